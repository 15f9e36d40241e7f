"""The query of each operator of this folder, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, exact_dedup, fill_middle, fingerprint, html_text, jaccard, langid, mixing, simhash, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those whose fold is not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.train(docs, usable=fold != 1)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are control strings, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    out = chat.format_chats(rows.unionByName(own)).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid_order",
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows
), moved AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS earlier, lead(role) OVER (PARTITION BY conv_id ORDER BY i) AS later FROM numbered
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) + 1
         + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars,
       bool_and((earlier IS NULL AND role IN ('system', 'user')) OR (earlier IN ('system', 'assistant') AND role = 'user') OR (earlier = 'user' AND role = 'assistant'))
         AND coalesce(bool_and(role <> 'system') FILTER (later IS NULL), false) AS valid_order
FROM moved GROUP BY conv_id
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts in documents and the row of each that stays."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


#: The rank file that the token queries use.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and the texts that they decode to, as digests."""
    out = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits: an insertion, a deletion and a replacement."""
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    edit = lambda start, end, text: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(text).alias("text"))
    third, half, most = F.floor(n / 3), F.floor(n / 2), F.floor(n * 3 / 4)
    edits = F.array(edit(third, third, " (edited 2026) "), edit(half, half + 17, ""), edit(most, most + 1, "n't\n"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    return token_counts.edited_counts(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose five-word shingles are alike."""
    return jaccard.similar_groups(_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike these and the next document are."""
    return fingerprint.compared_with_edit(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected severity of all documents; the labels have the grades 0 and 1."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return toxicity.severities(docs, toxicity.train(docs, labels))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: sizes, targets and the words taken of each document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_docs, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][((r - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM per
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, source_docs, r,
         coalesce(least(cap, weight * (SELECT arg_min(level, (cap / weight, r)) FROM levels WHERE level * weight < cap)), cap) AS target
  FROM levels
), seats AS (SELECT round(sum(target) / 32)::BIGINT AS n, count(*) AS m, sum(target) AS t FROM targets),
asked AS (
  SELECT source, r, unnest(range(1, (target / t * n + m)::BIGINT + 3)) AS k, target FROM targets, seats WHERE target > 0
), ranked AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, r, k) AS place FROM asked
), quotas AS (
  SELECT t.*, (SELECT count(*) FROM ranked, seats WHERE place <= n AND ranked.source IS NOT DISTINCT FROM t.source) AS quota,
         greatest(ceil(source_size / 1048576), ceil(source_docs / 32768), 1)::BIGINT AS shards
  FROM targets t
), placed AS (
  SELECT s.*, q.source_size, q.target, q.quota, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS o, q.shards
  FROM sizes s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
), sharded AS (SELECT *, o % shards AS shard FROM placed),
cells AS (
  SELECT source, shard, sum(size)::BIGINT AS shard_size, max(quota) AS quota,
         CASE WHEN sum(size) > 0 THEN greatest(round(sum(size) / 32), 1) ELSE 0 END::BIGINT AS blocks
  FROM sharded GROUP BY source, shard
), whole AS (SELECT *, sum(blocks) OVER (PARTITION BY source) AS b, count(*) OVER (PARTITION BY source) AS m FROM cells),
cell_asked AS (
  SELECT source, shard, quota, blocks, unnest(range(1, (quota * blocks / b + m)::BIGINT + 3)) AS k FROM whole WHERE blocks > 0
), cell_ranked AS (
  SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY blocks / (2 * k - 1) DESC, shard, k) AS place FROM cell_asked
), cell_quotas AS (
  SELECT c.*, least(2 * blocks, (SELECT count(*) FROM cell_ranked x WHERE place <= x.quota AND x.source IS NOT DISTINCT FROM c.source AND x.shard = c.shard)) AS q,
         ('0x' || substr(md5('mix/blocks|' || coalesce(source, '') || '|' || shard), 1, 12))::BIGINT AS mark
  FROM cells c
), laid AS (
  SELECT s.*, c.shard_size, c.blocks, c.q, c.mark,
         coalesce(sum(s.size) OVER (PARTITION BY s.source, s.shard ORDER BY s.o, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM sharded s JOIN cell_quotas c ON s.source IS NOT DISTINCT FROM c.source AND s.shard = c.shard
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (q // blocks) + coalesce(list_sum(list_transform(
         list_filter(range(first * blocks // shard_size, (first + size - 1) * blocks // shard_size + 1),
           lambda b: (b * [16777259, 33554467, 67108879, 134217757][(mark % 4 + 1)::INT] + mark % blocks) % blocks < q % blocks),
         lambda b: least(((b + 1) * shard_size + blocks - 1) // blocks - first, size) - greatest((b * shard_size + blocks - 1) // blocks - first, 0))), 0) END AS BIGINT) AS taken
FROM laid
"""


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    out = html_text.main_texts(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their units put in fill-in-middle order, and the texts that come back from it, as digests."""
    out = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(sha256('42:' || doc_id), k, 8))::BIGINT) AS h
  FROM documents
), formed AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the groups that links of three bits or fewer make of them."""
    out = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.shown(F.col("fp")).alias("fingerprint"), "component_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words stand together more often than chance."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT doc_id, lang, piece, row_number() OVER () AS p FROM (
    SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), words AS (SELECT lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
spans AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, w[i:i + m - 1] AS g, count(*) AS f FROM spans GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) >= 2) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:] JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
  SELECT lang, g[i:i + m - 1] AS g, max(a) AS longer
  FROM (SELECT lang, g, a, m, unnest(range(1, len(g) - m + 2)) AS i FROM best, (SELECT unnest([2, 3, 4]) AS m) WHERE len(g) > m) GROUP BY ALL
), ranked AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g WHERE i.longer IS NULL OR 100 * i.longer < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked QUALIFY rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_chat_format": op2_chat_format,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_fingerprint": op6_fingerprint,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_source_mix": op9_source_mix,
    "op10_html_text": op10_html_text,
    "op11_fill_middle": op11_fill_middle,
    "op12_simhash": op12_simhash,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {"op2_chat_format": OP2_SQL, "op5_ngram_jaccard": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op9_source_mix": OP9_SQL, "op11_fill_middle": OP11_SQL, "op13_collocations": OP13_SQL}
