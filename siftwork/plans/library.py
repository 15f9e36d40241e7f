"""Queries of readers and writers, uploads, the index, rules of records, parsers, hashes, reports, client streams and the review loop.

Inputs that the tables do not hold (files, manifests, answers of models) are made from whole tables; those that are
written as files come from nation, which has the same rows at every scale.
"""

from __future__ import annotations

import json

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, paths, text
from ..operators import chunking, evaluate, indexing, models, projections, review, scan, search, usage
from ..providers import ProviderError, unavailable
from ..sources import blocks, readers, tables
from ..sources.shared import shared_folder
from ..sources.tables import ISSUES_SQL, NODE_RUNS_SQL, files, issues, node_runs, query_set
from ..sources.versions import VersionedTable
from ..streaming import events as streams
from ..streaming import tasks
from . import workflow
from .catalog import FILES, query

NUL = "chr(0)"


# --- readers and writers ---------------------------------------------------------------------------------------------


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "nation")


@query("""SELECT n_nationkey::BIGINT AS nation, (strlen(n_name) + 1)::DOUBLE AS length, CAST(NULL AS VARCHAR) AS error, sha256(n_name || chr(10)) AS sha256 FROM nation
UNION ALL SELECT -1, NULL, 'FILE_STAT_FAILED', NULL ORDER BY nation""")
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with a file for each nation, read back; one more file is registered and not there. In order."""
    root = shared_folder(spark, "tree")
    _nation(spark, sf_dir).select("n_nationkey", F.col("n_name").alias("value")).repartition(1).write.partitionBy("n_nationkey").text(root)
    found = readers.source_tree(spark, root).where("path like '%.txt'").withColumn("path", F.regexp_extract("path", r"n_nationkey=(\d+)", 1))
    registered = _nation(spark, sf_dir).select(F.col("n_nationkey").cast("string").alias("path")).union(spark.createDataFrame([("-1",)], "path string"))
    out = readers.outcomes(registered, found).select(F.col("path").cast("long").alias("nation"), F.col("length").cast("double").alias("length"), "error", F.sha2("content", 256).alias("sha256"))
    return out.orderBy("nation")


@query("""SELECT doc_id AS file_id, CASE WHEN doc_id % 50 <> 7 THEN strlen(t)::DOUBLE END AS length, CASE WHEN doc_id % 50 <> 7 THEN sha256(t) END AS sha256, CASE WHEN doc_id % 50 = 7 THEN 'FILE_STAT_FAILED' END AS error,
CASE WHEN doc_id % 50 <> 7 THEN length(t) - length(replace(t, chr(0), '')) END::DOUBLE AS nul FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN chr(0) || 'x' ELSE '' END AS t FROM documents)""")
def files_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document, some with a NUL, read in blocks; every fiftieth is registered and was never written."""
    root = shared_folder(spark, "tree")
    d = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 9 == 0, F.concat(F.char(F.lit(0)), F.lit("x"))).otherwise("")).cast("binary").alias("content"))
    named = d.withColumn("path", F.concat_ws("/", F.col("file_id") % 16, F.concat("file_id", F.lit(".txt"))))
    blocks.written(named.where("file_id % 50 <> 7"), root).count()
    out = blocks.facts(named.select("path"), root)
    return out.select(F.regexp_extract("path", r"(\d+)\.txt", 1).cast("long").alias("file_id"), F.col("length").cast("double").alias("length"), "sha256", "error", F.col("nul").cast("double").alias("nul"))


@query("""SELECT doc_id AS file_id, CASE WHEN doc_id % 5 = 0 THEN concat('new ', doc_id) ELSE sha256(coalesce(text, '')) END AS content FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 5 = 0
UNION ALL SELECT doc_id, concat('more ', doc_id) FROM documents WHERE doc_id % 5 = 0""")
def versioned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the files stored, every fifth replaced, a job that fails half-way, a replacement that is rolled back."""
    d = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content"))
    table = VersionedTable(spark, shared_folder(spark, "versions"), d.schema, ["file_id"])
    table.replace(d.where("file_id % 3 <> 0"))
    fifth = d.where("file_id % 5 = 0")
    stored = table.replace(fifth.select("file_id", F.explode(F.array(F.concat(F.lit("new "), "file_id"), F.concat(F.lit("more "), "file_id"))).alias("content")))
    try:
        table.replace(d.select("file_id", F.when(F.col("file_id") % 2 == 1, F.raise_error(F.lit("half-way")).cast("string")).otherwise(F.lit("never")).alias("content")))
    except PySparkException:
        pass
    table.replace(d.select("file_id", F.lit("wrong").alias("content")))
    table.rollback(stored)
    return table.read()


def _json_file(spark: SparkSession, rows: DataFrame, name: str, head: str = "", tail: str = "") -> str:
    """One file with the rows, a bounded number, as a JSON list between head and tail."""
    path = shared_folder(spark, name)
    listed = rows.select(F.struct("*").alias("x")).agg(F.to_json(F.array_sort(F.collect_list("x"))).alias("all"))
    listed.select(F.concat(F.lit(head), "all", F.lit(tail)).alias("value")).coalesce(1).write.text(path)
    return path


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return _nation(spark, sf_dir).select(
        F.concat(F.lit("g"), n).alias("id"), F.when(n % 2 == 0, "java").otherwise("python").alias("language"), F.lit("security").alias("category"), F.concat(F.lit("src/"), "n_name").alias("relative_path"),
        F.when(n % 3 != 0, F.concat(F.lit("CWE-"), n)).alias("cwe_id"), F.when(n % 5 != 0, n.cast("int")).alias("start_line"), n.cast("int").alias("end_line"), F.when(n % 4 == 1, F.lit(False)).alias("vulnerable"),
        F.concat(F.lit("f"), n).alias("fingerprint"),
    )


@query("""SELECT concat('g', n_nationkey) AS id, concat('src/', n_name) AS relative_path, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey ELSE 0 END::INT AS start_line, n_nationkey % 4 <> 1 AS vulnerable, 0 AS sink_line FROM nation""")
def labelled_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled findings written as JSON and read back; left out are the fields that have a default."""
    path = _json_file(spark, _findings(spark, sf_dir).drop("fingerprint"), "truth", '{"name": "n", "entries": ', "}")
    return readers.ground_truth(spark, path).select("id", "relative_path", "start_line", "vulnerable", "sink_line")


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY concat('src/', n_name)) - 1 AS i FROM nation), f AS (SELECT i AS prediction_index, concat('f', n_nationkey) AS fingerprint, CASE WHEN n_nationkey % 3 <> 0 THEN concat('CWE-', n_nationkey) ELSE '' END AS cwe_id, 'Medium' AS risk_level FROM n)
SELECT 'object' AS form, * FROM f UNION ALL SELECT 'list', * FROM f""")
def predicted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written as an object with a list and as a bare list, and no file at all; read by one predictor."""
    rows = _findings(spark, sf_dir).select("relative_path", "start_line", "end_line", "language", "category", "cwe_id", "fingerprint")
    roots = {"object": _json_file(spark, rows, "object", '{"predictions": ', "}"), "list": _json_file(spark, rows, "list"), "none": shared_folder(spark, "none")}
    predictor = lambda root, language: readers.predictions(spark, root)
    out = [predictor(root, "java").select(F.lit(form).alias("form"), F.col("prediction_index").cast("long").alias("prediction_index"), "fingerprint", "cwe_id", "risk_level") for form, root in roots.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


MANIFEST = {
    "schema_version": 1, "repetitions": 3, "languages": ["java", "python"],
    "groups": [{"id": "size", "variants": [{"name": "few", "include_fingerprints": {"java": ["f0", "f2"], "python": []}}, {"name": "many", "include_fingerprints": {"java": ["f0", "f2", "f4", "f6"], "python": ["f1", "f3"]}}]}],
}


@query("""WITH v AS (SELECT * FROM (VALUES ('size', 'few', 'java', ['f0', 'f2']), ('size', 'many', 'java', ['f0', 'f2', 'f4', 'f6']), ('size', 'many', 'python', ['f1', 'f3'])) t(group_id, variant, language, chosen))
SELECT group_id, variant, language, concat('f', n_nationkey) AS fingerprint FROM nation JOIN v ON list_contains(chosen, concat('f', n_nationkey)) AND language = CASE WHEN n_nationkey % 2 = 0 THEN 'java' ELSE 'python' END""")
def manifest_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions that the variants of a manifest choose."""
    path = shared_folder(spark, "manifest")
    spark.createDataFrame([(json.dumps(MANIFEST),)], "value string").coalesce(1).write.text(path)
    _, variants = readers.manifest_variants(spark, path)
    return _findings(spark, sf_dir).select("language", "fingerprint").join(F.broadcast(variants), ["language", "fingerprint"]).select("group_id", "variant", "language", "fingerprint")


@query("""SELECT variant, json_extract_string(j, '$.findings')::BIGINT AS findings FROM (SELECT l_returnflag AS variant, json_object('variant', l_returnflag, 'findings', count(*)) AS j FROM lineitem GROUP BY l_returnflag)""")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as JSON and read back."""
    path = shared_folder(spark, "result")
    readers.written_json(tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("variant")).agg(F.count("*").alias("findings")), path)
    return spark.read.schema("variant string, findings long").json(path)


@query("""WITH old AS (SELECT o_orderkey AS file_id, o_custkey AS v FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS file_id, -o_custkey AS v FROM orders WHERE o_orderkey % 2 = 0)
SELECT file_id, v FROM new UNION ALL SELECT file_id, v FROM old WHERE file_id NOT IN (SELECT file_id FROM new)""")
def replaced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders")
    old, new = (o.where(c).select(F.col("o_orderkey").alias("file_id"), v.alias("v")) for c, v in (("o_orderkey % 3 <> 0", F.col("o_custkey")), ("o_orderkey % 2 = 0", -F.col("o_custkey"))))
    return readers.replaced(old, new, ["file_id"])


@query("""WITH n AS (SELECT user_id AS task_id, CASE WHEN event_id % 5 <> 0 THEN event_id % 7 END AS chunk_id, min(event_id) AS id FROM events GROUP BY ALL), o AS (SELECT DISTINCT user_id AS task_id, CASE WHEN event_id % 5 <> 0 THEN event_id % 7 END AS chunk_id FROM events WHERE event_id % 11 = 0)
SELECT task_id, chunk_id::DOUBLE AS chunk_id, id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.task_id = n.task_id AND o.chunk_id IS NOT DISTINCT FROM n.chunk_id)""")
def appended_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that an insert adds where some are stored; a trace may have no chunk."""
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 7).alias("chunk_id"), F.col("event_id").alias("id"))
    out = readers.appended_once(e.where("id % 11 = 0"), e, ["task_id", "chunk_id"], "id")
    return out.withColumn("chunk_id", F.col("chunk_id").cast("double"))


@query("SELECT user_id AS task_id, max(event_id) AS position, arg_max(event_type, event_id) AS report FROM events GROUP BY user_id")
def upserted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("position"), F.col("event_type").alias("report"))
    return readers.upserted(e.where("position % 3 = 0"), e.where("position % 3 <> 0"), ["task_id"], "position")


@query(f"""WITH n AS ({NODE_RUNS_SQL}), old AS (SELECT task_id, run_id % 50 AS k, status, 1 + run_id % 3 AS attempt FROM n WHERE run_id < 3000 AND run_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY task_id, run_id % 50 ORDER BY run_id) = 1),
new AS (SELECT task_id, run_id % 50 AS k, status FROM n WHERE run_id % 2 = 0 OR run_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY task_id, run_id % 50 ORDER BY run_id DESC) = 1)
SELECT coalesce(n.task_id, o.task_id) AS task_id, coalesce(n.k, o.k)::VARCHAR AS run_key, CASE WHEN n.k IS NULL OR o.status = 'success' THEN o.status ELSE n.status END AS status,
  CASE WHEN n.k IS NULL OR o.status = 'success' THEN o.attempt ELSE coalesce(o.attempt + 1, 1) END AS attempt FROM new n FULL JOIN old o ON o.task_id = n.task_id AND o.k = n.k""")
def recorded_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs recorded over earlier ones: those that succeeded stay, others count one more attempt."""
    r = node_runs(spark, sf_dir).select("task_id", (F.col("run_id") % 50).cast("string").alias("run_key"), "status", "run_id")
    early = r.where("run_id < 3000 and run_id % 2 = 0").withColumn("at", -F.col("run_id"))
    old = readers.upserted(early.where("run_id < 1000"), early.where("run_id >= 1000"), ["task_id", "run_key"], "at").select("task_id", "run_key", "status", (1 + F.col("run_id") % 3).alias("attempt"))
    late = r.where("run_id % 2 = 0 or run_id % 3 = 0")
    new = readers.upserted(late.where("run_id % 2 = 0"), late.where("run_id % 2 <> 0"), ["task_id", "run_key"], "run_id").select("task_id", "run_key", "status", F.lit(1).cast("long").alias("attempt"))
    return readers.recorded_runs(old, new)


@query("""SELECT n_nationkey AS nation, CASE n_nationkey % 3 WHEN 0 THEN concat('中文', n_name) WHEN 1 THEN concat('é', n_name) END AS text, CASE n_nationkey % 3 WHEN 0 THEN 'gb18030' WHEN 1 THEN 'utf-8-sig' END AS encoding FROM nation""")
def legacy_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in an older Chinese encoding, in UTF-8, and in none."""
    k, name = F.col("n_nationkey"), F.col("n_name").cast("binary")
    content = F.when(k % 3 == 0, F.concat(F.unhex(F.lit("D6D0CEC4")), name)).when(k % 3 == 1, F.concat(F.unhex(F.lit("C3A9")), name)).otherwise(F.concat(name, F.unhex(F.lit("81FF"))))
    return readers.legacy_text(_nation(spark, sf_dir).select(k.cast("string").alias("path"), content.alias("content"))).select(F.col("path").cast("int").alias("nation"), "text", "encoding")


# --- uploads and scans -----------------------------------------------------------------------------------------------

SENT = f"""{FILES}, sent AS (SELECT *, CASE file_id % 5 WHEN 0 THEN text || chr(0) WHEN 1 THEN repeat(chr(1), 3) || left(text, 4) ELSE text END AS body, CASE file_id % 4 WHEN 0 THEN 'Text/Plain; charset=x' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN NULL ELSE CASE WHEN file_id % 3 = 0 THEN 'image/png' ELSE 'text/x-java' END END AS mime FROM files),
facts AS (SELECT *, strlen(body) AS n, contains(body, chr(0)) AS has_nul, length(body) - length(regexp_replace(body, '[\\x00-\\x08\\x0B\\x0E-\\x1F]', '', 'g')) AS control FROM sent)"""


@query(f"""WITH {SENT} SELECT file_id, n::BIGINT AS size, sha256(body) AS sha256, has_nul, control::BIGINT AS control_bytes,
  CASE WHEN mime = 'image/png' THEN 'UNSUPPORTED_MEDIA_TYPE' WHEN n <> size THEN 'SIZE_MISMATCH' WHEN n > 1048576 THEN 'SINGLE_FILE_SIZE_EXCEEDED' WHEN has_nul OR control * 10 > n * 3 THEN 'BINARY_FILE' END AS rejection FROM facts""")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of uploaded bytes and why some are refused."""
    k = F.col("file_id")
    body = F.when(k % 5 == 0, F.concat("text", F.decode(F.unhex(F.lit("00")), "UTF-8"))).when(k % 5 == 1, F.concat(F.decode(F.unhex(F.lit("010101")), "UTF-8"), F.left("text", F.lit(4)))).otherwise(F.col("text"))
    mime = F.when(k % 4 == 0, "Text/Plain; charset=x").when(k % 4 == 1, "application/octet-stream").when(k % 4 == 3, F.when(k % 3 == 0, "image/png").otherwise("text/x-java"))
    out = files(spark, sf_dir).select("file_id", F.col("size").alias("declared"), mime.alias("mime"), readers.byte_facts(body.cast("binary")).alias("facts"))
    return out.select("file_id", "facts.size", "facts.sha256", "facts.has_nul", "facts.control_bytes", scan.upload_rejection(F.col("mime"), F.col("declared"), F.col("facts")).alias("rejection"))


@query(f"""WITH RECURSIVE {FILES}, n AS (SELECT project, file_id, size, row_number() OVER (PARTITION BY project ORDER BY file_id) AS i FROM files WHERE project IS NOT NULL),
u AS (SELECT DISTINCT project, 0::BIGINT AS i, 0::BIGINT AS used, -1::BIGINT AS file_id, false AS accepted FROM n
  UNION ALL SELECT u.project, n.i, u.used + CASE WHEN u.used + n.size <= 20000 THEN n.size ELSE 0 END, n.file_id, u.used + n.size <= 20000 FROM u JOIN n ON n.project = u.project AND n.i = u.i + 1)
SELECT project, file_id, accepted FROM u WHERE i > 0""")
def upload_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a manifest that fit 20,000 bytes, in order; one that does not fit is passed over."""
    return scan.capped(files(spark, sf_dir).where("project is not null").select("project", "file_id", "size"), ["project"], "file_id", "size", 20000).select("project", "file_id", "accepted")


@query(f"""WITH {FILES}, p AS (SELECT file_id, concat(path, '#', file_id) AS path FROM files), s AS (SELECT path, CASE WHEN file_id % 4 = 0 THEN 'skipped' ELSE 'included' END AS status FROM p WHERE file_id % 7 <> 3)
SELECT file_id, coalesce(s.status, 'failed') AS scan_status, CASE WHEN s.status IS NULL THEN 'SCANNER_OMITTED' WHEN s.status = 'skipped' THEN 'LOCK_FILE' END AS scan_reason FROM p LEFT JOIN s USING (path)""")
def scan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan's results on the files of a project; the scan left some out."""
    f = files(spark, sf_dir).select("file_id", F.concat_ws("#", "path", "file_id").alias("path"))
    skipped = F.col("file_id") % 4 == 0
    told = f.where("file_id % 7 <> 3").select("path", F.when(skipped, "skipped").otherwise("included").alias("status"), F.when(~skipped, "low").alias("priority"), F.when(skipped, "LOCK_FILE").alias("reason"))
    return scan.applied(f, told).select("file_id", "scan_status", "scan_reason")


# --- hashes, paths, versions, times ----------------------------------------------------------------------------------


@query(f"""WITH {FILES}, f AS (SELECT *, replace(path, '/', '\\') AS w, length(text) % 50 AS s FROM files)
SELECT file_id, sha256(concat(path, {NUL}, s, {NUL}, s + 3, {NUL}, 'r1', {NUL}, sha256(text))) AS issue_fingerprint, sha256(concat(path, {NUL}, 'run', {NUL}, s, {NUL}, s + 3)) AS symbol_hash, sha256(concat('review:', s, ':', file_id % 2, ':0:', file_id)) AS run_key FROM f""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.char_length("text") % 50).cast("long")
    windows = F.replace("path", F.lit("/"), F.lit("\\"))
    return files(spark, sf_dir).select(
        "file_id", text.issue_fingerprint(windows, s, s + 3, F.lit("r1"), F.col("text")).alias("issue_fingerprint"), text.symbol_hash(F.col("path"), F.lit("run"), s, s + 3).alias("symbol_hash"),
        text.run_key(F.lit("review"), s, F.col("file_id") % 2, F.lit(0), F.col("file_id")).alias("run_key"),
    )


@query(f"""WITH {FILES}, f AS (SELECT *, CASE file_id % 3 WHEN 0 THEN 'java' WHEN 1 THEN 'python' ELSE 'go' END AS l FROM files)
SELECT file_id, CASE l WHEN 'java' THEN concat('a.B.run::x', file_id) WHEN 'python' THEN concat('a.B#run.x', file_id) ELSE concat('a.B#run::x', file_id) END AS normalized,
  CASE l WHEN 'java' THEN 'Runtime.exec|ProcessBuilder|Statement.execute|ObjectInputStream|SpelExpressionParser' WHEN 'python' THEN 'eval|exec|pickle.loads|subprocess|shell=True|yaml.load' ELSE '' END AS hints,
  concat('key ', file_id, CASE WHEN file_id % 2 = 0 THEN ' auth' ELSE '' END, CASE WHEN file_id % 5 <> 0 THEN chr(10) || 'said so' ELSE '' END) AS rewritten FROM f""")
def review_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of languages, the hints of these, and queries written again from keywords, focus and feedback."""
    k = F.col("file_id")
    language = F.when(k % 3 == 0, "java").when(k % 3 == 1, "python").otherwise("go")
    words = F.array(F.lit("key"), F.lit(""), k.cast("string"))
    return files(spark, sf_dir).select(
        "file_id", text.normalize_query(F.concat(F.lit("a.B#run::x"), k), language).alias("normalized"), F.array_join(chunking.risk_hints(language), "|").alias("hints"),
        text.rewritten_query(words, F.when(k % 2 == 0, F.array(F.lit("auth"))).otherwise(F.array().cast("array<string>")), F.array(F.when(k % 5 != 0, "said so").otherwise(""))).alias("rewritten"),
    )


@query(f"""WITH {FILES} SELECT file_id, regexp_replace(path, '^[^/]*/', '') AS without_root, array_to_string(list_sort(list_distinct(list_filter([path, 'top.py', regexp_replace(path, '/[^/]*$', '')], lambda p: p <> ''))), '|') AS with_parents FROM files""")
def folder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client paths without their first folder, and paths with the folders that hold them."""
    return files(spark, sf_dir).select("file_id", paths.without_root(F.col("path")).alias("without_root"), F.array_join(paths.with_parents(F.array("path", F.lit("top.py"))), "|").alias("with_parents"))


@query("""WITH v AS (SELECT doc_id AS id, concat(doc_id % 3, '.', doc_id % 12, '.', doc_id % 5, CASE WHEN doc_id % 4 = 0 THEN 'rc1' ELSE '' END, CASE WHEN doc_id % 7 = 0 THEN '.x' ELSE '' END) AS v FROM documents),
n AS (SELECT id, list_transform(string_split(v, '.'), lambda p: coalesce(TRY_CAST(regexp_extract(p, '^\\d+') AS INT), 0)) AS n FROM v) SELECT id, array_to_string(n, '.') AS numbers, n >= [1, 8, 0] AS new_enough FROM n""")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    v = F.concat((k % 3).cast("string"), F.lit("."), (k % 12).cast("string"), F.lit("."), (k % 5).cast("string"), F.when(k % 4 == 0, "rc1").otherwise(""), F.when(k % 7 == 0, ".x").otherwise(""))
    n = numbers.version(v)
    return tables.table(spark, sf_dir, "documents").select(k.alias("id"), F.array_join(n.cast("array<string>"), ".").alias("numbers"), (n >= F.array(F.lit(1), F.lit(8), F.lit(0))).alias("new_enough"))


@query("""WITH e AS (SELECT event_id, ts, event_id * 274 + 1 AS ms, CASE WHEN event_id % 5 <> 0 THEN (event_id % 1000) * 1237 ELSE NULL END AS micro, CASE event_id % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'partial' ELSE 'unavailable' END AS st,
  CASE WHEN event_id % 6 = 0 THEN date_trunc('second', ts) ELSE ts END AS moment FROM events)
SELECT event_id AS id, ((ms + 50) // 100)::DOUBLE / 10 AS elapsed, concat(strftime(moment, '%Y-%m-%dT%H:%M:%S'), CASE WHEN moment <> date_trunc('second', moment) THEN strftime(moment, '.%f') ELSE '' END, '+00:00') AS iso,
  CASE WHEN st = 'available' AND micro IS NOT NULL THEN printf('$%d.%06d', micro // 1000000, micro % 1000000) WHEN st = 'partial' THEN CASE WHEN coalesce(micro, 0) <> 0 THEN printf('~$%d.%06d', micro // 1000000, micro % 1000000) ELSE 'partial' END ELSE 'cost_unavailable' END AS shown FROM e""")
def report_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations, times and costs as reports show them."""
    k = F.col("event_id")
    at = F.when(k % 6 == 0, F.date_trunc("second", "ts")).otherwise(F.col("ts"))
    cost = F.when(k % 5 != 0, ((k % 1000) * 1237).cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)"))
    status = F.when(k % 3 == 0, "available").when(k % 3 == 1, "partial").otherwise("unavailable")
    return tables.table(spark, sf_dir, "events").select(
        k.alias("id"), numbers.elapsed_seconds(F.lit(0).cast("timestamp"), F.timestamp_millis(k * 274 + 1)).alias("elapsed"), numbers.iso_time(at).alias("iso"), numbers.cost_display(cost, status).alias("shown")
    )


@query("""SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE concat('a|', doc_id) END AS items, doc_id % 9 AS start_line, greatest(doc_id % 9, doc_id % 5) AS end_line FROM documents""")
def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists from values that may be single or missing, ranges in order."""
    k = F.col("doc_id")
    raw = F.when(k % 4 == 1, F.lit('"a"')).when(k % 4 > 1, F.concat(F.lit('["a", "'), k, F.lit('"]')))
    r = projections.ordered_range(k % 9, k % 5)
    return tables.table(spark, sf_dir, "documents").select(k.alias("id"), F.array_join(projections.as_list(raw, "string"), "|").alias("items"), r["start_line"].alias("start_line"), r["end_line"].alias("end_line"))


# --- index -----------------------------------------------------------------------------------------------------------


def _provider(texts: list[str]) -> list[tuple[int, list[float]]]:
    """Hashes as vectors, last text first; down for texts whose length is divisible by 11."""
    if any(len(t) % 11 == 0 for t in texts):
        raise ProviderError("EMBEDDING_PROVIDER_UNAVAILABLE")
    return list(reversed(readers.hash_provider(texts, 8)))


@query(f"WITH {FILES} SELECT file_id, CASE WHEN NOT bool_or(length(text) % 11 = 0) OVER (PARTITION BY file_id // 10) THEN 8 END::DOUBLE AS dimension FROM files")
def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in batches of ten; the provider answers in another order, and fails a batch that holds a certain text."""
    chunks = files(spark, sf_dir).select(F.col("file_id").alias("chunk_id"), F.col("text").alias("content"), F.call_function("div", F.col("file_id"), F.lit(10)).alias("batch"))
    out = readers.batched_embeddings(chunks, _provider, 10, 8, "batch")
    own = F.round(F.element_at("embedding", 1), 5) == F.round(F.col("first"), 5)
    told = readers.batched_embeddings(chunks.select("chunk_id", "content"), lambda texts: readers.hash_provider(texts, 8), 1, 8).select("chunk_id", F.element_at("embedding", 1).alias("first"))
    out = out.join(told, "chunk_id").withColumn("embedding", F.when(own, F.col("embedding")))
    return out.select(F.col("chunk_id").alias("file_id"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("double").alias("dimension"))


@query("SELECT c_custkey AS query_id, 'embedding_failed|symbol_ilike_no_match' AS degradation FROM customer WHERE trim(c_name) <> ''")
def unavailable_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of queries, the customers' names, where the embedding provider is not configured and nothing is found."""
    q = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("query"))
    nothing = q.select("query_id").where(F.lit(False))
    return search.degradations(search.embedded(q, unavailable, 8), nothing, nothing, nothing)


INDEXED = f"""{FILES}, h AS (SELECT file_id, coalesce(project, '') AS project, text, sha256(text) AS hash, CASE WHEN file_id % 3 = 0 THEN NULL WHEN file_id % 7 = 0 THEN 'changed' ELSE sha256(text) END AS old_hash, CASE WHEN file_id % 13 = 0 THEN '0' ELSE '1' END AS old_version, file_id % 4 <> 2 AS old_ready FROM files)"""


@query(f"""WITH {INDEXED}, source AS (SELECT project, old_hash AS hash, min(file_id) AS reused_from FROM h WHERE old_hash IS NOT NULL AND old_ready GROUP BY ALL),
j AS (SELECT h.*, coalesce(old_hash = h.hash AND old_version = '1', false) AS current, reused_from, strlen(path_text) AS bytes, length(path_text) AS chars FROM (SELECT *, text AS path_text FROM h) h LEFT JOIN source s ON s.project = h.project AND s.hash = h.hash)
SELECT file_id, 1::BIGINT AS chunks, CASE WHEN current THEN old_ready ELSE reused_from IS NOT NULL OR (bytes <= 3000 AND chars % 11 <> 0) END::BIGINT AS ready, CASE WHEN current THEN old_ready ELSE reused_from IS NOT NULL END::BIGINT AS reused, current AS reused_file,
  CASE WHEN current OR reused_from IS NOT NULL THEN NULL WHEN bytes > 3000 THEN 'EMBEDDING_INPUT_TOKEN_LIMIT' WHEN chars % 11 = 0 THEN 'EMBEDDING_PROVIDER_FAILED' END AS error FROM j""")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built over an older one: files that are as they were, changed and new ones, reused vectors, too long texts, a provider that fails."""
    k = F.col("file_id")
    f = files(spark, sf_dir).select("file_id", F.coalesce("project", F.lit("")).alias("project"), k.alias("chunk_id"), F.lit("fp").alias("chunk_fingerprint"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.lit("1").alias("version"), F.col("text").alias("search_text"))
    ready = k % 4 != 2
    old = f.where("file_id % 3 <> 0").withColumns({
        "content_hash": F.when(k % 7 == 0, "changed").otherwise(F.col("content_hash")), "version": F.when(k % 13 == 0, "0").otherwise("1"), "embedding": F.when(ready, F.array_repeat(F.lit(0.5), 8).cast("array<float>")),
        "embedding_status": F.when(ready, "ready").otherwise("keyword_only"), "embedding_error": F.lit(None).cast("string"), "search_tokens": search.words_of(F.col("search_text")),
    })
    index, told = indexing.indexed_files(f, old, _provider, 8, text.token_bytes, 3000, 1)
    errors = index.select("file_id", F.col("embedding_error").alias("error"))
    return told.join(errors, "file_id").select("file_id", "chunks", "ready", "reused", "reused_file", "error")


@query("""WITH w AS (SELECT doc_id AS file_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS words FROM documents), t AS (SELECT file_id, len(words) AS length, unnest(words) AS token FROM w)
SELECT token, file_id, length, count(*) AS tf FROM t GROUP BY ALL""")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(tables.index_chunks(spark, sf_dir))


REFS_SQL = "SELECT l_orderkey AS file_id, concat('s', l_linenumber % 3) AS source, concat('t', l_partkey % 4) AS target, CASE WHEN l_suppkey % 2 = 0 THEN 'call' ELSE 'import' END AS relation, l_orderkey * 10 + l_linenumber AS pos, l_quantity AS q FROM lineitem"


@query(f"WITH r AS ({REFS_SQL}) SELECT file_id, source, target, relation, min(pos) AS pos FROM r GROUP BY ALL")
def unique_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal references of a file; lines that repeat a number have one position."""
    r = tables.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS file_id", "concat('s', l_linenumber % 3) AS source", "concat('t', l_partkey % 4) AS target", "CASE WHEN l_suppkey % 2 = 0 THEN 'call' ELSE 'import' END AS relation", "l_orderkey * 10 + l_linenumber AS pos")
    return indexing.unique_references(r, "pos")


@query("""SELECT o_orderkey AS relation_id, o_orderkey AS source_symbol, CASE WHEN (o_custkey % 10) <> 4 THEN o_custkey END::DOUBLE AS target_symbol FROM orders WHERE o_orderkey % 10 <> 4 OR o_orderkey NOT IN (SELECT c_custkey FROM customer)""")
def deleted_file_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations after the symbols of a tenth of the files are deleted; a symbol's file is its last digit."""
    symbols = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol_id"), (F.col("c_custkey") % 10).alias("file_id"))
    relations = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("relation_id"), F.col("o_orderkey").alias("source_symbol"), F.col("o_custkey").alias("target_symbol"))
    out = indexing.without_file(relations, symbols, spark.createDataFrame([(4,)], "file_id long"))
    return out.select("relation_id", "source_symbol", F.col("target_symbol").cast("double").alias("target_symbol"))


SPANS_SQL = "SELECT o_custkey AS file_id, o_orderkey AS id, o_orderkey % 40 AS s, o_orderkey % 40 + o_orderkey % 17 AS e FROM orders"


@query(f"""WITH x AS ({SPANS_SQL}) SELECT a.id AS item_id, (SELECT arg_min(d.id, (d.e - d.s, d.id)) FROM x d WHERE d.file_id = a.file_id AND d.id % 2 = 0 AND d.s <= a.s AND d.e >= a.e AND NOT (d.s = a.s AND d.e = a.e))::DOUBLE AS owner FROM x a""")
def owning_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest definition around each node of a file."""
    k = F.col("o_orderkey")
    x = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), k.alias("item_id"), (k % 40).alias("start"), (k % 40 + k % 17).alias("end"))
    out = indexing.owning_interval(x, x.where("item_id % 2 = 0").withColumnRenamed("item_id", "def_id"))
    return out.select("item_id", F.col("owner").cast("double").alias("owner"))


# --- usage and evaluation --------------------------------------------------------------------------------------------


@query("""SELECT event_id AS id, event_id % 3 + event_id % 4 AS calls, event_id % 100 + event_id % 70 AS tokens, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN (event_id % 11 + event_id % 13)::DOUBLE END AS cost, event_id % 5 <> 0 AND event_id % 7 <> 0 AS available FROM events""")
def combined_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage of an answer and of its repair."""
    k = F.col("event_id")
    call = lambda calls, tokens, cost, off: F.struct((k % calls).alias("calls"), (k % tokens).alias("tokens"), (k % cost).cast("double").alias("cost"), (k % off != 0).alias("available"))
    return tables.table(spark, sf_dir, "events").select(k.alias("id"), usage.combined(call(3, 100, 11, 5), call(4, 70, 13, 7)).alias("u")).select("id", "u.*")


@query(f"""WITH n AS ({NODE_RUNS_SQL}) SELECT concat_ws('/', coalesce(provider, 'unknown'), coalesce(model, 'unknown'), CASE WHEN run_id % 2 = 0 THEN 'v2' ELSE 'unconfigured' END) AS pricing, count(*) AS runs FROM n WHERE status = 'success' AND node_type IN ('llm', 'embedding') GROUP BY 1""")
def pricing_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.pricing_groups(node_runs(spark, sf_dir).withColumn("v", F.when(F.col("run_id") % 2 == 0, "v2")), [], "v").select("pricing", "runs")


@query(f"""WITH n AS ({NODE_RUNS_SQL}) SELECT run_id, CASE WHEN run_id % 9 = 0 THEN 'cancelled' WHEN run_id % 8 = 0 THEN 'asked' WHEN input_tokens >= 90 THEN 'max_calls' WHEN output_tokens >= 15 THEN 'token_budget' END AS stop FROM n""")
def budget_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the reasons to stop before a node runs."""
    k = F.col("run_id")
    return node_runs(spark, sf_dir).select("run_id", workflow.budget_stop(k % 9 == 0, F.when(k % 8 == 0, "asked"), F.col("input_tokens"), 90, F.col("output_tokens"), 15).alias("stop"))


@query("""WITH r AS (SELECT event_id % 40 AS list_id, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN user_id % 20 END AS hit FROM events), f AS (SELECT *, hit IS NOT NULL AND row_number() OVER (PARTITION BY list_id, hit ORDER BY pos) = 1 AS new FROM r)
SELECT pos, round(sum(new::INT) OVER (PARTITION BY list_id ORDER BY pos) / 20.0::DOUBLE, 9) AS recall FROM f""")
def recall_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of twenty labelled ids up to each rank of a list; an id found again counts once."""
    r = tables.table(spark, sf_dir, "events").select((F.col("event_id") % 40).alias("list_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 20).alias("hit"))
    return search.running_recall(r, F.lit(20), "list_id", "pos", "hit").select("pos", F.round("recall", 9).alias("recall"))


#: A labelled range and a prediction for each order, some without the other: one of each in a file, so that whether they
#: match does not depend on the matching.
ONE_SQL = """t AS (SELECT o_orderkey AS gt_id, CASE WHEN o_custkey % 2 = 0 THEN 'java' ELSE 'python' END AS language, o_orderkey % 30 + 3 AS sink, o_orderkey % 30 + 1 AS s, o_orderkey % 30 + 1 + o_custkey % 6 AS e, o_orderkey % 8 <> 5 AS vulnerable FROM orders),
p AS (SELECT o_orderkey AS prediction_index, CASE WHEN o_custkey % 2 = 0 THEN 'java' ELSE 'python' END AS language, o_orderkey % 30 + o_custkey % 4 AS s, o_orderkey % 30 + o_custkey % 4 + o_orderkey % 5 AS e, CASE WHEN o_custkey % 3 = 0 THEN 'High' ELSE 'Low' END AS risk FROM orders WHERE o_orderkey % 9 <> 2),
m AS (SELECT prediction_index, gt_id, p.language, risk, sink BETWEEN p.s AND p.e AS covers FROM p JOIN t ON gt_id = prediction_index AND vulnerable
  WHERE sink BETWEEN p.s AND p.e OR greatest(0, least(p.e, t.e) - greatest(p.s, t.s) + 1)::DOUBLE / (t.e - t.s + 1) >= 0.5)"""


def _ones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(truth, predictions) of ONE_SQL."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    own = {"language": F.when(c % 2 == 0, "java").otherwise("python"), "path": F.concat(F.lit("src/f"), k, F.lit(".x")), "category": F.when(k % 2 == 0, "security").otherwise("quality"), "cwe_id": F.concat(F.lit("CWE-"), k % 3)}
    o, named = tables.table(spark, sf_dir, "orders"), [v.alias(n) for n, v in own.items()]
    start, found = (k % 30 + 1).cast("int"), (k % 30 + c % 4).cast("int")
    truth = o.select(k.alias("gt_id"), *named, (start + 2).alias("sink_line"), start.alias("start_line"), (start + c % 6).cast("int").alias("end_line"), (k % 8 != 5).alias("vulnerable"))
    p = o.where("o_orderkey % 9 <> 2").select(
        k.alias("prediction_index"), *named, found.alias("start_line"), (found + k % 5).cast("int").alias("end_line"), F.when(c % 3 == 0, "High").otherwise("Low").alias("risk_level"), F.concat(F.lit("p"), k).alias("fingerprint")
    )
    return truth, p


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0 ELSE ({part})::DOUBLE / ({whole}) END"


@query(f"""WITH {ONE_SQL}, c AS (SELECT language, (SELECT count(*) FROM p WHERE p.language = l.language) AS n, (SELECT count(*) FROM p WHERE p.language = l.language AND risk = 'High') AS high, (SELECT count(*) FROM t WHERE t.language = l.language AND vulnerable) AS truth,
  (SELECT count(*) FROM m WHERE m.language = l.language) AS tp, (SELECT count(*) FROM m WHERE m.language = l.language AND risk = 'High') AS tp_high, (SELECT count(*) FROM m WHERE m.language = l.language AND covers) AS hit FROM (SELECT DISTINCT language FROM p) l)
SELECT language, tp, n - tp AS fp, truth - tp AS fn, round({_ratio('tp', 'n')}, 9) AS precision, round({_ratio('tp', 'truth')}, 9) AS recall, round({_ratio('2 * tp', 'n + truth')}, 9) AS f1, round({_ratio('high - tp_high', 'high')}, 9) AS high_risk_fp_rate, round({_ratio('hit', 'tp')}, 9) AS localization_rate FROM c""")
def evaluation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = _ones(spark, sf_dir)
    m = evaluate.matched(evaluate.candidates(p, t))
    m = m.join(p.select("prediction_index", "language"), "prediction_index")
    out = evaluate.evaluation(p, t, m, ["language"])
    return out.select("language", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "high_risk_fp_rate", "localization_rate")])


@query(f"""WITH {ONE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY prediction_index) - 1 AS position FROM p), k AS (SELECT unnest([10, 100, 1000]) AS k),
n AS (SELECT language, count(*) AS truth FROM t WHERE vulnerable GROUP BY language)
SELECT language, k, round((SELECT count(*) FROM m JOIN r USING (prediction_index) WHERE m.language = n.language AND position < k)::DOUBLE / truth, 9) AS recall FROM n, k""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the first predictions of each language, matched again for each k."""
    t, p = _ones(spark, sf_dir)
    at = F.row_number().over(Window.partitionBy("language").orderBy("prediction_index")) - 1
    return evaluate.recall_by_prefix(p.withColumn("position", at), t, [10, 100, 1000], ["language"]).withColumn("recall", F.round("recall", 9))


@query(f"""WITH {ONE_SQL} SELECT 'label' AS side, gt_id AS id FROM t WHERE vulnerable AND gt_id NOT IN (SELECT gt_id FROM m) UNION ALL SELECT 'prediction', prediction_index FROM p WHERE prediction_index NOT IN (SELECT prediction_index FROM m)""")
def unmatched_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = _ones(spark, sf_dir)
    labels, predictions = evaluate.unmatched(t, p, evaluate.matched(evaluate.candidates(p, t)))
    return labels.select(F.lit("label").alias("side"), F.col("gt_id").alias("id")).unionByName(predictions.select(F.lit("prediction").alias("side"), F.col("prediction_index").alias("id")))


# --- client streams --------------------------------------------------------------------------------------------------

KINDS = ("started", "scanned", "note", "completed", "note", "note", "note", "scanned", "note", "note", "failed")
STREAM_SQL = f"""e AS (SELECT event_id AS id, user_id AS task_id, [{', '.join(f"'{k}'" for k in KINDS)}][(event_id % {len(KINDS)} + 1)::INT] AS event_type, event_id % 101 AS progress FROM events),
c AS (SELECT DISTINCT user_id AS task_id, CASE WHEN user_id % 10 = 0 THEN 1000000000 ELSE user_id * 3 END AS cursor FROM events)"""


CLIENTS_SQL = f"""WITH {STREAM_SQL}, n AS (SELECT e.*, row_number() OVER (PARTITION BY task_id ORDER BY id) AS place FROM e JOIN c USING (task_id) WHERE id > cursor QUALIFY place <= 20),
s AS (SELECT *, coalesce(bool_or(event_type IN ('completed', 'partial', 'failed', 'cancelled')) OVER (PARTITION BY task_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM n)
SELECT task_id, place::INT AS place, id::DOUBLE AS id, concat('id: ', id, chr(10), 'event: ', event_type, chr(10), 'data: {{"id":', id, ',"task_id":', task_id, ',"progress":', progress, '}}', chr(10), chr(10)) AS frame, event_type IN ('completed', 'partial', 'failed', 'cancelled') AS done FROM s WHERE NOT ended
UNION ALL SELECT task_id, 0, NULL, concat(': heartbeat', chr(10), chr(10)), false FROM c WHERE task_id NOT IN (SELECT task_id FROM n)"""


@query(CLIENTS_SQL)
def client_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the clients of all tasks are sent next: twenty events at most, none behind a final one, or a heartbeat."""
    e = tables.table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.col("event_id") % len(KINDS) + 1).cast("int"))
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), kind.alias("event_type"), (F.col("event_id") % 101).alias("progress"))
    cursors = rows.select("task_id").distinct().withColumn("cursor", F.when(F.col("task_id") % 10 == 0, 1000000000).otherwise(F.col("task_id") * 3))
    out = streams.client_stream(rows, cursors, 20)
    return out.withColumn("id", F.col("id").cast("double"))


def _grown(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """A stream over a folder to which rows are added."""
    rows.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query(CLIENTS_SQL)
def live_client_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames from a stream with state: clients come, then their events, then nothing; restarted in between.

    Heartbeats go on for as long as nothing is sent; they count once.
    """
    base = shared_folder(spark, "live")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.col("event_id") % len(KINDS) + 1).cast("int"))
    rows = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), kind.alias("event_type"), (F.col("event_id") % 101).alias("progress"))
    cursors = rows.select("task_id").distinct().withColumn("cursor", F.when(F.col("task_id") % 10 == 0, 1000000000).otherwise(F.col("task_id") * 3).cast("long"))
    for k in range(3):
        e, c = _grown(spark, rows.where(F.lit(k == 1)), f"{base}/events"), _grown(spark, cursors.where(F.lit(k == 0)), f"{base}/clients")
        tasks.run(tasks.client_frames(e, c, 20), f"{base}/checkpoint", f"{base}/sink", once=True)
    return spark.read.parquet(f"{base}/sink").drop("batch").distinct().withColumn("id", F.col("id").cast("double"))


@query("SELECT DISTINCT ON (user_id, k) user_id, json_extract_string(props, '$.k') AS k, event_id AS id FROM events ORDER BY user_id, k, event_id")
def live_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first request of each key from a stream that is stopped half-way and started again."""
    base = shared_folder(spark, "live")
    r = tables.table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("idempotency_key"), F.col("event_id").alias("id"))
    half = r.agg(F.percentile_approx("id", 0.5)).first()[0]
    for part in (F.col("id") <= half, F.col("id") > half):
        tasks.run(tasks.least_requests(_grown(spark, r.where(part), f"{base}/requests")), f"{base}/checkpoint", f"{base}/sink", "update")
    return spark.read.parquet(f"{base}/sink").groupBy("user_id", F.col("idempotency_key").alias("k")).agg(F.min("id").alias("id"))


@query("SELECT event_id AS id, user_id AS task_id FROM events")
def appended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of all events appended to a sink twice: the checkpoint delivers each once."""
    base = shared_folder(spark, "stream")
    for _ in range(2):
        e = spark.readStream.schema("event_id long, user_id long").parquet(sf_dir, pathGlobFilter="events.parquet") if not _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema("event_id long, user_id long").parquet(f"{sf_dir}/events.parquet")
        streams.appended(e, f"{base}/sink", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("event_id long, user_id long").parquet(f"{base}/sink").select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


# --- rules of records ------------------------------------------------------------------------------------------------


def _rules(rows: DataFrame, kind: str) -> DataFrame:
    return review.violations(rows, review.RULES[kind]()).select(F.lit(kind).alias("record"), "rule", "violations")


def _broken(table: str, kind: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{kind}' AS record, '{rule}' AS rule, count(CASE WHEN {broken} THEN 1 END) AS violations FROM {table}" for rule, broken in rules.items())


@query(" UNION ALL ".join([
    _broken("documents", "chunks", {"start_line": "doc_id % 10 = 0", "line_range": "doc_id % 7 < doc_id % 10 - 1", "parse_confidence": "doc_id % 20 > 10", "embedding_status": "doc_id % 5 = 4", "index_status": "doc_id % 4 = 3"}),
    _broken("documents", "relations", {"confidence": "doc_id % 20 > 10", "relation_type": "doc_id % 6 = 5", "resolution_status": "doc_id % 4 = 3"}),
    _broken("documents", "issues", {"line_range": "doc_id % 7 < doc_id % 10 - 1", "security_cwe": "doc_id % 5 = 0 AND doc_id % 3 <> 0", "confidence": "doc_id % 20 > 10", "category": "doc_id % 5 = 4", "risk_level": "doc_id % 4 = 3"}),
    _broken("events", "tasks", {"progress": "event_id % 120 > 100", "llm_call_count": "event_id % 9 = 0", "input_tokens": "event_id % 8 = 0", "output_tokens": "false", "cost_status": "event_id % 4 = 3"}),
    _broken("events", "events", {"progress": "event_id % 120 > 100"}),
    _broken("documents", "parsed_chunks", {"placed": "doc_id % 11 = 0 OR lang IS NULL", "line_range": "doc_id % 10 = 0 OR doc_id % 7 < doc_id % 10 - 1", "content": "coalesce(text, '') = ''", "confidence": "doc_id % 20 > 10"}),
    _broken("documents", "parsed_references", {"ends": "doc_id % 11 = 0 OR doc_id % 13 = 0", "confidence": "doc_id % 20 > 10"}),
]))
def record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stored and parsed records break each rule; the records are made so that some do."""
    k, e = F.col("doc_id"), F.col("event_id")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    place = {"start_line": (k % 10).cast("int"), "end_line": (k % 7 + 1).cast("int"), "parse_confidence": k % 20 / 10, "confidence": k % 20 / 10}
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumns(place)
    ends = {"path": F.when(k % 11 != 0, F.concat(F.lit("f"), k)), "language": F.col("lang"), "content": F.col("text"), "source": F.concat(F.lit("s"), k), "target": F.when(k % 13 != 0, "t").otherwise("")}
    kinds = {"embedding_status": pick(k, "pending", "ready", "failed", "keyword_only", "lost"), "index_status": pick(k, "pending", "ready", "failed", "gone")}
    types = {"relation_type": pick(k, "call", "import", "extend", "implement", "reference", "guess"), "resolution_status": pick(k, "resolved", "unresolved", "external", "open")}
    found = {"category": pick(k, "security", "bug", "performance", "maintainability", "style"), "cwe_id": F.when(k % 3 == 0, "CWE-1").when(k % 3 == 1, ""), "risk_level": pick(k, "High", "Medium", "Low", "Huge")}
    v = tables.table(spark, sf_dir, "events").select("event_id", (e % 120).alias("progress"), F.when(e % 9 == 0, -1).otherwise(1).alias("llm_call_count"), F.when(e % 8 == 0, -5).otherwise(e).alias("input_tokens"), F.lit(0).alias("output_tokens"), pick(e, "available", "unavailable", "partial", "free").alias("cost_status"))
    out = [_rules(d.withColumns(kinds), "chunks"), _rules(d.withColumns(types), "relations"), _rules(d.withColumns(found), "issues"), _rules(v, "tasks"), _rules(v, "events"), _rules(d.withColumns(ends), "parsed_chunks"), _rules(d.withColumns(ends), "parsed_references")]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


UNIQUE = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "documents": ["doc_id"], "conversations": ["conv_id", "turn"], "events": ["user_id", "event_type"], "labels": ["doc_id"]}


@query(" UNION ALL ".join(f"SELECT '{t}' AS record, count(*) AS repeated FROM (SELECT {', '.join(keys)} FROM {t} GROUP BY ALL HAVING count(*) > 1)" for t, keys in UNIQUE.items()))
def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of several tables that more than one row has."""
    out = [review.repeated_keys(tables.table(spark, sf_dir, t), keys).agg(F.count("*").alias("repeated")).select(F.lit(t).alias("record"), "repeated") for t, keys in UNIQUE.items()]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


# --- reports, plans, the review loop ---------------------------------------------------------------------------------


@query(f"WITH i AS ({ISSUES_SQL}) SELECT DISTINCT issue_id, task_id, title, path, category, risk_level, fingerprint FROM i WHERE task_id = 7")
def issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the owner of a task reads of its issues, as a set."""
    return review.issue_projection(issues(spark, sf_dir).withColumn("user_id", F.col("task_id")), owner=7).distinct()


@query(f"""WITH i AS ({ISSUES_SQL}) SELECT task_id, count(CASE WHEN risk_level = 'High' THEN 1 END) AS high, count(CASE WHEN risk_level = 'Medium' THEN 1 END) AS medium, count(CASE WHEN coalesce(risk_level, 'Low') = 'Low' THEN 1 END) AS low, count(*) AS total FROM i WHERE task_id = 7 GROUP BY task_id""")
def owned_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a task for its owner, and for somebody else, who gets none."""
    reports = review.severity_stats(issues(spark, sf_dir), ["task_id"]).withColumn("user_id", F.col("task_id"))
    return review.report_projection(reports, 7, 7).unionByName(review.report_projection(reports, 7, 8))


@query(f"WITH i AS ({ISSUES_SQL}) SELECT DISTINCT issue_id, task_id, title, path, category, risk_level, fingerprint FROM i WHERE issue_id = 71")
def one_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.issue_projection(issues(spark, sf_dir), 71).distinct()


REPORT_SQL = f"""i AS (SELECT *, concat(title, ' ', path) AS d, row_number() OVER (PARTITION BY task_id, verified ORDER BY pos, title, path, fingerprint) AS number FROM (SELECT DISTINCT * FROM ({ISSUES_SQL}))),
b AS (SELECT task_id, verified, number, concat('### ', number, '. ', CASE risk_level WHEN 'High' THEN '🔴' WHEN 'Medium' THEN '🟡' WHEN 'Low' THEN '🟢' ELSE '⚪' END, ' ', title, chr(10), chr(10),
  '- **Category:** ', coalesce(category, '?'), chr(10), '- **Type:** ', 'T', task_id % 3, chr(10), '- **Risk:** ', coalesce(risk_level, '?'), chr(10), '- **Rule:** ', CASE WHEN pos % 4 = 0 THEN 'N/A' ELSE concat('r', pos % 4) END, chr(10), '- **CWE:** N/A', chr(10),
  '- **File:** `', path, '` L', pos % 50, '-L', pos % 50 + 2, chr(10), '- **Confidence:** ', pos % 101, '%', chr(10), '- **Critic:** ', coalesce(decision, 'pending'), chr(10), '- **Human review:** ', CASE WHEN coalesce(decision = 'uncertain', false) THEN 'Yes' ELSE 'No' END, chr(10), chr(10),
  '**Description:**', chr(10), chr(10), d, chr(10), chr(10), '**Evidence:**', chr(10), chr(10), '```', chr(10), fingerprint, chr(10), '```', chr(10), chr(10), '**Reason:**', chr(10), chr(10), chr(10), chr(10), '**Suggestion:**', chr(10), chr(10), 'mend it') AS block FROM i),
s AS (SELECT task_id, count(CASE WHEN risk_level = 'High' THEN 1 END) AS high, count(CASE WHEN risk_level = 'Medium' THEN 1 END) AS medium, count(CASE WHEN coalesce(risk_level, 'Low') = 'Low' THEN 1 END) AS low, count(*) AS total FROM i GROUP BY task_id),
k AS (SELECT task_id, string_agg(concat('- **', c, '**: ', n), chr(10) ORDER BY c) AS kinds FROM (SELECT task_id, coalesce(category, 'unknown') AS c, count(*) AS n FROM i GROUP BY ALL) GROUP BY task_id),
x AS (SELECT task_id, string_agg(block, chr(10) || chr(10) ORDER BY number) FILTER (verified) AS good, count(*) FILTER (verified) AS n_good, string_agg(block, chr(10) || chr(10) ORDER BY number) FILTER (NOT verified) AS bad, count(*) FILTER (NOT verified) AS n_bad FROM b GROUP BY task_id),
y AS (SELECT *, CASE task_id % 3 WHEN 0 THEN '$1.500000' WHEN 1 THEN '~$0.250000' ELSE 'cost_unavailable' END AS cost, CASE WHEN task_id % 4 = 0 THEN 'N/A' ELSE concat(task_id, '.0') END AS seconds FROM s JOIN k USING (task_id) JOIN x USING (task_id))
SELECT task_id, sha256(concat('# Code Review Report — ', CASE WHEN task_id % 5 = 0 THEN 'Unnamed Project' ELSE concat('P', task_id) END, chr(10), chr(10), '**Task ID:** ', task_id, '  ', chr(10), '**Generated:** 2024-02-03 04:05 UTC  ', chr(10), '**Cost:** ', cost, '  ', chr(10), '**Duration:** ', seconds, 's  ', chr(10), chr(10),
  CASE WHEN task_id % 2 = 0 THEN concat('## Summary', chr(10), chr(10), 'All in all.', chr(10), chr(10)) ELSE '' END, CASE WHEN task_id % 6 = 1 THEN concat('> ⚠️ **Stop reason:** max_calls', chr(10), chr(10)) ELSE '' END,
  '## Severity', chr(10), chr(10), '| Level  | Count |', chr(10), '|--------|-------|', chr(10), '| 🔴 High   | ', high, ' |', chr(10), '| 🟡 Medium | ', medium, ' |', chr(10), '| 🟢 Low    | ', low, ' |', chr(10), '| **Total** | **', total, '** |', chr(10), chr(10),
  '## Issue Types', chr(10), chr(10), kinds, chr(10), chr(10), '## Coverage', chr(10), chr(10), '- Plan items: ', CASE WHEN task_id % 7 = 0 THEN 'N/A' ELSE (task_id % 7)::VARCHAR END, chr(10), '- Verified issues: ', n_good, chr(10), '- Rejected issues: ', n_bad, chr(10), chr(10),
  CASE WHEN task_id % 2 = 1 THEN concat('## Degradation', chr(10), chr(10), '- **a**: none', chr(10), '- **b**: some', chr(10), chr(10)) ELSE '' END,
  CASE WHEN n_good > 0 THEN concat('## Verified Issues (', n_good, ')', chr(10), chr(10), good, chr(10), chr(10)) ELSE '' END, CASE WHEN n_bad > 0 THEN concat('## Rejected Issues (', n_bad, ')', chr(10), chr(10), bad, chr(10), chr(10)) ELSE '' END,
  '## Metrics', chr(10), chr(10), '- LLM calls: ', task_id, chr(10), '- Input tokens: 1,234,567', chr(10), '- Output tokens: 0', chr(10), '- Estimated cost: ', cost, chr(10), '- Elapsed: ', seconds, 's', chr(10))) AS markdown_sha256 FROM y"""


def _reported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t, p = F.col("task_id"), F.col("pos")
    i = review.numbered(issues(spark, sf_dir), "task_id", ["pos", "title", "path", "fingerprint"]).withColumns({
        "issue_type": F.concat(F.lit("T"), t % 3), "rule_id": F.when(p % 4 != 0, F.concat(F.lit("r"), p % 4)), "cwe_id": F.lit(None).cast("string"), "start_line": p % 50, "end_line": p % 50 + 2, "confidence": (p % 101) / 100,
        "critic_decision": F.col("decision"), "needs_human_review": F.col("decision") == "uncertain", "description": F.concat("title", F.lit(" "), "path"), "evidence": F.col("fingerprint"), "reason": F.lit(None).cast("string"),
        "suggestion": F.lit("mend it"),
    })
    tasks = issues(spark, sf_dir).select("task_id").distinct().select(
        "task_id", F.when(t % 5 != 0, F.concat(F.lit("P"), t)).alias("project"), F.lit("2024-02-03 04:05:06").cast("timestamp").alias("generated_at"), F.when(t % 2 == 0, "All in all.").alias("summary"),
        F.when(t % 6 == 1, "max_calls").alias("stop_reason"), F.when(t % 7 != 0, t % 7).alias("plan_items"), F.when(t % 2 == 1, F.create_map(F.lit("b"), F.lit("some"), F.lit("a"), F.lit("none"))).alias("degradation"), t.alias("calls"),
        F.lit(1234567).alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"), F.when(t % 3 == 0, F.lit(1.5)).otherwise(0.25).cast("decimal(12,6)").alias("cost"),
        F.when(t % 3 == 0, "available").when(t % 3 == 1, "partial").otherwise("unavailable").alias("cost_status"), F.lit(0).cast("timestamp").alias("started_at"), F.when(t % 4 != 0, F.timestamp_seconds(t)).alias("finished_at"),
    )
    return tasks, i


@query(f"WITH {REPORT_SQL}")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of all tasks, as digests."""
    out = review.report_markdown(*_reported(spark, sf_dir), "task_id")
    return out.select("task_id", F.sha2(F.col("markdown").cast("binary"), 256).alias("markdown_sha256"))


@query(f"""WITH {REPORT_SQL.rsplit("SELECT task_id, sha256(", 1)[0]} SELECT task_id, CASE WHEN verified THEN 8 ELSE 9 END AS section, number, sha256(block) AS text_sha256 FROM b
UNION ALL SELECT task_id, 8, 0, sha256(concat('## Verified Issues (', n_good, ')')) FROM y WHERE n_good > 0 UNION ALL SELECT task_id, 9, 0, sha256(concat('## Rejected Issues (', n_bad, ')')) FROM y WHERE n_bad > 0
UNION ALL SELECT task_id, 4, 0, sha256(concat('## Severity', chr(10), chr(10), '| Level  | Count |', chr(10), '|--------|-------|', chr(10), '| 🔴 High   | ', high, ' |', chr(10), '| 🟡 Medium | ', medium, ' |', chr(10), '| 🟢 Low    | ', low, ' |', chr(10), '| **Total** | **', total, '** |')) FROM y
UNION ALL SELECT task_id, 5, 0, sha256(concat('## Issue Types', chr(10), chr(10), kinds)) FROM y""")
def report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of all reports that come from issues, each as a digest: severity, types, issues."""
    parts = review.report_parts(*_reported(spark, sf_dir), "task_id").where(F.col("section").isin(4, 5, review.VERIFIED, review.REJECTED))
    return parts.select("task_id", "section", F.col("number").cast("long").alias("number"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ITEMS_SQL = """items AS (SELECT o_custkey AS task_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_orderkey % 40 AS top_k FROM orders),
planned AS (SELECT *, least(greatest(top_k, 1), 30) AS k FROM items WHERE position <= 10)"""


@query(f"""WITH {ITEMS_SQL} SELECT item_id, k AS top_k, concat('q', item_id) AS query, 'src/a/|' AS target_paths, 0 AS attempt FROM planned
UNION ALL SELECT item_id, k, CASE WHEN item_id % 2 = 0 THEN concat('word', item_id, ' auth') ELSE concat('q', item_id) END, 'src/a/|', 1 FROM planned
UNION ALL SELECT item_id, least(k * 2, 30), concat('q', item_id), 'src|src/a', 2 FROM planned""")
def planned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of plans, and what retries of their retrieval ask for."""
    planned = workflow.plan_items(_items(spark, sf_dir))
    told = lambda rows, attempt: rows.select("item_id", F.col("top_k").cast("long").alias("top_k"), "query", F.array_join("target_paths", "|").alias("target_paths"), F.lit(attempt).alias("attempt"))
    return told(planned, 0).unionByName(told(workflow.retried_items(planned, 0), 1)).unionByName(told(workflow.retried_items(planned, 1), 2))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    words = F.when(k % 2 == 0, F.array(F.concat(F.lit("word"), k))).otherwise(F.array().cast("array<string>"))
    return tables.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"), k.alias("item_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("position"), (k % 40).alias("top_k"), F.concat(F.lit("q"), k).alias("query"),
        words.alias("keywords"), F.when(k % 2 == 0, F.array(F.lit("auth"))).otherwise(F.array().cast("array<string>")).alias("risk_focus"), F.array(F.lit("src/a/"), F.lit("")).alias("target_paths"),
    )


@query(f"WITH {FILES} SELECT project, string_agg(path, chr(10) || chr(10) ORDER BY file_id) AS context FROM files WHERE project IS NOT NULL GROUP BY project")
def joined_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.joined_contexts(files(spark, sf_dir).where("project is not null").select("project", "file_id", F.col("path").alias("context")), ["project"], "file_id")


#: Each order is an item with one issue a round. Its context suffices from a retry on that its number names, if at all;
#: evidence, decisions and what the critic says in the second round depend on it too.
REVIEW_SQL = f"""{ITEMS_SQL}, going AS (SELECT * FROM planned WHERE task_id % 17 <> 3), ready AS (SELECT * FROM going WHERE item_id % 4 < 3),
one AS (SELECT *, CASE WHEN item_id % 7 = 0 THEN 'evidence' WHEN item_id % 5 < 2 THEN 'pass' WHEN item_id % 5 = 2 THEN 'uncertain' WHEN item_id % 5 = 3 THEN 'fail' ELSE 'missing' END AS said FROM ready),
two AS (SELECT *, CASE WHEN item_id % 11 = 0 THEN 'evidence' WHEN item_id % 3 = 0 THEN 'pass' ELSE 'fail' END AS again FROM one WHERE said IN ('fail', 'missing'))"""


def _review(spark: SparkSession, sf_dir: str, **limits) -> workflow.Outcome:
    tasks = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id")).distinct()
    k = F.col("item_id")

    def retrieve(items: DataFrame, attempt: int) -> DataFrame:
        return items.withColumn("context", F.concat_ws(" ", "query", "top_k")).withColumn("sufficient", k % 4 <= attempt)

    def reviewer(contexts: DataFrame, round_: int, failed: DataFrame | None) -> DataFrame:
        return contexts.select("task_id", "item_id", F.lit(round_).alias("at"), F.concat(F.lit("fp"), k).alias("fingerprint"), F.concat(F.lit("src/"), k).alias("path"), F.lit("r").alias("rule_id"))

    def evidence(found: DataFrame) -> DataFrame:
        lacks = F.when(F.col("at") == 1, k % 7 == 0).otherwise(k % 11 == 0)
        return found.withColumn("evidence_status", F.when(lacks, "failed").otherwise("passed"))

    def critic(found: DataFrame, round_: int) -> DataFrame:
        first = F.when(k % 5 < 2, "pass").when(k % 5 == 2, "uncertain").when(k % 5 == 3, "fail")
        second = F.when(k % 3 == 0, "pass").otherwise("fail")
        return found.select("fingerprint", F.lit(1).alias("pos"), (first if round_ == 1 else second).alias("decision"), F.lit("said").alias("reason")).where("decision is not null")

    guard = lambda t: t.select("task_id", F.when(F.col("task_id") % 17 == 3, "token_budget").alias("stop_reason"))
    return workflow.run_review(tasks, workflow.Nodes(lambda t: _items(spark, sf_dir).join(t, "task_id", "left_semi"), retrieve, reviewer, evidence, critic, guard), **limits)


def _told(out: workflow.Outcome) -> DataFrame:
    found = [x.select("item_id", "round", "outcome", "reason") for x in out.issues] + [x.select("item_id", F.lit(0).alias("round"), F.lit("skipped").alias("outcome"), F.col("warning").alias("reason")) for x in out.warnings]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


ROUND_ONE = """SELECT item_id, 1 AS round, CASE WHEN said = 'evidence' THEN 'rejected' ELSE 'verified' END AS outcome, CASE WHEN said = 'evidence' THEN said ELSE 'said' END AS reason FROM one WHERE said NOT IN ('fail', 'missing')
UNION ALL SELECT item_id, 0, 'skipped', 'insufficient_context_exhausted' FROM going WHERE item_id % 4 = 3"""


@query(f"""WITH {REVIEW_SQL} {ROUND_ONE}
UNION ALL SELECT item_id, 2, CASE WHEN again = 'pass' THEN 'verified' ELSE 'rejected' END, CASE WHEN again = 'evidence' THEN again ELSE 'said' END FROM two""")
def review_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of review of all planned items, with retries of retrieval; some tasks are stopped by their budget."""
    return _told(_review(spark, sf_dir))


@query(f"""WITH {REVIEW_SQL} SELECT *, 'partial_success' AS status, 'graph_recursion_limit_exceeded' AS stop_reason FROM ({ROUND_ONE})""")
def review_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a limit of steps that the second round exceeds: what the first one gave, marked partial."""
    out = _review(spark, sf_dir, limit=11)
    return _told(out).withColumn("status", F.lit(out.status)).withColumn("stop_reason", F.lit(out.stop_reason))


# --- parsers and models ----------------------------------------------------------------------------------------------

JAVA = """package p;
import java.util.List;

/** class Not {n} { */
@Deprecated
public class C{n} extends Base implements Run, Stop {
  private int x;
  public C{n}(int x) { this.x = x; }
  int run(int y) throws E {
    String s = "call(";
    return helper(y) + this.other(s);
  }
  enum Kind { A, B }
}
"""


def _made(spark: SparkSession, sf_dir: str, source: str, language: str, end: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", F.concat(F.lit("src/F"), F.col("file_id"), F.lit(end)).alias("path"), F.lit(language).alias("language"), F.replace(F.lit(source), F.lit("{n}"), F.col("file_id").cast("string")).alias("text"))


def _facts(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", "kind", F.coalesce("symbol_type", "relation").alias("type"), F.coalesce("qualified_name", "source").alias("name"), F.coalesce("parent_symbol", "target").alias("other"), F.col("start_line").cast("double").alias("start_line"), F.col("end_line").cast("double").alias("end_line"), "confidence")


def _expected(facts: list[tuple]) -> str:
    """SQL for the same facts of every document; {n} stands for its number."""
    say = lambda v: "NULL" if v is None else "replace('" + v + "', '{n}', doc_id::VARCHAR)" if isinstance(v, str) else str(v)
    rows = " UNION ALL ".join(f"SELECT doc_id AS file_id, {say(a)} AS kind, {say(b)} AS type, {say(c)} AS name, {say(d)} AS other, {say(e)}::DOUBLE AS start_line, {say(f)}::DOUBLE AS end_line, {say(g)}::DOUBLE AS confidence FROM documents" for a, b, c, d, e, f, g in facts)
    return rows


@query(_expected([
    ("chunk", "class", "C{n}", None, 5, 14, 1.0), ("chunk", "constructor", "C{n}.C{n}", "C{n}", 8, 8, 1.0), ("chunk", "method", "C{n}.run", "C{n}", 9, 12, 1.0), ("chunk", "enum", "C{n}.Kind", "C{n}", 13, 13, 1.0),
    ("reference", "import", "<compilation_unit>", "java.util.List", None, None, 0.95), ("reference", "extend", "C{n}", "Base", None, None, 0.85), ("reference", "implement", "C{n}", "Run", None, None, 0.85),
    ("reference", "implement", "C{n}", "Stop", None, None, 0.85), ("reference", "call", "C{n}.run", "helper", None, None, 0.75), ("reference", "call", "C{n}.run", "this.other", None, None, 0.75),
]))
def parsed_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions and references of a Java source for each document."""
    return _facts(chunking.parsed(_made(spark, sf_dir, JAVA, "java", ".java")))


PYTHON = """import os, re
from . import near

class C{n}(Base):
    def run(self, x):
        def inner():
            return near.call(x)
        return inner()

async def main():
    await C{n}().run(1)
"""


@query(_expected([
    ("chunk", "class", "C{n}", None, 4, 8, 1.0), ("chunk", "method", "C{n}.run", "C{n}", 5, 8, 1.0), ("chunk", "function", "C{n}.run.inner", "C{n}.run", 6, 7, 1.0), ("chunk", "function", "main", None, 10, 11, 1.0),
    ("reference", "import", "<module>", "os", None, None, 0.95), ("reference", "import", "<module>", "re", None, None, 0.95), ("reference", "import", "<module>", ".", None, None, 0.95), ("reference", "extend", "C{n}", "Base", None, None, 0.8),
    ("reference", "call", "C{n}.run.inner", "near.call", None, None, 0.75), ("reference", "call", "C{n}.run", "inner", None, None, 0.75), ("reference", "call", "main", "C{n}().run", None, None, 0.75), ("reference", "call", "main", "C{n}", None, None, 0.75),
]))
def parsed_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions and references of a Python source for each document."""
    return _facts(chunking.parsed(_made(spark, sf_dir, PYTHON, "python", ".py")))


@query("""WITH f AS (SELECT doc_id AS file_id, 100 + doc_id % 200 AS lines FROM documents), w AS (SELECT file_id, lines, unnest(range(0, greatest(lines - 11, 0) + 1, 110)) AS o FROM f)
SELECT file_id, 'line_window' AS type, concat('<fallback:', o + 1, '>') AS name, o + 1 AS start_line, least(o + 120, lines) AS end_line, 0.35::DOUBLE AS confidence, CASE WHEN file_id % 2 = 0 THEN 'SYNTAX_ERROR' ELSE 'NO_PARSER' END AS error FROM w""")
def parser_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that do not parse, or that no parser reads: windows of lines that overlap."""
    k = F.col("file_id")
    f = files(spark, sf_dir).select("file_id", F.concat(F.lit("f"), k).alias("path"), F.when(k % 2 == 0, "python").otherwise("go").alias("language"), F.repeat(F.lit("def (\n"), (100 + k % 200).cast("int")).alias("text"))
    out = chunking.parsed(f)
    return out.select("file_id", F.col("symbol_type").alias("type"), F.col("symbol_name").alias("name"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "confidence", "error")


def _model(prompt: str) -> tuple[str, int, int]:
    """Answers by the number in the prompt: fenced, bare, mended when asked again, never right, not at all."""
    n = int(prompt.split()[1])
    if n % 5 == 4:
        raise ProviderError("MODEL_UNAVAILABLE")
    good = f'{{"k": {n}}}'
    if n % 5 == 0:
        return f"Here:\n```json\n{good}\n```", 10, 2
    wrong = n % 5 == 3 or n % 5 == 2 and "not valid" not in prompt
    return ("no" if wrong else f"so {good} it is"), 10, 2


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 < 3 THEN concat('{"k": ', n_nationkey, '}') END AS answer, CASE n_nationkey % 5 WHEN 4 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1 END::BIGINT AS calls, CASE n_nationkey % 5 WHEN 4 THEN 0 WHEN 2 THEN 20 WHEN 3 THEN 20 ELSE 10 END::BIGINT AS input_tokens,
  CASE n_nationkey % 5 WHEN 3 THEN 'INVALID_ANSWER' WHEN 4 THEN 'PROVIDER_FAILED' END AS error FROM nation""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured answers of a model, with one repair."""
    prompts = _nation(spark, sf_dir).select(F.col("n_nationkey").alias("id"), F.concat(F.lit("ask "), F.col("n_nationkey")).alias("prompt"))
    return models.answered(prompts, _model, ["k"]).select("id", "answer", "calls", "input_tokens", "error")
