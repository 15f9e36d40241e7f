"""Retrieval: full-text, substring, symbol and vector search, reciprocal-rank fusion, fallbacks, traces, recall.

Queries come as a table of bounded size, (query_id, query, vector) and perhaps project; it is broadcast, and every search
ranks all documents for all of them in one pass. A query with a project meets the chunks of that project only. Texts are
ranked first and joined to the few results afterwards. The vector search takes any number of queries, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, paths, text
from ..providers import EmbeddingProvider, ProviderError, Search, SearchFailed
from ..session import ship

FUSION_K, CANDIDATES = 60, 30
#: Queries of a block of the vector search, and decimals to which scores are compared.
BLOCK, DECIMALS = 4096, 9
#: Queries and vectors of a tile, the scores that a task makes at once.
TILE = 1024


def first_term(query: Column) -> Column:
    return F.regexp_extract(query, r"\S+", 0)


def words_of(value: Column) -> Column:
    """Lower-case words in order."""
    return F.filter(F.split(F.lower(value), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def tokens(value: Column) -> Column:
    """Lower-case words, each once."""
    return F.array_distinct(words_of(value))


def top(scored: DataFrame, k: int, score: str = "score", by: str = "query_id", item: str = "file_id") -> DataFrame:
    """The k best of each query with their rank; scores equal to DECIMALS places by the smaller id."""
    w = Window.partitionBy(by).orderBy(F.round(score, DECIMALS).desc(), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def visible(chunks: DataFrame, languages: Sequence[str] = (), target_paths: Sequence[str] = (), embedded: bool = False) -> DataFrame:
    """The chunks that a search may see: ready ones, of the languages if any are named, at or below the target paths.

    embedded: ones with a ready vector only.
    """
    out = chunks.where("index_status = 'ready'")
    if languages:
        out = out.where(F.col("language").isin(*languages))
    if target_paths:
        out = out.where(paths.below(F.col("path"), list(target_paths)))
    return out.where("embedding is not null and embedding_status = 'ready'") if embedded else out


def _of_projects(rows: DataFrame) -> DataFrame:
    return rows.withColumn("project", F.coalesce("project", F.lit("")) if "project" in rows.columns else F.lit(""))


def _sides(chunks: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with project; without one on either side all rows meet."""
    if "project" not in queries.columns or "project" not in chunks.columns:
        chunks, queries = (x.withColumn("project", F.lit("")) for x in (chunks, queries))
    return _of_projects(chunks), _of_projects(queries)


def keyword_all_terms(docs: DataFrame, queries: DataFrame, content: str = "search_text") -> DataFrame:
    """(query_id, file_id, n_tokens) where every token of the query stands in the text."""
    d, q = _sides(docs, queries)
    q = q.select("query_id", "project", tokens(F.col("query")).alias("wanted")).where(F.size("wanted") > 0)
    d = d.select("file_id", "project", tokens(F.col(content)).alias("have"))
    return d.join(F.broadcast(q), "project").where(F.size(F.array_except("wanted", "have")) == 0).select("query_id", "file_id", F.size("have").alias("n_tokens"))


def _holds(value: Column, term: Column, whole: str) -> Column:
    """value holds term, whose % and _ are wildcards; a pattern is only made of terms that have some. whole: that as SQL."""
    return F.when(term.rlike(r"[%_\\]"), F.expr(whole)).otherwise(value.contains(term))


def keyword_fallback(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, content: str = "search_text") -> DataFrame:
    """(query_id, file_id, score, rank) by occurrences of the query's first word; its % and _ stay wildcards.

    The search where the store has no full-text index.
    """
    d, q = _sides(docs, queries)
    q = q.select("query_id", "project", F.lower(first_term(F.col("query"))).alias("term")).where("term <> ''")
    d = d.select("file_id", "project", F.lower(F.col(content)).alias("_text"))
    found = d.join(F.broadcast(q), "project").where(_holds(F.col("_text"), F.col("term"), "_text LIKE concat('%', term, '%')"))
    return top(found.select("query_id", "file_id", text.occurrence_rank(F.col("_text"), F.col("term")).alias("score")), k)


def symbol_search(symbols: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, file_id, score, rank): symbols whose name or qualified name holds the query's first word, by id."""
    d, q = _sides(symbols, queries)
    q = q.select("query_id", "project", F.lower(first_term(F.col("query"))).alias("term")).where("term <> ''")
    names = [F.lower(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in ("symbol_name", "qualified_name")]
    d = d.select("file_id", "project", *names)
    holds = [_holds(F.col(f"_{c}"), F.col("term"), f"_{c} LIKE concat('%', term, '%')") for c in ("symbol_name", "qualified_name")]
    found = d.join(F.broadcast(q), "project").where(holds[0] | holds[1])
    return top(found.select("query_id", "file_id", F.lit(0.01).alias("score")).distinct(), k)


def postings(docs: DataFrame, content: str = "search_text") -> DataFrame:
    """(token, file_id, tf, length): the inverted index; partition it by token when it is written."""
    rows = docs.select("file_id", words_of(F.col(content)).alias("words")).select("file_id", F.size("words").alias("length"), F.explode("words").alias("token"))
    return rows.groupBy("token", "file_id", "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, content: str = "search_text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, file_id, score, rank) by BM25 over the documents that hold all tokens of the query.

    One pass counts documents, words and the queries' tokens by project, a second one scores where the text is read: no
    posting is shuffled, only the best of each task meet. Documents of an index have search_tokens, their words as they
    were derived when the index was written; then no text is read.
    """
    d, q = _sides(docs, queries)
    q = q.select("query_id", "project", tokens(F.col("query")).alias("wanted")).where(F.size("wanted") > 0)
    asked = q.select("project", F.explode("wanted").alias("token")).groupBy("project").agg(F.collect_set("token").alias("asked"))
    words = F.col("search_tokens") if "search_tokens" in docs.columns else words_of(F.col(content))
    d = d.select("file_id", "project", words.alias("words"))
    seen = d.join(F.broadcast(asked), "project").select("project", F.size("words").alias("length"), F.explode(F.array_append(F.array_intersect("asked", "words"), "")).alias("token"))
    counts = seen.groupBy("project", "token").agg(F.count("*").alias("n"), F.sum("length").alias("words"))
    whole = F.max(F.when(F.col("token") == "", F.struct("n", (F.col("words") / F.col("n")).alias("mean")))).alias("whole")
    stats = counts.groupBy("project").agg(whole, F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias("df"))
    asked = q.join(F.broadcast(stats), "project")
    met = d.join(F.broadcast(asked), "project").where(F.size(F.array_except("wanted", "words")) == 0)
    n, mean, length = F.col("whole")["n"], F.col("whole")["mean"], F.size("words")

    def part(total: Column, token: Column) -> Column:
        df, tf = F.try_element_at("df", token), F.size(F.filter("words", lambda w: w == token))
        return total + F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))

    return top(met.select("query_id", "file_id", F.aggregate("wanted", F.lit(0.0), part).alias("score")), k)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, file_id, score, rank): exact cosine similarity to every vector; 0 where a norm is 0.

    Queries come in blocks of BLOCK, each one matrix that a pass over the vectors multiplies tile by tile; a task gives its
    k best of each query, so what it holds and what meets follows the block and not the vectors or the pairs.
    """
    ship(vectors.sparkSession)
    d, q = _sides(vectors, queries.where("vector is not null"))
    rows, q = d.select("file_id", "project", "embedding").where("embedding is not null"), q.select("query_id", "project", "vector")
    kind = q.schema["query_id"].dataType.simpleString()
    blocks = -(-q.count() // BLOCK)
    asked = q.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))))
    found = [_block_search(rows, asked.where(F.col("_block") == n).drop("_block"), k, kind) for n in range(max(1, blocks))]
    return top(reduce(DataFrame.unionByName, found), k)


class Best:
    """The k best (query, file, score, more columns) of each of n queries among what one task sees.

    Rows are kept until they are twice as many as k of each query, then all but the best are dropped: memory follows n * k and
    not the rows seen. Scores equal to DECIMALS places go by the smaller file. least: a lower score of a query is of no use.
    """

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self._parts, self._rows, self._room = [], 0, max(1 << 18, n * k)

    def put(self, *columns: np.ndarray) -> None:
        self._parts.append(columns)
        self._rows += len(columns[0])
        if self._rows > 2 * self._room:
            self.cut()

    def cut(self) -> list[np.ndarray]:
        """The columns of the best."""
        if not self._parts:
            return []
        columns = [np.concatenate(c) for c in zip(*self._parts, strict=True)]
        order = np.lexsort((columns[1], -np.round(columns[2].astype(np.float64), DECIMALS), columns[0]))
        query = columns[0][order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = order[place == self.k - 1]
        self.least[columns[0][last]] = columns[2][last] - 10.0**-DECIMALS
        columns = [c[order[place < self.k]] for c in columns]
        self._parts, self._rows = [tuple(columns)], len(columns[0])
        return columns


def tiles(n: int) -> list[slice]:
    return [slice(k, k + TILE) for k in range(0, n, TILE)]


def _block_search(rows: DataFrame, queries: DataFrame, k: int, kind: str) -> DataFrame:
    told = queries.collect()
    ids, projects = np.array([r["query_id"] for r in told]), np.array([r["project"] for r in told], object)
    matrix = np.array([r["vector"] for r in told], np.float64)
    schema = f"query_id {kind}, file_id long, score double"
    of_project = {project: np.flatnonzero(projects == project) for project in set(projects)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        norms, best = np.sqrt((matrix * matrix).sum(axis=1)), Best(len(ids), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            files, owners = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), object)
            lists = batch.column(2)
            if set(lists.value_lengths().to_pylist()) != {matrix.shape[1]}:
                raise ValueError("vectors differ in length")
            own = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(files), -1)
            lengths = np.sqrt((own * own).sum(axis=1))
            for project, asked in of_project.items():
                here = np.flatnonzero(owners == project)
                for part in tiles(len(here)):
                    at = here[part]
                    for some in tiles(len(asked)):
                        q = asked[some]
                        size = norms[q][:, None] * lengths[at][None, :]
                        scores = np.divide(matrix[q] @ own[at].T, size, out=np.zeros(size.shape), where=size > 0)
                        i, j = np.nonzero(scores >= best.least[q][:, None])
                        best.put(q[i].astype(np.int32), files[at[j]], scores[i, j])
        found = best.cut()
        for n in range(0, len(found[0]) if found else 0, 1 << 16):
            query, file, score = (c[n : n + (1 << 16)] for c in found)
            yield pa.RecordBatch.from_arrays([pa.array(ids[query].astype(np.int32 if kind == "int" else np.int64)), pa.array(file), pa.array(score)], names=["query_id", "file_id", "score"])

    return rows.mapInArrow(run, schema)


def embedded(queries: DataFrame, provider: EmbeddingProvider, dimension: int) -> DataFrame:
    """queries with vector from the provider, asked once more where it fails or answers with the wrong size, else null."""
    ship(queries.sparkSession)

    def ask(query: str) -> list[float] | None:
        for _ in range(2):
            try:
                got = dict(provider([query]))
            except ProviderError:
                continue
            if len(got.get(0, ())) == dimension:
                return [float(x) for x in got[0]]
        return None

    @F.pandas_udf("array<double>")
    def vectors(texts):
        return texts.map(ask)

    return queries.withColumn("vector", F.when(text.strip(F.col("query")) != "", vectors(text.strip(F.col("query")))))


def fused(vector: DataFrame, keyword: DataFrame, top_k: int = 10, k: int = FUSION_K) -> DataFrame:
    """(query_id, file_id, vector_rank, keyword_rank, rrf_score, rank, selected) of all candidates.

    Equal scores keep the order in which they were first seen: the vector list, then the keyword list.
    """
    v = vector.select("query_id", "file_id", F.col("rank").alias("vector_rank"))
    w = keyword.select("query_id", "file_id", F.col("rank").alias("keyword_rank"))
    out = v.join(w, ["query_id", "file_id"], "full_outer")
    out = out.withColumn("rrf_score", numbers.reciprocal_rank(F.col("vector_rank"), k) + numbers.reciprocal_rank(F.col("keyword_rank"), k))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.col("vector_rank").asc_nulls_last(), "keyword_rank")
    return out.withColumn("rank", F.row_number().over(order)).withColumn("selected", F.col("rank") <= top_k)


@dataclass
class Retrieved:
    """candidates: what fused() gives; codes: (query_id, degradation)."""

    candidates: DataFrame
    codes: DataFrame


def _run(search: Search, chunks: DataFrame, queries: DataFrame) -> DataFrame | None:
    """What a search finds; None if it failed."""
    try:
        return search(chunks, queries)
    except SearchFailed:
        return None


def _settled(found: DataFrame | None) -> DataFrame | None:
    """found, at most CANDIDATES rows a query, run once and kept as a local table."""
    return None if found is None else found.sparkSession.createDataFrame(found.select("query_id", "file_id", "score", "rank").collect(), _as_found(found))


def _as_found(found: DataFrame) -> T.StructType:
    return T.StructType([found.schema["query_id"], T.StructField("file_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])


def retrieve(
    chunks: DataFrame, vectors: DataFrame, queries: DataFrame, top_k: int = 10, languages: Sequence[str] = (), target_paths: Sequence[str] = (),
    vector: Search = vector_search, keyword: Search = bm25, symbol: Search = symbol_search,
) -> Retrieved:
    """Hybrid retrieval: vector and keyword candidates, fused; queries with neither use the symbol search instead.

    chunks: file_id, project, language, path, index_status, search_text, symbol_name, qualified_name; vectors: file_id,
    project, language, path, index_status, embedding, embedding_status. Blank queries give nothing. The searches can be
    replaced, by keyword_fallback for a store without a full-text index; one that raises SearchFailed is left out. Up to
    BLOCK queries each search runs once, here, and its candidates are a local table; with more everything stays a plan.
    """
    if not 1 <= top_k <= CANDIDATES:
        raise ValueError(f"top_k must be between 1 and {CANDIDATES}")
    asked = queries.where(text.strip(F.col("query")) != "")
    seen = visible(chunks, languages, target_paths)
    nothing = asked.sparkSession.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, file_id long, score double, rank int")
    told = asked.limit(BLOCK + 1).collect()
    once = len(told) <= BLOCK
    settled = _settled if once else lambda found: found
    asked = asked.sparkSession.createDataFrame(told, asked.schema) if once else asked
    by_vector, by_word = settled(_run(vector, visible(vectors, languages, target_paths, embedded=True), asked)), settled(_run(keyword, seen, asked))
    v, w = by_vector if by_vector is not None else nothing, by_word if by_word is not None else nothing
    answered = v.select("query_id").union(w.select("query_id")).distinct()
    left = asked.join(F.broadcast(answered), "query_id", "left_anti")
    by_symbol = settled(_run(symbol, seen, left))
    s = by_symbol if by_symbol is not None else nothing
    return Retrieved(fused(v, w.unionByName(s), top_k), degradations(asked, by_vector, by_word, by_symbol))


def degradations(queries: DataFrame, vector: DataFrame | None, keyword: DataFrame | None, symbol: DataFrame | None) -> DataFrame:
    """(query_id, degradation): codes of what failed (None) or was empty, in order, joined by |, at most 255 characters."""
    q = queries.where(text.strip(F.col("query")) != "").select("query_id", F.col("vector").isNull().alias("no_vector"))
    for df, name in ((vector, "v"), (keyword, "k"), (symbol, "s")):
        q = q.join(F.broadcast(df.select("query_id").distinct().withColumn(name, F.lit(True))), "query_id", "left") if df is not None else q.withColumn(name, F.lit(None).cast("boolean"))
    v, k, s = (F.col(c).isNotNull() for c in "vks")
    last = F.lit("symbol_search_failed") if symbol is None else F.when(s, "symbol_ilike_fallback").otherwise("symbol_ilike_no_match")
    codes = F.array(
        F.when(F.col("no_vector"), "embedding_failed"), F.when(~F.col("no_vector") & F.lit(vector is None), "vector_search_failed"),
        F.when(F.lit(keyword is None), "keyword_search_failed"), F.when(~v & ~k, last),
    )
    told = F.filter(codes, lambda c: c.isNotNull())
    told = F.when((F.size(told) == 0) & ~v & ~k & ~s, F.array(F.lit("no_results"))).otherwise(told)
    return q.select("query_id", F.substring(F.array_join(told, "|"), 1, 255).alias("degradation"))


def trace(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row for each candidate of a query, scores for the selected ones only; one row without a file where none is."""
    q = queries.where(text.strip(F.col("query")) != "").select("query_id", text.query_hash(F.col("query")).alias("query_hash"))
    out = q.join(candidates, "query_id", "left")
    return out.select(
        "query_id", "query_hash", "file_id", "vector_rank", "keyword_rank", F.when(F.col("selected"), F.col("rrf_score")).alias("rrf_score"), F.coalesce("selected", F.lit(False)).alias("selected")
    )


def recall_at_k(expected: Column, ranked: Column, k: int) -> Column:
    """Share of the expected ids among the first k; 1 where nothing is expected."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return numbers.ratio(F.size(F.array_intersect(expected, F.slice(ranked, 1, k))), F.size(F.array_distinct(expected)), 1.0)


def running_recall(ranked: DataFrame, total: Column, by: str, order: str, hit: str) -> DataFrame:
    """ranked with recall up to each rank; hit: the labelled id that a row found, or null; a repeated hit counts once."""
    first = Window.partitionBy(by, hit).orderBy(order)
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    new = (F.col(hit).isNotNull() & (F.row_number().over(first) == 1)).cast("int")
    return ranked.withColumn("_new", new).withColumn("recall", numbers.ratio(F.sum("_new").over(upto), total)).drop("_new")
