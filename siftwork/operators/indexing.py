"""Incremental index: reuse of embeddings, currency of files, symbols and relations."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text
from ..providers import EmbeddingProvider, TokenCounter
from ..session import ship
from ..sources import readers
from .search import words_of


def reuse(chunks: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    """chunks with reused_from and embedding of the first indexed chunk (least chunk_id) with equal keys, or nulls.

    The first ids are found without their vectors, which are looked up once for each key.
    """
    first = indexed.groupBy(*keys).agg(F.min("chunk_id").alias("reused_from"))
    vectors = indexed.select(F.col("chunk_id").alias("reused_from"), "embedding").join(first, "reused_from")
    return chunks.drop("embedding").join(vectors, keys, "left")


def build_result(chunks: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of an index build: chunks, ready, reused, keyword_only."""
    has = F.col("embedding").isNotNull()
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.count_if(has).alias("ready"), F.count_if(F.col("reused_from").isNotNull()).alias("reused"), F.count_if(~has).alias("keyword_only"))


def current_files(parsed: DataFrame, indexed: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, current): whether the indexed chunks of a file are exactly the parsed ones, by fingerprint and equal facts.

    Both: file, chunk_fingerprint, content_hash and version.
    """
    p = parsed.groupBy(file, "chunk_fingerprint").agg(F.count("*").alias("n"), F.min("content_hash").alias("hash"), F.min("version").alias("version"))
    i = indexed.groupBy(file, "chunk_fingerprint").agg(F.count("*").alias("n_old"), F.min("content_hash").alias("hash_old"), F.min("version").alias("version_old"))
    same = (F.col("n") == F.col("n_old")) & (F.col("hash") == F.col("hash_old")) & (F.col("version") == F.col("version_old"))
    return p.join(i, [file, "chunk_fingerprint"], "full_outer").groupBy(file).agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("current"))


def resolved(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with source_symbol and target_symbol of the same file, by simple or qualified name, last definition wins.

    A reference without a source symbol is dropped; one without a target symbol is external. references: file_id, source,
    target, relation, confidence; symbols: file_id, symbol_id (in order of definition), symbol_name, qualified_name.
    """
    alias = symbols.select("file_id", "symbol_id", F.explode(F.array_distinct(F.filter(F.array("symbol_name", "qualified_name"), lambda x: x.isNotNull()))).alias("alias"))
    last = alias.groupBy("file_id", "alias").agg(F.max("symbol_id").alias("symbol_id"))
    s = last.select("file_id", F.col("alias").alias("source"), F.col("symbol_id").alias("source_symbol"))
    t = last.select("file_id", F.col("alias").alias("target"), F.col("symbol_id").alias("target_symbol"))
    out = references.join(s, ["file_id", "source"]).join(t, ["file_id", "target"], "left")
    return out.withColumn("resolution", F.when(F.col("target_symbol").isNull(), "external").otherwise("resolved"))


def unique_references(references: DataFrame, order: str) -> DataFrame:
    """The first reference of each (file_id, source, target, relation)."""
    w = Window.partitionBy("file_id", "source", "target", "relation").orderBy(order)
    return references.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def without_file(relations: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """relations after the symbols of files are deleted: those from them go, targets among them become null."""
    gone = symbols.join(files.select("file_id").distinct(), "file_id", "left_semi").select("symbol_id")
    stay = relations.join(gone.select(F.col("symbol_id").alias("source_symbol")), "source_symbol", "left_anti")
    lost = gone.select(F.col("symbol_id").alias("target_symbol"), F.lit(True).alias("_gone"))
    return stay.join(lost, "target_symbol", "left").withColumn("target_symbol", F.when(F.col("_gone").isNull(), F.col("target_symbol"))).drop("_gone")


def owning_interval(items: DataFrame, definitions: DataFrame, by: str = "file_id") -> DataFrame:
    """items (by, item_id, start, end) with owner: the smallest definition (by, def_id, start, end) around each, or null.

    One pass over the sorted intervals of a file, items before equal definitions, keeps the open definitions that can still
    be the smallest around something: sorted by end, each longer than the one before. The first that ends late enough is
    the owner. For nested definitions this is the stack of those open. Equal lengths: the smallest def_id. Definitions may
    overlap as well. Items or definitions with a null bound have no owner and own nothing.
    """
    ship(items.sparkSession)
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((items, by), (items, "item_id"), (definitions, "def_id"))}
    whole = lambda df: df.where(F.col(by).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    bounds = [F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")]
    none = lambda c, of: F.lit(None).cast(kinds[c]).alias(c)
    rows = whole(items).select(by, *bounds, F.lit(0).alias("kind"), "item_id", none("def_id", definitions))
    rows = rows.unionByName(whole(definitions).where("start <= end").select(F.col(by).cast(kinds[by]).alias(by), *bounds, F.lit(1).alias("kind"), none("item_id", items), "def_id"))
    dealt = rows.repartition(by).sortWithinPartitions(by, "start", F.desc("end"), "kind", F.desc("def_id"))

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = None
        ends: list[int] = []
        open_: list[tuple[int, object]] = []  # (length, def_id), rising like ends
        for batch in batches:
            files, found, owners = [], [], []
            for file, start, end, kind, item, definition in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != now:
                    now, ends, open_ = file, [], []
                elif ends and ends[0] < start:
                    gone = bisect_left(ends, start)
                    del ends[:gone], open_[:gone]
                at = bisect_left(ends, end)
                if not kind:
                    files.append(file), found.append(item), owners.append(open_[at][1] if at < len(ends) else None)
                    continue
                own = (end - start, definition)
                if at < len(ends) and open_[at] < own:
                    continue  # one that ends no earlier is smaller
                last = at + 1 if at < len(ends) and ends[at] == end else at
                first = bisect_left(open_, own, 0, at)
                ends[first:last], open_[first:last] = [end], [own]
            yield pa.RecordBatch.from_arrays([pa.array(files, types[0]), pa.array(found, types[1]), pa.array(owners, types[2])], names=[by, "item_id", "owner"])

    types = [to_arrow_type(items.schema[by].dataType), to_arrow_type(items.schema["item_id"].dataType), to_arrow_type(definitions.schema["def_id"].dataType)]
    told = dealt.mapInArrow(swept, f"`{by}` {kinds[by]}, item_id {kinds['item_id']}, owner {kinds['def_id']}")
    return items.join(told.where("owner is not null").dropDuplicates([by, "item_id"]), [by, "item_id"], "left")


def indexed_files(
    parsed: DataFrame, old: DataFrame, provider: EmbeddingProvider, dimension: int, count_tokens: TokenCounter = text.token_bytes, max_tokens: int = 8192, batch: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Incremental indexing: (the new index, one row for each parsed file with the counts of its build).

    parsed: project, file_id, chunk_id, chunk_fingerprint, content_hash, version, search_text; old: the same with embedding,
    embedding_status, embedding_error, search_tokens. Files whose chunks are all as they were stay. The chunks of the
    others take the embedding of an old chunk of their project with the same content, or are found by keyword only if they
    are too long or the provider fails, or get an embedding from it. search_tokens, which a full-text search reads, is
    derived as chunks are written. Files that are not parsed stay as they are.
    """
    current = current_files(parsed, old.join(parsed.select("file_id").distinct(), "file_id", "left_semi"))
    fresh = parsed.join(current.where("not current").select("file_id"), "file_id", "left_semi")
    fresh = reuse(fresh, old.where("embedding_status = 'ready'").select("project", "content_hash", "chunk_id", "embedding"), ["project", "content_hash"])
    fresh = fresh.withColumn("_long", F.col("embedding").isNull() & (count_tokens(F.col("search_text")) > max_tokens))
    asked = fresh.where("embedding is null and not _long").select("chunk_id", F.col("search_text").alias("content"))
    answers = readers.batched_embeddings(asked, provider, batch, dimension).withColumnRenamed("embedding", "_given")
    fresh = fresh.join(answers, "chunk_id", "left").withColumn("embedding", F.coalesce("embedding", "_given"))
    failed = F.when(F.col("_long"), "EMBEDDING_INPUT_TOKEN_LIMIT").when(F.col("embedding").isNull(), "EMBEDDING_PROVIDER_FAILED")
    fresh = fresh.withColumn("embedding_error", failed).withColumn("embedding_status", F.when(F.col("embedding").isNull(), "keyword_only").otherwise("ready"))
    fresh = fresh.withColumn("search_tokens", words_of(F.col("search_text"))).drop("_long", "_given")
    index = readers.replaced(old, fresh.select(*old.columns), ["file_id"])
    told = build_result(fresh, ["file_id"]).withColumn("reused_file", F.lit(False))
    kept = old.join(current.where("current").select("file_id"), "file_id", "left_semi").withColumn("reused_from", F.when(F.col("embedding").isNotNull(), F.col("chunk_id")))
    return index, told.unionByName(build_result(kept, ["file_id"]).withColumn("reused_file", F.lit(True)))
