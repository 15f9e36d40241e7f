"""Exact duplicates: frequent digests are settled map-side, the others by one ordinary shuffle.

Misra-Gries counters, one bounded summary a task, name digests that may be frequent. A second look at the digests
counts those candidates exactly; the verified winners (at most CANDIDATES rows) are broadcast and every copy of a
frequent text is settled without being shuffled. All other digests go through a shuffle on the digest, aggregated
before it, so that no task takes all rows of a group; only the groups with two rows or more meet the rows again, by
broadcast if a count shows that they are few, else by a join that adaptive execution may split.

Edge cases: a null text counts as empty; empty texts are equal to each other; rows that repeat a doc_id with the same
text are copies too and exactly one row stays; a null doc_id ranks below every other; an empty table gives an empty
result; columns other than the named ones are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .scratch import dropped, free_name, held, kept

#: Counters of a task's summary, and the candidates that are verified and broadcast.
SLOTS, CANDIDATES = 512, 1024


def misra_gries(values: Iterator[tuple[bytes, int]], slots: int) -> dict[bytes, int]:
    """At most slots counters; a value with over 1/(slots+1) of the total weight is among them."""
    counters: dict[bytes, int] = {}
    for value, weight in values:
        if value in counters:
            counters[value] += weight
        elif len(counters) < slots:
            counters[value] = weight
        else:
            low = min(weight, min(counters.values()))
            counters = {v: c - low for v, c in counters.items() if c > low}
            if weight > low:
                counters[value] = weight - low
    return counters


def _summaries(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted():
            for batch in batches:
                for x in batch.column(0).value_counts():
                    yield x["values"].as_py(), x["counts"].as_py()

        found = misra_gries(counted(), slots)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(found), pa.binary()), "weight": pa.array(list(found.values()), pa.int64())})

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, row): SHA-256 of each text; row numbers the rows so that repeated rows can be told apart."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )


def heavy_digests(table: DataFrame, slots: int = SLOTS, candidates: int = CANDIDATES) -> DataFrame:
    """(digest, n, top_id, top_row, ties) of the frequent digests, verified by an exact count; at most candidates rows."""
    guesses = (
        table.select("digest").mapInArrow(_summaries(slots), "digest binary, weight long")
        .groupBy("digest").agg(F.sum("weight").alias("weight"))
        .where("weight > 1").orderBy(F.desc("weight"), "digest").limit(candidates).select("digest")
    )
    return winners(table.join(F.broadcast(guesses), "digest", "left_semi"))


def winners(table: DataFrame) -> DataFrame:
    """For each digest: n, its rows; top_id, their largest id; top_row, the last row of that id; ties, the rows of that id."""
    by_id = table.groupBy("digest", "id").agg(F.count("*").alias("m"), F.max("row").alias("last"))
    return by_id.groupBy("digest").agg(
        F.sum("m").alias("n"), F.max("id").alias("top_id"),
        F.coalesce(F.max_by("last", "id"), F.max("last")).alias("top_row"), F.coalesce(F.max_by("m", "id"), F.max("m")).alias("ties"),
    )


def _groups(docs: DataFrame, id_col: str, text_col: str, slots: int, candidates: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digests, heavy, shared): the digest of each row, and the winners of the frequent groups and of the other groups with copies."""
    ship(docs.sparkSession)
    table = kept(digests(docs, id_col, text_col), "digests")
    heavy = kept(heavy_digests(table, slots, candidates), "heavy")
    shared = kept(winners(table.join(F.broadcast(heavy), "digest", "left_anti")).where("n > 1"), "shared")
    return table, heavy, shared


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, candidates: int = CANDIDATES) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    keep_id is the largest id among the rows of equal text; that row, and one row only, has kept = true.
    """
    table, heavy, shared = _groups(docs, id_col, text_col, slots, candidates)
    settled = table.join(F.broadcast(heavy), "digest")
    others = table.join(F.broadcast(heavy), "digest", "left_anti").join(held(shared), "digest", "left")
    alone = F.col("n").isNull()
    return settled.unionByName(others).select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("top_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("top_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, candidates: int = CANDIDATES) -> DataFrame:
    """docs, all columns, without the rows that repeat a text; of equal texts the row with the largest id stays.

    Rows meet the winners of their digest, of frequent ones map-side; a text is not shuffled unless the groups with
    copies are too many to broadcast. Of rows that repeat both the id and the text of a winner the one with the least
    hash of its columns stays; each task settles its own before the shuffle, however many there are.
    """
    table, heavy, shared = _groups(docs, id_col, text_col, slots, candidates)
    repeats = heavy.where("ties > 1").select("digest").limit(1).count() + shared.where("ties > 1").select("digest").limit(1).count()
    dropped(table)
    sha, top, ties, whole = (free_name(docs, c) for c in ("exact_sha", "exact_top", "exact_ties", "exact_whole"))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = docs.withColumn(sha, digest)
    for groups in (F.broadcast(heavy), held(shared)):
        told = groups.select(F.col("digest").alias(f"{sha}_of"), F.struct("top_id").alias(f"{top}_of"), F.col("ties").alias(f"{ties}_of"))
        rows = rows.join(told, F.col(sha) == F.col(f"{sha}_of"), "left").drop(f"{sha}_of")
        old = (F.col(top), F.col(ties)) if top in rows.columns else ()
        rows = rows.withColumn(top, F.coalesce(*old[:1], F.col(f"{top}_of"))).withColumn(ties, F.coalesce(*old[1:], F.col(f"{ties}_of"))).drop(f"{top}_of", f"{ties}_of")
    rows = rows.where(F.col(top).isNull() | F.col(id_col).eqNullSafe(F.col(top)["top_id"]))
    if repeats:
        again = F.coalesce(F.col(ties), F.lit(1)) > 1
        told = [F.col(c) for c, kind in docs.dtypes if c != text_col and "map<" not in kind and "variant" not in kind]
        first = F.min_by(F.struct(*docs.columns), F.xxhash64(F.col(text_col).isNull(), *told)).alias(whole)
        one = rows.where(again).groupBy(sha).agg(first).select(f"{whole}.*")
        rows = rows.where(~again).select(*docs.columns).unionByName(one)
    return rows.select(*docs.columns)
