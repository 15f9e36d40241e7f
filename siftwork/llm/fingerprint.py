"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the document's and the
shares of two sketches estimate containment even between very unequal documents. The least hash is kept in any case,
so that no text with words has an empty sketch. Sketches merge: the sketch of two documents together is the union of
theirs, without a hash above the threshold if there is one below it. A fingerprint is the kept hashes, 48 bits each,
ascending, in base64.

with_next() puts each document beside the one that follows by id: ids are dealt to ranges by quantiles, each range is
sorted by itself, and the first documents of a range are sent to the range before it as well. One shuffle, no global
sort.

Edge cases: ids that follow each other are whole numbers, others are refused; null, empty and blank texts have the empty fingerprint; two empty fingerprints are alike (1.0), an empty
one and another are not (0.0); texts of fewer words than a shingle are one shingle; a null id comes before all others;
documents of equal id follow each other by text; a single document follows itself; an empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import parts, small_batches, tidy
from .shingles import WORDS, shingle_sets

#: One hash in so many is kept.
SCALED = 4
_LIMIT = np.uint64(2**48 // SCALED)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The kept 48-bit hashes of ascending 64-bit shingle hashes."""
    short = shingles[: max(1, int(np.searchsorted(shingles, _LIMIT << np.uint64(16))))] >> np.uint64(16)
    return short[np.concatenate(([True], short[1:] != short[:-1]))] if len(short) else short


def packed(hashes: np.ndarray) -> str:
    """A sketch as a fingerprint string."""
    return base64.b64encode(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    """The sketch of a fingerprint string."""
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of what a and b are sketches of."""
    both = np.union1d(a, b)
    below = int(np.searchsorted(both, _LIMIT))
    return both[: max(1, below)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of the sets behind two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merged(a, b)
    return len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the set behind a that the set behind b holds as well."""
    if not len(a):
        return 1.0
    part = a[: max(1, int(np.searchsorted(a, _LIMIT)))]
    return len(np.intersect1d(part, b, True)) / len(part)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """(id_col, fingerprint) for each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed(sketch(s)) for _, s in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())]))


def with_next(docs: DataFrame, of: Callable[[pa.Array, pa.Array, pa.Array], list[pa.Array]], schema: T.StructType, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """of(ids, texts, next texts) for the documents in ascending order of their ids; the last is followed by the first.

    of returns the columns of schema for a batch; null texts come as empty ones.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number, not {docs.schema[id_col].dataType.simpleString()}: the next document is the one with the next id")
    spark = docs.sparkSession
    small_batches(spark)
    n = min(parts(spark), 10_000)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    at = [k / n for k in range(n)]
    told = rows.agg(F.min("key").alias("first"), F.percentile_approx("key", at, max(10_000, 20 * n)).alias("bounds")).first()
    first = told["first"]
    bounds = np.unique(np.array([b for b in told["bounds"] or [] if b > first], np.int64))
    last = len(bounds)

    @F.pandas_udf("array<int>")
    def ranges(keys: pd.Series) -> pd.Series:
        values = keys.to_numpy(np.int64)
        home = np.searchsorted(bounds, values, "right")
        starts = (home > 0) & (bounds[np.maximum(home - 1, 0)] == values) if last else np.zeros(len(values), bool)
        return pd.Series([[h, h - 1] if s else [h, last + 1] if v == first else [h] for h, s, v in zip(home.tolist(), starts.tolist(), values.tolist(), strict=True)])

    placed = rows.withColumn("to", ranges("key")).select("id", "key", "text", F.element_at("to", 1).alias("home"), F.explode("to").alias("range"))
    placed = placed.select(
        "id", "key", "text", (F.col("range") != F.col("home")).alias("guest"), (F.col("range") > last).alias("wrap"),
        F.least("range", F.lit(last)).alias("range"),
    )
    dealt = placed.repartitionById(last + 1, "range").sortWithinPartitions("wrap", "key", "text").select("id", "text", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            table = table.combine_chunks()
            held = table.slice(table.num_rows - 1)
            if table.num_rows < 2:
                continue
            ids, texts, guest = (table.column(k).combine_chunks() if table.column(k).num_chunks != 1 else table.column(k).chunk(0) for k in range(3))
            own = pa.array(~guest[:-1].to_numpy(zero_copy_only=False))
            if pa.compute.any(own).as_py():
                columns = of(ids[:-1].filter(own), texts[:-1].filter(own), texts[1:].filter(own))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return dealt.mapInArrow(tidy(run), schema)


def compared_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """For each document its fingerprint and that of its edited text, whose last quarter is the next document's start.

    id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_edited: the estimated share
    of the document's shingles that its edited text holds as well.
    """

    def of(ids: pa.Array, texts: pa.Array, after: pa.Array) -> list[pa.Array]:
        edited, sizes = [], []
        for text, following in zip(texts.to_pylist(), after.to_pylist(), strict=True):
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + following[:cut])
            sizes.append(len(text))
        own, other, changed = ([sketch(s) for _, s in shingle_sets(x, size)] for x in (texts, after, pa.array(edited, pa.string())))
        return [
            ids, pa.array(sizes, pa.int64()), pa.array([sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([packed(s) for s in own]), pa.array([packed(s) for s in changed]),
            pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, other, strict=True)], pa.float64()),
            pa.array([containment(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
        ]

    names = {"n_chars": T.LongType(), "edited_sha256": T.StringType(), "fingerprint": T.StringType(), "edited_fingerprint": T.StringType(), "near_edited": T.DoubleType(), "near_next": T.DoubleType(), "in_edited": T.DoubleType()}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(k, v) for k, v in names.items()]])
    return with_next(docs, of, schema, id_col, text_col)
