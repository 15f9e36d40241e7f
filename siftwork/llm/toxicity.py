"""Toxicity: a cumulative-link ordinal regression over sparse word features.

Features are hashed words and the beginnings of words, with logarithmic counts per document, scaled by the square root
of the document's number of words. One weight vector serves all grades: P(grade > k) = sigmoid(w.x - b_k) with ordered
thresholds b_0 < b_1 < ...; the expected severity is the sum of these probabilities. The weights follow the
regularised leader with an L1 and an L2 penalty, so few are not zero; the gaps of the thresholds are learned as
logarithms, which keeps their order. The model is fitted by the driver on at most fit_rows labelled documents, in which
grades above 0 are more frequent than among all labels; the probabilities are set back to the odds of all labels by
Bayes' rule, so they do not depend on how full the sample is. Scoring reads every whole text.

Edge cases: null, empty and wordless texts have no features, are scored by the thresholds alone and never flagged;
null grades and documents without a label are not learned from; grades are whole numbers from 0, and without two
different grades to learn from every severity is 0 and nothing is flagged; ties in the sample go to the smaller id;
rows that repeat are scored each; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import dropped, evenly, kept, small_batches, tidy, within
from .shingles import _LOWER, _tables, mixed

BITS = 20
PREFIXES = (3, 4, 5, 6, 8)
#: Labelled documents to fit on, at most; half of them are graded above 0 if there are as many.
FIT_ROWS = 4000
#: Bytes of the sparse vectors to fit on, at most: the driver holds them.
FIT_BYTES = 64 << 20
PASSES, ALPHA, BETA, L1, L2 = 12, 0.3, 1.0, 5.0, 0.02
#: Bytes of a text that are turned into features at a time.
PIECE = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket numbers (repeats included) of a text's features, the distinct ones first counted by the caller, and words."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    found, words, at = [], 0, 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        while stop < len(data) and _WORD[data[stop - 1]] and _WORD[data[stop]]:
            stop += 1
        piece = data[at:stop]
        is_word = _WORD[piece]
        edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _tables(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_LOWER[piece] * up[: len(piece)], out=sums[1:])
        size, words = ends - starts, words + len(starts)
        found.append(mixed((sums[ends] - sums[starts]) * down[starts] + np.uint64(1)))
        for k in PREFIXES:
            own = starts[size > k]
            found.append(mixed((sums[own + k] - sums[own]) * down[own] + np.uint64(100 + k)))
        at = stop
    buckets = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32) if found else np.zeros(0, np.int32)
    return buckets, words


def vector(buckets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their values."""
    index, count = np.unique(buckets, return_counts=True)
    return index, (np.log1p(count) * scale(words)).astype(np.float32)


def scale(words: int) -> float:
    return 4.0 / max(words, 1) ** 0.25


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """Weights by bucket and the thresholds, ascending; grades: as many as thresholds, plus one.

    odds: the odds of a grade above 0 among all labels, divided by those among the rows that the model was fitted on.
    """

    weights: np.ndarray
    thresholds: np.ndarray
    odds: float = 1.0

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each z and k."""
        fitted = _sigmoid(z[:, None] - self.thresholds[None, :])
        return fitted * self.odds / (1.0 + fitted[:, :1] * (self.odds - 1.0))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, seed: int = 7, l1: float = L1, l2: float = L2, passes: int = PASSES) -> OrdinalModel:
    """Fits on rows of (buckets, values, grade)."""
    size = 1 << BITS
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    share = np.array([max(np.mean([g > k for *_, g in rows]), 1e-3) if rows else 0.5 for k in range(grades - 1)])
    first = -np.log(share[0] / max(1 - share[0], 1e-3))
    gaps = np.log(np.maximum(np.diff(-np.log(share / np.maximum(1 - share, 1e-3))), 0.1))
    theta, spent = np.concatenate(([first], gaps)), np.full(grades - 1, 1e-6)
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            index, value, grade = rows[i]
            zi, ni = z[index], n[index]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + l2))
            b = theta[0] + np.concatenate(([0.0], np.cumsum(np.exp(theta[1:]))))
            at = float(wi @ value)
            upper = _sigmoid(b[grade] - at) if grade < grades - 1 else 1.0
            lower = _sigmoid(b[grade - 1] - at) if grade else 0.0
            likely = max(upper - lower, 1e-9)
            g = (1.0 - upper - lower) * value
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[index], n[index] = zi + g - step * wi, ni + g * g
            db = np.zeros(grades - 1)
            if grade < grades - 1:
                db[grade] -= upper * (1 - upper) / likely
            if grade:
                db[grade - 1] += lower * (1 - lower) / likely
            dt = np.concatenate(([db.sum()], np.cumsum(db[::-1])[::-1][1:] * np.exp(theta[1:])))
            spent += dt * dt
            theta -= 0.1 * dt / np.sqrt(spent)
    active = np.abs(z) > l1
    w[active] = -(z[active] - np.sign(z[active]) * l1) / ((BETA + np.sqrt(n[active])) / ALPHA + l2)
    return OrdinalModel(w.astype(np.float32), theta[0] + np.concatenate(([0.0], np.cumsum(np.exp(theta[1:])))))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [vector(*features(t)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary()), *[batch.column(k) for k in (1, 2, 3)]],
            names=["buckets", "values", "grade", "toxic", "turn"],
        )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> OrdinalModel | None:
    """Fits on at most fit_rows labelled documents, chosen by a hash of their ids, and on at most fit_bytes of vectors,
    taken in turns of one of each side; of rows that repeat an id one text is learned from. None without two grades."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(grade_col).cast("int").alias("_grade"))
    with_text = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"))
    known = known.join(with_text, "_id", "left_semi").withColumn("_side", F.col("_grade") > 0)
    chosen = evenly(known, "_side", ["_id"], fit_rows // 2, 2)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    first = F.row_number().over(Window.partitionBy("_id").orderBy(F.xxhash64("_text"), "_text"))
    rows = rows.withColumn("_first", first).where("_first = 1").select("_text", "_grade", "_side", "_turn")
    rows = kept(rows.mapInArrow(tidy(_vectors), "buckets binary, values binary, grade int, toxic boolean, turn int"), "vectors")
    data = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["values"], np.float32), r["grade"]) for r in within(rows, ["turn", "toxic"], F.length("buckets") + F.length("values"), fit_bytes).collect()]
    data.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes()))
    model = None
    if len({g for *_, g in data}) > 1:
        model = fit(data, max(g for *_, g in data) + 1)
        here, above = {r["_side"]: r["count"] for r in known.groupBy("_side").count().collect()}, sum(g > 0 for *_, g in data)
        model.odds = here[True] * (len(data) - above) / (here[False] * above) if above < len(data) else 1.0
    dropped(chosen, rows)
    return model


def severities(docs: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text", flag_from: float = 0.5) -> DataFrame:
    """One row for each document: id_col, severity (the expected grade), grade (the likeliest), p_toxic, toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    names = [id_col, "severity", "grade", "p_toxic", "toxic"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    if model is None:
        return docs.select(id_col, F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(0.0).alias("p_toxic"), F.lit(False).alias("toxic"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        used = model.weights != 0
        for batch in batches:
            z, any_words = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for k, text in enumerate(batch.column(1).to_pylist()):
                buckets, words = features(text)
                any_words[k] = words > 0
                index, count = np.unique(buckets[used[buckets]], return_counts=True)
                z[k] = float(np.log1p(count) @ model.weights[index]) * scale(words)
            above = model.above(z)
            chances = -np.diff(np.concatenate((np.ones((len(z), 1)), above, np.zeros((len(z), 1))), axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(axis=1)), pa.array(chances.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array((above[:, 0] >= flag_from) & any_words)], names=names
            )

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
