"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one space, and n-grams of 1 to GRAMS characters are hashed to
2**BITS buckets. A bucket's weight in a text is (1 + ln count) * idf, scaled to unit length; document frequencies are
counted over all texts that may be learned from. The driver fits the weights on at most fit_rows of them, evenly by
language, by following the regularised leader with an L1 and an L2 penalty; CALIBRATE of that sample is kept apart to
fit the temperature that calibrates the probabilities. Scoring reads every whole text.

Edge cases: texts that are null, empty or without a letter get UNKNOWN with score 0; with nothing to learn from every
text does; with one language to learn from every text with a letter is in it, score 1; equal probabilities go to the
language that sorts first; rows that repeat are scored each; an empty table gives an empty result. Only the named
columns are read, and of the rows that are not learned from nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import dropped, evenly, kept, small_batches, tidy, within

UNKNOWN = "und"
BITS, GRAMS = 16, 3
#: Texts to fit on, at most, and the part of them that is kept for the temperature.
FIT_ROWS, CALIBRATE = 4000, 0.4
#: Bytes of the sparse vectors to fit on, and languages to learn (the most frequent ones), at most: the driver holds them.
FIT_BYTES, LANGUAGES = 64 << 20, 256
PASSES, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 0.02, 0.01
#: Characters of a text that are hashed at a time.
PIECE = 1 << 20
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def gram_counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's n-grams occur; None without a letter. Pieces of a long text are counted one by one."""
    if not text:
        return None
    total, any_letter = np.zeros(1 << BITS, np.int64), False
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[max(0, at - GRAMS) : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[codes]
        if not letter.any():
            continue
        any_letter = True
        codes = np.where(letter, codes, np.uint32(32))
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True
        codes = np.concatenate(([np.uint32(32)], codes[keep], [np.uint32(32)])).astype(np.uint32)
        code = codes * np.uint32(2654435761)
        gram = code.copy()
        for n in range(1, GRAMS + 1):
            if n > 1:
                if len(code) < n:
                    break
                gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(15))) * np.uint32(2246822519) + code[n - 1 :]
            mixed = (gram ^ (gram >> np.uint32(13))) * np.uint32(3266489917 + 2 * n)
            total += np.bincount(mixed >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total if any_letter else None


def _weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index = np.flatnonzero(counts)
    value = (1 + np.log(counts[index])) * idf[index]
    return index, (value / np.sqrt(value @ value)).astype(np.float32)


@dataclass
class LanguageModel:
    """Languages in order, idf by bucket, weights (bucket, language), biases and the temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        index, value = _weighted(counts, self.idf)
        return value @ self.weights[index] + self.bias


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, size: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from rows of (buckets, values, class), by FTRL-proximal steps."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    bias, spent = np.zeros(classes), np.full(classes, 1e-6)
    leader = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            index, value, label = rows[i]
            zi, ni = z[index], n[index]
            w = leader(zi, ni)
            error = _softmax(value @ w + bias)
            error[label] -= 1.0
            g = value[:, None] * error[None, :]
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[index] = ni + g * g
            spent += error * error
            bias -= 0.1 * error / np.sqrt(spent)
    return leader(z, n).astype(np.float32), bias


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm; 1 without examples.

    Each label counts for all but 1/(n + 2), as in the rule of succession: a sample without errors does not prove that
    there are none.
    """
    if len(labels) < 10:
        return 1.0
    n, classes = logits.shape
    goal = np.full((n, classes), 1 / (n + 2) / (classes - 1))
    goal[np.arange(n), labels] = 1 - 1 / (n + 2)
    loss = lambda t: -np.mean((goal * np.log(_softmax(logits / np.exp(t)) + 1e-300)).sum(axis=1))
    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, texts = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if (counts := gram_counts(text)) is not None:
                found += counts > 0
                texts += 1
    used = np.flatnonzero(found)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(used, -1).astype(np.int32)), "texts": pa.array(np.append(found[used], texts))})


def _sparse_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(text: str | None) -> tuple[bytes | None, bytes | None]:
        counts = gram_counts(text)
        if counts is None:
            return None, None
        index = np.flatnonzero(counts).astype(np.int32)
        return index.tobytes(), counts[index].astype(np.int32).tobytes()

    for batch in batches:
        found = [packed(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in found], pa.binary()), pa.array([c for _, c in found], pa.binary()), *[batch.column(k) for k in (1, 2, 3)]], names=["buckets", "counts", "lang", "apart", "turn"]
        )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> LanguageModel | None:
    """Fits a model on the rows of docs where usable holds and the language is known; None without any.

    Document frequencies come from all such rows, the weights from at most fit_rows of them, chosen by a hash of the id,
    and from at most fit_bytes of sparse vectors: rows are taken in turns of one of each language until these are full.
    """
    small_batches(docs.sparkSession)
    usable = F.coalesce(usable, F.lit(False)) if usable is not None else F.lit(True)
    known = docs.where(usable & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    frequency = np.zeros(1 << BITS, np.int64)
    texts = 0
    for row in known.select("_text").mapInArrow(tidy(_frequencies), "bucket int, texts long").groupBy("bucket").agg(F.sum("texts").alias("texts")).collect():
        if row["bucket"] < 0:
            texts = row["texts"]
        else:
            frequency[row["bucket"]] = row["texts"]
    if not texts:
        return None
    idf = np.log((1 + texts) / (1 + frequency)) + 1

    lettered = known.where(F.col("_text").rlike(r"\p{L}")).withColumn("_digest", F.xxhash64("_text"))
    languages = min(LANGUAGES, lettered.select("_lang").distinct().limit(LANGUAGES).count())
    chosen = evenly(lettered, "_lang", ["_id", "_digest"], max(1, fit_rows // max(1, languages)), languages or 1)
    apart = F.pmod(F.xxhash64("_digest", F.lit("apart")), F.lit(1000)) < 1000 * CALIBRATE
    sparse = kept(chosen.select("_text", "_lang", apart.alias("_apart"), "_turn").mapInArrow(tidy(_sparse_counts), "buckets binary, counts binary, lang string, apart boolean, turn int").where("buckets is not null"), "vectors")
    rows = within(sparse, ["turn", "lang"], F.length("buckets") + F.length("counts"), fit_bytes).collect()
    dropped(chosen, sparse)
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    if len(languages) == 1:
        return LanguageModel(languages, idf, np.zeros((1 << BITS, 1), np.float32), np.zeros(1))
    fitted = {r["lang"] for r in rows if not r["apart"]}  # a language whose rows all fell to the calibration is fitted on them
    data = []
    for r in rows:
        counts = np.zeros(1 << BITS, np.int64)
        counts[np.frombuffer(r["buckets"], np.int32)] = np.frombuffer(r["counts"], np.int32)
        data.append((*_weighted(counts, idf), languages.index(r["lang"]), r["apart"] and r["lang"] in fitted))
    data.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes()))
    weights, bias = fit([r[:3] for r in data if not r[3]], len(languages), 1 << BITS)
    model = LanguageModel(languages, idf, weights, bias)
    apart = [r for r in data if r[3]]
    if apart:
        model.temperature = temperature_of(np.array([v @ weights[i] + bias for i, v, _, _ in apart]), np.array([r[2] for r in apart]))
    return model


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score"), carry: bool = False) -> DataFrame:
    """(id_col, lang_pred, score) for each row; score is the calibrated probability of lang_pred.

    carry: all columns of docs stay, the two named ones follow; nothing is joined or shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    own = docs if carry else docs.select(id_col, text_col)
    at = own.columns.index(text_col)
    stay = [k for k, c in enumerate(own.columns) if carry or c == id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            told, scores = [], []
            for text in batch.column(at).to_pylist():
                counts = gram_counts(text) if model else None
                if counts is None:
                    told.append(UNKNOWN), scores.append(0.0)
                else:
                    chances = _softmax(model.logits(counts) / model.temperature)
                    best = int(chances.argmax())
                    told.append(model.languages[best]), scores.append(float(chances[best]))
            columns = [*[batch.column(k) for k in stay], pa.array(told, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*[batch.schema.names[k] for k in stay], *names])

    schema = T.StructType([*[own.schema.fields[k] for k in stay], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return own.mapInArrow(tidy(run), schema)
