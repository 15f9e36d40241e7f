"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

Texts are cut by a pattern into pre-tokens; merges never cross them. A block is the texts that a task reads until they
reach BLOCK_CHARS. Every distinct pre-token of a block that is not known yet is laid out once as a chain of byte
tokens, as many pre-tokens at a time as REPLAY_BYTES holds. An inverted index maps the rank of a token pair to the positions where that pair stands; ranks are taken in
order, all positions of a rank are merged from the left, and only the two neighbours of a merge get new index entries.
Since merges never cross pre-tokens, replays over parts of a block give what a replay over the whole corpus would, and
no text or pre-token is shuffled.

A pair's rank is that of its joined bytes, however the two parts came about, so a merge may make a pair of a lower
rank than the current one. Such a pair is replayed before the rest of the current rank: exactly the order in which a
lowest-rank-first encoder of single words works.

Edge cases: a null or empty text has no tokens; a pre-token that is a token is that token; texts of any length are
encoded whole; rows that repeat are encoded each; an empty table gives an empty result. Only the named columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import gc
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .scratch import small_batches, tidy

#: Characters of the texts of a block; pre-tokens and their bytes that a worker keeps from block to block.
BLOCK_CHARS, KNOWN_WORDS, KNOWN_BYTES = 3_000_000, 300_000, 12_000_000
#: Bytes of the pre-tokens of one replay, whose lists take about 100 times as much; a longer pre-token is replayed alone.
REPLAY_BYTES = 128_000
#: Bytes of packed ids in one batch of results, unless one text has more.
RESULT_BYTES = 1 << 20
_SHIFT = 24


class Vocabulary:
    """Token bytes by id and the merges they allow."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary has no token for {len(missing)} single bytes")
        if max(ranks.values()) >= 1 << _SHIFT:
            raise ValueError("ids above 16,777,215 are not supported")
        self.ranks = ranks
        self.by_id = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << _SHIFT | b] = rank

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from the lines "base64 rank" of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """The tokens of each word (no word is empty), by applying every merge in rank order to all words together."""
    single, pairs = vocabulary.single, vocabulary.pairs
    token = [single[b] for word in words for b in word]
    size = len(token)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    starts, at = [], 0
    for word in words:
        starts.append(at)
        before[at] = -1
        at += len(word)
        after[at - 1] = -1
    pair = [-1] * size
    index: dict[int, list[int]] = {}
    for p in range(size):
        if after[p] >= 0 and (rank := pairs.get(token[p] << _SHIFT | token[p + 1], -1)) >= 0:
            pair[p] = rank
            if rank in index:
                index[rank].append(p)
            else:
                index[rank] = [p]
    due = list(index)
    heapq.heapify(due)
    while due:
        rank = heapq.heappop(due)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        for k, p in enumerate(places):
            if pair[p] != rank:
                continue
            gone = after[p]
            right, left = after[gone], before[p]
            token[p], after[p] = rank, right
            pair[gone] = pair[p] = -1
            lower = False
            if right >= 0:
                before[right] = p
                if (new := pairs.get(rank << _SHIFT | token[right], -1)) >= 0:
                    pair[p] = new
                    lower = new <= rank
                    if new in index:
                        index[new].append(p)
                    else:
                        index[new] = [p]
                        heapq.heappush(due, new)
            if left >= 0:
                new = pairs.get(token[left] << _SHIFT | rank, -1)
                pair[left] = new
                if new >= 0:
                    lower = lower or new <= rank
                    if new in index:
                        index[new].append(left)
                    else:
                        index[new] = [left]
                        heapq.heappush(due, new)
            if lower and k + 1 < len(places):
                rest = places[k + 1 :]
                if rank in index:
                    index[rank] += rest
                else:
                    index[rank] = rest
                    heapq.heappush(due, rank)
                break
    out = []
    for p in starts:
        ids = []
        while p >= 0:
            ids.append(token[p])
            p = after[p]
        out.append(ids)
    return out


class Encoder:
    """Encodes pre-tokens and remembers a bounded number of them; ids are kept as packed 32-bit integers."""

    def __init__(self, raw: bytes, pattern: str):
        self.vocabulary = Vocabulary(read_ranks(raw))
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def learn(self, words: Iterable[str]) -> None:
        """Makes known the words that are not known yet."""
        new, size, ranks, known = {}, 0, self.vocabulary.ranks, self.known
        collects = gc.isenabled()
        gc.disable()  # the index is many small lists without cycles
        try:
            for word in words:
                if word not in known and word not in new:
                    raw = word.encode()
                    if (whole := ranks.get(raw)) is not None:
                        known[word] = np.int32(whole).tobytes()
                        continue
                    if new and size + len(raw) > REPLAY_BYTES:
                        self._replayed(new)
                        new, size = {}, 0
                    new[word] = raw
                    size += len(raw)
            self._replayed(new)
        finally:
            if collects:
                gc.enable()

    def _replayed(self, new: dict[str, bytes]) -> None:
        for (word, raw), ids in zip(new.items(), replay(list(new.values()), self.vocabulary), strict=True):
            self.known[word] = np.array(ids, np.int32).tobytes()
            self.known_bytes += len(raw)

    def forget(self, recent: Iterable[str]) -> None:
        """Drops what is known, but for the recent words, if it is more than a worker may keep."""
        if len(self.known) > KNOWN_WORDS or self.known_bytes > KNOWN_BYTES:
            self.known = {word: self.known[word] for word in recent}
            self.known_bytes = sum(map(len, self.known))

    def encode(self, words: list[str]) -> bytes:
        """Packed ids of known words."""
        return b"".join([self.known[w] for w in words])


_encoders: dict[tuple[int, str], Encoder] = {}


def worker_encoder(raw: bytes, pattern: str) -> Encoder:
    """This worker's encoder for a rank file; built once for all of its tasks."""
    key = (hash(raw), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(raw, pattern)
    return _encoders[key]


def shared_ranks(spark: SparkSession, path: str):
    """The rank file, read by the driver and broadcast: a vocabulary's size does not depend on the corpus."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded binary): each text's token ids, and the bytes that these ids decode to."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = shared_ranks(spark, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value, pattern)
        ids: list = []
        waiting: list[list[str]] = []
        new: dict[str, str] = {}
        chars, kind = 0, None

        def results(packed: list[bytes], own: list) -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(packed), np.int32)
            ends = np.cumsum([0] + [len(x) // 4 for x in packed], dtype=np.int64).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            decoded = [encoder.vocabulary.decode(np.frombuffer(x, np.int32).tolist()) for x in packed]
            return pa.RecordBatch.from_arrays([pa.array(own, kind), tokens, pa.array(decoded, pa.binary())], names=["id", "ids", "decoded"])

        def flush() -> Iterator[pa.RecordBatch]:
            encoder.learn(new)
            packed, own, size = [], [], 0
            for i, words in zip(ids, waiting, strict=True):
                x = encoder.encode(words)
                if own and size + len(x) > RESULT_BYTES:
                    yield results(packed, own)
                    packed, own, size = [], [], 0
                packed.append(x), own.append(i)
                size += len(x)
            yield results(packed, own)
            encoder.forget(new)
            ids.clear(), waiting.clear(), new.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = encoder.cut(text or "")
                ids.append(i)
                waiting.append([new.setdefault(w, w) for w in words])  # equal words of a block are one string
                chars += len(text or "")
                if chars >= BLOCK_CHARS:
                    yield from flush()
                    chars = 0
        if ids:
            yield from flush()

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
