"""Near copies by SimHash: fingerprints that differ in few bits, found by a byte-position index with count filtering.

A fingerprint has 64 bits, one for each bit of the XXH64 of the text's word shingles, repeats included: 1 if over half
of them have it. Seen as eight positional bytes, two fingerprints that differ in at most BITS = 3 bits share at least
five. The distinct fingerprints meet in lists of an inverted index:

1. Positional bytes are ordered by how often they occur, rare ones first. Of the first five bytes of two such
   fingerprints two at least are the same, so lists are kept by pairs of positional bytes: ten postings each.
2. A pair's list with over MOST members is not compared. Its members go on to lists by five positional bytes, those
   that hold the pair; who shares five or more bytes, that pair among them, meets there.
3. In a list, the positional bytes that two members share are tallied, those with five or more are verified by their
   differing bits. A long list by five bytes leaves three bytes open, 24 bits: its members are marked in a map of 2**24
   bits and each looks up its 2,324 possible partners, so the work follows the members, not their pairs.

A list gives a spanning forest of its links, fewer rows than it has members, and components() joins the forests.

Bounds: there are 2,048 positional bytes and 28 * 2**16 pairs of them; their counts are all that is collected. A task
holds one list at a time: MOST fingerprints, or at most the 2**24 that five bytes leave open. Rows with one text, and
texts with one fingerprint, are one member, so groups of copies cost nothing here.

Edge cases: null, empty and blank texts have the fingerprint zero, which links like any other; fewer words than a
shingle has are one shingle; rows that repeat an id are rows of their own; a null id is never the id of a component
unless all its rows have none; columns other than the named ones are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scratch import dropped, held, kept, parts, small_batches, tidy

#: Words of a shingle; the hashes' seed; differing bits of linked fingerprints.
WORDS, SEED, BITS = 3, 42, 3
#: Positional bytes that linked fingerprints share at least; the rarest of them in which they share PAIR.
SHARED, PAIR = 8 - BITS, 2
PREFIX = 8 - SHARED + PAIR
#: A list by two positional bytes is compared up to so many members, one by five up to LONG pair by pair.
MOST, LONG = 2048, 4096
#: Bytes of a text that are split into words in one step; hashes whose bits are counted, and postings that are compared, in one step; links held at once.
PIECE, STEP, HELD = 1 << 18, 1 << 14, 1 << 18
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = b" \t\n\x0b\x0c\r"
_PAIRS = list(combinations(range(8), PAIR))
_FIVES = list(combinations(range(8), SHARED))
_WITHIN = np.array([[set(p) <= set(q) for q in _FIVES] for p in _PAIRS])
_PAIR_AT = np.full((8, 8), -1, np.int64)
for _k, (_i, _j) in enumerate(_PAIRS):
    _PAIR_AT[_i, _j] = _PAIR_AT[_j, _i] = _k
_BYTES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int = WORDS, seed: int = SEED) -> Iterator[list[int]]:
    """The hashes of a text's shingles, in order, in lists of bounded length."""
    tail, full, at = [], False, 0
    while at < len(text):
        stop = min(at + PIECE, len(text))
        while stop < len(text) and text[stop] not in _BLANK:
            stop += 1
        words = tail + text[at:stop].translate(_LOWER).split()
        at = stop
        if len(words) >= size:
            full = True
            joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[: len(words) - size].tolist()]
            stops = (ends[size - 1 :] - 1).tolist()
            digest = xxhash.xxh64_intdigest
            for k in range(0, len(starts), STEP):
                yield [digest(joined[s:e], seed) for s, e in zip(starts[k : k + STEP], stops[k : k + STEP], strict=True)]
        tail = words[len(words) - size + 1 :] if len(words) >= size else words
    if tail and not full:
        yield [xxhash.xxh64_intdigest(b" ".join(tail), seed)]


def fingerprint_of(text: bytes, size: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text: bits that over half of its shingles' hashes have."""
    ones, n = np.zeros(64, np.int64), 0
    for found in shingle_hashes(text, size, seed):
        bits = np.unpackbits(np.array(found, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(found)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(t or b"", size, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary")).mapInArrow(tidy(run), schema)


def shown(fp: Column) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _positional(fps: np.ndarray) -> np.ndarray:
    """The eight bytes of each fingerprint, most significant first."""
    return fps.astype(">u8").view(np.uint8).reshape(-1, 8)


def byte_order(fps: DataFrame) -> np.ndarray:
    """The place of each positional byte, 256 * position + byte, in the order of rising frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2048, np.int64)
        for batch in batches:
            own = _positional(batch.column(0).to_numpy().view(np.uint64))
            counts += np.bincount((own + np.arange(8, dtype=np.int64) * 256).ravel(), minlength=2048)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2048)), pa.array(counts)], names=["byte", "n"])

    counts = np.zeros(2048, np.int64)
    for row in fps.select("fp").mapInArrow(tidy(run), "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[row["byte"]] = row["n"]
    order = np.empty(2048, np.int64)
    order[np.argsort(counts, kind="stable")] = np.arange(2048)
    return order


def _pair_keys(fps: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each fingerprint the lists of the pairs among its PREFIX rarest positional bytes."""
    own = _positional(fps).astype(np.int64)
    first = np.argsort(order[own + np.arange(8) * 256], axis=1)[:, :PREFIX]
    first.sort(axis=1)
    value = np.take_along_axis(own, first, axis=1)
    keys = [_PAIR_AT[first[:, i], first[:, j]] << 16 | value[:, i] << 8 | value[:, j] for i, j in combinations(range(PREFIX), 2)]
    return np.stack(keys, axis=1)


def _five_keys(fps: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the lists by five positional bytes that which, rows by _FIVES, asks for."""
    own = _positional(fps).astype(np.int64)
    rows, keys = [], []
    for k, five in enumerate(_FIVES):
        at = np.flatnonzero(which[:, k])
        if len(at):
            key = np.full(len(at), len(_PAIRS) + k, np.int64)
            for position in five:
                key = key << 8 | own[at, position]
            rows.append(at)
            keys.append(key)
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (none, none)


def postings(fps: DataFrame, order: np.ndarray, hot: np.ndarray | None = None) -> DataFrame:
    """(key, fp): the lists of each fingerprint; hot marks the pairs whose lists are too long, for which those by five
    positional bytes come instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            pairs = _pair_keys(own, order)
            long = (np.unpackbits(hot)[pairs] if hot is not None else np.zeros(pairs.shape, np.uint8)).astype(bool)
            rows, at = np.nonzero(~long)
            asked = np.zeros((len(own), len(_FIVES)), bool)
            for k in range(pairs.shape[1]):
                some = np.flatnonzero(long[:, k])
                asked[some] |= _WITHIN[pairs[some, k] >> 16]
            more, keys = _five_keys(own, asked)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([pairs[rows, at], keys])), pa.array(own[np.concatenate([rows, more])].view(np.int64))], names=["key", "fp"]
            )

    return fps.select("fp").mapInArrow(tidy(run), "key long, fp long")


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two fingerprints differ in at most BITS bits: shared positional bytes are tallied, then bits compared."""
    differ = x ^ y
    some = differ | differ >> np.uint64(4)
    some |= some >> np.uint64(2)
    some |= some >> np.uint64(1)
    enough = np.bitwise_count(some & _BYTES) <= 8 - SHARED
    enough[enough] = np.bitwise_count(differ[enough]) <= BITS
    return enough


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lets root, an array that names for each element one at most as large of the same class, hold the links a, b."""
    while len(a):
        a, b = root[a], root[b]
        while (root[a] != a).any() or (root[b] != b).any():
            a, b = root[a], root[b]
        apart = a != b
        a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        np.minimum.at(root, a, b)


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same elements as x, y, with fewer links than elements."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    root = np.arange(len(nodes))
    _joined(root, at[: len(x)], at[len(x) :])
    while (root[root] != root).any():
        root = root[root]
    some = root != np.arange(len(nodes))
    return nodes[some], nodes[root[some]]


def _pairwise(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links in lists, which stand one after the other; each member is compared with those after it, step by step."""
    found, held_links = [], 0
    at, step = np.arange(len(keys)), 1
    while True:
        at = at[at < len(keys) - step]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        x, y = fps[at], fps[at + step]
        yes = linked(x, y)
        if yes.any():
            found.append((x[yes], y[yes]))
            held_links += len(found[-1][0])
            if held_links > HELD:
                found = [_forest(*(np.concatenate(z) for z in zip(*found, strict=True)))]
                held_links = len(found[0][0])
        step += 1
    if found:
        yield _forest(*(np.concatenate(z) for z in zip(*found, strict=True)))


def _looked_up(key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links in one list by five positional bytes, by a map of the bits that are open; fps are distinct."""
    open_at = [p for p in range(8) if p not in _FIVES[(key >> 8 * SHARED) - len(_PAIRS)]]
    own = _positional(fps).astype(np.uint32)
    rest = own[:, open_at[0]] << 16 | own[:, open_at[1]] << 8 | own[:, open_at[2]]
    order = np.argsort(rest)
    fps, rest = fps[order], rest[order]
    here = np.zeros(1 << 24, bool)
    here[rest] = True
    root = np.arange(len(rest))
    for n in range(1, BITS + 1):
        for bits in combinations(range(24), n):
            other = rest ^ np.uint32(sum(1 << b for b in bits))
            at = np.flatnonzero(here[other] & (other > rest))
            if len(at):
                _joined(root, at, np.searchsorted(rest, other[at]))
    while (root[root] != root).any():
        root = root[root]
    some = root != np.arange(len(root))
    return fps[some], fps[root[some]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of lists that come sorted; the last list waits for the batches to come."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def compared(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
        sizes = np.diff(np.append(firsts, len(keys)))
        long = (sizes > LONG) & (keys[firsts] >= len(_PAIRS) << 8 * SHARED)
        for first, size in zip(firsts[long].tolist(), sizes[long].tolist(), strict=True):
            yield batch(*_looked_up(int(keys[first]), fps[first : first + size]))
        rest = np.repeat(~long, sizes)
        for x, y in _pairwise(keys[rest], fps[rest]):
            yield batch(x, y)

    def batch(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    enough = STEP
    for rows in batches:
        waiting.append((rows.column(0).to_numpy(), rows.column(1).to_numpy().view(np.uint64)))
        if sum(len(w[0]) for w in waiting) < enough:
            continue
        keys, fps = (np.concatenate([w[k] for w in waiting]) for k in range(2))
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield from compared(keys[:cut], fps[:cut])
        waiting = [(keys[cut:].copy(), fps[cut:].copy())]
        enough = STEP + 2 * (len(keys) - cut)
    if waiting:
        yield from compared(*(np.concatenate([w[k] for w in waiting]) for k in range(2)))


def links(fps: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b): links that join the fingerprints fps, distinct longs in a table that is kept, that are joined by links."""
    most = MOST if most is None else most
    order = byte_order(fps)
    long = postings(fps, order).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key").toArrow().column(0).to_numpy()
    hot = np.zeros(len(_PAIRS) << 16, np.uint8)
    hot[long] = 1
    dealt = postings(fps, order, np.packbits(hot)).repartition(parts(fps.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidy(_links), "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, seed: int = SEED) -> DataFrame:
    """For each row: id_col, fp (long), component_id: the smallest id that links of fingerprints reach."""
    rows = kept(fingerprints(docs, id_col, text_col, size, seed), "simhash")
    fps = kept(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")), "fps")
    edges = kept(links(fps), "links")
    classes = components(edges).withColumnRenamed("node", "fp")
    joined = fps.join(held(kept(classes, "classes")), "fp")
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    linked_fps = joined.join(held(kept(least, "least")), "root").select("fp", "n", "component")
    lone = fps.where("n > 1").join(held(linked_fps.select("fp")), "fp", "left_anti").select("fp", "n", F.col("least").alias("component"))
    shared = kept(linked_fps.unionByName(lone), "shared")
    dropped(edges)
    # Fingerprints of a thousandth of all rows or more, at most a thousand, are settled where their rows are.
    often = F.col("n") >= F.greatest(F.lit(2), F.lit(rows.count()) / 1000)
    out = rows.join(F.broadcast(shared.where(often).select("fp", F.struct("component").alias("_often"))), "fp", "left")
    out = out.join(held(shared.where(~often).select("fp", F.struct("component").alias("_rare"))), "fp", "left")
    component = F.when(F.col("_often").isNotNull(), F.col("_often.component")).when(F.col("_rare").isNotNull(), F.col("_rare.component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "fp", component.alias("component_id"))
