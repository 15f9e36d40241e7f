"""SimHash groups against a brute-force version; lists that are dealt anew and looked up."""

import random
import re

import numpy as np
import pytest
import xxhash

from siftwork.llm import queries, simhash
from tests.llm.test_queries import SMALL, table

WORDS = re.compile("[^\x20\x09-\x0d]+")


def fingerprint(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    found = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def by_force(ids, fps):
    """The smallest id that each row reaches; ids are unique."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = {}
    for i, f in zip(ids, fps, strict=True):
        distinct.setdefault(f, []).append(i)
    values = list(distinct)
    near = np.array(values, np.uint64)
    for k, f in enumerate(values):
        same = distinct[f] + [distinct[values[m]][0] for m in np.flatnonzero(np.bitwise_count(near[:k] ^ near[k]) <= 3)]
        for other in same[1:]:
            x, y = find(same[0]), find(other)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_against_brute_force(spark):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op12_simhash"](spark, SMALL).collect()}
    rows = table(SMALL, "documents", "doc_id, text")
    fps = [fingerprint(t) for _, t in rows]
    roots = by_force([i for i, _ in rows], fps)
    assert got == {i: (f"{f:016x}", roots[i]) for (i, _), f in zip(rows, fps, strict=True)}


@pytest.mark.parametrize("piece", [3, 8, 1 << 18])
def test_fingerprints_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    monkeypatch.setattr(simhash, "STEP", 2)
    rnd = random.Random(piece)
    for text in ["", " \t", "a", "A b", "a  b\nc", "é\x85 ü É", *(" ".join(rnd.choices(["ab", "C", "déf", "ghijklmnop"], k=rnd.randrange(30))) for _ in range(200))]:
        assert simhash.fingerprint_of(text.encode()) == fingerprint(text)


def crowd(seed, bits=40, n=900):
    """Fingerprints in a ball, some of few bits, some at random."""
    rnd = random.Random(seed)
    base, out = rnd.getrandbits(64), [0, 1, 3]
    for _ in range(n):
        f = base if rnd.random() < 0.7 else rnd.getrandbits(64) & rnd.getrandbits(64) & rnd.getrandbits(64)
        for b in rnd.sample(range(bits), rnd.randrange(9)):
            f ^= 1 << b
        out.append(f)
    return out


@pytest.mark.parametrize(("most", "long"), [(2048, 4096), (5, 4096), (0, 1), (20, 30)])
def test_lists_of_any_length(spark, monkeypatch, most, long):
    """Also with lists that are dealt anew by five bytes, and such lists that are looked up."""
    fps = sorted(set(crowd(most)))
    monkeypatch.setattr(simhash, "LONG", long)
    monkeypatch.setattr(simhash, "STEP", 64)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    edges = [(r["a"], r["b"]) for r in simhash.links(table, most).collect()]
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    want = by_force(range(len(fps)), fps)
    got = {}
    for k, f in enumerate(signed):
        got.setdefault(find(f), k)
    assert {k: got[find(f)] for k, f in enumerate(signed)} == want
    assert len(edges) < 60 * len(fps)


def test_links_share_a_list():
    rnd, order = random.Random(3), np.random.default_rng(3)
    for _ in range(3000):
        x = y = rnd.getrandbits(64)
        for b in rnd.sample(range(64), rnd.randrange(6)):
            y ^= 1 << b
        pair = np.array([x, y], np.uint64)
        keys = simhash._pair_keys(pair, order.permutation(2048))
        near = (x ^ y).bit_count() <= 3
        assert simhash.linked(pair[:1], pair[1:])[0] == near and (not near or set(keys[0].tolist()) & set(keys[1].tolist()))


def test_edge_cases(spark):
    text = "one two three four five six"
    rows = [(7, text, 1), (7, text, 1), (None, text.upper(), 2), (4, None, 3), (9, " \n", 4), (None, "lone", 5), (None, "z", 6), (None, "z", 6)]
    out = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string, fp long")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out if r["doc_id"]) == [(4, 4), (7, 7), (7, 7), (9, 4)]
    assert sorted(str(r["component_id"]) for r in out if r["doc_id"] is None) == ["7", "None", "None", "None"]
    assert all(r["fp"] == 0 for r in out if r["doc_id"] in (4, 9))
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = " ".join(f"w{k % 977}" for k in range(200_000))
    assert simhash.near_groups(spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string")).select("component_id").distinct().count() == 1
