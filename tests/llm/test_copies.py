"""Exact copies, similar documents, fingerprints, mixing."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftwork.llm import exact_dedup, fingerprint, jaccard, mixing
from siftwork.llm.components import components

DOCS = "doc_id long, text string"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def words_of(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_misra_gries_keeps_the_heavy():
    rnd = random.Random(1)
    for _ in range(200):
        stream = [(bytes([min(rnd.randrange(9), rnd.randrange(9))]), rnd.randrange(1, 4)) for _ in range(rnd.randrange(80))]
        kept, total, true = exact_dedup.misra_gries(iter(stream), 3), sum(w for _, w in stream), Counter()
        for v, w in stream:
            true[v] += w
        assert len(kept) <= 3 and all(v in kept for v, n in true.items() if n > total / 4) and all(kept[v] <= true[v] for v in kept)


def exact_by_force(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("limits", [{}, {"slots": 1, "candidates": 1}, {"slots": 2, "candidates": 500}])
def test_exact_groups(spark, limits):
    rnd = random.Random(2)
    rows = [(k, rnd.choice(["hot"] * 8 + ["a", "b", "c", "", None, f"own {k}"])) for k in range(300)]
    out = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS).repartition(5), **limits).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == exact_by_force(rows)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in out)


def test_exact_edge_cases(spark):
    rows = [(1, "x"), (1, "x"), (None, "x"), (2, None), (2, ""), (None, "y"), (None, "y")]
    out = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(r["kept"] for r in out) == 3 and {(r["keep_id"], r["group_size"]) for r in out} == {(1, 3), (2, 2), (None, 2)}
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOCS)).collect() == []
    wide = spark.createDataFrame([(1, "x", 5, "k"), (1, "x", 5, "k"), (3, "x", 6, "l"), (2, None, 7, "m")], "doc_id long, text string, n long, digest string")
    assert sorted(tuple(r) for r in exact_dedup.drop_exact_copies(wide).collect()) == [(2, None, 7, "m"), (3, "x", 6, "l")]


def test_rows_that_repeat_id_and_text(spark):
    hot = [(7, "x", k % 9, {"a": k}) for k in range(4000)]
    docs = spark.createDataFrame([*hot, (7, "y", 1, None), (6, "x", 1, None), (8, None, 1, None), (8, "", 1, None), (9, "z", 1, {"b": 1})], "doc_id long, text string, n long, m map<string,int>")
    for limits in ({}, {"slots": 2, "candidates": 1}):
        out = [exact_dedup.drop_exact_copies(docs.repartition(parts), **limits) for parts in (1, 7)]
        got = [sorted((r["doc_id"], r["text"] or "") for r in df.collect()) for df in out]
        assert got == [[(7, "x"), (7, "y"), (8, ""), (9, "z")]] * 2 and out[0].columns == docs.columns
        kept = [{(r["doc_id"], r["text"], r["n"]) for r in df.collect()} for df in out]
        assert kept[0] == kept[1]  # whatever the order of the rows


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == root
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def similar_by_force(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    base, shared = rnd.choices(vocabulary, k=80), rnd.choices(vocabulary, k=40)
    for _ in range(60):  # near copies
        w = list(base)
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        texts.append(" ".join(w[: rnd.choice([80, 80, 70, 60, 50])]))
    texts += [" ".join(shared[: rnd.randrange(5, 40)] + rnd.choices(vocabulary, k=rnd.randrange(12))) for _ in range(60)]
    texts += [" ".join(rnd.choices(vocabulary[:5], k=rnd.randrange(12))) for _ in range(60)]
    texts += [texts[0]] * 10 + [texts[1].upper(), None, "", " \n"]
    return list(enumerate(texts))


@pytest.mark.parametrize(("short", "rounds", "most"), [(17, 4, 1024), (3, 1, 20), (2, 0, 3)])
def test_similar_groups(spark, monkeypatch, short, rounds, most):
    """Also with lists, pairs and groups that are dealt to several tasks."""
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "MOST", most)
    monkeypatch.setattr(jaccard, "EACH", max(2, most // 4))
    rows = corpus(short)
    assert sorted(tuple(r) for r in jaccard.similar_groups(spark.createDataFrame(rows, DOCS)).collect()) == similar_by_force(rows)


def test_similar_edge_cases(spark):
    text = "a b c d e f g h"
    rows = spark.createDataFrame([(5, text, 1), (5, text, 1), (3, text.upper(), 2), (None, text, 3), (9, None, 4), (None, "z", 5)], "doc_id long, text string, n long")
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(rows).collect()), key=str)
    assert out == sorted([(5, 4, 3), (5, 4, 3), (3, 4, 3), (None, 4, 3), (9, 0, 9), (None, 1, None)], key=str)
    assert jaccard.similar_groups(spark.createDataFrame([], DOCS)).collect() == []
    assert sorted(r["n"] for r in jaccard.one_of_each(rows.where("doc_id is not null")).collect()) == [2, 4]


def test_prefixes_share_enough():
    """Sets over the threshold share at least the smaller multi-match of their prefixes."""
    import numpy as np

    rnd = random.Random(5)
    for _ in range(400):
        a = {rnd.randrange(60) for _ in range(rnd.randrange(1, 40))}
        b = {x for x in a if rnd.random() < 0.95} | {rnd.randrange(60) for _ in range(rnd.randrange(3))}
        if not b or 100 * len(a & b) < 75 * len(a | b):
            continue
        counts = np.array([(x * 7919) % 50 for x in range(60)], float)
        (la, pa), (lb, pb) = (jaccard.prefix_of(np.array(sorted(s), np.uint64), counts[sorted(s)], 3.0, 75, 100)[:2] for s in (a, b))
        assert len(set(pa.tolist()) & set(pb.tolist())) >= min(la, lb)


def test_fingerprints(spark):
    rnd = random.Random(6)
    rows = [(k * 3, " ".join(rnd.choices("abcdefg hij", k=rnd.randrange(900)))) for k in range(150)] + [(7, None), (8, ""), (10, rnd.choice("xyz") * 40)]
    rnd.shuffle(rows)
    out = {r["doc_id"]: r for r in fingerprint.compared_with_edit(spark.createDataFrame(rows, DOCS).repartition(6)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    near, far = 0, []
    for k, (i, t) in enumerate(order):
        following, cut = order[(k + 1) % len(order)][1], len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(t), shingles(edited)
        if len(a) > 60:
            near += 1
            far.append(abs(r["near_edited"] - len(a & b) / len(a | b)))
    assert near > 50 and sum(far) / near < 0.12
    assert out[7]["fingerprint"] == out[8]["fingerprint"] == ""


def test_fingerprint_ties_and_tiny_tables(spark):
    of = lambda rows: fingerprint.compared_with_edit(spark.createDataFrame(rows, DOCS)).collect()
    assert of([]) == []
    one = of([(4, "abcdefgh")])[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0
    assert len(of([(1, "b b"), (1, "a a"), (None, "c c"), (1, "a a")])) == 4


def test_fingerprints_by_brute_force(spark):
    """The strings, from whole-number arithmetic over the words of a text; likeness by sets of kept hashes."""
    import base64

    from siftwork.llm import shingles as sh

    whole = 2**64 - 1
    turn, base = int(sh._TURN[0]), 0x9E3779B97F4A7C15

    def spread(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & whole
        x = (x ^ x >> 27) * 0x94D049BB133111EB & whole
        return x ^ x >> 31

    def kept(text):
        words = [spread(sum(((b + 32 if 65 <= b <= 90 else b) + 1) * pow(base, k, 2**64) for k, b in enumerate(w)) & whole) for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
        take, all_of = min(5, len(words)), set()
        for i in range(len(words) - take + 1 if words else 0):
            h = take
            for w in words[i : i + take]:
                h = spread(h * turn + w & whole)
            all_of.add(h)
        short = sorted(h >> 16 for h in all_of)
        return sorted({h for h in short if h < 2**48 // fingerprint.SCALED} or set(short[:1]))

    rnd = random.Random(12)
    texts = [" ".join(rnd.choices(["Éa", "b", "Cc", "d", "e", "ff"], k=rnd.randrange(0, 60))) for _ in range(40)] + ["", "one", "Two words"]
    out = {r["doc_id"]: r for r in fingerprint.compared_with_edit(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    for k, text in enumerate(texts):
        own, after = kept(text), texts[(k + 1) % len(texts)]
        cut = len(text) // 4
        changed = kept(text[: len(text) - cut] + after[:cut])
        assert out[k]["fingerprint"] == base64.b64encode(b"".join(h.to_bytes(6) for h in own)).decode()
        for other, near in ((changed, "near_edited"), (kept(after), "near_next")):
            union = sorted(set(own) | set(other))
            union = [h for h in union if h < 2**48 // fingerprint.SCALED] or union[:1]
            want = len(set(own) & set(other) & set(union)) / len(union) if own and other else float(len(own) == len(other))
            assert abs(out[k][near] - want) < 1e-12
    with pytest.raises(TypeError, match="whole number"):
        fingerprint.compared_with_edit(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_sketches_merge():
    import numpy as np

    rnd = np.random.default_rng(7)
    for n, m in ((0, 5), (1, 1), (3, 400), (2000, 2000)):
        a, b = (np.unique(rnd.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2)) for k in (n, m))
        both = np.unique(np.concatenate((a, b)))
        assert fingerprint.merged(fingerprint.sketch(a), fingerprint.sketch(b)).tolist() == fingerprint.sketch(both).tolist()
        assert fingerprint.unpacked(fingerprint.packed(fingerprint.sketch(a))).tolist() == fingerprint.sketch(a).tolist()
    part = both[:: 4]
    assert fingerprint.containment(fingerprint.sketch(part), fingerprint.sketch(both)) == 1.0
    assert abs(fingerprint.containment(fingerprint.sketch(both), fingerprint.sketch(part)) - 0.25) < 0.05


def mixed(spark, rows, **how):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), **how).collect()


def test_mix_targets_and_bounds(spark):
    rnd = random.Random(8)
    rows = [(k, None if k % 50 == 0 else "w " * rnd.randrange(400), rnd.choice(["a"] * 6 + ["b", "c", "d", None])) for k in range(400)]
    out = mixed(spark, rows)
    assert len(out) == 400 and out and sorted(map(tuple, out), key=str) == sorted(map(tuple, mixed(spark, list(reversed(rows)))), key=str)
    total, per = sum(r["size"] for r in out), defaultdict(list)
    for r in out:
        assert r["size"] == len(words_of(rows[r["doc_id"]][1])) and 0 <= r["taken"] <= 2 * r["size"]
        per[r["source"]].append(r)
    weights = dict(zip(sorted(per, key=lambda s: (s is None, s)), [3, 1, 2, 3, 1], strict=True))
    size = {s: sum(r["size"] for r in rs) for s, rs in per.items()}
    target, open_ = {}, set(size)
    while True:  # raise all to a level; what is above its bound stops there
        left = 1.5 * total - sum(2 * size[s] for s in size if s not in open_)
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * size[s]}
        if not over:
            break
        open_ -= over
    for s, rs in per.items():
        target[s] = level * weights[s] if s in open_ else 2 * size[s]
        assert abs(rs[0]["target"] - target[s]) < 1e-6 and {r["source_size"] for r in rs} == {size[s]}
        assert abs(sum(r["taken"] for r in rs) - target[s]) <= 32 + 0.01 * size[s]


def test_apportionment_takes_the_highest_quotients(spark):
    rnd = random.Random(9)
    for kind in range(10):
        votes = [rnd.choice([0, 1, 5, 5, 15, 40, 300, 4000]) * (rnd.random() if kind % 2 else 1.0) for _ in range(rnd.randrange(1, 12))]
        seats = rnd.randrange(60) if sum(votes) else 0
        parties = spark.createDataFrame([(k, v) for k, v in enumerate(votes)], "p int, v double")
        got = [r["seats"] for r in mixing.apportion(parties, "v", F.lit(seats), [], [F.col("p")]).orderBy("p").collect()]
        best = sorted(((-v / (2 * k + 1), p, k) for p, v in enumerate(votes) if v > 0 for k in range(seats)))[:seats]
        assert got == [sum(p == q for _, q, _ in best) for p in range(len(votes))]


def test_shards_and_edge_cases_of_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    rows = [(k, "w " * (k % 37), "ab"[k % 2]) for k in range(300)]
    per = defaultdict(int)
    for r in mixed(spark, rows, block=10):
        assert r["taken"] <= 2 * r["size"]
        per[r["source"], r["target"]] += r["taken"]
    assert all(abs(taken - target) < 0.03 * target for (_, target), taken in per.items())
    assert mixed(spark, []) == []
    assert [(r["taken"], r["target"]) for r in mixed(spark, [(1, None, "a"), (2, "", None)])] == [(0, 0.0), (0, 0.0)]
    assert sum(r["taken"] for r in mixed(spark, [(1, "a b", None)] * 3)) in range(13)


def test_mixed_texts_are_what_is_taken(spark):
    rows = [(k, f" {k} ".join(f"w{j}" for j in range(k % 90)) or None, "abc"[k % 3], k) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed_texts(docs).collect()
    assert {r["doc_id"]: len(words_of(r["text"])) for r in out} == {k: n for k, n in taken.items() if n} and all(r["size"] == r["doc_id"] for r in out)
