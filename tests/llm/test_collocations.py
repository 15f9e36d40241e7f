"""Collocations against a brute-force version, with shares of pivots, small steps and words that come by a join; exact scores."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftwork.llm import collocations

COLUMNS = "doc_id long, text string, lang string, n long, gram string"


def by_force(rows, least, longest, first, percent=100):
    total, counts = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longer = Counter()
        for g, a in found.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    longer[g[i : i + m]] = max(longer[g[i : i + m]], a)
        scored = []
        for g, a in found.items():
            if longer[g] and 100 * longer[g] >= percent * a:
                continue
            s, k = min((1000 * a * total[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-s, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    words, ends = ["the", "The", "of", "a", "é", "ab", "cd", "x\x85y", "new", "york", "z"], [" ", " ", " ", "  ", "\t", ". ", ",", "\n"]
    rows = []
    for k in range(200):
        text = "".join(rnd.choice(words[: rnd.choice([3, 7, 11])]) + rnd.choice(ends) for _ in range(rnd.randrange(60)))
        rows.append((k, text + rnd.choice(["", "new york city hall", "the the the the the the"]), rnd.choice(["en", "en", "fr", None, "und", ""]), k, "own"))
    return rows + [(1, None, "en", 1, None), (2, "", None, 2, None), (3, " . , ", "de", 3, None), (None, "new york city hall", "en", 3, None), (None, "new york city hall", "en", 3, None)]


@pytest.mark.parametrize(
    ("limits", "least", "longest", "first", "percent"),
    [({}, 5, 5, 2000, 100), ({"HOT": 40, "STEP": 50, "GATHERED": 70, "PIECE": 7, "HELD": 3}, 5, 5, 7, 100), ({"DICTIONARY": 2}, 4, 4, 20, 60), ({"DICTIONARY_BYTES": 0, "HOT": 25}, 3, 2, 3, 100), ({"STEP": 1, "MET": 1}, 9, 7, 2000, 100)],
)
def test_collocations(spark, monkeypatch, limits, least, longest, first, percent):
    for name, value in limits.items():
        monkeypatch.setattr(collocations, name, value)
    rows = corpus(least)
    out = collocations.collocations(spark.createDataFrame(rows, COLUMNS).repartition(3), least=least, longest=longest, first=first, percent=percent)
    assert sorted(tuple(r) for r in out.collect()) == by_force(rows, least, longest, first, percent)


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], COLUMNS)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, "rare words only", "en", 1, "")], COLUMNS)).collect() == []


def test_scores_are_exact(spark):
    rnd = random.Random(4)
    rows = [tuple(rnd.randrange(1, 10 ** rnd.randrange(1, 16)) for _ in range(4)) for _ in range(500)]
    rows = [r for r in rows if 1000 * r[0] * r[1] // (r[2] * r[3]) < 2**63] + [(10**15, 10**15 - 1, 10**15 - 3, 10**15 - 7)]
    out = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", collocations.score(*(F.col(c) for c in "anlr")).alias("s")).collect()
    assert all(r["s"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"]) for r in out)


def test_pivots_hold_only_their_own(spark):
    """A fragment's words are never rarer than its pivot, and those to the left are more frequent."""
    import numpy as np

    rnd = np.random.default_rng(1)
    ids = rnd.integers(-1, 6, 500)
    pivots, left, right, around = collocations.windows(ids, 4)
    assert (around[:, :4] < pivots[:, None]).all() and (around[:, 4:] <= pivots[:, None]).all()
    assert ((around[:, :4] >= 0).sum(1) == left).all() and ((around[:, 4:] >= 0).sum(1) == right).all()
