"""Fill-in-middle: cuts by checkpoints against plain matching, outputs against a plain version, edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import fill_middle

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 18])
def test_cuts(monkeypatch, piece):
    monkeypatch.setattr(fill_middle, "PIECE", piece)
    rnd = random.Random(piece)
    for _ in range(400):
        text = "".join(rnd.choice("ab é\n\t 😀\x85 ") for _ in range(rnd.randrange(40)))
        units = UNITS.findall(text)
        index = fill_middle.counted(np.frombuffer(text.encode(), np.uint8), rnd.choice([1, 2, 3, 256]))
        assert (index.units, index.chars) == (len(units), len(text))
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert index.cut(k) == (len(before.encode()), len(before))


def test_checkpoints_are_sparse():
    index = fill_middle.counted(np.frombuffer(b"word " * 100_000, np.uint8), 256)
    assert index.units == 100_001 and len(index.marks) == 100_000 // 256 + 1
    assert index.cut(77_777) == (77_777 * 5 - 1, 77_777 * 5 - 1)


def by_force(i, text, seed=42, rate=50, spm=80):
    text, told = text or "", hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(told[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("seed", "rate", "spm"), [(42, 50, 80), (7, 100, 0), (7, 100, 100), (1, 0, 50)])
def test_outputs(spark, seed, rate, spm):
    rnd = random.Random(seed)
    rows = [(k, "".join(rnd.choice(["a", "<", "P>", "<S", "é ", "\n", " x", "<M>" if k % 9 == 0 else ""]) for _ in range(rnd.randrange(40))), "x") for k in range(300)]
    rows += [(300, None, "x"), (301, "", "y"), (302, " \n ", None), (302, " \n ", None), (None, "some words here", "z"), (303, "one " * 200_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    out = fill_middle.fill_in_middle(docs, seed=seed, rate=rate, spm_rate=spm).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out), key=key)
    assert got == sorted(((i, *by_force(i, t, seed, rate, spm), t or "") for i, t, _ in rows), key=key)


def test_other_sentinels_and_no_rows(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    signs = ("[a.", "[b.", "[c.")
    rows = spark.createDataFrame([(k, f"{k} words <P> and [ab more") for k in range(50)], "doc_id long, text string")
    out = fill_middle.fill_in_middle(rows, rate=100, sentinels=signs)
    assert out.where("form = 'plain'").count() == 0
    back = out.select("doc_id", fill_middle.restored(F.col("output"), F.col("form"), signs).alias("text"))
    assert sorted(back.collect()) == sorted(rows.collect())
