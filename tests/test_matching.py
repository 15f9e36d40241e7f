"""Ranges, islands and matchings of files with many findings; owners by a sweep."""

import random
import time

from pyspark.sql import functions as F

from siftwork.operators import evaluate, indexing

PSHAPE = "variant string, prediction_index int, language string, path string, category string, cwe_id string, start_line int, end_line int, risk_level string, fingerprint string, position int"
TSHAPE = "gt_id string, language string, path string, category string, cwe_id string, sink_line int, start_line int, end_line int, vulnerable boolean"


def findings(seed, n, lines):
    rnd = random.Random(seed)
    made, truth = [], []
    for k in range(n):
        a, b = rnd.randrange(lines), rnd.randrange(lines)
        made.append(("v", k, "java", f"f{k % 2}", "quality", "", a, a + rnd.choice([-1, 0, 1, 3, 9, 40]), rnd.choice(["High", "Low"]), f"p{k}", k))
        truth.append((f"g{k:05}", "java", f"f{k % 2}", "quality", "", b + rnd.randrange(4), b, b + rnd.choice([-1, 0, 1, 2, 5, 6, 30]), True))
    return made, truth


def agree(p, t):
    if p[3] != t[2]:
        return False
    shared = min(p[7], t[7]) - max(p[6], t[6]) + 1
    overlap = shared / (t[7] - t[6] + 1) if p[6] <= p[7] and t[6] <= t[7] and shared > 0 else 0
    return p[6] <= t[5] <= p[7] or overlap >= 0.5


def test_ranges_by_brute_force(spark):
    for seed, n, lines in ((1, 120, 60), (2, 150, 500), (3, 60, 8)):
        made, truth = findings(seed, n, lines)
        pairs = evaluate.candidates(spark.createDataFrame(made, PSHAPE), spark.createDataFrame(truth, TSHAPE))
        got = sorted((r["prediction_index"], r["gt_id"]) for r in pairs.collect())
        assert got == sorted((p[1], t[0]) for p in made for t in truth if agree(p, t))


def plain_matching(made, truth, order):
    edges = {}
    for p in sorted(made, key=order):
        near = [t for t in truth if agree(p, t)]
        share = lambda t: max(0, min(p[7], t[7]) - max(p[6], t[6]) + 1) / max(1, t[7] - t[6] + 1) if t[6] <= t[7] else 0.0  # noqa: B023, E731
        edges[p[1]] = [t[0] for t in sorted(near, key=lambda t: (not p[6] <= t[5] <= p[7], -share(t), t[0]))]  # noqa: B023
    return evaluate.maximum_matching(edges.items())


def test_islands_keep_the_pairs(spark):
    """The same pairs as one matching over all predictions in the same order; prefixes of another order are largest too."""
    for seed, n, lines in ((4, 90, 40), (5, 120, 300)):
        made, truth = findings(seed, n, lines)
        p, t = spark.createDataFrame(made, PSHAPE), spark.createDataFrame(truth, TSHAPE)
        got = {r["gt_id"]: r["prediction_index"] for r in evaluate.matched(evaluate.candidates(p, t)).collect()}
        assert got == plain_matching(made, truth, lambda p: (p[3], p[6], p[7], p[5], p[8], p[9], p[1]))
        recalls = {r["k"]: r["recall"] for r in evaluate.recall_by_prefix(p, t, [1, 7, 30, n], ["language"]).collect()}
        for k, recall in recalls.items():
            assert round(recall * len(truth)) == len(plain_matching(made[:k], truth, lambda p: p[1]))


def test_prefixes_compete(spark):
    """Two predictions that both want the first of two labels: the second finds the other one."""
    truth = [(g, "java", "src/A.java", "security", "CWE-89", 10, 1, 10, True) for g in ("gt-1", "gt-2")]
    made = [("v", k, "java", "src/A.java", "security", "CWE-89", 1, 10, "Low", "x", k) for k in range(2)]
    out = evaluate.recall_by_prefix(spark.createDataFrame(made, PSHAPE), spark.createDataFrame(truth, TSHAPE), [1, 2], ["language"])
    assert {r["k"]: r["recall"] for r in out.collect()} == {1: 0.5, 2: 1.0}


def test_one_file_with_many_findings(spark):
    n = 100_000
    k = F.col("id").cast("int")
    at = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4 * n)).cast("int")
    both = [F.lit("java").alias("language"), F.lit("one").alias("path"), F.lit("quality").alias("category"), F.lit("").alias("cwe_id")]
    made = spark.range(n).select(F.lit("v").alias("variant"), k.alias("prediction_index"), *both, at.alias("start_line"), (at + k % 7).alias("end_line"), F.lit("Low").alias("risk_level"), F.lit("p").alias("fingerprint"))
    truth = spark.range(n).select(F.concat(F.lit("g"), k).alias("gt_id"), *both, (at + 1).alias("sink_line"), at.alias("start_line"), (at + 3).alias("end_line"), F.lit(True).alias("vulnerable"))
    began = time.time()
    pairs = evaluate.candidates(made, truth).cache()
    isles = evaluate.islands(pairs, evaluate.KEYS).groupBy("island").agg(F.countDistinct("gt_id").alias("n"))
    few = isles.agg(F.count("*").alias("islands"), F.max("n").alias("most")).first()
    found = evaluate.matched(pairs).agg(F.count("*").alias("n"), F.countDistinct("gt_id").alias("labels"), F.countDistinct("prediction_index").alias("made")).first()
    assert few["islands"] > n / 20 and few["most"] < 2000 and n * 0.6 < found["n"] == found["labels"] == found["made"]
    assert time.time() - began < 240
    pairs.unpersist()


def test_owners_by_brute_force(spark):
    rnd = random.Random(6)
    for lines, longest in ((12, 12), (40, 15), (200, 60)):
        spans = [(rnd.randrange(3), k, s, s + rnd.randrange(longest)) for k, s in enumerate(rnd.randrange(lines) for _ in range(150))]
        items = [*spans, (None, 900, 1, 2), (1, 901, None, 2), (0, 902, 3, None)]
        definitions = [x for x in spans if rnd.random() < 0.6] + [(1, 950, 5, 4), (None, 951, 0, 99)]
        out = indexing.owning_interval(spark.createDataFrame(items, "file_id int, item_id int, start int, end int"), spark.createDataFrame(definitions, "file_id int, def_id int, start int, end int"))
        want = {}
        for f, i, s, e in items:
            around = [] if None in (f, s, e) else [(b - a, d) for g, d, a, b in definitions if g == f and a <= s and b >= e and (a, b) != (s, e)]
            want[i] = min(around)[1] if around else None
        assert {r["item_id"]: r["owner"] for r in out.collect()} == want


def test_owners_in_one_deep_file(spark):
    n = 50_000
    spans = spark.range(n).select(F.lit(1).alias("file_id"), F.col("id").alias("item_id"), F.col("id").alias("start"), (2 * n - F.col("id")).alias("end"))
    out = indexing.owning_interval(spans, spans.withColumnRenamed("item_id", "def_id"))
    assert out.where("owner = item_id - 1").count() == n - 1


def test_shuffles_of_a_matching(spark):
    """Pairs are shuffled by key and by island only, and a label whose points are close goes to one stretch."""
    made, truth = findings(8, 60, 40)
    pairs = evaluate.candidates(spark.createDataFrame(made, PSHAPE), spark.createDataFrame(truth, TSHAPE))
    plan = evaluate.matched(pairs, ["language"])._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Subquery")[0].count("Exchange hashpartitioning") <= 4
    t = [("g", "java", "a", "quality", "", 2, 1, 4, True)]
    p = [("v", k, "java", "a", "quality", "", 1, 1 + k, "Low", "x", k) for k in range(1, 7)]
    pairs = evaluate.candidates(spark.createDataFrame(p, PSHAPE), spark.createDataFrame(t, TSHAPE))
    assert sorted((r["prediction_index"], r["point"]) for r in pairs.collect()) == [(k, 2) for k in range(1, 7)]
