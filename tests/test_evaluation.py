import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import evaluate

# Labelled findings and predictions of a small test set, (name, path, cwe, sink, start, end) and
# (name, path, cwe, start, end, risk), in order.
TRUTH = {
    "java": [
        ("sqli-001", "sqli/VulnerableService.java", 89, 14, 14, 15), ("hardcoded-key-001", "hardcoded_key/HardcodedKey.java", 798, 6, 6, 6), ("nullptr-001", "null_pointer/NullableService.java", 476, 8, 8, 8),
        ("transaction-001", "transaction/MissingTransaction.java", 778, 12, 12, 15), ("missing-auth-001", "missing_auth/UnprotectedEndpoint.java", 862, 7, 7, 8),
        ("plaintext-pwd-001", "plaintext_password/PlaintextLog.java", 256, 12, 12, 12), ("sensitive-log-001", "sensitive_log/SensitiveLog.java", 532, 12, 11, 13), ("cmd-inject-001", "command_injection/VulnerableCommand.java", 78, 11, 10, 11),
    ],
    "python": [
        ("sqli-001", "sqli/vulnerable_query.py", 89, 9, 8, 9), ("cmd-inject-001", "command_injection/vulnerable_subprocess.py", 78, 6, 6, 6), ("deserialize-001", "insecure_deserialization/vulnerable_pickle.py", 502, 6, 6, 6),
        ("hardcoded-key-001", "hardcoded_key/hardcoded_secret.py", 798, 3, 3, 3), ("path-traversal-001", "path_traversal/vulnerable_path.py", 22, 8, 7, 9), ("input-validation-001", "input_validation/no_validation.py", 20, 6, 6, 7),
        ("assert-check-001", "assert_check/assert_security.py", 617, 3, 3, 3), ("exception-swallow-001", "exception_swallow/swallow_exception.py", 390, 8, 7, 9),
    ],
}
PREDICTED = {
    "java": [
        ("sqli-001", "sqli/VulnerableService.java", 89, 14, 15, "High"), ("hardcoded-key-001", "hardcoded_key/HardcodedKey.java", 798, 6, 6, "High"), ("nullptr-001", "null_pointer/NullableService.java", 476, 7, 8, "Medium"),
        ("transaction-001", "transaction/MissingTransaction.java", 778, 12, 15, "Medium"), ("missing-auth-001", "missing_auth/UnprotectedEndpoint.java", 862, 7, 8, "High"), ("fp-001", "sqli/SafeService.java", 89, 12, 13, "High"),
        ("fp-002", "sqli/VulnerableService.java", 20, 14, 15, "Medium"), ("fp-003", "missing_auth/SafeAuthenticated.java", 862, 7, 8, "Medium"),
    ],
    "python": [
        ("sqli-001", "sqli/vulnerable_query.py", 89, 8, 9, "High"), ("cmd-inject-001", "command_injection/vulnerable_subprocess.py", 78, 6, 6, "High"), ("deserialize-001", "insecure_deserialization/vulnerable_pickle.py", 502, 5, 6, "High"),
        ("hardcoded-key-001", "hardcoded_key/hardcoded_secret.py", 798, 3, 3, "Medium"), ("path-traversal-001", "path_traversal/vulnerable_path.py", 22, 7, 9, "Medium"), ("fp-001", "sqli/safe_query.py", 89, 7, 8, "High"),
        ("fp-002", "insecure_deserialization/vulnerable_pickle.py", 89, 5, 6, "Medium"), ("fp-003", "exception_swallow/swallow_exception.py", 390, 1, 3, "Low"),
    ],
}
ALL = {lang: [p[0] for p in rows] for lang, rows in PREDICTED.items()}
pick = lambda **at: {lang: [ALL[lang][i] for i in at[lang]] for lang in ALL}
same = lambda *at: pick(java=at, python=at)
# Which predictions each variant keeps, and its published macro precision, recall and F1.
VARIANTS = {
    "keyword": (same(0, 1, 5, 6), 0.500, 0.250, 0.333),
    "vector": (pick(java=(0, 2, 3, 6, 7), python=(0, 2, 3, 6, 7)), 0.600, 0.375, 0.462),
    "hybrid_rrf": (same(*range(8)), 0.625, 0.625, 0.625),
    "review_only": (same(*range(8)), 0.625, 0.625, 0.625),
    "review_critic": (same(0, 1, 2, 3, 4, 5, 7), 0.714, 0.625, 0.667),
    "review_evidence_critic": (same(0, 1, 2, 3, 4), 1.000, 0.625, 0.769),
    "line_window": (same(0, 1, 5, 6), 0.500, 0.250, 0.333),
    "ast": (same(0, 1, 2, 3, 5, 6), 0.667, 0.500, 0.571),
    "ast_neighbors": (same(*range(8)), 0.625, 0.625, 0.625),
    "round_1": (same(0, 1, 2), 1.000, 0.375, 0.545),
    "round_2": (same(0, 1, 2, 3, 4, 5), 0.833, 0.625, 0.714),
    "round_3": (same(*range(8)), 0.625, 0.625, 0.625),
}
PSHAPE = "variant string, prediction_index int, language string, path string, category string, cwe_id string, start_line int, end_line int, risk_level string, fingerprint string, position int"
TSHAPE = "gt_id string, language string, path string, category string, cwe_id string, sink_line int, start_line int, end_line int, vulnerable boolean"


def tables(spark):
    truth = [(f"{lang}-{n}", lang, p, "security", f"CWE-{c}", s, a, b, True) for lang, rows in TRUTH.items() for n, p, c, s, a, b in rows]
    made = []
    for variant, (names, *_) in VARIANTS.items():
        for lang, rows in PREDICTED.items():
            kept = [r for r in rows if r[0] in names[lang]]
            made += [(variant, 100 * (lang == "python") + k, lang, p, "security", f"CWE-{c}", a, b, risk, n, k) for k, (n, p, c, a, b, risk) in enumerate(kept)]
    return spark.createDataFrame(made, PSHAPE), spark.createDataFrame(truth, TSHAPE)


def test_ablation_rows(spark):
    predictions, truth = tables(spark)
    pairs = evaluate.candidates(predictions, truth, ["variant"]).withColumn("lang", F.col("language"))
    matches = evaluate.matched(pairs, ["variant", "lang"]).withColumnRenamed("lang", "language")
    out = evaluate.evaluation(predictions, truth, matches, ["variant", "language"])
    counts = {(r["variant"], r["language"]): (r["tp"], r["fp"], r["fn"], round(r["high_risk_fp_rate"], 3), r["localization_rate"]) for r in out.collect()}
    assert counts["hybrid_rrf", "java"][:3] == counts["hybrid_rrf", "python"][:3] == (5, 3, 3)
    assert counts["vector", "java"] == (3, 2, 5, 0.0, 1.0) and all(c[4] == 1.0 for c in counts.values())
    assert round((counts["keyword", "java"][3] + counts["keyword", "python"][3]) / 2, 3) == 0.333
    runs = out.withColumn("run", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    macro = {r["variant"]: r for r in evaluate.macro(runs, ["variant"], "run", ["precision", "recall", "f1"]).collect()}
    for variant, (_, p, r, f) in VARIANTS.items():
        m = macro[variant]
        assert [round(m[k], 3) for k in ("precision_mean", "recall_mean", "f1_mean")] == [p, r, f], variant
        assert m["f1_std"] == 0


def test_recall_by_prefix(spark):
    predictions, truth = tables(spark)
    out = evaluate.recall_by_prefix(predictions.where("variant = 'hybrid_rrf'"), truth, [1, 5, 10], ["language"])
    assert {(r["language"], r["k"]): r["recall"] for r in out.collect()} == {(lang, k): x for lang in ("java", "python") for k, x in ((1, 0.125), (5, 0.625), (10, 0.625))}


@pytest.mark.parametrize(("change", "ok"), [({}, True), ({"cwe_id": "CWE-1"}, False), ({"category": "quality", "cwe_id": "CWE-1"}, False), ({"start_line": 11, "end_line": 12}, False), ({"start_line": 8, "end_line": 9}, False), ({"start_line": 10, "end_line": 20}, True), ({"path": "src//Foo.java"}, True)])
def test_candidates(spark, change, ok):
    p = dict(variant="v", prediction_index=0, language="java", path="src/Foo.java", category="security", cwe_id="CWE-89", start_line=8, end_line=12, risk_level="Medium", fingerprint="f", position=0) | change
    t = ("g", "java", "src/Foo.java", "security", "CWE-89", 10, 8, 12, True)
    out = evaluate.candidates(spark.createDataFrame([tuple(p.values())], PSHAPE), spark.createDataFrame([t], TSHAPE))
    assert (out.count() == 1) == ok


def test_cwe_counts_for_security_only(spark):
    p = ("v", 0, "java", "a", "quality", "CWE-1", 1, 2, "Low", "f", 0)
    assert evaluate.candidates(spark.createDataFrame([p], PSHAPE), spark.createDataFrame([("g", "java", "a", "quality", "CWE-2", 1, 1, 4, True)], TSHAPE)).count() == 1


def test_half_of_the_range_is_enough(spark):
    t = spark.createDataFrame([("g", "java", "a", "quality", "", 10, 1, 10, True)], TSHAPE)
    p = [("v", k, "java", "a", "quality", "", a, b, "Low", "f", k) for k, (a, b) in enumerate([(1, 5), (1, 4), (5, 1)])]
    assert [r["prediction_index"] for r in evaluate.candidates(spark.createDataFrame(p, PSHAPE), t).collect()] == [0]


def test_matching_beats_greedy(spark):
    truth = spark.createDataFrame([("a", "java", "f", "quality", "", 10, 1, 10, True), ("b", "java", "f", "quality", "", 4, 1, 4, True)], TSHAPE)
    made = spark.createDataFrame([("v", 0, "java", "f", "quality", "", 1, 10, "Low", "x", 0), ("v", 1, "java", "f", "quality", "", 5, 10, "Low", "y", 1)], PSHAPE)
    found = evaluate.matched(evaluate.candidates(made, truth))
    assert {(r["gt_id"], r["prediction_index"]) for r in found.collect()} == {("a", 1), ("b", 0)}
    free_truth, free_made = evaluate.unmatched(truth, made, found)
    assert free_truth.count() == free_made.count() == 0


def test_matching_is_maximum():
    rnd = random.Random(4)
    for _ in range(300):
        n, m = rnd.randrange(1, 6), rnd.randrange(1, 6)
        edges = [(p, [g for g in range(m) if rnd.random() < 0.4]) for p in range(n)]
        best = _largest(dict(edges), set())
        got = evaluate.maximum_matching(edges)
        assert len(got) == best and len(set(got.values())) == len(got) and all(g in dict(edges)[p] for g, p in got.items())


def _largest(edges, used):
    if not edges:
        return 0
    (p, rights), *rest = edges.items()
    return max([_largest(dict(rest), used)] + [1 + _largest(dict(rest), used | {g}) for g in rights if g not in used])
