import json
import time

import pytest
from pyspark.sql import functions as F

from siftwork.functions import text
from siftwork.operators import chunking, context, indexing, review, scan, search, usage
from siftwork.plans import workflow
from siftwork.providers import ProviderError, SearchFailed
from siftwork.sources import readers


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_scan_of_a_project(spark):
    lines = {"src/api/auth.py": 2, "src/domain/order.py": 3, "tests/test_order.py": 1, "src/generated.py": 1, "README.md": 1}
    registered = spark.createDataFrame([(p,) for p in [*list(lines)[:4], "src/missing.py"]], "path string")
    physical = spark.createDataFrame([(p, 10, n) for p, n in lines.items()], "path string, size long, lines long")
    out = scan.reconcile(registered, physical)
    assert rows(out.select("path", "status", "priority", "reason"), "path") == [
        ("README.md", "skipped", None, "UNREGISTERED_FILE"), ("src/api/auth.py", "included", "high", None), ("src/domain/order.py", "included", "medium", None),
        ("src/generated.py", "skipped", None, "GENERATED_FILE"), ("src/missing.py", "failed", None, "FILE_MISSING"), ("tests/test_order.py", "included", "low", None),
    ]
    assert rows(scan.coverage(out)) == [(5, 5, 3, 1, 1, 0.6)]
    included = out.where("status = 'included'")
    assert rows(scan.priority_histogram(included)) == [(1, 1, 1)]
    assert rows(scan.language_stats(included)) == [("python", 3, 6, 30)]
    later = scan.applied(spark.createDataFrame([("src/api/auth.py",), ("x.py",)], "path string"), out)
    assert rows(later.select("path", "scan_status", "scan_reason"), "path") == [("src/api/auth.py", "included", None), ("x.py", "failed", "SCANNER_OMITTED")]
    assert rows(scan.coverage(out.where("false"))) == [(0, 0, 0, 0, 0, 1.0)]


def test_capped_passes_over_what_does_not_fit(spark):
    items = spark.createDataFrame([(1, k, n) for k, n in enumerate([60, 50, 30, 10, 5])], "m int, pos int, size long")
    assert [r["accepted"] for r in scan.capped(items, ["m"], "pos", "size", 100).orderBy("pos").collect()] == [True, False, True, True, False]


def test_main_languages(spark):
    m = spark.createDataFrame([(1, "python", 0), (1, "java", 1), (1, None, 2)], "p int, language string, position int")
    assert rows(scan.first_main_language(m, ["p"])) == [(1, "python")]
    assert rows(scan.main_language(spark.createDataFrame([("python", 2), ("java", 2)], "language string, files long"))) == [("java",)]


def test_line_windows(spark):
    f = spark.createDataFrame([(1, "a.py", "\n".join(map(str, range(11)))), (2, "b.py", ""), (3, "c.py", "x\n")], "file_id long, path string, text string")
    out = rows(chunking.line_windows(f, "file_id", "path", "text", 5, 1).select("file_id", "part", "start_line", "end_line"), "file_id", "part")
    assert out == [(1, 1, 1, 5), (1, 2, 5, 9), (1, 3, 9, 11), (3, 1, 1, 1)]


PYTHON = "import os\n\nclass Service(Base):\n    def review(self, value):\n        return audit.check(value)\n"
JAVA = "import java.util.List;\npublic class Service extends Base implements Runnable {\n  // a { comment\n  public void run() {\n    audit.check(\"}\");\n  }\n}\n"


def test_python_parser():
    found = chunking.parse_source("a.py", "python", PYTHON)
    assert [(r["symbol_type"], r["qualified_name"], r["start_line"], r["end_line"]) for r in found if r["kind"] == "chunk"] == [("class", "Service", 3, 5), ("method", "Service.review", 4, 5)]
    assert found[1]["signature"] == "def review(self, value)"
    assert [(r["source"], r["target"], r["relation"]) for r in found if r["kind"] == "reference"] == [("<module>", "os", "import"), ("Service", "Base", "extend"), ("Service.review", "audit.check", "call")]


def test_java_parser():
    found = chunking.parse_source("A.java", "java", JAVA)
    assert [(r["symbol_type"], r["qualified_name"]) for r in found if r["kind"] == "chunk"] == [("class", "Service"), ("method", "Service.run")]
    refs = {(r["source"], r["target"], r["relation"]) for r in found if r["kind"] == "reference"}
    assert {("Service", "Base", "extend"), ("Service", "Runnable", "implement"), ("Service.run", "audit.check", "call")} <= refs
    two = chunking.parse_source("B.java", "java", "interface A extends B, C {}\n")
    assert [(r["target"], r["relation"]) for r in two if r["kind"] == "reference"] == [("B", "extend"), ("C", "extend")]


def test_parser_falls_back_to_windows_and_to_the_module(spark):
    broken = chunking.parse_source("a.py", "python", "def f(:\n" * 9, 5, 1)
    assert [(r["symbol_type"], r["start_line"], r["end_line"], r["confidence"]) for r in broken] == [("line_window", 1, 5, 0.35), ("line_window", 5, 9, 0.35)]
    assert chunking.parse_source("x.py", "python", "a = 1\n")[0]["symbol_type"] == "module"
    assert chunking.parse_source("x.py", "python", "  \n") == []
    long = chunking.parse_source("y.py", "python", "def f():\n" + "    pass\n" * 10, 5, 1)
    assert [(r["split_part"], r["start_line"], r["end_line"]) for r in long] == [(1, 1, 5), (2, 5, 9), (3, 9, 11)]
    assert chunking.detect("a/B.PY") == "python" and chunking.detect("x.pyi") == "python" and chunking.detect("x.go") is None
    f = spark.createDataFrame([(1, "a.py", "python", PYTHON)], "file_id long, path string, language string, text string")
    parsed = chunking.parsed(f)
    symbols = chunking.symbols_of(parsed).withColumn("symbol_id", F.col("start_line").cast("long"))
    refs = indexing.resolved(parsed.where("kind = 'reference'").select("file_id", "source", "target", "relation", "confidence"), symbols)
    assert rows(refs.select("source", "target", "resolution"), "source") == [("Service", "Base", "external"), ("Service.review", "audit.check", "external")]


def test_index_reuse_and_currency(spark):
    chunks = spark.createDataFrame([(1, "h1"), (2, "h2")], "chunk_id long, hash string")
    old = spark.createDataFrame([(7, "h1", [1.0]), (5, "h1", [2.0])], "chunk_id long, hash string, embedding array<double>")
    out = indexing.reuse(chunks, old, ["hash"])
    assert rows(out.select("chunk_id", "reused_from", "embedding"), "chunk_id") == [(1, 5, [2.0]), (2, None, None)]
    assert rows(indexing.build_result(out)) == [(2, 1, 1, 1)]
    facts = "file_id long, chunk_fingerprint string, content_hash string, version string"
    parsed = spark.createDataFrame([(1, "a", "h", "1"), (2, "b", "h", "2"), (3, "c", "h", "1")], facts)
    have = spark.createDataFrame([(1, "a", "h", "1"), (2, "b", "h", "1"), (3, "c", "h", "1"), (3, "d", "h", "1")], facts)
    assert rows(indexing.current_files(parsed, have), "file_id") == [(1, True), (2, False), (3, False)]


def test_symbols(spark):
    symbols = spark.createDataFrame([(1, 10, "f", "A.f"), (1, 11, "f", "B.f"), (2, 12, "g", "g")], "file_id long, symbol_id long, symbol_name string, qualified_name string")
    refs = spark.createDataFrame([(1, "A.f", "f", "call", 0.7), (1, "<module>", "f", "import", 0.9), (2, "g", "f", "call", 0.7)], "file_id long, source string, target string, relation string, confidence double")
    assert rows(indexing.resolved(refs, symbols).select("source_symbol", "target_symbol", "resolution"), "source_symbol") == [(10, 11, "resolved"), (12, None, "external")]
    relations = spark.createDataFrame([(10, 12), (12, 11)], "source_symbol long, target_symbol long")
    assert rows(indexing.without_file(relations, symbols, spark.createDataFrame([(1,)], "file_id long")).select("source_symbol", "target_symbol")) == [(12, None)]
    items = spark.createDataFrame([(1, 1, 5, 6), (1, 2, 50, 51)], "file_id long, item_id long, start int, end int")
    definitions = spark.createDataFrame([(1, 100, 0, 20), (1, 101, 4, 8)], "file_id long, def_id long, start int, end int")
    assert rows(indexing.owning_interval(items, definitions).select("item_id", "owner"), "item_id") == [(1, 101), (2, None)]


def ranked(spark, ids):
    return spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "query_id int, file_id long, rank int")


def test_fusion_order_and_ties(spark):
    order = lambda v, k, top=10: [r["file_id"] for r in search.fused(ranked(spark, v), ranked(spark, k), top).where("selected").orderBy("rank").collect()]
    assert order([1, 2, 3], [2, 3, 1]) == [2, 1, 3]
    assert order([4, 5], []) == [4, 5] and order([], []) == [] and len(order(range(9), [], 5)) == 5
    assert order([8], [3]) == [8, 3]


CHUNK = "file_id long, project string, language string, path string, index_status string, search_text string, symbol_name string, qualified_name string"


def _store(spark):
    chunks = spark.createDataFrame(
        [
            (1, "p", "java", "src/a", "ready", "find the user", "Find", None), (2, "p", "java", "src/b", "ready", "100% sure", "Zeta", "a.Zeta"), (3, "other", "java", "src/c", "ready", "user user", "Zeta", None),
            (4, "p", "java", "src/d", "pending", "user", "Zeta", None), (5, "p", "go", "src/e", "ready", "user", "Zeta", None), (6, "p", "java", "lib/f", "ready", "user", "Zeta", None),
        ],
        CHUNK,
    )
    vectors = chunks.select("file_id", "project", "language", "path", "index_status", F.when(F.col("file_id") != 2, F.array(F.lit(1.0), F.col("file_id").cast("double"))).otherwise(F.array(F.lit(0.0), F.lit(0.0))).alias("embedding"), F.lit("ready").alias("embedding_status"))
    queries = [(1, " user ", "p", [1.0, 0.0]), (2, "zeta", "p", None), (3, "nothing", "p", None), (4, "   ", "p", [1.0, 0.0]), (5, "user", "none", [1.0, 0.0])]
    return chunks, vectors, spark.createDataFrame(queries, "query_id int, query string, project string, vector array<double>")


def test_retrieval_filters_and_degrades(spark):
    chunks, vectors, queries = _store(spark)
    found = search.retrieve(chunks, vectors, queries, 10, ("java",), ("src",))
    assert [tuple(r) for r in found.candidates.select("query_id", "file_id").orderBy("query_id", "rank").collect()] == [(1, 1), (1, 2), (2, 2)]
    assert rows(found.codes, "query_id") == [(1, ""), (2, "embedding_failed|symbol_ilike_fallback"), (3, "embedding_failed|symbol_ilike_no_match"), (5, "symbol_ilike_no_match")]
    assert [tuple(r) for r in search.trace(queries, found.candidates).where("query_id = 3").select("file_id", "rrf_score", "selected").collect()] == [(None, None, False)]
    everywhere = search.retrieve(chunks, vectors, queries.drop("project"), 10).candidates.where("query_id = 1 and keyword_rank is not null")
    assert {r["file_id"] for r in everywhere.collect()} == {1, 3, 5, 6}
    for wrong in (0, 31):
        with pytest.raises(ValueError):
            search.retrieve(chunks, vectors, queries, wrong)


def test_searches_that_fail_are_left_out(spark):
    chunks, vectors, queries = _store(spark)

    def fails(chunks, queries):
        raise SearchFailed

    out = search.retrieve(chunks, vectors, queries, 10, ("java",), ("src",), vector=fails, keyword=fails, symbol=fails)
    assert out.candidates.count() == 0
    assert rows(out.codes, "query_id")[:2] == [(1, "vector_search_failed|keyword_search_failed|symbol_search_failed"), (2, "embedding_failed|keyword_search_failed|symbol_search_failed")]
    out = search.retrieve(chunks, vectors, queries, 10, ("java",), ("src",), keyword=fails)
    assert rows(out.codes, "query_id")[0] == (1, "keyword_search_failed") and out.candidates.where("query_id = 1").count() == 2

    def bug(chunks, queries):
        raise KeyError("a bug")

    with pytest.raises(KeyError):
        search.retrieve(chunks, vectors, queries, 10, vector=bug)


def test_words_that_all_must_stand(spark):
    chunks, _, _ = _store(spark)
    queries = spark.createDataFrame([(1, "USER the"), (2, "user sure"), (3, "100%"), (4, "10_%")], "query_id int, query string")
    assert rows(search.keyword_all_terms(chunks, queries).select("query_id", "file_id"), "query_id") == [(1, 1), (3, 2)]
    assert rows(search.bm25(chunks, queries).select("query_id", "file_id"), "query_id") == [(1, 1), (3, 2)]
    assert rows(search.keyword_fallback(chunks, queries).where("query_id > 2").select("query_id", "file_id"), "query_id") == [(3, 2), (4, 2)]  # wildcards


def test_vector_search_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "BLOCK", 3)
    rng = np.random.default_rng(2)
    m = rng.integers(-3, 4, (60, 5)).astype(float)
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)], "file_id long, embedding array<float>").repartition(5)
    asked = df.where("file_id % 7 = 0").select(F.col("file_id").alias("query_id"), F.col("embedding").alias("vector"))
    norm = np.sqrt((m * m).sum(1))
    want = []
    for q in range(0, 60, 7):
        s = [round(float(m[q] @ m[k] / (norm[q] * norm[k])) if norm[q] * norm[k] else 0.0, 9) for k in range(60)]
        want += [(q, k, r + 1) for r, k in enumerate(sorted(range(60), key=lambda k: (-s[k], k))[:8])]
    assert sorted(tuple(r) for r in search.vector_search(df, asked, 8).select("query_id", "file_id", "rank").collect()) == sorted(want)
    assert search.vector_search(df, asked.limit(0), 8).count() == 0


def test_embedded_queries_are_asked_for_twice(spark):
    calls = []

    def provider(texts):
        calls.append(texts[0])
        if texts[0] == "down" or calls.count(texts[0]) == 1 and texts[0] == "late":
            raise ProviderError
        return [(0, [1.0, 2.0] if texts[0] != "short" else [1.0])]

    q = spark.createDataFrame([(1, " ok "), (2, "down"), (3, "late"), (4, "short"), (5, " ")], "query_id int, query string").coalesce(1)
    assert [r["vector"] for r in search.embedded(q, provider, 2).orderBy("query_id").collect()] == [[1.0, 2.0], None, [1.0, 2.0], None, None]


def test_answers_as_json():
    from siftwork.operators.models import structured

    assert structured('a ```json\n{"k": 1}\n``` b', ["k"]) == structured('x [{"k": 1}] y', ["k"]) == {"k": 1}  # braces before brackets
    assert structured('{"k": 1}}', ["k"]) is None and structured("", ["k"]) is None and structured('```\n{"k": 2}\n```', ["k"]) == {"k": 2}


def test_recursion_limit_keeps_what_is_done(spark):
    tasks = spark.createDataFrame([(1,)], "task_id long")
    items = spark.createDataFrame([(1, 5, 1, 50, "q", ["w"], [], ["a/b"])], "task_id long, item_id long, position int, top_k int, query string, keywords array<string>, risk_focus array<string>, target_paths array<string>")
    told = []
    nodes = workflow.Nodes(
        lambda t: items, lambda i, attempt: i.withColumns({"context": F.col("query"), "sufficient": F.lit(True)}), lambda c, k, failed: c.select("task_id", "item_id", F.lit("f").alias("fingerprint"), F.lit("p").alias("path"), F.lit("r").alias("rule_id")),
        lambda found: found.withColumn("evidence_status", F.lit("passed")), lambda found, k: found.select("fingerprint", F.lit(1).alias("pos"), F.lit("fail").alias("decision"), F.lit("no").alias("reason")), recorder=lambda name, rows: told.append(name),
    )
    whole = workflow.run_review(tasks, nodes)
    assert whole.status == "success" and told[:3] == ["guard", "planner", "retrieve"] and whole.steps == len(told) == 13
    assert [[r["outcome"] for r in x.collect()] for x in whole.issues] == [[], [], [], ["rejected"]]
    for limit in range(13):
        out = workflow.run_review(tasks, nodes, limit=limit)
        assert out.partial and out.stop_reason == "graph_recursion_limit_exceeded" and out.steps == limit


def test_items_are_retried_without_a_join(spark):
    items = spark.range(12).selectExpr("1L AS task_id", "id AS item_id", "int(id) AS position", "5 AS top_k", "concat('q', id) AS query", "array('w') AS keywords", "array('f') AS risk_focus", "array('a/b/') AS target_paths")
    asked = []

    def retrieve(rows, attempt):
        asked.append(rows)
        return rows.withColumns({"context": F.col("query"), "sufficient": F.col("item_id") % 4 <= attempt})

    nodes = workflow.Nodes(lambda t: items, retrieve, lambda c, k, failed: c.selectExpr("task_id", "item_id", "string(item_id) AS fingerprint", "'p' AS path", "'r' AS rule_id"), lambda found: found.withColumn("evidence_status", F.lit("passed")), lambda found, k: found.selectExpr("fingerprint", "1 AS pos", "'pass' AS decision", "'' AS reason"))
    out = workflow.run_review(spark.createDataFrame([(1,)], "task_id long"), nodes)
    assert [r["item_id"] for r in out.warnings[0].orderBy("item_id").collect()] == [3, 7]
    assert [sorted({(r["query"], r["top_k"]) for r in x.collect()}) for x in asked[1:]] == [[("w f", 5)], [("w f", 10)]] and asked[2].count() == 4
    assert "Join" not in asked[2]._jdf.queryExecution().optimizedPlan().toString()


def test_recall(spark):
    out = lambda e, r, k: spark.range(1).select(search.recall_at_k(F.array(*map(F.lit, e)) if e else F.array().cast("array<int>"), F.array(*map(F.lit, r)), k)).first()[0]
    assert out([1, 2], [3, 2, 4], 2) == 0.5 and out([], [1], 1) == 1.0
    with pytest.raises(ValueError):
        out([1], [1], 0)
    hits = spark.createDataFrame([(1, 1, None), (1, 2, "a"), (1, 3, "a"), (1, 4, "b")], "q int, rank int, hit string")
    assert [r["recall"] for r in search.running_recall(hits, F.lit(4), "q", "rank", "hit").orderBy("rank").collect()] == [0.0, 0.25, 0.25, 0.5]


def test_context(spark):
    chunks = spark.createDataFrame([(1, "a.py", "body")], "chunk_id long, path string, content string")
    symbols = spark.createDataFrame([(1, 10, "f", "A.f"), (2, 11, "g", None)], "chunk_id long, symbol_id long, symbol_name string, qualified_name string")
    relations = spark.createDataFrame([(10, 11, "g", "call"), (10, None, "os", "import")], "source_symbol long, target_symbol long, target string, relation string")
    out = context.related(chunks, symbols, relations)
    block = out.select(context.block_text(F.col("path"), F.lit(1), F.lit(2), F.lit("f"), F.col("related"), F.col("content"))).first()[0]
    assert block == "### a.py:1-2\nsymbol: f\nrelated: call g, import os\nbody"
    items = spark.createDataFrame([(1, k, t) for k, t in enumerate([60, 50, 30, 10, 5], 1)], "q int, rank int, tokens long")
    kept = context.within_budget(items, "q", "rank", "tokens", 100)
    assert [r["rank"] for r in kept.where("kept").orderBy("rank").collect()] == [1, 3, 4]
    assert [r["used"] for r in kept.orderBy("rank").collect()] == [60, 60, 90, 100, 100]


def test_evidence(spark):
    files = spark.createDataFrame([("p", "a.py", "x = 1\r\n  y = 2\n")], "project string, path string, text string")
    chunks = spark.createDataFrame([("p", 1)], "project string, chunk_id long")
    issues = spark.createDataFrame(
        [(1, "p", "a.py", 2, 2, " y = 2", [1]), (2, "p", "b.py", 1, 1, "x", [1]), (3, "p", "a.py", 2, 9, "y", [1]), (4, "p", "a.py", 1, 1, " ", [1]), (5, "p", "a.py", 1, 1, "x", []), (6, "p", "a.py", 2, 2, "y  = 2", [1]), (7, "p", "a.py", 1, 1, "x", [1, 9])],
        "issue_id long, project string, path string, start_line int, end_line int, evidence string, source_chunk_ids array<long>",
    )
    assert [r[0] for r in review.verified(issues, files, chunks).orderBy("issue_id").select("evidence_status").collect()] == ["passed"] + ["failed"] * 6


def test_critic(spark):
    issues = spark.createDataFrame([(k, f) for k, f in enumerate("abcd")], "issue_id long, fingerprint string")
    decisions = spark.createDataFrame([("a", 0, "fail", "x"), ("a", 1, "pass", "y"), ("b", 2, "uncertain", "z"), ("c", 3, "fail", "w")], "fingerprint string, pos long, decision string, reason string")
    out = rows(review.merged(issues, decisions, 1, 2).select("decision", "reason", "outcome", "needs_human_review"), "issue_id")
    assert out == [("pass", "y", "verified", False), ("uncertain", "z", "verified", True), ("fail", "w", "retry", False), ("fail", "missing_critic_decision", "retry", False)]
    assert {r[0] for r in review.merged(issues, decisions, 2, 2).where("decision = 'fail'").select("outcome").collect()} == {"rejected"}


def test_duplicates(spark):
    shape = "t int, fingerprint string, pos long, v string"
    old, new = spark.createDataFrame([(1, "a", 0, "x"), (1, "", 1, "e1"), (1, "", 2, "e2")], shape), spark.createDataFrame([(1, "a", 0, "y"), (1, "", 1, "gone"), (1, "b", 2, "z")], shape)
    assert rows(review.last_of_each(old, new, ["t"]).select("fingerprint", "v", "place"), "fingerprint") == [("", "e2", 1), ("a", "y", 0), ("b", "z", 2)]
    assert rows(review.first_of_each(old.union(new), ["t"], [F.col("pos"), F.col("v")]).select("fingerprint", "v"), "fingerprint") == [("a", "x"), ("b", "z")]


def test_statistics(spark):
    issues = spark.createDataFrame([("High", "security"), ("Odd", None), (None, "quality")], "risk_level string, category string")
    assert rows(review.severity_stats(issues)) == [(1, 0, 1, 3)]
    assert rows(review.category_histogram(issues), "category") == [("quality", 1), ("security", 1), ("unknown", 1)]


def test_usage(spark):
    runs = spark.createDataFrame(
        [(1, 1, "llm", "success", 10, 5, 2, "0.1"), (2, 1, "embedding", "success", 7, 9, None, None), (3, 1, "llm", "failed", 99, 99, 9, "9")],
        "run_id long, task_id long, node_type string, status string, input_tokens long, output_tokens long, model_call_count long, price string",
    ).withColumn("cost", F.col("price").cast("decimal(12,6)"))
    out = usage.totals(runs, ["task_id"]).select("calls", "input_tokens", "output_tokens", F.col("cost").cast("double"), "cost_status")
    assert rows(out) == [(3, 17, 5, 0.1, "partial")]
    assert rows(usage.running(runs, "task_id", "run_id", 3, 1000).select("calls", "tokens", "cost_status", "stop"), "run_id") == [(2, 15, "available", None), (3, 31, "partial", "max_calls")]
    trials = spark.createDataFrame([("v", 10 * k, 100 + 20 * (k - 1), 1, 0.1 + 0.02 * (k - 1), "USD") for k in range(1, 7)], "v string, latency_ms long, input_tokens long, output_tokens long, cost double, currency string")
    t = usage.telemetry(trials, ["v"]).first()
    assert t["p95_latency_ms"] == 60 and t["mean_input_tokens"] == 150 and round(t["mean_cost"], 9) == 0.15 and t["one_currency"]


def test_workflow(spark):
    shape = "issue_id long, fingerprint string, path string, rule_id string, round int"
    issues = spark.createDataFrame([(1, "a", "p", "r1", 1), (2, "b", "p", "r2", 1), (3, "c", "p", "r1", 2), (4, "d", "p", "r3", 2)], shape)
    decisions = spark.createDataFrame([("a", 1, 0, "fail", "x"), ("b", 1, 1, "pass", "x"), ("c", 2, 2, "fail", "x")], "fingerprint string, round int, pos long, decision string, reason string")
    assert rows(workflow.review_rounds(issues, decisions).select("issue_id", "outcome"), "issue_id") == [(2, "verified"), (3, "rejected")]
    items = spark.createDataFrame([(1, k, 99 if k else 0) for k in range(12)], "task_id long, position int, top_k int")
    planned = workflow.plan_items(items)
    assert planned.count() == 10 and {r[0] for r in planned.select("top_k").collect()} == {1, 30}
    stop = spark.range(1).select(workflow.budget_stop(F.lit(False), F.lit(None).cast("string"), F.lit(3), 3, F.lit(0), 9)).first()[0]
    assert stop == "max_calls"


@pytest.mark.parametrize(
    ("kind", "schema", "good", "bad"),
    [
        ("chunks", "start_line int, end_line int, parse_confidence double, embedding_status string, index_status string", (1, 1, 1.0, "keyword_only", None), (0, -1, 1.5, "keyword", "done")),
        ("relations", "confidence double, relation_type string, resolution_status string", (0.0, "extend", "external"), (-0.1, "use", "open")),
        ("issues", "start_line int, end_line int, category string, cwe_id string, confidence double, risk_level string", (3, 4, "security", "CWE-1", 0.5, "Low"), (3, 2, "quality", "", 2.0, "low")),
        ("tasks", "progress int, llm_call_count int, input_tokens int, output_tokens int, cost_status string", (100, 0, 0, 0, "partial"), (101, -1, -1, -1, "free")),
        ("events", "progress int", (None,), (-1,)),
        ("parsed_chunks", "path string, language string, start_line int, end_line int, content string, confidence double", ("a.py", "python", 1, 1, "x", 1.0), ("", "python", None, 1, None, 1.1)),
        ("parsed_references", "source string, target string, path string, confidence double", ("a", "b", "a.py", 1.0), ("a", None, "a.py", -1.0)),
    ],
)
def test_rules_of_records(spark, kind, schema, good, bad):
    rules = review.RULES[kind]()
    told = {r["rule"]: r["violations"] for r in review.violations(spark.createDataFrame([good, bad, good], schema), rules).collect()}
    assert told == {n: 0 if (kind, n) == ("issues", "security_cwe") else 1 for n in rules}
    if kind == "issues":
        none = spark.createDataFrame([(1, 1, "security", None, 0.5, "Low"), (1, 1, "security", "", 0.5, "Low"), (1, 1, "bug", None, 0.5, "Low")], schema)
        assert {r["rule"]: r["violations"] for r in review.violations(none, rules).collect()}["security_cwe"] == 2


def test_source_too_nested_for_the_parser_falls_back():
    out = chunking.parse_source("a.py", "python", "not " * 20000 + "x\n")
    assert [(r["symbol_type"], r["error"]) for r in out] == [("line_window", "SYNTAX_ERROR")]


def test_writers(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert rows(readers.replaced(old, new, ["k"]), "k") == [(1, "a"), (2, "c"), (3, "d")]
    again = spark.createDataFrame([(None, "x"), (1, "y"), (4, "z"), (4, "y2")], "k long, v string")
    assert rows(readers.appended_once(old.union(spark.createDataFrame([(None, "n")], "k long, v string")), again, ["k"], "v")) == [(4, "y2")]
    runs = "task_id long, run_key string, status string, attempt int"
    have = spark.createDataFrame([(1, "a", "success", 1), (1, "b", "failed", 1)], runs)
    more = spark.createDataFrame([(1, "a", "failed", 1), (1, "b", "success", 1), (1, "c", "success", 1)], runs)
    assert rows(readers.recorded_runs(have, more).select("run_key", "status", "attempt"), "run_key") == [("a", "success", 1), ("b", "success", 2), ("c", "success", 1)]


def test_embedding_batches(spark):
    chunks = spark.createDataFrame([(k, f"t{k}") for k in range(23)], "chunk_id long, content string").coalesce(1)

    def provider(texts):
        if "t5" in texts:
            raise ProviderError("down")
        return list(reversed(readers.hash_provider(texts)))

    out = readers.batched_embeddings(chunks, provider).orderBy("chunk_id").collect()
    assert [r["embedding"] is None for r in out] == [k < 10 for k in range(23)]
    assert out[11]["embedding"] == pytest.approx(readers.hash_provider(["t10", "t11"])[1][1], abs=1e-6)


def test_readers(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    assert rows(readers.source_tree(spark, str(tmp_path)).select("path", "length")) == [("src/a.py", 6)]
    one = {"relative_path": "a", "language": "java", "category": "security", "fingerprint": "f"}
    (tmp_path / "list.json").write_text(json.dumps([one, one | {"start_line": 3}]))
    (tmp_path / "dict.json").write_text(json.dumps({"predictions": [one]}))
    assert rows(readers.predictions(spark, f"{tmp_path}/list.json").select("prediction_index", "start_line", "risk_level"), "prediction_index") == [(0, 0, "Medium"), (1, 3, "Medium")]
    assert readers.predictions(spark, f"{tmp_path}/dict.json").count() == 1 and readers.predictions(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "truth.json").write_text(json.dumps({"entries": [{"id": "g", "language": "java", "category": "security", "relative_path": "a", "cwe_id": "C"}]}))
    assert rows(readers.ground_truth(spark, f"{tmp_path}/truth.json").select("id", "sink_line", "vulnerable")) == [("g", 0, True)]
    with pytest.raises(Exception, match="(?i)path"):
        readers.ground_truth(spark, f"{tmp_path}/gone.json")
    manifest = {"schema_version": 1, "repetitions": 3, "languages": ["java"], "groups": [{"id": "g", "variants": [{"name": "v", "include_fingerprints": {"java": ["a", "b"]}}]}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert readers.manifest_variants(spark, f"{tmp_path}/m.json")[1].count() == 2
    for wrong in ({"schema_version": 2}, {"repetitions": 9}, {"groups": []}):
        (tmp_path / "m.json").write_text(json.dumps(manifest | wrong))
        with pytest.raises(ValueError):
            readers.manifest_variants(spark, f"{tmp_path}/m.json")


def test_search_text(spark):
    df = spark.createDataFrame([("a.b.findUser", "body")], "name string, content string")
    assert df.select(text.search_text([F.col("name"), F.lit(None).cast("string")], F.col("content"))).first()[0] == "a.b.findUser\na b find user\nbody"


def test_projections(spark, tmp_path):
    from siftwork.operators import projections

    raw = spark.createDataFrame([('"a"', 3, 1), ('["a", "b"]', 1, 2), (None, 1, 1)], "v string, s int, e int")
    out = raw.select(projections.as_list(F.col("v"), "string").alias("v"), projections.ordered_range(F.col("s"), F.col("e")).alias("r")).collect()
    assert [r["v"] for r in out] == [["a"], ["a", "b"], []] and [tuple(r["r"]) for r in out] == [(3, 3), (1, 2), (1, 1)]
    reports = spark.createDataFrame([(1, "# one")], "task_id long, markdown string")
    projections.exported(reports, "markdown", f"{tmp_path}/r")
    assert spark.read.text(f"{tmp_path}/r").first()["value"] == "# one"
    with pytest.raises(ValueError):
        projections.exported(reports, "pdf", f"{tmp_path}/r")


def test_model_calls(spark):
    from siftwork.operators import models

    def provider(prompt):
        if prompt == "down":
            raise ProviderError
        if prompt == "good":
            return 'Sure:\n```json\n{"k": 1}\n```', 5, 2
        return ('{"k": 2}' if "not valid" in prompt and prompt.startswith("mend") else '{"x": 0}'), 5, 2

    out = models.answered(spark.createDataFrame([(1, "good"), (2, "mend"), (3, "bad"), (4, "down")], "id long, prompt string"), provider, ["k"])
    assert rows(out, "id") == [(1, '{"k": 1}', 1, 5, 2, None), (2, '{"k": 2}', 2, 10, 4, None), (3, None, 2, 10, 4, "INVALID_ANSWER"), (4, None, 0, 0, 0, "PROVIDER_FAILED")]


def test_java_parser_knows_what_encloses_what():
    source = "class A {\n  interface B { void no(); }\n  A() { go(); }\n  void run() {\n    new R() { public void inner() { u.v(); } };\n    w();\n  }\n  int last();\n}\nclass C { void m() { x.y . z (1); } }\n"
    found = chunking.parse_source("A.java", "java", source)
    assert [r["qualified_name"] for r in found if r["kind"] == "chunk"] == ["A", "A.B", "A.B.no", "A.A", "A.run", "A.last", "C", "C.m"]
    assert [(r["source"], r["target"]) for r in found if r["relation"] == "call"] == [("A.A", "go"), ("A.run", "inner"), ("A.run", "u.v"), ("A.run", "w"), ("C.m", "x.y.z")]
    assert chunking.parse_source("A.java", "java", "class A { /* no end }")[0]["error"] == "SYNTAX_ERROR"


@pytest.mark.parametrize("piece", ["class A { public int m(int a) { return b.c(a); } }\n", "class a ", "/*", "a.", 'x """ \\" ', "f() ", "@A ", "a "])
def test_java_parser_takes_time_that_follows_the_file(piece):
    start = time.monotonic()
    chunking.parse_source("A.java", "java", piece * (600_000 // len(piece)))
    assert time.monotonic() - start < 15


def test_capped_streams_one_large_group(spark):
    items = spark.range(30000).select(F.lit("hot").alias("m"), F.col("id").alias("pos"), (F.col("id") * 7919 % 101).alias("size"), F.lit("x").alias("more")).union(
        spark.createDataFrame([("b", 1, 5, "y"), ("b", 2, None, "y"), (None, 1, 3, "z")], "m string, pos long, size long, more string")
    )
    got, used, want = scan.capped(items, ["m"], "pos", "size", 20000).collect(), 0, {}
    for k in range(30000):
        want[k] = used + k * 7919 % 101 <= 20000
        used += k * 7919 % 101 if want[k] else 0
    assert {r["pos"]: r["accepted"] for r in got if r["m"] == "hot"} == want and len(got) == 30003
    assert sorted((str(r["m"]), r["pos"], r["accepted"]) for r in got if r["m"] != "hot") == [("None", 1, True), ("b", 1, True), ("b", 2, None)]
    assert scan.capped(items.where("false"), ["m"], "pos", "size", 1).count() == 0


def test_issues_are_numbered_once_each_in_one_shuffle(spark):
    given = [(1, True, 5, "a"), (1, True, 5, "a"), (1, True, 3, "b"), (1, False, 4, "c"), (1, None, 1, "d"), (1, None, 1, "d"), (2, True, 9, None), (2, True, 9, None), (None, True, 1, "e")]
    issues = spark.createDataFrame(given, "task_id int, verified boolean, pos int, title string")
    out = review.numbered(issues, "task_id", ["pos", "title"])
    assert sorted(map(tuple, out.collect()), key=str) == [(1, False, 4, "c", 1), (1, None, 1, "d", 1), (1, True, 3, "b", 1), (1, True, 5, "a", 2), (2, True, 9, None, 1)]
    both = out.where("verified is not null").unionByName(out.where("number > 0"))
    assert both.count() == 9
    plan = out.groupBy("task_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_report_of_one_task_with_most_issues_stays_in_parts(spark):
    n = 20000
    issue = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(2).cast("long").alias("task_id"), F.col("id").alias("pos"), F.when(F.col("id") % 5 == 4, None).otherwise(F.col("id") % 5 < 3).alias("verified"),
        F.lit("High").alias("risk_level"), F.lit("bug").alias("category"), *[F.lit("t").alias(c) for c in ("title", "issue_type", "rule_id", "cwe_id", "path", "critic_decision", "description", "evidence", "reason", "suggestion")],
        F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit(0.5).alias("confidence"), F.lit(False).alias("needs_human_review"),
    )
    tasks = spark.createDataFrame([(2,), (3,)], "task_id long").selectExpr(
        "task_id", "'P' AS project", "timestamp '2024-01-01 00:00:00' AS generated_at", "'' AS summary", "string(null) AS stop_reason", "1 AS plan_items", "map('a', 'b') AS degradation", "1 AS calls", "1 AS input_tokens",
        "1 AS output_tokens", "decimal(1.5) AS cost", "'available' AS cost_status", "timestamp(null) AS started_at", "timestamp(null) AS finished_at",
    )
    parts = review.report_parts(tasks, issue).cache()
    per = {(r["task_id"], r["section"]): (r["n"], r["top"], r["longest"]) for r in parts.groupBy("task_id", "section").agg(F.count("*").alias("n"), F.max("number").alias("top"), F.max(F.length("text")).alias("longest")).collect()}
    good = sum(k % 3 != 0 and k % 5 < 3 for k in range(n))
    assert per[2, 8][:2] == (good + 1, good) and max(x[2] for x in per.values()) < 1000
    assert {s for t, s in per if t == 3} == {0, 1, 4, 6, 7, 10} and not [t for t, _ in per if t == 1]
    whole = review.report_markdown(tasks, issue).where("task_id = 3").first()["markdown"]
    assert whole == "\n\n".join(r["text"] for r in parts.where("task_id = 3").orderBy("section").collect()) + "\n"
    parts.unpersist()
