"""The vector index against exact search: recall, filters, queries of any number, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators import search, vector_index
from siftwork.sources.shared import shared_folder


def table(spark, rows):
    return spark.createDataFrame(rows, "file_id long, project string, language string, embedding array<float>")


def clustered(n=3000, seed=1, dimension=24):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(30, dimension)) * 3
    at = rng.integers(30, size=n)
    at[: n // 3] = 0  # one cell holds a third of all rows
    return [(k, f"p{k % 3}", ["en", "fr", None, "de"][k % 4], (centers[at[k]] + rng.normal(size=dimension)).tolist()) for k in range(n)]


@pytest.fixture(scope="module")
def built(spark):
    rows = clustered()
    path = shared_folder(spark, "index")
    vector_index.build(table(spark, rows), path)
    return rows, vector_index.opened(spark, path)


def hits(exact, found):
    told = [{(r["query_id"], r["file_id"]) for r in df.collect()} for df in (exact, found)]
    return len(told[0] & told[1]) / len(told[0])


def test_recall_and_cells(spark, built):
    rows, index = built
    asked = table(spark, rows).where("file_id % 20 = 0").select(F.col("file_id").alias("query_id"), F.col("embedding").alias("vector"))
    found, cost = index.searched(index.rows(), asked, 10)
    assert hits(search.vector_search(table(spark, rows), asked, 10), found) >= 0.9
    assert index.rows().count() == len(rows) and int(index.model.sizes.sum()) == len(rows)
    told = cost.agg(F.avg("cells").alias("cells"), F.max("rows").alias("rows")).first()
    assert told["cells"] < len(index.model.sizes) / 2 and told["rows"] < len(rows)


def test_filters_lose_nothing(spark, built):
    """A filter that leaves fewer rows than are asked for gives all of them, in exact order."""
    rows, index = built
    asked = spark.createDataFrame([(k, f"p{k % 3}", rows[k][3]) for k in range(0, 3000, 300)], "query_id long, project string, vector array<float>")
    for condition in ("language = 'fr' AND file_id < 900", "language = 'de'", "file_id < 0"):
        exact = search.vector_search(table(spark, rows).where(condition), asked, 12).collect()
        found = index.search(index.rows().where(condition), asked, 12).collect()
        want, got = ({(r["query_id"], r["rank"]): (r["file_id"], round(r["score"], 5)) for r in x} for x in (exact, found))
        if condition == "language = 'de'":
            assert len(got) == len(want) == 120 and sum(got[k] == want[k] for k in want) >= 100
        else:
            assert got == want


def test_cells_and_filters_reach_the_files(built):
    _, index = built
    plan = index.rows().where("cell IN (1, 2) AND language = 'en'").select("file_id", "code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "EqualTo(language,en)" in plan and "embedding" not in plan


def test_edges(spark, monkeypatch):
    rows = [(1, "a", "x", [1.0, 0.0, 0.0]), (2, "a", "x", [0.0, 0.0, 0.0]), (3, None, "x", [1.0, 0.0, 0.0]), (4, "a", "x", None), (5, "a", "x", [1.0, 0.0, 0.0]), (6, "a", "x", [-1.0, 0.5, 0.0])]
    index = vector_index.build(table(spark, rows), shared_folder(spark, "index"), cells=3)
    asked = [(1, "a", [2.0, 0.0, 0.0]), (2, "", [1.0, 0.0, 0.0]), (3, "nowhere", [1.0, 0.0, 0.0]), (4, "a", None), (5, "a", [0.0, 0.0, 0.0])]
    queries = spark.createDataFrame(asked, "query_id long, project string, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["file_id"], round(r["score"], 4)) for r in index.search(index.rows(), queries, 3).collect())
    assert got == [(1, 1, 1, 1.0), (1, 2, 5, 1.0), (1, 3, 2, 0.0), (2, 1, 3, 1.0), (5, 1, 1, 0.0), (5, 2, 2, 0.0), (5, 3, 5, 0.0)]
    monkeypatch.setattr(vector_index, "BLOCK", 2)
    assert sorted((r["query_id"], r["rank"], r["file_id"], round(r["score"], 4)) for r in index.search(index.rows(), queries, 3).collect()) == got
    assert index.search(index.rows(), queries.where("query_id > 9")).collect() == []
    with pytest.raises(ValueError):
        index.search(index.rows(), spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"))
    with pytest.raises(ValueError):
        vector_index.build(table(spark, []), shared_folder(spark, "index"))


def test_exact_misses_nothing(spark, monkeypatch):
    """Vectors without clusters, many copies of some, few cells asked first: the exact search gives what brute force gives."""
    rng = np.random.default_rng(3)
    plain = rng.normal(size=(1500, 24))
    plain[:700] = plain[0]
    rows = [(k, f"p{k % 2}", ["en", "fr"][k % 2 ^ k % 3 % 2], plain[k].tolist()) for k in range(1500)]
    index = vector_index.build(table(spark, rows), shared_folder(spark, "index"))
    index.model.probes, index.ef = 1, 15
    asked = spark.createDataFrame([(k, f"p{k % 2}", plain[k].tolist()) for k in (0, 1, 7, 801, 903, 1204, 1499)] + [(9999, "p0", [0.0] * 24)], "query_id long, project string, vector array<double>")
    for condition in ("true", "language = 'fr'", "file_id > 1400"):
        exact = search.vector_search(table(spark, rows).where(condition), asked, 12).collect()
        found = index.exact(index.rows().where(condition), asked, 12).collect()
        told = [{(r["query_id"], r["rank"]): (r["file_id"], round(r["score"], 5)) for r in x} for x in (exact, found)]
        assert told[0] == told[1]


def test_best_of_copies_are_the_first_ids():
    """What a task keeps of equal scores is the smallest ids, and it keeps no more than it gives."""
    best = search.Best(2, 3)
    best._room = 8
    for k in range(40, 0, -1):
        best.put(np.array([0, 1]), np.array([k, k]), np.array([0.5, k / 100]))
        assert best._rows <= 18
    query, file, _ = best.cut()
    assert list(zip(query, file, strict=True)) == [(0, 1), (0, 2), (0, 3), (1, 40), (1, 39), (1, 38)]
