import ast
import os
import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from siftwork.operators import chunking
from siftwork.plans import registry
from siftwork.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, float):
        return f"{value:.6g}"
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    return str(value.item() if hasattr(value, "item") else value)


def same_rows(left: pd.DataFrame, right: pd.DataFrame) -> bool:
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    key = lambda df: sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None)), key=repr)
    return key(left) == key(right)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        assert same_rows(got, db.sql(registry.ORACLE_SQL[name]).df())
    else:
        assert len(got.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_parsed_files_by_brute_force(spark, db):
    got: dict = {}
    for r in registry.QUERIES["parsed_files"](spark, SF).collect():
        got.setdefault(r["file_id"], []).append((r["symbol_type"], r["start_line"], r["end_line"], r["error"]))
    texts, fallen = db.sql("SELECT doc_id, lang, coalesce(text, '') AS text FROM documents").fetchall(), 0
    paths = {r["file_id"]: r["path"].lower() for r in tables.files(spark, SF).select("file_id", "path").collect()}
    for i, lang, said in texts:
        kind = "java" if paths[i].endswith(".java") else "python" if paths[i].endswith(".py") else lang
        if kind == "java":
            assert got[i] if said.strip() else True
            continue
        try:
            if kind == "python" and ast.parse(said):
                continue
        except (SyntaxError, ValueError):
            pass
        n, start, want = len(said.splitlines()), 0, []
        while n and (not want or want[-1][2] < n):
            want.append(("line_window", start + 1, min(start + chunking.MAX_LINES, n), "SYNTAX_ERROR" if kind == "python" else "NO_PARSER"))
            start += chunking.MAX_LINES - chunking.OVERLAP
        assert got[i] == (want or [(None, None, None, "EMPTY_SOURCE")])
        fallen += 1
    assert fallen > 20 and len(texts) >= 200


def _best(edges):
    """The size of a largest matching, by trying everything: small groups only."""
    if not edges:
        return 0
    left = edges[0][0]
    rest = [e for e in edges if e[0] != left]
    return max([_best(rest)] + [1 + _best([e for e in rest if e[1] != right]) for own, right in edges if own == left])


def test_matchings_by_brute_force(spark, tmp_path):
    """max_matching, prf1 and recall_at_k_prefix over a small table, against a matching found by trying everything."""
    rnd = random.Random(3)
    lines = [(o, rnd.randrange(200), rnd.randrange(60), n, "A", "F") for o in range(30) for n in range(1, 10) if rnd.random() < 0.8]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    pairs = con.execute(registry.ORACLE_SQL["interval_candidates"]).fetchall()
    predicted = con.execute(f"SELECT prediction_index, language, path, category, cwe_id, risk_level, row_number() OVER (PARTITION BY path, language ORDER BY prediction_index) - 1 FROM ({tables.PREDICTED_SQL})").fetchall()
    truth = dict(con.execute(f"SELECT language, count(*) FROM ({tables.TRUTH_SQL}) WHERE vulnerable GROUP BY 1").fetchall())
    key, place = {r[0]: r[1:5] for r in predicted}, {r[0]: r[6] for r in predicted}

    def best(most):
        groups: dict = {}
        for p, t, *_ in pairs:
            if place[p] < most:
                groups.setdefault(key[p][:3] + (key[p][3] if key[p][2] == "security" else "",), []).append((p, t))
        return {name: sum(_best(sorted(set(g))) for k, g in groups.items() if k[0] == name) for name in truth}

    found = registry.QUERIES["max_matching"](spark, str(tmp_path)).collect()
    chosen = [(r["prediction_index"], r["gt_id"]) for r in found]
    assert set(chosen) <= {(p, t) for p, t, *_ in pairs} and len({p for p, _ in chosen}) == len({t for _, t in chosen}) == len(chosen) == sum(best(99).values()) > 20
    scores = {r["language"]: r for r in registry.QUERIES["prf1"](spark, str(tmp_path)).collect()}
    for name, tp in best(99).items():
        n = sum(k[0] == name for k in key.values())
        r = scores[name]
        assert (r["tp"], r["fp"], r["fn"]) == (tp, n - tp, truth[name] - tp)
        assert (r["precision"], r["recall"], r["f1"]) == pytest.approx((tp / n, tp / truth[name], 2 * tp / (n + truth[name])))
    recalls = {(r["language"], r["k"]): r["recall"] for r in registry.QUERIES["recall_at_k_prefix"](spark, str(tmp_path)).collect()}
    assert recalls == {(name, k): pytest.approx(tp / truth[name]) for k in (1, 2, 5) for name, tp in best(k).items()}


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(registry.QUERIES) > 45


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
