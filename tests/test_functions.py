from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.functions import numbers, paths, text
from siftwork.sources import readers


def values(spark, column, *given, kind="string"):
    rows = spark.createDataFrame([(k, *g) for k, g in enumerate(given)], "k int, " + ", ".join(f"x{i} {t}" for i, t in enumerate(kind.split(";"))))
    return [r[0] for r in rows.orderBy("k").select(column).collect()]


def test_split_identifier(spark):
    assert values(spark, text.split_identifier(F.col("x0")), ("findUserByName",), ("HTTPServer",), ("user_repository",), ("",)) == ["find user by name", "http server", "user repository", ""]


def test_normalized_content_and_identity(spark):
    assert values(spark, text.normalize_content(F.col("x0")), ("a  \r\nb\t\n\n",), ("\u2003x\u2028",), ("",)) == ["a\nb", "x", ""]
    prints = values(spark, text.chunk_fingerprint(F.col("x0"), F.lit("f"), F.lit(1), F.lit(2), text.content_hash(F.col("x1"))), ("a.py", "x \n"), ("b.py", "x"), kind="string;string")
    assert prints[0] != prints[1]
    assert len(set(values(spark, text.content_hash(F.col("x0")), ("x \n",), ("x",)))) == 1


def test_line_counts_differ_on_a_last_line_break_and_other_breaks(spark):
    given = [("",), ("a",), ("a\n",), ("a\nb",), ("a\x0bb\x0cc\u2028d",), ("a\r\nb\r",)]
    assert values(spark, text.lines_scanned(F.col("x0")), *given) == [len(g[0].splitlines()) for g in given]
    assert values(spark, text.lines_cited(F.col("x0")), *given) == [g[0].count("\n") + (1 if g[0] else 0) for g in given]


def test_token_estimate(spark):
    assert values(spark, text.token_estimate(F.col("x0")), ("",), ("abcde",), ("é字",)) == [1, 2, 2]


def test_occurrence_rank(spark):
    assert values(spark, text.occurrence_rank(F.col("x0"), F.lit("ab")), ("ab ab",), ("x",)) == [0.02, 0.0]


def test_json_in_free_text(spark):
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    given = [('so\n```json\n{"k": 1}\n```',), ('x {"k": 2} y',), ("no",), ('{"j": 3}',), ('{"k": ',)]
    assert [r and r["k"] for r in values(spark, text.parsed_json(F.col("x0"), schema, ["k"]), *given)] == [1, 2, None, None, None]


def test_queries(spark):
    assert values(spark, text.normalize_query(F.col("x0"), F.col("x1")), ("A#b", "java"), ("a::b", "python"), ("a#b", "go"), kind="string;string") == ["A.b", "a.b", "a#b"]
    assert values(spark, text.query_hash(F.col("x0")), (" q ",), ("q",))[0] == values(spark, text.query_hash(F.col("x0")), ("q",))[0]
    assert values(spark, text.rewritten_query(F.array(F.lit("a"), F.lit("")), F.array(F.lit("b")), F.array(F.lit("why"))), ("",)) == ["a b\nwhy"]


@pytest.mark.parametrize(
    ("path", "size", "reason"),
    [("node_modules/tool.py", 1, "EXCLUDED_PATH"), ("src/generated.py", 1, "GENERATED_FILE"), ("src/client.min.java", 1, "GENERATED_FILE"), ("src/readme.md", 1, "UNSUPPORTED_FILE_TYPE"),
     ("src/large.py", (1 << 20) + 1, "SINGLE_FILE_SIZE_EXCEEDED"), ("src/service.py", 1 << 20, None), ("Build/x.py", 1, "EXCLUDED_PATH"), ("src/poetry.lock", 1, "LOCK_FILE"), ("build", 1, "UNSUPPORTED_FILE_TYPE"), (".py", 1, "UNSUPPORTED_FILE_TYPE")],
)
def test_exclusion_reasons(spark, path, size, reason):
    assert values(spark, paths.exclusion_reason(F.col("x0"), F.col("x1")), (path, size), kind="string;long") == [reason]


def test_priorities(spark):
    given = {"src/api/auth.py": "high", "src/domain/order.py": "medium", "tests/test_order.py": "low", "src/auth-helper.py": "high", "src/test_api.py": "low", "db/migrations/api/x.py": "low", "src/user_routes.py": "high"}
    assert values(spark, paths.priority_of(F.col("x0")), *[(p,) for p in given]) == list(given.values())


def test_unsafe_paths(spark):
    bad = ["../outside.py", "/absolute.py", "C:/windows.py", "src\\windows.py", "src//collapsed.py", "src/./collapsed.py", "src/con.py", "src/trailing.py ", "src/invalid?.py", "", "a/" + "x" * 256, "x." + "y" * 600]
    assert values(spark, paths.portable(F.col("x0")), *[(p,) for p in bad]) == [False] * len(bad)
    assert values(spark, paths.portable(F.col("x0")), ("src/ok.py",), ("a b/c.py",)) == [True, True]
    assert values(spark, paths.safe_relative(F.col("x0")), ("a/b.py",), ("../a",), ("/a",), ("a//b",), ("",)) == [True, False, False, False, False]


def test_paths(spark):
    assert values(spark, paths.normalized(F.col("x0")), ("a\\b//c/",), ("./a/./b",), ("a/.",)) == ["a/b/c", "a/b", "a"]
    assert values(spark, paths.below(F.col("x0"), ["src/"]), ("src",), ("src/a",), ("srcs/a",)) == [True, True, False]
    assert values(spark, paths.without_root(F.col("x0")), ("root/a/b",), ("a",)) == ["a/b", "a"]
    assert values(spark, paths.with_parents(F.array(F.lit("a/b/c"), F.lit("x"))), ("",)) == [["a/b", "a/b/c", "x"]]
    assert values(spark, paths.language_of(F.col("x0")), ("A.JAVA",), ("a.pyi",), ("x/.py",)) == ["java", None, None]


def test_numbers(spark):
    arrays = "array<double>;array<double>"
    assert values(spark, numbers.cosine(F.col("x0"), F.col("x1")), ([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), kind=arrays) == [1.0, 0.0]
    with pytest.raises(Exception, match="differ in length"):
        values(spark, numbers.cosine(F.col("x0"), F.col("x1")), ([1.0], [1.0, 2.0]), kind=arrays)
    ints = "int;int;int;int"
    assert values(spark, numbers.overlap_ratio(*[F.col(f"x{i}") for i in range(4)]), (1, 10, 1, 10), (1, 5, 1, 10), (5, 1, 1, 10), (1, 2, 9, 3), (20, 30, 1, 10), kind=ints) == [1.0, 0.5, 0.0, 0.0, 0.0]
    price = lambda x: F.lit(x).cast("decimal(12,6)")
    assert values(spark, numbers.cost(F.col("x0"), F.lit(0), price("0.5"), price("1")), (1,), (3,), kind="long") == [Decimal("0.000001"), Decimal("0.000002")]
    assert values(spark, numbers.version(F.col("x0")), ("0.10.2",), ("1.x",)) == [[0, 10, 2], [1, 0]]
    assert values(spark, numbers.elapsed_seconds(F.col("x0").cast("timestamp"), F.col("x1").cast("timestamp")), ("2024-01-01 00:00:00", "2024-01-01 00:00:01.25"), kind="string;string") == [1.2]


def test_bytes(spark):
    facts = values(spark, readers.byte_facts(F.col("x0")), (bytearray(b"ab\n"),), (bytearray(b"a\x00"),), (bytearray(b"\x01\x02\x03ab"),), (bytearray(b""),), kind="binary")
    assert [(f["size"], f["has_nul"], f["binary"]) for f in facts] == [(3, False, False), (2, True, True), (5, False, True), (0, False, False)]
    assert values(spark, text.decoded(F.col("x0")), (bytearray("\ufeffé".encode()),), (bytearray(b"\xff\xfe"),), kind="binary") == ["é", None]
    rows = readers.legacy_text(spark.createDataFrame([("a", bytearray("中文".encode("gb18030")))], "path string, content binary")).collect()
    assert rows[0]["text"] == "中文" and rows[0]["encoding"] == "gb18030"
