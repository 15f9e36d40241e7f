"""The parsers as a table function of SQL."""

from siftwork.operators import chunking


def test_lateral(spark):
    chunking.register(spark)
    long = "def big():\n" + "    x = 1\n" * 200
    rows = [(1, "a.py", "import os\n\n\ndef f():\n    return os.sep\n"), (2, "noext", long), (3, "B.JAVA", "class B { void m() { n(); } }"), (4, "plain", "no code. at all."), (5, "bad.py", "def ("), (6, "none", None)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    out = spark.sql("SELECT f.file_id, p.* FROM {files} f, LATERAL parse_source(f.path, f.text) p", files=files).collect()
    told = sorted((r["file_id"], r["kind"], r["language"], r["symbol_name"], r["start_line"], r["end_line"], r["split_part"], r["error"]) for r in out if r["kind"] != "reference")
    assert [t for t in told if t[0] == 1] == [(1, "chunk", "python", "f", 4, 5, None, None)]
    assert [t[4:7] for t in told if t[0] == 2] == [(1, 120, 1), (111, 201, 2)] and {t[2] for t in told if t[0] == 2} == {"python"}
    assert {t[2] for t in told if t[0] == 3} == {"java"}
    assert [t[7] for t in told if t[0] in (4, 5, 6)] == ["NO_PARSER", "SYNTAX_ERROR", "EMPTY_SOURCE"]


def test_same_rows_as_the_dataframe_form(spark):
    chunking.register(spark)
    files = spark.createDataFrame([(k, f"f{k}.py", f"import m{k}\n\nclass C{k}:\n    def g(self):\n        return m{k}.h()\n") for k in range(20)], "file_id long, path string, text string")
    names = ["file_id", *[f.split()[0] for f in chunking.PARSED.split(", ")]]
    by_sql = spark.sql("SELECT f.file_id, p.* FROM {files} f, LATERAL parse_source(f.path, f.text) p", files=files).select(names).collect()
    plain = chunking.parsed(files.selectExpr("*", "'python' AS language")).select(names).collect()
    assert sorted(map(str, by_sql)) == sorted(map(str, plain))


def test_rows_are_handed_on_by_size(spark, monkeypatch):
    """Files of one batch leave the task in several batches of rows, with the same rows."""
    from pyspark.sql import functions as F

    from siftwork.operators import chunking

    files = spark.range(300).coalesce(1).select(F.col("id").alias("file_id"), F.lit("a.go").alias("path"), F.lit("go").alias("language"), F.repeat(F.lit("x y\n"), 200).alias("text"))
    want = sorted(map(str, chunking.parsed(files).collect()))
    monkeypatch.setattr(chunking, "HANDED_ON", 5000)
    seen = []
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, f, shape, g=type(files).mapInArrow: (seen.append(f), g(self, f, shape))[1])
    assert sorted(map(str, chunking.parsed(files).collect())) == want
    told = [b.num_rows for b in seen[0](iter([files.toArrow().to_batches()[0]]))]
    assert len(told) > 50 and max(told) <= 10


def test_python_texts_are_read_once_and_split_once(monkeypatch):
    """Texts of nodes as ast gives them, with other line ends and letters of several bytes; a found language is not read again."""
    import ast

    from siftwork.operators import chunking

    source = "import é\r\nclass A(B.é,\r  C):\n\tdef f(self):\n\t\treturn 'äö', g.h(\x0c1)(2)\n"
    found, refs, imports = chunking.PARSERS["python"].read(source)
    want = [ast.get_source_segment(source, n) for n in ast.walk(ast.parse(source)) if isinstance(n, ast.ClassDef | ast.FunctionDef)]
    assert [f["content"] for f in found] == want and imports == ["import é"]
    assert [r["target"] for r in refs] == ["é", "B.é", "C", "g.h(\x0c1)", "g.h"]
    reads, read = [], type(chunking.PARSERS["python"]).read
    monkeypatch.setattr(type(chunking.PARSERS["python"]), "read", lambda self, text: (reads.append(1), read(self, text))[1])
    assert list(chunking.ParseSource().eval("plain", "def once():\n    return 5\n")) and len(reads) == 1
