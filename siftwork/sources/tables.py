"""Entities of source analysis, bound to the tables at hand: files, manifests, vectors, runs, issues, spans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the files that documents stand for: SQL that Spark and DuckDB both read.
PATH_SQL = (
    "concat(CASE doc_id % 11 WHEN 0 THEN 'src/api' WHEN 1 THEN 'src/domain' WHEN 2 THEN 'tests/unit' WHEN 3 THEN 'web/node_modules/pkg' WHEN 4 THEN 'src/Auth' "
    "WHEN 5 THEN 'build' WHEN 6 THEN 'db/migrations' WHEN 7 THEN 'src' ELSE 'src/core' END, '/', CASE doc_id % 13 WHEN 0 THEN 'generated.py' WHEN 1 THEN 'poetry.lock' "
    "WHEN 2 THEN concat('test_', doc_id, '.py') WHEN 3 THEN concat('route-', doc_id, '.java') WHEN 4 THEN concat('notes', doc_id, '.md') WHEN 5 THEN concat('Client', doc_id, '.min.java') "
    "WHEN 6 THEN concat('Doc', doc_id, '.JAVA') ELSE concat('doc_', doc_id, '.py') END)"
)
#: Paths that clients might send, safe and not.
CLIENT_PATH_SQL = (
    "CASE doc_id % 12 WHEN 0 THEN concat('../f', doc_id, '.py') WHEN 1 THEN concat('/abs', doc_id, '.py') WHEN 2 THEN concat('src//f', doc_id, '.py') WHEN 3 THEN concat('src/./f', doc_id, '.py') "
    "WHEN 4 THEN 'src/con.py' WHEN 5 THEN concat('src/f', doc_id, '.py ') WHEN 6 THEN concat('src/f', doc_id, '?.py') WHEN 7 THEN concat('C:/f', doc_id, '.py') WHEN 8 THEN concat('out/F', doc_id, '.py') "
    "WHEN 9 THEN '' ELSE concat('src/F', doc_id % 100, '.py') END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, project, language, path, client_path, text, size): one file for each document."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("project"), F.col("lang").alias("language"), F.expr(PATH_SQL).alias("path"),
        F.expr(CLIENT_PATH_SQL).alias("client_path"), F.coalesce("text", F.lit("")).alias("text"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), "embedding", "label")


#: What a chunk of the index is, for Spark and DuckDB: its project, whether it and its vector are ready.
CHUNK_SQL = (
    "doc_id AS file_id, coalesce(source, '') AS project, lang AS language, PATH AS path, CASE WHEN doc_id % 20 = 19 THEN 'pending' ELSE 'ready' END AS index_status"
).replace("PATH", PATH_SQL)
VECTOR_STATUS_SQL = "CASE WHEN vec_id % 25 = 24 THEN 'keyword_only' ELSE 'ready' END"


def index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, project, language, path, index_status, search_text, symbol_name, qualified_name): one chunk for each document."""
    return table(spark, sf_dir, "documents").selectExpr(*_parts(CHUNK_SQL), "coalesce(text, '') AS search_text", f"{PATH_SQL} AS symbol_name", f"{PATH_SQL} AS qualified_name")


def index_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, project, language, path, index_status, embedding, embedding_status): the vectors of the chunks that have one."""
    v = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS file_id", "embedding", f"{VECTOR_STATUS_SQL} AS embedding_status")
    return table(spark, sf_dir, "documents").selectExpr(*_parts(CHUNK_SQL)).join(v, "file_id")


def _parts(sql: str) -> list[str]:
    """The columns of a SELECT list, each of which ends in AS and a name."""
    return [x.strip(" ,") for x in re.findall(r".+? AS \w+(?:,|$)", sql)]


#: The query set of the retrieval queries: number, text, the vector that stands for the text, project. A parameter of fixed size.
QUERY_SET = [
    (1, "the of and", 0, "src7"), (2, "und der", 7, "src1"), (3, "les que", 14, "src7"), (4, "thing", 21, "src1"), (5, "License", 28, "src2"), (6, "zzqx nothing", 35, "src7"),
    (7, "   ", 42, "src1"), (8, "100%_sure", -1, "src1"), (9, "core doc", -1, "src7"), (10, "The", -1, "src2"), (11, "doc_", 49, "nowhere"),
]
#: The languages and folders that the retrieval queries ask for.
ASKED_LANGUAGES, ASKED_PATHS = ("en", "fr", "de"), (" src/ ", "tests\\unit", "db")


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, project, vector): vector is null where the provider has none."""
    given = spark.createDataFrame(QUERY_SET, "query_id int, query string, vec_id long, project string")
    return given.join(F.broadcast(table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin([q[2] for q in QUERY_SET])).select("vec_id", F.col("embedding").alias("vector"))), "vec_id", "left").drop("vec_id")


def node_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, task_id, node_type, status, input_tokens, output_tokens, model_call_count, cost, latency_ms, provider, model, started_at)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("task_id"),
        F.when(F.col("event_id") % 3 == 0, "embedding").when(F.col("event_id") % 3 == 1, "llm").otherwise("tool").alias("node_type"),
        F.when(F.col("event_id") % 7 == 0, "failed").otherwise("success").alias("status"),
        k.alias("input_tokens"), (k % 17).alias("output_tokens"), F.when(F.col("event_id") % 5 == 0, k % 3).alias("model_call_count"),
        F.when(F.col("event_id") % 4 != 0, F.round(F.abs("value").cast("decimal(18,6)"), 6).cast("decimal(12,6)")).alias("cost"),
        (k * 10 + F.col("event_id") % 10).alias("latency_ms"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("p"), F.col("event_id") % 2)).alias("provider"),
        F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.col("ts").alias("started_at"),
    )


#: The same rows for DuckDB.
NODE_RUNS_SQL = """SELECT event_id AS run_id, user_id AS task_id, CASE event_id % 3 WHEN 0 THEN 'embedding' WHEN 1 THEN 'llm' ELSE 'tool' END AS node_type,
  CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'success' END AS status, json_extract_string(props, '$.k')::BIGINT AS input_tokens,
  json_extract_string(props, '$.k')::BIGINT % 17 AS output_tokens, CASE WHEN event_id % 5 = 0 THEN json_extract_string(props, '$.k')::BIGINT % 3 END AS model_call_count,
  CASE WHEN event_id % 4 <> 0 THEN round(abs(value)::DECIMAL(18,6), 6)::DECIMAL(12,6) END AS cost, json_extract_string(props, '$.k')::BIGINT * 10 + event_id % 10 AS latency_ms,
  CASE WHEN event_id % 4 <> 0 THEN concat('p', event_id % 2) END AS provider, concat('m', user_id % 3) AS model, ts AS started_at FROM events"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(issue_id, task_id, pos, fingerprint, path, category, risk_level, title, verified, decision): order lines as findings."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("issue_id"), (F.col("l_orderkey") % 100).alias("task_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.when(F.col("l_partkey") % 50 != 0, F.concat(F.lit("fp"), F.col("l_partkey"))).otherwise("").alias("fingerprint"),
        F.concat(F.lit("src/"), F.col("l_returnflag"), F.lit("/f"), F.col("l_suppkey"), F.lit(".py")).alias("path"),
        F.when(F.col("l_linenumber") == 1, "security").when(F.col("l_linenumber") == 2, "performance").when(F.col("l_linenumber") == 3, "quality").alias("category"),
        F.when(F.col("l_partkey") % 5 == 0, "High").when(F.col("l_partkey") % 5 == 1, "Medium").when(F.col("l_partkey") % 5 == 2, "Low").when(F.col("l_partkey") % 5 == 3, "Unknown").alias("risk_level"),
        F.concat(F.lit("Issue "), F.col("l_linestatus"), F.col("l_suppkey")).alias("title"), (F.col("l_linestatus") == "F").alias("verified"),
        F.when(F.col("l_suppkey") % 4 == 0, "pass").when(F.col("l_suppkey") % 4 == 1, "fail").when(F.col("l_suppkey") % 4 == 2, "uncertain").alias("decision"),
    )


ISSUES_SQL = """SELECT l_orderkey * 10 + l_linenumber AS issue_id, l_orderkey % 100 AS task_id, l_orderkey * 10 + l_linenumber AS pos,
  CASE WHEN l_partkey % 50 <> 0 THEN concat('fp', l_partkey) ELSE '' END AS fingerprint, concat('src/', l_returnflag, '/f', l_suppkey, '.py') AS path,
  CASE l_linenumber WHEN 1 THEN 'security' WHEN 2 THEN 'performance' WHEN 3 THEN 'quality' END AS category,
  CASE l_partkey % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' WHEN 3 THEN 'Unknown' END AS risk_level,
  concat('Issue ', l_linestatus, l_suppkey) AS title, l_linestatus = 'F' AS verified,
  CASE l_suppkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'uncertain' END AS decision FROM lineitem"""


def truth_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled line ranges (gt_id, language, path, category, cwe_id, sink_line, start_line, end_line, vulnerable)."""
    l = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") % 40 + 1
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("gt_id"), F.when(F.col("l_suppkey") % 2 == 0, "java").otherwise("python").alias("language"),
        F.concat(F.lit("src/f"), F.col("l_orderkey"), F.lit(".x")).alias("path"), F.when(F.col("l_linenumber") % 2 == 0, "security").otherwise("quality").alias("category"),
        F.concat(F.lit("CWE-"), F.col("l_linenumber") % 3).alias("cwe_id"), (start + 2).cast("int").alias("sink_line"), start.cast("int").alias("start_line"),
        (start + F.col("l_suppkey") % 6).cast("int").alias("end_line"), (F.col("l_linenumber") < 6).alias("vulnerable"),
    )


def predicted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions (prediction_index, language, path, ..., risk_level, fingerprint): shifted ranges of the order lines."""
    l = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") % 40 + F.col("l_suppkey") % 3
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("prediction_index"), F.when(F.col("l_suppkey") % 2 == 0, "java").otherwise("python").alias("language"),
        F.concat(F.lit("src//f"), F.col("l_orderkey"), F.lit(".x")).alias("path"), F.when(F.col("l_linenumber") % 2 == 0, "security").otherwise("quality").alias("category"),
        F.concat(F.lit("CWE-"), F.col("l_linenumber") % 3).alias("cwe_id"), start.cast("int").alias("start_line"), (start + F.col("l_partkey") % 4).cast("int").alias("end_line"),
        F.when(F.col("l_partkey") % 3 == 0, "High").otherwise("Medium").alias("risk_level"), F.concat(F.lit("p"), F.col("l_partkey")).alias("fingerprint"),
    )


TRUTH_SQL = """SELECT l_orderkey * 10 + l_linenumber AS gt_id, CASE WHEN l_suppkey % 2 = 0 THEN 'java' ELSE 'python' END AS language, concat('src/f', l_orderkey, '.x') AS path,
  CASE WHEN l_linenumber % 2 = 0 THEN 'security' ELSE 'quality' END AS category, concat('CWE-', l_linenumber % 3) AS cwe_id, l_partkey % 40 + 3 AS sink_line, l_partkey % 40 + 1 AS start_line,
  l_partkey % 40 + 1 + l_suppkey % 6 AS end_line, l_linenumber < 6 AS vulnerable FROM lineitem"""
PREDICTED_SQL = """SELECT l_orderkey * 10 + l_linenumber AS prediction_index, CASE WHEN l_suppkey % 2 = 0 THEN 'java' ELSE 'python' END AS language, concat('src/f', l_orderkey, '.x') AS path,
  CASE WHEN l_linenumber % 2 = 0 THEN 'security' ELSE 'quality' END AS category, concat('CWE-', l_linenumber % 3) AS cwe_id, l_partkey % 40 + l_suppkey % 3 AS start_line,
  l_partkey % 40 + l_suppkey % 3 + l_partkey % 4 AS end_line, CASE WHEN l_partkey % 3 = 0 THEN 'High' ELSE 'Medium' END AS risk_level, concat('p', l_partkey) AS fingerprint FROM lineitem"""
