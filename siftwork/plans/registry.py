"""All queries of this package by name, and the SQL that each is held against: here those of scan, text, review, usage,
evaluation and events; the others stand in retrieval.py and library.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, paths, text
from ..operators import chunking, evaluate, indexing, projections, review, scan, usage
from ..sources import tables
from ..sources.shared import shared_folder
from ..sources.tables import ISSUES_SQL, NODE_RUNS_SQL, PREDICTED_SQL, TRUTH_SQL, files, issues, node_runs, predicted_spans, truth_spans
from ..streaming import events as streams
from ..streaming import tasks
from . import library, retrieval, workflow  # noqa: F401 - they register their queries
from .catalog import FILES, ORACLE_SQL, QUERIES, query, quoted  # noqa: F401

# --- scan ------------------------------------------------------------------------------------------------------------

CLASSIFIED = f"""{FILES}, named AS (
  SELECT *, lower(path) AS p, string_split(lower(path), '/')[-1] AS name, string_split(lower(path), '/')[:-2] AS dirs FROM files
), typed AS (
  SELECT *, CASE WHEN ends_with(name, '.java') THEN 'java' WHEN ends_with(name, '.py') THEN 'python' END AS scan_language, regexp_replace(name, '\\.[^.]+$', '') AS stem FROM named
), judged AS (
  SELECT *, CASE WHEN list_has_any(dirs, [{quoted(paths.EXCLUDED_IN_SCAN)}]) THEN 'EXCLUDED_PATH' WHEN name IN ({quoted(paths.LOCK_FILES)}) THEN 'LOCK_FILE'
    WHEN name IN ({quoted(paths.GENERATED_NAMES)}) OR regexp_matches(name, '\\.(designer\\.java|generated\\.java|generated\\.py|min\\.java|min\\.py)$') THEN 'GENERATED_FILE'
    WHEN scan_language IS NULL THEN 'UNSUPPORTED_FILE_TYPE' WHEN size > 1048576 THEN 'SINGLE_FILE_SIZE_EXCEEDED' END AS reason,
    CASE WHEN list_has_any(dirs, [{quoted(paths.LOW_PRIORITY)}]) OR starts_with(name, 'test_') THEN 'low'
      WHEN list_has_any(dirs, [{quoted(paths.HIGH_PRIORITY)}]) OR list_has_any(string_split(replace(stem, '-', '_'), '_'), [{quoted(paths.HIGH_PRIORITY)}]) THEN 'high' ELSE 'medium' END AS level,
    length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS lines
  FROM typed
)"""


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.classify(files(spark, sf_dir).withColumn("lines", text.lines_scanned(F.col("text"))))


@query(f"WITH {CLASSIFIED} SELECT file_id, path, scan_language, reason, CASE WHEN reason IS NULL THEN level END AS priority FROM judged")
def scan_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).select("file_id", "path", "scan_language", "reason", "priority")


@query(f"""WITH {CLASSIFIED}, r AS (SELECT DISTINCT path FROM files WHERE file_id % 10 <> 9 UNION SELECT DISTINCT concat('gone/', file_id, '.py') FROM files WHERE file_id % 50 = 3),
p AS (SELECT path, min(reason) AS reason FROM judged WHERE file_id % 10 <> 7 GROUP BY path),
j AS (SELECT r.path IS NOT NULL AS reg, p.path IS NOT NULL AS disc, CASE WHEN p.path IS NULL THEN 'failed' WHEN r.path IS NULL OR reason IS NOT NULL THEN 'skipped' ELSE 'included' END AS status FROM r FULL JOIN p ON r.path = p.path)
SELECT count(CASE WHEN reg THEN 1 END) AS registered, count(CASE WHEN disc THEN 1 END) AS discovered, count(CASE WHEN reg AND status = 'included' THEN 1 END) AS included, count(CASE WHEN reg AND status = 'skipped' THEN 1 END) AS skipped,
  count(CASE WHEN status = 'failed' THEN 1 END) AS failed, CASE WHEN count(CASE WHEN reg THEN 1 END) = 0 THEN 1.0 ELSE count(CASE WHEN reg AND status = 'included' THEN 1 END)::DOUBLE / count(CASE WHEN reg THEN 1 END) END AS coverage FROM j""")
def scan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered: nine files of ten, and some that are gone; found: nine of ten, others."""
    f = files(spark, sf_dir)
    registered = f.where("file_id % 10 <> 9").select("path").union(f.where("file_id % 50 = 3").select(F.concat(F.lit("gone/"), "file_id", F.lit(".py"))))
    physical = f.where("file_id % 10 <> 7").groupBy("path").agg(F.min("size").alias("size"))
    return scan.coverage(scan.reconcile(registered, physical))


@query(f"WITH {CLASSIFIED} SELECT project, scan_language AS language, count(*) AS files, sum(lines)::BIGINT AS lines, sum(size)::BIGINT AS bytes FROM judged WHERE reason IS NULL GROUP BY ALL")
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.language_stats(_scanned(spark, sf_dir).where("reason IS NULL"), ["project"])


@query(f"WITH {CLASSIFIED}, c AS (SELECT project, scan_language AS language, count(*) AS n FROM judged WHERE reason IS NULL GROUP BY ALL) SELECT DISTINCT ON (project) project, language AS main_language FROM c ORDER BY project, n DESC, language")
def main_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.main_language(scan.language_stats(_scanned(spark, sf_dir).where("reason IS NULL"), ["project"]), ["project"])


@query(f"WITH {CLASSIFIED}, c AS (SELECT project, scan_language AS language, count(*) AS n, min(file_id) AS place FROM judged WHERE scan_language IS NOT NULL GROUP BY ALL) SELECT DISTINCT ON (project) project, language AS main_language FROM c ORDER BY project, n DESC, place")
def upload_main_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _scanned(spark, sf_dir).select("project", F.col("scan_language").alias("language"), F.col("file_id").alias("position"))
    return scan.first_main_language(m, ["project"])


@query(f"WITH {CLASSIFIED} SELECT count(CASE WHEN level = 'high' THEN 1 END) AS high, count(CASE WHEN level = 'medium' THEN 1 END) AS medium, count(CASE WHEN level = 'low' THEN 1 END) AS low FROM judged WHERE reason IS NULL")
def priority_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.priority_histogram(_scanned(spark, sf_dir).where("reason IS NULL"))


SAFE = f"""{FILES}, cut AS (SELECT *, string_split(client_path, '/') AS parts FROM files), checked AS (
  SELECT *, client_path <> '' AND NOT starts_with(client_path, '/') AND NOT contains(client_path, '\\') AND NOT list_has_any(parts, ['', '.', '..']) AS safe_relative,
    client_path = trim(client_path) AND NOT contains(client_path, '\\') AND length(client_path) <= 512 AND client_path <> '' AND NOT list_has_any(parts, ['', '.', '..'])
      AND NOT regexp_matches(client_path, '[ .](/|$)') AND NOT regexp_matches(client_path, '[<>:"|?*]')
      AND NOT list_has_any(list_transform(parts, lambda x: lower(string_split(x, '.')[1])), [{quoted(paths.RESERVED_STEMS)}]) AS portable,
    list_has_any(list_transform(parts[:-2], lambda x: lower(x)), [{quoted(paths.EXCLUDED_IN_UPLOAD)}]) AS excluded FROM cut)"""


@query(f"WITH {SAFE} SELECT file_id, client_path, safe_relative, portable, excluded FROM checked")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.path_safety(files(spark, sf_dir)).select("file_id", "client_path", "safe_relative", "portable", "excluded")


@query(f"""WITH {SAFE}, s AS (SELECT project, size, portable AND NOT excluded AND regexp_matches(lower(client_path), '\\.(py|java)$') AND size <= 1048576 AS ok FROM checked)
SELECT project, count(*) AS files, count(CASE WHEN ok THEN 1 END) AS accepted, count(CASE WHEN NOT ok THEN 1 END) AS rejected, sum(size)::BIGINT AS declared_bytes, coalesce(sum(size) FILTER (ok), 0)::BIGINT AS accepted_bytes FROM s GROUP BY project""")
def manifest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = files(spark, sf_dir).withColumn("status", scan.manifest_status(F.col("client_path"), F.col("size")))
    return scan.manifest_rollup(m, ["project"])


@query(f"WITH {FILES} SELECT project, lower(client_path) AS folded_path, count(*) AS copies FROM files GROUP BY ALL HAVING count(*) > 1")
def manifest_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.duplicate_paths(files(spark, sf_dir), ["project"])


@query(f"WITH {FILES} SELECT file_id, path FROM files WHERE path = 'src/core' OR starts_with(path, 'src/core/') OR starts_with(path, 'db/')")
def path_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(paths.below(F.col("path"), [" src\\core/ ", "db", "", "db"])).select("file_id", "path")


# --- text and chunks -------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id AS file_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS words FROM documents""")
def identifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", text.split_identifier(F.col("text")).alias("words"))


@query(f"""WITH {FILES}, w AS (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(path, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS words FROM files)
SELECT file_id, sha256(path || chr(10) || words || chr(10) || text) AS search_sha256 FROM w""")
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = text.search_text([F.col("path"), F.lit(""), F.lit(None).cast("string")], F.col("text"))
    return files(spark, sf_dir).select("file_id", F.sha2(made.cast("binary"), 256).alias("search_sha256"))


WINDOWS = f"""{FILES}, l AS (SELECT file_id, path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines FROM files WHERE text <> ''),
o AS (SELECT *, unnest(range(0, greatest(len(lines) - 2, 0) + 1, 4)) AS o FROM l),
w AS (SELECT file_id, path, o // 4 + 1 AS part, o + 1 AS start_line, least(o + 5, len(lines)) AS end_line, lines[o + 1:o + 5] AS own FROM o),
h AS (SELECT *, sha256(trim(array_to_string(list_transform(own, lambda x: rtrim(x, ' ' || chr(9) || chr(13))), chr(10)), ' ' || chr(9) || chr(10) || chr(13))) AS content_hash FROM w)"""


@query(f"WITH {WINDOWS} SELECT file_id, part, start_line, end_line, content_hash, sha256(concat(path, chr(0), '<fallback:', start_line, '>', chr(0), start_line, chr(0), end_line, chr(0), content_hash)) AS chunk_fingerprint FROM h")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.line_windows(files(spark, sf_dir), "file_id", "path", "text", 5, 1)
    return rows.select("file_id", "part", "start_line", "end_line", "content_hash", "chunk_fingerprint")


@query(f"""WITH {FILES} SELECT file_id, greatest(1, ceil(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 4.0)::BIGINT + length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) AS estimate,
size::BIGINT AS bytes, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' THEN 1 ELSE 0 END)::BIGINT AS lines_cited FROM files""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return files(spark, sf_dir).select("file_id", text.token_estimate(t).alias("estimate"), text.token_bytes(t).alias("bytes"), text.lines_cited(t).alias("lines_cited"))


@query(f"""WITH {FILES}, c AS (SELECT file_id, project, sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS h FROM files), x AS (SELECT project, h, min(file_id) AS first FROM c WHERE file_id % 3 <> 0 GROUP BY ALL)
SELECT c.file_id, x.first::DOUBLE AS reused_from FROM c LEFT JOIN x USING (project, h)""")
def embedding_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the files are indexed; each file takes the embedding of the first indexed one with equal text."""
    c = files(spark, sf_dir).select("file_id", "project", F.sha2(text.strip(F.col("text")).cast("binary"), 256).alias("content_hash"))
    indexed = c.where("file_id % 3 <> 0").select("project", "content_hash", F.col("file_id").alias("chunk_id"), F.array(F.lit(0.0)).alias("embedding"))
    return indexing.reuse(c, indexed, ["project", "content_hash"]).select("file_id", F.col("reused_from").cast("double").alias("reused_from"))


@query(f"""WITH {WINDOWS}, fp AS (SELECT file_id, part, sha256(concat(path, chr(0), '<fallback:', start_line, '>', chr(0), start_line, chr(0), end_line, chr(0), content_hash)) AS fp, content_hash FROM h),
parsed AS (SELECT file_id, list_sort(list(DISTINCT fp || content_hash || '1')) AS have FROM fp GROUP BY file_id),
stored AS (SELECT file_id, list_sort(list(DISTINCT fp || CASE WHEN file_id % 7 = 0 AND part = 2 THEN 'other' ELSE content_hash END || CASE WHEN file_id % 11 = 0 THEN '0' ELSE '1' END)) AS have
  FROM (SELECT * FROM fp WHERE NOT (file_id % 5 = 0 AND part = 1) UNION ALL SELECT file_id, 99, 'gone', 'gone' FROM fp WHERE file_id % 13 = 0 AND part = 1) GROUP BY file_id)
SELECT coalesce(p.file_id, s.file_id) AS file_id, coalesce(p.have = s.have, false) AS current FROM parsed p FULL JOIN stored s ON p.file_id = s.file_id""")
def file_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some files lost their first chunk in the index, some have one too many, another content or another version."""
    c = chunking.line_windows(files(spark, sf_dir), "file_id", "path", "text", 5, 1).withColumn("version", F.lit("1"))
    c = c.select("file_id", "chunk_fingerprint", "content_hash", "version", "part")
    stored = c.where("NOT (file_id % 5 = 0 AND part = 1)")
    stored = stored.withColumn("content_hash", F.when((F.col("file_id") % 7 == 0) & (F.col("part") == 2), "other").otherwise(F.col("content_hash"))).withColumn("version", F.when(F.col("file_id") % 11 == 0, "0").otherwise("1"))
    extra = c.where("file_id % 13 = 0 AND part = 1").select("file_id", F.lit("gone").alias("chunk_fingerprint"), F.lit("gone").alias("content_hash"), F.when(F.col("file_id") % 11 == 0, "0").otherwise("1").alias("version"))
    return indexing.current_files(c.drop("part"), stored.drop("part").unionByName(extra))


# --- review ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {FILES}, l AS (SELECT *, concat(path, '#', file_id) AS own, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM files),
i AS (SELECT *, CASE file_id % 7 WHEN 0 THEN 0 ELSE 1 + file_id % 3 END AS s, CASE file_id % 5 WHEN 0 THEN 999999 ELSE 2 + file_id % 4 END AS e,
  CASE file_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'not in the file at all' WHEN 2 THEN concat('  ', lines[2], ' ') ELSE lines[1 + file_id % 3] END AS ev FROM l),
c AS (SELECT *, file_id % 9 <> 4 AS path_ok, s >= 1 AND e >= s AND e <= length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' THEN 1 ELSE 0 END AS in_range FROM i),
v AS (SELECT file_id AS issue_id, path_ok, path_ok AND in_range AS lines_ok,
  path_ok AND in_range AND coalesce(trim(ev, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND contains(array_to_string(lines[s:e], chr(10)), trim(ev, ' ' || chr(9) || chr(10) || chr(13))), false) AS evidence_ok, file_id % 4 <> 1 AND file_id % 10 <> 3 AS chunks_ok FROM c)
SELECT *, CASE WHEN path_ok AND lines_ok AND evidence_ok AND chunks_ok THEN 'passed' ELSE 'failed' END AS evidence_status FROM v""")
def evidence_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue for each file: some name no file, lines outside it, no, wrong or shifted evidence, no chunk or one of another project."""
    f = files(spark, sf_dir).withColumn("path", F.concat_ws("#", "path", "file_id"))
    k, line = F.col("file_id"), lambda n: F.get(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1), n)
    i = f.select(
        k.alias("issue_id"), "project", F.when(k % 9 == 4, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"),
        F.when(k % 7 == 0, 0).otherwise((1 + k % 3).cast("int")).alias("start_line"), F.when(k % 5 == 0, 999999).otherwise((2 + k % 4).cast("int")).alias("end_line"),
        F.when(k % 6 == 0, "").when(k % 6 == 1, "not in the file at all").when(k % 6 == 2, F.concat(F.lit("  "), line(F.lit(1)), F.lit(" "))).otherwise(line((k % 3).cast("int"))).alias("evidence"),
        F.when(k % 4 == 1, F.array().cast("array<bigint>")).when(k % 10 == 3, F.array(k, -1 - k)).otherwise(F.array(k, k)).alias("source_chunk_ids"),
    )
    out = review.verified(i, f, f.select("project", k.alias("chunk_id")))
    return out.select("issue_id", "path_ok", "lines_ok", "evidence_ok", "chunks_ok", "evidence_status")


@query(f"""WITH i AS ({ISSUES_SQL}), d AS (SELECT fingerprint, arg_max(decision, (pos, decision)) AS decision FROM (SELECT * FROM i WHERE decision IS NOT NULL AND fingerprint <> '' AND issue_id % 3 = 0) GROUP BY fingerprint)
SELECT issue_id, coalesce(d.decision, 'fail') AS decision, CASE WHEN d.decision IS NULL THEN 'missing_critic_decision' ELSE 'said' END AS reason,
  CASE WHEN coalesce(d.decision, 'fail') IN ('pass', 'uncertain') THEN 'verified' ELSE 'retry' END AS outcome, coalesce(d.decision, 'fail') = 'uncertain' AS needs_human_review FROM i LEFT JOIN d USING (fingerprint)""")
def critic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = issues(spark, sf_dir)
    d = i.where("decision IS NOT NULL AND fingerprint <> '' AND issue_id % 3 = 0").select("fingerprint", "pos", "decision", F.lit("said").alias("reason"))
    return review.merged(i.drop("decision"), d).select("issue_id", "decision", "reason", "outcome", "needs_human_review")


@query(f"WITH i AS ({ISSUES_SQL}) SELECT DISTINCT ON (task_id, fingerprint) task_id, fingerprint, issue_id FROM i WHERE fingerprint <> '' ORDER BY task_id, fingerprint, verified DESC, pos")
def issue_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified before rejected, then in order."""
    return review.first_of_each(issues(spark, sf_dir), ["task_id"], [F.desc("verified"), F.col("pos")]).select("task_id", "fingerprint", "issue_id")


@query(f"""WITH i AS ({ISSUES_SQL}), r AS (SELECT *, CASE WHEN verified THEN 0 ELSE 1 END AS side FROM i WHERE verified OR fingerprint <> '')
SELECT task_id, fingerprint, arg_max(issue_id, (side, pos)) AS issue_id, arg_min(pos, (side, pos)) AS place FROM r GROUP BY ALL""")
def issue_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = issues(spark, sf_dir)
    return review.last_of_each(i.where("verified"), i.where("NOT verified"), ["task_id"]).select("task_id", "fingerprint", "issue_id", "place")


@query(f"""WITH i AS ({ISSUES_SQL}) SELECT task_id, count(CASE WHEN risk_level = 'High' THEN 1 END) AS high, count(CASE WHEN risk_level = 'Medium' THEN 1 END) AS medium, count(CASE WHEN coalesce(risk_level, 'Low') = 'Low' THEN 1 END) AS low, count(*) AS total FROM i GROUP BY task_id""")
def severity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.severity_stats(issues(spark, sf_dir), ["task_id"])


@query(f"WITH i AS ({ISSUES_SQL}) SELECT coalesce(category, 'unknown') AS category, count(*) AS issues FROM i GROUP BY 1")
def category_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.category_histogram(issues(spark, sf_dir))


@query(f"WITH i AS ({ISSUES_SQL}) SELECT issue_id, title, path FROM i WHERE risk_level = 'High' AND category = 'security' AND (lower(title) LIKE '%f1%' OR lower(path) LIKE '%f1%' OR lower(fingerprint) LIKE '%f1%') ORDER BY task_id, issue_id LIMIT 15 OFFSET 15")
def issue_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a filtered list."""
    return review.issue_page(issues(spark, sf_dir), [F.col("task_id"), F.col("issue_id")], "High", "security", "F1", 2).select("issue_id", "title", "path")


@query(f"""WITH i AS ({ISSUES_SQL}), u AS (SELECT count(*) AS n FROM (SELECT task_id, fingerprint FROM i GROUP BY ALL HAVING count(*) > 1))
SELECT 'risk_known' AS rule, count(CASE WHEN coalesce(risk_level, 'Low') NOT IN ('High', 'Medium', 'Low') THEN 1 END) AS violations FROM i UNION ALL SELECT 'category_known', count(CASE WHEN category IS NOT NULL AND category NOT IN ('security', 'quality') THEN 1 END) FROM i
UNION ALL SELECT 'has_fingerprint', count(CASE WHEN fingerprint = '' THEN 1 END) FROM i UNION ALL SELECT 'unique_fingerprint', n FROM u""")
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = issues(spark, sf_dir)
    rules = {"risk_known": F.coalesce("risk_level", F.lit("Low")).isin(*review.LEVELS), "category_known": F.col("category").isin("security", "quality"), "has_fingerprint": F.col("fingerprint") != ""}
    twice = i.groupBy("task_id", "fingerprint").count().where("count > 1").agg(F.count("*").alias("violations")).select(F.lit("unique_fingerprint").alias("rule"), "violations")
    return review.violations(i, rules).union(twice)


# --- usage -----------------------------------------------------------------------------------------------------------


@query(f"""WITH n AS ({NODE_RUNS_SQL}), b AS (SELECT * FROM n WHERE status = 'success' AND node_type IN ('llm', 'embedding'))
SELECT task_id, sum(coalesce(model_call_count, 1))::BIGINT AS calls, sum(input_tokens)::BIGINT AS input_tokens, coalesce(sum(output_tokens) FILTER (node_type = 'llm'), 0)::BIGINT AS output_tokens, sum(cost)::DOUBLE AS cost,
  CASE WHEN count(cost) = 0 THEN 'unavailable' WHEN count(cost) < count(*) THEN 'partial' ELSE 'available' END AS cost_status FROM b GROUP BY task_id""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.totals(node_runs(spark, sf_dir), ["task_id"]).select("task_id", "calls", "input_tokens", "output_tokens", F.col("cost").cast("double").alias("cost"), "cost_status")


@query(f"""WITH n AS ({NODE_RUNS_SQL}) SELECT concat_ws('/', coalesce(provider, 'unknown'), coalesce(model, 'unknown'), 'unconfigured') AS pricing, count(*) AS runs, sum(cost)::DOUBLE AS cost
FROM n WHERE status = 'success' AND node_type IN ('llm', 'embedding') GROUP BY 1""")
def pricing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.pricing_groups(node_runs(spark, sf_dir)).withColumn("cost", F.col("cost").cast("double"))


@query(f"""WITH n AS ({NODE_RUNS_SQL}), b AS (SELECT *, sum(coalesce(model_call_count, 1)) OVER w AS calls, sum(input_tokens + output_tokens) OVER w AS tokens, count(cost) OVER w AS p, count(*) OVER w AS a FROM n
  WHERE status = 'success' AND node_type IN ('llm', 'embedding') WINDOW w AS (PARTITION BY task_id ORDER BY run_id))
SELECT run_id, calls::BIGINT AS calls, tokens::BIGINT AS tokens, CASE WHEN p = 0 THEN 'unavailable' WHEN p < a THEN 'partial' ELSE 'available' END AS cost_status,
  CASE WHEN calls >= 20 THEN 'max_calls' WHEN tokens >= 1000 THEN 'token_budget' END AS stop FROM b""")
def running_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.running(node_runs(spark, sf_dir), "task_id", "run_id", 20, 1000).select("run_id", "calls", "tokens", "cost_status", "stop")


@query(f"""WITH n AS ({NODE_RUNS_SQL}) SELECT node_type, count(*) AS trials, avg(latency_ms) AS mean_latency_ms, quantile_disc(latency_ms, 0.95)::BIGINT AS p95_latency_ms, avg(input_tokens) AS mean_input_tokens,
  avg(output_tokens) AS mean_output_tokens, round(avg(cost)::DOUBLE, 6) AS mean_cost, count(DISTINCT provider) = 1 AS one_currency FROM n GROUP BY node_type""")
def telemetry_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.telemetry(node_runs(spark, sf_dir).withColumnRenamed("provider", "currency"), ["node_type"]).withColumn("mean_cost", F.round("mean_cost", 6))


@query(f"""WITH n AS ({NODE_RUNS_SQL}) SELECT run_id, CAST((input_tokens * 15::BIGINT + output_tokens * 25::BIGINT + 5) // 10 AS DOUBLE) / 1000000 AS cost FROM n""")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = lambda s: F.lit(s).cast("decimal(12,6)")
    return node_runs(spark, sf_dir).select("run_id", numbers.cost(F.col("input_tokens"), F.col("output_tokens"), price("1.5"), price("2.5")).cast("double").alias("cost"))


# --- evaluation ------------------------------------------------------------------------------------------------------

PAIRS = f"""t AS ({TRUTH_SQL}), p AS ({PREDICTED_SQL}), c AS (SELECT p.*, gt_id, sink_line, t.start_line AS ts, t.end_line AS te, sink_line BETWEEN p.start_line AND p.end_line AS covers,
  CASE WHEN p.end_line < p.start_line OR t.end_line < t.start_line THEN 0 ELSE greatest(0, least(p.end_line, t.end_line) - greatest(p.start_line, t.start_line) + 1)::DOUBLE / (t.end_line - t.start_line + 1) END AS overlap
  FROM p JOIN t ON p.language = t.language AND p.path = t.path AND p.category = t.category AND (t.category <> 'security' OR p.cwe_id = t.cwe_id) WHERE t.vulnerable), e AS (SELECT * FROM c WHERE covers OR overlap >= 0.5)"""


@query(f"WITH {PAIRS} SELECT prediction_index, gt_id, covers, round(overlap, 9) AS overlap FROM e")
def interval_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.candidates(predicted_spans(spark, sf_dir), truth_spans(spark, sf_dir)).select("prediction_index", "gt_id", "covers", F.round("overlap", 9).alias("overlap"))


@query()
def max_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.matched(evaluate.candidates(predicted_spans(spark, sf_dir), truth_spans(spark, sf_dir)))


@query()
def prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = predicted_spans(spark, sf_dir), truth_spans(spark, sf_dir)
    m = evaluate.matched(evaluate.candidates(p, t), ["language"])
    return evaluate.evaluation(p, t, m, ["language"])


#: Every matching of a key, grown by one prediction at a time in the order o: how many labels the best of each step takes.
def _growing(order: str) -> str:
    return f"""k AS (SELECT language, path, category, CASE WHEN category = 'security' THEN cwe_id ELSE '' END AS cwe, prediction_index, {order} AS o, list(gt_id ORDER BY gt_id) AS gts FROM e GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY language, path, category, cwe ORDER BY o, prediction_index) AS i FROM k),
g AS (SELECT language, path, category, cwe, 0::BIGINT AS i, 0::BIGINT AS o, []::BIGINT[] AS used FROM i WHERE i = 1
  UNION SELECT g.language, g.path, g.category, g.cwe, i.i, i.o, u FROM (SELECT g.*, i.i AS ni, i.o AS no, unnest(list_concat([used], list_transform(list_filter(gts, lambda x: NOT list_contains(used, x)), lambda x: list_sort(list_append(used, x))))) AS u
    FROM g JOIN i ON g.language = i.language AND g.path = i.path AND g.category = i.category AND g.cwe = i.cwe AND i.i = g.i + 1) g JOIN i ON g.language = i.language AND g.path = i.path AND g.category = i.category AND g.cwe = i.cwe AND i.i = g.ni),
best AS (SELECT language, path, category, cwe, i, o, max(len(used)) AS n FROM g GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {PAIRS}, {_growing('prediction_index')} SELECT language, path, sum(n)::BIGINT AS matched FROM (SELECT language, path, category, cwe, max(n) AS n FROM best GROUP BY ALL) GROUP BY ALL HAVING sum(n) > 0""")
def matching_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings of each file a largest matching takes; the SQL tries every matching."""
    found = evaluate.matched(evaluate.candidates(predicted_spans(spark, sf_dir), truth_spans(spark, sf_dir)), ["language", "path"])
    return found.groupBy("language", "path").agg(F.count("*").alias("matched"))


@query(f"""WITH RECURSIVE {PAIRS}, pl AS (SELECT DISTINCT language, path, prediction_index, rank() OVER (PARTITION BY path, language ORDER BY prediction_index) - 1 AS place FROM p),
{_growing('(SELECT place FROM pl WHERE pl.prediction_index = e.prediction_index AND pl.language = e.language AND pl.path = e.path)')}, n AS (SELECT language, count(*) AS truth FROM t WHERE vulnerable GROUP BY language), ks AS (SELECT unnest([1, 2, 5])::INT AS k),
tp AS (SELECT language, k, sum(n) AS tp FROM (SELECT language, path, category, cwe, k, max(n) AS n FROM best, ks WHERE i > 0 AND o < k GROUP BY ALL) GROUP BY ALL)
SELECT language, k, round(coalesce(tp, 0)::DOUBLE / truth, 9) AS recall FROM n CROSS JOIN ks LEFT JOIN tp USING (language, k)""")
def recall_at_k_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the first predictions of each file, for all k from one matching; the SQL tries every matching of each prefix."""
    p = predicted_spans(spark, sf_dir)
    p = p.withColumn("position", F.rank().over(Window.partitionBy("path", "language").orderBy("prediction_index")) - 1)
    return evaluate.recall_by_prefix(p, truth_spans(spark, sf_dir), [1, 2, 5], ["language"]).withColumn("recall", F.round("recall", 9))


@query("""WITH s AS (SELECT l_returnflag AS variant, l_linestatus AS language, l_linenumber % 3 AS run, count(CASE WHEN l_quantity > 25 THEN 1 END)::DOUBLE / count(*) AS f1 FROM lineitem GROUP BY ALL),
r AS (SELECT variant, run, avg(f1) AS f1 FROM s GROUP BY ALL) SELECT variant, round(avg(f1), 9) AS f1_mean, round(stddev_pop(f1), 9) AS f1_std FROM r GROUP BY variant""")
def ablation_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = tables.table(spark, sf_dir, "lineitem")
    per = l.groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("language"), (F.col("l_linenumber") % 3).alias("run")).agg((F.count_if(F.col("l_quantity") > 25) / F.count("*")).alias("f1"))
    return evaluate.macro(per, ["variant"], "run", ["f1"]).select("variant", F.round("f1_mean", 9).alias("f1_mean"), F.round("f1_std", 9).alias("f1_std"))


# --- owners, events, parsing -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC")
def owner_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One owner's items, newest first."""
    return tables.table(spark, sf_dir, "orders").where("o_custkey = 7").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "o_orderdate")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def owner_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return tables.table(spark, sf_dir, "customer").join(owned, "c_custkey", "left_semi").select("c_custkey")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("started", "scanned", "note", "completed", "failed", "note", "cancelled")]), (F.col("event_id") % 7 + 1).cast("int"))
    return tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), kind.alias("event_type"), (F.col("event_id") % 101).cast("int").alias("progress"), F.col("ts").alias("created_at"))


EVENTS_SQL = "e AS (SELECT event_id AS id, user_id AS task_id, ['started', 'scanned', 'note', 'completed', 'failed', 'note', 'cancelled'][(event_id % 7 + 1)::INT] AS event_type, event_id % 101 AS progress, ts AS created_at FROM events)"


@query(f"WITH {EVENTS_SQL} SELECT id, event_type FROM e WHERE id > 1234 ORDER BY id LIMIT 100")
def event_replay_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.page_after(_events(spark, sf_dir), 1234, 100).select("id", "event_type")


@query(f"WITH {EVENTS_SQL} SELECT id, task_id FROM e WHERE created_at >= (SELECT max(created_at) FROM e) - INTERVAL 7 DAYS")
def event_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return streams.retained(e, e.agg(F.max("created_at").alias("now")), 7).select("id", "task_id")


@query(f"WITH {EVENTS_SQL} SELECT id, max(progress) OVER (PARTITION BY task_id ORDER BY id)::INT AS shown FROM e")
def event_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.running_progress(_events(spark, sf_dir)).select("id", "shown")


FSM_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY id) AS i FROM e), s AS (
  SELECT task_id, 0::BIGINT AS i, 'pending' AS state FROM (SELECT DISTINCT task_id FROM e)
  UNION ALL SELECT s.task_id, n.i, CASE WHEN s.state = 'pending' AND event_type = 'started' THEN 'scanning' WHEN s.state = 'scanning' AND event_type = 'scanned' THEN 'reviewing' WHEN s.state = 'reviewing' AND event_type = 'completed' THEN 'success'
    WHEN s.state IN ('pending', 'scanning', 'reviewing') AND event_type IN ('failed', 'cancelled') THEN event_type ELSE s.state END FROM s JOIN n ON n.task_id = s.task_id AND n.i = s.i + 1)
SELECT task_id, arg_max(state, s.i) AS state, (SELECT max(progress) FROM e WHERE e.task_id = s.task_id)::INT AS progress, max(s.i) AS n_events FROM s GROUP BY task_id"""


@query(FSM_SQL)
def task_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.task_states(_events(spark, sf_dir))


@query(FSM_SQL)
def live_task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from a stream that is stopped half-way and started again: the last update of each task."""
    base = shared_folder(spark, "live")
    e = _events(spark, sf_dir).drop("created_at")
    half = e.agg(F.percentile_approx("id", 0.5)).first()[0]
    for part in (F.col("id") <= half, F.col("id") > half):
        e.where(part).write.mode("append").parquet(f"{base}/events")
        tasks.run(streams.state_stream(spark.readStream.schema(e.schema).parquet(f"{base}/events")), f"{base}/checkpoint", f"{base}/sink", "update")
    told = spark.read.parquet(f"{base}/sink").groupBy("task_id").agg(F.max_by(F.struct("state", "progress", "n_events"), "n_events").alias("x"))
    return told.select("task_id", "x.*")


@query("SELECT DISTINCT ON (user_id, k) user_id, json_extract_string(props, '$.k') AS k, event_id AS id FROM events ORDER BY user_id, k, event_id")
def idempotent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("idempotency_key"), F.col("event_id").alias("id"))
    return streams.once(r, "id").select("user_id", F.col("idempotency_key").alias("k"), "id")


@query("SELECT event_id AS id, CASE WHEN event_id % 4 <> 3 THEN json_extract_string(props, '$.k')::DOUBLE END AS k FROM events")
def json_extract_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON inside free text: fenced, between words, bare, and broken."""
    from pyspark.sql import types as T

    e = tables.table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\ndone"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("so "), "props", F.lit(" it is"))).when(F.col("event_id") % 4 == 2, F.col("props")).otherwise(F.concat(F.lit("{"), "props"))
    return e.select(F.col("event_id").alias("id"), text.parsed_json(said, T.StructType([T.StructField("k", T.IntegerType())]), ["k"])["k"].cast("double").alias("k"))


PYTHON_SOURCE = "class C{n}(Base):\n    def run(self, x):\n        return helper(x)\n\ndef helper(x):\n    return x\n"


@query(r"""WITH f AS (SELECT doc_id FROM documents)
SELECT doc_id AS file_id, concat('C', doc_id, '.run') AS source, 'helper' AS target, 'call' AS relation, 'resolved' AS resolution FROM f
UNION ALL SELECT doc_id, concat('C', doc_id), 'Base', 'extend', 'external' FROM f""")
def symbol_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a small Python module for each file, resolved within it."""
    source = F.replace(F.lit(PYTHON_SOURCE), F.lit("{n}"), F.col("file_id").cast("string"))
    f = files(spark, sf_dir).select("file_id", "path", F.lit("python").alias("language"), source.alias("text"))
    rows = chunking.parsed(f)
    symbols = chunking.symbols_of(rows).withColumn("symbol_id", F.col("file_id") * 100 + F.col("start_line"))
    references = rows.where("kind = 'reference'").select("file_id", "source", "target", "relation", "confidence")
    return indexing.resolved(references, symbols).select("file_id", "source", "target", "relation", "resolution")


@query("""WITH d AS (SELECT doc_id AS file_id, doc_id % 200 + 52 AS n FROM documents), w AS (SELECT *, CASE WHEN n > 120 THEN range(0, n - 10, 110) ELSE [0] END AS offsets FROM d),
p AS (SELECT *, unnest(offsets) AS a FROM w) SELECT file_id, 'python' AS language, concat('f', file_id) AS symbol_name, (4 + a)::INT AS start_line, (CASE WHEN n > 120 THEN least(a + 120, n) ELSE n END + 3)::INT AS end_line,
CASE WHEN n > 120 THEN a // 110 + 1 END::DOUBLE AS split_part, concat('import os,import m', file_id % 7) AS imports FROM p""")
def parsed_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source around each document's words by the table function: definitions over 120 lines in parts, imports, files
    without an extension whose language is found in their text."""
    chunking.register(spark)
    words = F.concat(F.lit('    """'), F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]+", " "), F.lit('"""'))
    source = F.concat(
        F.lit("import os\nimport m"), F.col("file_id") % 7, F.lit("\n\ndef f"), "file_id", F.lit("():\n"), words, F.lit("\n"), F.expr("repeat('    x = 1\n', int(file_id % 200 + 50))")
    )
    made = files(spark, sf_dir).select("file_id", F.concat(F.lit("src/f"), "file_id", F.when(F.col("file_id") % 3 == 0, "").otherwise(".py")).alias("path"), source.alias("source"))
    return spark.sql(
        "SELECT f.file_id, p.language, p.symbol_name, p.start_line, p.end_line, double(p.split_part) AS split_part, array_join(p.imports, ',') AS imports FROM {made} f, LATERAL parse_source(f.path, f.source) p WHERE p.kind = 'chunk'", made=made
    )


@query()
def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks and references of all files' own texts; the parser is that of the path, else of the file's language."""
    by_path = F.when(F.lower("path").endswith(".java"), "java").when(F.lower("path").endswith(".py"), "python").otherwise(F.coalesce("language", F.lit("")))
    rows = chunking.parsed(files(spark, sf_dir).withColumn("language", by_path))
    return rows.select("file_id", "path", "language", "kind", "symbol_type", "symbol_name", "start_line", "end_line", "source", "target", "relation", "error", "content_hash")


@query(f"""WITH i AS ({ISSUES_SQL}), a AS (SELECT *, concat('r', issue_id % 9) AS rule_id, 1 + issue_id % 2 AS round FROM i WHERE fingerprint <> ''),
d AS (SELECT fingerprint, round, arg_max(decision, (pos, decision)) AS decision FROM a WHERE decision IS NOT NULL GROUP BY ALL),
m AS (SELECT a.issue_id, a.path, a.rule_id, a.round, coalesce(d.decision, 'fail') AS said FROM a LEFT JOIN d ON a.fingerprint = d.fingerprint AND a.round = d.round)
SELECT issue_id, round, 'verified' AS outcome FROM m WHERE round = 1 AND said <> 'fail' UNION ALL
SELECT issue_id, round, CASE WHEN said = 'fail' THEN 'rejected' ELSE 'verified' END FROM m WHERE round = 2 AND EXISTS (SELECT 1 FROM m x WHERE x.round = 1 AND x.said = 'fail' AND x.path = m.path AND x.rule_id = m.rule_id)""")
def workflow_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of review with decisions from the table."""
    i = issues(spark, sf_dir).where("fingerprint <> ''").withColumn("rule_id", F.concat(F.lit("r"), F.col("issue_id") % 9)).withColumn("round", 1 + F.col("issue_id") % 2)
    d = i.where("decision IS NOT NULL").select("fingerprint", "round", "pos", "decision", F.lit("said").alias("reason"))
    return workflow.review_rounds(i.drop("decision"), d.drop("round_")).select("issue_id", "round", "outcome")


@query(f"WITH {FILES} SELECT file_id, unnest(CASE WHEN file_id % 2 = 0 THEN [file_id, file_id + 1] ELSE [file_id] END) AS chunk_id FROM files")
def issue_chunk_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select(F.col("file_id").alias("issue_id"), F.when(F.col("file_id") % 2 == 0, F.array("file_id", F.col("file_id") + 1, "file_id")).otherwise(F.array("file_id")).alias("source_chunk_ids"))
    return projections.issue_chunks(f).withColumnRenamed("issue_id", "file_id")


@query(f"WITH {SAFE} SELECT DISTINCT file_id FROM checked WHERE portable AND NOT excluded AND regexp_matches(lower(client_path), '\\.(py|java)$') AND size <= 1048576")
def pending_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("path", F.concat_ws("#", "file_id", "client_path"))
    manifest = f.select("path", scan.manifest_status(F.col("client_path"), F.col("size")).alias("status"))
    return projections.pending_uploads(f, manifest).select("file_id")


@query(f"WITH i AS ({ISSUES_SQL}) SELECT DISTINCT category FROM i WHERE category IS NOT NULL ORDER BY category")
def issue_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.categories(issues(spark, sf_dir))


@query(f"""WITH i AS ({ISSUES_SQL}), l AS (SELECT task_id, coalesce(risk_level, 'Low') AS k, count(*) AS n FROM i GROUP BY ALL), c AS (SELECT task_id, coalesce(category, 'unknown') AS k, count(*) AS n FROM i GROUP BY ALL)
SELECT task_id, string_agg(k || '=' || n, ',' ORDER BY k) AS levels, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM c WHERE c.task_id = l.task_id) AS categories FROM l GROUP BY task_id""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps of a report, written as texts."""
    told = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return projections.report_totals(issues(spark, sf_dir), "task_id").select("task_id", told("by_level").alias("levels"), told("by_category").alias("categories"))


@query(f"WITH {CLASSIFIED} SELECT file_id, path, lines::BIGINT AS lines, 1 AS symbols FROM judged")
def file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("lines", text.lines_scanned(F.col("text")))
    chunks = f.select("file_id", F.col("path").alias("symbol_name"), F.lit(None).cast("string").alias("qualified_name"))
    out = projections.file_summaries(chunks.union(chunks), f)
    return out.select("file_id", "path", "lines", projections.state_summary({"symbols": F.col("symbols")})["symbols"].alias("symbols"))
