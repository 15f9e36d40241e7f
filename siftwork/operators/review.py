"""Review operators: evidence checks, critic decisions, duplicate findings, statistics, pages, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text

LEVELS = ("High", "Medium", "Low")


def verified(issues: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """issues with path_ok, lines_ok, evidence_ok, chunks_ok and evidence_status.

    issues: issue_id, project, path, start_line, end_line, evidence, source_chunk_ids; files: project, path, text;
    chunks: project, chunk_id.
    """
    f = files.select("project", "path", text.lines_cited(F.col("text")).alias("_lines"), F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")).alias("_text"))
    out = issues.join(f, ["project", "path"], "left")
    path_ok = F.col("_lines").isNotNull()
    lines_ok = path_ok & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") <= F.col("_lines"))
    cited = F.array_join(F.slice(F.split("_text", "\n", -1), F.when(lines_ok, F.col("start_line")).otherwise(1), F.when(lines_ok, F.col("end_line") - F.col("start_line") + 1).otherwise(0)), "\n")
    wanted = text.evidence_text(F.col("evidence"))
    out = out.withColumn("path_ok", path_ok).withColumn("lines_ok", F.coalesce(lines_ok, F.lit(False))).withColumn("evidence_ok", F.coalesce(lines_ok & (wanted != "") & cited.contains(wanted), F.lit(False)))
    owned = chunks.select("project", "chunk_id", F.lit(True).alias("_own"))
    each = issues.select("issue_id", "project", F.explode(F.array_distinct("source_chunk_ids")).alias("chunk_id")).join(owned, ["project", "chunk_id"], "left")
    each = each.groupBy("issue_id").agg(F.bool_and(F.col("_own").isNotNull()).alias("chunks_ok"))
    out = out.join(each, "issue_id", "left").withColumn("chunks_ok", F.coalesce("chunks_ok", F.lit(False))).drop("_lines", "_text")
    return out.withColumn("evidence_status", F.when(F.col("path_ok") & F.col("lines_ok") & F.col("evidence_ok") & F.col("chunks_ok"), "passed").otherwise("failed"))


def merged(issues: DataFrame, decisions: DataFrame, round_: int = 1, max_rounds: int = 2) -> DataFrame:
    """issues with decision, reason, outcome and needs_human_review; of several decisions on a fingerprint the last counts.

    No decision fails. pass and uncertain are verified, uncertain for a human; fail is retried while rounds are left.
    """
    last = decisions.groupBy("fingerprint").agg(F.max(F.struct("pos", "decision", "reason")).alias("_d"))
    out = issues.join(last, "fingerprint", "left").withColumn("decision", F.coalesce("_d.decision", F.lit("fail"))).withColumn("reason", F.when(F.col("_d").isNull(), "missing_critic_decision").otherwise(F.col("_d.reason"))).drop("_d")
    outcome = F.when(F.col("decision").isin("pass", "uncertain"), "verified").otherwise("retry" if round_ < max_rounds else "rejected")
    return out.withColumn("outcome", outcome).withColumn("needs_human_review", F.col("decision") == "uncertain")


def first_of_each(issues: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first issue of each fingerprint; issues without one are dropped."""
    w = Window.partitionBy(*by, "fingerprint").orderBy(*order)
    return issues.where("fingerprint <> ''").withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def last_of_each(existing: DataFrame, incoming: DataFrame, by: list[str]) -> DataFrame:
    """existing and incoming by fingerprint: the last row counts, at the first one's position (place).

    Existing rows without a fingerprint share one slot; incoming ones without are dropped. Both have pos.
    """
    rows = existing.withColumn("_side", F.lit(0)).unionByName(incoming.where("fingerprint <> ''").withColumn("_side", F.lit(1)))
    same = Window.partitionBy(*by, "fingerprint")
    late = same.orderBy(F.desc("_side"), F.desc("pos"))
    rows = rows.withColumn("place", F.min(F.struct("_side", "pos")).over(same)).withColumn("_rank", F.row_number().over(late)).where("_rank = 1")
    return rows.withColumn("place_side", F.col("place._side")).withColumn("place", F.col("place.pos")).drop("_rank", "_side")


def failed_again(issues: DataFrame, failed: DataFrame) -> DataFrame:
    """The issues whose path and rule failed before."""
    return issues.join(failed.select("path", "rule_id").distinct(), ["path", "rule_id"], "left_semi")


def _levels() -> list[Column]:
    level = F.coalesce("risk_level", F.lit("Low"))
    return [*[F.count_if(level == x).alias(x.lower()) for x in LEVELS], F.count("*").alias("total")]


def severity_stats(issues: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts by level; no level counts as Low, an unknown one in the total only."""
    return issues.groupBy(*by).agg(*_levels())


def category_histogram(issues: DataFrame, by: list[str] = ()) -> DataFrame:
    return issues.groupBy(*by, F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("issues"))


def issue_projection(issues: DataFrame, issue_id: int | None = None, owner: int | None = None) -> DataFrame:
    """What clients read of issues, or of one: without an owner those of everybody, in no order of its own."""
    out = issues if issue_id is None else issues.where(F.col("issue_id") == issue_id)
    out = out if owner is None else out.where(F.col("user_id") == owner)
    return out.select("issue_id", "task_id", "title", "path", "category", "risk_level", "fingerprint")


def report_projection(reports: DataFrame, task_id: int, owner: int | None = None) -> DataFrame:
    """What clients read of a task's report; with an owner only if the task is theirs."""
    out = reports.where(F.col("task_id") == task_id)
    out = out if owner is None else out.where(F.col("user_id") == owner)
    return out.select("task_id", "high", "medium", "low", "total")


def issue_page(issues: DataFrame, order: list[Column], risk: str | None = None, category: str | None = None, words: str = "", page: int = 1, size: int = 15) -> DataFrame:
    """One page of the issues that match a level, a category and words in title, path or fingerprint."""
    out = issues
    if risk:
        out = out.where(F.col("risk_level") == risk)
    if category:
        out = out.where(F.col("category") == category)
    if words:
        low = F.lit(words.lower())
        out = out.where(F.lower("title").contains(low) | F.lower("path").contains(low) | F.lower("fingerprint").contains(low))
    return out.orderBy(*order).offset((page - 1) * size).limit(size)


#: The marks of risk levels in a report, and that of any other (fixed values).
MARKS, OTHER_MARK = {"High": "\U0001f534", "Medium": "\U0001f7e1", "Low": "\U0001f7e2"}, "\u26aa"


#: The sections of a report that hold issues.
VERIFIED, REJECTED = 8, 9


def _said(name: str, missing: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(missing))


def issue_markdown(number: Column) -> Column:
    """One issue as a block of a report."""
    mark = F.lit(OTHER_MARK)
    for level, sign in MARKS.items():
        mark = F.when(F.col("risk_level") == level, sign).otherwise(mark)
    facts = {
        "Category": _said("category", "?"), "Type": _said("issue_type", "?"), "Risk": _said("risk_level", "?"), "Rule": _said("rule_id", "N/A"), "CWE": _said("cwe_id", "N/A"),
        "File": F.concat(F.lit("`"), _said("path", "?"), F.lit("` L"), _said("start_line", "0"), F.lit("-L"), _said("end_line", "0")),
        "Confidence": F.concat(F.bround(F.coalesce("confidence", F.lit(0.0)) * 100, 0).cast("int").cast("string"), F.lit("%")),
        "Critic": _said("critic_decision", "pending"), "Human review": F.when(F.coalesce("needs_human_review", F.lit(False)), "Yes").otherwise("No"),
    }
    texts = {"Description": _said("description", ""), "Evidence": F.concat(F.lit("```\n"), _said("evidence", ""), F.lit("\n```")), "Reason": _said("reason", ""), "Suggestion": _said("suggestion", "")}
    head = F.concat(F.lit("### "), number.cast("string"), F.lit(". "), mark, F.lit(" "), _said("title", "Untitled"))
    listed = F.array_join(F.array(*[F.concat(F.lit(f"- **{name}:** "), c) for name, c in facts.items()]), "\n")
    return F.array_join(F.array(head, listed, *[F.concat(F.lit(f"**{name}:**\n\n"), c) for name, c in texts.items()]), "\n\n")


def numbered(issues: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Each different row of issues of a task once, with number: its place among the issues of its task and verdict.

    Rows are shuffled once, by task; there one sort brings equal rows together and gives the order. It spills. What is
    derived from the columns of an issue is better added afterwards, so that it is neither shuffled nor sorted.
    """
    # Not the verdict itself: a filter on that would come before the shuffle, which then served one reader only.
    rows = issues.where(F.col(by).isNotNull()).withColumn("_side", F.coalesce(F.col("verified").cast("int"), F.lit(-1))).repartition(by)
    first = [by, "_side", *order]
    same = Window.partitionBy(*first, *[c for c in issues.columns if c not in first]).orderBy(*order)
    once = rows.withColumn("_again", F.row_number().over(same)).where("_again = 1").drop("_again")
    return once.withColumn("number", F.row_number().over(Window.partitionBy(by, "_side").orderBy(*order))).drop("_side")


def _parts_of(tasks: DataFrame, issues: DataFrame, by: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The parts of report_parts(): those of tasks, and those of single issues."""
    if "number" not in issues.columns:
        issues = issues.repartition(by).withColumn("number", F.row_number().over(Window.partitionBy(by, "verified").orderBy(order)))
    known = issues.join(tasks.select(by), by, "left_semi").where("verified is not null")
    blocks = known.select(by, F.when(F.col("verified"), VERIFIED).otherwise(REJECTED).alias("section"), "number", issue_markdown(F.col("number")).alias("text"))
    sums = ["high", "medium", "low", "total", "_passed", "_failed"]
    told = issues.groupBy(by, F.coalesce("category", F.lit("unknown")).alias("category")).agg(*_levels(), F.count_if("verified").alias("_passed"), F.count_if(~F.col("verified")).alias("_failed"))
    told = told.groupBy(by).agg(*[F.sum(c).alias(c) for c in sums], F.array_sort(F.collect_list(F.struct("category", F.col("total").alias("issues")))).alias("_kinds"))
    t = tasks.join(told, by, "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    shown, seconds = numbers.cost_display(F.col("cost"), F.col("cost_status")), F.coalesce(F.format_string("%.1f", numbers.elapsed_seconds(F.col("started_at"), F.col("finished_at"))), F.lit("N/A"))
    shown_seconds = F.when(F.col("started_at").isNull() | F.col("finished_at").isNull(), "N/A").otherwise(seconds)
    lines = lambda title, *rows: F.concat(F.lit(f"## {title}\n\n"), F.concat_ws("\n", *rows))
    listed = lambda name, value: F.concat(F.lit(f"- {name}: "), value.cast("string"))
    rows = [F.format_string(f"| {MARKS[level]} %s | %d |", F.lit(level.ljust(6)), count(F.col(level.lower()))) for level in LEVELS]
    passed, failed = count(F.col("_passed")), count(F.col("_failed"))
    title = lambda name, n: F.when(n > 0, F.format_string(f"## {name} (%d)", n))
    parts = [
        F.concat(F.lit("# Code Review Report \u2014 "), F.coalesce(F.nullif("project", F.lit("")), F.lit("Unnamed Project"))),
        F.concat_ws(
            "  \n", F.concat(F.lit("**Task ID:** "), F.col(by).cast("string")), F.concat(F.lit("**Generated:** "), F.date_format("generated_at", "yyyy-MM-dd HH:mm 'UTC'")),
            F.concat(F.lit("**Cost:** "), shown), F.concat(F.lit("**Duration:** "), shown_seconds, F.lit("s  ")),
        ),
        F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("## Summary\n\n"), F.col("summary"))),
        F.when(F.coalesce("stop_reason", F.lit("")) != "", F.concat(F.lit("> \u26a0\ufe0f **Stop reason:** "), F.col("stop_reason"))),
        lines("Severity", F.lit("| Level  | Count |"), F.lit("|--------|-------|"), *rows, F.format_string("| **Total** | **%d** |", count(F.col("total")))),
        F.when(F.size("_kinds") > 0, lines("Issue Types", F.transform("_kinds", lambda k: F.concat(F.lit("- **"), k["category"], F.lit("**: "), k["issues"].cast("string"))))),
        lines("Coverage", listed("Plan items", _said("plan_items", "N/A")), listed("Verified issues", passed), listed("Rejected issues", failed)),
        F.when(F.size("degradation") > 0, lines("Degradation", F.transform(F.array_sort(F.map_entries("degradation")), lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), e["value"])))),
        title("Verified Issues", passed), title("Rejected Issues", failed),
        lines(
            "Metrics", listed("LLM calls", count(F.col("calls"))), listed("Input tokens", F.format_number(count(F.col("input_tokens")), 0)), listed("Output tokens", F.format_number(count(F.col("output_tokens")), 0)),
            listed("Estimated cost", shown), F.concat(F.lit("- Elapsed: "), shown_seconds, F.lit("s")),
        ),
    ]
    frame = t.select(by, F.posexplode(F.array(*parts)).alias("section", "text")).where("text is not null").select(by, "section", F.lit(0).alias("number"), "text")
    return frame, blocks


def report_parts(tasks: DataFrame, issues: DataFrame, by: str = "task_id", order: str = "pos") -> DataFrame:
    """(by, section, number, text): the report of each task in parts, to be read by section and number with blank lines between.

    tasks: by, project, generated_at, summary, stop_reason, plan_items, degradation (map), calls, input_tokens,
    output_tokens, cost, cost_status, started_at, finished_at. issues: by, verified, what issue_markdown() reads, and
    order or the number that numbered() gave them. Sections: head, facts, summary, stop reason, severity, types, coverage,
    degradation, verified issues, rejected issues, metrics; those without content are left out. An issue is a part of its
    own (number from 1, below its section's title), so no value grows with a task; numbering sorts a task's issues, which
    spills. Issues without a task or without a verdict are in no part; a task without issues has all the others.
    """
    frame, blocks = _parts_of(tasks, issues, by, order)
    return frame.unionByName(blocks)


def report_markdown(tasks: DataFrame, issues: DataFrame, by: str = "task_id", order: str = "pos") -> DataFrame:
    """(by, markdown): the parts of report_parts() as one text a task, for reports that are exported as a file.

    A report is one value here; those of tasks too large for that are read or written by parts. Issues become text where
    numbering has brought them: no text is shuffled.
    """
    frame, blocks = (x.groupBy(by).agg(F.collect_list(F.struct("section", "number", "text")).alias(name)) for x, name in zip(_parts_of(tasks, issues, by, order), ("_frame", "_blocks"), strict=True))
    parts = F.array_sort(F.concat("_frame", F.coalesce("_blocks", F.array().cast("array<struct<section:int,number:int,text:string>>"))))
    return frame.join(blocks, by, "left").select(by, F.concat(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n"), F.lit("\n")).alias("markdown"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): for each rule the rows that break it; a rule that is null is not broken."""
    counted = rows.agg(*[F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counted.select(F.inline(pairs))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, count) of the keys that more than one row has."""
    return rows.groupBy(*keys).count().where("count > 1")


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


#: Rules of the stored and the parsed records for violations(): ranges and enumerations pass on null, filled columns do not.
RULES: dict[str, Callable[[], dict[str, Column]]] = {
    "chunks": lambda: {
        "start_line": F.col("start_line") > 0, "line_range": F.col("end_line") >= F.col("start_line"), "parse_confidence": F.col("parse_confidence").between(0, 1),
        "embedding_status": F.col("embedding_status").isin("pending", "ready", "failed", "keyword_only"), "index_status": F.col("index_status").isin("pending", "ready", "failed"),
    },
    "relations": lambda: {
        "confidence": F.col("confidence").between(0, 1), "relation_type": F.col("relation_type").isin("call", "import", "extend", "implement", "reference"),
        "resolution_status": F.col("resolution_status").isin("resolved", "unresolved", "external"),
    },
    "issues": lambda: {
        "line_range": F.col("end_line") >= F.col("start_line"), "security_cwe": (F.col("category") != "security") | _filled("cwe_id"), "confidence": F.col("confidence").between(0, 1),
        "category": F.col("category").isin("security", "bug", "performance", "maintainability"), "risk_level": F.col("risk_level").isin(*LEVELS),
    },
    "tasks": lambda: {
        "progress": F.col("progress").between(0, 100), **{c: F.col(c) >= 0 for c in ("llm_call_count", "input_tokens", "output_tokens")},
        "cost_status": F.col("cost_status").isin("available", "unavailable", "partial"),
    },
    "events": lambda: {"progress": F.col("progress").between(0, 100)},
    "parsed_chunks": lambda: {
        "placed": _filled("path") & _filled("language"), "line_range": F.coalesce((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")), F.lit(False)),
        "content": _filled("content"), "confidence": F.col("confidence").between(0, 1),
    },
    "parsed_references": lambda: {"ends": _filled("source") & _filled("target") & _filled("path"), "confidence": F.col("confidence").between(0, 1)},
}
