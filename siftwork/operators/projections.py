"""Projections that planners, recorders, clients and exports read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_summaries(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, path, language, lines, symbols): one row for each file; symbols: sorted distinct names of its chunks."""
    names = chunks.where("symbol_name IS NOT NULL").groupBy("file_id").agg(F.array_sort(F.collect_set(F.coalesce("qualified_name", "symbol_name"))).alias("symbols"))
    return files.select("file_id", "path", "language", "lines").join(names, "file_id", "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))


def state_summary(state: dict[str, Column]) -> Column:
    """struct of the sizes of a state's lists, 0 for null: what is recorded of a node's input and output."""
    return F.struct(*[F.when(c.isNull(), 0).otherwise(F.size(c)).alias(name) for name, c in state.items()])


def issue_chunks(issues: DataFrame) -> DataFrame:
    """(issue_id, chunk_id): the bridge from issues to their distinct source chunks."""
    return issues.select("issue_id", F.explode(F.array_distinct("source_chunk_ids")).alias("chunk_id"))


def pending_uploads(local: DataFrame, manifest: DataFrame) -> DataFrame:
    """The client's files whose manifest path is pending."""
    return local.join(manifest.where("status = 'pending'").select("path").distinct(), "path", "left_semi")


def categories(issues: DataFrame) -> DataFrame:
    return issues.select("category").where("category IS NOT NULL").distinct().orderBy("category")


def as_list(value: Column, kind: str) -> Column:
    """A list from a JSON value that may be a list or a single value; null gives an empty list."""
    single = F.from_json(F.concat(F.lit("["), value, F.lit("]")), f"array<{kind}>")
    return F.when(value.isNull(), F.array().cast(f"array<{kind}>")).when(F.trim(value).startswith("["), F.from_json(value, f"array<{kind}>")).otherwise(single)


def ordered_range(start: Column, end: Column) -> Column:
    """A line range whose end is not before its start."""
    return F.struct(start.alias("start_line"), F.greatest(start, end).alias("end_line"))


def exported(reports: DataFrame, kind: str, path: str) -> None:
    """Writes reports (task_id, markdown) as text, a folder for each task; markdown is the only kind."""
    if kind != "markdown":
        raise ValueError(f"the export format {kind} is not supported")
    reports.select("task_id", F.col("markdown").alias("value")).write.partitionBy("task_id").mode("overwrite").text(path)


def report_totals(issues: DataFrame, by: str) -> DataFrame:
    """(by, by_level, by_category): the maps of counts that a report stores."""
    count = lambda c, name: issues.groupBy(by, c.alias("k")).agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    return count(F.coalesce("risk_level", F.lit("Low")), "by_level").join(count(F.coalesce("category", F.lit("unknown")), "by_category"), by)
