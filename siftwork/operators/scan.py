"""Scan operators: classification of files, coverage, language and priority statistics, manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions import numbers, paths
from ..session import ship


def classify(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """files with scan_language, reason (null if included) and priority (null if not)."""
    return files.withColumn("reason", paths.exclusion_reason(F.col(path), F.col(size))).withColumn("scan_language", paths.language_of(F.col(path))).withColumn(
        "priority", F.when(F.col("reason").isNull(), paths.priority_of(F.col(path)))
    )


def reconcile(registered: DataFrame, physical: DataFrame) -> DataFrame:
    """(path, status, reason, registered, discovered, ...) of registered paths against the files found.

    Registered and found: included or skipped with its reason. Not found: failed, FILE_MISSING. Not registered: skipped,
    UNREGISTERED_FILE. physical: path, size, lines.
    """
    r = registered.select("path").distinct().withColumn("registered", F.lit(True))
    p = classify(physical).withColumn("discovered", F.lit(True))
    out = r.join(p, "path", "full_outer").withColumn("registered", F.coalesce("registered", F.lit(False))).withColumn("discovered", F.coalesce("discovered", F.lit(False)))
    reason = F.when(~F.col("discovered"), "FILE_MISSING").when(~F.col("registered"), "UNREGISTERED_FILE").otherwise(F.col("reason"))
    out = out.withColumn("reason", reason)
    status = F.when(F.col("reason") == "FILE_MISSING", "failed").when(F.col("reason").isNull(), "included").otherwise("skipped")
    return out.withColumn("status", status).withColumn("priority", F.when(F.col("status") == "included", F.col("priority")))


def applied(project_files: DataFrame, scan: DataFrame) -> DataFrame:
    """project_files (path, ...) with the scan's outcome; a file that the scan left out failed with SCANNER_OMITTED."""
    s = scan.select("path", F.col("status").alias("scan_status"), F.col("priority").alias("scan_priority"), F.col("reason").alias("scan_reason"))
    out = project_files.join(s, "path", "left")
    return out.withColumn("scan_reason", F.when(F.col("scan_status").isNull(), "SCANNER_OMITTED").otherwise(F.col("scan_reason"))).withColumn("scan_status", F.coalesce("scan_status", F.lit("failed")))


def coverage(scan: DataFrame) -> DataFrame:
    """One row of counters; the rate is 1 where nothing is registered."""
    r = F.col("registered")
    return scan.agg(
        F.count_if(r).alias("registered"), F.count_if("discovered").alias("discovered"), F.count_if(r & (F.col("status") == "included")).alias("included"),
        F.count_if(r & (F.col("status") == "skipped")).alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"),
    ).withColumn("coverage", numbers.ratio(F.col("included"), F.col("registered"), 1.0))


def language_stats(included: DataFrame, by: list[str] = ()) -> DataFrame:
    return included.groupBy(*by, F.col("scan_language").alias("language")).agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("size").alias("bytes"))


def main_language(stats: DataFrame, by: list[str] = ()) -> DataFrame:
    """The language with most files; of equals the one that sorts first."""
    return stats.groupBy(*by).agg(F.min(F.struct((-F.col("files")).alias("n"), "language"))["language"].alias("main_language"))


def first_main_language(manifest: DataFrame, by: list[str]) -> DataFrame:
    """The language with most files; of equals the one that the manifest names first. manifest: by, language, position."""
    per = manifest.where("language is not null").groupBy(*by, "language").agg(F.count("*").alias("n"), F.min("position").alias("at"))
    return per.groupBy(*by).agg(F.max_by("language", F.struct("n", -F.col("at"))).alias("main_language"))


def priority_histogram(included: DataFrame) -> DataFrame:
    return included.agg(*[F.count_if(F.col("priority") == p).alias(p) for p in ("high", "medium", "low")])


def path_safety(files: DataFrame, path: str = "client_path") -> DataFrame:
    p = F.col(path)
    return files.withColumn("safe_relative", paths.safe_relative(p)).withColumn("portable", paths.portable(p)).withColumn("excluded", paths.excluded_in_upload(p))


def manifest_status(path: Column, size: Column) -> Column:
    """pending for a file to upload, else why not."""
    return (
        F.when(~paths.portable(path), "unsafe").when(paths.excluded_in_upload(path), "excluded").when(paths.language_of(path).isNull(), "unsupported")
        .when(size > paths.MAX_FILE_BYTES, "too_large").otherwise("pending")
    )


def manifest_rollup(manifest: DataFrame, by: list[str]) -> DataFrame:
    """Files and bytes of each manifest, declared and by status."""
    pending = F.col("status") == "pending"
    return manifest.groupBy(*by).agg(
        F.count("*").alias("files"), F.count_if(pending).alias("accepted"), F.count_if(~pending).alias("rejected"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("declared_bytes"), F.coalesce(F.sum(F.when(pending, F.col("size"))), F.lit(0)).alias("accepted_bytes"),
    )


def duplicate_paths(manifest: DataFrame, by: list[str], path: str = "client_path") -> DataFrame:
    """Paths of a manifest that differ in case at most."""
    return manifest.groupBy(*by, F.lower(path).alias("folded_path")).agg(F.count("*").alias("copies")).where("copies > 1")


def upload_rejection(mime: Column, declared: Column, facts: Column) -> Column:
    """Why uploaded bytes are refused, or null: media type, size, binary content. facts: what byte_facts() gives."""
    media = F.lower(F.split(F.coalesce(mime, F.lit("")), ";")[0])
    allowed = (media == "") | media.startswith("text/") | media.isin("application/octet-stream", "application/x-python-code", "application/java", "application/x-java-source")
    return F.when(~allowed, "UNSUPPORTED_MEDIA_TYPE").when(facts["size"] != declared, "SIZE_MISMATCH").when(facts["size"] > paths.MAX_FILE_BYTES, "SINGLE_FILE_SIZE_EXCEEDED").when(facts["binary"], "BINARY_FILE")


def capped(items: DataFrame, by: list[str], order: str, cost: str, cap: int) -> DataFrame:
    """items with accepted: in order, each that still fits under cap is taken, those that do not are passed over.

    What is taken depends on all that was taken before, so the rows of a group pass one after the other through one task;
    they are sorted by Spark, which spills, and only the sum so far is held. Costs are not negative:
    rows that cost more than cap alone do not go there. Rows of equal order go by their other columns; a row without a cost is neither taken nor refused (null).
    """
    ship(items.sparkSession)
    rest = [c for c in items.columns if c not in by and c != order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used = None, 0
        for batch in batches:
            taken, costs = [], batch.column(cost).to_pylist()
            for key, x in zip(zip(*[batch.column(c).to_pylist() for c in by], strict=True), costs, strict=True):
                if key != group:
                    group, used = key, 0
                fits = None if x is None else used + x <= cap
                used += x if fits else 0
                taken.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], [*batch.schema.names, "accepted"])

    schema = StructType([*items.schema.fields, StructField("accepted", BooleanType())])
    large = F.coalesce(F.col(cost) > cap, F.lit(False))
    passed = items.where(~large).repartition(*by).sortWithinPartitions(*by, order, *rest).mapInArrow(run, schema)
    return passed.unionByName(items.where(large).withColumn("accepted", F.lit(False))).select(*by, order, *rest, "accepted")
