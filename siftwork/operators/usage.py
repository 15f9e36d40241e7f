"""Usage and cost of runs: totals, pricing groups, running sums, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _billed(runs: DataFrame) -> DataFrame:
    return runs.where((F.col("status") == "success") & F.col("node_type").isin("llm", "embedding"))


def totals(runs: DataFrame, by: list[str]) -> DataFrame:
    """Calls and tokens of successful model runs; output tokens of language models only; cost and its status."""
    priced = F.col("cost").isNotNull()
    out = _billed(runs).groupBy(*by).agg(
        F.sum(F.coalesce("model_call_count", F.lit(1))).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.coalesce(F.sum(F.when(F.col("node_type") == "llm", F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
        F.sum("cost").alias("cost"), F.count_if(priced).alias("priced"), F.count("*").alias("runs"),
    )
    status = F.when(F.col("priced") == 0, "unavailable").when(F.col("priced") < F.col("runs"), "partial").otherwise("available")
    return out.withColumn("cost_status", status)


def pricing_groups(runs: DataFrame, by: list[str] = (), version: str | None = None) -> DataFrame:
    """Runs and cost by provider/model/version; version: the column of the pricing version, if there is one."""
    priced_by = F.coalesce(F.col(version), F.lit("unconfigured")) if version else F.lit("unconfigured")
    key = F.concat_ws("/", F.coalesce("provider", F.lit("unknown")), F.coalesce("model", F.lit("unknown")), priced_by)
    return _billed(runs).groupBy(*by, key.alias("pricing")).agg(F.count("*").alias("runs"), F.sum("cost").alias("cost"))


def running(runs: DataFrame, by: str, order: str, max_calls: int, max_tokens: int) -> DataFrame:
    """runs with calls, tokens and cost so far, the cost status so far, and what stops the task before the next call."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    b = _billed(runs)
    b = b.withColumn("calls", F.sum(F.coalesce("model_call_count", F.lit(1))).over(upto)).withColumn("tokens", F.sum(F.col("input_tokens") + F.col("output_tokens")).over(upto)).withColumn("cost_so_far", F.sum("cost").over(upto))
    priced, all_ = F.count("cost").over(upto), F.count("*").over(upto)
    b = b.withColumn("cost_status", F.when(priced == 0, "unavailable").when(priced < all_, "partial").otherwise("available"))
    return b.withColumn("stop", F.when(F.col("calls") >= max_calls, "max_calls").when(F.col("tokens") >= max_tokens, "token_budget"))


def combined(first: Column, second: Column) -> Column:
    """The usage struct (calls, tokens, cost, available) of two calls; the cost counts if both have one."""
    both = first["available"] & second["available"]
    return F.struct((first["calls"] + second["calls"]).alias("calls"), (first["tokens"] + second["tokens"]).alias("tokens"), F.when(both, first["cost"] + second["cost"]).alias("cost"), both.alias("available"))


def telemetry(trials: DataFrame, by: list[str]) -> DataFrame:
    """Means, the nearest-rank 95th percentile of latency, and whether all trials use one currency."""
    return trials.groupBy(*by).agg(
        F.count("*").alias("trials"), F.avg("latency_ms").alias("mean_latency_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").cast("long").alias("p95_latency_ms"),
        F.avg("input_tokens").alias("mean_input_tokens"), F.avg("output_tokens").alias("mean_output_tokens"), F.avg("cost").cast("double").alias("mean_cost"), (F.count_distinct("currency") == 1).alias("one_currency"),
    )
