"""Column expressions over numbers: similarity, intervals, money, versions, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0; an error where the lengths differ."""
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double"))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(checked, F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms))


def overlap_ratio(start: Column, end: Column, true_start: Column, true_end: Column) -> Column:
    """Share of the closed interval true_start..true_end that start..end covers; 0 where either is inverted."""
    shared = F.least(end, true_end) - F.greatest(start, true_start) + 1
    return F.when((true_end < true_start) | (end < start) | (shared < 1), 0.0).otherwise(shared / (true_end - true_start + 1))


def covers(start: Column, end: Column, line: Column) -> Column:
    return line.between(start, end)


def cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Price of a call for prices per million tokens: six decimals, halves rounded up."""
    whole = input_tokens.cast("decimal(18,0)") * input_price.cast("decimal(12,6)") + output_tokens.cast("decimal(18,0)") * output_price.cast("decimal(12,6)")
    return F.round(whole * F.lit("0.000001").cast("decimal(7,6)"), 6).cast("decimal(12,6)")


def version(text: Column) -> Column:
    """Numbers of a dotted version, for comparison."""
    return F.transform(F.split(text, r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"\A\d+", 0).try_cast("int"), F.lit(0)))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two times, one decimal, from whole milliseconds."""
    return F.bround((F.unix_millis(end) - F.unix_millis(start)) / 1000.0, 1)


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.coalesce(1.0 / (k + rank), F.lit(0.0))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole as a double; empty where whole is 0."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part.cast("double") / whole.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def cost_display(amount: Column, status: Column) -> Column:
    """A cost for readers: exact, about, or that there is none."""
    shown = F.concat(F.lit("$"), amount.cast("decimal(18,6)").cast("string"))
    about = F.when(amount != 0, F.concat(F.lit("~"), shown)).otherwise("partial")
    return F.when((status == "available") & amount.isNotNull(), shown).when(status == "partial", F.coalesce(about, F.lit("partial"))).otherwise("cost_unavailable")


def iso_time(at: Column) -> Column:
    """A time in UTC as ISO 8601, microseconds only where there are some."""
    small = F.unix_micros(at) % 1000000
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(small != 0, F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("+00:00"))
