"""Context assembly: chunks with their symbols and relations, within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def related(chunks: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """chunks (chunk_id, ...) with related: sorted "relation target" texts of the outbound relations of their symbols."""
    names = symbols.select(F.col("symbol_id").alias("target_symbol"), F.coalesce("qualified_name", "symbol_name").alias("_name"))
    hops = symbols.select("chunk_id", "symbol_id").join(relations.select(F.col("source_symbol").alias("symbol_id"), "target_symbol", "target", "relation"), "symbol_id").join(names, "target_symbol", "left")
    lines = hops.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "relation", F.coalesce("_name", "target")))).alias("related"))
    return chunks.join(lines, "chunk_id", "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))


def block_text(path: Column, start: Column, end: Column, symbol: Column, related_to: Column, content: Column) -> Column:
    """A chunk as text: where it stands, what it is, what it refers to, and its content."""
    head = F.format_string("### %s:%d-%d", path, start, end)
    return F.array_join(F.filter(F.array(head, F.concat(F.lit("symbol: "), symbol), F.when(F.size(related_to) > 0, F.concat(F.lit("related: "), F.array_join(related_to, ", "))), content), lambda x: x.isNotNull()), "\n")


def within_budget(ranked: DataFrame, by: str, rank: str, cost: str, budget: int) -> DataFrame:
    """ranked with kept and used: in order of rank, an item that would exceed the budget is left out, later ones are tried.

    A group is the at most 30 candidates of one query.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<used:bigint,kept:boolean>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x[cost] <= budget
        used = s["used"] + F.when(fits, x[cost]).otherwise(F.lit(0))
        return F.struct(used.cast("long").alias("used"), F.concat(s["out"], F.array(F.struct(used.cast("long").alias("used"), fits.alias("kept")))).alias("out"))

    rest = [c for c in ranked.columns if c not in (by, rank)]
    rows = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(rank, *rest))).alias("all")).withColumn("out", F.aggregate("all", start, step)["out"])
    return rows.select(by, F.inline(F.zip_with("all", "out", lambda x, o: F.struct(x[rank].alias(rank), *[x[c].alias(c) for c in rest], o["used"].alias("used"), o["kept"].alias("kept")))))


def assembled(kept: DataFrame, by: str, rank: str, block: str) -> DataFrame:
    """(by, context, blocks): one context text for each query, a blank line between its blocks."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct(rank, block))), lambda x: x[block])
    return kept.where("kept").groupBy(by).agg(F.array_join(blocks, "\n\n").alias("context"), F.count("*").alias("blocks"))
