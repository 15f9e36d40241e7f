"""Mixing sources to target weights with DataFrame functions only.

Sizes are words. Sources get targets by weight, bounded by a multiple of their own size, what is above shared again by
weight. The mix is made of blocks of equally many words: the Sainte-Lague method gives each source a whole number of
blocks by the highest quotients target/1, target/3, target/5 ..., and again each shard of a source its share of
them. A shard is a hashed part of a source, a bounded number of words and of documents, in a seeded order and cut into
equal blocks. Full rounds take every block; what is left takes blocks that a seeded permutation names, so no block is
taken more than once beyond the full rounds, and none over max_repeats times.

Sources, and the shards of a source, meet in one task as rows of some hundred bytes, by windows that spill: a million
sources, or a source of ten trillion words (ten million shards), is about a gigabyte there. Documents never do.

Edge cases: a null or blank text has size 0 and nothing is taken of it; null is a source of its own, after the others;
a source without words gets the target 0; rows that repeat a doc_id are documents of their own; ties of quotients go to
the source, then the shard, that comes first; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import kept

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; words and documents of a shard.
BLOCK, SHARD_WORDS, SHARD_DOCS = 32, 1 << 20, 1 << 15
#: Up to so many sources, each with a name of up to NAME_CHARS, are broadcast; more meet their documents by a shuffle.
SOURCES, NAME_CHARS = 20_000, 256
#: Primes above any number of blocks in a shard: multipliers of the block permutation.
STRIDES = (16777259, 33554467, 67108879, 134217757)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: str, *keys: Column) -> Column:
    """48 bits of MD5 as a long: the same in every run, on every machine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]).cast("binary")), 1, 12), 16, 10).cast("long")


def targets_of(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, source_docs, weight, target): one row a source.

    Sorted by cap/weight, the sources that stop at their cap come first: for each, the level that the rest would get
    if those before it were capped tells whether it is capped too.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", cap * F.col("source_size"))
    rising = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    per = per.withColumn("_level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    per = per.withColumn("_open", F.col("_level") * F.col("weight") < F.col("_cap"))
    level = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level").alias("level")))).over(everything)["level"]
    return per.withColumn("_final", level).select(
        "source", "source_size", "source_docs", "weight",
        F.coalesce(F.least(F.col("_cap"), F.col("_final") * F.col("weight")), F.col("_cap")).alias("target"),
    )


def apportion(parties: DataFrame, votes: str, seats: Column, group: list[str], order: list[Column], name: str = "seats") -> DataFrame:
    """parties with their whole-number seats by the Sainte-Lague method, within each group; seats: the group's total.

    Standard rounding by the average divisor is off by at most half the number of parties of the group, and a party's
    seats by at most its share of that plus one; so many of its next (or last) quotients compete for the difference.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    all_of = {c: F.col(c) for c in parties.columns}
    p = parties.withColumn("_seats", seats.cast("long")).withColumn("_all", F.sum(votes).over(whole)).withColumn("_m", F.count("*").over(whole))
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(0.0)
    p = p.withColumn("_rank", F.row_number().over(whole.orderBy(*order)))
    p = p.withColumn("_base", F.floor(share * F.col("_seats") + 0.5).cast("long"))
    p = p.withColumn("_off", F.col("_seats") - F.sum("_base").over(whole))
    reach = F.when((F.col("_off") == 0) | (F.col(votes) <= 0), 0).otherwise(F.floor(share * F.col("_m") / 2 + 1.5)).cast("int")
    steps = F.when(F.col("_off") > 0, F.sequence(F.lit(1), F.greatest(reach, F.lit(1)))).otherwise(F.sequence(F.lit(1), F.greatest(F.least(reach, F.col("_base").cast("int")), F.lit(1))))
    usable = (F.col("_off") > 0) & (reach > 0) | (F.col("_off") < 0) & (reach > 0) & (F.col("_base") > 0)
    p = p.withColumn("_step", F.explode_outer(F.when(usable, steps)))
    quotient = F.col(votes) / F.when(F.col("_off") > 0, 2 * (F.col("_base") + F.col("_step")) - 1).otherwise(2 * (F.col("_base") - F.col("_step")) + 1)
    p = p.withColumn("_q", F.when(F.col("_step").isNotNull(), quotient))
    # Of equal quotients the first party's counts more: it wins a seat first and loses one last.
    best = whole.orderBy(*[F.when(F.col("_off") > 0, a).otherwise(b).asc_nulls_last() for a, b in ((-F.col("_q"), F.col("_q")), (F.col("_rank"), -F.col("_rank")))], F.col("_step"))
    p = p.withColumn("_won", (F.col("_q").isNotNull() & (F.row_number().over(best) <= F.abs("_off"))).cast("long"))
    summed = p.groupBy(*all_of).agg(F.max("_base").alias("_base"), F.sum("_won").alias("_won"), F.max("_off").alias("_off"))
    return summed.select(*all_of, (F.col("_base") + F.signum("_off").cast("long") * F.col("_won")).alias(name))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, max_repeats: int, block: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, quotas, cells): the size of each row; blocks and shards of each source; blocks and rounds of each shard."""
    sizes = kept(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    sources = kept(targets_of(sizes, weights, share, float(max_repeats)), "targets")
    count = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block)
    shards = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("source_docs") / SHARD_DOCS), F.lit(1)).cast("long")
    quotas = apportion(sources, "target", count, [], [F.col("source").asc_nulls_last()], "quota").withColumn("shards", shards)
    quotas = kept(quotas.withColumnRenamed("source", "_source"), "quotas")
    cells = _dealt(sizes, quotas, seed).groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("quota").alias("quota"))
    cells = cells.withColumn("blocks", F.when(F.col("shard_size") > 0, F.greatest(F.round(F.col("shard_size") / block), F.lit(1))).otherwise(0).cast("long"))
    cells = apportion(cells, "blocks", F.col("quota"), ["source"], [F.col("shard")], "quota_shard")
    cells = cells.withColumn("quota_shard", F.least("quota_shard", max_repeats * F.col("blocks")))
    mark = seeded(f"{seed}/blocks", F.col("source"), F.col("shard"))
    cells = cells.select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "blocks",
        F.when(F.col("blocks") > 0, F.floor(F.col("quota_shard") / F.col("blocks"))).otherwise(0).cast("long").alias("rounds"),
        F.when(F.col("blocks") > 0, F.col("quota_shard") % F.col("blocks")).otherwise(0).cast("long").alias("extra"),
        F.element_at(F.array(*[F.lit(s) for s in STRIDES]), (mark % len(STRIDES) + 1).cast("int")).cast("long").alias("stride"),
        F.when(F.col("blocks") > 0, mark % F.col("blocks")).otherwise(0).alias("shift"),
    )
    cells = kept(cells, "cells")
    return sizes, quotas, cells


def _dealt(rows: DataFrame, quotas: DataFrame, seed: str) -> DataFrame:
    """rows (id, source, size, ...) with what their source gets, their place in the seeded order and their shard."""
    n, longest = quotas.agg(F.count("*"), F.coalesce(F.max(F.length("_source")), F.lit(0))).first()
    small = n <= SOURCES and longest <= NAME_CHARS
    rows = rows.join(F.broadcast(quotas) if small else quotas, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return rows.withColumn("_order", seeded(seed, F.col("id"))).withColumn("shard", F.col("_order") % F.col("shards"))


def _laid_out(rows: DataFrame, quotas: DataFrame, cells: DataFrame, seed: str) -> DataFrame:
    """rows with the position of their first word in their shard, with what their shard gets, and with taken."""
    before = Window.partitionBy("source", "shard").orderBy("_order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = _dealt(rows, quotas, seed).withColumn("first_word", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    more = F.when((F.col("size") > 0) & (F.col("extra") > 0), F.aggregate(extra_spans(), F.lit(0).cast("long"), lambda total, s: total + s["to"] - s["from"])).otherwise(0)
    return rows.withColumn("taken", (F.col("size") * F.col("rounds") + more).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """One row for each document: id_col, size, source, source_size, target, rounds, first_word, shard_size, blocks,
    extra, stride, shift, taken; taken is the number of its words in the mix, repeats counted.

    The block of word w of a shard (first_word on are the document's) is w * blocks div shard_size; it is taken rounds
    times, and once more if (number * stride + shift) mod blocks < extra.
    """
    sizes, quotas, cells = _plan(docs, id_col, text_col, source_col, weights, share, max_repeats, block, seed)
    return _laid_out(sizes, quotas, cells, seed).select(
        F.col("id").alias(id_col), "size", "source", "source_size", "target", "rounds", "first_word", "shard_size", "blocks", "extra", "stride", "shift", "taken"
    )


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """The mix itself: docs, all columns, with the text that is taken of each; documents of which nothing is go.

    Whole rounds repeat the text as it is, a line break between; words of further blocks follow, one space between.
    """
    _, quotas, cells = _plan(docs, id_col, text_col, source_col, weights, share, max_repeats, block, seed)
    row = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row.alias("_row"))
    rows = _laid_out(rows, quotas, cells, seed).where("taken > 0")
    text = F.col("_row").getField(text_col)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    spans = F.when(F.col("extra") > 0, F.filter(extra_spans(), lambda s: s["to"] > s["from"]))
    rows = rows.withColumn("_words", F.when(F.size(spans) > 0, words)).withColumn("_spans", spans)
    cut = F.transform("_spans", lambda s: F.array_join(F.slice("_words", (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")), " "))
    pieces = F.concat(F.array_repeat(text, F.col("rounds").cast("int")), F.when(F.size("_spans") > 0, F.array(F.array_join(cut, " "))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_text", F.array_join(pieces, "\n"))
    return rows.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


def extra_spans() -> Column:
    """array<struct<from, to>>: the words of a document, from 0, that lie in blocks taken once more than rounds says."""
    size, first, whole, blocks = F.col("size"), F.col("first_word"), F.col("shard_size"), F.col("blocks")
    numbers = F.sequence(_block(first, whole, blocks), _block(first + size - 1, whole, blocks))
    chosen = F.filter(numbers, lambda b: (b * F.col("stride") + F.col("shift")) % blocks < F.col("extra"))
    return F.transform(chosen, lambda b: F.struct(F.greatest(_ceil(b * whole, blocks) - first, F.lit(0)).alias("from"), F.least(_ceil((b + 1) * whole, blocks) - first, size).alias("to")))


def _block(word: Column, whole: Column, blocks: Column) -> Column:
    return F.call_function("div", word * blocks, whole)


def _ceil(a: Column, b: Column) -> Column:
    return F.call_function("div", a + b - 1, b)
