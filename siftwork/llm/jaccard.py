"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles. Sets with a Jaccard likeness of at least NUM/DEN share at least
t = ceil(NUM/DEN * n) elements with either side's n. In any common order of the elements, two such sets share at least
l of the first n - t + l elements of each; so a pair needs min(l, l') shared elements of its two prefixes. The order
is by a count sketch of all shingles of the corpus, rare ones first. A document lengthens its prefix, l = 1 to
LONGEST, to where the estimated cost is least: the entries that its prefix meets, and the candidates among them that at
least l entries can make, each of which costs a verification.

Texts with equal word sequences are one class, and only the class with its smallest id joins. Lists of an element with
up to SHORT documents give all their pairs. Documents that meet in longer lists are joined once more among themselves,
with elements in exact order of their frequency there. The rarest element that a linked pair shares lies in both
prefixes; if SHORT sets or fewer hold it, its list gives the pair. Otherwise the pair shares dense elements only, which
bounds the sizes of the partners that either side has room for. A dense list gives the pairs with its pivot, the
document that is met most; the likeness is a metric, so members whose distances from the pivot differ by more than
1 - NUM/DEN are not linked, and those linked with the pivot are in one component already. What these bounds leave is
verified, or joined in the same way around new pivots, and after ROUNDS of them pair by pair: no link between different
components is lost, and a group of near copies costs about as many verifications as it has members. Verification
intersects the whole sets, with whole numbers.

Edge cases: null, empty and blank texts have empty sets and are linked with nothing; shorter texts give their whole
sequence as one shingle; rows that repeat a doc_id each get the component of their own text, which links of their other
texts may join; a null doc_id gets the component of its equal texts, or null; an empty table gives an empty result. Only
the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scratch import dropped, free_name, held, kept, parts, small_batches, tidy
from .shingles import WORDS, shingle_sets

NUM, DEN = 75, 100
#: Counters of the sketch (a power of two) and the slices in which they travel. A task counts to FULL, the sums to WIDE:
#: over 10**13 shingles chance puts about 1.2 million on a counter, and elements that occur some thousand times more stand out.
COUNTERS, SLICES, FULL, WIDE = 1 << 23, 64, 2**16 - 1, 2**32 - 1
#: Longest multi-match, members of a list that still gives all its pairs, rounds of pivots before plain pairs.
LONGEST, SHORT, ROUNDS = 8, 17, 4
#: Members of a list that one task orders, and pairs of one document that one task verifies; more are dealt to several.
MOST, EACH = 1024, 256
#: Entries that an element is thought to meet which the sketch cannot tell from chance.
CHANCE = 0.02
_EPS = 1e-9


def _sketch_parts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shift = np.zeros(COUNTERS, np.uint16), np.uint64(64 - COUNTERS.bit_length() + 1)
        for batch in batches:
            found = [s for _, s in shingle_sets(batch.column(0), size)]
            if found:
                at, often = np.unique(np.concatenate(found) >> shift, return_counts=True)
                at = at.astype(np.int64)
                counts[at] = np.minimum(counts[at] + often, FULL)
        if counts.any():
            cut = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array(cut, pa.binary())})

    return run


def _sketch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(raw), np.uint16).astype(np.uint32)
            sums[k] = np.minimum(sums[k].astype(np.int64) + part, WIDE).astype(np.uint32) if k in sums else part

    raw = [zlib.compress(x.tobytes(), 1) for x in sums.values()]
    yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "counts": pa.array(raw, pa.binary())})


def shingle_sketch(docs: DataFrame, text_col: str = "text", size: int = WORDS) -> np.ndarray:
    """How often the shingles that fall on each counter occur, over all documents.

    Each task sends its counters in slices; a task that gets a slice adds up what comes, one part at a time.
    """
    small_batches(docs.sparkSession)
    schema = "slice int, counts binary"
    sums = docs.select(text_col).mapInArrow(tidy(_sketch_parts(size)), schema).repartition(min(SLICES, parts(docs.sparkSession)), "slice").mapInArrow(tidy(_sketch_sums), schema)
    out = np.zeros(COUNTERS, np.uint32)
    for row in sums.collect():
        out[row["slice"] * (COUNTERS // SLICES) :][: COUNTERS // SLICES] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return out


def prefix_of(shingles: np.ndarray, counts: np.ndarray, base: float, num: int, den: int, most: int = MOST) -> tuple[int, np.ndarray, int]:
    """The multi-match l of a set (ascending hashes, with their counts), its prefix, rare elements first, and how many
    of these elements surely have lists of most members or fewer.

    A prefix costs its elements, and a pass over the set for each candidate. Its elements meet as many entries as they
    occur beyond what chance puts on a counter, and CHANCE more each; at most entries/l documents are met l times.
    """
    n = len(shingles)
    least = -(-num * n // den)
    order = np.argsort(counts, kind="stable")
    met = np.cumsum(np.maximum(counts[order].astype(np.float64) - base, 0.0) + CHANCE)
    l = np.arange(1, min(LONGEST, least) + 1)
    cost = l + met[n - least + l - 1] / l * n / 8
    best = int(l[cost.argmin()])
    prefix = order[: n - least + best]
    return best, shingles[prefix], int(np.searchsorted(counts[prefix], most, "right"))


def prefix_table(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """(id, hi, lo, n, l, rare, prefix): for each row the digest of its word sequence, the size of its set and its prefix,
    the first rare elements of which surely have no list of over MOST members."""
    spark = docs.sparkSession
    sketch = shingle_sketch(docs, text_col, size)
    sketch = sketch.astype(np.uint16) if sketch.max() <= FULL else sketch  # each worker holds one
    base = float(np.median(sketch)) + 3 * float(np.sqrt(np.median(sketch)))
    shared, most = spark.sparkContext.broadcast(sketch), MOST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shift = shared.value, np.uint64(64 - COUNTERS.bit_length() + 1)
        for batch in batches:
            his, los, ns, ls, rares, prefixes = [], [], [], [], [], []
            for words, own in shingle_sets(batch.column(1), size):
                hi, lo = np.frombuffer(blake2b(words.tobytes(), digest_size=16).digest(), np.int64).tolist()
                l, prefix, rare = prefix_of(own, counts[(own >> shift).astype(np.int64)], base, num, den, most) if len(own) else (0, own, 0)
                his.append(hi), los.append(lo), ns.append(len(own)), ls.append(l), rares.append(rare), prefixes.append(prefix.view(np.int64))
            ends = np.cumsum([0] + [len(p) for p in prefixes], dtype=np.int64).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(ns, pa.int64()), pa.array(ls, pa.int32()), pa.array(rares, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["id", "hi", "lo", "n", "l", "rare", "prefix"],
            )

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("hi", "lo", "n")], T.StructField("l", T.IntegerType()), T.StructField("rare", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def set_table(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, shingles): each row's whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.view(np.int64) for _, s in shingle_sets(batch.column(1), size)]
            ends = np.cumsum([0] + [len(s) for s in found], dtype=np.int64).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "shingles"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("shingles", T.ArrayType(T.LongType()))])
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def _sizes_fit(a: Column, b: Column, num: int, den: int) -> Column:
    return den * F.least(a, b) >= num * F.greatest(a, b)


def _beside_sets(rows: DataFrame, pairs: DataFrame, sets: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """rows, one for each of pairs, with the set of the document key under name; one with over EACH pairs is dealt to several tasks."""
    hot = kept(pairs.groupBy(F.col(key).alias("_hot")).agg(F.ceil(F.count("*") / EACH).cast("int").alias("_s")).where("_s > 1"), "hot")
    few = held(hot)
    dealt = rows.join(few, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("_s")), F.lit(0))).drop("_hot", "_s")
    copies = sets.join(few, F.col("id") == F.col("_hot"), "left").select(F.col("id").alias(key), F.col("shingles").alias(name), F.explode(F.sequence(F.lit(0), F.coalesce("_s", F.lit(1)) - 1)).alias("_salt"))
    return dealt.join(copies.withColumn("_salt", F.col("_salt").cast("long")), [key, "_salt"]).drop("_salt")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b), a table that is kept, with their distance and whether they are linked."""
    out = _beside_sets(pairs, pairs, sets, "a", "b", "_a")
    out = _beside_sets(out, pairs, sets, "b", "a", "_b").select("a", "b", F.size(F.array_intersect("_a", "_b")).cast("long").alias("_both"), (F.size("_a") + F.size("_b")).cast("long").alias("_sum"))
    return out.select(
        "a", "b", (1 - F.col("_both") / (F.col("_sum") - F.col("_both"))).alias("distance"),
        (den * F.col("_both") >= num * (F.col("_sum") - F.col("_both"))).alias("linked"),
    )


def _short_pairs(rows: DataFrame, most: int) -> DataFrame:
    """Structs x, y for each pair of a list tok with up to most members; rows: tok, d and what the structs also hold.

    No list of rows has more than MOST members.
    """
    own = F.struct(*[c for c in rows.columns if c != "tok"])
    whole = Window.partitionBy("tok")
    rows = rows.select("tok", own.alias("y"), F.count("*").over(whole).alias("c"), F.collect_list(own).over(whole.orderBy("d").rowsBetween(-most, -1)).alias("earlier"))
    return rows.where(F.col("c") <= most).select("y", F.explode("earlier").alias("x")).where("x.d < y.d")


def exact_prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(tok, d, n, first, dense, room): prefixes by the exact document frequency within sets, without lone elements.

    first: whether tok is in the shorter prefix that suffices towards documents of at least the same size; dense: whether
    more than SHORT sets hold tok; room: the largest partner that d can be linked with by dense elements alone.
    """
    rows = sets.select(F.col("id").alias("d"), F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("tok"))
    often = kept(rows.groupBy("tok").agg(F.count("*").alias("f")).where("f > 1"), "often")
    ranked = rows.join(held(often), "tok").repartition(parts(sets.sparkSession), "d").groupBy("d", "n").agg(F.sort_array(F.collect_list(F.struct("f", "tok"))).alias("all"))
    n, over = F.col("n"), num + den
    alone = n - F.size("all")  # elements of one set come first in the order
    least = F.call_function("div", num * n + den - 1, F.lit(den))
    among_equals = F.call_function("div", 2 * num * n + over - 1, F.lit(over))
    held_often = F.size(F.filter("all", lambda x: x["f"] > SHORT)).cast("long")
    rows = ranked.select(
        "d", "n", alone.alias("alone"), (F.call_function("div", over * held_often, F.lit(num)) - n).alias("room"),
        F.posexplode(F.slice("all", F.lit(1), F.greatest(n - least + 1 - alone, F.lit(0)).cast("int"))).alias("at", "x"),
    )
    return rows.select(F.col("x.tok").alias("tok"), "d", "n", (F.col("alone") + F.col("at") < n - among_equals + 1).alias("first"), (F.col("x.f") > SHORT).alias("dense"), "room")


def _beside_lists(rows: DataFrame, *told: Column) -> DataFrame:
    """rows with aggregates of their list tok; these are few, and joined, so that no task gets a whole list."""
    lists = kept(rows.groupBy("tok").agg(*told), "lists")
    return rows.join(held(lists), "tok")


def _met_in_lists(inner: DataFrame, outer: DataFrame, fits: Column) -> DataFrame:
    """(a, b): the documents d of inner and d_y of outer that meet in a list tok and fit; a list is dealt to several tasks."""
    sizes = [x.groupBy("tok").agg(F.count("*").alias(n)) for x, n in ((inner, "_i"), (outer, "_o"))]
    lists = held(kept(sizes[0].join(sizes[1], "tok").select("tok", F.ceil(F.col("_i") * F.col("_o") / (EACH * EACH)).cast("int").alias("_s")), "lists"))
    left = inner.join(lists, "tok").withColumn("_salt", F.pmod(F.xxhash64("d"), F.col("_s"))).drop("_s")
    right = outer.join(lists, "tok").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s").cast("long") - 1))).drop("_s")
    return left.join(right, ["tok", "_salt"]).where(fits).select(F.least("d", "d_y").alias("a"), F.greatest("d", "d_y").alias("b"))


def _crowded_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links among documents that met in long lists, by a join of its own in exact order of frequency."""
    width = 1 - num / den
    rows = kept(exact_prefixes(sets, num, den), "exact")
    x, y = F.col("x"), F.col("y")
    small_first = (F.struct(x["n"], x["d"]) < F.struct(y["n"], y["d"])) & x["first"] | (F.struct(y["n"], y["d"]) < F.struct(x["n"], x["d"])) & y["first"]
    sparse = _short_pairs(rows.where("not dense").select("tok", "d", "n", "first"), SHORT).where(small_first & _sizes_fit(x["n"], y["n"], num, den))
    pairs = sparse.select(F.col("x.d").alias("a"), F.col("y.d").alias("b"))

    # Pairs that share no sparse element: both must hold enough dense ones.
    may = lambda n1, room1, n2, room2: (n2 <= room1) & (n1 <= room2) & _sizes_fit(n1, n2, num, den)
    near = lambda p, q: F.abs(p - q) <= width + _EPS
    fits = may(F.col("n"), F.col("room"), F.col("n_y"), F.col("room_y")) & near(F.col("distance"), F.col("distance_y"))
    y_of = ["tok", *[F.col(c).alias(f"{c}_y") for c in ("d", "n", "room", "distance")]]
    most_met = F.max_by("d", "met").alias("pivot")
    dense = rows.where("dense").select("tok", "d", "n", "room")
    dense = kept(dense.join(dense.groupBy("d").agg(F.count("*").alias("met")), "d"), "dense")
    past = [rows, dense]
    # Lists with the same pivot are one group from here on, so that a pair comes up once.
    dense = kept(_beside_lists(dense, most_met).select(F.col("pivot").alias("tok"), "d", "n", "room", "met", "pivot").distinct(), "dense")
    of_pivot = lambda t: t.where("d <> pivot").select(F.least("pivot", "d").alias("a"), F.greatest("pivot", "d").alias("b"))
    asked = kept(pairs.unionByName(of_pivot(dense)).distinct(), "asked")
    found = kept(_verified(asked, sets, num, den), "found")
    links, past = [found.where("linked").select("a", "b")], [*past, dense, asked, found]
    for turn in range(ROUNDS + 1):
        if not dense.take(1):
            break
        told = dense.where("d <> pivot").withColumn("a", F.least("pivot", "d")).withColumn("b", F.greatest("pivot", "d")).join(found, ["a", "b"])
        told = kept(told.groupBy("tok", "d", "n", "room", "met").agg(F.min("distance").alias("distance"), F.max("linked").alias("linked")), "told")
        past.append(told)
        wide = _beside_lists(told, F.min(F.when(F.col("linked"), F.col("n"))).alias("_least"), F.max(F.when(~F.col("linked"), F.col("room"))).alias("_room"))
        outer = wide.where(~F.col("linked") & (F.col("_least") <= F.col("room")) & (F.col("distance") <= 2 * width + _EPS)).select(*y_of)
        inner = wide.where(F.col("linked") & (F.col("n") <= F.col("_room")))
        cross = _met_in_lists(inner, outer, fits)
        # Of two that are far, the smaller must have room for its own size.
        far = _beside_lists(told.where("not linked"), F.min(F.when(F.col("room") >= F.col("n"), F.col("n"))).alias("_smallest"))
        far = kept(far.where((F.col("room") >= F.col("n")) | (F.col("_smallest") <= F.col("room"))).select("tok", "d", "n", "room", "met", "distance"), "far")
        far, past = _beside_lists(far, F.count("*").alias("_c"), most_met), [*past, far]
        rest = _short_pairs(far.where(F.col("_c") <= SHORT).select("tok", "d", "n", "room", "met", "distance"), SHORT)
        rest = rest.where(may(x["n"], x["room"], y["n"], y["room"]) & near(x["distance"], y["distance"])).select(F.col("x.d").alias("a"), F.col("y.d").alias("b"))
        long = far.where(F.col("_c") > SHORT).drop("_c")
        if turn < ROUNDS:
            dense = kept(long.drop("distance"), "dense")
            past.append(dense)
            more = of_pivot(dense)
        else:
            more = _met_in_lists(long, long.select(*y_of), (F.col("d") < F.col("d_y")) & fits)
        asked = kept(cross.unionByName(rest).unionByName(more).distinct(), "asked")
        found = kept(_verified(asked, sets, num, den), "found")
        past += [asked, found]
        links.append(found.where("linked").select("a", "b"))
    out = kept(reduce(DataFrame.unionByName, links), "links")
    dropped(*past)
    return out


def jaccard_links(docs: DataFrame, table: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """(a, b): links between representatives that connect whatever the links of all pairs connect.

    table: what prefix_table() gives for docs, kept, with one row a class.
    """
    rows = table.where("n > 0 and id is not null").select("id", "n", "l", "rare", F.posexplode("prefix").alias("at", "tok"))
    rows = rows.select("tok", F.col("id").alias("d"), (F.shiftleft("n", 36) + F.col("at") * 16 + F.col("l")).alias("nl"), (F.col("at") >= F.col("rare")).alias("maybe"))
    # Elements that may have long lists are counted, aggregated before the shuffle; no longer list is ordered in one task.
    hot = kept(rows.where("maybe").groupBy("tok").agg(F.count("*").alias("_c")).where(F.col("_c") > max(MOST, SHORT)).select("tok"), "hot")
    hot_members = kept(rows.where("maybe").join(held(hot), "tok", "left_semi").select(F.col("d").alias("_id")).distinct(), "members")
    rows = rows.join(held(hot), "tok", "left_anti").drop("maybe") if hot.take(1) else rows.drop("maybe")
    inlist = Window.partitionBy("tok").orderBy("d")
    rows = rows.withColumn("_before", F.lag("d").over(inlist)).withColumn("_after", F.lead("d").over(inlist))
    met = kept(rows.where("_before is not null or _after is not null").drop("_before", "_after"), "met")
    x, y = F.col("x"), F.col("y")
    n, at, l = (lambda c: F.shiftright(c["nl"], 36)), (lambda c: F.shiftright(c["nl"], 4).bitwiseAND(2**32 - 1)), (lambda c: c["nl"] % 16)
    met_at = (
        _short_pairs(met, SHORT).where(_sizes_fit(n(x), n(y), num, den))
        .groupBy(F.col("x.d").alias("a"), F.col("y.d").alias("b"))
        .agg(
            F.count("*").alias("shared"), F.min(F.least(l(x), l(y))).alias("l"), F.max(n(x)).alias("na"), F.max(n(y)).alias("nb"),
            F.min(n(x) - at(x) - 1).alias("after_a"), F.min(n(y) - at(y) - 1).alias("after_b"),
        )
    )
    # Behind the last shared element of the prefixes either set has only so many elements left to share.
    possible = F.col("shared") + F.least("after_a", "after_b")
    pairs = met_at.where((F.col("shared") >= F.col("l")) & ((num + den) * possible >= num * (F.col("na") + F.col("nb")))).select("a", "b")
    pairs = kept(pairs, "pairs")
    long = met.groupBy("tok").agg(F.count("*").alias("_c")).where(F.col("_c") > SHORT).select("tok")
    crowd = kept(met.join(long, "tok", "left_semi").select(F.col("d").alias("_id")).unionByName(hot_members).distinct(), "crowd")
    needed = kept(pairs.select(F.explode(F.array("a", "b")).alias("_id")).unionByName(crowd).distinct(), "needed")
    few, texts = held(needed), docs.select(F.col(id_col), F.col(text_col))
    sets = kept(set_table(texts.join(few, texts[id_col] == few["_id"], "left_semi"), id_col, text_col, size), "sets")
    links = kept(_verified(pairs, sets, num, den).where("linked").select("a", "b"), "links")
    dropped(met, pairs, needed, hot, hot_members)
    if crowd.take(1):
        more = _crowded_links(sets.join(held(crowd), F.col("id") == F.col("_id"), "left_semi"), num, den)
        links = kept(links.unionByName(more).distinct(), "links")
    dropped(crowd, sets)
    return links


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id (the smallest id reachable by links)."""
    small_batches(docs.sparkSession)
    table = kept(prefix_table(docs, id_col, text_col, size, num, den), "prefixes")
    heads = kept(table.select("id", "hi", "lo", "n"), "heads")
    classes = kept(heads.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    others = kept(heads.where("n > 0").join(held(classes.where("copies > 1")), ["hi", "lo"]).where("id <> rep").select("id", "hi", "lo").distinct(), "copies")
    links = jaccard_links(docs, table.join(held(others), ["id", "hi", "lo"], "left_anti"), id_col, text_col, size, num, den)
    dropped(table, others)
    roots = kept(components(links), "roots")
    groups = classes.join(roots, F.col("rep") == F.col("node"), "left").where("copies > 1 or node is not null")
    groups = kept(groups.select("hi", "lo", F.coalesce("root", "rep").alias("root")), "groups")
    dropped(roots, classes, links)
    grouped = heads.where("n > 0").join(held(groups), ["hi", "lo"], "left").select("id", "n", F.coalesce("root", "id").alias("component_id"))
    return grouped.unionByName(heads.where("n = 0").select("id", "n", F.col("id").alias("component_id"))).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """docs, all columns, with the document of the smallest id of each group of similar ones.

    The ids that go meet the documents by broadcast if a count shows that they are few; then no text is shuffled.
    """
    gone = free_name(docs, "similar_id")
    groups = similar_groups(docs, id_col, text_col, **how)
    stays = F.max(F.col(id_col).eqNullSafe(F.col("component_id"))).alias("stays")
    ids = kept(groups.groupBy(F.col(id_col).alias(gone)).agg(stays).where("not stays").select(gone), "gone")
    return docs.join(held(ids), docs[id_col].eqNullSafe(F.col(gone)), "left_anti")
