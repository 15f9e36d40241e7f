"""Phrase collocations by pivot partitioning: each n-gram is counted where its rarest word is.

1. Words are counted; those with LEAST occurrences or more in their language get ids, rarer words higher ones.
2. Texts become sequences of ids, broken where a piece ends or a word is not frequent, since no frequent phrase goes
   over such a place. For each occurrence of a word as a pivot the text is rewritten to the words around it that are not
   rarer, at most LONGEST - 1 on each side: what phrases of which the pivot is the rarest word can reach. Equal fragments
   are counted before they are sent to their pivot. A phrase that holds its rarest word twice belongs to the first of
   them, so every occurrence of a phrase is in one fragment.
3. Per pivot, phrases are mined level by level: a phrase is counted only where the shorter phrases in it that hold the
   pivot are frequent. Only the pivot's own phrases are emitted.
4. Cuts of the frequent phrases meet the counts of their parts by joins, and scores are whole-number arithmetic.

Bounds: pivots are dealt in buckets of some MET occurrences. One with over HOT occurrences is dealt to several tasks,
which emit all their counts; these are added up before the threshold. A task holds the fragments of one bucket or one
share of a pivot at a time, or STEP of several. The words are broadcast if a look at them finds at most DICTIONARY of them in DICTIONARY_BYTES; else texts get
their ids by a join, one row a text as before, and the other steps are the same.

Edge cases: a null text is empty, a null language is `und` and falls together with it; empty texts, pieces and
languages without a frequent phrase give no rows; rows that repeat an id or a text count one by one; columns other than
the named ones are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import dropped, held, kept, parts, small_batches, tidy

#: Occurrences of a phrase; its words; rows a language; share in percent of a longer phrase that makes a shorter one go.
LEAST, LONGEST, FIRST, PERCENT = 100, 5, 2000, 100
UNKNOWN = "und"
#: Words that are broadcast, and their bytes.
DICTIONARY, DICTIONARY_BYTES = 500_000, 16 << 20
#: Occurrences of a pivot that one task takes; ids whose fragments are made, and fragments that are mined, in one step;
#: words counted at once; occurrences of a bucket of pivots.
HOT, GATHERED, STEP, HELD, MET = 1 << 20, 1 << 21, 1 << 19, 1 << 18, 1 << 21
#: Bytes of a text that are split into words in one step.
PIECE = 1 << 20
_ENDS = b".,;:!?\n\x0b\x0c\r"
#: No UTF-8 text holds it: the end of a piece.
_CUT = b"\xff"
_PLAIN = bytes(0xFF if c in _ENDS else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_WIDTH = 8


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lower case, with _CUT where a piece ends, in lists of bounded length."""
    at = 0
    while at < len(text):
        stop = min(at + PIECE, len(text))
        while stop < len(text) and _PLAIN[text[stop]] not in (0x20, 0xFF):
            stop += 1
        # split() would also cut at white space that is none here; all of it is in _PLAIN already.
        yield text[at:stop].translate(_PLAIN).replace(_CUT, b" \xff ").split()
        at = stop


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) over all texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict[str, Counter[bytes]] = defaultdict(Counter)

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                own.pop(_CUT, None)
                words, ns = list(own), list(own.values())
                for k in range(0, len(words), STEP):
                    some = pa.array(words[k : k + STEP], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), some, pa.array(ns[k : k + STEP], pa.int64())], names=["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for words in tokens(text):
                    counts[lang].update(words)
                if sum(map(len, counts.values())) > HELD:
                    yield from counted()
        yield from counted()

    found = _rows(docs, text_col, lang_col).mapInArrow(tidy(run), "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def with_ids(frequent: DataFrame) -> tuple[DataFrame, bool]:
    """frequent (lang, word, n), a table that is kept, with an id, the place of the word in the order of falling counts;
    and whether it may be broadcast."""
    n, size = frequent.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    spark, order = frequent.sparkSession, [F.desc("n"), F.col("lang"), F.col("word")]
    dealt = frequent.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = kept(dealt.select("lang", "word", "n", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_at")), "dealt")
    before, starts = 0, []
    for row in sorted(dealt.groupBy("_part").count().collect()):
        starts.append((row["_part"], before))
        before += row["count"]
    offsets = spark.createDataFrame(starts, "_part long, _before long")
    words = kept(dealt.join(F.broadcast(offsets), "_part").select("lang", "word", "n", (F.col("_before") + F.col("_at")).alias("id")), "words")
    dropped(dealt)
    return words, n <= DICTIONARY and size <= DICTIONARY_BYTES


def _narrow(few: bool) -> type:
    """The type in which ids are sent: those of a broadcast dictionary are small."""
    return np.int32 if few else np.int64


def _by_dictionary(dictionary) -> Callable[[pa.RecordBatch], Iterator[tuple[str, list[np.ndarray]]]]:
    """Ids of the texts of a batch (lang, text) by a broadcast dictionary."""

    def ids_of(batch: pa.RecordBatch) -> Iterator[tuple[str, list[np.ndarray]]]:
        ids = dictionary.value
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang in ids:
                get = ids[lang].get
                yield lang, [np.array([get(w, -1) for w in words], np.int32) for words in tokens(text)]

    return ids_of


def _by_join(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, ids): the ids of each text by a join with all frequent words, -1 for other words and ends of pieces."""
    ends = f"[{_ENDS.decode()}]"
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = F.split(F.regexp_replace(lower, ends, " . "), "[ \t]+", -1)  # no word has a full stop
    at = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "lang", F.posexplode(split).alias("at", "word")).where("word <> ''")
    told = at.join(words.select("lang", "word", "id"), ["lang", "word"], "left").groupBy("row", "lang")
    return told.agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("id", F.lit(-1).cast("long")).alias("id")))).alias("all")).select("lang", F.col("all.id").alias("ids"))


def _of_column(batch: pa.RecordBatch) -> Iterator[tuple[str, list[np.ndarray]]]:
    offsets, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
    for k, lang in enumerate(batch.column(0).to_pylist()):
        yield lang, [flat[offsets[k] : offsets[k + 1]]]


def windows(ids: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pivots, left, right, around): for each position what its phrases can reach; around has reach columns a side.

    To the left words must be more frequent than the pivot, to the right they may be the pivot again.
    """
    edge = np.full(reach, -1, ids.dtype)
    padded = np.concatenate([edge, ids, edge])
    sides, sizes = [], []
    for step in (-1, 1):
        open_, size = ids >= 0, np.zeros(len(ids), np.int32)
        side = np.full((len(ids), reach), -1, ids.dtype)
        for k in range(1, reach + 1):
            other = padded[reach + step * k : reach + step * k + len(ids)]
            open_ = open_ & (other >= 0) & ((other < ids) if step < 0 else (other <= ids))
            size += open_
            side[:, reach - k if step < 0 else k - 1] = np.where(open_, other, -1)
        sides.append(side)
        sizes.append(size)
    some = sizes[0] + sizes[1] > 0
    return ids[some], sizes[0][some], sizes[1][some], np.concatenate(sides, axis=1)[some]


def _marks(pivots: np.ndarray, around: np.ndarray) -> np.ndarray:
    """A hash of each fragment."""
    mark = pivots.astype(np.uint64)
    for k in range(around.shape[1]):
        mark = (mark ^ around[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mark ^= mark >> np.uint64(29)
    return mark


def _merged(keys: np.ndarray, pivots: np.ndarray, marks: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first of equal fragments, by key, and how many equal it: sorted by a hash, compared in full."""
    order = np.lexsort((marks, keys))
    same = (keys[order[1:]] == keys[order[:-1]]) & (marks[order[1:]] == marks[order[:-1]]) & (pivots[order[1:]] == pivots[order[:-1]])
    some = np.flatnonzero(same)
    same[some] = (around[order[some]] == around[order[some + 1]]).all(axis=1)
    first = np.flatnonzero(np.concatenate(([True], ~same))[: len(order)])
    return order[first], np.diff(np.append(first, len(order)))


def fragments(rows: DataFrame, ids_of: Callable[[pa.RecordBatch], Iterator[tuple[str, list[np.ndarray]]]], longest: int, few: bool, hot: list[int], buckets: int) -> DataFrame:
    """(key, heads, ids): fragments by bucket, or by share of a pivot (a negative key). heads: count, left and right words
    of each as one number; ids: its words with the pivot among them.

    hot: how many words occur more than HOT, 2 * HOT, 4 * HOT ... times; these have the least ids and 2, 4, 8 ... shares.
    """
    reach, kind = longest - 1, _narrow(few)
    falling = -np.array(hot, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: defaultdict[str, list[np.ndarray]] = defaultdict(list)
        n, gap = 0, np.full(1, -1, kind)

        def sent(sequence: np.ndarray) -> Iterator[pa.RecordBatch]:
            pivots, left, right, around = windows(sequence, reach)
            if not len(pivots):
                return
            marks, keys = _marks(pivots, around), pivots.astype(np.int64) % buckets
            levels = np.searchsorted(falling, -pivots.astype(np.int64), "left")
            some = levels > 0
            shares = (marks[some] >> np.uint64(20)) & ((np.uint64(1) << levels[some].astype(np.uint64)) - np.uint64(1))
            keys[some] = -1 - (pivots[some].astype(np.int64) << 24 | shares.astype(np.int64))
            first, counts = _merged(keys, pivots, marks, around)
            keys, left, right = keys[first], left[first], right[first]
            around = np.insert(around[first], reach, pivots[first], axis=1)
            heads = ((counts * longest + left) * longest + right).astype(np.int32)
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            bounds = np.append(starts, len(keys))
            words = np.concatenate(([0], np.cumsum(left + right + 1, dtype=np.int64)))[bounds]
            for k in range(0, len(starts), 1 << 12):
                own = bounds[k : k + (1 << 12) + 1]
                at = words[k : k + (1 << 12) + 1]
                blob = lambda values, offsets: pa.Array.from_buffers(pa.binary(), len(own) - 1, [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])  # noqa: B023, E731
                near = around[own[0] : own[-1]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[own[:-1]]), blob(heads[own[0] : own[-1]], own * 4), blob(near[near >= 0], at * near.itemsize)], names=["key", "heads", "ids"])

        def flushed() -> Iterator[pa.RecordBatch]:
            while waiting:
                yield from sent(np.concatenate(waiting.popitem()[1]))

        for batch in batches:
            for lang, found in ids_of(batch):
                waiting[lang] += [*found, gap]
                n += sum(map(len, found)) + 1
                if n > GATHERED:
                    yield from flushed()
                    n = 0
        yield from flushed()

    return rows.mapInArrow(tidy(run), "key long, heads binary, ids binary")


def mined(keys: np.ndarray, least: np.ndarray, pivots: np.ndarray, heads: np.ndarray, ids: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, phrase ids as rows, count) of the phrases that hold their pivot, level by level, for one length and place.

    ids: without the pivots; keys: for each fragment its pivot's number; least: for each number the count that a phrase needs.
    """
    reach = longest - 1
    count, left, right = heads.astype(np.int64) // longest**2, heads // longest % longest, heads % longest
    words, dense = np.unique(ids, return_inverse=True)
    place = np.arange(reach)
    row = np.full((len(keys), 2 * reach + 1), -1, np.int64)
    row[np.concatenate([place >= reach - left[:, None], np.zeros((len(keys), 1), bool), place < right[:, None]], axis=1)] = dense
    # Codes of the phrases that begin s words before the pivot, for each fragment; level 1 is the pivot alone.
    codes: dict[int, np.ndarray] = {0: keys}
    lexicon = {0: (np.arange(len(least)), np.zeros((len(least), 0), np.int64))}
    of_key = np.zeros(len(least), np.int64)
    of_key[keys] = pivots
    for length in range(2, longest + 1):
        now, told = {}, {}
        for s in range(length):
            before, after = codes.get(s) if s <= length - 2 else None, codes.get(s - 1) if s else None
            if (s <= length - 2 and before is None) or (s and after is None):
                continue
            usable = np.ones(len(keys), bool)
            for parent in (before, after):
                if parent is not None:
                    usable &= parent >= 0
            new = row[:, reach - s + length - 1] if before is not None else row[:, reach - s]
            at = np.flatnonzero(usable & (new >= 0))
            if not len(at):
                continue
            parent, (owner, phrases) = (before, lexicon[s]) if before is not None else (after, lexicon[s - 1])
            both, code = np.unique(parent[at] * len(words) + new[at], return_inverse=True)
            total = np.bincount(code, count[at].astype(np.float64)).astype(np.int64)
            parents, added = both // len(words), both % len(words)
            enough = total >= least[owner[parents]]
            if not enough.any():
                continue
            number = np.where(enough, np.cumsum(enough) - 1, -1)
            parents, added, total = parents[enough], added[enough], total[enough]
            grown = np.column_stack([phrases[parents], added] if before is not None else [added, phrases[parents]])
            now[s] = np.full(len(keys), -1, np.int64)
            now[s][at] = number[code]
            told[s] = (owner[parents], grown)
            # A phrase's words around its pivot, with the pivot itself s places after the first.
            whole = np.column_stack([words[grown[:, :s]], of_key[owner[parents]], words[grown[:, s:]]])
            yield owner[parents], whole, total
        codes, lexicon = now, told
        if not codes:
            return


def _mine(least: int, longest: int, few: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Phrases of the pivots of rows (key, heads, ids) that come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            owners, blobs, told = zip(*rows, strict=True)
            heads, ids = np.frombuffer(b"".join(blobs), np.int32), np.frombuffer(b"".join(told), _narrow(few)).astype(np.int64)
            left, right = heads // longest % longest, heads % longest
            at = np.cumsum(left + right + 1, dtype=np.int64) - right - 1
            each = np.repeat(np.array(owners, np.int64), [len(x) // 4 for x in blobs])
            # A pivot's number: those of a bucket are told apart by their ids, the shares of one by their keys.
            pivots = ids[at]
            names, keys = np.unique(np.where(each < 0, each, pivots), return_inverse=True)
            for _, phrases, total in mined(keys, np.where(names < 0, 1, least), pivots, heads, np.delete(ids, at), longest):
                width = phrases.shape[1] * _WIDTH
                raw = pa.Array.from_buffers(pa.binary(width), len(phrases), [None, pa.py_buffer(np.ascontiguousarray(phrases.astype(">i8")))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([raw, pa.array(total)], names=["gram", "n"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > STEP and row[0] != waiting[-1][0]:
                    yield from out(waiting)
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[1]) // 4
        if waiting:
            yield from out(waiting)

    return run


def phrase_counts(docs: DataFrame, words: DataFrame, few: bool, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(gram, n): the phrases of 2 to longest words with least occurrences or more; gram: the ids of its words.

    words: (lang, word, n, id) of the frequent words, a table that is kept; few: whether it may be broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = _rows(docs, text_col, lang_col)
    powers = [HOT << k for k in range(24)]
    told = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.count_if(F.col("n") > p).alias(f"over{k}") for k, p in enumerate(powers)]).first()
    hot, buckets = [x for x in told[1:] if x], max(4 * parts(spark), told["n"] // MET)
    if few:
        ids: defaultdict[str, dict[bytes, int]] = defaultdict(dict)
        for row in words.select("lang", "word", "id").toLocalIterator():
            ids[row["lang"]][row["word"].encode()] = row["id"]
        ids_of = _by_dictionary(spark.sparkContext.broadcast(dict(ids)))
    else:
        rows, ids_of = _by_join(rows, words), _of_column
    dealt = fragments(rows, ids_of, longest, few, hot, buckets).repartition(parts(spark), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidy(_mine(least, longest, few)), "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _part(gram: Column, first: Column | int, words: Column | int) -> Column:
    """The words of a gram from the first-th on, counted from 1."""
    first, words = (F.lit(x) if isinstance(x, int) else x for x in (first, words))
    return F.substring(gram, (first - 1) * _WIDTH + 1, words * _WIDTH)


def _id_at(gram: Column, at: Column | int) -> Column:
    """The id of a gram's word, counted from 1."""
    return F.conv(F.hex(_part(gram, at, 1)), 16, 10).cast("long")


def score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)), exact for counts of up to 16 digits."""
    whole = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", whole(1000 * a) * whole(n), whole(l) * whole(r)).cast("long")


def scored(grams: DataFrame, singles: DataFrame, totals: DataFrame) -> DataFrame:
    """grams (lang, gram, a) with the cut of the lowest score: l, r, n, score. singles: (gram, f) of the frequent words."""
    counts = grams.select("gram", F.col("a").alias("f")).unionByName(singles)
    longest = F.call_function("div", F.length("gram"), F.lit(_WIDTH)).cast("int")
    cuts = grams.select("lang", "gram", "a", longest.alias("words"), F.explode(F.sequence(F.lit(1), longest - 1)).alias("k"))
    cuts = cuts.withColumn("first", _part(F.col("gram"), 1, F.col("k"))).withColumn("rest", _part(F.col("gram"), F.col("k") + 1, F.col("words") - F.col("k")))
    few = held(counts)
    cuts = cuts.join(few.select(F.col("gram").alias("first"), F.col("f").alias("l")), "first").join(few.select(F.col("gram").alias("rest"), F.col("f").alias("r")), "rest")
    cuts = cuts.join(held(totals), "lang")
    told = F.struct(score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")
    return cuts.groupBy("lang", "gram", "a", "n").agg(F.min(told).alias("best")).select("lang", "gram", "a", "best.l", "best.r", "n", "best.score")


def without_contained(candidates: DataFrame, percent: int = PERCENT) -> DataFrame:
    """candidates (gram, a, ...) less those that a longer one of percent of their occurrences or more contains."""
    words = F.call_function("div", F.length("gram"), F.lit(_WIDTH)).cast("int")
    longer = candidates.select("gram", "a", words.alias("words")).where("words > 2")
    longer = longer.select("gram", "a", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    longer = longer.select("gram", "a", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("at"))
    inside = longer.select(_part(F.col("gram"), F.col("at"), F.col("m")).alias("gram"), F.col("a").alias("_longer")).groupBy("gram").agg(F.max("_longer").alias("_longer"))
    beside = candidates.join(inside, "gram", "left")
    return beside.where(F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("a"))).drop("_longer")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, first: int = FIRST, percent: int = PERCENT
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language by score.

    a counts the phrase, l and r the parts of the cut that scores lowest, n all words of the language.
    """
    counts = kept(word_counts(docs, text_col, lang_col), "word_counts")
    totals = kept(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = kept(counts.where(F.col("n") >= least), "frequent")
    words, few = with_ids(frequent)
    grams = phrase_counts(docs, words, few, text_col, lang_col, least, longest).select("gram", F.col("n").alias("a"), _id_at(F.col("gram"), 1).alias("id"))
    grams = kept(grams.join(held(words.select("id", "lang")), "id").select("lang", "gram", "a"), "grams")
    dropped(counts, frequent)
    singles = words.select(F.unhex(F.lpad(F.hex("id"), 2 * _WIDTH, "0")).alias("gram"), F.col("n").alias("f"))
    candidates = without_contained(kept(scored(grams, singles, totals), "scored"), percent)
    # Ties at the last rank stay until the phrases are spelled.
    order = [F.desc("score"), F.desc("a")]
    best = candidates.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_rank") <= first).drop("_rank")
    length = F.call_function("div", F.length("gram"), F.lit(_WIDTH)).cast("int")
    spelled = best.select("*", F.explode(F.sequence(F.lit(1), length)).alias("_at"))
    spelled = spelled.withColumn("id", _id_at(F.col("gram"), F.col("_at"))).join(held(words.select("id", "word")), "id")
    spelled = spelled.groupBy("lang", "gram", "a", "l", "r", "n", "score").agg(F.sort_array(F.collect_list(F.struct("_at", "word"))).alias("_words"))
    spelled = spelled.withColumn("phrase", F.array_join(F.col("_words.word"), " "))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return spelled.withColumn("rank", rank.cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
