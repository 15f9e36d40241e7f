"""Evaluation: candidate pairs of predicted and labelled ranges, maximum matching, precision, recall, ablations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, paths
from ..session import ship

KEYS = ["language", "path", "category", "cwe_key"]


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with normalized paths and the key cwe_key, which tells apart security findings only."""
    return rows.withColumn("path", paths.normalized(F.col("path"))).withColumn("cwe_key", F.when(F.col("category") == "security", F.col("cwe_id")).otherwise(""))


def candidates(predictions: DataFrame, truth: DataFrame, also: list[str] = ()) -> DataFrame:
    """(also, keys, gt_id, prediction_index, covers, overlap, point, ...): pairs of equal keys whose ranges agree.

    They agree if the prediction covers the sink line or at least half of the labelled range. A range that holds half of
    another holds one of the two lines in its middle, so each agreeing prediction holds one of three points of the label:
    the sink line and these two. A prediction is dealt to the one or two stretches of 2**level lines that it touches; the
    level is the least of 3, 6, 9, ... for which that is as long as it. A label goes once to each stretch of its points, on
    each level that predictions have. They meet by stretch: the pairs looked at are those close by, however many findings a
    file has. The pair counts at the first of the label's points that the prediction holds.
    """
    p = _keyed(predictions).select(*also, *KEYS, "prediction_index", F.col("start_line").alias("p_start"), F.col("end_line").alias("p_end"), "risk_level", F.col("cwe_id").alias("p_cwe"), "fingerprint", *(["position"] if "position" in predictions.columns else []))
    p = p.where("p_start <= p_end").withColumn("_level", 3 * F.greatest(F.lit(1), F.ceil(F.log2(F.col("p_end") - F.col("p_start") + 1) / 3)).cast("int"))
    levels = p.select(F.collect_set("_level").alias("levels"))
    stretch = lambda line: F.floor(line / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    p = p.withColumn("_stretch", F.explode(F.array_distinct(F.array(stretch(F.col("p_start")), stretch(F.col("p_end"))))))
    t = _keyed(truth.where("vulnerable")).select(*KEYS, "gt_id", "sink_line", F.col("start_line").alias("t_start"), F.col("end_line").alias("t_end"))
    half = F.call_function("div", F.col("t_end") - F.col("t_start"), F.lit(2)).cast("int")
    middle = [F.when(F.col("t_start") <= F.col("t_end"), line) for line in (F.col("t_start") + half, F.col("t_end") - half)]
    points = F.array_compact(F.array("sink_line", *middle))
    t = t.withColumn("_level", F.explode(levels.scalar())).withColumn("_stretch", F.explode(F.array_distinct(F.transform(points, stretch))))
    held = F.coalesce(*[F.when(x.between(F.col("p_start"), F.col("p_end")), x) for x in (F.col("sink_line"), *middle)])
    out = p.join(t, [*KEYS, "_level", "_stretch"]).withColumn("point", held).where(stretch(F.col("point")) == F.col("_stretch")).drop("_level", "_stretch")
    out = out.withColumn("covers", numbers.covers(F.col("p_start"), F.col("p_end"), F.col("sink_line"))).withColumn("overlap", numbers.overlap_ratio(F.col("p_start"), F.col("p_end"), F.col("t_start"), F.col("t_end")))
    return out.where("covers or overlap >= 0.5")


def maximum_matching(edges: Iterable[tuple[object, list[object]]]) -> dict[object, object]:
    """right -> left of a largest matching. edges: (left, its rights, best first), in order.

    Each left looks for a free right along an alternating path, depth first; a path is flipped when it ends.
    """
    wanted, owner = dict(edges), {}
    for root in wanted:
        tried: set = set()
        path = [(root, iter(wanted[root]), None)]
        while path:
            left, rest, _ = path[-1]
            right = next((r for r in rest if r not in tried), None)
            if right is None:
                path.pop()
                continue
            tried.add(right)
            path[-1] = (left, rest, right)
            holder = owner.get(right)
            if holder is None:
                for node, _, taken in path:
                    owner[taken] = node
                break
            path.append((holder, iter(wanted[holder]), None))
    return owner


#: The order in which predictions look for a label; it decides among matchings of equal size.
ORDER = ["p_start", "p_end", "p_cwe", "risk_level", "fingerprint", "prediction_index"]


def islands(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs with island: pairs that share a prediction or a label, in one step or over others, are on one island.

    The points of a prediction's or a label's pairs span a stretch of lines; stretches of pairs that share one of the two
    overlap. Islands are the gaps between stretches, which a running maximum over the sorted pairs of a key finds. Pairs are
    shuffled once, by key, for all of that.
    """
    pairs = pairs.repartition(*by)
    own, label = Window.partitionBy(*by, "prediction_index"), Window.partitionBy(*by, "gt_id")
    span = lambda f, pick: pick(f("point").over(own), f("point").over(label))
    out = pairs.withColumn("_from", span(F.min, F.least)).withColumn("_to", span(F.max, F.greatest))
    order = Window.partitionBy(*by).orderBy("_from", "_to", "prediction_index", "gt_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_new", (F.col("_from") > F.coalesce(F.max("_to").over(before), F.col("_from") - 1)).cast("int"))
    return out.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_from", "_to", "_new")


def matched(pairs: DataFrame, also: list[str] = (), order: list[str] = ORDER) -> DataFrame:
    """(also, gt_id, prediction_index, overlap, covers, risk_level, position if pairs have it) of a maximum one-to-one matching.

    Pairs compete only on their island of their key, so islands are matched by themselves: they are dealt by a hash,
    sorted, and read as a stream that holds one island at a time; a file with many findings spreads over the tasks. The
    order of predictions and candidates decides among matchings of equal size. Predictions are added in that order, and
    one that is matched stays matched: the predictions of any prefix of the order that are matched are a largest
    matching of that prefix. also: columns beside the keys that tell lists apart, or keys that are to be given too.
    """
    ship(pairs.sparkSession)
    by = list(dict.fromkeys([*also, *KEYS]))
    keep = [*also, "gt_id", "prediction_index", "overlap", "covers", "risk_level", *(["position"] if "position" in pairs.columns else [])]
    group = [*by, "island"]

    columns = list(dict.fromkeys([*group, *keep]))
    made, label, told = columns.index("prediction_index"), columns.index("gt_id"), [columns.index(c) for c in keep]

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []

        def flush() -> list[tuple]:
            if len(rows) == 1:
                return [tuple(rows[0][c] for c in told)]
            edges: dict = {}
            for r in rows:
                edges.setdefault(r[made], []).append(r[label])
            owner = maximum_matching(edges.items())
            # A pair that comes in several rows is given once.
            return [tuple(r[c] for c in told) for r in rows if owner.get(r[label]) == r[made] and owner.pop(r[label]) is not None]

        for batch in batches:
            out = []
            for r in zip(*[batch[c].tolist() for c in columns], strict=True):
                key = r[: len(group)]
                if key != now and rows:
                    out += flush()
                    rows = []
                now = key
                rows.append(r)
            yield pd.DataFrame(out, columns=keep)
        if rows:
            yield pd.DataFrame(flush(), columns=keep)

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    dealt = islands(pairs, by).repartition(*group).sortWithinPartitions(*group, *order, F.desc("covers"), F.desc("overlap"), "gt_id")
    return dealt.select(*columns).mapInPandas(match, ", ".join(f"{c} {kinds[c]}" for c in keep))


def unmatched(truth: DataFrame, predictions: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled findings and predictions without a partner."""
    return truth.where("vulnerable").join(matches, "gt_id", "left_anti"), predictions.join(matches, "prediction_index", "left_anti")


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    precision, recall = numbers.ratio(tp, tp + fp), numbers.ratio(tp, tp + fn)
    return [precision.alias("precision"), recall.alias("recall"), numbers.f1(precision, recall).alias("f1")]


def evaluation(predictions: DataFrame, truth: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """Counts, precision, recall, F1, false positives among high risks, and localization, by (by, language)."""
    p = predictions.groupBy(*by).agg(F.count("*").alias("n_predictions"), F.count_if(F.col("risk_level") == "High").alias("n_high"))
    t = truth.where("vulnerable").groupBy("language").agg(F.count("*").alias("n_truth"))
    m = matches.groupBy(*by).agg(F.count("*").alias("tp"), F.count_if(F.col("risk_level") == "High").alias("tp_high"), F.count_if("covers").alias("localized"))
    out = p.join(m, by, "left").join(t, "language", "left").fillna(0, ["tp", "tp_high", "localized", "n_truth"])
    out = out.withColumn("fp", F.col("n_predictions") - F.col("tp")).withColumn("fn", F.col("n_truth") - F.col("tp"))
    return out.select(
        *by, "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")), numbers.ratio(F.col("n_high") - F.col("tp_high"), F.col("n_high")).alias("high_risk_fp_rate"),
        numbers.ratio(F.col("localized"), F.col("tp")).alias("localization_rate"),
    )


def recall_by_prefix(predictions: DataFrame, truth: DataFrame, ks: list[int], by: list[str]) -> DataFrame:
    """(by, k, recall): of the first k predictions of each list, for every k from one matching. predictions: position from 0.

    Predictions look for labels in the order of their positions, so those of the first k that end up matched are as many
    as the first k alone can match.
    """
    found = matched(candidates(predictions, truth, [c for c in by if c not in KEYS]), by, ["position", *ORDER])
    counts = found.groupBy(*by).agg(F.array(*[F.struct(F.lit(k).alias("k"), F.count_if(F.col("position") < k).alias("tp")) for k in ks]).alias("_told"))
    t = truth.where("vulnerable").groupBy("language").agg(F.count("*").alias("n_truth"))
    none = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(0).cast("long").alias("tp")) for k in ks])
    out = predictions.select(*by).distinct().join(counts, by, "left").withColumn("_k", F.explode(F.coalesce("_told", none))).join(t, "language", "left")
    return out.select(*by, "_k.k", numbers.ratio(F.col("_k.tp"), F.coalesce("n_truth", F.lit(0))).alias("recall"))


def macro(per_run: DataFrame, by: list[str], run: str, metrics: list[str]) -> DataFrame:
    """Mean over languages of each run, then mean and population deviation over the runs."""
    runs = per_run.groupBy(*by, run).agg(*[F.avg(m).alias(m) for m in metrics])
    return runs.groupBy(*by).agg(*[f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])
