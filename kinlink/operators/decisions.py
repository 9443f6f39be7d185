"""Metrics, thresholds, ownership and error accounting over candidate pairs.

Truth and predictions are (s1_id, target_id) rows, the roster one row per
owner. Owners without rows stay in every denominator.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f_half(g: Column, k: Column, t: Column) -> Column:
    """F0.5 of t hits among k predictions for g true links; 1 if both are empty."""
    return F.when((g == 0) & (k == 0), F.lit(1.0)).when(t == 0, F.lit(0.0)).otherwise(1.25 * t / (0.25 * g + k))


def per_owner(predicted: DataFrame, truth: DataFrame, roster: DataFrame) -> DataFrame:
    """s1_id, g, k, t, f for every owner of the roster, in one shuffle of flagged rows."""
    p = predicted.select("s1_id", "target_id", F.lit(1).alias("k"), F.lit(0).alias("g"))
    g = truth.select("s1_id", "target_id", F.lit(0).alias("k"), F.lit(1).alias("g"))
    pairs = p.unionByName(g).groupBy("s1_id", "target_id").agg(F.max("k").alias("k"), F.max("g").alias("g"))
    counts = pairs.groupBy("s1_id").agg(F.sum("g").alias("g"), F.sum("k").alias("k"), F.sum(F.col("g") * F.col("k")).alias("t"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return roster.select("s1_id").join(counts, "s1_id", "left").select("s1_id", zero("g"), zero("k"), zero("t")).withColumn("f", f_half(F.col("g"), F.col("k"), F.col("t")))


def summary(scores: DataFrame) -> DataFrame:
    """One row: macro F0.5, link precision and recall, empty and false-positive shares."""
    rate = lambda n, d: F.try_divide(n.cast("double"), F.nullif(d, F.lit(0)).cast("double"))
    return scores.agg(
        F.count(F.lit(1)).alias("owners"),
        F.avg("f").alias("macro_f"),
        rate(F.sum("t"), F.sum("k")).alias("precision"),
        rate(F.sum("t"), F.sum("g")).alias("recall"),
        F.avg((F.col("k") == 0).cast("double")).alias("empty_rate"),
        rate(F.count_if((F.col("g") == 0) & (F.col("k") > 0)), F.count_if(F.col("g") == 0)).alias("singleton_fp_rate"),
    )


#: The reference's grid, as its arange gives it: 0.05 to 1 in steps of 0.005, and one over all scores.
FINE_GRID = (*np.arange(0.05, 1, 0.005).tolist(), 1.000001)


def level_of(p: Column, steps: int, grid: tuple[float, ...] | None) -> Column:
    """Place of the highest threshold that p reaches in ``grid`` (ascending) or among k/steps; negative for none."""
    if grid is None:
        return F.least(F.floor(p * steps + 1e-9).cast("int"), F.lit(steps))
    return F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= p)) - 1


def threshold_sweep(scored: DataFrame, truth: DataFrame, roster: DataFrame, steps: int = 20, grid: tuple[float, ...] | None = None) -> DataFrame:
    """threshold, macro_f for the thresholds of ``grid``, or for k/steps and one over all scores.

    A pair counts for every threshold up to its score: per owner and step only
    sums are kept, then running sums give every threshold's counts, so pairs
    are never multiplied by thresholds.
    """
    labelled = scored.join(truth.withColumn("_true", F.lit(1)), ["s1_id", "target_id"], "left")
    sums = labelled.groupBy("s1_id", level_of(F.col("p"), steps, grid).alias("level")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.coalesce("_true", F.lit(0))).alias("t"))
    last = steps + 1 if grid is None else len(grid) - 1
    levels = roster.select("s1_id").join(truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("g")), "s1_id", "left").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(last))))
    above = Window.partitionBy("s1_id").orderBy(F.desc("level"))
    at = levels.join(sums, ["s1_id", "level"], "left").select("level", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce(F.sum("k").over(above), F.lit(0)).alias("k"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"))
    threshold = F.col("level") / steps if grid is None else F.element_at(F.array(*[F.lit(t) for t in grid]), F.col("level") + 1)
    return at.groupBy("level").agg(F.avg(f_half(F.col("g"), F.col("k"), F.col("t"))).alias("macro_f")).select(threshold.alias("threshold"), "macro_f")


def best(table: DataFrame) -> DataFrame:
    """The row of the best macro F; ties to the higher threshold."""
    return table.orderBy(F.desc(F.round("macro_f", 9)), F.desc("threshold")).limit(1)


def one_owner(accepted: DataFrame) -> DataFrame:
    """The claim of highest p of each target, ties to the smaller owner: an aggregate, so a contested target is no window. A claim without a p is none."""
    order = F.struct(-F.col("p"), F.col("s1_id"))
    rest = [c for c in accepted.columns if c != "target_id"]
    return accepted.where(F.col("p").isNotNull()).groupBy("target_id").agg(F.min_by(F.struct(*rest), order).alias("_x")).select("target_id", "_x.*").select(*accepted.columns)


def claims(scored: DataFrame) -> DataFrame:
    """Claimants of each pair's target and the best other p (second for the winner, first for the rest)."""
    top = scored.groupBy("target_id").agg(F.count(F.lit(1)).alias("claimants"), F.min(F.struct((-F.col("p")).alias("p"), F.col("s1_id"))).alias("_best"))
    joined = scored.join(top, "target_id").withColumn("_won", F.col("s1_id") == F.col("_best.s1_id"))
    second = joined.where(~F.col("_won")).groupBy("target_id").agg(F.max("p").alias("_second"))
    return joined.join(second, "target_id", "left").select("s1_id", "target_id", "p", "claimants", F.when(F.col("_won"), F.col("_second")).otherwise(-F.col("_best.p")).alias("best_other_p"))


def error_ledger(candidates: DataFrame, accepted: DataFrame, final: DataFrame, truth: DataFrame) -> DataFrame:
    """error, pairs: true links not retrieved, rejected or lost to another owner, and false links kept."""
    flags = [df.select("s1_id", "target_id", *[F.lit(int(n == m)).alias(m) for m in "catf"]) for n, df in zip("caft", (candidates, accepted, final, truth), strict=True)]
    rows = flags[0]
    for f in flags[1:]:
        rows = rows.unionByName(f)
    pair = rows.groupBy("s1_id", "target_id").agg(*[F.max(m).alias(m) for m in "catf"])
    kind = (
        F.when((F.col("t") == 1) & (F.col("c") == 0), "retrieval miss")
        .when((F.col("t") == 1) & (F.col("a") == 0), "rejected")
        .when((F.col("t") == 1) & (F.col("f") == 0), "ownership loss")
        .when((F.col("t") == 0) & (F.col("f") == 1), "false accept")
    )
    return pair.withColumn("error", kind).where("error IS NOT NULL").groupBy("error").agg(F.count(F.lit(1)).alias("pairs"))


def id_lists(links: DataFrame, roster: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row per owner: its sorted distinct targets, comma-joined, "" for none."""
    lists = links.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias(column))
    return roster.select("s1_id").join(lists, "s1_id", "left").select("s1_id", F.coalesce(column, F.lit("")).alias(column))
