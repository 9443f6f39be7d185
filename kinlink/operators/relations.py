"""Plain relational forms: restricted, checked and set-wise joins, shares, nearest ranks, missing rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def restrict(frame: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``; a key that repeats there multiplies nothing."""
    return frame.join(keys, on, "left_semi")


def without(frame: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key doesn't occur in ``keys``."""
    return frame.join(keys, on, "left_anti")


def checked_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that raises where it would lose or multiply rows of ``left``."""
    of_key = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    bad = left.join(of_key, on, "left").agg(F.count_if(F.col("_n").isNull()).alias("lost"), F.count_if(F.col("_n") > 1).alias("multiplied")).first()
    if bad["lost"] or bad["multiplied"]:
        raise ValueError(f"{bad['lost']} rows lost, {bad['multiplied']} multiplied")
    return left.join(right, on)


def same_set(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """One row: distinct keys on one side alone, and whether there are none."""
    flags = a.select(*on, F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(b.select(*on, F.lit(0), F.lit(1))).groupBy(*on).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    sums = flags.agg(F.count_if(F.col("y") == 0).alias("left_only"), F.count_if(F.col("x") == 0).alias("right_only"))
    return sums.withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def shares(frame: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """Rows per key, and their share of the rows of ``within`` (of all rows, if that is empty)."""
    counts = frame.groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("n"))
    totals = frame.groupBy(*within).agg(F.count(F.lit(1)).alias("_total")) if within else frame.agg(F.count(F.lit(1)).alias("_total"))
    joined = counts.join(totals, within) if within else counts.crossJoin(F.broadcast(totals))  # one row
    return joined.withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def count_profile(rows: DataFrame, roster: DataFrame, owner: str, q: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """owners, mean, p95 (nearest rank) and max of rows an owner, owners without rows included; per ``by`` where rows have groups.

    The quantile is read off a histogram of counts, so no task sorts owners.
    """
    by = by or []
    owners = roster.select(owner).distinct()
    groups = rows.select(*by).distinct() if by else None
    base = owners.crossJoin(F.broadcast(groups)) if by else owners  # groups: a grid of settings
    counts = base.join(rows.groupBy(*by, owner).agg(F.count(F.lit(1)).alias("n")), [*by, owner], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    histogram = counts.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("f"))
    up_to = Window.partitionBy(*by).orderBy("n")
    whole = Window.partitionBy(*by)
    ranked = histogram.withColumns({"_c": F.sum("f").over(up_to), "_t": F.sum("f").over(whole)})
    at = F.floor((F.col("_t") - 1) * q + 0.5) + 1
    return ranked.groupBy(*by).agg(F.sum("f").alias("owners"), (F.sum(F.col("n") * F.col("f")) / F.sum("f")).alias("mean_candidates"), F.min(F.when(F.col("_c") >= at, F.col("n"))).alias("p95_candidates"), F.max("n").alias("max_candidates"))


def missing_rates(frame: DataFrame, columns: list[str], label: str) -> DataFrame:
    """feature, missing_rate, and its mean among rows of label 0 and 1: one pass, then turned."""
    measures = [m for c in columns for m in (F.avg(F.col(c).isNull().cast("double")).alias(f"{c}__0"), F.avg(F.when(F.col(label) == 0, F.col(c))).alias(f"{c}__1"), F.avg(F.when(F.col(label) == 1, F.col(c))).alias(f"{c}__2"))]
    row = frame.agg(*measures)
    turned = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__0").alias("missing_rate"), F.col(f"{c}__1").alias("mean_label_0"), F.col(f"{c}__2").alias("mean_label_1")) for c in columns])
    return row.select(F.inline(turned))
