"""Salted stable hashing, roles, stratified samples and negatives."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Cumulative bounds of the roles.
ROLE_BOUNDS = (("fit", 0.60), ("tune", 0.70), ("calibrate", 0.80), ("audit", 1.00))


def stable_unit(c: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 32 bits of sha256(salt|id): the same in every engine."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), c), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def blake_unit(c: Column, salt: str) -> Column:
    """A number in [0, 1) from the 64-bit BLAKE2b of salt|id, big-endian: the reference's own units. Spark has no such function, so an Arrow one."""

    @F.pandas_udf(DoubleType())
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: int.from_bytes(hashlib.blake2b(f"{salt}|{i}".encode(), digest_size=8).digest(), "big") / 2.0**64)

    return run(c)


def unowned_weights(sample: DataFrame, truth: DataFrame, times: float = 2.0) -> DataFrame:
    """Weights of negatives whose target has no owner, ``times`` over, and the flag ``unowned``. Labels only, never a feature."""
    owned = truth.select("target_id").distinct().withColumn("_owned", F.lit(1))
    flagged = sample.join(owned, "target_id", "left").withColumn("unowned", (F.col("label") == 0) & F.col("_owned").isNull()).drop("_owned")
    return flagged.withColumn("weight", F.when(F.col("unowned"), F.col("weight") * times).otherwise(F.col("weight")))


def role(unit: Column) -> Column:
    chosen = F.lit(ROLE_BOUNDS[-1][0])
    for name, bound in reversed(ROLE_BOUNDS[:-1]):
        chosen = F.when(unit < bound, name).otherwise(chosen)
    return chosen


def stratified_take(pool: DataFrame, n: int, strata: list[str], unit: str) -> DataFrame:
    """``n`` rows, proportional to the strata by largest remainder, smallest units first."""
    sizes = pool.groupBy(*strata).agg(F.count(F.lit(1)).alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    share = sizes.crossJoin(F.broadcast(total)).withColumn("_exact", F.col("_size") * F.lit(float(n)) / F.col("_total"))  # one row beside each stratum
    floors = share.withColumn("_floor", F.floor("_exact"))
    left = F.lit(n) - F.sum("_floor").over(Window.partitionBy())
    order = Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), *strata)
    quota = floors.withColumn("_quota", F.col("_floor") + (F.row_number().over(order) <= left).cast("int")).select(*strata, "_quota")
    ranked = pool.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(unit)))
    return ranked.join(F.broadcast(quota), strata).where("_r <= _quota").drop("_r", "_quota")


def sample_negatives(frame: DataFrame, hardness: str, unit: str, cap: int = 32, hard: int = 8) -> DataFrame:
    """All positives and ``hard`` hardest negatives at weight 1, ``cap - hard`` others by smallest unit at their inverse inclusion."""
    w = Window.partitionBy("s1_id", "label")
    ranked = frame.withColumn("_h", F.row_number().over(w.orderBy(F.desc(hardness), "target_id")))
    ranked = ranked.withColumns({"_hard": (F.col("label") == 0) & (F.col("_h") <= hard)})
    rest = Window.partitionBy("s1_id", "label", "_hard")
    ranked = ranked.withColumns({"_u": F.row_number().over(rest.orderBy(unit, "target_id")), "_n": F.count(F.lit(1)).over(rest)})
    kept = ranked.where((F.col("label") == 1) | F.col("_hard") | (F.col("_u") <= cap - hard))
    weight = F.when((F.col("label") == 1) | F.col("_hard"), F.lit(1.0)).otherwise(F.col("_n") / F.least(F.col("_n"), F.lit(cap - hard)).cast("double"))
    return kept.withColumn("weight", weight).drop("_h", "_hard", "_u", "_n")
