"""Second-stage evidence: seeds, support features, two-threshold policies, owner bootstrap.

Candidates are (s1_id, target_id, source, p) rows with the target's name,
address and numbers. An owner's candidates are bounded by the retrieval
budgets, so its windows are; nothing is gathered per target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.functions.similarity import SCORERS
from kinlink.operators.decisions import level_of

#: Thresholds tried for seeds, least number of seed links, least observed precision.
SEED_THRESHOLDS = (0.9, 0.95, 0.98, 0.99, 0.995, 0.999)
SEED_LINKS, SEED_PRECISION = 200, 0.995


def _evident(scored: DataFrame, threshold: float) -> DataFrame:
    """Rows of at least ``threshold`` that have a name or an address."""
    return scored.where((F.col("p") >= threshold) & (F.concat(F.coalesce("t_name", F.lit("")), F.coalesce("t_address", F.lit(""))) != ""))


def seeds(scored: DataFrame, threshold: float, per: tuple[str, ...] = ("s1_id",), limit: int = 2) -> DataFrame:
    """The ``limit`` surest rows of each group ``per``, one of each (name, address); ties to the smaller target. Labels play no part."""
    surest = (F.desc("p"), "target_id")
    one = Window.partitionBy(*per, "t_name", "t_address").orderBy(*surest)
    first = _evident(scored, threshold).withColumn("_r", F.row_number().over(one)).where("_r = 1")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(*per).orderBy(*surest))).where(F.col("_r") <= limit).drop("_r")


def seed_trials(scored: DataFrame, thresholds: tuple[float, ...] = SEED_THRESHOLDS, links: int = SEED_LINKS, precision: float = SEED_PRECISION) -> DataFrame:
    """threshold, seed_links, correct_seed_links, observed_precision, owner_coverage, chosen.

    Seeds of a higher threshold are those of the lowest that reach it, so all
    trials take one pass. Chosen is the lowest eligible threshold, the highest
    if none is.
    """
    owners = scored.agg(F.count_distinct("s1_id").alias("_owners"))
    picked = seeds(scored, min(thresholds), ("s1_id", "source"))
    grid = scored.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    reached = picked.withColumn("threshold", F.explode(F.array(*[F.when(F.col("p") >= t, F.lit(t)) for t in thresholds]))).where("threshold IS NOT NULL")
    sums = reached.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("c"), F.count_distinct("s1_id").alias("o"))
    table = grid.join(F.broadcast(sums), "threshold", "left").crossJoin(F.broadcast(owners))  # a row each threshold, and one row
    table = table.select(
        "threshold",
        F.coalesce("n", F.lit(0)).cast("long").alias("seed_links"),
        F.coalesce("c", F.lit(0)).cast("long").alias("correct_seed_links"),
        F.try_divide("c", "n").alias("observed_precision"),
        F.coalesce(F.try_divide("o", "_owners"), F.lit(0.0)).alias("owner_coverage"),
    )
    able = (F.col("seed_links") >= links) & (F.col("observed_precision") >= precision)
    best = F.coalesce(F.min(F.when(able, F.col("threshold"))).over(Window.partitionBy()), F.lit(max(thresholds)))  # over a row a threshold
    return table.withColumn("chosen", F.col("threshold") == best)


def support_features(scored: DataFrame, threshold: float) -> DataFrame:
    """Fifteen columns a pair: its own p, the owner's best other, and the evidence of seeds of the same and of the other source.

    A pair is never its own seed. Of each owner and source three evidence
    groups with two members are kept: leaving a pair out removes one group at
    most, so the two best others are always among them. Missing measures are
    null.
    """
    surest = (F.desc("p"), "target_id")
    whole = Window.partitionBy("s1_id").orderBy(*surest).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(*surest))
    base = scored.select("s1_id", "target_id", "source", "p", "t_name", "t_address", "t_numbers", F.when(place == 1, F.nth_value("p", 2).over(whole)).otherwise(F.first("p").over(whole)).alias("best_other_p"))
    group = Window.partitionBy("s1_id", "source", "t_name", "t_address")
    pool = _evident(base, threshold).withColumns({"_m": F.row_number().over(group.orderBy(*surest)), "_lead": F.min(F.struct((-F.col("p")).alias("p"), "target_id")).over(group)})
    pool = pool.withColumn("_g", F.dense_rank().over(Window.partitionBy("s1_id", "source").orderBy("_lead"))).where("_m <= 2 AND _g <= 3")
    seed = F.struct((-F.col("p")).alias("minus_p"), F.col("target_id"), F.col("source"), F.col("_g").alias("g"), F.col("t_name").alias("name"), F.col("t_address").alias("address"), F.col("t_numbers").alias("numbers"))
    pools = pool.groupBy("s1_id").agg(F.array_sort(F.collect_list(seed)).alias("_pool"))

    def chosen(same: bool) -> Column:
        """The first two others of the pool, one of each evidence group."""
        others = F.filter("_pool", lambda x: (x.target_id != F.col("target_id")) & ((x.source == F.col("source")) if same else (x.source != F.col("source"))))
        return F.slice(F.filter(others, lambda x, i: ~F.exists(F.slice(others, F.lit(1), i), lambda y: (y.g == x.g) & (y.source == x.source))), 1, 2)

    none = F.array().cast(pools.schema["_pool"].dataType)
    marked = [F.transform(F.coalesce(chosen(same), none), lambda x: F.struct(F.lit(same).alias("same"), x.alias("seed"))) for same in (True, False)]  # noqa: B023
    both = base.join(pools, "s1_id", "left").withColumn("_seeds", F.concat(*marked))
    rows = both.select("s1_id", "target_id", "p", "best_other_p", "t_name", "t_address", "t_numbers", F.explode_outer("_seeds").alias("s"))
    rows = rows.withColumns({"_n": SCORERS["token_set"](F.col("t_name"), F.col("s.seed.name")), "_a": SCORERS["token_set"](F.col("t_address"), F.col("s.seed.address"))})
    told = (F.size("t_numbers") > 0) & (F.size("s.seed.numbers") > 0)
    rows = rows.withColumn("_c", F.when(told, (~F.arrays_overlap("t_numbers", "s.seed.numbers")).cast("double")))
    measures = [F.first("p").alias("p1"), F.first("best_other_p").alias("best_other_p"), (F.first("p") - F.first("best_other_p")).alias("p1_gap_other")]
    for name, same in (("same", True), ("cross", False)):
        of = lambda c, same=same: F.when(F.col("s.same") == same, c)
        measures += [
            F.count(of(F.lit(1))).alias(f"{name}_support_count"),
            F.max(of(-F.col("s.seed.minus_p"))).alias(f"{name}_support_max_p"),
            F.max(of(F.col("_n"))).alias(f"{name}_support_name_similarity"),
            F.max(of(F.col("_a"))).alias(f"{name}_support_address_similarity"),
            F.max(of((F.col("_n") + F.col("_a")) / 2)).alias(f"{name}_support_joint_similarity"),
            F.avg(of(F.col("_c"))).alias(f"{name}_support_number_conflict_share"),
        ]
    return rows.groupBy("s1_id", "target_id").agg(*measures)


def policy_grid(reference: float) -> tuple[float, ...]:
    """The reference's grid of two thresholds: steps of 0.01, its one threshold, and one over all scores."""
    return tuple(np.unique(np.r_[np.round(np.arange(0.05, 1, 0.01), 8), reference, 1.000001]).tolist())


def two_threshold_sweep(scored: DataFrame, truth: DataFrame, roster: DataFrame, missing: str, steps: int = 20, grid: tuple[float, ...] | None = None) -> DataFrame:
    """address_threshold, missing_threshold, macro_f, one_threshold over the square of ``grid``, or of k/steps and one over all scores.

    Pairs are summed once per owner, field state and step; each task then adds
    its owners' scores up over the square, so one row a cell leaves it.
    """
    thresholds = [k / steps for k in range(steps + 2)] if grid is None else list(grid)
    size = len(thresholds)
    labelled = scored.join(truth.withColumn("_true", F.lit(1)), ["s1_id", "target_id"], "left")
    state = F.coalesce((F.col(missing) == 1).cast("int"), F.lit(0))
    sums = labelled.groupBy("s1_id", state.alias("m"), level_of(F.col("p"), steps, grid).alias("level")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.coalesce("_true", F.lit(0))).alias("t"))
    cells = sums.where("level >= 0").groupBy("s1_id").agg(F.collect_list(F.array(*[F.col(c).cast("long") for c in ("m", "level", "k", "t")])).alias("cells"))  # 2 * len(thresholds) at most
    own = roster.select("s1_id").join(truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("g")), "s1_id", "left").join(cells, "s1_id", "left").select(F.coalesce("g", F.lit(0)).alias("g"), "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size)), 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                g, rows = b.column(0).slice(at, 64).to_numpy(), b.column(1).slice(at, 64).to_pylist()
                counts = np.zeros((2, 2, len(rows), size))  # pairs and hits, state, owner, step
                for o, own_cells in enumerate(rows):
                    for m, level, k, t in own_cells or ():
                        counts[0, m, o, level] += k
                        counts[1, m, o, level] += t
                counts = counts[..., ::-1].cumsum(-1)[..., ::-1]
                k, t = counts[:, 0, :, :, None] + counts[:, 1, :, None, :]
                below = 0.25 * g[:, None, None] + k
                total += np.where(below > 0, 1.25 * t / np.maximum(below, 0.25), 1.0).sum(0)
                n += len(rows)
        if n:
            a, c = np.divmod(np.arange(size * size), size)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(c, pa.int32()), pa.array(total.ravel()), pa.array(np.full(size * size, n), pa.int64())], names=["a", "b", "f", "n"])

    macro = own.mapInArrow(run, "a int, b int, f double, n long").groupBy("a", "b").agg((F.sum("f") / F.sum("n")).alias("macro_f"))
    value = F.array(*[F.lit(t) for t in thresholds])
    return macro.select(F.element_at(value, F.col("a") + 1).alias("address_threshold"), F.element_at(value, F.col("b") + 1).alias("missing_threshold"), "macro_f", (F.col("a") == F.col("b")).alias("one_threshold"))


def best_policy(table: DataFrame) -> DataFrame:
    """The best row; ties to equal thresholds, then to higher ones."""
    return table.orderBy(F.desc(F.round("macro_f", 9)), F.desc("one_threshold"), F.desc("address_threshold"), F.desc("missing_threshold")).limit(1)


def apply_policy(scored: DataFrame, missing: str, address_threshold: float, missing_threshold: float) -> DataFrame:
    return scored.where(F.col("p") >= F.when(F.col(missing) == 1, F.lit(missing_threshold)).otherwise(F.lit(address_threshold)))


def paired_owners(before: DataFrame, after: DataFrame) -> DataFrame:
    """s1_id, before_f, after_f, delta of the owners that both hold."""
    return before.select("s1_id", F.col("f").alias("before_f")).join(after.select("s1_id", F.col("f").alias("after_f")), "s1_id").withColumn("delta", F.col("after_f") - F.col("before_f"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """One row: macro scores, their difference, and how many owners gained or lost."""
    return pairs.agg(
        F.count(F.lit(1)).alias("owners"), F.avg("before_f").alias("before_macro_f"), F.avg("after_f").alias("after_macro_f"), F.avg("delta").alias("paired_delta"),
        F.count_if(F.col("delta") > 1e-12).alias("improved_owners"), F.count_if(F.col("delta") < -1e-12).alias("worsened_owners"), F.count_if(F.abs("delta") <= 1e-12).alias("unchanged_owners"),
    )


def owner_bootstrap(owners: DataFrame, ratios: dict[str, tuple[str | None, str | None]], repeats: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """measure, estimate, low, high of ratios of sums (a null denominator: of means), whole owners resampled.

    A Poisson bootstrap: every owner draws its own weights from its hash, so
    each partition sends one sum a repeat and no owner leaves its executor.
    Repeats whose denominator is zero take no part.
    """
    names = list(ratios)
    sides = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c else F.lit(1.0) for pair in ratios.values() for c in pair]
    drawn = owners.select(F.xxhash64("s1_id").alias("h"), F.array(*sides).alias("v"))

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((repeats + 1, 2 * len(names)))  # the last row: every owner once
        for batch in batches:
            values = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            total[-1] += values.sum(0)
            for at in range(0, batch.num_rows, 256):
                hashes = batch.column(0).slice(at, 256).to_pylist()
                weights = np.stack([np.random.default_rng([seed, h & (2**64 - 1)]).poisson(1.0, repeats) for h in hashes])
                total[:-1] += weights.T @ values[at : at + 256]
        yield pa.RecordBatch.from_arrays([pa.array(range(repeats + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["repeat", "sums"])

    sums = drawn.mapInArrow(resample, "repeat int, sums array<double>").groupBy("repeat").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(2 * len(names))])
    long = sums.select("repeat", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.try_divide(f"s{2 * k}", f"s{2 * k + 1}").alias("value")) for k, n in enumerate(names)])).alias("x")).select("repeat", "x.*")
    again, edge = F.when(F.col("repeat") < repeats, F.col("value")), (1 - level) / 2
    return long.groupBy("measure").agg(F.max(F.when(F.col("repeat") == repeats, F.col("value"))).alias("estimate"), F.percentile(again, F.lit(edge)).alias("low"), F.percentile(again, F.lit(1 - edge)).alias("high"))


def promotes(select_gain: float, low_over_direct: float, low_over_control: float, country_deltas: list[float]) -> bool:
    """Whether a second model replaces the first: a Select gain, both lower bounds over zero, and no country that loses."""
    return select_gain > 0 and low_over_direct > 0 and low_over_control > 0 and bool(country_deltas) and min(country_deltas) >= 0
