"""Reports over candidates, decisions and scores, each as few aggregates over one flagged table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.operators.decisions import best, claims, f_half, one_owner, per_owner, threshold_sweep
from kinlink.operators.relations import count_profile

KEYS = ["s1_id", "target_id"]
#: Retrieval budgets tried, and the limits that a chosen one keeps.
WORD_BUDGETS, MISSING_BUDGETS = (50, 100, 200), (0, 25, 50, 100)
MEAN_LIMIT, P95_LIMIT, TARGET_RECALL = 400, 500, 0.995


def two_step_threshold(scored: DataFrame, truth: DataFrame, roster: DataFrame) -> DataFrame:
    """threshold, macro_f of the best hundredth, or of the best two thousandth within a hundredth of it; ties to the higher.

    Answering nothing at all is the threshold infinity.
    """
    coarse = threshold_sweep(scored, truth, roster, grid=(*np.round(np.arange(0.01, 1.0, 0.01), 2).tolist(), float("inf")))
    at = best(coarse).first()["threshold"]
    if np.isinf(at):
        return best(coarse)
    low, high = max(at - 0.01, 0.0), min(at + 0.01, 1.0)
    fine = threshold_sweep(scored, truth, roster, grid=tuple(np.unique(np.round(np.arange(low, high + 1e-9, 0.0005), 4)).tolist()))
    return best(coarse.unionByName(fine).dropDuplicates(["threshold"]))


def loss_decomposition(candidates: DataFrame, accepted: DataFrame, truth: DataFrame, roster: DataFrame) -> DataFrame:
    """One row: what retrieval, rejection, false acceptance and (signed) ownership cost in macro F0.5; they sum to total_loss."""
    flags = [df.select(*KEYS, *[F.lit(int(n == m)).alias(m) for m in "caft"]) for n, df in zip("caft", (candidates, accepted, one_owner(accepted), truth), strict=True)]
    rows = flags[0].unionAll(flags[1]).unionAll(flags[2]).unionAll(flags[3])
    pair = rows.groupBy(*KEYS).agg(*[F.max(m).alias(m) for m in "caft"])
    on = lambda e: F.sum(F.expr(e))
    sums = pair.groupBy("s1_id").agg(F.sum("t").alias("g"), on("t * c").alias("tc"), on("t * a").alias("ta"), on("a").alias("ka"), on("f").alias("kf"), on("t * f").alias("tf"))
    own = roster.select("s1_id").join(sums, "s1_id", "left").na.fill(0, ["g", "tc", "ta", "ka", "kf", "tf"])
    g = F.col("g")
    f = [f_half(g, F.col(k), F.col(t)) for k, t in (("tc", "tc"), ("ta", "ta"), ("ka", "ta"), ("kf", "tf"))]
    losses = {"retrieval_loss": 1 - f[0], "rejection_loss": f[0] - f[1], "false_acceptance_loss": f[1] - f[2], "ownership_loss": f[2] - f[3], "total_loss": 1 - f[3]}
    return own.agg(*[F.avg(c).alias(n) for n, c in losses.items()])


def errors(candidates: DataFrame, accepted: DataFrame, final: DataFrame, truth: DataFrame) -> DataFrame:
    """KEYS and the error of every pair that went wrong."""
    flags = [df.select(*KEYS, *[F.lit(int(n == m)).alias(m) for m in "caft"]) for n, df in zip("caft", (candidates, accepted, final, truth), strict=True)]
    pair = flags[0].unionAll(flags[1]).unionAll(flags[2]).unionAll(flags[3]).groupBy(*KEYS).agg(*[F.max(m).alias(m) for m in "caft"])
    kind = F.when(F.expr("t = 1 AND c = 0"), "retrieval miss").when(F.expr("t = 1 AND a = 0"), "rejected").when(F.expr("t = 1 AND f = 0"), "ownership loss").when(F.expr("t = 0 AND f = 1"), "false accept")
    return pair.select(*KEYS, kind.alias("error")).where("error IS NOT NULL")


def ownership(accepted: DataFrame, by: str) -> DataFrame:
    """Per ``by``: accepted links, those on contested targets, those the one-owner rule drops, and their share."""
    told = claims(accepted).join(accepted.select(*KEYS, by), KEYS)
    kept = one_owner(accepted).select(*KEYS, F.lit(1).alias("_kept"))
    rows = told.join(kept, KEYS, "left")
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("claimants") > 1).alias("contested_links"), F.count_if(F.col("_kept").isNull()).alias("dropped"))
    return sums.withColumn("dropped_share", F.col("dropped") / F.col("accepted"))


def runner_up_gap(accepted: DataFrame) -> DataFrame:
    """One row over contested targets: the median gap between the best and the second p, and how often it is small."""
    tops = accepted.groupBy("target_id").agg(F.max("p").alias("_top"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = one_owner(accepted).select(*KEYS, F.lit(1).alias("_won"))
    second = accepted.join(tops, "target_id").join(first, KEYS, "left").where("_won IS NULL").groupBy("target_id").agg((F.first("_top") - F.max("p")).alias("gap"))
    return second.agg(F.median("gap").alias("median_gap"), F.avg((F.col("gap") < 0.05).cast("double")).alias("under_0_05"), F.avg((F.col("gap") < 0.10).cast("double")).alias("under_0_10"))


def headline(accepted: DataFrame, rule: DataFrame, truth: DataFrame, roster: DataFrame) -> DataFrame:
    """One row: macro F0.5 of the accepted pairs, of a plain rule and of no answers, and the targets accepted once and more often."""
    macro = lambda pairs, name: per_owner(pairs, truth, roster).agg(F.avg("f").alias(name))
    targets = accepted.groupBy("target_id").agg(F.count_distinct("s1_id").alias("n")).agg(F.count(F.lit(1)).alias("accepted_targets"), F.count_if(F.col("n") > 1).alias("contested_targets"))
    return macro(accepted, "macro_f").crossJoin(macro(rule, "rule_macro_f")).crossJoin(macro(accepted.limit(0), "empty_macro_f")).crossJoin(targets)  # one row each


def budget_table(union: DataFrame, truth: DataFrame, roster: DataFrame, words: tuple[int, ...] = WORD_BUDGETS, missing: tuple[int, ...] = MISSING_BUDGETS) -> DataFrame:
    """word_k, missing_k, mean and p95 candidates, eligible, recall, misses, oracle_f05 and the chosen budget.

    Chosen among the eligible is the smallest that reaches the target recall,
    else the one with the best oracle.
    """
    spark = union.sparkSession
    grid = spark.createDataFrame([(w, m) for w in words for m in missing], "word_k int, missing_k int")
    by = ["word_k", "missing_k"]
    kept = union.join(F.broadcast(grid), (F.col("word_rank") <= F.col("word_k")) | (F.col("missing_rank") <= F.col("missing_k")))  # a row a setting
    hits = kept.join(truth.select(*KEYS, F.lit(1).alias("_hit")), KEYS, "left")
    profile = count_profile(kept.select(*by, "s1_id"), roster, "s1_id", by=by)
    own = hits.groupBy(*by, "s1_id").agg(F.count("_hit").alias("t"))
    links = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("g"))
    scores = roster.select("s1_id").crossJoin(F.broadcast(grid)).join(links, "s1_id", "left").join(own, [*by, "s1_id"], "left").na.fill(0, ["g", "t"])
    oracle = scores.groupBy(*by).agg(F.avg(f_half(F.col("g"), F.col("t"), F.col("t"))).alias("oracle_f05"), F.sum("t").alias("found"), F.sum("g").alias("_links"))
    made = profile.join(oracle, by).select(
        *by, "mean_candidates", "p95_candidates", ((F.col("mean_candidates") <= MEAN_LIMIT) & (F.col("p95_candidates") <= P95_LIMIT)).alias("eligible"),
        (F.col("found") / F.col("_links")).alias("recall"), (F.col("_links") - F.col("found")).alias("misses"), "oracle_f05",
    )
    rows = made.collect()  # a row a setting
    able = [r for r in rows if r["eligible"]]
    at = [r for r in able if round(r["recall"], 9) >= TARGET_RECALL]
    size = lambda r: (round(r["mean_candidates"], 9), -round(r["oracle_f05"], 9), r["word_k"], r["missing_k"])
    gain = lambda r: (-round(r["oracle_f05"], 9), -round(r["recall"], 9), round(r["mean_candidates"], 9), r["word_k"], r["missing_k"])
    pick = min(at, key=size) if at else min(able, key=gain) if able else None
    table = spark.createDataFrame(rows, made.schema)
    return table.withColumn("chosen", (F.col("word_k") == pick["word_k"]) & (F.col("missing_k") == pick["missing_k"]) if pick else F.lit(False))


def recall_at(ranked: DataFrame, truth: DataFrame, ranks: tuple[int, ...]) -> DataFrame:
    """k, share of true links among the first k candidates of their owners."""
    told = truth.join(ranked.select(*KEYS, "rank"), KEYS, "left").agg(*[F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"r{k}") for k in ranks])
    return told.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ranks])))


def ablation(union: DataFrame, truth: DataFrame, runs: dict[str, Column]) -> DataFrame:
    """run, pairs, recall and misses of each way to keep candidates, in one pass over the union."""
    flagged = union.join(truth.select(*KEYS, F.lit(1).alias("_hit")), KEYS, "left")
    names = list(runs)
    sums = flagged.agg(*[m for k, n in enumerate(names) for m in (F.count_if(runs[n]).alias(f"p{k}"), F.count(F.when(runs[n], F.col("_hit"))).alias(f"h{k}"))])
    both = sums.crossJoin(truth.agg(F.count(F.lit(1)).alias("links")))  # one row each
    return both.select(F.inline(F.array(*[F.struct(F.lit(n).alias("run"), F.col(f"p{k}").alias("pairs"), (F.col(f"h{k}") / F.col("links")).alias("recall"), (F.col("links") - F.col(f"h{k}")).alias("misses")) for k, n in enumerate(names)])))


def score_metrics(scored: DataFrame, p: str, label: str) -> DataFrame:
    """One row: pairs, logloss and AUC; ties count half.

    AUC comes from counts per distinct score and running sums over ranges of
    them, so no task holds all pairs.
    """
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = scored.agg(F.count(F.lit(1)).alias("pairs"), (-F.avg(F.when(F.col(label) == 1, F.log(q)).otherwise(F.log(1 - q)))).alias("logloss"))
    counts = scored.groupBy(F.col(p).alias("p")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    parts = counts.repartitionByRange("p").withColumn("_part", F.spark_partition_id())
    from pyspark.sql import Window

    below = Window.partitionBy("_part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    inner = parts.withColumn("_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    sums = inner.groupBy("_part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)).alias("won"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    total = sums.withColumn("_before", F.coalesce(F.sum("neg").over(before), F.lit(0))).agg(F.sum(F.col("won") + F.col("pos") * F.col("_before")).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return loss.crossJoin(total).select("pairs", "logloss", F.try_divide(F.col("won"), F.col("pos").cast("double") * F.col("neg")).alias("auc"))  # one row each
