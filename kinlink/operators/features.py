"""Pair features: text similarities, idf-weighted overlap, numbers, channels, and owner-relative measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.functions import similarity as sim

#: The columns of each family, in the order of the matrix.
BASE = ["name_red_ratio", "name_red_token_set", "name_cons_ratio", "addr_token_set", "addr_partial", "addr_len_ratio", "cand_addr_missing", "num_jaccard", "num_conflict", "retrieval_score", "retrieval_rank", "source_s3"]
EXTRA = [
    "name_red_token_sort", "name_red_partial", "name_red_jw", "name_nospace_ratio", "addr_ratio", "cand_name_nonlatin", "num_shared", "score_rel_max", "score_gap_max", "rank_overall", "n_close", "n_name_close",
    "name_set_gap", "addr_set_gap", "anchor_name_set", "anchor_addr_set",
]
OVERLAP = ["shared_idf", "coverage_query", "coverage_target", "unshared_query", "unshared_target", "weighted_jaccard"]
CHANNELS = ["word", "missing", "char", "name"]
# End of the fixed values.

KEYS = ["s1_id", "target_id"]


def token_idf(texts: DataFrame, column: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Idf of each distinct token within the groups ``by`` (every token, however rare), and each group's size."""
    sizes = texts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    df = texts.select(*by, F.explode(F.array_distinct(F.filter(F.split(column, " "), lambda t: t != ""))).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("_df"))
    return df.join(sizes, by).select(*by, "token", (F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1).alias("idf")), sizes


def overlap_of_texts(texts: DataFrame, query: str, target: str, idf: DataFrame, sizes: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """The columns of ``texts``, distinct rows of ``by`` and two texts, and six idf-weighted measures of the texts' token sets; null where either is empty.

    A token outside the group's table weighs ln(n + 1) + 1. Each pair's tokens
    meet the table in one join.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda t: t != ""))
    sets = texts.select(F.struct(*by, query, target).alias("_of"), *by, words(F.col(query)).alias("_a"), words(F.col(target)).alias("_b"))
    rows = sets.select("_of", *by, "_a", "_b", F.explode_outer(F.array_union("_a", "_b")).alias("token"))
    rows = rows.join(idf, [*by, "token"], "left").join(F.broadcast(sizes), by, "left")  # a row a group
    w = F.coalesce("idf", F.log(F.coalesce("_n", F.lit(0)) + 1) + 1)
    of = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    in_a, in_b = F.array_contains("_a", F.col("token")), F.array_contains("_b", F.col("token"))
    sums = rows.groupBy("_of").agg(of(in_a & in_b).alias("s"), of(in_a).alias("a"), of(in_b).alias("b"), F.first((F.size("_a") > 0) & (F.size("_b") > 0)).alias("_told"))
    s, a, b = F.col("s"), F.col("a"), F.col("b")
    values = (s, F.try_divide(s, a), F.try_divide(s, b), a - s, b - s, F.try_divide(s, a + b - s))
    return sums.select("_of.*", *[F.when(F.col("_told"), v).alias(f"{prefix}_{n}") for n, v in zip(OVERLAP, values, strict=True)])


def weighted_overlap(pairs: DataFrame, query: Column, target: Column, idf: DataFrame, sizes: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """KEYS and six idf-weighted measures of two texts; each combination of texts is measured once."""
    told = pairs.select(*KEYS, F.struct(*by, query.alias("_q"), target.alias("_t")).alias("_of"))
    made = overlap_of_texts(told.select("_of").distinct().select("_of.*"), "_q", "_t", idf, sizes, by, prefix)
    names = [f"{prefix}_{n}" for n in OVERLAP]
    return told.join(made.select(F.struct(*by, "_q", "_t").alias("_of"), *names), "_of").select(*KEYS, *names)


def number_match(a: Column, b: Column) -> tuple[Column, Column]:
    """Agreement and conflict of two typed numbers; null where either is empty."""
    told = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(told, (a == b).cast("double")), F.when(told, (a != b).cast("double"))


def channel_flags(union: DataFrame, channels: list[str] = CHANNELS, top: int = 50) -> DataFrame:
    """Which channels returned a pair, from their ranks: word_top50, {channel}_retrieved and channel_count beside scores and ranks."""
    had = {c: F.col(f"{c}_rank").isNotNull().cast("int") for c in channels}
    flags = {f"{c}_retrieved": h for c, h in had.items()} | {"word_top50": F.coalesce((F.col("word_rank") <= top).cast("int"), F.lit(0)), "channel_count": sum(had.values(), F.lit(0))}
    return union.withColumns(flags)


def text_features(pairs: DataFrame) -> DataFrame:
    """The string measures of BASE and EXTRA for pairs with q_/t_ name_red, name_cons, addr_norm and the anchor's a_name_red, a_addr_norm.

    Every distinct combination of texts is scored once.
    """
    sides = ["q_name_red", "t_name_red", "q_name_cons", "t_name_cons", "q_addr_norm", "t_addr_norm", "a_name_red", "a_addr_norm"]
    c = {x: F.col(x) for x in sides}
    bare = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit(" "), F.lit(""))
    made = {
        "name_red_ratio": sim.SCORERS["ratio"](c["q_name_red"], c["t_name_red"]),
        "name_red_token_set": sim.SCORERS["token_set"](c["q_name_red"], c["t_name_red"]),
        "name_red_token_sort": sim.SCORERS["token_sort"](c["q_name_red"], c["t_name_red"]),
        "name_red_partial": sim.SCORERS["partial"](c["q_name_red"], c["t_name_red"]),
        "name_red_jw": sim.SCORERS["jaro_winkler"](c["q_name_red"], c["t_name_red"]),
        "name_nospace_ratio": sim.SCORERS["ratio"](bare(c["q_name_red"]), bare(c["t_name_red"])),
        "name_cons_ratio": sim.SCORERS["ratio"](c["q_name_cons"], c["t_name_cons"]),
        "addr_token_set": sim.SCORERS["token_set"](c["q_addr_norm"], c["t_addr_norm"]),
        "addr_partial": sim.SCORERS["partial"](c["q_addr_norm"], c["t_addr_norm"]),
        "addr_ratio": sim.SCORERS["ratio"](c["q_addr_norm"], c["t_addr_norm"]),
        "anchor_name_set": sim.SCORERS["token_set"](c["t_name_red"], c["a_name_red"]),
        "anchor_addr_set": sim.SCORERS["token_set"](c["t_addr_norm"], c["a_addr_norm"]),
    }
    texts = F.struct(*sides)
    scored = pairs.select(*sides).distinct().withColumns(made).select(texts.alias("_texts"), *made)
    return pairs.withColumn("_texts", texts).join(scored, "_texts").drop("_texts")


def anchors(candidates: DataFrame) -> DataFrame:
    """Each pair's anchor: the best other candidate of its owner by score, ties to the smaller id."""
    order = F.struct((-F.col("score")).alias("s"), F.col("target_id").alias("t"))
    tops = candidates.groupBy("s1_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, 2).alias("_tops"))  # an owner's candidates are bounded by the budgets
    first, second = F.get("_tops", F.lit(0))["t"], F.get("_tops", F.lit(1))["t"]
    return candidates.join(tops, "s1_id").withColumn("anchor_id", F.when(F.col("target_id") == first, second).otherwise(first)).drop("_tops")


def relative(pairs: DataFrame) -> DataFrame:
    """An owner's candidates against each other: score ratio and gap to the best, rank, near ones, and gaps of name and address."""
    w = Window.partitionBy("s1_id")
    s, top = F.col("retrieval_score"), F.max("retrieval_score").over(w)
    name, addr = F.col("name_red_token_set"), F.col("addr_token_set")
    return pairs.withColumns({
        "score_rel_max": F.try_divide(s, F.nullif(top, F.lit(0.0))), "score_gap_max": top - s, "rank_overall": F.rank().over(w.orderBy(F.desc("retrieval_score"))),
        "_top": top, "n_name_close": F.count_if(name >= 0.9).over(w), "name_set_gap": F.max(name).over(w) - name, "addr_set_gap": F.max(addr).over(w) - addr,
    }).withColumn("n_close", F.count_if(s >= 0.9 * F.col("_top")).over(w)).drop("_top")


def base_features(pairs: DataFrame) -> DataFrame:
    """KEYS, source, BASE and EXTRA for scored pairs with both sides' texts and number lists; every candidate of an owner must be there.

    Needs score, rank, source, q_/t_ name_red, name_cons, addr_norm, addr_nums,
    t_name_nonlatin. Where a measure can't be told it is null.
    """
    targets = pairs.select(F.col("target_id").alias("anchor_id"), F.col("t_name_red").alias("a_name_red"), F.col("t_addr_norm").alias("a_addr_norm")).dropDuplicates(["anchor_id"])
    told = text_features(anchors(pairs).join(targets, "anchor_id", "left"))
    a, b = F.col("q_addr_nums"), F.col("t_addr_nums")
    shared = F.size(F.array_intersect(a, b))
    told = told.withColumns({
        "addr_len_ratio": sim.length_ratio(F.col("q_addr_norm"), F.col("t_addr_norm")), "cand_addr_missing": (F.coalesce("t_addr_norm", F.lit("")) == "").cast("int"), "num_shared": shared,
        "num_jaccard": sim.set_jaccard(a, b), "num_conflict": ((F.size(a) > 0) & (F.size(b) > 0) & (shared == 0)).cast("int"), "retrieval_score": F.col("score"), "retrieval_rank": F.col("rank"),
        "source_s3": (F.col("source") == "S3").cast("int"), "cand_name_nonlatin": F.col("t_name_nonlatin").cast("int"),
    })
    return relative(told).select(*KEYS, "source", *BASE, *EXTRA)
