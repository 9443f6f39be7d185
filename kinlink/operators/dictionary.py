"""Learning how words in an Indic script are written in Latin, from pairs of records known to be the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.functions.similarity import SCORERS
from kinlink.functions.text import INDIC, romanise

#: Least similarity of an alignment, least count of a word, least share of its best spelling.
LEAST_SIMILARITY, LEAST_COUNT, LEAST_SHARE = 0.5, 3, 0.6


def learn(pairs: DataFrame, latin: str = "latin_text", native: str = "native_text") -> DataFrame:
    """token, latin, n, share: each Indic token's most frequent counterpart among pairs of cleaned texts.

    In each pair every Indic token goes with the Latin token that is most like
    its generic romanisation (ties to the lexically smaller); a token is kept
    with enough counts and a clear best.
    """
    rows = pairs.where(F.col(native).rlike(INDIC)).withColumn("_pair", F.monotonically_increasing_id()).select(
        "_pair", F.array_distinct(F.filter(F.split(native, " "), lambda t: t.rlike(INDIC))).alias("_n"), F.array_distinct(F.filter(F.split(latin, " "), lambda t: (t != "") & ~t.rlike(INDIC))).alias("_l"))
    crossed = rows.select("_pair", F.explode("_n").alias("token"), "_l").select("_pair", "token", F.explode("_l").alias("latin"))
    told = crossed.select("token", "latin").distinct()  # each combination is scored once
    scored = told.withColumn("_s", SCORERS["ratio"](romanise(F.col("token")), F.col("latin"))).where(F.col("_s") >= LEAST_SIMILARITY)
    best = crossed.join(scored, ["token", "latin"]).groupBy("_pair", "token").agg(F.min(F.struct((-F.col("_s")).alias("s"), F.col("latin").alias("latin"))).alias("_b"))
    counts = best.groupBy("token", F.col("_b.latin").alias("latin")).agg(F.count(F.lit(1)).alias("n"))
    of_token = Window.partitionBy("token")
    ranked = counts.withColumns({"share": F.col("n") / F.sum("n").over(of_token), "_r": F.row_number().over(of_token.orderBy(F.desc("n"), "latin"))})
    return ranked.where((F.col("_r") == 1) & (F.col("n") >= LEAST_COUNT) & (F.col("share") >= LEAST_SHARE)).select("token", "latin", "n", "share")
