"""Queries of the second stage, registered beside those of the catalogue.

Targets take a name and an address from their part; every fifth size has no
address.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.operators import decisions as dec
from kinlink.operators import evidence as ev
from kinlink.plans.catalogue import CAND, FINAL, FINE_SQL, QUERIES, SQL, candidates, final, query, roster, table, truth

__all__ = ["QUERIES", "SQL"]  # the catalogue's, with the queries below

PROOF = f"""{CAND}, ev AS (SELECT c.*, CAST(q >= 30 AS INTEGER) AS label, p_name AS t_name, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand || ' ' || p_type END AS t_address, CAST(p_size % 5 = 0 AS INTEGER) AS cand_addr_missing
  FROM cand c JOIN part ON target_id = 'S2-' || p_partkey)"""


def evidence(spark: SparkSession, d: str) -> DataFrame:
    bare = F.col("p_size") % 5 == 0
    part = table(spark, d, "part").select(
        F.concat(F.lit("S2-"), "p_partkey").alias("target_id"), F.col("p_name").alias("t_name"), F.when(bare, "").otherwise(F.concat_ws(" ", "p_brand", "p_type")).alias("t_address"),
        bare.cast("int").alias("cand_addr_missing"), F.array(F.col("p_size").cast("string")).alias("t_numbers"),
    )
    return candidates(spark, d).withColumn("label", (F.col("q") >= 30).cast("int")).join(part, "target_id")


PICK = "SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY p DESC, target_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY {per}, t_name, t_address ORDER BY p DESC, target_id) AS r1 FROM ev WHERE p >= {at} AND t_name || t_address <> '') WHERE r1 = 1"


@query(f"WITH {PROOF} SELECT s1_id, target_id, source, p FROM ({PICK.format(per='s1_id', at=0.5)}) WHERE r <= 2")
def r16_seeds(spark, d):
    return ev.seeds(evidence(spark, d), 0.5).select("s1_id", "target_id", "source", "p")


@query(f"""WITH {PROOF}, pick AS (SELECT * FROM ({PICK.format(per="s1_id, source", at=0.9)}) WHERE r <= 2), thr AS (SELECT unnest([0.9::DOUBLE, 0.95, 0.98, 0.99, 0.995, 0.999]) AS threshold),
tab AS (SELECT threshold, count(s1_id) AS seed_links, coalesce(sum(label), 0) AS correct_seed_links, sum(label) / CAST(nullif(count(s1_id), 0) AS DOUBLE) AS observed_precision, count(DISTINCT s1_id) / (SELECT CAST(count(DISTINCT s1_id) AS DOUBLE) FROM ev) AS owner_coverage
  FROM thr LEFT JOIN pick ON p >= threshold GROUP BY threshold)
SELECT threshold, seed_links, CAST(correct_seed_links AS BIGINT) AS correct_seed_links, round(observed_precision, 9) AS observed_precision, round(owner_coverage, 9) AS owner_coverage,
  threshold = coalesce((SELECT min(threshold) FROM tab WHERE seed_links >= 200 AND observed_precision >= 0.995), 0.999) AS chosen FROM tab""")
def d10_seed_threshold(spark, d):
    return ev.seed_trials(evidence(spark, d)).withColumns({c: F.round(c, 9) for c in ("observed_precision", "owner_coverage")})


@query()
def fe7_support_features(spark, d):
    return ev.support_features(evidence(spark, d), 0.5)


GRID = f"""WITH {PROOF}, lv AS (SELECT range AS level FROM range(0, 22)), tr AS (SELECT s1_id, count(*) AS g FROM truth GROUP BY 1),
pr AS (SELECT level, e.s1_id, cand_addr_missing AS m, count(*) AS k, count(t.s1_id) AS t FROM lv JOIN ev e ON least(floor(e.p * 20 + 1e-9), 20) >= level LEFT JOIN truth t ON e.s1_id = t.s1_id AND e.target_id = t.target_id GROUP BY ALL),
cell AS (SELECT r.s1_id, x.level AS a, y.level AS b, coalesce(tr.g, 0) AS g, coalesce(p0.k, 0) + coalesce(p1.k, 0) AS k, coalesce(p0.t, 0) + coalesce(p1.t, 0) AS t FROM roster r CROSS JOIN lv x CROSS JOIN lv y LEFT JOIN tr ON tr.s1_id = r.s1_id
  LEFT JOIN pr p0 ON p0.s1_id = r.s1_id AND p0.level = x.level AND p0.m = 0 LEFT JOIN pr p1 ON p1.s1_id = r.s1_id AND p1.level = y.level AND p1.m = 1),
sweep AS (SELECT a / 20.0 AS address_threshold, b / 20.0 AS missing_threshold, round(avg(CASE WHEN g = 0 AND k = 0 THEN 1.0 WHEN t = 0 THEN 0.0 ELSE CAST(1.25 * t AS DOUBLE) / CAST(0.25 * g + k AS DOUBLE) END), 9) AS macro_f, a = b AS one_threshold FROM cell GROUP BY a, b)"""


@query(f"{GRID} SELECT * FROM sweep")
def d6_two_threshold_sweep(spark, d):
    return ev.two_threshold_sweep(evidence(spark, d), truth(spark, d), roster(spark, d), "cand_addr_missing").withColumn("macro_f", F.round("macro_f", 9))


FINE = f"""WITH {PROOF}, {FINE_SQL}, lv AS (SELECT unnest([{", ".join(f"{t!r}e0" for t in ev.policy_grid(1.000001))}]) AS lvl UNION SELECT * FROM (SELECT threshold FROM fine ORDER BY macro_f DESC, threshold DESC LIMIT 1)),
pr AS (SELECT lvl, e.s1_id, cand_addr_missing AS m, count(*) AS k, count(t.s1_id) AS t FROM lv JOIN ev e ON e.p >= lvl LEFT JOIN truth t ON e.s1_id = t.s1_id AND e.target_id = t.target_id GROUP BY ALL),
cell AS (SELECT r.s1_id, x.lvl AS a, y.lvl AS b, coalesce(ftr.g, 0) AS g, coalesce(p0.k, 0) + coalesce(p1.k, 0) AS k, coalesce(p0.t, 0) + coalesce(p1.t, 0) AS t FROM roster r CROSS JOIN lv x CROSS JOIN lv y LEFT JOIN ftr ON ftr.s1_id = r.s1_id
  LEFT JOIN pr p0 ON p0.s1_id = r.s1_id AND p0.lvl = x.lvl AND p0.m = 0 LEFT JOIN pr p1 ON p1.s1_id = r.s1_id AND p1.lvl = y.lvl AND p1.m = 1)
SELECT a AS address_threshold, b AS missing_threshold, round(avg(CASE WHEN g = 0 AND k = 0 THEN 1.0 WHEN t = 0 THEN 0.0 ELSE CAST(1.25 * t AS DOUBLE) / CAST(0.25 * g + k AS DOUBLE) END), 9) AS macro_f, a = b AS one_threshold FROM cell GROUP BY a, b"""


@query(FINE)
def d6_fine_two_threshold_sweep(spark, d):
    """D6 over the reference's grid, with the threshold that the fine sweep chooses."""
    one = dec.best(dec.threshold_sweep(candidates(spark, d), truth(spark, d), roster(spark, d), grid=dec.FINE_GRID)).first()["threshold"]
    return ev.two_threshold_sweep(evidence(spark, d), truth(spark, d), roster(spark, d), "cand_addr_missing", grid=ev.policy_grid(one)).withColumn("macro_f", F.round("macro_f", 9))


@query(f"WITH {PROOF} SELECT s1_id, target_id, p FROM ev WHERE p >= CASE WHEN cand_addr_missing = 1 THEN 0.7 ELSE 0.5 END")
def p6_two_threshold_policy(spark, d):
    return ev.apply_policy(evidence(spark, d), "cand_addr_missing", 0.5, 0.7).select("s1_id", "target_id", "p")


def scores(spark: SparkSession, d: str, owned: bool) -> DataFrame:
    accepted = final(spark, d) if owned else candidates(spark, d).where("p >= 0.5")
    return dec.per_owner(accepted, truth(spark, d), roster(spark, d))


F_SQL = "CASE WHEN g = 0 AND k = 0 THEN 1.0 WHEN t = 0 THEN 0.0 ELSE CAST(1.25 * t AS DOUBLE) / CAST(0.25 * g + k AS DOUBLE) END"
HITS = "SELECT a.s1_id, count(*) AS k, count(t.s1_id) AS t FROM {x} a LEFT JOIN truth t ON a.s1_id = t.s1_id AND a.target_id = t.target_id GROUP BY 1"


@query(f"""WITH {CAND}, {FINAL}, tr AS (SELECT s1_id, count(*) AS g FROM truth GROUP BY 1), h0 AS ({HITS.format(x="acc")}), h1 AS ({HITS.format(x="fin")}),
f0 AS (SELECT s1_id, {F_SQL} AS f FROM (SELECT r.s1_id, coalesce(g, 0) AS g, coalesce(k, 0) AS k, coalesce(t, 0) AS t FROM roster r LEFT JOIN tr USING (s1_id) LEFT JOIN h0 USING (s1_id))),
f1 AS (SELECT s1_id, {F_SQL} AS f FROM (SELECT r.s1_id, coalesce(g, 0) AS g, coalesce(k, 0) AS k, coalesce(t, 0) AS t FROM roster r LEFT JOIN tr USING (s1_id) LEFT JOIN h1 USING (s1_id)))
SELECT count(*) AS owners, round(avg(f0.f), 9) AS before_macro_f, round(avg(f1.f), 9) AS after_macro_f, round(avg(f1.f - f0.f), 9) AS paired_delta, count(*) FILTER (f1.f - f0.f > 1e-12) AS improved_owners, count(*) FILTER (f1.f - f0.f < -1e-12) AS worsened_owners, count(*) FILTER (abs(f1.f - f0.f) <= 1e-12) AS unchanged_owners FROM f0 JOIN f1 USING (s1_id)""")
def d14_paired_comparison(spark, d):
    found = ev.paired_summary(ev.paired_owners(scores(spark, d, False), scores(spark, d, True)))
    return found.withColumns({c: F.round(c, 9) for c in ("before_macro_f", "after_macro_f", "paired_delta")})


@query()
def d14_owner_bootstrap(spark, d):
    return ev.owner_bootstrap(ev.paired_owners(scores(spark, d, False), scores(spark, d, True)), {"paired_delta": ("delta", None)})


@query()
def d15_clustered_intervals(spark, d):
    return ev.owner_bootstrap(scores(spark, d, True), {"macro_f": ("f", None), "recall": ("t", "g")})
