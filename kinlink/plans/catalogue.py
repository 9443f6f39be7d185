"""Queries of the record-matching engine over the driver's tables, with their SQL.

Records: benchmark items are owners (S1) and documents targets (S2) of the text
queries, one block a language. Customers are owners and the parts they ordered
targets of the decision queries: p stands in for a model's score, a link is
true where at least 30 pieces were ordered. All rows of all tables take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink.functions import similarity as sim
from kinlink.functions import text as tx
from kinlink.operators import decisions as dec
from kinlink.operators import pairs as pr
from kinlink.operators import retrieval as ret
from kinlink.operators import sampling as smp

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def C(x: str) -> str:
    """SQL of ``text.clean``."""
    return rf"trim(regexp_replace(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[''’‘`´]', '', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


def T(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


# ---- texts -------------------------------------------------------------------


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"SELECT doc_id, {C('text')} AS cleaned FROM documents")
def n2_clean_text(spark, d):
    return documents(spark, d).select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query()
def n2_basic_clean(spark, d):
    return documents(spark, d).select("doc_id", tx.basic_clean(F.col("text")).alias("cleaned"))


@query("SELECT event_id, regexp_replace(regexp_replace(event_type || ' null ' || props, '\\bnull\\b', ' ', 'gi'), '\\bn/a\\b', ' ', 'gi') AS cleaned FROM events")
def n5_null_placeholders(spark, d):
    return table(spark, d, "events").select("event_id", tx.no_placeholders(F.concat("event_type", F.lit(" null "), "props")).alias("cleaned"))


NUM = r"""regexp_replace(regexp_replace(regexp_replace(t, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), '^(?:n°|nº|no\.?)(\d)', '\1'), '\b0+(\d)', '\1', 'g')"""


@query(rf"""SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[^\s,;:()\[\]{{}}|<>"]+'), lambda t: {NUM}), lambda t: regexp_matches(t, '\d')))) AS numbers FROM documents""")
def n4_number_tokens(spark, d):
    return documents(spark, d).select("doc_id", tx.number_tokens(F.col("text")).alias("numbers"))


DROP = ", ".join(f"'{w}'" for w in tx.LEGAL_FORMS + tx.FUNCTION_WORDS)


@query(f"SELECT doc_id, CASE WHEN kept = '' THEN c ELSE kept END AS reduced FROM (SELECT doc_id, c, array_to_string(list_filter(string_split(c, ' '), lambda t: NOT list_contains([{DROP}], t)), ' ') AS kept FROM (SELECT doc_id, {C('text')} AS c FROM documents))")
def n8_legal_form_strip(spark, d):
    c = tx.clean(F.col("text"))
    drop = F.array(*[F.lit(w) for w in tx.LEGAL_FORMS + tx.FUNCTION_WORDS])
    kept = F.array_join(F.filter(F.split(F.col("c"), " "), lambda t: ~F.array_contains(drop, t)), " ")
    return documents(spark, d).select("doc_id", c.alias("c")).select("doc_id", F.when(kept == "", F.col("c")).otherwise(kept).alias("reduced"))


ABBREVIATED = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(tx.ADDRESS_ABBREVIATIONS.items())) + "}"


@query(f"WITH m AS MATERIALIZED (SELECT {ABBREVIATED} AS m) SELECT doc_id, array_to_string(list_transform(string_split({C('text')}, ' '), lambda t: coalesce(m[t], t)), ' ') AS address FROM documents, m")
def n7_address_abbreviations(spark, d):
    return documents(spark, d).select("doc_id", tx.map_words(tx.clean(F.col("text")), tx.ADDRESS_ABBREVIATIONS).alias("address"))


@query(r"SELECT doc_id, regexp_matches(coalesce(text, ''), '[^\p{Latin}\p{Common}\p{Inherited}]') AS nonlatin FROM documents")
def n9_nonlatin_flag(spark, d):
    return documents(spark, d).select("doc_id", tx.nonlatin(F.col("text")).alias("nonlatin"))


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(coalesce(url, '')), '{tx.DOMAIN}', 1), '^www\.', ''), '{tx.TOP_LEVEL}', ''), '[^a-z0-9]+', ' ', 'g')) AS stem FROM pages")
def x2_domain_stem(spark, d):
    return table(spark, d, "pages").select("page_id", tx.domain_stem(F.col("url")).alias("stem"))


HOUSE_SQL = tx.HOUSE.replace("(?=", "(?:")


@query(rf"""SELECT doc_id, regexp_extract(l, '{HOUSE_SQL}', 1) || regexp_extract(l, '{HOUSE_SQL}', 2) AS house,
  CASE WHEN regexp_matches(regexp_extract(l, '{tx.UNIT}', 1), '\d') THEN regexp_extract(l, '{tx.UNIT}', 1) ELSE '' END AS unit,
  regexp_extract(l, '{tx.FLOOR}', 1) || regexp_extract(l, '{tx.FLOOR}', 2) AS floor FROM (SELECT doc_id, lower(coalesce(text, '')) AS l FROM documents)""")
def x3_house_unit_floor(spark, d):
    c = F.col("text")
    return documents(spark, d).select("doc_id", tx.house(c).alias("house"), tx.unit(c).alias("unit"), tx.floor_number(c).alias("floor"))


@query("SELECT p_name AS name_red, p_brand AS country, count(*) AS reference_name_count, round(ln(1 + count(*)), 9) AS log_frequency FROM part GROUP BY p_name, p_brand")
def x8_name_frequency(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name_red"), F.col("p_brand").alias("country")).agg(F.count(F.lit(1)).alias("reference_name_count")).withColumn("log_frequency", F.round(F.log1p("reference_name_count"), 9))


@query()
def t1_romanise(spark, d):
    words = documents(spark, d).select(F.explode(tx.tokens(tx.clean(F.col("text")))).alias("token")).distinct()
    return words.select("token", tx.romanise(F.col("token")).alias("latin"))


# ---- similarities ------------------------------------------------------------

PAIRS = "SELECT s.s_suppkey, c.c_custkey, s.s_name, c.c_name FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey"


def name_pairs(spark: SparkSession, d: str, measure: Callable[[DataFrame], DataFrame], profile: Callable[[str], dict[str, Column]] = lambda name: {name: F.col(name)}) -> DataFrame:
    """Suppliers and customers of one nation with what ``measure`` makes of the ``profile`` of s_name and of c_name, once for each pair of profiles."""
    told = {"supplier": profile("s_name"), "customer": profile("c_name")}
    s, c = (table(spark, d, t).select(F.col(f"{t[0]}_nationkey").alias("nation"), f"{t[0]}_{t[:4]}key", *[e.alias(n) for n, e in columns.items()]) for t, columns in told.items())
    return pr.measured_pairs(s, c, ["nation"], (list(told["supplier"]), list(told["customer"])), (["s_suppkey"], ["c_custkey"]), measure)


@query(f"SELECT s_suppkey, c_custkey, round(jaro_winkler_similarity(s_name, c_name), 9) AS similarity FROM ({PAIRS})")
def f5_jaro_winkler(spark, d):
    return name_pairs(spark, d, lambda names: names.withColumn("similarity", F.round(sim.SCORERS["jaro_winkler"](F.col("s_name"), F.col("c_name")), 9)))


@query()
def f1_indel_ratios(spark, d):
    a, b = F.col("s_name"), F.col("c_name")
    return name_pairs(spark, d, lambda names: names.withColumns({n: F.round(sim.SCORERS[n](a, b), 9) for n in ("ratio", "token_sort", "token_set", "partial")}))


G = lambda c: f"list_distinct(regexp_extract_all({c}, '\\d'))"


@query(f"""SELECT s_suppkey, c_custkey, CAST(len(list_intersect(a, b)) AS INTEGER) AS num_shared, CASE WHEN len(list_distinct(a || b)) = 0 THEN NULL ELSE round(len(list_intersect(a, b)) / CAST(len(list_distinct(a || b)) AS DOUBLE), 9) END AS num_jaccard,
  CAST(len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) = 0 AS INTEGER) AS num_conflict, round(least(length(s_name), length(c_name)) / CAST(greatest(length(s_name), length(c_name)) AS DOUBLE), 9) AS len_ratio
  FROM (SELECT *, {G('s_name')} AS a, {G('c_name')} AS b FROM ({PAIRS}))""")
def f8_number_jaccard(spark, d):
    """Many names are alike to it: nothing but their digits and lengths counts."""

    def profile(name):
        digits = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(name), F.lit(r"\d"), F.lit(0))))
        return {f"{name}_digits": digits, f"{name}_length": F.length(name)}

    a, b, x, y = F.col("s_name_digits"), F.col("c_name_digits"), F.col("s_name_length"), F.col("c_name_length")
    both = F.size(F.array_intersect(a, b))
    measures = {
        "num_shared": F.when(a.isNotNull(), F.coalesce(both, F.lit(0))), "num_jaccard": F.round(sim.set_jaccard(a, b), 9),  # nulls, and NaN of two empty names, as in the SQL
        "num_conflict": ((F.size(a) > 0) & (F.size(b) > 0) & (both == 0)).cast("int"), "len_ratio": F.when(F.greatest(x, y) == 0, F.lit(float("nan"))).otherwise(F.round(F.least(x, y) / F.greatest(x, y), 9)),
    }
    return name_pairs(spark, d, lambda names: names.withColumns(measures), profile)


# ---- retrieval ---------------------------------------------------------------

TARGETS = f"tgt AS (SELECT lang AS block, 'S2-' || doc_id AS id, {C('text')} AS text FROM documents)"
OWNERS = f"own AS (SELECT block, 'S1-' || item_id AS id, {C('text')} AS text FROM benchmark, (SELECT DISTINCT block FROM tgt))"
VOCAB = f"""cnt AS (SELECT block, id, term, count(*) AS tf FROM (SELECT block, id, unnest({T('text')}) AS term FROM tgt) GROUP BY ALL),
size AS (SELECT block, count(*) AS n FROM tgt GROUP BY block),
voc AS (SELECT block, term, df, total, ln((n + 1.0) / (df + 1)) + 1 AS idf FROM (SELECT block, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM cnt GROUP BY ALL HAVING count(*) >= 2) JOIN size USING (block)),
raw AS (SELECT block, id, term, (1 + ln(tf)) * idf AS w FROM cnt JOIN voc USING (block, term)),
post AS (SELECT block, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY block, id)) AS weight FROM raw)"""
QUERIED = f"""qcnt AS (SELECT block, id, term, count(*) AS tf FROM (SELECT block, id, unnest({T('text')}) AS term FROM own) GROUP BY ALL),
qraw AS (SELECT block, id, term, (1 + ln(tf)) * idf AS w FROM qcnt JOIN voc USING (block, term)),
qpost AS (SELECT block, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY block, id)) AS weight FROM qraw),
pair AS (SELECT q.block, q.id AS s1_id, p.id AS target_id, round(sum(q.weight * p.weight), 6) AS score FROM qpost q JOIN post p USING (block, term) GROUP BY ALL HAVING round(sum(q.weight * p.weight), 6) > 0),
word AS (SELECT *, row_number() OVER (PARTITION BY block, s1_id ORDER BY score DESC, target_id) AS rank FROM pair)"""


def targets(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("lang").alias("block"), F.concat(F.lit("S2-"), "doc_id").alias("id"), tx.clean(F.col("text")).alias("text"))


def owners(spark: SparkSession, d: str) -> DataFrame:
    blocks = documents(spark, d).select(F.col("lang").alias("block")).distinct()  # every owner asks each block
    items = table(spark, d, "benchmark").select(F.concat(F.lit("S1-"), "item_id").alias("id"), tx.clean(F.col("text")).alias("text"))
    return items.crossJoin(F.broadcast(blocks)).select("block", "id", "text")


def word_channel(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    return ret.top_k(owners(spark, d), targets(spark, d), ret.words, k)


@query(f"WITH {TARGETS}, {VOCAB} SELECT block, term, df, total, round(idf, 9) AS idf FROM voc")
def o7_vocabulary(spark, d):
    t = targets(spark, d)
    return ret.vocabulary(t, ret.term_counts(t, ret.words(F.col("text")))).select("block", "term", "df", "total", F.round("idf", 9).alias("idf"))


@query(f"WITH {TARGETS}, {VOCAB} SELECT block, id, term, round(weight, 9) AS weight FROM post")
def r2_tfidf_weights(spark, d):
    t = targets(spark, d)
    counts = ret.term_counts(t, ret.words(F.col("text")))
    return ret.weigh(counts, ret.vocabulary(t, counts)).withColumn("weight", ret.rounded(F.col("weight"), 9))


@query(f"WITH {TARGETS}, {OWNERS}, {VOCAB}, {QUERIED} SELECT block, s1_id, target_id, score, CAST(rank AS INTEGER) AS rank FROM word WHERE rank <= 50")
def r4_word_topk(spark, d):
    return word_channel(spark, d)


@query(f"WITH {TARGETS}, {OWNERS}, {VOCAB}, {QUERIED}, acc AS (SELECT * FROM word WHERE rank <= 50 AND score >= 0.2) SELECT s1_id, target_id, block, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, s1_id) AS claim FROM acc) WHERE claim = 1")
def flagship_matching(spark, d):
    """Retrieve, accept and give every target to one owner."""
    accepted = word_channel(spark, d).where("score >= 0.2").withColumn("p", F.col("score"))
    return dec.one_owner(accepted).select("s1_id", "target_id", "block", "score", "rank")


NAMES = """tgt AS (SELECT p_type AS block, id, text FROM (SELECT p_type, p_brand || ' ' || p_name AS id, lower(p_brand || ' ' || p_name) AS text FROM part GROUP BY ALL)),
own AS (SELECT DISTINCT block, n AS id, lower(n) AS text FROM (SELECT p_name AS n FROM part), (SELECT DISTINCT block FROM tgt))"""
GRAMS = "flatten([list_transform(range(1, length(text) - k + 2), lambda i: substring(text, i, k)) for k in [2, 3, 4]])"


@query(f"WITH {NAMES}, {VOCAB.replace(T('text'), GRAMS)}, {QUERIED.replace(T('text'), GRAMS)} SELECT block, s1_id, target_id, score, CAST(rank AS INTEGER) AS rank FROM word WHERE rank <= 20")
def r5_char_topk(spark, d):
    part = table(spark, d, "part")
    t = part.select(F.col("p_type").alias("block"), F.concat_ws(" ", "p_brand", "p_name").alias("id")).distinct().withColumn("text", F.lower("id"))
    q = part.select(F.col("p_name").alias("id")).distinct().crossJoin(F.broadcast(part.select(F.col("p_type").alias("block")).distinct())).withColumn("text", F.lower("id"))
    return ret.top_k(q, t, ret.char_grams, 20)


# ---- decisions ---------------------------------------------------------------

CAND = """cand AS (SELECT 'S1-' || o_custkey AS s1_id, 'S2-' || l_partkey AS target_id, CASE WHEN min(l_returnflag) = 'A' THEN 'S3' ELSE 'S2' END AS source, round(avg(l_discount) * 10, 6) AS p, round(avg(l_tax) * 10, 6) AS score, max(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
truth AS (SELECT s1_id, target_id FROM cand WHERE q >= 30), roster AS (SELECT 'S1-' || c_custkey AS s1_id, c_mktsegment AS country FROM customer)"""
FINAL = "acc AS (SELECT * FROM cand WHERE p >= 0.5), fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY p DESC, s1_id) AS r FROM acc) WHERE r = 1)"
OWNER = """tr AS (SELECT s1_id, count(*) AS g FROM truth GROUP BY 1), pr AS (SELECT a.s1_id, count(*) AS k, count(t.s1_id) AS t FROM fin a LEFT JOIN truth t ON a.s1_id = t.s1_id AND a.target_id = t.target_id GROUP BY 1),
per AS (SELECT s1_id, country, g, k, t, CASE WHEN g = 0 AND k = 0 THEN 1.0 WHEN t = 0 THEN 0.0 ELSE CAST(1.25 * t AS DOUBLE) / CAST(0.25 * g + k AS DOUBLE) END AS f FROM (SELECT r.s1_id, country, coalesce(g, 0) AS g, coalesce(k, 0) AS k, coalesce(t, 0) AS t FROM roster r LEFT JOIN tr USING (s1_id) LEFT JOIN pr USING (s1_id)))"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    rows = o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_custkey", "l_partkey").agg(F.min("l_returnflag").alias("flag"), F.avg("l_discount").alias("p"), F.avg("l_tax").alias("score"), F.max("l_quantity").alias("q"))
    return rows.select(
        F.concat(F.lit("S1-"), "o_custkey").alias("s1_id"), F.concat(F.lit("S2-"), "l_partkey").alias("target_id"), F.when(F.col("flag") == "A", "S3").otherwise("S2").alias("source"),
        F.round(F.col("p") * 10, 6).alias("p"), F.round(F.col("score") * 10, 6).alias("score"), "q",
    )


def truth(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).where("q >= 30").select("s1_id", "target_id")


def roster(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.concat(F.lit("S1-"), "c_custkey").alias("s1_id"), F.col("c_mktsegment").alias("country"))


def final(spark: SparkSession, d: str) -> DataFrame:
    return dec.one_owner(candidates(spark, d).where("p >= 0.5"))


@query(f"WITH {CAND} SELECT s1_id, target_id FROM truth")
def s4_truth_pairs(spark, d):
    return truth(spark, d)


@query(f"WITH {CAND}, {FINAL} SELECT s1_id, target_id, p FROM fin")
def d5_one_owner(spark, d):
    return final(spark, d).select("s1_id", "target_id", "p")


@query(f"WITH {CAND}, {FINAL}, {OWNER} SELECT s1_id, CAST(g AS BIGINT) AS g, CAST(k AS BIGINT) AS k, CAST(t AS BIGINT) AS t, round(f, 9) AS f FROM per")
def d1_owner_f05(spark, d):
    return dec.per_owner(final(spark, d), truth(spark, d), roster(spark, d)).withColumn("f", F.round("f", 9))


@query(f"""WITH {CAND}, {FINAL}, {OWNER} SELECT count(*) AS owners, round(avg(f), 9) AS macro_f, round(sum(t) / CAST(sum(k) AS DOUBLE), 9) AS precision, round(sum(t) / CAST(sum(g) AS DOUBLE), 9) AS recall, round(avg(CAST(k = 0 AS INTEGER)), 9) AS empty_rate,
  round(count(*) FILTER (g = 0 AND k > 0) / CAST(nullif(count(*) FILTER (g = 0), 0) AS DOUBLE), 9) AS singleton_fp_rate FROM per""")
def d2_metric_summary(spark, d):
    s = dec.summary(dec.per_owner(final(spark, d), truth(spark, d), roster(spark, d)))
    return s.select("owners", *[F.round(c, 9).alias(c) for c in s.columns if c != "owners"])


@query(f"""WITH {CAND}, thr AS (SELECT range AS level FROM range(0, 22)), tr AS (SELECT s1_id, count(*) AS g FROM truth GROUP BY 1),
pr AS (SELECT level, c.s1_id, count(*) AS k, count(t.s1_id) AS t FROM thr JOIN cand c ON least(floor(c.p * 20 + 1e-9), 20) >= level LEFT JOIN truth t ON c.s1_id = t.s1_id AND c.target_id = t.target_id GROUP BY ALL)
SELECT level / 20.0 AS threshold, round(avg(CASE WHEN g = 0 AND k = 0 THEN 1.0 WHEN t = 0 THEN 0.0 ELSE CAST(1.25 * t AS DOUBLE) / CAST(0.25 * g + k AS DOUBLE) END), 9) AS macro_f
FROM (SELECT level, coalesce(g, 0) AS g, coalesce(k, 0) AS k, coalesce(t, 0) AS t FROM roster CROSS JOIN thr LEFT JOIN tr USING (s1_id) LEFT JOIN pr USING (level, s1_id)) GROUP BY level""")
def d4_threshold_sweep(spark, d):
    return dec.threshold_sweep(candidates(spark, d), truth(spark, d), roster(spark, d)).withColumn("macro_f", F.round("macro_f", 9))


FINE_SQL = f"""fthr AS (SELECT unnest([{", ".join(f"{t!r}e0" for t in dec.FINE_GRID)}]) AS threshold), ftr AS (SELECT s1_id, count(*) AS g FROM truth GROUP BY 1),
fpr AS (SELECT threshold, c.s1_id, count(*) AS k, count(t.s1_id) AS t FROM fthr JOIN cand c ON c.p >= threshold LEFT JOIN truth t ON c.s1_id = t.s1_id AND c.target_id = t.target_id GROUP BY ALL),
fine AS (SELECT threshold, round(avg(CASE WHEN g = 0 AND k = 0 THEN 1.0 WHEN t = 0 THEN 0.0 ELSE CAST(1.25 * t AS DOUBLE) / CAST(0.25 * g + k AS DOUBLE) END), 9) AS macro_f
  FROM (SELECT threshold, coalesce(g, 0) AS g, coalesce(k, 0) AS k, coalesce(t, 0) AS t FROM roster CROSS JOIN fthr LEFT JOIN ftr USING (s1_id) LEFT JOIN fpr USING (threshold, s1_id)) GROUP BY threshold)"""


@query(f"WITH {CAND}, {FINE_SQL} SELECT * FROM fine")
def d4_fine_threshold_sweep(spark, d):
    """D4 over the reference's grid."""
    return dec.threshold_sweep(candidates(spark, d), truth(spark, d), roster(spark, d), grid=dec.FINE_GRID).withColumn("macro_f", F.round("macro_f", 9))


@query(f"""WITH {CAND} SELECT s1_id, target_id, p, count(*) OVER (PARTITION BY target_id) AS claimants,
  CASE WHEN row_number() OVER w = 1 THEN nth_value(p, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE first_value(p) OVER w END AS best_other_p FROM cand WINDOW w AS (PARTITION BY target_id ORDER BY p DESC, s1_id)""")
def d9_claim_table(spark, d):
    return dec.claims(candidates(spark, d))


@query(f"""WITH {CAND}, {FINAL}, k AS (SELECT s1_id, target_id, max(c) AS c, max(a) AS a, max(f) AS f, max(t) AS t FROM (
  SELECT s1_id, target_id, 1 AS c, 0 AS a, 0 AS f, 0 AS t FROM cand WHERE score >= 0.1 UNION ALL SELECT s1_id, target_id, 0, 1, 0, 0 FROM acc WHERE score >= 0.1 UNION ALL SELECT s1_id, target_id, 0, 0, 1, 0 FROM fin WHERE score >= 0.1 UNION ALL SELECT s1_id, target_id, 0, 0, 0, 1 FROM truth) GROUP BY ALL)
SELECT error, count(*) AS pairs FROM (SELECT CASE WHEN t = 1 AND c = 0 THEN 'retrieval miss' WHEN t = 1 AND a = 0 THEN 'rejected' WHEN t = 1 AND f = 0 THEN 'ownership loss' WHEN t = 0 AND f = 1 THEN 'false accept' END AS error FROM k) WHERE error IS NOT NULL GROUP BY error""")
def d7_error_ledger(spark, d):
    found = F.col("score") >= 0.1
    c = candidates(spark, d)
    return dec.error_ledger(c.where(found), c.where(found & (F.col("p") >= 0.5)), final(spark, d).where(found), truth(spark, d))


@query(f"WITH {CAND}, {FINAL} SELECT r.s1_id, coalesce(string_agg(target_id, ',' ORDER BY target_id), '') AS matched_entity_ids FROM roster r LEFT JOIN fin USING (s1_id) GROUP BY r.s1_id")
def s9_id_lists(spark, d):
    return dec.id_lists(final(spark, d), roster(spark, d))


@query(f"WITH {CAND}, n AS (SELECT s1_id, source, row_number() OVER (PARTITION BY s1_id, source ORDER BY score DESC, target_id) AS rank, score, target_id FROM cand) SELECT s1_id, source, target_id, score, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 5")
def w1_rank(spark, d):
    return ret.rank(candidates(spark, d), ["s1_id", "source"]).where("rank <= 5").select("s1_id", "source", "target_id", "score", "rank")


@query(f"""WITH {CAND}, m AS (SELECT *, max(score) OVER (PARTITION BY s1_id) AS top FROM cand) SELECT s1_id, target_id, round(score / nullif(top, 0), 9) AS score_rel_max, round(top - score, 9) AS score_gap_max,
  CAST(rank() OVER (PARTITION BY s1_id ORDER BY score DESC) AS INTEGER) AS rank_overall, count(*) FILTER (score >= 0.9 * top) OVER (PARTITION BY s1_id) AS n_close FROM m""")
def fe2_relative_features(spark, d):
    w = Window.partitionBy("s1_id")
    c = candidates(spark, d).withColumn("top", F.max("score").over(w))
    return c.select("s1_id", "target_id", F.round(F.try_divide(F.col("score"), F.nullif("top", F.lit(0.0))), 9).alias("score_rel_max"), F.round(F.col("top") - F.col("score"), 9).alias("score_gap_max"),
                    F.rank().over(w.orderBy(F.desc("score"))).alias("rank_overall"), F.count_if(F.col("score") >= 0.9 * F.col("top")).over(w).alias("n_close"))


@query(f"WITH {CAND}, n AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS r FROM cand) SELECT n.s1_id, n.target_id, a.target_id AS anchor_id FROM n LEFT JOIN n a ON a.s1_id = n.s1_id AND a.r = CASE WHEN n.r = 1 THEN 2 ELSE 1 END")
def j11_anchor(spark, d):
    """Each pair's anchor: the best other candidate of its owner."""
    c = candidates(spark, d)
    ranked = ret.rank(c, ["s1_id"])
    tops = ranked.where("rank <= 2").groupBy("s1_id").agg(F.max(F.when(F.col("rank") == 1, F.col("target_id"))).alias("a1"), F.max(F.when(F.col("rank") == 2, F.col("target_id"))).alias("a2"))
    return c.join(tops, "s1_id").select("s1_id", "target_id", F.when(F.col("target_id") == F.col("a1"), F.col("a2")).otherwise(F.col("a1")).alias("anchor_id"))


CHANNELS = "ch AS (SELECT s1_id, target_id, score AS word_score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS word_rank, p AS missing_score, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, target_id) AS missing_rank FROM cand), un AS (SELECT s1_id, target_id, CASE WHEN word_rank <= 20 THEN word_score END AS word_score, CASE WHEN word_rank <= 20 THEN CAST(word_rank AS INTEGER) END AS word_rank, CASE WHEN missing_rank <= 10 THEN missing_score END AS missing_score, CASE WHEN missing_rank <= 10 THEN CAST(missing_rank AS INTEGER) END AS missing_rank FROM ch WHERE word_rank <= 20 OR missing_rank <= 10)"


def channels(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    word = ret.rank(c, ["s1_id"]).where("rank <= 20")
    missing = ret.rank(c.withColumn("score", F.col("p")), ["s1_id"]).where("rank <= 10")
    return ret.union_channels({"word": word, "missing": missing})


@query(f"WITH {CAND}, {CHANNELS} SELECT * FROM un")
def r10_channel_union(spark, d):
    return channels(spark, d)


@query(f"""WITH {CAND}, {CHANNELS}, grid AS (SELECT * FROM (VALUES (5), (10), (20)) w(word_k), (VALUES (0), (5), (10)) m(missing_k)),
kept AS (SELECT word_k, missing_k, u.s1_id, u.target_id, t.s1_id IS NOT NULL AS hit FROM grid JOIN un u ON word_rank <= word_k OR missing_rank <= missing_k LEFT JOIN truth t ON t.s1_id = u.s1_id AND t.target_id = u.target_id)
SELECT word_k, missing_k, count(*) AS pairs, count(*) FILTER (hit) AS found, round(count(*) / CAST((SELECT count(*) FROM roster) AS DOUBLE), 9) AS mean_candidates, round(count(*) FILTER (hit) / CAST((SELECT count(*) FROM truth) AS DOUBLE), 9) AS recall FROM kept GROUP BY ALL""")
def r13_budget_grid(spark, d):
    """Every (word, missing) budget in one pass: each pair joins the nine rows of the grid."""
    grid = spark.createDataFrame([(w, m) for w in (5, 10, 20) for m in (0, 5, 10)], "word_k int, missing_k int")
    t = truth(spark, d)
    pairs = channels(spark, d).join(t.withColumn("_hit", F.lit(1)), ["s1_id", "target_id"], "left")
    totals = roster(spark, d).agg(F.count(F.lit(1)).alias("owners")).crossJoin(t.agg(F.count(F.lit(1)).alias("links")))
    kept = pairs.join(F.broadcast(grid), (F.col("word_rank") <= F.col("word_k")) | (F.col("missing_rank") <= F.col("missing_k")))
    sums = kept.groupBy("word_k", "missing_k").agg(F.count(F.lit(1)).alias("pairs"), F.count("_hit").alias("found"))
    return sums.crossJoin(F.broadcast(totals)).select("word_k", "missing_k", "pairs", "found", F.round(F.col("pairs") / F.col("owners"), 9).alias("mean_candidates"), F.round(F.col("found") / F.col("links"), 9).alias("recall"))


@query(f"""WITH {CAND}, s AS (SELECT country, source, p >= 0.5 AS retrieved FROM truth JOIN cand USING (s1_id, target_id) JOIN roster USING (s1_id))
SELECT CASE WHEN grouping(country) = 0 THEN country WHEN grouping(source) = 0 THEN source ELSE 'all' END AS slice, count(*) AS links, round(avg(CAST(retrieved AS INTEGER)), 9) AS recall FROM s GROUP BY GROUPING SETS ((country), (source), ())""")
def a14_slice_recall(spark, d):
    flagged = candidates(spark, d).where("q >= 30").join(roster(spark, d), "s1_id").select("country", "source", (F.col("p") >= 0.5).cast("int").alias("retrieved"))
    sets = flagged.groupingSets([["country"], ["source"], []], "country", "source").agg(F.grouping("country").alias("gc"), F.grouping("source").alias("gs"), F.count(F.lit(1)).alias("links"), F.round(F.avg("retrieved"), 9).alias("recall"))
    return sets.select(F.when(F.col("gc") == 0, F.col("country")).when(F.col("gs") == 0, F.col("source")).otherwise("all").alias("slice"), "links", "recall")


@query(f"WITH {CAND}, {FINAL} SELECT claimants, count(*) AS targets FROM (SELECT target_id, count(*) AS claimants FROM acc GROUP BY 1) GROUP BY 1")
def d8_claimant_histogram(spark, d):
    return candidates(spark, d).where("p >= 0.5").groupBy("target_id").agg(F.count(F.lit(1)).alias("claimants")).groupBy("claimants").agg(F.count(F.lit(1)).alias("targets"))


@query(f"""WITH {CAND}, {FINAL} SELECT (SELECT count(*) FROM part) AS targets, (SELECT count(DISTINCT target_id) FROM cand) AS candidate_targets, count(DISTINCT target_id) AS accepted_targets,
  count(DISTINCT target_id) FILTER (target_id NOT IN (SELECT target_id FROM truth)) AS orphans_accepted FROM acc""")
def d12_orphan_summary(spark, d):
    c = candidates(spark, d)
    flags = c.groupBy("target_id").agg(F.max((F.col("p") >= 0.5).cast("int")).alias("a"), F.max((F.col("q") >= 30).cast("int")).alias("t"))
    sums = flags.agg(F.count(F.lit(1)).alias("candidate_targets"), F.sum("a").alias("accepted_targets"), F.count_if((F.col("a") == 1) & (F.col("t") == 0)).alias("orphans_accepted"))
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("targets")).crossJoin(sums)


UNIT = lambda c, salt: f"CAST(('0x' || substr(sha256('{salt}|' || {c}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
BAND = f"band AS (SELECT r.s1_id, country, least(count(t.target_id), 6) AS band, {UNIT('r.s1_id', 'sample')} AS u FROM roster r LEFT JOIN truth t USING (s1_id) GROUP BY ALL)"


@query(f"SELECT s1_id, u AS unit, CASE WHEN u < 0.6 THEN 'fit' WHEN u < 0.7 THEN 'tune' WHEN u < 0.8 THEN 'calibrate' ELSE 'audit' END AS role FROM (SELECT s1_id, {UNIT('s1_id', 'role')} AS u FROM (SELECT 'S1-' || c_custkey AS s1_id FROM customer))")
def l2_role_split(spark, d):
    return roster(spark, d).select("s1_id", smp.stable_unit(F.col("s1_id"), "role").alias("unit")).select("s1_id", "unit", smp.role(F.col("unit")).alias("role"))


@query(f"""WITH {CAND}, {BAND}, z AS (SELECT country, band, count(*) AS size FROM band GROUP BY ALL), f AS (SELECT *, size * 200.0::DOUBLE / (SELECT count(*) FROM band) AS exact FROM z),
q AS (SELECT country, band, floor(exact) + CAST(row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, country, band) <= 200 - sum(floor(exact)) OVER () AS INTEGER) AS quota FROM f)
SELECT s1_id, country, band FROM (SELECT *, row_number() OVER (PARTITION BY country, band ORDER BY u) AS r FROM band) JOIN q USING (country, band) WHERE r <= quota""")
def l3_stratified_take(spark, d):
    """200 owners: the sampling operator's own size."""
    n = truth(spark, d).groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    pool = roster(spark, d).join(n, "s1_id", "left").select("s1_id", "country", F.least(F.coalesce("n", F.lit(0)), F.lit(6)).cast("long").alias("band"), smp.stable_unit(F.col("s1_id"), "sample").alias("u"))
    return smp.stratified_take(pool, 200, ["country", "band"], "u").select("s1_id", "country", "band")


@query(f"""WITH {CAND}, l AS (SELECT s1_id, target_id, CAST(q >= 30 AS INTEGER) AS label, round(0.5 * p + 0.5 * score, 6) AS h, {UNIT("s1_id || target_id", 'negative')} AS u FROM cand),
a AS (SELECT *, row_number() OVER (PARTITION BY s1_id, label ORDER BY h DESC, target_id) AS r FROM l), b AS (SELECT *, label = 0 AND r <= 4 AS hard FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY s1_id, label, hard ORDER BY u, target_id) AS k, count(*) OVER (PARTITION BY s1_id, label, hard) AS n FROM b)
SELECT s1_id, target_id, label, CASE WHEN label = 1 OR hard THEN 1.0::DOUBLE ELSE round(n / CAST(least(n, 8) AS DOUBLE), 9) END AS weight FROM c WHERE label = 1 OR hard OR k <= 8""")
def l8_negative_sample(spark, d):
    frame = candidates(spark, d).select("s1_id", "target_id", (F.col("q") >= 30).cast("int").alias("label"), F.round(0.5 * F.col("p") + 0.5 * F.col("score"), 6).alias("h"), smp.stable_unit(F.concat("s1_id", "target_id"), "negative").alias("u"))
    return smp.sample_negatives(frame, "h", "u", 12, 4).select("s1_id", "target_id", "label", F.round("weight", 9).alias("weight"))


@query(f"""WITH {CAND} SELECT (SELECT count(*) FROM roster) - (SELECT count(DISTINCT s1_id) FROM roster) AS repeated_owners, count(*) FILTER (s1_id NOT LIKE 'S1-%' OR target_id NOT LIKE 'S2-%') AS bad_prefix,
  count(*) FILTER (s1_id NOT IN (SELECT s1_id FROM roster)) AS unknown_owners, count(*) FILTER (p IS NULL OR p < 0 OR p > 1) AS bad_scores, (SELECT count(*) FROM (SELECT target_id FROM truth GROUP BY 1 HAVING count(*) > 1)) AS shared_targets FROM cand""")
def v1_validation_report(spark, d):
    c, r = candidates(spark, d), roster(spark, d)
    known = c.join(r.select("s1_id", F.lit(1).alias("_known")).distinct(), "s1_id", "left")
    report = known.agg(F.count_if(~F.col("s1_id").startswith("S1-") | ~F.col("target_id").startswith("S2-")).alias("bad_prefix"), F.count_if(F.col("_known").isNull()).alias("unknown_owners"), F.count_if(F.col("p").isNull() | (F.col("p") < 0) | (F.col("p") > 1)).alias("bad_scores"))
    repeated = r.agg((F.count(F.lit(1)) - F.count_distinct("s1_id")).alias("repeated_owners"))
    shared = truth(spark, d).groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("shared_targets"))
    return repeated.crossJoin(report).crossJoin(shared)  # one row each
