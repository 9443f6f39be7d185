"""Normaliser, features, reports, models and dictionary against brute force."""

import hashlib
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinlink.functions import similarity as sim
from kinlink.functions import text as tx
from kinlink.operators import decisions, dictionary, features, grouped, models, relations, reports, retrieval, sampling
from kinlink.streaming import matching


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [
    ("10 main street new york new york", "10 main st ny ny"),
    ("west bengal west bengal west road", "wb wb w rd"),
    ("new york", "ny"), ("", ""), ("newyork new", "newyork new"),
])
def test_phrases_that_stand_side_by_side(spark, raw, want):
    assert one(spark, raw, tx.states_and_streets) == want


def test_dotted_forms_and_placeholders(spark):
    assert one(spark, "acme l l c l l c", tx.strip_legal) == "acme"
    assert one(spark, "inc co", tx.strip_legal) == "inc co"
    row = spark.createDataFrame([("S2-1", "Acme Pvt", "10/n/a main, दिल्ली", "IN", "S2")], "entity_id string, business_name string, business_address string, country string, source string")
    got = tx.normalise(row).first()
    assert (got["addr_nums"], got["addr_norm"], got["name_red"]) == (["10"], "10 main dl", "acme")
    views = tx.number_views(F.col("x"))
    got = spark.createDataFrame([("１２Ｂ main Suite ５",)], "x string").select(*[c.alias(n) for n, c in views.items()]).first()
    assert tuple(got) == ("12b", "5", "", 1)


def test_dictionary_before_romanisation(spark):
    table = spark.createDataFrame([("कमल", "camel")], "token string, latin string")
    rows = spark.createDataFrame([(1, "कमल shop राम"), (2, "plain shop"), (3, None), (4, "कमल shop राम")], "i int, name string")
    got = {r["i"]: r["name"] for r in tx.to_latin(rows, "name", table).collect()}
    assert got == {1: "camel shop ram", 2: "plain shop", 3: None, 4: "camel shop ram"}
    share = tx.coverage(rows, "name", table).first()
    assert (share["occurrences"], share["known_share"]) == (4, 0.5)
    pairs = spark.createDataFrame([("ram stores", "राम shop")] * 3 + [("kamal x", "कमल y")] * 2, "latin_text string, native_text string")
    assert [(r["token"], r["latin"], r["n"], r["share"]) for r in dictionary.learn(pairs).collect()] == [("राम", "ram", 3, 1.0)]


def test_base_features_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["red", "ring", "blue", "widget", "steel", "bolt"]
    text = lambda: " ".join(rng.sample(words, rng.randint(0, 3)))
    rows = [(f"S1-{i}", f"S2-{i}{j}", rng.choice(["S2", "S3"]), round(rng.random(), 2), j + 1, *(text() for _ in range(6)), rng.sample("123", 2), rng.sample("123", 1), bool(j % 2)) for i in range(6) for j in range(5)]
    schema = "s1_id string, target_id string, source string, score double, rank int, q_name_red string, t_name_red string, q_name_cons string, t_name_cons string, q_addr_norm string, t_addr_norm string, q_addr_nums array<string>, t_addr_nums array<string>, t_name_nonlatin boolean"
    made = {(r["s1_id"], r["target_id"]): r for r in features.base_features(spark.createDataFrame(rows, schema)).collect()}
    assert len(made) == len(rows) and made[rows[0][:2]].asDict().keys() == {"s1_id", "target_id", "source", *features.BASE, *features.EXTRA}
    for r in rows:
        got, group = made[r[:2]], sorted((x for x in rows if x[0] == r[0]), key=lambda x: (-x[3], x[1]))
        anchor = group[1] if group[0][1] == r[1] else group[0]
        value = lambda f, a, b: f(a, b) if a and b else None
        want = {"name_red_ratio": value(sim.indel, r[5], r[6]), "addr_token_set": value(sim.token_set, r[9], r[10]), "name_nospace_ratio": value(sim.indel, r[5].replace(" ", ""), r[6].replace(" ", "")), "anchor_name_set": value(sim.token_set, r[6], anchor[6]),
                "num_shared": len(set(r[11]) & set(r[12])), "rank_overall": 1 + sum(x[3] > r[3] for x in group), "n_close": sum(x[3] >= 0.9 * group[0][3] for x in group), "source_s3": int(r[2] == "S3"), "cand_addr_missing": int(not r[10])}
        for name, x in want.items():
            assert got[name] == pytest.approx(x) if x is not None else got[name] is None, name


def test_overlap_of_unseen_and_empty_texts(spark):
    idf = spark.createDataFrame([("S2", "main", 2.0)], "source string, token string, idf double")
    sizes = spark.createDataFrame([("S2", 9)], "source string, _n long")
    pairs = spark.createDataFrame([("a", "x", "S2", "main new", "main"), ("a", "y", "S2", "", "main")], "s1_id string, target_id string, source string, q string, t string")
    got = {r["target_id"]: r for r in features.weighted_overlap(pairs, F.col("q"), F.col("t"), idf, sizes, ["source"], "name").collect()}
    unseen = math.log(10) + 1
    assert got["x"]["name_unshared_query"] == pytest.approx(unseen) and got["x"]["name_weighted_jaccard"] == pytest.approx(2 / (2 + unseen)) and got["y"]["name_shared_idf"] is None


def test_losses_sum_to_the_final_loss(spark):
    frame = lambda rows: spark.createDataFrame(rows, "s1_id string, target_id string")
    accepted = spark.createDataFrame([("a", "x", 0.9), ("b", "x", 0.95), ("a", "k", 0.6), ("d", "y", 0.7)], "s1_id string, target_id string, p double")
    truth, roster = frame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")]), spark.createDataFrame([(o,) for o in "abcde"], "s1_id string")
    found = accepted.select("s1_id", "target_id").union(frame([("a", "y")]))
    row = reports.loss_decomposition(found, accepted, truth, roster).first()
    assert sum(row[c] for c in ("retrieval_loss", "rejection_loss", "false_acceptance_loss", "ownership_loss")) == pytest.approx(row["total_loss"])
    assert row["retrieval_loss"] == pytest.approx(2 / 5) and row["ownership_loss"] > 0


def test_checked_join_and_units(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert relations.checked_join(left, right, ["k"]).count() == 2
    with pytest.raises(ValueError, match="1 rows lost, 1 multiplied"):
        relations.checked_join(left, right.where("k = 1").union(right.where("k = 1")), ["k"])
    want = int.from_bytes(hashlib.blake2b(b"salt|S1-7", digest_size=8).digest(), "big") / 2**64
    assert one(spark, "S1-7", lambda c: sampling.blake_unit(c, "salt")) == want


def test_a_claim_without_a_score_owns_nothing(spark):
    rows = spark.createDataFrame([("a", "x", None), ("c", "x", 0.9), ("b", "x", 0.9), ("a", "y", None)], "s1_id string, target_id string, p double")
    assert list(map(tuple, decisions.one_owner(rows).collect())) == [("b", "x", 0.9)]


def test_auc_counts_ties_half(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 9) / 10, int(rng.random() < 0.4)) for _ in range(200)]
    got = reports.score_metrics(spark.createDataFrame(rows, "p double, label int").repartition(5), "p", "label").first()
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    assert got["auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)) and got["pairs"] == 200


def test_trees_learn_and_survive_storage(spark, tmp_path):
    rng = random.Random(6)
    rows = [(x := rng.random(), None if rng.random() < 0.2 else rng.random(), int(x + 0.1 * rng.random() > 0.6)) for _ in range(1200)]
    frame = spark.createDataFrame(rows, "a double, b double, label int")
    train, tune = frame.where("b IS NULL OR b < 0.7"), frame.where("b >= 0.7")
    model = models.fit(train, tune, ("a", "b"), s=models.Settings(rounds=8, rate=0.3, depth=3, least_rows=5))
    assert models.evaluate(model, tune).first()["auc"] > 0.97 and models.importances(model)[0][0] == "a"
    model.save(str(tmp_path / "m"))
    again = models.Model.load(str(tmp_path / "m"))
    assert [r["p"] for r in models.predict(again, tune).orderBy("a").limit(5).collect()] == [r["p"] for r in models.predict(model, tune).orderBy("a").limit(5).collect()]


def test_stream_answers_every_owner_once(spark, tmp_path):
    targets = spark.createDataFrame([("US", "t1", "red ring"), ("US", "t2", "red bolt"), ("US", "t3", "blue ring")], "block string, id string, text string")
    for k, text in enumerate(["red ring", "blue bolt"]):
        spark.createDataFrame([("US", f"o{k}", text)], targets.schema).write.parquet(str(tmp_path / f"in/{k}"))
    owners = spark.readStream.schema(targets.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        matching.match_stream(owners, targets, retrieval.words, 1, 0.1, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("s1_id", "target_id").collect()
    assert ("o0", "t1") in set(map(tuple, got)) and len(got) == len({r["s1_id"] for r in got})


def test_scores_of_many_pairs_equal_those_of_one():
    rng = random.Random(9)
    one_by_one = {"ratio": sim.indel, "token_sort": sim.token_sort, "token_set": sim.token_set, "partial": sim.partial, "jaro_winkler": sim.jaro_winkler}
    for letters, longest in (("ab ", 9), ("abcdé 𝒳\0", 30), ("xyz", 64), ("ab c", 90)):
        made = lambda: ["".join(rng.choices(letters, k=rng.randint(0, longest))) for _ in range(300)]  # noqa: B023, E731
        for a, b in ((made(), made()), (["cat dog", "Supplier#1", "x" * 64], ["eel", "Customer#2", "x" * 64])):
            for name, f in one_by_one.items():
                assert sim.scores(name, pd.Series(a), pd.Series(b)).tolist() == [f(x, y) for x, y in zip(a, b, strict=True)], name


def test_pairs_of_parts_are_measured_by_profile(spark, tmp_path):
    from kinlink.plans import third_stage

    part = [(i, f"name{i % 2}", "B", "LARGE", 10 + i % 3) for i in range(60)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    seen = []

    def measure(pairs):
        seen.append(pairs.groupBy("p_brand", "p_size", "x", "y").count().count())
        return pairs.withColumn("sum", F.col("x") + F.col("y"))

    got = sorted(map(tuple, third_stage.measured(spark, str(tmp_path), (["x"], ["y"]), measure).collect()))
    assert got == sorted((f"S1-{a[0]}", f"S2-{b[0]}", a[4] % 4 + b[4] % 5) for a in part for b in part if a[4] == b[4] and a[0] != b[0]) and seen == [3]
    assert third_stage.fe4_number_match(spark, str(tmp_path)).count() == len(got)


def test_overlap_measures_each_combination_of_texts_once(spark, monkeypatch):
    idf = spark.createDataFrame([("S2", "main", 2.0)], "source string, token string, idf double")
    sizes = spark.createDataFrame([("S2", 9)], "source string, _n long")
    pairs = spark.createDataFrame([(f"a{i}", f"x{i}", "S2", "main new", "main" if i % 2 else None) for i in range(20)], "s1_id string, target_id string, source string, q string, t string")
    seen, inner = [], features.overlap_of_texts
    monkeypatch.setattr(features, "overlap_of_texts", lambda texts, *a: seen.append(texts.count()) or inner(texts, *a))
    got = {r["s1_id"]: r["name_shared_idf"] for r in features.weighted_overlap(pairs, F.col("q"), F.col("t"), idf, sizes, ["source"], "name").collect()}
    assert seen == [2] and got == {f"a{i}": 2.0 if i % 2 else None for i in range(20)}


def test_features_by_key_equal_those_of_pairs(spark, monkeypatch):
    """Every owner meets each target of its key but itself, without a pair being shuffled; only repeated owners go by pairs."""
    rng = random.Random(5)
    words = ["red", "ring", "blue", "widget", "steel", "bolt"]
    text = lambda: " ".join(rng.sample(words, rng.randint(0, 3))) or None
    side = lambda s, n, extra: [(rng.choice(["a", "b", None]), f"{s}-{i}", i if i % 11 else None, *extra(i), text(), text(), text(), rng.sample("123", i % 3)) for i in [*range(n), 3, 4]]
    texts = lambda s: f"{s}_name_red string, {s}_name_cons string, {s}_addr_norm string, {s}_addr_nums array<string>"
    owners = spark.createDataFrame(side("S1", 40, lambda i: (i % 3 / 2,)), f"k string, s1_id string, _self long, score double, {texts('q')}")
    targets = spark.createDataFrame(side("S2", 30, lambda i: ("S3" if i % 4 else "S2", bool(i % 2)))[:-2], f"k string, target_id string, _self long, source string, t_name_nonlatin boolean, {texts('t')}")
    pairs = owners.withColumnRenamed("_self", "_left").join(targets.withColumnRenamed("_self", "_right"), "k").where("_left <> _right")
    want = features.base_features(retrieval.rank(pairs, ["s1_id", "source"]))
    seen, base = [], features.base_features
    monkeypatch.setattr(features, "base_features", lambda p: seen.append(p.select("s1_id").distinct().count()) or base(p))
    for parts in (1024, 3):
        monkeypatch.setattr(grouped, "OWNERS", parts)
        got = grouped.features_by_key(owners, targets, ["k"])
        assert got.schema.simpleString() == want.schema.simpleString()
        order = lambda df: sorted(map(tuple, df.where("s1_id NOT IN ('S1-3', 'S1-4')").collect()), key=lambda r: r[:2])
        assert order(got) == order(want) and len(order(got)) > 100
        assert got.count() == want.count() and max(seen) <= 2
