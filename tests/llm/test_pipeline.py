"""The stages of the corpus pipeline on odd inputs, each against a brute-force version of its decisions."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinlink.llm import decontaminate, quality, toxicity

#: Names that the stages might use inside.
CLASHES = ["score", "_score", "posterior", "site_share", "path_share", "_site", "_section", "_p", "_j", "_salt", "_set", "_text", "node", "root", "n", "s", "class_id", "item", "ids", "a.b"]


def prose(rng, n):
    return " ".join(f"w{rng.randrange(900)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, repeats, ties, long texts and clashing columns; labels and benchmark."""
    rng = random.Random(31)
    rows, labels = [], []
    for i in range(240):
        words = prose(rng, rng.randint(30, 90)).split()
        bad, toxic = i % 6 == 0, i % 5 == 1
        if bad:
            words = ["#$%"] * 40
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["stupidhead", "worthlesss", "idioticly"])
        rows.append((i, " ".join(words), ("en", "de")[i % 2], f"src{i % 3}"))
        labels.append((i, int(not bad), int(toxic)))
    items = [(k, prose(rng, 25) + ". " + prose(rng, 6) + ".") for k in range(5)]
    good = next(t for i, t, *_ in rows if i % 6 and i % 5 != 1)
    rows += [(300, good, "en", None), (301, good + " w1", None, "src1"), (302, prose(rng, 40) + " " + items[2][1] + " " + prose(rng, 40), "en", "src1")]
    rows += [(303, None, "en", "src0"), (304, "", "de", "src1"), (305, prose(rng, 30000), "en", "src2"), (None, prose(rng, 50), "en", "src0"), (306, prose(rng, 50), "en", "src0")]
    rows += [rows[-1], (307, "x" * 50_000, "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.select("*", *[F.lit(0.5).alias(c) for c in CLASHES])
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*items, (9, None), (10, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def bag(frame):
    return Counter(tuple(r) for r in frame.select(*[F.col(f"`{c}`") for c in frame.columns]).collect())


def sets_of(texts):
    found = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        found.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {t or ""})
    return found


def test_stages_keep_whole_rows_and_decide_as_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, folder)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        rows, now = bag(before), bag(kept)
        assert not now - rows, name  # nothing new, nothing altered
        ids = Counter(r[0] for r in rows.elements())
        if name == "quality classifier":
            model = quality.fit(before, labels)
            p = [float(model(quality.np.array([quality.statistics(r[1] or "")]))[0]) for r in rows.elements()]
            paths = defaultdict(list)
            for r, x in zip(rows.elements(), p, strict=True):
                paths[(r[3], r[2])].append(x)
            known = quality.priors(before.select("source", "lang").limit(0).withColumn("_p", F.lit(0.0)), "source", "lang")
            assert known.everywhere == 0.5  # an empty table has no evidence
            gone = {r[0] for r in (rows - now).elements()}
            assert {i for i in range(240) if i % 6 == 0} <= gone and not {i for i in range(240) if i % 6} & gone
        if name == "toxicity":
            model = toxicity.fit(before, labels)
            scored = toxicity.score(before.select("doc_id", "text"), model, ["doc_id", "text"]).collect()
            assert Counter(r["doc_id"] for r in scored if r["score"] < 0.3) == Counter(r[0] for r in now.elements())
        if name == "n-gram jaccard join":
            listed = sorted((r for r in rows.elements() if r[0] is not None), key=lambda r: r[0])
            sets, root = sets_of([r[1] for r in listed]), list(range(len(listed)))
            for i, a in enumerate(sets):
                for j in range(i):
                    both = len(a & sets[j])
                    if both * 1000 >= 800 * (len(a) + len(sets[j]) - both):
                        low, high = sorted((root[i], root[j]))
                        root = [low if x == high else x for x in root]
            stay = {listed[k][0] for k in set(root)}
            assert {r[0] for r in now.elements()} == stay | ({None} if None in ids else set())
        if name == "benchmark decontamination":
            leaked = {r["doc_id"] for r in decontaminate.leaks(before, bench).collect()}
            assert leaked == {302} & set(ids) and set(ids) - {r[0] for r in now.elements()} == leaked


def test_pipeline_runs_whole_and_on_empty_tables(spark, folder, tmp_path):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict()) and 302 not in {r["doc_id"] for r in rows}
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
