"""Files: round trips, order, refusals."""

import pytest
from pyspark.sql import functions as F

from kinlink.sources import tables


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(("\n".join(lines) + "\n").encode())
    return str(path)


HEAD = "\t".join(tables.RECORD_COLUMNS)


def test_records_are_read_without_quoting(spark, tmp_path):
    put(tmp_path / "train/train_source1.tsv", HEAD, 'S1-2\tA "quoted, name\t\tUS', "S1-1\tnull\tx\tIN")
    put(tmp_path / "train/train_source2.tsv", HEAD, "S2-Ω\té\taddr, 2\tUS")
    put(tmp_path / "train/train_source3.tsv", HEAD, "S3-1\tb\tc\tUS")
    rows = {r["entity_id"]: r for r in tables.load_records(spark, str(tmp_path), "train").collect()}
    assert (rows["S1-2"]["business_name"], rows["S1-2"]["business_address"], rows["S1-1"]["business_name"]) == ('A "quoted, name', "", "null")
    assert rows["S2-Ω"]["source"] == "S2" and len(rows) == 4
    assert [r["s1_id"] for r in tables.roster_of(spark, str(tmp_path / "train/train_source1.tsv")).orderBy("row_no").collect()] == ["S1-2", "S1-1"]
    with pytest.raises(ValueError, match="header"):
        tables.read_tsv(spark, put(tmp_path / "bad.tsv", "a\tb", "1\t2"), ["b", "a"])
    put(tmp_path / "train/train_source3.tsv", HEAD, "S2-9\tb\tc\t")
    with pytest.raises(ValueError, match="1 bad_prefix, 1 empty_country"):
        tables.load_records(spark, str(tmp_path), "train")


def test_id_lists_round_trip(spark, tmp_path):
    path = put(tmp_path / "labels.tsv", "source1_entity_id\tmatched_entity_ids", "S1-9\tS2-2, S3-1", "S1-1\t", "S1-5\tS2-1")
    links, roster = tables.load_labels(spark, path)
    assert sorted(map(tuple, links.collect())) == [("S1-5", "S2-1"), ("S1-9", "S2-2"), ("S1-9", "S3-1")]
    out = str(tmp_path / "out.tsv")
    tables.write_id_lists(links.union(links), roster, out, "matched_entity_ids")
    assert open(out, "rb").read() == b"source1_entity_id\tmatched_entity_ids\nS1-9\tS2-2,S3-1\nS1-1\t\nS1-5\tS2-1\n"
    assert tables.same_rows(tables.read_id_lists(spark, out, "matched_entity_ids"), links)
    tables.rewrite_lists(spark, out, roster.withColumn("row_no", -F.col("row_no")), "matched_entity_ids")
    assert [x.split("\t")[0] for x in open(out).read().splitlines()[1:]] == ["S1-5", "S1-1", "S1-9"]
    with pytest.raises(ValueError, match="repeated_link"):
        tables.load_labels(spark, put(tmp_path / "twice.tsv", "source1_entity_id\tmatched_entity_ids", "S1-9\tS2-2,S2-2"))


def test_export_gives_targets_one_owner(spark, tmp_path):
    rows = [("S1-1", "S2-1", "S2", 0.95, 1.0, 1), ("S1-2", "S2-1", "S2", 0.95, 1.0, 1), ("S1-2", "S3-1", "S3", 0.5, 1.0, 1)]
    spark.createDataFrame(rows, tables.SCORE_SCHEMA).write.parquet(str(tmp_path / "scores"))
    scores = tables.read_scores(spark, str(tmp_path / "scores"))
    roster = spark.createDataFrame([("S1-2", 0), ("S1-1", 1), ("S1-3", 2)], "s1_id string, row_no long")
    tables.export(scores, roster, 0.9, str(tmp_path / "out"))
    assert open(tmp_path / "out/matches.tsv").read().splitlines()[1:] == ["S1-2\t", "S1-1\tS2-1", "S1-3\t"]
    tables.verify_export(str(tmp_path / "out"))
    with open(tmp_path / "out/matches.tsv", "a") as f:
        f.write("x")
    with pytest.raises(ValueError, match="differs"):
        tables.verify_export(str(tmp_path / "out"))
    spark.createDataFrame([(*rows[0][:3], 1.5, 1.0, 0)], tables.SCORE_SCHEMA).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="1 bad_p, 1 bad_rank"):
        tables.read_scores(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="outside"):
        tables.export(scores, roster.limit(0), 0.9, str(tmp_path / "none"))


def test_contracts_claims_and_batches(spark, tmp_path):
    tables.contract(str(tmp_path / "c.json"), {"k": 1})
    tables.contract(str(tmp_path / "c.json"), {"k": 1})
    with pytest.raises(ValueError, match="other settings"):
        tables.contract(str(tmp_path / "c.json"), {"k": 2})
    tables.claim_once(str(tmp_path / "audit"), "first")
    with pytest.raises(ValueError, match="first"):
        tables.claim_once(str(tmp_path / "audit"), "second")
    frame = spark.createDataFrame([(f"o{i:03d}", j) for i in range(50) for j in range(1 + i % 4)], "s1_id string, j int")
    got = sorted(map(tuple, tables.owner_batches(frame, 10).collect()))
    total = 0
    for i, (owner, n, batch) in enumerate(got):
        assert (owner, n, batch) == (f"o{i:03d}", 1 + i % 4, total // 10)
        total += n
