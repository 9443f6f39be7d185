"""Files in and out: quote-free tab-separated records, label lists, id lists, score shards, published folders.

Every reader checks its header, nothing is inferred, and an empty field is an
empty text. Writers put a file in place only when it is whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SOURCES = ("S1", "S2", "S3")
RECORD_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
SCORE_SCHEMA = "s1_id string, target_id string, source string, p double, score double, rank int"
KEYS = ["s1_id", "target_id"]


def read_tsv(spark: SparkSession, path: str, columns: list[str], numbered: bool = False) -> DataFrame:
    """All columns as texts, without quoting; raises where the header differs.

    ``numbered`` adds row_no, which grows in the order of the file.
    """
    header = spark.read.text(path).limit(1).collect()
    found = header[0][0].removeprefix("﻿").rstrip("\r").split("\t") if header else []
    if found != columns:
        raise ValueError(f"{path}: header {found}, expected {columns}")
    schema = StructType([StructField(c, StringType()) for c in columns])
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("escape", "").option("header", True).option("enforceSchema", True).csv(path)
    rows = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])
    return rows.withColumn("row_no", F.monotonically_increasing_id()) if numbered else rows


def rejected(frame: DataFrame, **rules: Column) -> dict[str, int]:
    """Rows that break each rule, in one pass."""
    row = frame.agg(*[F.count_if(c).alias(n) for n, c in rules.items()]).first()
    return {n: row[n] for n in rules}


def refuse(what: str, found: dict[str, int]) -> None:
    if any(found.values()):
        raise ValueError(f"{what}: {', '.join(f'{n} {k}' for k, n in found.items() if n)}")


def repeated(frame: DataFrame, *keys: str) -> int:
    """Keys on more than one row."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.count(F.lit(1))).first()[0]


def load_records(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The sources of a split as one table with ``source``; raises on foreign prefixes, repeated ids or empty countries."""
    parts = [read_tsv(spark, f"{folder}/{split}/{split}_source{s[1]}.tsv", RECORD_COLUMNS).withColumn("source", F.lit(s)) for s in SOURCES]
    records = reduce(DataFrame.unionByName, parts)
    refuse(f"{split} records", rejected(records, bad_prefix=~F.startswith("entity_id", F.concat("source", F.lit("-"))), empty_country=F.col("country") == "") | {"repeated_id": repeated(records, "entity_id")})
    return records


def split_lists(lists: DataFrame, owner: str, column: str) -> DataFrame:
    """s1_id, target_id of comma-joined lists; empty lists and entries give no rows."""
    return lists.select(F.col(owner).alias("s1_id"), F.explode(F.split(F.coalesce(column, F.lit("")), ",")).alias("target_id")).withColumn("target_id", F.trim("target_id")).where("target_id <> ''")


def load_labels(spark: SparkSession, path: str, columns: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> tuple[DataFrame, DataFrame]:
    """True links (s1_id, target_id) and the roster (s1_id, row_no) of a label file; raises on repeated owners or links."""
    raw = read_tsv(spark, path, list(columns), numbered=True)
    links = split_lists(raw, *columns)
    refuse(path, {"repeated_owner": repeated(raw, columns[0]), "repeated_link": repeated(links, *KEYS)})
    return links, raw.select(F.col(columns[0]).alias("s1_id"), "row_no")


def roster_of(spark: SparkSession, path: str) -> DataFrame:
    """s1_id, row_no of a source file, in its order."""
    return read_tsv(spark, path, RECORD_COLUMNS, numbered=True).select(F.col("entity_id").alias("s1_id"), "row_no")


def list_rows(links: DataFrame, roster: DataFrame, column: str) -> DataFrame:
    """source1_entity_id, its sorted distinct targets comma-joined, row_no: one row an owner of the roster."""
    lists = links.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias(column))
    return roster.join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column), "row_no")


def write_id_lists(links: DataFrame, roster: DataFrame, path: str, column: str) -> None:
    """One row an owner, in roster order: id, tab, comma-joined target ids; UTF-8, no quotes, line feeds.

    Spark sorts by row_no and writes the lines; the parts are then joined, in
    order, into one file that takes its name when it is whole.
    """
    refuse("roster", {"repeated_owner": repeated(roster, "s1_id")})
    rows = list_rows(links, roster, column).orderBy("row_no")
    parts = Path(f"{path}.parts")
    rows.select(F.concat_ws("\t", "source1_entity_id", column).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(str(parts))
    draft = Path(f"{path}.tmp")
    with draft.open("wb") as out:
        out.write(f"source1_entity_id\t{column}\n".encode())
        for part in sorted(parts.glob("part-*")):
            with part.open("rb") as given:
                while block := given.read(1 << 20):
                    out.write(block)
            part.unlink()
    os.replace(draft, path)
    for rest in (*parts.iterdir(),):
        rest.unlink()
    parts.rmdir()


def read_id_lists(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The links of a file that ``write_id_lists`` wrote."""
    return split_lists(read_tsv(spark, path, ["source1_entity_id", column]), "source1_entity_id", column)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def rewrite_lists(spark: SparkSession, path: str, roster: DataFrame, column: str) -> None:
    """Write a list file again in roster order; raises, leaving the old file, where its links would change."""
    links = read_id_lists(spark, path, column)
    draft = f"{path}.again"
    write_id_lists(links, roster, draft, column)
    if not same_rows(links, read_id_lists(spark, draft, column)):
        os.unlink(draft)
        raise ValueError(f"{path}: links would change")
    os.replace(draft, path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score shards as one table; raises on another schema, p outside 0 to 1, ranks under 1 or repeated pairs."""
    scores = spark.read.parquet(path)
    expected = spark.createDataFrame([], SCORE_SCHEMA).schema
    if [(f.name, f.dataType) for f in scores.schema] != [(f.name, f.dataType) for f in expected]:
        raise ValueError(f"{path}: schema {scores.schema.simpleString()}")
    bad_p = F.col("p").isNull() | F.isnan("p") | (F.col("p") < 0) | (F.col("p") > 1)
    refuse(path, rejected(scores, bad_p=bad_p, bad_rank=~F.coalesce(F.col("rank") >= 1, F.lit(False))) | {"repeated_pair": repeated(scores, *KEYS)})
    return scores


def export(scores: DataFrame, roster: DataFrame, threshold: float, folder: str) -> dict:
    """Candidate and match lists of a roster, each target with one owner, and a manifest of their sizes and hashes."""
    from kinlink.operators.decisions import one_owner

    outside = scores.join(roster, "s1_id", "left_anti").limit(1).count()
    refuse("scores", {"owner_outside_roster": outside})
    Path(folder).mkdir(parents=True, exist_ok=True)
    accepted = one_owner(scores.where(F.col("p") >= threshold))
    write_id_lists(scores, roster, f"{folder}/candidates.tsv", "candidate_entity_ids")
    write_id_lists(accepted, roster, f"{folder}/matches.tsv", "matched_entity_ids")
    manifest = {n: fingerprint(f"{folder}/{n}") for n in ("candidates.tsv", "matches.tsv")}
    write_json(f"{folder}/manifest.json", manifest)
    return manifest


def fingerprint(path: str) -> dict:
    """Size and SHA-256 of a file."""
    digest, size = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
            size += len(block)
    return {"bytes": size, "sha256": digest.hexdigest()}


def verify_export(folder: str) -> None:
    """Raises where a published file differs from its manifest, or the manifest names a file outside the folder."""
    for name, known in json.loads(Path(folder, "manifest.json").read_text()).items():
        if Path(name).name != name:
            raise ValueError(f"{name}: outside the folder")
        if fingerprint(f"{folder}/{name}") != known:
            raise ValueError(f"{name}: differs from the manifest")


def write_json(path: str, value: object) -> None:
    """Canonical JSON, put in place when whole."""
    draft = Path(f"{path}.tmp")
    draft.write_text(json.dumps(value, sort_keys=True, ensure_ascii=False, indent=1) + "\n", encoding="utf-8")
    os.replace(draft, path)


def contract(path: str, value: dict) -> None:
    """Write the settings of a run, or raise where the folder was made with others."""
    if Path(path).exists():
        if json.loads(Path(path).read_text(encoding="utf-8")) != json.loads(json.dumps(value)):
            raise ValueError(f"{path}: made with other settings")
    else:
        write_json(path, value)


def claim_once(path: str, by: str) -> None:
    """Mark a reserved population as used; raises where it is already."""
    try:
        with open(path, "x", encoding="utf-8") as f:
            f.write(by + "\n")
    except FileExistsError:
        raise ValueError(f"{path}: used by {Path(path).read_text(encoding='utf-8').strip()}") from None


def publish(draft: str, folder: str) -> None:
    """Give a finished folder its name; raises where that exists."""
    if Path(folder).exists():
        raise ValueError(f"{folder}: exists")
    os.rename(draft, folder)


def write_partitioned(frame: DataFrame, path: str, by: Iterable[str]) -> None:
    """Parquet by folders of ``by``, so that a reader's filter on them opens only its own; an existing table is not touched."""
    frame.write.mode("errorifexists").partitionBy(*by).parquet(path)


def owner_batches(candidates: DataFrame, size: int) -> DataFrame:
    """s1_id and the batch it is in: owners in order, whole, about ``size`` candidates a batch.

    Running totals come from range totals, so no task sees all owners.
    """
    counts = candidates.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("s1_id").withColumn("_part", F.spark_partition_id())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = counts.groupBy("_part").agg(F.sum("n").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select("_part", "_start")
    running = Window.partitionBy("_part").orderBy("s1_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(F.broadcast(starts), "_part").withColumn("_at", F.col("_start") + F.coalesce(F.sum("n").over(running), F.lit(0)))
    return placed.select("s1_id", "n", F.floor(F.col("_at") / size).cast("int").alias("batch"))
