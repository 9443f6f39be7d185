"""Shared plumbing: tables in the shared folder, Arrow batch maps, hashing."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries after which a per-worker word cache is emptied, so its memory stays bounded.
CACHE_LIMIT = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset the session must be local (tests), and a temporary
    folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    made = tempfile.mkdtemp(prefix="kinlink-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def session_dir(spark: SparkSession) -> str:
    """The session's own part of the shared folder."""
    return f"{shared_dir(spark)}/kinlink/{spark.sparkContext.applicationId}"


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; the stored table and its path."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage and survives lost executors; types and column order stay.
    What is returned by an operator may read such tables, so they stay until
    ``clear`` is called.
    """
    return store(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this session; call it once the results are written."""
    remove(spark, session_dir(spark))


def text_column(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column of a batch as Python strings, nulls as empty texts."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batch: pa.RecordBatch, name: str, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that one string column of each part stays near ``max_bytes``."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.nbytes <= max_bytes or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), name, max_bytes)
    yield from slices(batch.slice(half), name, max_bytes)


def parts(batches: Iterator[pa.RecordBatch], name: str, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The slices of all batches. The cycle collector rests meanwhile: word lists hold no cycles, and walking them costs a third of the time."""
    gc.disable()
    try:
        for batch in batches:
            yield from slices(batch, name, max_bytes)
    finally:
        gc.enable()


class Lexicon:
    """Words seen so far in one Arrow array; a word's place indexes the caller's own tables."""

    def __init__(self):
        self.words = pa.array([], pa.string())

    def places(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Place of each of some distinct words, and those that are new; they take the next places in order."""
        found = pc.index_in(words, value_set=self.words)
        missing = found.is_null()
        new, where = words.filter(missing), found.fill_null(0).to_numpy().astype(np.int64)
        where[missing.to_numpy(zero_copy_only=False)] = np.arange(len(self.words), len(self.words) + len(new))
        if len(new):
            self.words = pa.concat_arrays([self.words, new])
        return where, new


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-case white-space words of all texts in a row (some may be empty), and how many each text has."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    return lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy()


def gather(values: np.ndarray, length: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``picked`` of ``values``, which holds runs of the given lengths, and their lengths."""
    n = length[picked]
    ends = np.cumsum(n)
    first = np.cumsum(length) - length
    return values[np.arange(ends[-1] if len(n) else 0) + np.repeat(first[picked] - (ends - n), n)], n


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column in ``taken`` is called so in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by name, whatever marks a name holds."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def with_number(docs: DataFrame, keep: list[str], name: str, make: Callable[[], Callable[[pa.Array], np.ndarray]], max_bytes: int = 4 << 20) -> DataFrame:
    """The columns ``keep`` and, as ``name``, a number for each text; ``make`` gives a task its function of texts.

    Columns go by place on the way, so they may have any name; ``name`` must differ from them.
    """
    wanted = list(dict.fromkeys([*keep, "text"]))
    inner, at = [f"c{k}" for k in range(len(wanted))], wanted.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for part in parts(batches, inner[at], max_bytes):
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(compute(part.column(at)), pa.float64())], names=[*inner[: len(keep)], "made"])

    fields = ", ".join([*(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)), "made double"])
    return docs.select(*named(wanted)).toDF(*inner).mapInArrow(run, fields).toDF(*keep, name)


def hash64(text: str) -> int:
    """A 64-bit hash of a string that every worker agrees on."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
