"""Best-fit packing planned on the histogram of lengths.

Lengths of pieces are counted, never gathered: a driver-side plan places
*counts* by best fit decreasing (at most one histogram row per length up to
the capacity), and pieces then take the planned slots by a join on their rank
within their length.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink.llm.common import Lexicon, gather, load, materialise, parts, split_words

CAPACITY = 4096
END_ID = 1
#: Ranks that one row of the plan covers at most, so that no join key is hot.
RANK_BLOCK = 4096


class WordEncoder:
    """Ids of a lower-casing word-level BPE file.

    The file's splitter cuts a text into runs that its merges never cross, so
    a text's ids are those of its words, and each distinct word is encoded
    once. Words are told apart by Arrow, and what is known of them stands in
    flat arrays of at most ``room`` bytes, emptied when full: nothing is kept
    per word as a Python object. Only texts made of characters on which the
    splitter is restated exactly take this way; all others, and texts with
    "<|", go to the library whole.
    """

    made: dict[str, WordEncoder] = {}
    POINTS = [*range(0x20, 0x7F), 0x0A, 0x0D, 0x09, *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]

    def __init__(self, path: str, room: int = 16 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already take all cores
        from tokenizers import Tokenizer

        self.library, self.room = Tokenizer.from_file(path), room
        escaped = lambda chars: "".join(re.escape(c) for c in chars)
        points = [chr(p) for p in self.POINTS]
        letters = [c for c in points if unicodedata.category(c)[0] == "L"]
        numbers = [c for c in points if unicodedata.category(c)[0] == "N"]
        others = [c for c in points if unicodedata.category(c)[0] not in "LN" and c not in " \t\r\n"]
        known = [c for c, low in zip(points, pc.utf8_lower(pa.array(points)).to_pylist(), strict=True) if c.lower() == low and set(low) <= set(points)]
        self.odd = "<\\||[^" + "".join(rf"\x{{{ord(c):x}}}" for c in known) + "]"
        self.runs = re.compile(f"[{escaped(letters)}]+|'s|'t|'re|'ve|'m|'ll|'d|[{escaped(numbers)}]|[{escaped(others)}]+")
        self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.ends[[i for w, i in self.library.get_vocab().items() if w.endswith("</w>")]] = True
        self.forget()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def forget(self) -> None:
        self.lexicon = Lexicon()
        self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. Runs are encoded many at a time; each ends with its only token that ends a word."""
        split = list(map(self.runs.findall, words))
        place: dict[str, int] = {}
        run = np.fromiter((place.setdefault(r, len(place)) for rs in split for r in rs), np.int64)
        distinct = list(place)
        ids, length = [], []
        for at in range(0, len(distinct), 2000):
            some = distinct[at : at + 2000]
            made = self.whole(" ".join(some))
            stops = np.flatnonzero(self.ends[made]) + 1
            if len(stops) != len(some) or stops[-1] != len(made):
                alone = [self.whole(r) for r in some]
                made, stops = np.concatenate(alone), np.cumsum([len(x) for x in alone])
            ids.append(made)
            length.append(np.diff(stops, prepend=0))
        if not ids:
            return np.zeros(0, "<u4"), np.zeros(len(words), np.int64)
        flat, n = gather(np.concatenate(ids), np.concatenate(length), run)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        total = np.concatenate(([0], np.cumsum(n)))
        ends = np.cumsum(sizes)
        return flat, total[ends] - total[ends - sizes]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.odd)
        found, count = split_words(pc.if_else(odd, "", texts))
        if self.lexicon.words.nbytes + self.ids.nbytes + self.length.nbytes > self.room:
            self.forget()
        where, new = self.lexicon.places(found.dictionary)
        if len(new):
            ids, length = self.learn(new.to_pylist())
            self.ids, self.length = np.concatenate((self.ids, ids)), np.concatenate((self.length, length))
        flat, n = gather(self.ids, self.length, where[found.indices.to_numpy()])
        length = np.diff(np.concatenate(([0], np.cumsum(n)))[np.cumsum(count)], prepend=0)
        if (at := np.flatnonzero(odd.to_numpy(zero_copy_only=False))).size:
            cut = np.split(flat, np.cumsum(length)[:-1])
            for k in at.tolist():
                cut[k] = self.whole(texts[k].as_py())
            flat, length = np.concatenate(cut), np.fromiter(map(len, cut), np.int64, len(cut))
        return flat, length


def encode_pieces(docs: DataFrame, model_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.of(model_file)
        for part in parts(batches, "text", 4 << 20):
            ids, length = encode(part.column(1))
            count = length // capacity + 1  # with the end id no document is empty
            row = np.repeat(np.arange(len(length)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            size = np.minimum(length[row] + 1 - piece * capacity, capacity)
            last = piece == count[row] - 1
            first = (np.cumsum(length) - length)[row] + piece * capacity
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(end if closes else b"", zlib.crc32(raw[4 * a : 4 * (a + n - closes)])) for a, n, closes in zip(first.tolist(), size.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_counts(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit decreasing over counts.

    Returns slots (length, first rank, count, first sequence, items a sequence,
    first offset) and the number of sequences. Open sequences of equal residual
    stand in runs (first sequence, how many); a placement takes whole runs and
    splits one at most, so runs grow by two a length at most.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    residuals: list[int] = []
    made = 0

    def put(residual: int, first: int, n: int) -> None:
        if n and residual:
            if not open_runs[residual]:
                bisect.insort(residuals, residual)
            open_runs[residual].append((first, n))

    def take(residual: int, first: int, n: int, length: int, rank: int, left: int) -> int:
        """Fill ``n`` sequences from ``first`` with up to ``left`` items; the number placed."""
        each = residual // length
        full = min(n, left // each)
        if full:
            slots.append((length, rank, full * each, first, each, capacity - residual))
            put(residual - each * length, first, full)
        placed = full * each
        rest = left - placed
        if full < n:
            if rest:
                slots.append((length, rank + placed, rest, first + full, rest, capacity - residual))
                put(residual - rest * length, first + full, 1)
                put(residual, first + full + 1, n - full - 1)
                placed += rest
            else:
                put(residual, first + full, n - full)
        return placed

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect.bisect_left(residuals, length)
            if k < len(residuals):
                residual = residuals[k]
                first, n = open_runs[residual].pop()
                if not open_runs[residual]:
                    residuals.pop(k)
            else:
                residual, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            placed = take(residual, first, n, length, rank, left)
            rank, left = rank + placed, left - placed
    return slots, made


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every row of ``pieces`` (with a ``length`` of 1 to ``capacity``) a sequence and an offset.

    Adds sequence_id and offset. ``pieces`` must be a stored table (read
    twice). Rank within a length comes from counts per (length, bucket of the
    document), so a length that holds a third of all rows is never one task.
    Equal rows may swap slots; either choice packs the same.
    """
    spark = pieces.sparkSession
    n = max(1, pieces.count())
    buckets = max(1, n // 100_000)
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    slots, _ = plan_counts(histogram, capacity)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("length", "_bucket", "_first")
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("_row", F.row_number().over(within) - 1).join(firsts, ["length", "_bucket"]).withColumn("_rank", F.col("_first") + F.col("_row"))
    columns = [pa.array([s[k] for s in slots], pa.int64()) for k in range(6)]
    plan = spark.createDataFrame(pa.table(dict(zip(("length", "_from", "_count", "_sequence", "_each", "_offset"), columns, strict=True))))
    plan = plan.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / RANK_BLOCK), F.floor((F.col("_from") + F.col("_count") - 1) / RANK_BLOCK))))
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / RANK_BLOCK))
    placed = ranked.join(plan, ["length", "_block"]).where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_count")))
    item = F.col("_rank") - F.col("_from")
    return placed.select(
        *[F.col(c) for c in pieces.columns],
        (F.col("_sequence") + F.floor(item / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (item % F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, model_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Encode and pack all rows of ``docs`` (doc_id, text).

    A null or empty text is its end id alone; a null doc_id stays null;
    repeated rows are packed as often as they occur; an empty table gives no
    rows; other columns are not read. Only documents over the capacity are
    cut, and nothing is dropped.
    """
    return pack(materialise(encode_pieces(docs, model_file, capacity), "pieces"), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
