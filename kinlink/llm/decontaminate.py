"""Benchmark decontamination by latent semantic retrieval.

Documents become sequences of benchmark-vocabulary ids. A distributed
randomised SVD of the TF-IDF rows of all passages of all documents gives a
latent space; every item-sized window of every document is searched there for
items by cosine. As a rank that a corpus can afford doesn't tell all copies
from the background, windows that hold enough of an item's heaviest terms (a
prefix filter that loses nothing the final check would accept) are candidates
too. All candidates are checked by longest common subsequence with the item
and by its answer, so paraphrases with replaced or inserted words are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import Lexicon, gather, load, materialise, named, parts, split_words

WORD = re.compile(r"\w+")
#: Items of one round over the corpus: what is broadcast is their vocabulary (some 300,000 words) and latent vectors.
GROUP = 5000
TERM_BLOCK = 512
BLOCK, PASSAGE = 16, 64
#: Words cut into blocks at once, words whose latent rows are summed at once (a few MB, so they stay in a core's cache), and cells of the table that holds items' term weights.
CHUNK, CACHED, CELLS = 100_000, 8192, 1 << 24


@dataclass(frozen=True)
class Settings:
    """A passage leaks an item if the aligned words hold ``sure`` of its idf
    mass, or ``likely`` of it and ``answer`` of its last sentence's."""

    likely: float = 0.5
    sure: float = 0.6
    answer: float = 0.6
    share: float = 0.7
    rank: int = 48
    oversample: int = 16
    cosine: float = 0.5  #: of a window and an item, from which they are candidates
    seed: int = 11


@dataclass(frozen=True)
class Items:
    """Benchmark items as ids from 1; 0 is any word outside the vocabulary."""

    item_id: list[int]
    ids: list[np.ndarray]
    answers: list[int]  #: place where the last sentence starts
    vocabulary: dict[str, int]


def read_items(rows: list[tuple[int, str | None]]) -> Items:
    """Items with at least one word; the last sentence follows the last full stop, line or mark but the final one."""
    vocabulary: dict[str, int] = {}
    item_id, ids, answers = [], [], []
    for i, text in rows:
        words = WORD.findall((text or "").lower())
        if not words:
            continue
        sentences = [s for s in re.split(r"[.!?\n]+", text.lower()) if WORD.search(s)]
        last = len(WORD.findall(sentences[-1]))
        item_id.append(i)
        ids.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64))
        answers.append(len(words) - last)
    return Items(item_id, ids, answers, vocabulary)


def align(a: list[int], masks: dict[int, int], n: int) -> list[int]:
    """Places in ``a`` of a longest common subsequence with the sequence that ``masks`` describes."""
    full = (1 << n) - 1
    row, rows = full, []
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    found, j = [], n
    zeros = lambda r, m: m - (r & ((1 << m) - 1)).bit_count()
    for i in range(len(a) - 1, -1, -1):
        now = zeros(rows[i], j)
        if not now:
            break
        if now > zeros(rows[i - 1] if i else full, j):
            found.append(i)
            while zeros(rows[i], j - 1) == now:
                j -= 1
            j -= 1
    return found[::-1]


class Encoder:
    """Vocabulary ids of texts' words; those of a token between white space are kept in flat arrays of at most ``room`` bytes."""

    def __init__(self, vocabulary: dict[str, int], room: int = 16 << 20):
        self.vocabulary, self.room = vocabulary, room
        self.forget()

    def forget(self) -> None:
        self.lexicon, self.ids, self.length = Lexicon(), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        found, count = split_words(texts)
        if self.lexicon.words.nbytes + self.ids.nbytes + self.length.nbytes > self.room:
            self.forget()
        where, new = self.lexicon.places(found.dictionary)
        if len(new):
            get = self.vocabulary.get
            split = [[get(w, 0) for w in WORD.findall(t)] for t in new.to_pylist()]
            self.ids = np.concatenate((self.ids, np.fromiter((i for x in split for i in x), "<u4")))
            self.length = np.concatenate((self.length, np.fromiter(map(len, split), np.int64, len(split))))
        flat, n = gather(self.ids, self.length, where[found.indices.to_numpy()])
        return flat, np.diff(np.concatenate(([0], np.cumsum(n)))[np.cumsum(count)], prepend=0)


def encode(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, ids (little-endian uint32 of every word of the whole text)."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for part in parts(batches, "text", 4 << 20):
            flat, n = encoder(part.column(1))
            ends = pa.array(np.concatenate(([0], np.cumsum(4 * n))), pa.int32()).buffers()[1]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(flat)])], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


@dataclass(frozen=True)
class Prefixes:
    """For each term the items whose prefix holds it: the heaviest terms with
    ``share`` of an item's idf mass. A passage that aligns with ``likely`` of the
    mass holds ``share + likely - 1`` of it in prefix terms."""

    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    block: np.ndarray  #: a quarter of each item's length
    length: np.ndarray
    bound: np.ndarray


def prefixes(items: Items, idf: np.ndarray, s: Settings) -> Prefixes:
    terms, owners, bound = [], [], []
    for k, ids in enumerate(items.ids):
        own, n = np.unique(ids, return_counts=True)
        order = np.argsort(-idf[own], kind="stable")
        mass = np.cumsum((idf[own] * n)[order])
        some = own[order[: int(np.searchsorted(mass, s.share * mass[-1] - 1e-9)) + 1]]
        terms.append(some)
        owners.append(np.full(len(some), k))
        bound.append(mass[len(some) - 1] - (1 - s.likely) * mass[-1])
    term, owner = np.concatenate(terms), np.concatenate(owners)
    order = np.argsort(term, kind="stable")
    count = np.bincount(term, minlength=len(idf))
    length = np.array([len(x) for x in items.ids])
    return Prefixes(np.cumsum(count) - count, count, owner[order], np.maximum(1, -(-length // 4)), length, np.array(bound))


def screen(encoded: DataFrame, items: Items, idf: np.ndarray, s: Settings) -> DataFrame:
    """Passages that could leak an item: doc_id, item (its place), ids.

    Occurrences of prefix terms are summed per document, item and block of a
    quarter of the item; a window of six blocks from a block that holds one
    covers every prefix term of a span of up to 1.25 item lengths. Windows
    under the item's bound can't pass the final check; the others become
    passages, with the item's length of words before them.
    """
    shared = encoded.sparkSession.sparkContext.broadcast((idf, prefixes(items, idf, s)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, pre = shared.value
        for part in parts(batches, "ids", 8 << 20):
            raw = part.column(1).to_pylist()
            length = np.array([len(r) // 4 for r in raw], np.int64)
            ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
            base = np.cumsum(length) - length
            at = np.flatnonzero(pre.count[ids])
            if not len(at):
                continue
            n = pre.count[ids[at]]
            ends = np.cumsum(n)
            item = pre.item[np.arange(ends[-1]) + np.repeat(pre.first[ids[at]] - (ends - n), n)]
            doc = np.searchsorted(base, at, side="right") - 1
            doc, place, weight = np.repeat(doc, n), np.repeat(at - base[doc], n), np.repeat(weights[ids[at]], n)
            blocks = int(length.max()) + 8
            key, where = np.unique((doc * len(pre.bound) + item) * blocks + place // pre.block[item], return_inverse=True)
            mass = np.concatenate(([0.0], np.cumsum(np.bincount(where, weight))))
            inside = mass[np.searchsorted(key, key + 6)] - mass[:-1]
            owner = key // blocks % len(pre.bound)
            rows = []
            for h in np.flatnonzero(inside >= pre.bound[owner] - 1e-6).tolist():
                k, d = int(owner[h]), int(key[h]) // blocks // len(pre.bound)
                start = (int(key[h]) % blocks) * int(pre.block[k])
                stop = min(start + 6 * int(pre.block[k]), int(length[d]))
                start = max(0, start - int(pre.length[k]))
                rows.append((part.column(0)[d].as_py(), k, raw[d][4 * start : 4 * stop]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "item", "ids"])

    return encoded.mapInArrow(run, "doc_id long, item int, ids binary")


def chunks(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some 100,000 words at a time: their ids and the row of each; a longer row comes alone."""
    held: list[int] = []
    size = 0
    for k, r in enumerate([*raw, None]):
        if held and (r is None or size + len(r) > 4 * CHUNK):
            yield np.frombuffer(b"".join(raw[i] for i in held), "<u4").astype(np.int64), np.repeat(held, [len(raw[i]) // 4 for i in held])
            held, size = [], 0
        if r:
            held.append(k)
            size += len(r)


def places(row: np.ndarray) -> np.ndarray:
    """Place of each word in its row, the rows' words standing together."""
    new = np.flatnonzero(np.diff(row, prepend=-1))
    return np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))


def _sums(ids: np.ndarray, group: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of ``table``'s rows over the words of each group; groups are numbered in order, some may be empty."""
    out = np.zeros((int(group[-1]) + 1 if len(group) else 0, table.shape[1]), table.dtype)
    known = np.flatnonzero(ids)
    for at in range(0, len(known), CACHED):
        some = known[at : at + CACHED]
        first = np.flatnonzero(np.diff(group[some], prepend=-1))
        out[group[some[first]]] += np.add.reduceat(table[ids[some]], first, axis=0)
    return out


def blocks_of(ids: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks of BLOCK words start, and each block's distinct ids (zeros for the rest)."""
    first = place % BLOCK == 0
    padded = np.zeros((int(first.sum()), BLOCK), np.int32)
    padded[np.cumsum(first) - 1, place % BLOCK] = ids
    padded.sort(axis=1)
    padded[:, 1:][padded[:, 1:] == padded[:, :-1]] = 0
    return np.flatnonzero(first), padded


def gram_product(encoded: DataFrame, right: np.ndarray) -> np.ndarray:
    """A'A times ``right`` for the term counts A of all passages of all documents, and beside
    it the blocks that hold each term (all blocks, for id 0); as many rows as terms reach the driver."""
    shared = encoded.sparkSession.sparkContext.broadcast(right.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        total = np.zeros((len(table), table.shape[1] + 1))
        for b in batches:
            for ids, row in chunks(b.column(0).to_pylist()):
                place = places(row)
                first, padded = blocks_of(ids, row, place)
                held = np.bincount(padded.ravel(), minlength=len(table))
                held[0] = len(first)
                total[:, -1] += held
                passage = np.cumsum((place % PASSAGE == 0)) - 1
                product = _sums(ids, passage, table)
                known = np.flatnonzero(ids)
                for at in range(0, len(known), CACHED):
                    some = known[at : at + CACHED]
                    some = some[np.argsort(ids[some], kind="stable")]
                    begin = np.flatnonzero(np.diff(ids[some], prepend=-1))
                    total[ids[some[begin]], :-1] += np.add.reduceat(product[passage[some]], begin, axis=0)
        parts = range(0, len(total), TERM_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([k // TERM_BLOCK for k in parts], pa.int32()), pa.array([total[k : k + TERM_BLOCK].tobytes() for k in parts], pa.binary())], names=["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        some = sum(np.frombuffer(x.as_py(), np.float64) for x in table["part"])
        return pa.table({"block": table["block"][:1], "part": pa.array([np.ascontiguousarray(some).tobytes()], pa.binary())})

    summed = encoded.select("ids").mapInArrow(run, "block int, part binary").groupBy("block").applyInArrow(add, "block int, part binary").toArrow().sort_by("block")
    return np.concatenate([np.zeros(0), *(np.frombuffer(x, np.float64) for x in summed["part"].to_pylist())]).reshape(-1, right.shape[1] + 1)


def latent_space(encoded: DataFrame, terms: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Idf of each id over blocks of all documents (0 for id 0), and the leading right singular
    vectors (terms x rank) of the TF-IDF rows A of all passages.

    One pass over the corpus: A'A is recovered from its product with random
    columns by Nystrom's approximation, shifted a little for stability.
    """
    width = min(terms + 1, s.rank + s.oversample)
    columns, _ = np.linalg.qr(np.random.default_rng(s.seed).normal(size=(terms + 1, width)))
    got = gram_product(encoded, columns)
    if not len(got) or not got[0, -1]:  # no document, or none with a word
        return np.concatenate(([0.0], np.ones(terms))), np.zeros((terms + 1, 1))
    idf = np.log((got[0, -1] + 1) / (got[:, -1] + 1)) + 1
    idf[0] = 0
    test = columns / np.where(idf > 0, idf, np.inf)[:, None]
    y = idf[:, None] * got[:, :-1]
    y += (1e-6 * np.linalg.norm(y) + 1e-12) * test
    core = test.T @ y
    core = np.linalg.cholesky((core + core.T) / 2 + 1e-12 * np.trace(core) * np.eye(width))
    u, value, _ = np.linalg.svd(np.linalg.solve(core, y.T).T, full_matrices=False)
    return idf, u[:, np.argsort(-value)[: s.rank]]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def latent_items(items: Items, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return unit(np.stack([(basis[ids] * idf[ids][:, None]).sum(0) for ids in items.ids]))


def search(encoded: DataFrame, items: Items, idf: np.ndarray, basis: np.ndarray, s: Settings) -> DataFrame:
    """doc_id, item (its place), ids of the windows that meet an item in the latent space.

    Every document is cut into blocks of 16 words with a latent vector each.
    A window, from every block on, is as many blocks as hold the item
    wherever it starts; it is a candidate from ``s.cosine`` on, if the words
    of so many blocks could hold ``s.likely`` of the item's idf mass at all. Candidates of an
    item that overlap are one row, with half the item's length around it.
    """
    shared = encoded.sparkSession.sparkContext.broadcast((items.ids, idf, (idf[:, None] * basis).astype(np.float32), latent_items(items, idf, basis).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, weights, table, latent = shared.value
        length = np.array([len(x) for x in item_ids])
        blocks = -(-length // BLOCK) + 1
        step = max(1, CELLS // len(weights))
        ones, tables = np.ones(BLOCK, np.float32), []  # items of as many blocks each, and the weight of every term in them
        for w in np.unique(blocks).tolist():
            own = np.flatnonzero(blocks == w)
            for at in range(0, len(own), step):
                some = own[at : at + step]
                cells = np.zeros((len(some), len(weights)), np.float32)
                for k, i in enumerate(some.tolist()):
                    cells[k] = np.bincount(item_ids[i], weights[item_ids[i]], len(weights))
                tables.append((w, some, cells, (s.likely * cells.sum(1) - 1e-3).astype(np.float32)))
        for b in batches:
            raw = b.column(1).to_pylist()
            out: list[tuple] = []
            for ids, row in chunks(raw):
                place = places(row)
                first, padded = blocks_of(ids, row, place)
                owner, of_row = row[first], place[first] // BLOCK
                vectors = _sums(ids, np.cumsum(place % BLOCK == 0) - 1, table)
                total = np.concatenate((np.zeros((1, vectors.shape[1])), np.cumsum(vectors, 0, dtype=np.float64)))
                last = np.searchsorted(owner, owner, side="right")  # blocks of a row end here
                for w, some, cells, bound in tables:
                    stop = np.minimum(np.arange(len(first)) + w, last)
                    windows = unit(total[stop] - total[:-1]).astype(np.float32)
                    for at in range(0, len(windows), 4096):
                        near = np.flatnonzero(windows[at : at + 4096] @ latent[some].T >= s.cosine).astype(np.int32)
                        n = len(some)
                        asked = np.zeros((min(4096, len(windows) - at) + w - 1) * n, bool)  # blocks of those windows, each weighed once
                        for j in range(w):
                            asked[near + j * n] = True
                        asked[(len(first) - at) * n :] = False
                        pairs = np.flatnonzero(asked).astype(np.int32)
                        mass = np.zeros(len(asked), np.float32)
                        for lo in range(0, len(pairs), CACHED):
                            x = pairs[lo : lo + CACHED]
                            y = x // n
                            mass[x] = cells.take(((x - y * n) * len(weights))[:, None] + padded[at + y]) @ ones
                        near = near[sum(mass[near + j * n] for j in range(w)) >= bound[near % n]]
                        start, item = near // n + at, some[near % n]
                        order = np.lexsort((start, item, owner[start]))
                        start, item = start[order], item[order]
                        apart = np.ones(len(start), bool)
                        apart[1:] = (owner[start[1:]] != owner[start[:-1]]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + w)
                        ends = np.append(np.flatnonzero(apart)[1:], len(start)) - 1 if len(start) else []
                        for p, q in zip(np.flatnonzero(apart).tolist(), list(ends), strict=True):
                            d, n = int(owner[start[p]]), int(length[item[p]])
                            lo, hi = int(of_row[start[p]]) * BLOCK - n // 2, int(of_row[stop[start[q]] - 1] + 1) * BLOCK + n // 2
                            out.append((b.column(0)[d].as_py(), int(item[p]), raw[d][4 * max(0, lo) : 4 * hi]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "item", "ids"])

    return encoded.mapInArrow(run, "doc_id long, item int, ids binary")


def verify(passages: DataFrame, items: Items, idf: np.ndarray, basis: np.ndarray, s: Settings) -> DataFrame:
    """doc_id, item_id, cosine, matched, answer of passages that leak an item."""
    latent = latent_items(items, idf, basis)
    shared = passages.sparkSession.sparkContext.broadcast((items.item_id, items.ids, items.answers, idf, basis, latent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_id, item_ids, answers, weights, v, lat = shared.value
        table = (weights[:, None] * v).astype(np.float32)
        sequences = [ids.tolist() for ids in item_ids]
        heavy = [float(weights[ids].sum()) for ids in item_ids]
        closing = [float(weights[ids[a:]].sum()) for ids, a in zip(item_ids, answers, strict=True)]
        for b in batches:
            out: list[tuple] = []
            for at in range(0, b.num_rows, 1000):
                own = b.column(1).slice(at, 1000).to_numpy()
                rows = b.column(2).slice(at, 1000).to_pylist()
                size = np.array([len(r) // 4 for r in rows])
                product = np.zeros((len(rows), v.shape[1]))
                some = _sums(np.frombuffer(b"".join(rows), "<u4").astype(np.int64), np.repeat(np.arange(len(rows)), size), table)
                product[: len(some)] = some
                cosine = (unit(product) * lat[own]).sum(1)
                for p in range(len(rows)):
                    k, masks = int(own[p]), {}
                    ids = np.frombuffer(rows[p], "<u4").tolist()
                    for j, x in enumerate(ids):
                        if x:
                            masks[x] = masks.get(x, 0) | 1 << j
                    if sum(weights[x] for x in sequences[k] if x in masks) < s.likely * heavy[k]:
                        continue
                    places = align(sequences[k], masks, len(ids))
                    matched = float(sum(weights[sequences[k][i]] for i in places)) / heavy[k]
                    answered = float(sum(weights[sequences[k][i]] for i in places if i >= answers[k])) / closing[k]
                    if matched >= s.sure or (matched >= s.likely and answered >= s.answer):
                        out.append((b.column(0)[at + p].as_py(), item_id[k], float(cosine[p]), matched, answered))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *(pa.float64(),) * 3), strict=True)], names=["doc_id", "item_id", "cosine", "matched", "answer"])

    return passages.mapInArrow(run, "doc_id long, item_id long, cosine double, matched double, answer double")


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per (document, item) that it leaks: doc_id, item_id, cosine, matched, answer.

    Null or empty texts and items leak nothing; texts of any length are read
    whole; repeated rows of a doc_id are one document here; rows without an id
    count under a null id; other columns are not read; empty tables give no
    rows. The benchmark is worked through in groups of GROUP items, each a
    pass over the corpus.
    """
    spark = docs.sparkSession
    groups = max(1, -(-benchmark.count() // GROUP))
    found = None
    for g in range(groups):
        some = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).select("item_id", "text").toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        items = read_items(list(zip(some["item_id"].to_pylist(), some["text"].to_pylist(), strict=True)))
        if not items.item_id:
            continue
        encoded = materialise(encode(docs, items), "ids")
        idf, basis = latent_space(encoded, len(items.vocabulary), s)
        passages = materialise(screen(encoded, items, idf, s).unionAll(search(encoded, items, idf, basis, s)), "passages")
        part = verify(passages, items, idf, basis, s)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], "doc_id long, item_id long, cosine double, matched double, answer double")
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("matched").alias("matched"), F.max("answer").alias("answer"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns, whatever those are called.

    An id goes where any of its rows leaks an item; rows without an id stay.
    """
    gone = materialise(leaks(docs, benchmark, s).select("doc_id").distinct(), "leaks")
    return docs.join(gone, "doc_id", "left_anti").select(*named(docs.columns))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
