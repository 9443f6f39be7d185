"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents of equal shingle sets are one node. Each node has a label (a row of
MinHash values) in every tree of the forest, and a tree is the sorted list of
its labels: two nodes share a prefix of the trie exactly as far as the least
of the matches between neighbours in the list from one to the other. Matched
prefixes start at a label's full length and are shortened until the recall of
a pair at the threshold reaches the target; neighbours in the list that match
that far become edges. Their components hold every pair that can be linked;
within a component, all pairs are verified exactly on shingle sets in blocks,
so a group of thousands of near copies spreads over tasks, and links are
counted where they are found, never listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink.llm.common import Lexicon, gather, hash64, load, materialise, named, parts, split_words
from kinlink.llm.components import components

WORD = re.compile(r"\w+")
#: Shingles that are hashed at once.
CACHED = 1 << 17


@dataclass(frozen=True)
class Settings:
    """Shingles of ``words`` words; links from a Jaccard similarity of ``threshold`` (in thousandths)."""

    words: int = 5
    threshold: int = 800
    trees: int = 24
    deepest: int = 6
    recall: float = 0.99999
    block_rows: int = 256
    block_shingles: int = 400_000
    seed: int = 5

    def depth(self) -> int:
        """Length of a matched prefix: shortened from the whole label until the forest's recall at the threshold reaches the target."""
        t = self.threshold / 1000
        for depth in range(self.deepest, 1, -1):
            if 1 - (1 - t**depth) ** self.trees >= self.recall:
                return depth
        return 1


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts.

    Words are runs of word characters in lower case. Fewer words than a
    shingle make one shingle; a text without words is one shingle of its own
    characters, so equal texts still meet. Hashes of the words between white
    space are kept in flat arrays of at most ``room`` bytes.
    """

    def __init__(self, words: int, room: int = 16 << 20):
        self.n, self.room = words, room
        self.forget()

    def forget(self) -> None:
        self.lexicon, self.hashes, self.length = Lexicon(), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def learn(self, tokens: list[str]) -> None:
        split = list(map(WORD.findall, tokens))
        made = {w: hash64(w) for w in {w for ws in split for w in ws}}
        flat = np.fromiter((made[w] for ws in split for w in ws), np.uint64)
        self.hashes = np.concatenate((self.hashes, flat))
        self.length = np.concatenate((self.length, np.fromiter(map(len, split), np.int64, len(split))))

    def _roll(self, h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of ``n`` words."""
        s = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
            s ^= s >> np.uint64(29)
        return s * np.uint64(0xBF58476D1CE4E5B9)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        found, count = split_words(texts)
        if self.lexicon.words.nbytes + self.hashes.nbytes + self.length.nbytes > self.room:
            self.forget()
        where, new = self.lexicon.places(found.dictionary)
        if len(new):
            self.learn(new.to_pylist())
        h, n = gather(self.hashes, self.length, where[found.indices.to_numpy()])
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum(count)].tolist()
        long = self._roll(h, self.n) if len(h) >= self.n else h
        sets, begin = [], 0
        for k, end in enumerate(ends):
            if end - begin >= self.n:
                sets.append(np.unique(long[begin : end - self.n + 1]))
            elif end > begin:
                sets.append(self._roll(h[begin:end], end - begin))
            else:
                sets.append(np.array([hash64("\0" + (texts[k].as_py() or ""))], np.uint64))
            begin = end
        return sets


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, _text (hash of the text), _set (hash of the shingle set), _n (shingles), and the label in each tree: _front (the values that are matched), _back (the rest)."""
    depth = s.depth()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(s.words)
        rng = np.random.default_rng(s.seed)
        hashes = s.trees * s.deepest
        times = rng.integers(0, 2**31, hashes).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        plus = rng.integers(0, 2**32, hashes, dtype=np.uint64).astype(np.uint32)

        def sign(part: pa.RecordBatch, sets: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
            flat = np.concatenate(sets)
            starts = np.cumsum(n) - n
            x = (flat >> np.uint64(32)).astype(np.uint32)  # well mixed already, so a linear step a hash will do
            y, low = np.empty_like(x), np.empty((hashes, len(sets)), np.uint32)
            for k in range(hashes):
                np.multiply(x, times[k], out=y)
                y += plus[k]
                np.minimum.reduceat(y, starts, out=low[k])
            labels = (low * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint64).reshape(s.deepest, s.trees, len(sets))  # 16 mixed bits of a least value tell it apart
            front, back = (np.zeros((len(sets), s.trees), np.uint64) for _ in range(2))
            for d in range(s.deepest):
                to = front if d < depth else back
                to *= np.uint64(65536 if d < 4 or d >= depth else 0x9E3779B97F4A7C15)  # up to four values stand side by side, more are mixed
                to += labels[d].T
            whole = np.add.reduceat(flat * np.uint64(0x94D049BB133111EB) ^ (flat >> np.uint64(31)), starts)
            mixed = np.bitwise_xor.reduceat(flat * np.uint64(0xD6E8FEB86659FD93), starts)
            names = [f"{a:x}-{b:x}-{c}" for a, b, c in zip(whole.tolist(), mixed.tolist(), n.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names), pa.array(n, pa.int32()), *(pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), s.trees).cast(pa.list_(pa.int64())) for x in (front, back))], names=["doc_id", "_text", "_set", "_n", "_front", "_back"])

        for part in parts(batches, "text", 8 << 20):
            sets = shingle(part.column(2))
            n = np.array([len(x) for x in sets])
            group = np.cumsum(n) // CACHED  # some sets at a time, so that their hashes stay in a core's cache
            for lo, hi in zip(first := np.flatnonzero(np.diff(group, prepend=-1)).tolist(), [*first[1:], len(sets)], strict=True):
                yield sign(part.slice(lo, hi - lo), sets[lo:hi], n[lo:hi])

    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), "text")
    return texts.mapInArrow(run, "doc_id long, _text long, _set string, _n int, _front array<long>, _back array<long>")


def forest_edges(nodes: DataFrame, s: Settings) -> DataFrame:
    """a, b: neighbours in a tree's sorted labels that match in the first ``s.depth()`` values.

    All trees are sorted in one go by ranges of (label, tree, node), so a
    group of equal labels, however large, spreads over tasks. Each range is
    walked once; its first and last row meet those of the next ranges in one
    window of two rows a range.
    """
    # A set this small can't reach the threshold with any other set, not even with one shingle more.
    able = nodes.where(F.col("_n") * 1000 >= s.threshold * (F.col("_n") + 1))
    rows = able.select("node", "_back", F.posexplode("_front").alias("tree", "front")).select("node", "tree", "front", F.get("_back", "tree").alias("back"))
    keys, names = ["front", "tree", "back", "node"], ["a", "b", "part", "side", "tree", "front"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        end = lambda last, side: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((last[0][-1], None, part, side, last[1][-1], last[2][-1]), kinds, strict=True)], names=names)
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy() for k in range(3)]
            if last is None:
                yield end([x[:1] for x in now], 0)
            else:
                now = [np.concatenate((x[-1:], y)) for x, y in zip(last, now, strict=True)]
            node, tree, front = now
            met = np.flatnonzero((tree[1:] == tree[:-1]) & (front[1:] == front[:-1]))
            if len(met):
                yield pa.RecordBatch.from_arrays([pa.array(node[met + 1]), pa.array(node[met]), *(pa.nulls(len(met), t) for t in kinds[2:])], names=names)
            last = now
        if last is not None:
            yield end(last, 1)

    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    walked = materialise(ordered.select("node", "tree", "front").mapInArrow(walk, "a long, b long, part int, side int, tree int, front long"), "forest")
    ends = Window.orderBy("part", "side")
    met = walked.where("side IS NOT NULL").withColumns({f"_{c}": F.lag(c).over(ends) for c in ("a", "tree", "front")})
    met = met.where("side = 0 AND tree = _tree AND front = _front").select("a", F.col("_a").alias("b"))
    return walked.where("side IS NULL").select("a", "b").unionAll(met)


def _linked(sets: list[np.ndarray], threshold: int, split: int | None) -> np.ndarray:
    """Matrix of linked pairs; with ``split``, only of the first ``split`` against the rest."""
    n = np.array([len(x) for x in sets])
    term, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    shared = count > 1
    place = np.cumsum(shared) - 1
    some = shared[where]
    owner, where, width = owner[some], place[where[some]], int(shared.sum())
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    both = np.zeros((len(sets), len(sets)) if split is None else (split, len(sets) - split), np.float32)
    step = max(256, (8 << 20) // len(sets))
    for at in range(0, width, step):
        lo, hi = np.searchsorted(where, (at, at + step))
        m = np.zeros((len(sets), min(step, width - at)), np.float32)
        m[owner[lo:hi], where[lo:hi] - at] = 1
        both += m @ m.T if split is None else m[:split] @ m[split:].T
    both = both.astype(np.int64)
    either = (n[:, None] + n[None, :] if split is None else n[:split, None] + n[None, split:]) - both
    linked = both * 1000 >= threshold * either
    if split is None:
        np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least place of each place's component."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(root)).min(1, initial=len(root))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(members: DataFrame, s: Settings) -> DataFrame:
    """node, root, links of each block pair.

    ``members``: node, root, copies, _n and text of every node of a candidate
    component. A component is cut into blocks of bounded rows and shingles; a
    group of this step is a pair of blocks.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_n").alias("_all"))
    blocks = F.greatest(F.ceil(F.col("_rows") / s.block_rows), F.ceil(F.col("_all") / s.block_shingles)).cast("int")
    sizes = sizes.select("root", blocks.alias("_blocks"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(s.words)
        for part in parts(batches, "text", 4 << 20):
            sets = shingle(part.column(4))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "root", "copies", "_blocks", "_shingles"])

    rows = members.join(sizes, "root").select("node", "root", "copies", "_blocks", "text").mapInArrow(shingled, "node long, root long, copies long, _blocks int, _shingles binary")
    own = rows.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    paired = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("node", "root", "copies", "_blocks", "_own", "_shingles", F.least("_own", "_other").alias("_p"), F.greatest("_own", "_other").alias("_q"))

    def check(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_own", "ascending"), ("node", "ascending")])
        node, copies, side = (table[c].to_numpy() for c in ("node", "copies", "_own"))
        sets = [np.frombuffer(x, np.uint64) for x in table["_shingles"].to_pylist()]
        p, q = table["_p"][0].as_py(), table["_q"][0].as_py()
        whole = table["_blocks"][0].as_py() == 1
        split = None if p == q else int((side == p).sum())
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        if len(node) > 1 and split != 0 and split != len(node):
            linked = _linked(sets, s.threshold, split)
            if split is None:
                links, square = linked @ copies, linked
            else:
                links = np.concatenate((linked @ copies[split:], linked.T @ copies[:split]))
                square = np.zeros((len(node), len(node)), bool)
                square[:split, split:], square[split:, :split] = linked, linked.T
            root = _roots(square)
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, root, node)
        some = links > 0
        return pa.table({"node": pa.array(node[some], pa.int64()), "low": pa.array(least[root][some], pa.int64()), "links": pa.array(links[some], pa.int64()), "single": pa.array([whole] * int(some.sum()), pa.bool_())})

    return paired.groupBy("root", "_p", "_q").applyInArrow(check, "node long, low long, links long, single boolean")


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), n_links.

    A class is a component of the links; n_links counts the other documents
    linked to this one, copies included. Null texts are empty texts, and texts
    without words are linked only to equal ones; texts of any length are read
    whole; rows with a null doc_id are left out, as nothing could name them;
    rows that repeat a doc_id count as copies, or as further texts of it, each
    with a row, a class and links of its own; extra columns are not read; an
    empty table gives no rows.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    signed = materialise(signatures(known, s), "signatures")
    # One node a set, numbered in the stored table; one of its rows lends its text to the verification.
    nodes = signed.groupBy("_set").agg(F.min(F.struct("doc_id", "_text")).alias("_one"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("_front", "_back", "_n")))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "sets")
    roots = materialise(components(forest_edges(nodes, s), "candidates"), "roots")
    wanted = roots.join(nodes.select("node", "copies", "_n", "_one"), "node").select("node", "root", "copies", "_n", "_one.doc_id", "_one._text")
    texts = known.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), "text")
    members = texts.join(wanted, ["doc_id", "_text"]).dropDuplicates(["node"])
    checked = materialise(verify(members, s), "links")
    merged = components(checked.where("NOT single AND low < node").select(F.col("node").alias("a"), F.col("low").alias("b")), "classes").withColumnRenamed("root", "_root")
    found = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("low").alias("low")).join(merged, "node", "left").select("node", "links", F.coalesce("_root", "low").alias("root"))
    of_node = nodes.join(found, "node", "left").select("_set", F.col("_one.doc_id").alias("least"), F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of_node = materialise(of_node, "nodes")
    least = of_node.groupBy("root").agg(F.min("least").alias("class_id"))
    return signed.select("doc_id", "_set").join(of_node.join(least, "root").select("_set", "class_id", "n_links"), "_set").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all their columns, whatever those are called.

    An id goes where a row of it is in a class of a lesser id: of the texts
    that share an id all go or stay. Rows that repeat a kept id stay as they
    are; rows without an id stay; an empty table gives no rows.
    """
    gone = materialise(classes(docs, s).where("doc_id <> class_id").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*named(docs.columns))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(load(spark, sf_dir, "documents"))
