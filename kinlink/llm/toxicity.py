"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams, a
window's vector the mean over its words (padded to a fixed width, so short
texts aren't blown up), and a linear softmax reads it. Vectors and softmax are
trained jointly in numpy on a bounded sample of labelled rows. A text's score
is that of its worst window, so a few words in a long text still count; unseen
misspellings share n-gram vectors with the words they come from. As the model
is linear in the n-grams, scoring needs one number per n-gram bucket: a
broadcast of fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import Lexicon, fresh, gather, load, named, parts, split_words, with_number

EDGES = "\"'`.,;:!?()[]{}<>|/\\+=~^-_*#$%&@«»“”„…"


@dataclass(frozen=True)
class Settings:
    """``sample`` labelled rows of each label are learned from at most, each with all its text."""

    sample: int = 3000
    width: int = 32
    buckets: int = 1 << 17
    dim: int = 8
    shortest: int = 3
    longest: int = 5
    noisy_epochs: int = 2
    picked_epochs: int = 3
    rate: float = 0.5
    steps: int = 1000
    threshold: float = 0.3
    seed: int = 7


@dataclass
class Model:
    weights: np.ndarray  #: of each n-gram bucket, towards toxic
    bias: float
    scale: float  #: of the worst window's margin, in the calibrated logit
    shift: float
    settings: Settings


def n_grams(words: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words in a row, and how many each has: a word's edge marks go,
    its borders are marked, and it counts as a whole and by its character n-grams."""
    bare = pc.utf8_trim(words, characters=EDGES)
    marked = pc.binary_join_element_wise("<", pc.if_else(pc.equal(bare, ""), words, bare), ">", "")
    length = pc.utf8_length(marked).to_numpy().astype(np.int64)
    codes = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(length)
    left = np.repeat(ends, length) - np.arange(len(codes))  # characters from here to the word's end
    prime, found, owners = np.uint32(0x01000193), [], []
    powers = np.cumprod(np.full(int(length.max(initial=1)), 0x9E3779B1, np.uint32), dtype=np.uint32)
    if len(codes):
        found.append(np.add.reduceat((codes + np.uint32(7)) * powers[np.repeat(length, length) - left], ends - length, dtype=np.uint32))
        owners.append(np.arange(len(length)))
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, s.longest + 1):
        h[: len(codes) - n + 1] = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * prime
        if n >= s.shortest:
            at = np.flatnonzero(left >= n)
            found.append(h[at] + np.uint32(n))
            owners.append(np.repeat(np.arange(len(length)), np.maximum(length - n + 1, 0)))
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    mixed = np.concatenate(found) if found else np.zeros(0, np.uint32)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(13)
    order = np.argsort(owner, kind="stable")
    return (mixed[order] % np.uint32(s.buckets)).astype(np.int64), np.bincount(owner, minlength=len(length))


def sequences(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the places in them of all texts' words in a row, and how many each text has.

    A run of one word counts once, else a word repeated for pages would be a window of its own.
    """
    found, count = split_words(texts)
    at, owner = found.indices.to_numpy(), np.repeat(np.arange(len(count)), count)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    if (blank := pc.index(found.dictionary, "").as_py()) >= 0:
        new &= at != blank
    return found.dictionary, at[new].astype(np.int64), np.bincount(owner[new], minlength=len(count))


def train_windows(windows: pa.Array, labels: np.ndarray, owners: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Joint training; returns the weight of each bucket and the bias.

    First all windows carry their document's label; then only the two worst
    windows of a toxic document do, as its others may be clean.
    """
    rng = np.random.default_rng(s.seed)
    words, tok, length = sequences(windows)
    flat, size = n_grams(words, s)
    first = np.cumsum(size) - size
    vectors = rng.normal(0, 0.3, (s.buckets, s.dim))
    out = rng.normal(0, 0.3, (s.dim, 2))
    bias = np.zeros(2)
    seen, seen_out, seen_bias = np.full((s.buckets, 1), 1e-4), np.full_like(out, 1e-4), np.full(2, 1e-4)

    def step(rows: np.ndarray) -> None:
        nonlocal out, bias
        n = length[rows]
        words, inverse = np.unique(gather(tok, length, rows)[0], return_inverse=True)
        grams, k = gather(flat, size, words)
        gram, where = np.unique(grams, return_inverse=True)
        of_word = np.repeat(np.arange(len(words)), k)
        word_vectors = np.add.reduceat(vectors[gram][where], np.cumsum(k) - k) / k[:, None]
        of_window = np.repeat(np.arange(len(rows)), n)
        bag = np.stack([np.bincount(of_window, word_vectors[inverse, j], len(rows)) for j in range(s.dim)], 1) / s.width
        logits = bag @ out + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = p - np.eye(2)[labels[rows]]
        g_out, g_bias, g_bag = bag.T @ g, g.sum(0), g @ out.T / s.width
        g_words = np.stack([np.bincount(inverse, g_bag[of_window, j], len(words)) for j in range(s.dim)], 1) / k[:, None]
        g_grams = np.stack([np.bincount(where, g_words[of_word, j], len(gram)) for j in range(s.dim)], 1)
        seen_out[:] += g_out**2
        seen_bias[:] += g_bias**2
        seen[gram] += (g_grams**2).mean(1, keepdims=True)
        out = out - s.rate * g_out / np.sqrt(seen_out)
        bias = bias - s.rate * g_bias / np.sqrt(seen_bias)
        vectors[gram] -= s.rate * g_grams / np.sqrt(seen[gram])

    def margins() -> np.ndarray:
        """Of all windows."""
        weight = vectors @ (out[:, 1] - out[:, 0])
        of_words = np.add.reduceat(weight[flat], first) / size if len(flat) else np.zeros(0)
        return np.bincount(np.repeat(np.arange(len(length)), length), of_words[tok], len(length)) / s.width + bias[1] - bias[0]

    usable = np.flatnonzero(length)
    epochs = s.noisy_epochs + s.picked_epochs
    batch = min(max(len(usable) // 100, 32), 256)  # so few windows still make many steps
    rounds = max(1, round(s.steps * batch / max(1, epochs * len(usable))))
    for epoch in np.repeat(np.arange(epochs), rounds):
        rows = usable
        if epoch >= s.noisy_epochs:
            m = margins()
            order = usable[np.lexsort((-m[usable], owners[usable]))]
            place = np.arange(len(order)) - np.searchsorted(owners[order], owners[order])
            rows = order[(labels[order] == 0) | (place < 2)]
        rows = rng.permutation(rows)
        for at in range(0, len(rows), batch):
            step(rows[at : at + batch])
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


class Scorer:
    """Worst-window margins of texts; one per worker and model.

    Word weights are whole multiples of 2**-30, so equal texts get equal sums wherever they stand.
    """

    def __init__(self, weights: np.ndarray, bias: float, s: Settings, room: int = 16 << 20):
        self.weights, self.bias, self.s, self.room = weights, bias, s, room
        self.lexicon, self.known = Lexicon(), np.zeros(0, np.int64)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        words, at, count = sequences(texts)
        if self.lexicon.words.nbytes + self.known.nbytes > self.room:
            self.lexicon, self.known = Lexicon(), np.zeros(0, np.int64)
        where, new = self.lexicon.places(words)
        if len(new):
            grams, size = n_grams(new, self.s)
            mean = np.add.reduceat(self.weights[grams], np.cumsum(size) - size) / size
            self.known = np.concatenate((self.known, np.rint(mean * 2**30).astype(np.int64)))
        width, ends = self.s.width, np.cumsum(count)
        total = np.concatenate(([0], np.cumsum(self.known[where[at]])))
        worst = total[ends] - total[ends - count]
        if (long := np.flatnonzero(count > width)).size:
            sums = total[width:] - total[:-width]
            worst[long] = [sums[b : e - width + 1].max() for b, e in zip((ends - count)[long].tolist(), ends[long].tolist(), strict=True)]
        return worst / 2**30 / width + self.bias


def calibrate(margin: np.ndarray, label: np.ndarray, rarer: float = 1.0) -> tuple[float, float]:
    """Logistic scale and shift of margins by Newton's method, with Platt's smoothed targets.

    ``rarer`` is the odds of label 1 among all labelled rows over those in the
    sample: a sample richer in toxic rows than the tables would score all too high.
    """
    high, low = (label == 1).sum(), (label == 0).sum()
    if not high or not low:
        return 1.0, 0.0
    target = np.where(label == 1, (high + 1) / (high + 2), 1 / (low + 2))
    centre, spread = margin.mean(), margin.std() or 1.0
    x = np.stack([(margin - centre) / spread, np.ones_like(margin)], 1)
    w = np.array([1.0, np.log(high / low)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (p - target) + 1e-3 * w)
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread + np.log(rarer))


def remainder(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from a bounded sample of labelled rows: of each label the
    ``s.sample`` of smallest hash among rows whose remainder is not 2.

    Vectors are trained on remainders 0 and 1, the calibration on 3. Rows with
    a null label or id take no part; without rows of both labels every score
    is a constant.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id") != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of_label = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows at most
    rarer = min(1.0, s.sample / of_label.get(0, 1)) / min(1.0, s.sample / of_label.get(1, 1))
    mixed = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(mixed, "doc_id").limit(s.sample).unionAll(known.where("toxic = 0").orderBy(mixed, "doc_id").limit(s.sample))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text", 4 << 20):
            words, at, count = sequences(part.column(2))
            row = np.repeat(np.arange(len(count)), count)
            place = (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)) // s.width
            first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(place, prepend=-1))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array([*first.tolist(), len(at)], pa.int32()), words.take(pa.array(at))), " ")
            own = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(place[first], pa.int32()), texts], names=["doc_id", "toxic", "at", "text"])

    sampled = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 * s.sample ids
    got = sampled.select("doc_id", F.col("toxic").cast("int"), "text").mapInArrow(cut, "doc_id long, toxic int, at int, text string").toArrow().sort_by([("doc_id", "ascending"), ("at", "ascending"), ("text", "ascending")])
    owners, label, texts = got["doc_id"].to_numpy(), got["toxic"].to_numpy().astype(np.int64), got["text"].combine_chunks()
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(s.buckets), 0.0, 1.0, float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1))) if len(label) else -2.0, s)
    rest = np.array([zlib.crc32(str(i).encode()) % 4 == 3 for i in owners.tolist()])
    if len(set(label[~rest].tolist())) < 2:
        rest = np.zeros_like(rest)
    train = np.flatnonzero(~rest)
    weights, bias = train_windows(texts.take(pa.array(train)), label[train], owners[train], s)
    held = np.flatnonzero(rest) if len(set(label[rest].tolist())) == 2 else train
    margin = Scorer(weights, bias, s)(texts.take(pa.array(held)))
    ids, at = np.unique(owners[held], return_inverse=True)
    worst = np.full(len(ids), -np.inf)
    np.maximum.at(worst, at, margin)
    scale, shift = calibrate(worst, label[held][np.unique(at, return_index=True)[1]], rarer)
    return Model(weights, bias, scale, shift, s)


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """Add ``name`` (toxic likelier the higher, 0 to 1) to the columns ``keep``.

    Null and empty texts get the score of a text without words; repeated rows
    get equal scores; a text of any length is read whole; nothing but the text
    enters; an empty table gives no rows. ``name`` must differ from all of
    ``keep`` (``fresh`` finds such a one). One scan, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.scale, model.shift, model.settings))

    def make():
        weights, bias, scale, shift, s = shared.value
        scorer = Scorer(weights, bias, s)
        return lambda texts: 1 / (1 + np.exp(-np.clip(scale * scorer(texts) + shift, -500, 500)))

    return with_number(docs, keep, name, make)


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, whatever those are called."""
    name = fresh(docs.columns, "score")
    return score(docs, model, docs.columns, name).where(F.col(name) < model.settings.threshold).select(*named(docs.columns))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit(docs, load(spark, sf_dir, "labels"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", (remainder("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= model.settings.threshold).cast("int").alias("predicted"))
