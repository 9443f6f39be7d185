"""Quality by hierarchical empirical Bayes.

A logistic classifier reads a document's text statistics. Its probabilities,
summed over each path (site and section) and site by grouped aggregation, give
posteriors of a site's and a path's share of good documents, shrunk towards
the share above them as strongly as the spread between groups, by the method
of moments, tells. A document's posterior joins its own likelihood ratio with
its path's prior odds, from which its own evidence is left out, so that it
counts once; it is kept where that reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import fresh, load, materialise, named, parts, text_column, with_number

#: Labelled rows that the classifier is fitted on at most.
SAMPLE = 20_000
#: Paths up to which their sums are broadcast (about 100 bytes each); beyond, they are joined by a salted shuffle.
BROADCAST_PATHS = 100_000
#: Tasks over which a path's documents are then spread.
SALTS = 32
P = "_p"
ASCII_LETTERS = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
UPPER, DIGIT, SPACE = (np.array([test(chr(i)) and i < 128 for i in range(256)]) for test in (str.isupper, str.isdigit, str.isspace))
ODD = np.array([chr(i) in "#$%&*|!{}[]<>=+~^@\\/_" for i in range(256)])
STOP = np.array([chr(i) in ".,;:?" for i in range(256)])
NAMES = ("log_words", "distinct", "repeated", "word_length", "upper", "digits", "odd", "stops", "repeated_lines", "bars")


def statistics(text: str) -> tuple[float, ...]:
    """NAMES of a whole text; zeros for a text without words."""
    words = text.split()
    if not words:
        return (0.0,) * len(NAMES)
    n = len(words)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size, letters = max(1, int(counts.sum())), max(1, int(counts[ASCII_LETTERS].sum()))
    lines = [x for x in text.split("\n") if x]
    return (
        np.log1p(n),
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        min(size / n, 40.0),
        counts[UPPER].sum() / letters,
        counts[DIGIT].sum() / size,
        min(float(counts[ODD].sum()) / n, 5.0),
        min(float(counts[STOP].sum()) / n, 2.0),
        1 - len(set(lines)) / max(1, len(lines)),
        words.count("|") / n,
    )


@dataclass(frozen=True)
class Classifier:
    weights: tuple[float, ...]
    bias: float
    prior: float  #: share of good rows that it was fitted on

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ np.array(self.weights) + self.bias, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> Classifier:
    """Ridge logistic regression by Newton's method."""
    if len(y) == 0 or y.min() == y.max():
        share = float((y.sum() + 1) / (len(y) + 2))
        return Classifier((0.0,) * len(NAMES), float(np.log(share / (1 - share))), share)
    centre, spread = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = np.c_[(x - centre) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(keep) + 1e-9 * np.eye(len(w)), z.T @ (p - y) + keep * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(tuple((w[:-1] / spread).tolist()), float(w[-1] - (w[:-1] * centre / spread).sum()), float(y.mean()))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on the ``sample`` labelled rows of smallest hash.

    Null labels and ids take no part, nor do rows whose crc32(doc_id as text)
    mod 4 is 2: those are held out to be judged on. Where an id's labels differ
    the lower one counts; without rows of both labels the score is a constant.
    """
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([statistics(t) for t in text_column(part, "text")], pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x array<double>").toArrow().sort_by("doc_id")
    return fit_logistic(np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(NAMES)), got["quality"].to_numpy().astype(float))


def evidence(docs: DataFrame, classifier: Classifier, keep: list[str], name: str = P) -> DataFrame:
    """The columns ``keep`` with each text's probability of being good as ``name``, which none of them may be called."""
    rows = lambda texts: classifier(np.array([statistics(t or "") for t in texts.to_pylist()]))
    return with_number(docs, keep, name, lambda: rows, 16 << 20)


def _strength(groups: DataFrame, above: str) -> float:
    """Weight, in documents, of the share above a group: from the spread of the
    groups' shares beyond what binomial noise explains (method of moments)."""
    mean = F.col(above)
    r = groups.agg(
        F.sum(F.col("n")).alias("n"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"),
        F.sum(mean * (1 - mean)).alias("noise"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("within"),
    ).first()
    if not r["n"]:
        return 1.0
    spread = max((r["between"] - r["noise"]) / r["n"], 1e-9)
    return float(min(max(r["within"] / r["n"] / spread - 1, 1.0), 1e6))


@dataclass(frozen=True)
class Priors:
    """Per path (_site, _section) its sums and its site's (n, s, site_n, site_s), the share of all, and how strongly shares pull."""

    paths: DataFrame
    everywhere: float
    of_site: float
    of_path: float

    def shares(self, n, s, site_n, site_s, own: float | F.Column = 0.0, count: int = 0) -> tuple[F.Column, F.Column]:
        """A site's and a path's good share, each shrunk towards the one above, with ``count`` documents of evidence ``own`` left out."""
        site = (F.lit(self.of_site * self.everywhere) + site_s - own) / (F.lit(self.of_site) + site_n - count)
        return site, (F.lit(self.of_path) * site + s - own) / (F.lit(self.of_path) + n - count)


def priors(scored: DataFrame, site: str, section: str) -> Priors:
    """Grouped sums of evidence, pre-aggregated before the shuffle, so a hot site costs one row a task.

    Null sites and sections are groups of their own.
    """
    of = [c.alias(a) for c, a in zip(named([site, section]), ("_site", "_section"), strict=True)]
    paths = materialise(scored.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.sum(P).alias("s")), "paths")
    sites = paths.groupBy("_site").agg(F.sum("n").alias("site_n"), F.sum("s").alias("site_s"))
    total = sites.agg(F.sum("site_n").alias("n"), F.sum("site_s").alias("s")).first()
    everywhere = (total["s"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    of_site = _strength(sites.select(F.col("site_n").alias("n"), F.col("site_s").alias("s"), F.lit(everywhere).alias("above")), "above")
    right = sites.withColumnRenamed("_site", "_of")
    joined = materialise(paths.join(right, F.col("_site").eqNullSafe(F.col("_of"))).drop("_of"), "shares")
    draft = Priors(joined, everywhere, of_site, 1.0)
    of_path = _strength(joined.select("n", "s", draft.shares(*named(["n", "s", "site_n", "site_s"]))[0].alias("above")), "above")
    return Priors(joined, everywhere, of_site, of_path)


def judge(scored: DataFrame, p: str, known: Priors, classifier: Classifier, site: str, section: str, name: str) -> DataFrame:
    """Add to ``scored`` the struct ``name`` of site_share, path_share and posterior.

    Path sums are broadcast up to BROADCAST_PATHS of them; beyond, the rows
    are shuffled by path and salt, so a path with a third of all rows is
    spread over SALTS tasks. Both ways give the same rows.
    """
    small = known.paths.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
    names = {c: fresh([*scored.columns, name], f"_{c}") for c in ("_site", "_section", "n", "s", "site_n", "site_s", "_salt")}
    right = known.paths.withColumnsRenamed({c: x for c, x in names.items() if c != "_salt"})
    same = named([site])[0].eqNullSafe(F.col(names["_site"])) & named([section])[0].eqNullSafe(F.col(names["_section"]))
    if small:
        joined = scored.join(F.broadcast(right), same)
    else:
        salt = names["_salt"]
        left = scored.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        other = fresh([*left.columns, *right.columns, name], "_other_salt")
        joined = left.join(right.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col(salt) == F.col(other)))
    odds = lambda c: c / (1 - c)
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    site_share, path_share = known.shares(*(F.col(names[c]) for c in ("n", "s", "site_n", "site_s")), F.col(p), 1)
    o = odds(inside(F.col(p))) / odds(inside(F.lit(classifier.prior))) * odds(inside(path_share))
    return joined.select(*named(scored.columns), F.struct(site_share.alias("site_share"), path_share.alias("path_share"), (o / (1 + o)).alias("posterior")).alias(name))


def classify(docs: DataFrame, labels: DataFrame, site: str = "source", section: str = "lang", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, evidence, site_share, path_share, posterior, keep.

    Both shares leave the document's own evidence out. Null and empty texts
    have zero statistics; texts of any length are read whole; repeated rows
    count and return as often as they occur; an empty table gives no rows;
    other columns are not read.
    """
    classifier = fit(docs, labels, sample)
    scored = materialise(evidence(docs, classifier, ["doc_id", site, section]), "evidence")
    judged = judge(scored, P, priors(scored, site, section), classifier, site, section, "_j")
    return judged.select("doc_id", F.col(P).alias("evidence"), "_j.site_share", "_j.path_share", "_j.posterior", (F.col("_j.posterior") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, site: str = "source", section: str = "lang", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns, whatever those are called.

    Nulls, empty and long texts, repeats and empty tables are as in
    ``classify``. Texts are shuffled only where paths are too many to broadcast.
    """
    classifier = fit(docs, labels, sample)
    known = priors(evidence(docs, classifier, [site, section]), site, section)
    p, name = fresh(docs.columns, P), fresh(docs.columns, "_j")
    judged = judge(evidence(docs, classifier, docs.columns, p), p, known, classifier, site, section, name)
    return judged.where(F.col(f"{name}.posterior") >= threshold).select(*named(docs.columns))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
