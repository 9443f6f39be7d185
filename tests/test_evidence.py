"""Second-stage operators against brute force."""

import itertools
import random

import numpy as np
import pytest

from kinlink.functions import similarity as sim
from kinlink.operators import evidence as ev

FIELDS = "s1_id string, target_id string, source string, p double, t_name string, t_address string, t_numbers array<string>"
NAMES = ("same", "cross")


def made(n, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(pick("a", "b", "c"), f"t{i:03}", pick("S2", "S3"), pick(0.3, 0.8, 0.9, 0.95), pick("", "red mill", "blue mill"), pick("", "2 low road", "3 low road"), [pick("2", "3")] * pick(0, 1)) for i in range(n)] + [("d", "lone", "S2", 0.9, "x", "", [])]


def seeds_of(rows, threshold, limit=2):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        if r[3] >= threshold and (r[4] or r[5]) and (r[4], r[5]) not in seen:
            seen.add((r[4], r[5]))
            out.append(r)
    return out[:limit]


def best(values):
    return max([v for v in values if v is not None], default=None)


def support(rows, threshold):
    out = {}
    for r in rows:
        others = [o for o in rows if o[0] == r[0] and o[1] != r[1]]
        row = [r[3], best([o[3] for o in others])]
        row.append(None if row[1] is None else r[3] - row[1])
        for same in (True, False):
            found = seeds_of([o for o in others if (o[2] == r[2]) == same], threshold)
            near = [[sim.token_set(r[k], s[k]) if r[k] and s[k] else None for k in (4, 5)] for s in found]
            clash = [float(not set(r[6]) & set(s[6])) for s in found if r[6] and s[6]]
            row += [len(found), best([s[3] for s in found]), best([n for n, _ in near]), best([a for _, a in near]), best([(n + a) / 2 for n, a in near if n is not None and a is not None]), sum(clash) / len(clash) if clash else None]
        out[r[0], r[1]] = row
    return out


@pytest.mark.parametrize("n", [0, 60])
def test_support_features(spark, n):
    rows = made(n, 5)
    got = {(r[0], r[1]): list(r[2:]) for r in ev.support_features(spark.createDataFrame(rows, FIELDS), 0.8).collect()}
    want = support(rows, 0.8)
    assert got.keys() == want.keys()
    assert all(x == pytest.approx(y) if y is not None else x is None for k in want for x, y in zip(got[k], want[k], strict=True))


def test_seeds_and_trials(spark):
    rows = made(60, 6)
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "CAST(p > 0.9 AS INT) AS label")
    assert {(r.s1_id, r.target_id) for r in ev.seeds(df, 0.8).collect()} == {(o, s[1]) for o in "abcd" for s in seeds_of([r for r in rows if r[0] == o], 0.8)}
    trials = {r.threshold: r for r in ev.seed_trials(df, (0.8, 0.95, 0.99), links=1, precision=0.9).collect()}
    for t, r in trials.items():
        picked = [s for o in "abcd" for x in ("S2", "S3") for s in seeds_of([r for r in rows if r[0] == o and r[2] == x], t)]
        assert (r.seed_links, r.correct_seed_links) == (len(picked), sum(s[3] > 0.9 for s in picked))
    assert [t for t, r in trials.items() if r.chosen] == [0.95] and trials[0.99].observed_precision is None


def test_two_thresholds(spark):
    """Four pairs and an owner without any; addressed pairs need 0.8, unaddressed ones 0.5."""
    pairs = [("a", "x", 0.85, 0), ("a", "y", 0.7, 0), ("b", "z", 0.55, 1), ("c", "w", 0.3, 1)]
    scored = spark.createDataFrame(pairs, "s1_id string, target_id string, p double, bare int")
    truth = spark.createDataFrame([("a", "x"), ("b", "z")], "s1_id string, target_id string")
    roster = spark.createDataFrame([(o,) for o in "abcd"], "s1_id string")
    table = ev.two_threshold_sweep(scored, truth, roster, "bare")
    assert table.count() == 22**2
    top = ev.best_policy(table).first()
    assert (top.address_threshold, top.missing_threshold, top.macro_f) == (0.85, 0.55, 1)
    assert {r.target_id for r in ev.apply_policy(scored, "bare", 0.8, 0.5).collect()} == {"x", "z"}


def test_two_fine_thresholds_equal_brute_force(spark):
    rng = random.Random(3)
    pairs = [(o, f"t{k}", rng.random(), rng.choice((0, 1, None))) for o in "abcde" for k in range(9)]
    true = {(o, t) for o, t, p, _ in pairs if rng.random() < p}
    grid = ev.policy_grid(0.8149999)
    assert len(grid) == 97 and 0.81 in grid and 0.8149999 in grid
    table = ev.two_threshold_sweep(spark.createDataFrame(pairs, "s1_id string, target_id string, p double, bare int"), spark.createDataFrame(sorted(true), "s1_id string, target_id string"), spark.createDataFrame([(o,) for o in "abcdef"], "s1_id string"), "bare", grid=grid)
    got = {(r.address_threshold, r.missing_threshold): (r.macro_f, r.one_threshold) for r in table.collect()}
    assert len(got) == 97**2
    for a, b in rng.sample(sorted(got), 300):
        f = []
        for o in "abcdef":
            kept = {(q, t) for q, t, p, m in pairs if q == o and p >= (b if m == 1 else a)}
            g = sum(q == o for q, _ in true)
            f.append(1.25 * len(kept & true) / (0.25 * g + len(kept)) if g or kept else 1.0)
        assert got[a, b] == (pytest.approx(sum(f) / 6), a == b)


def test_bootstrap(spark):
    """Intervals near those of resampled owners, whatever the partitions; zero denominators give null."""
    rng = np.random.default_rng(1)
    g, hit = rng.integers(0, 5, 300), rng.random(300)
    rows = [(f"o{i}", float(hit[i]), int(g[i] * hit[i]), int(g[i]), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "s1_id string, f double, t int, g int, zero int")
    ratios = {"f": ("f", None), "recall": ("t", "g"), "none": ("t", "zero")}
    one, four = ({r.measure: r for r in ev.owner_bootstrap(df.repartition(n), ratios, 400).collect()} for n in (1, 4))
    t = np.array([r[2] for r in rows])
    draws = rng.integers(0, 300, (400, 300))
    for name, means in (("f", hit[draws].mean(1)), ("recall", t[draws].sum(1) / g[draws].sum(1))):
        low, high = np.quantile(means, [0.025, 0.975])
        assert one[name].low == pytest.approx(low, abs=0.02) and one[name].high == pytest.approx(high, abs=0.02)
        assert (one[name].low, one[name].high) == pytest.approx((four[name].low, four[name].high))
    assert one["f"].estimate == pytest.approx(hit.mean()) and one["none"].low is None


def test_promotion():
    assert ev.promotes(0.1, 0.1, 0.1, [0.0])
    assert not any(ev.promotes(*x) for x in ((0, 1, 1, [0]), (1, 0, 1, [0]), (1, 1, 0, [0]), (1, 1, 1, []), (1, 1, 1, [-1])))
    assert not any(ev.promotes(*x, [1]) for x in itertools.product((0, 1), repeat=3) if not all(x))
