"""Lead-lag operators against plain loops, with series in several blocks and parts, gaps, and odd rows."""

import itertools
import math
import zlib

import numpy as np
import pytest

from panelweave.operators import leadlag as L

KEYS = {"entity": "k", "pos": "pos", "value": "v"}
RNG = np.random.default_rng(4)
NAMES = [f"s{i:02d}" for i in range(14)]
#: name -> {position: value}; one in six values is missing, positions begin below zero.
SERIES = {k: {p: float(np.round(RNG.normal(), 3)) for p in range(-7, 40) if RNG.random() > 1 / 6} for k in NAMES}
SERIES["s03"] = {p: 2.5 for p in range(-7, 40)}  # no spread
SERIES["s04"] = {p + 2: v for p, v in SERIES["s05"].items()}  # follows s05 two positions later
SERIES["s06"] = {11: 1.0}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, p, v) for k, s in SERIES.items() for p, v in s.items()]
    odd = [(None, 3, 1.0), ("s00", None, 1.0), ("s00", 100, None), ("s01", next(iter(SERIES["s01"])), -99.0)]  # a repeated position: the largest value counts
    return spark.createDataFrame(rows + odd, "k string, pos int, v double").repartition(3)


def pairs(ordered):
    return [(a, b) for a, b in itertools.product(NAMES, NAMES) if (a != b if ordered else a < b)]


def both(a, b, lag):
    s, t = SERIES[a], SERIES[b]
    at = sorted(p for p in s if p + lag in t)
    return at, np.array([s[p] for p in at]), np.array([t[p + lag] for p in at])


def corr(x, y, least=1):
    if len(x) < max(least, 1) or x.std() <= 1e-12 or y.std() <= 1e-12:
        return None
    return float(np.corrcoef(x, y)[0, 1])


def same(got, want):
    assert got.keys() == want.keys(), (sorted(set(want) - set(got))[:3], sorted(set(got) - set(want))[:3])
    for key, row in want.items():
        for x, y in zip(got[key], row, strict=True):
            assert (x is None and y is None) or (x is not None and y is not None and abs(x - y) < 1e-9), (key, got[key], row)


@pytest.mark.parametrize("cells", [L.CELLS, 1280, 300])  # 300: the whole series don't fit, so parts of positions meet
@pytest.mark.parametrize("ordered", [True, False])
def test_lagged_correlations_and_sums(frame, cells, ordered):
    lags = [-3, -1, 0, 2]
    want = {(a, b, k): (len(x), corr(x, y, 5)) for a, b in pairs(ordered) for k in lags for _, x, y in [both(a, b, k)] if len(x)}
    got = L.lagged_correlations(frame, lags=lags, ordered=ordered, least=5, cells=cells, **KEYS).collect()
    same({(r.a, r.b, r.lag): (r.n, r.corr) for r in got}, want)
    hit = lambda v: v > 0.5
    got = L.lagged_sums(frame, {"xy": (hit, lambda v: v), "h": (lambda v: v == v, hit)}, lags=lags, ordered=ordered, cells=cells, **KEYS).collect()
    want = {(a, b, k): (len(x), y[x > 0.5].sum(), (y > 0.5).sum()) for a, b in pairs(ordered) for k in lags for _, x, y in [both(a, b, k)] if len(x)}
    same({(r.a, r.b, r.lag): (r.n, r.xy, r.h) for r in got}, want)


@pytest.mark.parametrize("cells", [L.CELLS, 130])  # 130: blocks of two entities
def test_events_tails_windows_and_rolling(frame, cells):
    want = {(a, b, k): (len(y), y.mean(), np.median(y), (y > 0).mean()) for a, b in pairs(True) for k in (0, 2) for _, x, y in [both(a, b, k)] for y in [y[x >= 0.8]] if len(y)}
    got = L.event_responses(frame, lambda v: v >= 0.8, lags=[0, 2], cells=cells, **KEYS).collect()
    same({(r.a, r.b, r.lag): (r.n, r.mean, r.median, r.up) for r in got}, want)

    want = {(a, b): ((y[x <= np.quantile(x, 0.3) + 1e-12] <= np.quantile(y, 0.3) + 1e-12).mean(),) for a, b in pairs(False) for _, x, y in [both(a, b, 0)] if len(x)}
    same({(r.a, r.b): (r.tail,) for r in L.tail_dependence(frame, level=0.3, cells=cells, **KEYS).collect()}, want)

    want = {}
    for a, b in pairs(False):
        at, x, y = both(a, b, 0)
        for i in range(9, len(at)):
            u, v = x[i - 9 : i + 1], y[i - 9 : i + 1]
            d = u - v
            want[a, b, at[i]] = (corr(u, v), (d[-1] - d.mean()) / d.std() if d.std() > 0 else None)
    same({(r.a, r.b, r.pos): (r.corr, r.spread_z) for r in L.rolling_relations(frame, 10, cells=cells, **KEYS).collect()}, want)


@pytest.mark.parametrize("lag", [1, -2])
@pytest.mark.parametrize("cells", [L.CELLS, 1900])  # 1900: parts of positions
def test_windows_up_to_ends_beyond_the_values(frame, lag, cells):
    want = {}
    for a, b in pairs(False):
        at, x, y = both(a, b, lag)
        for e in (-5, 4, 20, 39, 45, 90):
            inside = [i for i, p in enumerate(at) if e - 9 <= p <= e]
            if inside:
                want[a, b, e] = (len(inside), corr(x[inside], y[inside]))
    got = L.window_correlations(frame, [-5, 4, 20, 39, 45, 90], 10, lag=lag, cells=cells, **KEYS).collect()
    same({(r.a, r.b, r.end_pos): (r.n, r.corr) for r in got}, want)


def test_maxstat_against_loops_with_the_same_seeds(frame):
    lags, low, high = range(-2, 3), min(min(s) for s in SERIES.values()), max(max(s) for s in SERIES.values())
    dense = {k: np.array([s.get(p, np.nan) for p in range(low, high + 1)]) for k, s in SERIES.items()}

    def stat(x, y):
        best = None
        for k in lags:
            u, v = x[max(0, -k) : len(x) - max(0, k)], y[max(0, k) : len(y) - max(0, -k)]
            fine = ~np.isnan(u) & ~np.isnan(v)
            c = corr(u[fine], v[fine], 10)
            best = best if c is None else max(abs(c), best or 0.0)
        return best

    def judged(a, b, stage, draws):
        rng = np.random.default_rng(zlib.crc32(f"7|{b}|{stage}".encode()))
        cuts = [dense[b][i : i + 5] for i in range(0, len(dense[b]), 5)]
        null = [stat(dense[a], np.concatenate([cuts[i] for i in rng.permutation(len(cuts))])) for _ in range(draws)]
        null = [x for x in null if x is not None]
        return (1 + sum(x >= stat(dense[a], dense[b]) - 1e-12 for x in null)) / (1 + len(null)), len(null)

    want = {}
    for a, b in pairs(False):
        seen, p, n = stat(dense[a], dense[b]), None, 0
        if seen is not None:
            p, n = judged(a, b, "screen", 19)
            if p <= 0.1:
                p, n = judged(a, b, "refine", 39)
        want[a, b] = (seen, p, n)
    got = {(r.a, r.b): (r.stat, r.p, r.draws) for r in L.maxstat_permutation(frame, lags=lags, draws=19, refined=39, trigger=0.1, seed=7, **KEYS).collect()}
    same(got, want)
    assert got["s04", "s05"][1] == 1 / 40 and got["s03", "s05"][0] is None
    few = {(r.a, r.b): (r.stat, r.p, r.draws) for r in L.maxstat_permutation(frame, lags=lags, draws=19, refined=39, trigger=0.1, seed=7, cells=130, **KEYS).collect()}
    same(few, got)


def test_other_leaders_take_out_their_own(frame):
    rows = frame.filter("k is not null and pos is not null").filter("v > -99 or v is null")
    want = {}
    for k in NAMES:
        for at in range(-7, 60):
            values = [s[at - lag] for other, s in SERIES.items() if other != k for lag in (1, 2) if at - lag in s]
            if values:
                want[k, at] = (sum(values) / len(values), max(values), min(values), sum(v >= 0.7 for v in values))
    got = L.other_leaders(rows, 0.7, lags=[1, 2], **KEYS)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    same({(r.k, r.pos): (r["mean"], r.top, r.low, r.shocks) for r in got.collect()}, want)


def test_edge_leaders_use_the_strongest_and_nothing_later(spark, frame):
    edges = [("s01", "x", 1, 2.0), ("s02", "x", 0, -3.0), ("s05", "x", 2, 1.0), ("s07", "x", -1, 9.0), ("s08", "x", 1, 0.5), ("s09", "y", 3, None), ("s00", "s01", 1, 1.0)]
    got = L.edge_leaders(frame.filter("v > -99"), spark.createDataFrame(edges, "src string, dst string, lag int, weight double"), 0.7, most=3, **KEYS)
    want = {}
    for dst, used in (("x", edges[:3]), ("s01", edges[6:])):
        for at in range(-10, 60):
            v = [(w, SERIES[src][at - lag]) for src, _, lag, w in used if at - lag in SERIES[src]]
            if v:
                values = [x for _, x in v]
                want[dst, at] = (sum(abs(w) * x * math.copysign(1, w) for w, x in v) / sum(abs(w) for w, _ in v), sum(w * x for w, x in v), max(values), min(values), sum(x >= 0.7 for x in values), sum(x <= -0.7 for x in values))
    same({(r.k, r.pos): (r.consensus, r.pressure, r.top, r.low, r.ups, r.downs) for r in got.collect()}, want)


def test_series_without_rows_or_too_long_for_one_part(spark, frame):
    empty = frame.filter("false")
    assert L.lagged_correlations(empty, lags=[0, 1], **KEYS).count() == 0
    assert L.rolling_relations(empty, 10, **KEYS).count() == L.other_leaders(empty, 1.0, lags=[1], **KEYS).count() == 0
    with pytest.raises(ValueError, match="positions"):
        L.tail_dependence(frame, level=0.3, cells=20, **KEYS)


def test_what_is_shuffled_are_tiles(frame):
    plan = L.lagged_correlations(frame, lags=[0, 1, 2], **KEYS)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
