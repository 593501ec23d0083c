"""Exact quantiles against NumPy: ties, nulls, odd values, hot groups, and brackets narrowed more than once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators.quantiles import exact_quantiles

SHARES = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)


def groups():
    rng = np.random.default_rng(3)
    hot = rng.normal(size=6000)
    return {
        "hot": hot, "ties": rng.integers(0, 4, 900) / 2.0, "one": np.array([7.5]), "two": np.array([1.0, 2.0]), "same": np.full(300, -3.0), None: rng.normal(size=50),
        "steep": np.exp(rng.normal(size=2000) * 30), "wide": np.r_[-1e300, np.linspace(0, 1e-9, 1500), 1e300], "inf": np.r_[rng.normal(size=40), math.inf, -math.inf],
    }


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, float(v)) for k, values in groups().items() for v in values]
    rows += [("hot", None), ("hot", math.nan), ("none", None), ("none", math.nan)]
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


def linear(values, s):
    x = np.sort(values)
    k = math.floor(s * (len(x) - 1))
    part = s * (len(x) - 1) - k
    return x[k] if part <= 0 else (1 - part) * x[k] + part * x[k + 1]


@pytest.mark.parametrize("options", [{"small": 0}, {"small": 0, "accuracy": 50, "most": 20}, {"small": 0, "most_broadcast": 0}, {}])
def test_quantiles_are_exact(frame, options):
    got = {r.k: (r.n, r.quantiles) for r in exact_quantiles(frame, ["k"], "v", SHARES, **options).collect()}
    assert got.keys() == groups().keys()
    for k, values in groups().items():
        assert got[k][0] == len(values)
        for s, q in zip(SHARES, got[k][1], strict=True):
            want = linear(values, s)
            assert q == want or abs(q - want) <= 1e-9 * max(abs(want), 1e-9) or (math.isnan(want) and math.isnan(q)), (k, s, q, want)


def test_quantiles_equal_percentile_and_take_any_grouping(spark, frame):
    rows = frame.filter("k in ('hot', 'ties', 'same')").withColumn("half", F.pmod(F.xxhash64("v"), F.lit(2)))
    got = {(r.k, r.half): r.quantiles for r in exact_quantiles(rows, ["k", "half"], F.col("v") * 2, (0.3, 0.7), small=0, accuracy=100).collect()}
    for r in rows.filter("not isnan(v)").groupBy("k", "half").agg(F.percentile(F.col("v") * 2, F.array(F.lit(0.3), F.lit(0.7))).alias("q")).collect():
        assert np.allclose(got.pop((r.k, r.half)), r.q)
    assert not got
    whole = exact_quantiles(frame.filter("k = 'hot'"), [], "v", (0.5,), small=0, accuracy=100).collect()
    assert len(whole) == 1 and whole[0].n == 6000 and abs(whole[0].quantiles[0] - np.median(groups()["hot"])) < 1e-12
    assert exact_quantiles(frame.filter("false"), ["k"], "v", (0.5,), small=0).count() == 0
