"""Queries that SQL can't say, against plain NumPy and Python on the smallest tables."""

import math
import zlib

import duckdb
import numpy as np
import pytest

from panelweave.plans import QUERIES
from panelweave.plans.evaluate import LONG
from panelweave.plans.registry import sql
from panelweave.plans.stats import _SER, FV

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def result(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_fingerprint(spark, duck):
    hashes = [zlib.crc32(f"{a}|{b}|{c}".encode()) for a, b, c in duck.sql("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders").fetchall()]
    x = 0
    for h in hashes:
        x ^= h
    row = result(spark, "r1_22_fingerprint")[0]
    assert (row["n_rows"], row["hash_xor"], row["hash_sum"]) == (len(hashes), x, sum(hashes))


def test_beta_bound(spark):
    for r in result(spark, "r9_7_beta_bound"):
        a, b = 1 + r["hits"], 1 + r["misses"]
        x = (np.arange(200_000) + 0.5) / 200_000
        p = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / len(x)
        assert abs(p[x <= r["beta_low"]].sum() - 0.05) < 2e-3


def test_network_series(spark, duck):
    d = duck.sql(sql("panel", "SELECT date, bucket, sum(close) AS v FROM panel GROUP BY 1, 2")).df().pivot(index="date", columns="bucket", values="v").sort_index()
    got = {str(r["end_date"]): r for r in result(spark, "r6_21_network_series")}
    want = 0
    for end in d.index:
        x = d[(d.index <= end) & (d.index > end - np.timedelta64(10, "D"))].dropna()
        if len(x) < 6:
            continue
        want += 1
        z = (x - x.mean()) / x.std(ddof=0)
        c = (z.T @ z / len(x)).to_numpy()
        pair = c[np.triu_indices(5, 1)]
        r = got[str(end.date())]
        assert [r["mean_corr"], r["q90"], r["density"], r["eigen_share"]] == pytest.approx([pair.mean(), np.quantile(pair, 0.9), (abs(pair) >= 0.6).mean(), max(np.linalg.svd(c)[1]) / 5], abs=2e-6)
    assert want == len(got) > 0


def test_granger(spark, duck):
    s = duck.sql(sql("ret", f", {_SER} SELECT * FROM s")).df()
    series = {k: dict(zip(g["pos"], g["v"], strict=True)) for k, g in s.groupby("k")}
    lags = {}
    for k, v in series.items():
        at = sorted(v)
        lags[k] = {p: (v[p], v[at[i - 1]], v[at[i - 2]]) for i, p in enumerate(at) if i >= 2}
    got = {(r["a"], r["b"]): r for r in result(spark, "r7_50_granger")}
    assert set(got) == {(a, b) for a in series for b in series if a != b}
    for (a, b), r in got.items():
        both = sorted(set(lags[a]) & set(lags[b]))
        y = np.array([lags[b][p][0] for p in both])
        own, more = np.array([[1, *lags[b][p][1:]] for p in both]), np.array([[1, *lags[b][p][1:], *lags[a][p][1:]] for p in both])
        rss = [float(y @ y - y @ x @ np.linalg.pinv(x.T @ x) @ x.T @ y) for x in (own, more)]
        assert r["gain"] == pytest.approx((rss[0] - rss[1]) / ((y - y.mean()) ** 2).sum(), abs=1e-5)
        assert r["f"] == pytest.approx((rss[0] - rss[1]) / 2 / (rss[1] / (len(y) - 5)), rel=1e-4)


def test_simplex_search_contains_each_model_alone(spark, duck):
    x = duck.sql(sql("scored", f", {LONG} SELECT model, fold_id, target, s FROM lng JOIN scored USING (row_id)")).df()
    got = {r["candidate"]: r for r in result(spark, "r10_19_simplex_search")}
    assert len(got) == 6 + 12
    for m in (0, 1, 2):  # the first candidates are the corners
        per = []
        for _, g in x[x["model"] == m].groupby("fold_id"):
            c = g.assign(s=g["s"].round(9)).groupby("s")["target"].agg(["sum", "count"]).sort_index(ascending=False)
            if c["sum"].sum():
                per.append((c["sum"] * c["sum"].cumsum() / c["count"].cumsum()).sum() / c["sum"].sum())
        assert got[m]["mean_ap"] == pytest.approx(np.mean(per), abs=2e-6) and got[m]["least_ap"] == pytest.approx(min(per), abs=2e-6)


def test_bootstrap_means_enclose_the_mean(spark):
    rows = result(spark, "r7_42_bootstrap_mean")
    assert rows and all(r["low"] <= r["high"] for r in rows)


def replicated(units, draws, seed):
    """Sums over units {name: values} with NumPy's own draws, seeded as the operator's."""
    return sum(np.outer(v, np.random.default_rng(zlib.crc32(f"{seed}|{u}".encode())).poisson(1.0, draws)) for u, v in units.items())


def test_bootstraps_equal_seeded_numpy(spark, duck):
    c = duck.sql(sql("features", f"SELECT feature, fold_id, CASE WHEN count(*) >= 10 AND stddev_pop(value) > 1e-12 AND stddev_pop(target) > 1e-12 THEN corr(value, target) END AS c FROM {FV} GROUP BY 1, 2")).df().dropna()
    for r in result(spark, "r7_42_bootstrap_mean"):
        s, n = replicated({str(f): np.array([x, 1.0]) for f, x in c[c["feature"] == r["feature"]][["fold_id", "c"]].itertuples(index=False)}, 200, 7)
        m = s[n > 0] / n[n > 0]
        assert r["low"] == pytest.approx(np.quantile(m, 0.05), abs=2e-6) and r["high"] == pytest.approx(np.quantile(m, 0.95), abs=2e-6)
    x = duck.sql(sql("scored", " SELECT market, ticker, date, target, score FROM scored WHERE score >= 0.8")).df()
    x["date"] = x["date"].astype(str).str[:10]
    for name, by, unit, draws in (("r7_43_date_block_bootstrap", [], ["date"], 200), ("r7_44_stratified_bootstrap", ["market"], ["ticker", "date"], 100)):
        groups = {k: g for k, g in x.groupby(by)} if by else {(): x}
        rows = result(spark, name)
        assert len(rows) == len(groups)
        for r in rows:
            g = groups[tuple(r[b] for b in by)].groupby(unit)["target"].agg(["sum", "count"])
            tp, al = replicated({"|".join(map(str, k if isinstance(k, tuple) else (k,))): v.to_numpy(float) for k, v in g.iterrows()}, draws, 11)
            assert r["draws"] == (al > 0).sum() and r["precision_low"] == pytest.approx(np.quantile(tp[al > 0] / al[al > 0], 0.05), abs=2e-6)


def test_average_linkage(spark, duck):
    """Clusters of each market: merged again here, pair by pair, from the correlations."""
    f = duck.sql(sql("features", f"SELECT market, feature, row_id, value FROM {FV}")).df()
    got = {}
    for r in result(spark, "r7_15_average_linkage"):
        got.setdefault(r["market"], {})[r["feature"]] = r["cluster"]
    assert set(got) == set(f["market"])
    for market, g in f.groupby("market"):
        w = g.pivot(index="row_id", columns="feature", values="value")
        dist = 1 - w.corr().abs()
        groups = [[c] for c in sorted(w.columns)]
        while len(groups) > 1:
            pairs = [(np.mean([dist.loc[a, b] for a in x for b in y]), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j]
            d, i, j = min(pairs)
            if d > 0.7:
                break
            groups[i] += groups.pop(j)
        mine = {}
        for name, k in got[market].items():
            mine.setdefault(k, set()).add(name.split(":")[-1])
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups))


def fitted(x, y, ridge=1.0):
    """Logistic weights by plain gradient and Newton steps on the whole matrix."""
    x = np.column_stack([np.ones(len(x)), x])
    pull, w = np.r_[0.0, np.full(x.shape[1] - 1, ridge)], np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (p - y) + pull * w)
    return w


def test_trained_stacks_equal_plain_fits(spark, duck):
    x = duck.sql(sql("scored", f", {LONG} SELECT row_id, fold_id, market, target, max(s) FILTER (model = 0) AS s0, max(s) FILTER (model = 1) AS s1, max(s) FILTER (model = 2) AS s2 FROM lng JOIN scored USING (row_id) GROUP BY ALL")).df()
    cols = ["s0", "s1", "s2"]
    prob = lambda w, rows: 1 / (1 + np.exp(-(w[0] + rows[cols].to_numpy() @ w[1:])))
    want, special = {}, {}
    for f in sorted(x["fold_id"].unique())[1:]:
        past, now = x[x["fold_id"] < f], x[x["fold_id"] == f]
        pooled = dict(zip(now["row_id"], prob(fitted(past[cols].to_numpy(), past["target"].to_numpy()), now), strict=True))
        want |= pooled
        for m, g in now.groupby("market"):
            own = past[past["market"] == m]
            n, ones = len(own), own["target"].sum()
            if n >= 30 and ones >= 5 and n - ones >= 5:
                mine = prob(fitted(own[cols].to_numpy(), own["target"].to_numpy()), g)
                special |= {r: n / (n + 50) * a + 50 / (n + 50) * pooled[r] for r, a in zip(g["row_id"], mine, strict=True)}
            else:
                special |= {r: pooled[r] for r in g["row_id"]}
    for name, expected in (("r14_16_trained_stack", want), ("r14_27_trained_specialists", special)):
        got = {r["row_id"]: r["stacked"] for r in result(spark, name)}
        assert got.keys() == expected.keys() and all(got[r] == pytest.approx(v, abs=2e-6) for r, v in expected.items())


def test_grouped_fits_of_odd_groups(spark):
    from panelweave.operators.newton import grouped_logistic

    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 2)) * [1, 40], 3)  # one feature of large scale
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(int)
    rows = [("usual", *map(float, a), int(b)) for a, b in zip(x, y, strict=True)]
    rows += [("apart", float(i), 0.0, int(i > 10)) for i in range(20)] + [("one", 1.0, 2.0, 1)] * 5 + [("usual", None, 1.0, 1), (None, 1.0, 1.0, 1), ("none", 1.0, 1.0, None), ("usual", 1.0, 1.0, 7)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y int").repartition(3)
    for limit in (10_000, 0):
        got = {r["g"]: r for r in grouped_logistic(df, ["g"], ["a", "b"], "y", most_broadcast=limit, steps=60).collect()}
        assert set(got) == {"usual", "apart", "one"} and got["usual"]["n"] == 300
        assert np.allclose(got["usual"]["w"], fitted(x, y), atol=1e-6)
        assert np.allclose(got["apart"]["w"], fitted(np.array([[i, 0.0] for i in range(20)]), np.arange(20) > 10), atol=1e-6)
        assert 0 < got["one"]["w"][0] <= 20
    assert grouped_logistic(df, [], ["a", "b"], "y", steps=60).count() == 1
    assert grouped_logistic(df.filter("false"), ["g"], ["a"], "y").count() == 0
