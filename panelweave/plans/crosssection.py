"""Queries: transforms across entities on a date."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.windows import over, pct_rank, zscore
from panelweave.operators import crosssection as X
from panelweave.operators import rolling as R
from panelweave.plans.registry import query, sql

CLUSTERS = [("f_close", 0), ("f_volume", 0), ("f_mean", 0), ("f_errors", 1), ("f_buys", 1), ("f_ret", 1)]
CLUSTER_SQL = "cl(feature, cluster) AS (VALUES " + ", ".join(f"('{f}', {c})" for f, c in CLUSTERS) + ")"
RANKED = "ranked AS (SELECT *, CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY feature, date, value IS NOT NULL ORDER BY value) + (count(*) OVER (PARTITION BY feature, date, value) - 1) / 2.0) / count(value) OVER (PARTITION BY feature, date) END AS rk FROM features)"


def pr(x: str, by: str) -> str:
    """DuckDB text of a percentile rank with average ties."""
    p = f"PARTITION BY {by}, " if by else "PARTITION BY "
    q = f"PARTITION BY {by}" if by else ""
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({p}{x} IS NOT NULL ORDER BY {x}) + (count(*) OVER ({p}{x}) - 1) / 2.0) / count({x}) OVER ({q}) END"


@query("r6_1_date_rank", sql("ret", f"SELECT ticker, date, round({pr('r', 'date')}, 6) AS pr FROM ret"))
def _(t):
    return t.ret.select("ticker", "date", pct_rank(F.col("r"), "date").alias("pr"))


@query("r6_2_group_rank", sql("panel", f"SELECT ticker, date, round({pr('close', 'date, market')}, 6) AS market_rank, round({pr('volume', 'date, bucket')}, 6) AS bucket_rank FROM panel"))
def _(t):
    return t.panel.select("ticker", "date", pct_rank(F.col("close"), "date", "market").alias("market_rank"), pct_rank(F.col("volume"), "date", "bucket").alias("bucket_rank"))


@query("r6_3_global_rank", f"SELECT o_orderkey, round({pr('o_totalprice', '')}, 6) AS pr FROM orders")
def _(t):
    return X.global_pct_rank(t.read("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "pr", parts=8).select("o_orderkey", "pr")


@query("r6_4_robust_z", sql("panel", ", m AS (SELECT *, quantile_cont(close, 0.5) OVER (PARTITION BY date, market) AS med FROM panel), d AS (SELECT *, 1.4826 * quantile_cont(abs(close - med), 0.5) OVER (PARTITION BY date, market) AS mad, stddev_pop(close) OVER (PARTITION BY date, market) AS sd FROM m), s AS (SELECT *, CASE WHEN mad > 1e-12 THEN mad ELSE sd END AS sc FROM d) SELECT ticker, date, CASE WHEN sc > 1e-12 THEN round(greatest(least((close - med) / sc, 8), -8), 6) END AS z FROM s"))
def _(t):
    return X.robust_z(t.panel, "close", ["date", "market"], "z").select("ticker", "date", "z")


@query("r6_5_group_z", sql("panel", "SELECT ticker, date, CASE WHEN stddev_samp(close) OVER w > 0 THEN round((close - avg(close) OVER w) / stddev_samp(close) OVER w, 6) END AS z FROM panel WINDOW w AS (PARTITION BY date, bucket)"))
def _(t):
    return t.panel.select("ticker", "date", zscore(F.col("close"), "date", "bucket").alias("z"))


@query("r6_6_median_delta", sql("panel", "SELECT ticker, date, round(close - quantile_cont(close, 0.5) OVER (PARTITION BY date, bucket), 6) AS delta FROM panel"))
def _(t):
    return t.panel.select("ticker", "date", X.median_delta(F.col("close"), "date", "bucket").alias("delta"))


@query("r6_7_demean", sql("panel", "SELECT ticker, date, round(close - avg(close) OVER (PARTITION BY ticker), 6) AS residual FROM panel"))
def _(t):
    return t.panel.select("ticker", "date", X.demean(F.col("close"), "ticker").alias("residual"))


_LOO = "CASE WHEN count(r) OVER w{i} - (r IS NOT NULL)::INT > 0 THEN (sum(r) OVER w{i} - coalesce(r, 0)) / (count(r) OVER w{i} - (r IS NOT NULL)::INT) END"


@query("r6_8_peer_mean", sql("ret", f"SELECT ticker, date, round(coalesce({_LOO.format(i=1)}, {_LOO.format(i=2)}), 6) AS peer FROM ret WINDOW w1 AS (PARTITION BY date, bucket), w2 AS (PARTITION BY date)"))
def _(t):
    return t.ret.select("ticker", "date", X.peer_mean(F.col("r"), "date", "bucket").alias("peer"))


@query("r6_9_peer_block", sql("ret", f", p AS (SELECT ticker, date, r, {_LOO.format(i=1)} AS peer, stddev_samp(r) OVER w1 AS dispersion FROM ret WINDOW w1 AS (PARTITION BY date, bucket)) SELECT ticker, date, round(r - peer, 6) AS relative, round(dispersion, 6) AS dispersion, round(lag(peer, 1) OVER w, 6) AS peer_lag1, round(lag(peer, 3) OVER w, 6) AS peer_lag3 FROM p WINDOW w AS (PARTITION BY ticker ORDER BY date)"))
def _(t):
    return X.peer_block(t.ret, "r").select("ticker", "date", "relative", "dispersion", "peer_lag1", "peer_lag3")


def clusters(t):
    return t.spark.createDataFrame(CLUSTERS, "feature string, cluster int")


@query("r6_10_cluster_innovation", sql("features", f", {RANKED}, {CLUSTER_SQL}, c AS (SELECT * FROM ranked JOIN cl USING (feature)) SELECT a.row_id, a.feature, round(any_value(a.rk) - quantile_cont(b.rk, 0.5), 6) AS innovation FROM c a JOIN c b ON a.row_id = b.row_id AND a.cluster = b.cluster AND a.feature <> b.feature WHERE a.rk IS NOT NULL GROUP BY 1, 2"))
def _(t):
    return X.cluster_innovation(t.features.filter("value is not null"), clusters(t))


_PEERS = [("f_close", "f_volume", 0.9), ("f_close", "f_mean", 0.5), ("f_volume", "f_buys", 0.4), ("f_volume", "f_errors", 0.3)]


@query("r6_11_peer_innovation", sql("features", f", {RANKED}, e(feature, peer, weight) AS (VALUES {', '.join(str(p) for p in _PEERS)}) SELECT a.row_id, a.feature, round(any_value(a.rk) - sum(weight * b.rk) / sum(weight), 6) AS innovation FROM ranked a JOIN e USING (feature) JOIN ranked b ON b.row_id = a.row_id AND b.feature = e.peer GROUP BY 1, 2"))
def _(t):
    return X.weighted_peer_innovation(t.features, t.spark.createDataFrame(_PEERS, "feature string, peer string, weight double"))


@query("r6_12_horizon_spread", sql("panel", f", m AS (SELECT *, avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ma_3, avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ma_10 FROM (SELECT ticker, date, close FROM panel)), q AS (SELECT ticker, date, round(ma_3, 9) AS ma_3, round(ma_10, 9) AS ma_10 FROM m) SELECT ticker, date, round({pr('ma_3', 'date')} - {pr('ma_10', 'date')}, 6) AS ma_3__ma_10 FROM q"))
def _(t):
    w = over("ticker", order="date")
    m = t.panel.select("ticker", "date", F.round(F.avg("close").over(w.rowsBetween(-2, 0)), 9).alias("ma_3"), F.round(F.avg("close").over(w.rowsBetween(-9, 0)), 9).alias("ma_10"))
    return X.horizon_spreads(m, [("ma_3", "ma_10")]).select("ticker", "date", "ma_3__ma_10")


@query("r6_13_pair_transforms", sql("panel", f", k AS (SELECT ticker, date, {pr('close', 'date')} AS ra, {pr('volume', 'date')} AS rb FROM panel) SELECT ticker, date, round(ra - rb, 6) AS difference, round(ra * rb, 6) AS product, round(least(ra, rb), 6) AS low, round(greatest(ra, rb), 6) AS high, round(abs(ra - rb), 6) AS disagreement FROM k"))
def _(t):
    return X.pair_transforms(t.panel, "close", "volume").select("ticker", "date", "difference", "product", "low", "high", "disagreement")


@query("r6_14_relative_features", sql("panel", f"SELECT ticker, date, round({pr('close', 'date')}, 6) AS date_rank, round((close - avg(close) OVER (PARTITION BY date)) / stddev_samp(close) OVER (PARTITION BY date), 6) AS date_z, round({pr('close', 'date, market')}, 6) AS market_rank, round(close - quantile_cont(close, 0.5) OVER (PARTITION BY date, market), 6) AS market_delta FROM panel"))
def _(t):
    return X.relative_features(t.panel, "close", ["market"]).select("ticker", "date", "date_rank", "date_z", "market_rank", "market_delta")


@query("r6_15_top_levels", "WITH top AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5) SELECT p_partkey, coalesce(top.p_brand, '__OTHER__') AS level FROM part LEFT JOIN top USING (p_brand)")
def _(t):
    return X.one_hot_top(t.read("part"), "p_brand", 5).select("p_partkey", "level")


@query("r6_16_staged_transforms", sql("panel", f", z AS (SELECT ticker, date, close, {pr('close', 'date')} AS dr, {pr('close', 'date, industry')} AS ir, close - lag(close, 5) OVER w AS change5 FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT ticker, date, 'date_rank' AS transform, round(dr, 6) AS value FROM z UNION ALL SELECT ticker, date, 'industry_rank', round(ir, 6) FROM z UNION ALL SELECT ticker, date, 'change5', round(change5, 6) FROM z"))
def _(t):
    w = over("ticker", order="date")
    wide = t.panel.select("ticker", "date", pct_rank(F.col("close"), "date").alias("date_rank"), pct_rank(F.col("close"), "date", "industry").alias("industry_rank"), R.change(F.col("close"), 5, w).alias("change5"))
    return wide.unpivot(["ticker", "date"], ["date_rank", "industry_rank", "change5"], "transform", "value")


@query("r6_17_breadth", sql("ret", ", k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY close DESC, ticker) AS n FROM ret) SELECT date, round(avg((r > 0)::INT), 6) AS advance, round(avg((r < 0)::INT), 6) AS decline, round(avg((r <= -0.5)::INT), 6) AS crash, round(stddev_samp(r), 6) AS std, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 6) AS iqr, round(quantile_cont(close, 0.5), 6) AS median_size, round(sum(CASE WHEN n <= 10 THEN close END) / sum(close), 6) AS top_share FROM k GROUP BY date"))
def _(t):
    return X.breadth(t.ret, "r", "close")


@query("r6_18_market_flow", sql("panel", ", d AS (SELECT date, market, sum(buys) AS flow, sum(buys)::DOUBLE / sum(volume) AS ratio FROM panel GROUP BY 1, 2) SELECT date, market, flow, round(ratio, 6) AS ratio, CASE WHEN stddev_pop(ratio) OVER w > 1e-12 AND count(ratio) OVER w >= 5 THEN round((ratio - avg(ratio) OVER w) / stddev_pop(ratio) OVER w, 6) END AS z FROM d WINDOW w AS (PARTITION BY market ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"))
def _(t):
    d = t.panel.groupBy("date", "market").agg(F.sum("buys").alias("flow"), (F.sum("buys") / F.sum("volume")).alias("ratio"))
    return d.withColumn("z", R.rolling_z(F.col("ratio"), over("market", order="date"), 10, past_only=False, least=5))


@query("r6_19_universe_quantiles", sql("ret", ", q AS (SELECT date, quantile_cont(r, 0.05) AS q05, quantile_cont(r, 0.5) AS q50, quantile_cont(r, 0.95) AS q95 FROM ret GROUP BY 1) SELECT date, round(any_value(q05), 6) AS q05, round(any_value(q50), 6) AS q50, round(any_value(q95), 6) AS q95, round(avg(CASE WHEN r <= q05 + 1e-12 THEN r END), 6) AS left_tail FROM ret JOIN q USING (date) GROUP BY date"))
def _(t):
    q = t.ret.groupBy("date").agg(*[F.percentile("r", F.lit(p)).alias(f"q{round(100 * p):02d}") for p in (0.05, 0.5, 0.95)])
    return t.ret.join(q, "date").groupBy("date").agg(*[F.first(c).alias(c) for c in ("q05", "q50", "q95")], F.avg(F.when(F.col("r") <= F.col("q05") + 1e-12, F.col("r"))).alias("left_tail"))


@query("r6_20_crowded_share", sql("panel", ", q AS (SELECT date, quantile_cont(volume, 0.8) AS c FROM panel GROUP BY 1) SELECT date, round(avg((volume > c)::INT), 6) AS crowded, round(quantile_cont(buys::DOUBLE / volume, 0.5), 6) AS median_flow, round(avg((buys > errors)::INT), 6) AS rising FROM panel JOIN q USING (date) GROUP BY date"))
def _(t):
    q = t.panel.groupBy("date").agg(F.percentile("volume", F.lit(0.8)).alias("c"))
    x = t.panel.join(q, "date")
    return x.groupBy("date").agg(F.avg((F.col("volume") > F.col("c")).cast("double")).alias("crowded"), F.percentile(F.col("buys") / F.col("volume"), F.lit(0.5)).alias("median_flow"), F.avg((F.col("buys") > F.col("errors")).cast("double")).alias("rising"))


@query("r6_21_network_series")
def _(t):
    """Mean pair correlation, its 90 percent quantile, density and the largest eigenvalue's share over the last ten days, between markets' bucket series."""
    import numpy as np
    import pandas as pd

    d = t.panel.groupBy("date", "bucket").agg(F.sum("close").alias("v")).groupBy("date").pivot("bucket", [f"B{i}" for i in range(5)]).sum("v")
    ends = d.select(F.col("date").alias("end_date"))
    windows = ends.join(F.broadcast(d), (F.col("date") <= F.col("end_date")) & (F.col("date") > F.date_sub("end_date", 10)))

    def network(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")[[f"B{i}" for i in range(5)]].dropna()
        if len(x) < 6:
            return pd.DataFrame(columns=["end_date", "mean_corr", "q90", "density", "eigen_share"])
        c = np.corrcoef(x.to_numpy().T)
        pair = c[np.triu_indices(5, 1)]
        return pd.DataFrame([(key[0], pair.mean(), np.quantile(pair, 0.9), (np.abs(pair) >= 0.6).mean(), np.linalg.eigvalsh(c)[-1] / 5)], columns=["end_date", "mean_corr", "q90", "density", "eigen_share"])

    return windows.groupBy("end_date").applyInPandas(network, "end_date date, mean_corr double, q90 double, density double, eigen_share double")


@query("r6_22_entity_network", sql("ret", ", p AS (SELECT ticker, date, r, CASE WHEN count(r) OVER w - (r IS NOT NULL)::INT > 0 THEN (sum(r) OVER w - coalesce(r, 0)) / (count(r) OVER w - (r IS NOT NULL)::INT) END AS m FROM ret WINDOW w AS (PARTITION BY date, market)), b AS (SELECT ticker, date, CASE WHEN m IS NOT NULL THEN r END AS r, CASE WHEN r IS NOT NULL THEN m END AS m FROM p) SELECT ticker, date, CASE WHEN count(r) OVER v >= 6 AND stddev_pop(r) OVER v > 1e-12 AND stddev_pop(m) OVER v > 1e-12 THEN round(corr(r, m) OVER v, 6) END AS market_corr FROM b WINDOW v AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"))
def _(t):
    from panelweave.functions.windows import leave_one_out_mean

    p = t.ret.withColumn("m", leave_one_out_mean(F.col("r"), "date", "market"))
    return p.select("ticker", "date", R.rolling_pair("corr", F.col("r"), F.col("m"), over("ticker", order="date"), 10, 6).alias("market_corr"))


@query("r6_23_regime_calendar", sql("ret", """, d AS (SELECT date, avg(r) AS r FROM ret WHERE r IS NOT NULL GROUP BY 1),
x AS (SELECT date, r, count(r) OVER b AS seen, CASE WHEN count(r) OVER l3 = 3 THEN list_reduce(list_prepend(1.0, list(r) OVER l3), lambda a, v: a * (1 + v)) - 1 END AS rs, CASE WHEN count(r) OVER l5 = 5 THEN list_reduce(list_prepend(1.0, list(r) OVER l5), lambda a, v: a * (1 + v)) - 1 END AS rl,
 CASE WHEN count(r) OVER l5 = 5 THEN stddev_pop(r) OVER l5 END AS vol, list_reduce(list_prepend(1.0, list(r) OVER b), lambda a, v: a * (1 + v)) AS level FROM d WINDOW b AS (ORDER BY date ROWS UNBOUNDED PRECEDING), l3 AS (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), l5 AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, level / max(level) OVER b - 1 AS dd, list_filter(list(vol) OVER b, lambda v: v IS NOT NULL) AS vs FROM x WINDOW b AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, CASE WHEN vol IS NOT NULL AND len(vs) >= 3 THEN len(list_filter(vs, lambda v: v <= vol))::DOUBLE / len(vs) END AS vr FROM y)
SELECT date, round(rs, 6) AS ret_short, round(rl, 6) AS ret_long, round(dd, 6) AS drawdown, CASE WHEN rl IS NOT NULL THEN CASE WHEN dd <= -0.2 AND rs < 0 THEN 'CRASH_STRESS' WHEN dd <= -0.2 AND rs > 0.05 THEN 'REBOUND' ELSE (CASE WHEN rl > 0.02 THEN 'BULL' WHEN rl < -0.02 THEN 'BEAR' ELSE 'SIDEWAYS' END) || CASE WHEN vr >= 0.7 THEN '_HIGH_VOL' ELSE '_LOW_VOL' END END END AS state, seen >= 10 AS history_sufficient FROM z"""))
def _(t):
    d = t.ret.filter("r is not null").groupBy("date").agg(F.avg("r").alias("r"))
    return X.regime_calendar(d, "r").select("date", "ret_short", "ret_long", "drawdown", "state", "history_sufficient")
