"""Queries: forward labels, episodes, per-entity windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.scalar import ln, ratio
from panelweave.functions.windows import over
from panelweave.operators import labels as L
from panelweave.operators import rolling as R
from panelweave.plans.registry import query, rd, sql

W = "OVER (PARTITION BY ticker ORDER BY date"


def _w():
    return over("ticker", order="date")


@query("r4_1_forward_label", sql("labelled", f"SELECT ticker, date, label, target_valid, first_hit_day, {rd('best')} FROM labelled"))
def _(t):
    return t.labelled.select("ticker", "date", "label", "target_valid", "first_hit_day", "best")


@query("r4_2_multi_horizon", sql("labelled", "SELECT ticker, date, CASE WHEN v THEN (c1 >= u)::INT END AS surge_d1, CASE WHEN v THEN (greatest(c1, c2) >= u)::INT END AS surge_d2, CASE WHEN v THEN (greatest(c1, c2, c3) >= u)::INT END AS surge_d3, CASE WHEN v THEN (least(c1, c2, c3) <= -u)::INT END AS crash_d3 FROM (SELECT *, c3 IS NOT NULL AS v, 0.6 - 1e-12 AS u FROM labelled)"))
def _(t):
    return L.multi_horizon_labels(t.ret, "r", threshold=0.6).select("ticker", "date", "surge_d1", "surge_d2", "surge_d3", "crash_d3")


@query("r4_3_move_direction", sql("labelled", "SELECT ticker, date, move, CASE WHEN move = 1 THEN (up >= 0.7)::INT ELSE -1 END AS direction, round(up - abs(down), 6) AS margin FROM (SELECT *, (greatest(up, abs(down)) >= 0.7)::INT AS move FROM (SELECT ticker, date, greatest(c1, c2, c3, 0.0) AS up, least(c1, c2, c3, 0.0) AS down FROM labelled WHERE c3 IS NOT NULL))"))
def _(t):
    return L.move_and_direction(t.ret, "r", threshold=0.7).select("ticker", "date", "move", "direction", "margin")


_RISK = """SELECT ticker, date, first_up, first_down, CASE WHEN first_up = 0 OR first_up >= 2 THEN (first_up = 2)::INT END AS h2, (first_up > 0 AND (first_down = 0 OR first_up <= first_down))::INT AS up_before_down, (first_down > 0 AND (first_up = 0 OR first_down < first_up))::INT AS down_before_up FROM (
SELECT ticker, date, CASE WHEN c1 >= 1.0 - 1e-12 THEN 1 WHEN c2 >= 1.0 - 1e-12 THEN 2 WHEN c3 >= 1.0 - 1e-12 THEN 3 ELSE 0 END AS first_up, CASE WHEN c1 <= -0.6 + 1e-12 THEN 1 WHEN c2 <= -0.6 + 1e-12 THEN 2 WHEN c3 <= -0.6 + 1e-12 THEN 3 ELSE 0 END AS first_down FROM labelled WHERE c3 IS NOT NULL)"""


@query("r4_4_competing_risks", sql("labelled", _RISK))
def _(t):
    return L.competing_risks(t.ret, "r", up=1.0, down=0.6).select("ticker", "date", "first_up", "first_down", "h2", "up_before_down", "down_before_up")


@query("r4_5_stronger_targets", sql("labelled", "SELECT ticker, date, (best >= 4.0 - 1e-12)::INT AS t4, (best >= 8.0 - 1e-12)::INT AS t8 FROM labelled WHERE target_valid"))
def _(t):
    return t.labelled.filter("target_valid").select("ticker", "date", *[(F.col("best") >= x - 1e-12).cast("int").alias(f"t{x:g}") for x in (4.0, 8.0)])


@query("r4_6_label_from_closes", sql("panel", f"SELECT ticker, date, CASE WHEN lead(close, 3) {W}) IS NOT NULL THEN (greatest(lead(close, 1) {W}), lead(close, 2) {W}), lead(close, 3) {W})) / close - 1 >= 3.0000001)::INT END AS label FROM panel"))
def _(t):
    leads = [F.lead("close", k).over(_w()) for k in (1, 2, 3)]
    return t.panel.select("ticker", "date", F.when(leads[2].isNotNull(), (ratio(F.greatest(*leads), F.col("close")) - 1 >= 3.0000001).cast("int")).alias("label"))


@query("r4_7_hazard_composition", sql("scored", "SELECT row_id, round(1 - (1 - score) * (1 - score / 2) * (1 - score / 4), 6) AS p_up FROM scored"))
def _(t):
    s = F.col("score")
    return t.scored.select("row_id", L.hazard_to_probability([s, s / 2, s / 4]).alias("p_up"))


@query("r4_8_maturity", sql("scored", ", c AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM panel)) SELECT row_id FROM scored WHERE date IN (SELECT date FROM c WHERE pos <= (SELECT max(pos) - 3 FROM c WHERE date <= DATE '2024-01-18'))"))
def _(t):
    return L.mature(t.scored, t.panel, "2024-01-18", 3).select("row_id")


_EPI = f""", f AS (SELECT *, target = 1 AS f FROM scored), g AS (SELECT *, sum((f IS DISTINCT FROM pf)::INT) {W}) AS run FROM (SELECT *, lag(f) {W}) AS pf FROM f))"""


@query("r4_9_episodes", sql("scored", f"{_EPI} SELECT ticker, run AS episode, min(date) AS start, max(date) AS \"end\", count(*) AS length, max((score >= 0.8)::INT) AS captured FROM g WHERE f GROUP BY 1, 2"))
def _(t):
    return L.episode_table(t.scored, F.col("target") == 1, alert=F.col("score") >= 0.8)


@query("r4_10_episode_weights", sql("scored", f"{_EPI} SELECT row_id, round(CASE WHEN f THEN 1.0 / count(*) OVER (PARTITION BY ticker, run) ELSE 1.0 END, 6) AS episode_weight FROM g"))
def _(t):
    return L.episodes(t.scored, F.col("target") == 1).select("row_id", "episode_weight")


@query("r5_1_changes", sql("panel", f"SELECT ticker, date, round(close - lag(close, 5) {W}), 6) AS change5, round((close - lag(close, 5) {W})) / greatest(abs(lag(close, 5) {W})), 1e-9), 6) AS ratio5 FROM panel"))
def _(t):
    return t.panel.select("ticker", "date", R.change(F.col("close"), 5, _w()).alias("change5"), R.ratio_change(F.col("close"), 5, _w()).alias("ratio5"))


def _frame(size, past=False):
    return f"{W} ROWS BETWEEN {size if past else size - 1} PRECEDING AND {'1 PRECEDING' if past else 'CURRENT ROW'})"


def _z(size, past, std, least):
    f = _frame(size, past)
    return f"CASE WHEN count(close) {f} >= {least} AND {std}(close) {f} > 1e-12 THEN (close - avg(close) {f}) / {std}(close) {f} END"


@query("r5_2_past_z", sql("panel", f"SELECT ticker, date, round(greatest(least(z, 8), -8), 6) AS z FROM (SELECT ticker, date, {_z(10, True, 'stddev_pop', 5)} AS z FROM panel) WHERE z IS NOT NULL"))
def _(t):
    return t.panel.select("ticker", "date", R.rolling_z(F.col("close"), _w(), 10, past_only=True, least=5, bound=8.0).alias("z")).filter("z is not null")


@query("r5_3_inclusive_z", sql("panel", f"SELECT ticker, date, round({_z(10, False, 'stddev_samp', 5)}, 6) AS z FROM panel"))
def _(t):
    return t.panel.select("ticker", "date", R.rolling_z(F.col("close"), _w(), 10, past_only=False, least=5, sample=True).alias("z"))


@query("r5_4_past_rank", sql("panel", f"SELECT ticker, date, CASE WHEN len(s) >= 4 THEN round((len(list_filter(s, lambda v: v < close)) + 0.5 * len(list_filter(s, lambda v: v = close))) / len(s), 6) END AS pr FROM (SELECT ticker, date, close, list(close) {_frame(8, True)} AS s FROM panel)"))
def _(t):
    return t.panel.select("ticker", "date", R.rolling_rank(F.col("close"), _w(), 8, past_only=True, least=4).alias("pr"))


@query("r5_5_inclusive_rank", sql("panel", f"SELECT ticker, date, round(len(list_filter(s, lambda v: v <= close)) / len(s), 6) AS pr FROM (SELECT ticker, date, close, list(close) {_frame(8)} AS s FROM panel)"))
def _(t):
    return t.panel.select("ticker", "date", R.rolling_rank(F.col("close"), _w(), 8, past_only=False, least=1).alias("pr"))


@query("r5_6_rolling_slope", sql("panel", f"SELECT ticker, date, round(CASE WHEN count(*) {_frame(7)} >= 5 THEN regr_slope(close, pos) {_frame(7)} END, 6) AS slope, round(sum(close) {_frame(7)}, 6) AS total FROM (SELECT *, CAST(row_number() {W}) AS DOUBLE) AS pos FROM panel)"))
def _(t):
    p = t.panel.withColumn("pos", F.row_number().over(_w()).cast("double"))
    return p.select("ticker", "date", R.rolling_slope(F.col("close"), F.col("pos"), _w(), 7, 5).alias("slope"), F.sum("close").over(_w().rowsBetween(-6, 0)).alias("total"))


@query("r5_7_rolling_beta", sql("panel", f"SELECT ticker, date, CASE WHEN ok THEN round(corr(close, v) {_frame(8)}, 6) END AS corr, CASE WHEN ok THEN round(covar_samp(close, v) {_frame(8)} / var_samp(v) {_frame(8)}, 6) END AS beta FROM (SELECT *, count(*) {_frame(8)} >= 5 AND stddev_pop(close) {_frame(8)} > 1e-12 AND stddev_pop(v) {_frame(8)} > 1e-12 AS ok FROM (SELECT ticker, date, close / 7 AS close, volume::DOUBLE AS v FROM panel))"))
def _(t):
    a, b = F.col("close") / 7, F.col("volume").cast("double")
    return t.panel.select("ticker", "date", R.rolling_pair("corr", a, b, _w(), 8, 5).alias("corr"), R.rolling_pair("beta", a, b, _w(), 8, 5).alias("beta"))


@query("r5_8_rolling_moments", sql("panel", f"SELECT ticker, date, CASE WHEN count(*) {_frame(10)} >= 6 THEN round(skewness(close / 100) {_frame(10)}, 6) END AS skew, CASE WHEN count(*) {_frame(10)} >= 6 THEN round(kurtosis(close / 100) {_frame(10)}, 6) END AS kurt FROM panel"))
def _(t):
    s, k = R.rolling_moments(F.col("close") / 100, _w(), 10, 6)
    return t.panel.select("ticker", "date", s.alias("skew"), k.alias("kurt"))


@query("r5_9_compound_return", sql("ret", f"SELECT ticker, date, CASE WHEN count(r) {_frame(4)} = 4 THEN round(list_reduce(list_prepend(1.0, list(r) {_frame(4)}), lambda a, v: a * (1 + v)) - 1, 6) END AS c4 FROM ret"))
def _(t):
    return t.ret.select("ticker", "date", R.compound(F.col("r"), _w(), 4).alias("c4"))


@query("r5_10_drawdown", sql("panel", f"SELECT ticker, date, round(close / max(close) {_frame(10)} - 1, 6) AS dd FROM panel"))
def _(t):
    return t.panel.select("ticker", "date", R.drawdown(F.col("close"), _w(), 10).alias("dd"))


@query("r5_11_rows_since_peak", sql("panel", f", p AS (SELECT *, row_number() {W}) AS pos, max(close) {W}) AS top FROM panel) SELECT ticker, date, pos - max(CASE WHEN close >= top THEN pos END) {W}) AS since FROM p"))
def _(t):
    return R.rows_since_peak(t.panel, "close", _w(), "since").select("ticker", "date", "since")


@query("r5_12_rows_since_low", sql("panel", f", p AS (SELECT *, row_number() {W}) AS pos, list({{'c': close, 'd': date}}) {_frame(6)} AS s FROM panel) SELECT ticker, date, len(list_filter(s, lambda x: x.d > (list_sort(list_filter(s, lambda y: y.c = list_min(list_transform(s, lambda z: z.c))), 'DESC')[1]).d)) AS since FROM p"))
def _(t):
    return R.rows_since_low(t.panel, "close", _w(), 6, "since").select("ticker", "date", "since")


@query("r5_13_signed_streak", sql("ret", f", s AS (SELECT *, CAST(coalesce(sign(r), 0) AS INTEGER) AS s FROM ret), n AS (SELECT *, CASE WHEN s = lag(s) {W}) THEN 0 ELSE 1 END AS nw FROM s), g AS (SELECT *, sum(nw) {W}) AS run FROM n) SELECT ticker, date, s * row_number() OVER (PARTITION BY ticker, run ORDER BY date) AS streak FROM g"))
def _(t):
    return R.signed_streak(t.ret, "r", _w(), "streak", "ticker").select("ticker", "date", "streak")


@query("r5_14_semivolatility", sql("ret", f"SELECT ticker, date, CASE WHEN count(r) {_frame(8)} >= 5 THEN round(sqrt(avg(CASE WHEN r IS NOT NULL THEN least(r, 0) * least(r, 0) END) {_frame(8)}), 6) END AS sv FROM ret"))
def _(t):
    return t.ret.select("ticker", "date", R.semivolatility(F.col("r"), _w(), 8, 5).alias("sv"))


@query("r5_15_expected_shortfall", sql("ret", f", q AS (SELECT ticker, date, count(r) {_frame(10)} AS n, list(r) {_frame(10)} AS s, quantile_cont(r, 0.2) {_frame(10)} AS c FROM ret) SELECT ticker, date, CASE WHEN n >= 6 THEN round(list_avg(list_filter(s, lambda v: v <= c + 1e-12)), 6) END AS es FROM q"))
def _(t):
    return t.ret.select("ticker", "date", R.expected_shortfall(F.col("r"), _w(), 10, 0.2, 6).alias("es"))


@query("r5_16_event_decay", sql("panel", f"SELECT ticker, date, round(coalesce(exp(-ln(2.0) / 5 * (date - max(CASE WHEN errors >= 2 THEN date END) {W}))), 0), 6) AS decay FROM panel"))
def _(t):
    return t.panel.select("ticker", "date", R.event_decay(F.col("errors") >= 2, F.col("date"), _w(), 5.0).alias("decay"))


@query("r5_17_event_counts", f"WITH d AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'signup') AS s, max(value) AS v FROM events GROUP BY 1, 2) SELECT ticker, date, sum(e) {_frame(5)} AS error_5, sum(e) {_frame(20)} AS error_20, sum(s) {_frame(5)} AS signup_5, sum(s) {_frame(20)} AS signup_20, max(v) {_frame(20)} AS max_severity FROM d")
def _(t):
    e = t.read("events").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"), "event_type", "value")
    return R.event_counts(e, "event_type", ["error", "signup"], "value")


@query("r5_18_self_state", sql("ret", f", p AS (SELECT *, lag(r, 1) {W}) AS p1, lag(r, 2) {W}) AS p2 FROM ret) SELECT ticker, date, round(avg(CASE WHEN p2 > 0 THEN p1 END) {_frame(10)}, 6) AS after_up, round(avg(CASE WHEN p2 < 0 THEN p1 END) {_frame(10)}, 6) AS after_down, round(avg(CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN (sign(p1) = sign(p2))::INT END) {_frame(10)}, 6) AS same_sign, round(sum(p1) {_frame(3)}, 6) AS sum3, round(sum(p1) {_frame(5)}, 6) AS sum5 FROM p"))
def _(t):
    return R.self_state(t.ret, "r").select("ticker", "date", "after_up", "after_down", "same_sign", "sum3", "sum5")


@query("r5_19_autocorrelation_map", sql("ret", f", x AS (SELECT ticker, k AS lag, r AS y, CASE k WHEN 1 THEN lag(r, 1) {W}) WHEN 2 THEN lag(r, 2) {W}) ELSE lag(r, 3) {W}) END AS x FROM (SELECT *, 1 AS k FROM ret) UNION ALL SELECT ticker, 2, r, lag(r, 2) {W}) FROM ret UNION ALL SELECT ticker, 3, r, lag(r, 3) {W}) FROM ret) SELECT ticker, lag, count(*) AS n, round(corr(x, y), 6) AS corr, round(avg(CASE WHEN x > 0 THEN (y > 0)::INT END), 6) AS up_after_up, round(avg(CASE WHEN x < 0 THEN (y < 0)::INT END), 6) AS down_after_down, CASE WHEN corr(x, y) > 0.05 THEN 'momentum' WHEN corr(x, y) < -0.05 THEN 'mean_reversion' ELSE 'none' END AS kind FROM x WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2"))
def _(t):
    return R.autocorrelation_map(t.ret, "r", [1, 2, 3])


_BAR = "b AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, arg_min(value, event_id) AS o, max(value) AS h, min(value) AS l, arg_max(value, event_id) AS c, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2)"


def bars(t):
    e = t.read("events")
    return e.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(F.min_by("value", "event_id").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", "event_id").alias("c"), F.count("*").cast("double").alias("v"))


@query("r5_20_range_volatility", f"WITH {_BAR} SELECT ticker, date, CASE WHEN count(*) {_frame(5)} >= 3 THEN round(sqrt(avg(ln(h / l) * ln(h / l)) {_frame(5)} / (4 * ln(2.0))), 6) END AS parkinson, CASE WHEN count(*) {_frame(5)} >= 3 THEN round(sqrt(greatest(avg(ln(h / o) * (ln(h / o) - ln(c / o)) + ln(l / o) * (ln(l / o) - ln(c / o))) {_frame(5)}, 0)), 6) END AS rogers_satchell FROM b")
def _(t):
    return R.range_volatility(bars(t), "o", "h", "l", "c").select("ticker", "date", "parkinson", "rogers_satchell")


_VOL = f"""WITH {_BAR}, g AS (SELECT *, ln(h / l) * ln(h / l) AS hl, 0.5 * ln(h / l) * ln(h / l) - (2 * ln(2.0) - 1) * ln(c / o) * ln(c / o) AS gk, ln(h / o) * (ln(h / o) - ln(c / o)) + ln(l / o) * (ln(l / o) - ln(c / o)) AS rs, ln(o / lag(c) {W})) AS gap, ln(c / o) AS co, ln(c / lag(c) {W})) AS r FROM b),
q AS (SELECT *, abs(r) * abs(lag(r) {W})) AS bp FROM g), z AS (SELECT *, sum(r * r) {_frame(5)} AS realised, 1.5707963267948966 * sum(bp) {_frame(5)} AS bipower FROM q)
SELECT ticker, date, o, h, l, c, v, CASE WHEN count(hl) {_frame(5)} >= 3 THEN round(sqrt(greatest(avg(hl) {_frame(5)} / (4 * ln(2.0)), 0)), 6) END AS parkinson, CASE WHEN count(hl) {_frame(5)} >= 3 THEN round(sqrt(greatest(avg(gk) {_frame(5)}, 0)), 6) END AS garman_klass, CASE WHEN count(hl) {_frame(5)} >= 3 THEN round(sqrt(greatest(avg(rs) {_frame(5)}, 0)), 6) END AS rogers_satchell,
  CASE WHEN count(gap) {_frame(5)} >= 3 THEN round(sqrt(greatest(var_samp(gap) {_frame(5)} + 0.34 / (1.34 + 6 / 4.0) * var_samp(co) {_frame(5)} + (1 - 0.34 / (1.34 + 6 / 4.0)) * avg(rs) {_frame(5)}, 0)), 6) END AS yang_zhang, CASE WHEN count(bp) {_frame(5)} >= 3 AND realised > 1e-12 THEN round(greatest(realised - bipower, 0) / realised, 6) END AS jump_share FROM z"""


@query("r5_20_range_volatility_full", _VOL)
def _(t):
    return R.range_volatility(bars(t), "o", "h", "l", "c")


@query("r5_21_microstructure", f"WITH {_BAR}, r AS (SELECT *, c / lag(c) {W}) - 1 AS r FROM b) SELECT ticker, date, CASE WHEN count(r) {_frame(5)} >= 3 THEN round(avg(abs(r) / (c * v)) {_frame(5)}, 6) END AS illiquidity, CASE WHEN h <> l THEN round((2 * c - h - l) / (h - l), 6) END AS close_location, CASE WHEN count(r) {_frame(5)} >= 3 THEN round(sum(sign(r) * v) {_frame(5)}, 6) END AS signed_volume, round(v / avg(v) {_frame(5, True)}, 6) AS turnover_shock FROM r")
def _(t):
    return R.microstructure(bars(t), "o", "h", "l", "c", "v").select("ticker", "date", "illiquidity", "close_location", "signed_volume", "turnover_shock")


@query("r5_22_limit_stress", f"WITH {_BAR}, r AS (SELECT *, c / lag(c) {W}) - 1 AS r, o / lag(c) {W}) - 1 AS g FROM b) SELECT ticker, date, CASE WHEN h <> l THEN round((c - l) / (h - l), 6) END AS close_to_low, round(least(g, 0.0), 6) AS gap_down, round(c / h - 1, 6) AS selloff, sum(CASE WHEN r <= -0.5 THEN 1 ELSE 0 END) {_frame(5)} AS extreme_falls FROM r")
def _(t):
    return R.limit_stress(bars(t), "o", "h", "l", "c", bar=0.5).select("ticker", "date", "close_to_low", F.when(F.lag("c").over(_w()).isNotNull(), F.col("gap_down")).otherwise(F.lit(0.0)).alias("gap_down"), "selloff", "extreme_falls")


@query("r5_23_tail_dependence", sql("ret", f", m AS (SELECT date, avg(r) AS m FROM ret GROUP BY 1), x AS (SELECT ticker, date, r, m FROM ret JOIN m USING (date)) SELECT ticker, date, CASE WHEN count(r) {_frame(10)} >= 5 THEN round(avg(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN (m < 0.5 AND r < 0)::INT END) {_frame(10)}, 6) END AS co_fall FROM x"))
def _(t):
    m = t.ret.groupBy("date").agg(F.avg("r").alias("m"))
    x = t.ret.join(F.broadcast(m), "date").withColumn("m0", F.col("m") - 0.5)
    return R.tail_dependence(x, "r", "m0").select("ticker", "date", "co_fall")


@query("r5_24_price_block", sql("ret", f"SELECT ticker, date, round(close / lag(close, 3) {W}) - 1, 6) AS ret3, round(close / avg(close) {_frame(5)} - 1, 6) AS gap5, round(CASE WHEN count(r) {_frame(5)} >= 5 THEN stddev_pop(r) {_frame(5)} END, 6) AS vol5, round(buys::DOUBLE / volume, 6) AS flow, round(ln(close), 6) AS log_size FROM ret"))
def _(t):
    c = F.col("close")
    return t.ret.select("ticker", "date", (ratio(c, F.lag(c, 3).over(_w())) - 1).alias("ret3"), (ratio(c, F.avg(c).over(_w().rowsBetween(-4, 0))) - 1).alias("gap5"), F.when(F.count("r").over(_w().rowsBetween(-4, 0)) >= 5, F.stddev_pop("r").over(_w().rowsBetween(-4, 0))).alias("vol5"), (F.col("buys") / F.col("volume")).alias("flow"), ln(c).alias("log_size"))


@query("r5_25_flow_block", sql("panel", f", f AS (SELECT *, buys::DOUBLE / volume AS f FROM panel) SELECT ticker, date, round(sum(f) {_frame(5)}, 6) AS sum5, round(f - lag(f, 1) {W}), 6) AS change1, round((f - lag(f, 1) {W})) - (lag(f, 1) {W}) - lag(f, 2) {W})), 6) AS acceleration, round(f - errors::DOUBLE / volume, 6) AS divergence FROM f"))
def _(t):
    p = t.panel.withColumn("f", F.col("buys") / F.col("volume"))
    f, l1, l2 = F.col("f"), F.lag("f", 1).over(_w()), F.lag("f", 2).over(_w())
    return p.select("ticker", "date", F.sum("f").over(_w().rowsBetween(-4, 0)).alias("sum5"), (f - l1).alias("change1"), ((f - l1) - (l1 - l2)).alias("acceleration"), (f - F.col("errors") / F.col("volume")).alias("divergence"))


@query("r5_26_index_features", sql("panel", ", d AS (SELECT date, sum(close) AS c FROM panel GROUP BY 1) SELECT date, round(c / lag(c, 1) OVER w - 1, 6) AS r1, round(c / lag(c, 5) OVER w - 1, 6) AS r5, round(lag(c, 1) OVER w, 6) AS foreign_lag, round(c / max(c) OVER (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) - 1, 6) AS dd FROM d WINDOW w AS (ORDER BY date)"))
def _(t):
    d, w = t.panel.groupBy("date").agg(F.sum("close").alias("c")), Window.orderBy("date")
    c = F.col("c")
    return d.select("date", (c / F.lag(c, 1).over(w) - 1).alias("r1"), (c / F.lag(c, 5).over(w) - 1).alias("r5"), F.lag(c, 1).over(w).alias("foreign_lag"), R.drawdown(c, w, 10).alias("dd"))


@query("r5_27_macro_lag", sql("monthly", ", m AS (SELECT date, sum(rev) AS v FROM monthly GROUP BY 1) SELECT CAST(date + 31 AS DATE) AS available, round(lag(v, 1) OVER w, 2) AS lagged, round(lag(v, 1) OVER w - lag(v, 6) OVER w, 2) AS change5 FROM m WINDOW w AS (ORDER BY date)"))
def _(t):
    m, w = t.monthly.groupBy("date").agg(F.sum("rev").alias("v")), Window.orderBy("date")
    return m.select(F.date_add("date", 31).alias("available"), F.round(F.lag("v", 1).over(w), 2).alias("lagged"), F.round(F.lag("v", 1).over(w) - F.lag("v", 6).over(w), 2).alias("change5"))


@query("r5_28_driver_links", sql("ret", f", m AS (SELECT bucket, date, avg(r) AS d FROM ret GROUP BY 1, 2), rule(bucket, driver) AS (VALUES ('B0', 'B1'), ('B1', 'B2'), ('B2', 'B0')), x AS (SELECT x.ticker, x.date, x.r, m.d FROM ret x JOIN rule USING (bucket) JOIN m ON m.bucket = rule.driver AND m.date = x.date) SELECT ticker, date, CASE WHEN count(r) {_frame(10)} >= 6 AND n THEN round(corr(r, d) {_frame(10)}, 6) END AS link FROM (SELECT *, stddev_pop(r) {_frame(10)} > 1e-12 AS n FROM (SELECT ticker, date, CASE WHEN d IS NOT NULL THEN r END AS r, CASE WHEN r IS NOT NULL THEN d END AS d FROM x))"))
def _(t):
    drivers = t.ret.groupBy(F.col("bucket").alias("driver"), "date").agg(F.avg("r").alias("d"))
    rules = t.spark.createDataFrame([("B0", "B1"), ("B1", "B2"), ("B2", "B0")], "bucket string, driver string")
    x = t.ret.join(F.broadcast(rules), "bucket").join(F.broadcast(drivers), ["driver", "date"])
    return x.select("ticker", "date", R.rolling_pair("corr", F.col("r"), F.col("d"), _w(), 10, 6).alias("link"))


@query("r5_29_sequences", sql("panel", f", s AS (SELECT ticker, date, list(close) {_frame(5)} AS s FROM panel) SELECT ticker, date, round(s[1], 6) AS first, round(s[5], 6) AS last FROM s WHERE len(s) = 5"))
def _(t):
    return R.sequences(t.panel, ["date", "close"], 5).select("ticker", "date", F.col("window")[0]["close"].alias("first"), F.col("window")[4]["close"].alias("last"))
