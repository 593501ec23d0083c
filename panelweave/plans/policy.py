"""Queries: pooling of effects, alert policies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions import scalar as S
from panelweave.functions.windows import over
from panelweave.operators import hierarchy as H
from panelweave.operators import policy as P
from panelweave.operators import stats as T
from panelweave.plans.registry import query, sql
from panelweave.plans.stats import FV, auc_sql, greedy_sql

EFF = "eff AS (SELECT ticker, market, bucket, fold_id, count(*)::DOUBLE AS n, round(avg(score - target) / 7, 12) AS x FROM scored GROUP BY 1, 2, 3, 4)"


def effects(t):
    return t.scored.groupBy("ticker", "market", "bucket", "fold_id").agg(F.count("*").cast("double").alias("n"), F.round(F.avg(F.col("score") - F.col("target")) / 7, 12).alias("x"))


@query("r8_1_prior_without_self", sql("scored", f", {EFF} SELECT ticker, fold_id, CASE WHEN sum(n) OVER w - n > 1e-12 THEN round((sum(x * n) OVER w - x * n) / (sum(n) OVER w - n), 6) END AS prior FROM eff WINDOW w AS (PARTITION BY fold_id, bucket)"))
def _(t):
    return H.prior_without_self(effects(t), ["fold_id", "bucket"], "x", "n", "prior").select("ticker", "fold_id", "prior")


_RING = "CASE WHEN {w} > 1e-9 THEN round(({wx}) / ({w}), 6) END AS {r}_mean, CASE WHEN {w} > 1e-9 THEN round(({w}) * ({w}) / ({w2}), 6) END AS {r}_neff"


@query("r8_2_peer_rings", sql("scored", f", {EFF}, s AS (SELECT ticker, fold_id, n AS w0, n * n AS w20, n * x AS wx0, " + ", ".join(f"sum({e}) OVER {w} AS {k}{i}" for k, e in (("w", "n"), ("w2", "n * n"), ("wx", "n * x")) for i, w in ((1, "wb"), (2, "wm"), (3, "wt"))) + " FROM eff WINDOW wb AS (PARTITION BY fold_id, market, bucket), wm AS (PARTITION BY fold_id, market), wt AS (PARTITION BY fold_id)) SELECT ticker, fold_id, " + ", ".join(_RING.format(r=r, w=f"w{a} - w{b}", w2=f"w2{a} - w2{b}", wx=f"wx{a} - wx{b}") for r, a, b in (("bucket", 1, 0), ("market", 2, 1), ("rest", 3, 2))) + " FROM s"))
def _(t):
    r = H.peer_rings(effects(t), ["fold_id"], "bucket", "market", "x", "n")
    return r.select("ticker", "fold_id", *[f"{k}_{m}" for k in ("bucket", "market", "rest") for m in ("mean", "neff")])


_PRIOR = f", {EFF}, p AS (SELECT *, (sum(x * n) OVER wb - x * n) / nullif(sum(n) OVER wb - n, 0) AS pb, (sum(x * n) OVER wm - x * n) / nullif(sum(n) OVER wm - n, 0) AS pm FROM eff WINDOW wb AS (PARTITION BY fold_id, bucket), wm AS (PARTITION BY fold_id, market)), q AS (SELECT *, round((coalesce(pb * 0.6, 0) + coalesce(pm * 0.4, 0)) / nullif((pb IS NOT NULL)::INT * 0.6 + (pm IS NOT NULL)::INT * 0.4, 0), 9) AS prior FROM p)"


def pooled(t):
    e = H.prior_without_self(H.prior_without_self(effects(t), ["fold_id", "bucket"], "x", "n", "pb"), ["fold_id", "market"], "x", "n", "pm")
    return e.withColumn("prior", F.round(H.combined_prior([(F.col("pb"), 0.6), (F.col("pm"), 0.4)]), 9))


@query("r8_3_combined_prior", sql("scored", f"{_PRIOR} SELECT ticker, fold_id, round(prior, 6) AS prior FROM q"))
def _(t):
    return pooled(t).select("ticker", "fold_id", "prior")


@query("r8_4_partial_pooling", sql("scored", f"{_PRIOR} SELECT ticker, fold_id, strength, round(n / (n + strength) * sqrt(0.8), 6) AS reliability, round(n / (n + strength) * sqrt(0.8) * x + (1 - n / (n + strength) * sqrt(0.8)) * coalesce(prior, 0), 6) AS posterior FROM q, (VALUES (2.0), (5.0), (10.0)) s(strength)"))
def _(t):
    base, out = pooled(t), None
    for s in (2.0, 5.0, 10.0):
        one = H.partial_pooling(base, "x", "prior", "n", F.lit(0.8), s).withColumn("strength", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out.select("ticker", "fold_id", "strength", "reliability", "posterior")


_TAX = "CASE WHEN n / (n + 5) < 0.3 THEN 'LOW_EVIDENCE' WHEN abs(x) < 0.02 AND abs(coalesce(prior, 0)) < 0.02 THEN 'WEAK' WHEN prior IS NULL OR abs(prior) < 0.02 THEN 'UNIQUE' WHEN sign(x) <> sign(prior) THEN 'REVERSAL' WHEN abs(x) > 1.5 * abs(prior) THEN 'AMPLIFIED' WHEN abs(x) * 1.5 < abs(prior) THEN 'DAMPENED' ELSE 'SHARED' END"


@query("r8_5_taxonomy", sql("scored", f"{_PRIOR} SELECT ticker, fold_id, {_TAX} AS kind FROM q"))
def _(t):
    return pooled(t).select("ticker", "fold_id", H.taxonomy(F.col("x"), F.col("prior"), F.col("n") / (F.col("n") + 5)).alias("kind"))


@query("r8_6_sensitivity", sql("scored", f"{_PRIOR}, l AS (SELECT ticker, n / (n + s) * x + (1 - n / (n + s)) * coalesce(prior, 0) AS e FROM q, (VALUES (2.0), (5.0), (10.0)) v(s)) SELECT ticker, count(*) AS strengths, round(quantile_cont(e, 0.5), 6) AS median, round(min(abs(e * 10)), 6) AS least_z, round(greatest(count(*) FILTER (e > 1e-12), count(*) FILTER (e < -1e-12))::DOUBLE / nullif(count(*) FILTER (abs(e) > 1e-12), 0), 6) AS consistency FROM l GROUP BY ticker"))
def _(t):
    base, out = pooled(t), None
    for s in (2.0, 5.0, 10.0):
        one = H.partial_pooling(base, "x", "prior", "n", F.lit(1.0), s).select("ticker", F.col("posterior").alias("e"), (F.col("posterior") * 10).alias("z"))
        out = one if out is None else out.unionByName(one)
    return H.sensitivity(out, ["ticker"], "e", "z").drop("p")


@query("r8_7_separator_dedup", sql("features", ", c AS (SELECT feature, fold_id, round(abs(corr(value, target)), 9) AS s FROM features WHERE value IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY s DESC, fold_id) AS n FROM c WHERE s IS NOT NULL AND NOT isnan(s)) SELECT feature, fold_id, round(s, 6) AS s, row_number() OVER (ORDER BY s DESC, feature) AS place FROM b WHERE n = 1"))
def _(t):
    from panelweave.functions.windows import complete_corr

    c = t.features.filter("value is not null").groupBy("feature", "fold_id").agg(F.round(F.abs(complete_corr(F.col("value"), F.col("target"))), 9).alias("s")).filter("s is not null")
    b = c.withColumn("n", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("s"), "fold_id"))).filter("n = 1").drop("n")
    return b.withColumn("place", F.row_number().over(Window.orderBy(F.desc("s"), "feature")))


@query("r8_8_entity_similarity", sql("scored", ", e AS (SELECT market || bucket AS k, fold_id AS node, round(avg(score - target), 9) AS x FROM scored GROUP BY 1, 2), p AS (SELECT a.k AS a, b.k AS b, a.x AS x, b.x AS y FROM e a JOIN e b ON a.node = b.node AND a.k <> b.k), r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM p), s AS (SELECT a, b, round(0.6 * sum(x * y) / sqrt(sum(x * x) * sum(y * y)) + 0.4 * corr(rx, ry), 9) AS similarity FROM r GROUP BY 1, 2) SELECT a, b, round(similarity, 6) AS similarity, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS n FROM s) WHERE n <= 3"))
def _(t):
    e = t.scored.groupBy(F.concat("market", "bucket").alias("k"), F.col("fold_id").alias("node")).agg(F.round(F.avg(F.col("score") - F.col("target")), 9).alias("x"))
    return H.entity_similarity(e, "k", "node", "x").select("a", "b", "similarity", "rank")


@query("r8_9_driver_profiles", sql("features", ", m AS (SELECT ticker, feature, round(avg(value * (2 * target - 1)), 6) AS e FROM features WHERE value IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(e) DESC, feature) AS n FROM m) SELECT ticker, string_agg(feature, ',' ORDER BY n) AS drivers FROM k WHERE n <= 3 GROUP BY ticker"))
def _(t):
    m = t.features.filter("value is not null").groupBy("ticker", "feature").agg(F.round(F.avg(F.col("value") * (2 * F.col("target") - 1)), 6).alias("e"))
    k = m.withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc(F.abs("e")), "feature"))).filter("n <= 3")
    return k.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "feature"))), lambda s: s["feature"]), ",").alias("drivers"))


@query("r8_10_label_audit", "SELECT count(*) AS n, round(avg((p_type = 'ECONOMY')::INT), 6) AS unknown_ratio, count(DISTINCT p_brand) AS levels, round((SELECT count(*) FILTER (k > 1)::DOUBLE / count(*) FROM (SELECT count(*) AS k FROM part GROUP BY p_brand)), 6) AS shared FROM part")
def _(t):
    p = t.read("part")
    shared = p.groupBy("p_brand").agg(F.count("*").alias("k")).agg(F.avg((F.col("k") > 1).cast("double")).alias("shared"))
    return p.agg(F.count("*").alias("n"), F.avg((F.col("p_type") == "ECONOMY").cast("double")).alias("unknown_ratio"), F.count_distinct("p_brand").alias("levels")).crossJoin(shared)


@query("r8_11_adaptive_eligibility", sql("scored", ", c AS (SELECT ticker, fold_id, count(*) AS n, sum(target) AS pos FROM scored GROUP BY 1, 2), d AS (SELECT *, CAST(CASE WHEN fold_id >= 4 THEN least(5, greatest(2, ceil(0.5 * max(n) OVER (PARTITION BY ticker)))) ELSE 5 END AS BIGINT) AS need FROM c) SELECT ticker, fold_id, need, n >= need AND pos >= 1 AND n - pos >= 1 AS eligible FROM d"))
def _(t):
    c = t.scored.groupBy("ticker", "fold_id").agg(F.count("*").alias("n"), F.sum("target").alias("pos"))
    return H.adaptive_eligibility(c, recent_from=4, rows=5, fraction=0.5, floor=2, least_pos=1, least_neg=1).select("ticker", "fold_id", "need", "eligible")


_STATE = ", st AS (SELECT market, feature, quantile_cont(value, 0.5) AS c, CASE WHEN (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 > 1e-9 THEN (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 WHEN stddev_pop(value) > 1e-9 THEN stddev_pop(value) ELSE 1 END AS s FROM features WHERE fold_id < 3 AND value IS NOT NULL GROUP BY 1, 2)"


def state(t):
    return H.robust_state(t.features.filter("fold_id < 3 and value is not null"), ["market", "feature"])


@query("r8_12_robust_state", sql("features", f"{_STATE} SELECT market, feature, round(c, 6) AS centre, round(s, 6) AS scale FROM st"))
def _(t):
    return state(t)


_DIR = [("f_close", -1, 2.0), ("f_volume", 1, 1.0), ("f_ret", -1, 1.5)]


@query("r8_13_evidence", sql("features", f"{_STATE}, dr(feature, direction, weight) AS (VALUES {', '.join(map(str, _DIR))}), z AS (SELECT row_id, weight, greatest(least((value - c) / s, 6), -6) * direction AS z FROM features JOIN st USING (market, feature) JOIN dr USING (feature) WHERE fold_id >= 3 AND value IS NOT NULL) SELECT row_id, count(*) AS slots, round(sum(z * weight) / sum(weight), 5) AS mean, round(min(z), 6) AS low, round(max(z), 6) AS high, round(avg((z > 0.5)::INT), 6) AS favourable, round(avg((z < -0.5)::INT), 6) AS adverse FROM z GROUP BY row_id"))
def _(t):
    d = t.spark.createDataFrame(_DIR, "feature string, direction int, weight double")
    return H.evidence(t.features.filter("fold_id >= 3"), state(t), d, ["market", "feature"]).drop("std").withColumn("mean", F.round("mean", 5))


@query("r8_14_smoothed_prior", sql("scored", ", g AS (SELECT ticker, sum(target) AS h, count(*) AS n FROM scored GROUP BY 1), p AS (SELECT ticker, (h + 80 * (SELECT avg(target) FROM scored)) / (n + 80) AS p FROM g) SELECT ticker, round(p, 6) AS prior, round(ln(p / (1 - p)), 6) AS prior_logit FROM p"))
def _(t):
    return H.smoothed_prior(t.scored, "ticker", "target").select("ticker", "prior", "prior_logit")


_TOP = ", k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, row_id) AS n, count(*) OVER (PARTITION BY date) AS m FROM scored)"


@query("r9_1_daily_top", sql("scored", f"{_TOP} SELECT row_id FROM k WHERE n <= greatest(ceil(m * 0.05), 1)"))
def _(t):
    return P.daily_top(t.scored, "score", 0.05).filter("alert").select("row_id")


@query("r9_2_daily_budget", sql("scored", f"{_TOP} SELECT row_id FROM k WHERE n <= least(floor(m * 0.04 + 1e-12), 5)"))
def _(t):
    return P.daily_budget(t.scored, "score", 0.04, 5).filter("alert").select("row_id")


@query("r9_3_biased_budget", sql("scored", ", k AS (SELECT row_id, row_number() OVER (PARTITION BY date ORDER BY score + CASE market WHEN 'M0' THEN 0.1 WHEN 'M1' THEN -0.05 ELSE 0 END DESC, row_id) AS n FROM scored) SELECT row_id FROM k WHERE n <= 4"))
def _(t):
    return P.daily_budget(t.scored, P.with_bias("score", "market", {"M0": 0.1, "M1": -0.05}), 1.0, 4).filter("alert").select("row_id")


@query("r9_4_pooled_top", sql("scored", "SELECT row_id, score FROM scored ORDER BY score DESC, row_id LIMIT (SELECT CAST(ceil(count(*) * 0.03) AS BIGINT) FROM scored)"))
def _(t):
    return P.pooled_top(t.scored, "score", 0.03).select("row_id", "score")


_CONF = "SELECT {by} n, tp, fp, fn, tn, alert_days, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity, round((tp + fp)::DOUBLE / n, 6) AS alert_rate, round(tp::DOUBLE / nullif(tp + fp, 0) / ((tp + fn)::DOUBLE / n), 6) AS lift FROM (SELECT {by} count(*) AS n, count(*) FILTER (a AND target = 1) AS tp, count(*) FILTER (a AND target = 0) AS fp, count(*) FILTER (NOT a AND target = 1) AS fn, count(*) FILTER (NOT a AND target = 0) AS tn, count(DISTINCT CASE WHEN a THEN date END) AS alert_days FROM (SELECT *, n <= greatest(ceil(m * 0.05), 1) AS a FROM (SELECT * EXCLUDE n, n AS n FROM k)) GROUP BY ALL)"


@query("r9_5_confusion", sql("scored", _TOP + " " + _CONF.format(by="fold_id,")))
def _(t):
    return P.confusion(P.daily_top(t.scored, "score", 0.05), F.col("alert"), by=["fold_id"])


@query("r9_6_wilson", sql("scored", ", c AS (SELECT ticker, sum(target) AS k, count(*) AS n FROM scored GROUP BY 1) SELECT ticker, round(greatest(((k / n) + 1.959964 * 1.959964 / (2 * n) - 1.959964 * sqrt(((k / n) * (1 - k / n) + 1.959964 * 1.959964 / (4 * n)) / n)) / (1 + 1.959964 * 1.959964 / n), 0), 6) AS low FROM c"))
def _(t):
    return t.scored.groupBy("ticker").agg(F.sum("target").alias("k"), F.count("*").alias("n")).select("ticker", S.wilson_lower(F.col("k"), F.col("n")).alias("low"))


@query("r9_7_beta_bound")
def _(t):
    return P.beta_lower_bound(t.scored.groupBy("market", "fold_id").agg(F.sum("target").alias("hits"), F.sum(1 - F.col("target")).alias("misses")), "hits", "misses")


CURVE = ", g AS (SELECT market, score, count(*) AS k, sum(target) AS p FROM scored GROUP BY 1, 2), c AS (SELECT market, score, sum(k) OVER w AS alerts, sum(p) OVER w AS tp, sum(p) OVER v AS positives, sum(k) OVER v AS rows FROM g WINDOW w AS (PARTITION BY market ORDER BY score DESC), v AS (PARTITION BY market))"


@query("r9_8_recall_threshold", sql("scored", f"{CURVE} SELECT market, max(score) AS threshold, round(max_by(tp / alerts, score), 6) AS precision, max_by(alerts, score) AS alerts FROM c WHERE tp >= ceil(positives * 0.3) GROUP BY market"))
def _(t):
    return P.threshold_for_recall(t.scored, 0.3, ["market"])


@query("r9_9_policy_choice", sql("scored", ", g(threshold) AS (VALUES (0.5), (0.6), (0.7), (0.8), (0.9)), m AS (SELECT threshold, count(*) FILTER (score >= threshold) AS alerts, count(*) FILTER (score >= threshold AND target = 1) AS tp, sum(target) AS p, count(*) AS n FROM scored, g GROUP BY 1) SELECT threshold, round(tp::DOUBLE / p, 6) AS recall, round(alerts::DOUBLE / n, 6) AS alert_rate FROM m WHERE tp::DOUBLE / p >= 0.25 ORDER BY alerts, threshold DESC LIMIT 1"))
def _(t):
    grid = t.spark.createDataFrame([(x,) for x in (0.5, 0.6, 0.7, 0.8, 0.9)], "threshold double")
    m = P.at_thresholds(t.scored, grid, [])
    return m.filter(F.col("tp") / F.col("positives") >= 0.25).orderBy("alerts", F.desc("threshold")).limit(1).select("threshold", (F.col("tp") / F.col("positives")).alias("recall"), (F.col("alerts") / F.col("rows")).alias("alert_rate"))


@query("r9_10_minimax_budget", sql("scored", ", q(fraction) AS (VALUES (0.02), (0.05), (0.1), (0.2)), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, row_id) AS place_, count(*) OVER (PARTITION BY date) AS m FROM scored), f AS (SELECT fraction, fold_id, count(*) AS n, count(*) FILTER (place_ <= least(floor(m * fraction + 1e-12), 20)) AS alerts, count(*) FILTER (place_ <= least(floor(m * fraction + 1e-12), 20) AND target = 1) AS tp, sum(target) AS p FROM k, q GROUP BY 1, 2), h AS (SELECT *, coalesce(tp::DOUBLE / nullif(p, 0), 0) AS rec, coalesce((tp * n)::DOUBLE / nullif(alerts * p, 0), 0) AS lift FROM f), s AS (SELECT fraction, avg((rec >= 0.05 AND lift >= 1.1)::INT) AS pass_rate, min(rec) AS least_recall, min(lift) AS least_lift, sum(alerts)::DOUBLE / sum(n) AS alert_rate FROM h GROUP BY 1) SELECT fraction, round(pass_rate, 6) AS pass_rate, round(least_recall, 6) AS least_recall, round(least_lift, 6) AS least_lift, round(alert_rate, 6) AS alert_rate, row_number() OVER (ORDER BY pass_rate DESC, least_recall DESC, least_lift DESC, alert_rate, fraction) AS place FROM s"))
def _(t):
    return P.minimax_budget(t.scored, t.spark.createDataFrame([(x,) for x in (0.02, 0.05, 0.1, 0.2)], "fraction double"), "fold_id", cap=20, recall=0.05, lift=1.1)


@query("r9_11_precision_curve", sql("scored", ", k AS (SELECT fold_id, row_number() OVER w AS k, sum(target) OVER w AS tp, sum(target) OVER (PARTITION BY fold_id) AS p FROM scored WINDOW w AS (PARTITION BY fold_id ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING)), b AS (SELECT fold_id, k, tp / k AS prec, tp / p AS rec FROM k WHERE k >= 10), m AS (SELECT fold_id, max(prec) AS best FROM b GROUP BY 1) SELECT fold_id, round(any_value(best), 6) AS best_precision, min(CASE WHEN prec = best THEN k END) AS best_alerts, round(max(CASE WHEN prec >= 0.3 THEN rec END), 6) AS recall_at_precision FROM b JOIN m USING (fold_id) GROUP BY fold_id"))
def _(t):
    return P.precision_curve_best(t.scored, ["fold_id"], least_alerts=10, precision=0.3)


_OK = "tp / alerts >= 0.25 AND alerts >= 15"


@query("r9_12_safe_threshold", sql("scored", f"{CURVE}, o AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY tp / positives DESC, score DESC) AS n FROM c WHERE {_OK}), m AS (SELECT DISTINCT market, positives FROM c) SELECT market, coalesce(o.score, 'inf'::DOUBLE) AS threshold, coalesce(o.alerts, 0) AS alerts, coalesce(o.tp, 0) AS tp, m.positives FROM m LEFT JOIN (SELECT * FROM o WHERE n = 1) o USING (market)"))
def _(t):
    return P.safest_threshold(t.scored, ["market"], precision=0.25, least_alerts=15)


_GRID = "gr AS (SELECT DISTINCT unnest(quantile_cont(score, [0.5, 0.7, 0.8, 0.9, 0.95])) AS threshold FROM scored UNION SELECT 0.65)"


def grid_of(t):
    q = t.scored.agg(F.percentile("score", F.array(*map(F.lit, [0.5, 0.7, 0.8, 0.9, 0.95]))).alias("q")).select(F.explode("q").alias("threshold"))
    return q.unionByName(t.spark.createDataFrame([(0.65,)], "threshold double")).distinct()


@query("r9_13_threshold_grid", sql("scored", f", {_GRID} SELECT round(threshold, 6) AS threshold FROM gr"))
def _(t):
    return grid_of(t)


@query("r9_14_grid_policy", sql("scored", f", {_GRID} SELECT fold_id, round(threshold, 6) AS threshold, count(*) FILTER (score >= threshold) AS alerts, count(*) FILTER (score >= threshold AND target = 1) AS tp, sum(target) AS positives, count(*) AS rows FROM scored, gr GROUP BY fold_id, gr.threshold"))
def _(t):
    return P.at_thresholds(t.scored, grid_of(t), ["fold_id"])


@query("r9_15_scope_policy", sql("scored", f"{CURVE}, o AS (SELECT market, score, row_number() OVER (PARTITION BY market ORDER BY tp / positives DESC, score DESC) AS n FROM c WHERE {_OK}), f AS (SELECT market, score AS th FROM o WHERE n = 1) SELECT row_id, score >= coalesce(th, 0.9) AS alert FROM scored LEFT JOIN f USING (market)"))
def _(t):
    th = P.safest_threshold(t.scored, ["market"], precision=0.25, least_alerts=15).select("market", F.when(F.col("threshold") < float("inf"), F.col("threshold")).alias("th"))
    return t.scored.join(F.broadcast(th), "market", "left").select("row_id", (F.col("score") >= F.coalesce("th", F.lit(0.9))).alias("alert"))


@query("r9_16_precision_curve_table", sql("scored", f"{CURVE} SELECT market, score, alerts, tp, round(tp / alerts, 6) AS precision, round(tp / positives, 6) AS recall FROM c"))
def _(t):
    return P.score_curve(t.scored, ["market"]).select("market", "score", "alerts", "tp", "precision", "recall")


@query("r9_17_cascade", sql("scored", ", c(i, s) AS (VALUES (0, -1e9), (1, 0.5), (2, 0.7)), d(j, v) AS (VALUES (0, -1e9), (1, 2.0), (2, 4.0)), m AS (SELECT i, j, count(*) AS alerts, sum(target) AS tp FROM scored, c, d WHERE score >= s AND volume >= v GROUP BY 1, 2) SELECT i AS c_score, j AS c_volume, alerts, tp, round(tp / alerts, 6) AS precision FROM m WHERE tp / alerts >= 0.1 AND alerts >= 10"))
def _(t):
    return P.cascade(t.scored, ["score", "volume"], {"score": [0.5, 0.7], "volume": [2.0, 4.0]}, precision=0.1, least_alerts=10)


@query("r9_18_frozen_threshold", sql("scored", ", g AS (SELECT score, count(*) AS k, sum(target) AS p FROM scored WHERE fold_id IN (2, 3) GROUP BY 1), c AS (SELECT score, sum(k) OVER (ORDER BY score DESC) AS alerts, sum(p) OVER (ORDER BY score DESC) AS tp FROM g), f AS (SELECT score AS th FROM c WHERE tp / alerts >= 0.2 AND alerts >= 20 ORDER BY tp DESC, score DESC LIMIT 1) SELECT fold_id, count(*) FILTER (score >= th) AS alerts, count(*) FILTER (score >= th AND target = 1) AS tp FROM scored, f WHERE fold_id >= 4 GROUP BY fold_id"))
def _(t):
    th = P.safest_threshold(t.scored.filter("fold_id in (2, 3)").withColumn("all", F.lit(1)), ["all"], precision=0.2, least_alerts=20).select(F.col("threshold").alias("th"))
    later = t.scored.filter("fold_id >= 4").crossJoin(F.broadcast(th))
    return later.groupBy("fold_id").agg(F.count_if(F.col("score") >= F.col("th")).alias("alerts"), F.count_if((F.col("score") >= F.col("th")) & (F.col("target") == 1)).alias("tp"))


@query("r9_19_policy_by_fold", sql("scored", "SELECT fold_id, count(*) FILTER (score >= 0.8) AS alerts, round(avg(CASE WHEN score >= 0.8 THEN target END), 6) AS precision, round(coalesce(sum(CASE WHEN score >= 0.8 THEN target END), 0)::DOUBLE / sum(target), 6) AS recall FROM scored GROUP BY fold_id"))
def _(t):
    return P.confusion(t.scored, F.col("score") >= 0.8, by=["fold_id"]).select("fold_id", (F.col("tp") + F.col("fp")).alias("alerts"), "precision", "recall")


@query("r9_20_scope_metrics", sql("scored", "SELECT market, bucket, count(*) AS n, sum((score >= 0.8)::INT) AS alerts, sum((score >= 0.8)::INT * target) AS tp, sum(target) AS positives, round(sum((score >= 0.8)::INT * target)::DOUBLE / nullif(sum((score >= 0.8)::INT), 0), 6) AS precision, round(sum((score >= 0.8)::INT * target)::DOUBLE / nullif(sum(target), 0), 6) AS recall FROM scored GROUP BY GROUPING SETS ((), (market), (bucket))"))
def _(t):
    return P.grouping_metrics(t.scored, ["market", "bucket"], F.col("score") >= 0.8)


@query("r9_21_tradeoff", sql("scored", ", q(fraction) AS (VALUES (0.01), (0.05), (0.1)), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, row_id) AS place_, count(*) OVER (PARTITION BY date) AS m FROM scored) SELECT fraction, count(*) FILTER (place_ <= greatest(ceil(m * fraction), 1)) AS alerts, round(sum(CASE WHEN place_ <= greatest(ceil(m * fraction), 1) THEN target END)::DOUBLE / sum(target), 6) AS recall FROM k, q GROUP BY fraction"))
def _(t):
    w = Window.partitionBy("date").orderBy(F.desc("score"), "row_id")
    k = t.scored.withColumns({"r": F.row_number().over(w), "m": F.count("*").over(Window.partitionBy("date"))})
    g = k.crossJoin(F.broadcast(t.spark.createDataFrame([(0.01,), (0.05,), (0.1,)], "fraction double")))
    a = F.col("r") <= F.greatest(F.ceil(F.col("m") * F.col("fraction")), F.lit(1))
    return g.groupBy("fraction").agg(F.count_if(a).alias("alerts"), (F.sum(F.when(a, F.col("target"))) / F.sum("target")).alias("recall"))


@query("r9_22_candidate_mask", sql("scored", ", k AS (SELECT row_id, (rank() OVER (PARTITION BY ticker, fold_id ORDER BY score) + (count(*) OVER (PARTITION BY ticker, fold_id, score) - 1) / 2.0) / count(*) OVER (PARTITION BY ticker, fold_id) AS pr FROM scored) SELECT row_id FROM k WHERE pr >= 0.75"))
def _(t):
    from panelweave.functions.windows import pct_rank

    return t.scored.withColumn("pr", pct_rank(F.col("score"), "ticker", "fold_id")).filter("pr >= 0.75").select("row_id")


@query("r9_23_alert_status", sql("ret", ", s AS (SELECT ticker, date, CASE WHEN errors > 2 THEN 0.6 ELSE 0.1 END AS missing, CASE WHEN day(date) > 2 THEN 'BULL' END AS regime, count(*) OVER (PARTITION BY ticker ORDER BY date) AS seen, r FROM ret) SELECT ticker, date, CASE WHEN missing > 0.5 THEN 'POOR_COVERAGE' WHEN regime IS NULL THEN 'NO_REGIME' WHEN seen < 5 THEN 'SHORT_HISTORY' WHEN r IS NULL THEN 'NO_SCORE' ELSE 'SCORED' END AS status FROM s"))
def _(t):
    seen = F.count("*").over(over("ticker", order="date").rowsBetween(Window.unboundedPreceding, 0))
    return t.ret.select("ticker", "date", P.alert_status(F.when(F.col("errors") > 2, 0.6).otherwise(0.1), F.when(F.dayofmonth("date") > 2, "BULL"), seen, F.col("r")).alias("status"))


@query("r9_24_gap_report", sql("scored", "SELECT fold_id, round(0.3 - avg(CASE WHEN score >= 0.8 THEN target END), 6) AS precision_gap, CASE WHEN avg(CASE WHEN score >= 0.8 THEN target END) >= 0.3 THEN 'NONE' WHEN avg(target) < 0.1 THEN 'BASE_RATE' ELSE 'RANKING' END AS bottleneck FROM scored GROUP BY fold_id"))
def _(t):
    p = F.avg(F.when(F.col("score") >= 0.8, F.col("target")))
    return t.scored.groupBy("fold_id").agg((0.3 - p).alias("precision_gap"), F.when(p >= 0.3, "NONE").when(F.avg("target") < 0.1, "BASE_RATE").otherwise("RANKING").alias("bottleneck"))


@query("r9_25_diverse_finalists", sql("features", greedy_sql(f"SELECT feature, row_number() OVER (ORDER BY abs(auc - 0.5) DESC, feature) AS i FROM ({auc_sql('feature', FV)})", "abs(pc.c) > 0.8", 3)).replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT unnest(range(0, len(kept))) AS place, unnest(kept) AS feature FROM g WHERE i = (SELECT max(i) FROM o)")
def _(t):
    """Features by AUC, each kept only if its correlation with those kept is at most 0.8; the greedy pass runs over the short ranked list."""
    a = T.auc(t.features, ["feature"]).withColumn("s", F.abs(F.col("auc") - 0.5))
    m = T.correlation_matrix(t.features).filter("abs(corr) > 0.8")
    near = m.select(F.col("a").alias("feature"), F.col("b").alias("o")).unionByName(m.select(F.col("b").alias("feature"), F.col("a").alias("o"))).groupBy("feature").agg(F.collect_set("o").alias("near"))
    r = a.join(near, "feature", "left").withColumn("near", F.coalesce("near", F.expr("cast(array() as array<string>)"))).agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "feature", "near"))).alias("r"))
    kept = F.aggregate("r", F.expr("cast(array() as array<string>)"), lambda acc, x: F.when(F.arrays_overlap(acc, x["near"]) | (F.size(acc) >= 3), acc).otherwise(F.concat(acc, F.array(x["feature"]))))
    return r.select(F.posexplode(kept).alias("place", "feature"))


@query("r9_26_screen_summary", sql("features", ", c AS (SELECT feature, fold_id, round(abs(corr(value, target)), 9) AS c FROM features WHERE value IS NOT NULL GROUP BY 1, 2), s AS (SELECT feature, round(avg(c), 9) AS m, round(min(c), 9) AS l FROM c WHERE c IS NOT NULL AND NOT isnan(c) GROUP BY 1), r AS (SELECT feature, m, round(0.7 * rank() OVER (ORDER BY m) / count(*) OVER () + 0.3 * rank() OVER (ORDER BY l) / count(*) OVER (), 9) AS s FROM s) SELECT feature, round(m, 6) AS mean, round(s, 6) AS screen FROM r"))
def _(t):
    from panelweave.functions.windows import complete_corr

    c = t.features.filter("value is not null").groupBy("feature", "fold_id").agg(F.round(F.abs(complete_corr(F.col("value"), F.col("target"))), 9).alias("c")).filter("c is not null")
    s = c.groupBy("feature").agg(F.round(F.avg("c"), 9).alias("mean"), F.round(F.min("c"), 9).alias("l"))
    n = F.count("*").over(Window.partitionBy())
    return s.select("feature", "mean", (0.7 * F.rank().over(Window.orderBy("mean")) / n + 0.3 * F.rank().over(Window.orderBy("l")) / n).alias("screen"))
