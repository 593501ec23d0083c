"""Queries: gates, profiles, forward candidates, bundles and reports over per-fold statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.windows import complete_corr, over, pct_rank
from panelweave.operators import evaluate as E
from panelweave.operators import policy as P
from panelweave.operators import screening as N
from panelweave.operators import stats as T
from panelweave.plans.crosssection import clusters, pr
from panelweave.plans.evaluate import LONG, models
from panelweave.plans.registry import query, sql
from panelweave.plans.stats import _NEAR, FV, _SER, auc_sql, series

_FC = f"fc AS (SELECT feature, fold_id, CASE WHEN count(*) >= 10 AND stddev_pop(value) > 1e-12 AND stddev_pop(target) > 1e-12 THEN round(corr(value, target), 9) END AS c FROM {FV} GROUP BY 1, 2)"


def fold_corr(t):
    return T.correlations(t.features, ["feature", "fold_id"]).withColumn("corr", F.round("corr", 9))


@query("r7_21_quantile_mi", sql("ret", f", {_SER}, p AS (SELECT a.k AS a, b.k AS b, a.v AS x, b.v AS y FROM s a JOIN s b ON a.pos = b.pos AND a.k < b.k), m AS (SELECT a, b, x > quantile_cont(x, 0.5) OVER w AS u, y > quantile_cont(y, 0.5) OVER w AS v FROM p WINDOW w AS (PARTITION BY a, b)), c AS (SELECT a, b, u, v, count(*) AS n FROM m GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY a, b) AS t, sum(n) OVER (PARTITION BY a, b, u) AS nu, sum(n) OVER (PARTITION BY a, b, v) AS nv FROM c) SELECT a, b, round(sum(n / t * ln(n * t / (nu * nv))), 6) AS mi FROM t GROUP BY 1, 2"))
def _(t):
    from panelweave.operators.leadlag import median_information
    from panelweave.plans.stats import KEYS, series

    return median_information(series(t), **KEYS)


@query("r7_61_alignment_gate", sql("features", f", {_FC}, m AS (SELECT *, avg(CASE WHEN fold_id < 3 THEN c END) OVER (PARTITION BY feature) AS t FROM fc WHERE c IS NOT NULL), g AS (SELECT feature, any_value(t) AS t, avg(CASE WHEN fold_id >= 3 THEN (sign(c) = sign(t))::INT END) AS m FROM m GROUP BY 1) SELECT feature, round(t, 6) AS train_mean, round(m, 6) AS match, abs(t) >= 0.02 AND coalesce(m, 0) >= 0.6 AS passes, concat_ws(',', CASE WHEN abs(t) < 0.02 THEN 'weak' END, CASE WHEN coalesce(m, 0) < 0.6 THEN 'unstable' END) AS reasons FROM g"))
def _(t):
    return N.alignment_gate(fold_corr(t), F.col("fold_id") < 3)


@query("r7_62_univariate_topk", sql("features", f", k AS (SELECT feature, fold_id, target, row_number() OVER (PARTITION BY feature, fold_id ORDER BY value DESC, row_id) AS n, count(*) OVER (PARTITION BY feature, fold_id) AS m FROM {FV}) SELECT feature, fold_id, round(avg(CASE WHEN n <= ceil(m * 0.1) THEN target END), 6) AS top_rate, round(avg(target), 6) AS base FROM k GROUP BY 1, 2"))
def _(t):
    w = Window.partitionBy("feature", "fold_id")
    k = t.features.filter("value is not null").withColumns({"n": F.row_number().over(w.orderBy(F.desc("value"), "row_id")), "m": F.count("*").over(w)})
    return k.groupBy("feature", "fold_id").agg(F.avg(F.when(F.col("n") <= F.ceil(F.col("m") * 0.1), F.col("target"))).alias("top_rate"), F.avg("target").alias("base"))


@query("r7_63_direction_relation", sql("features", f", c AS (SELECT feature, round(corr(value, target), 9) AS a, round(corr(value, (row_id % 3 = 0)::INT), 9) AS b FROM {FV} GROUP BY 1) SELECT feature, CASE WHEN abs(a) >= 0.03 AND abs(b) < 0.01 THEN 'FIRST_ONLY' WHEN abs(b) >= 0.03 AND abs(a) < 0.01 THEN 'SECOND_ONLY' WHEN abs(a) >= 0.01 AND abs(b) >= 0.01 AND sign(a) <> sign(b) THEN 'OPPOSITE' WHEN abs(a) >= 0.01 AND abs(b) >= 0.01 THEN 'COMMON' ELSE 'NONE' END AS relation FROM c"))
def _(t):
    f = t.features.filter("value is not null")
    c = f.groupBy("feature").agg(F.round(complete_corr(F.col("value"), F.col("target")), 9).alias("a"), F.round(complete_corr(F.col("value"), (F.col("row_id") % 3 == 0).cast("int")), 9).alias("b"))
    return c.select("feature", N.direction_relation(F.col("a"), F.col("b")).alias("relation"))


@query("r7_64_evidence_grades", sql("features", f", {_FC}, g AS (SELECT feature, avg(c) FILTER (fold_id < 3) AS s, avg(c) FILTER (fold_id >= 3) AS k FROM fc GROUP BY 1) SELECT feature, CASE WHEN abs(s) >= 0.05 AND sign(s) = sign(k) AND abs(k) >= 0.02 THEN 'A' WHEN abs(s) >= 0.02 AND sign(s) = sign(k) THEN 'B' WHEN abs(s) >= 0.02 THEN 'C' ELSE 'D' END AS grade FROM g"))
def _(t):
    g = fold_corr(t).groupBy("feature").agg(F.avg(F.when(F.col("fold_id") < 3, F.col("corr"))).alias("s"), F.avg(F.when(F.col("fold_id") >= 3, F.col("corr"))).alias("k"))
    return g.select("feature", N.evidence_grade(F.col("s"), F.col("k")).alias("grade"))


_RANK = f"rk AS (SELECT feature, c, row_number() OVER (ORDER BY abs(c) DESC, feature) AS place, feature IN ('f_close', 'f_ret') AS rep FROM (SELECT feature, round(corr(value, target), 9) AS c FROM {FV} GROUP BY 1))"


def ranked(t):
    c = T.correlations(t.features, ["feature"]).select("feature", F.round("corr", 9).alias("c"))
    return c.withColumns({"place": F.row_number().over(Window.orderBy(F.desc(F.abs("c")), "feature")), "rep": F.col("feature").isin("f_close", "f_ret")})


@query("r7_65_profiles", sql("features", f", {_RANK} SELECT 'P0' AS profile, feature FROM rk UNION ALL SELECT 'P1', feature FROM rk WHERE place <= 3 UNION ALL SELECT 'P2', feature FROM rk WHERE abs(c) >= 0.1 UNION ALL SELECT 'P3', feature FROM rk WHERE rep UNION ALL SELECT 'P4', feature FROM rk WHERE abs(c) >= 0.1 AND rep UNION ALL SELECT 'P5', feature FROM rk WHERE place <= 3 AND NOT rep"))
def _(t):
    return N.profiles(ranked(t), top=3, strict=F.abs("c") >= 0.1, representative=F.col("rep"))


@query("r7_66_separation_score", sql("features", f", a AS ({auc_sql('feature', FV)}), k AS (SELECT feature, avg((value IS NOT NULL)::INT) AS cov FROM features GROUP BY 1), {_FC}, s AS (SELECT feature, greatest(count(*) FILTER (c > 1e-12), count(*) FILTER (c < -1e-12))::DOUBLE / nullif(count(*) FILTER (abs(c) > 1e-12), 0) AS con FROM fc GROUP BY 1) SELECT feature, round(CASE WHEN cov >= 0.5 THEN (0.7 * 2 * abs(auc - 0.5) + 0.3 * coalesce(con, 0)) * sqrt(cov) ELSE 0 END, 5) AS separation FROM a JOIN k USING (feature) JOIN s USING (feature)"))
def _(t):
    a = T.auc(t.features, ["feature"]).select("feature", F.round("auc", 6).alias("auc"))
    k = t.features.groupBy("feature").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("cov"))
    s = fold_corr(t).groupBy("feature").agg(T.sign_consistency(F.col("corr")).alias("con"))
    return a.join(k, "feature").join(s, "feature").select("feature", F.round(N.separation_score(F.col("auc"), F.col("cov"), F.col("con")), 5).alias("separation"))


@query("r7_67_crossfit_ranking", sql("features", f", {_FC}, v AS (SELECT fold_id, feature, c, sum(c) OVER w - c AS others FROM fc WHERE c IS NOT NULL WINDOW w AS (PARTITION BY feature)), g AS (SELECT feature, round(avg(CASE WHEN others >= 0 THEN c ELSE -c END), 9) AS held FROM v GROUP BY 1) SELECT feature, round(held, 6) AS held, row_number() OVER (ORDER BY held DESC, feature) AS place FROM g"))
def _(t):
    v = fold_corr(t).filter("corr is not null").withColumn("others", F.sum("corr").over(Window.partitionBy("feature")) - F.col("corr"))
    g = v.groupBy("feature").agg(F.round(F.avg(F.when(F.col("others") >= 0, F.col("corr")).otherwise(-F.col("corr"))), 9).alias("held"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("held"), "feature")))


@query("r7_68_train_scores", sql("features", f", a AS ({auc_sql('feature, market', '(SELECT * FROM features WHERE value IS NOT NULL AND fold_id < 3)')}) SELECT feature, market, round(5 * greatest(abs(auc - 0.5) * n / (n + 80.0), 0), 5) AS train_score FROM a"))
def _(t):
    a = T.auc(t.features.filter("fold_id < 3"), ["feature", "market"]).withColumn("auc", F.round("auc", 6))
    return a.select("feature", "market", F.round(5 * F.greatest(F.abs(F.col("auc") - 0.5) * F.col("n") / (F.col("n") + 80.0), F.lit(0.0)), 5).alias("train_score"))


@query("r7_69_cross_entity", sql("features", f", c AS (SELECT market, feature, round(corr(value, target), 9) AS c FROM {FV} GROUP BY 1, 2) SELECT a.market AS a, b.market AS b, round(avg((sign(a.c) = sign(b.c))::INT), 6) AS agreement FROM c a JOIN c b ON a.feature = b.feature AND a.market < b.market GROUP BY 1, 2"))
def _(t):
    c = T.correlations(t.features, ["market", "feature"]).select("market", "feature", F.round("corr", 9).alias("c"))
    j = c.select(F.col("market").alias("a"), "feature", F.col("c").alias("x")).join(c.select(F.col("market").alias("b"), "feature", F.col("c").alias("y")), "feature").filter("a < b")
    return j.groupBy("a", "b").agg(F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("agreement"))


@query("r7_70_clipped_scale", sql("panel", ", q AS (SELECT market, quantile_cont(close, 0.05) AS l, quantile_cont(close, 0.95) AS h FROM panel GROUP BY 1) SELECT ticker, date, CASE WHEN h > l THEN round(greatest(least((close - l) / (h - l), 1), 0), 6) END AS scaled FROM panel JOIN q USING (market)"))
def _(t):
    return N.clipped_scale(t.panel, "close", ["market"]).select("ticker", "date", "scaled")


@query("r7_71_error_drivers", sql("features", f", k AS (SELECT feature, round(abs(corr(value, target - 0.3)) + 0.5 * abs(coalesce(corr(value, (target = 0 AND row_id % 4 = 0)::INT), 0)), 9) AS d FROM {FV} GROUP BY 1), m AS (SELECT feature, avg((value IS NULL)::INT) AS miss FROM features GROUP BY 1) SELECT feature, round(d * (1 + miss), 6) AS driver FROM k JOIN m USING (feature)"))
def _(t):
    fp = ((F.col("target") == 0) & (F.col("row_id") % 4 == 0)).cast("int")
    k = t.features.filter("value is not null").groupBy("feature").agg(F.round(F.abs(complete_corr(F.col("value"), F.col("target") - 0.3)) + 0.5 * F.abs(F.coalesce(complete_corr(F.col("value"), fp), F.lit(0.0))), 9).alias("d"))
    m = t.features.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("miss"))
    return k.join(m, "feature").select("feature", (F.col("d") * (1 + F.col("miss"))).alias("driver"))


@query("r12_4_latest_scoring", sql("scored", ", l AS (SELECT max(date) AS d FROM scored) SELECT row_id, rank FROM (SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM scored WHERE date = (SELECT d FROM l))"))
def _(t):
    last = t.scored.agg(F.max("date").alias("date"))
    day = t.scored.join(F.broadcast(last), "date", "left_semi")
    return day.select("row_id", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "row_id")).alias("rank"))


@query("r12_2_12_3_threshold_replay", sql("scored", ", g AS (SELECT fold_id, round(score, 2) AS s, count(*) AS k, sum(target) AS p FROM scored GROUP BY 1, 2), e AS (SELECT DISTINCT fold_id AS f FROM scored), h AS (SELECT f, s, sum(k) AS k, sum(p) AS p FROM e JOIN g ON g.fold_id < f GROUP BY 1, 2), c AS (SELECT f, s, sum(k) OVER w AS al, sum(p) OVER w AS tp FROM h WINDOW w AS (PARTITION BY f ORDER BY s DESC)) SELECT e.f AS fold_id, CASE WHEN min(CASE WHEN tp / al >= 0.2 AND al >= 20 THEN s END) IS NULL THEN 'inf'::DOUBLE ELSE greatest(min(CASE WHEN tp / al >= 0.2 AND al >= 20 THEN s END), 0.6) END AS threshold FROM e LEFT JOIN c USING (f) GROUP BY 1"))
def _(t):
    g = t.scored.groupBy("fold_id", F.round("score", 2).alias("s")).agg(F.count("*").alias("k"), F.sum("target").alias("p"))
    e = t.scored.select(F.col("fold_id").alias("f")).distinct()
    h = g.join(F.broadcast(e), F.col("fold_id") < F.col("f")).groupBy("f", "s").agg(F.sum("k").alias("k"), F.sum("p").alias("p"))
    w = Window.partitionBy("f").orderBy(F.desc("s"))
    c = h.withColumns({"al": F.sum("k").over(w), "tp": F.sum("p").over(w)})
    ok = (F.col("tp") / F.col("al") >= 0.2) & (F.col("al") >= 20)
    found = c.groupBy("f").agg(F.min(F.when(ok, F.col("s"))).alias("t"))
    return e.join(found, "f", "left").select(F.col("f").alias("fold_id"), F.when(F.col("t").isNull(), float("inf")).otherwise(F.greatest("t", F.lit(0.6))).alias("threshold"))


@query("r12_9_late_corrections", "WITH e AS (SELECT event_id, user_id, ts, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT (event_id * 7919) % 10007 AS event_id, user_id, ts FROM events)) SELECT count(*) FILTER (event_id < seen) AS late, count(*) FILTER (seen IS NULL OR event_id >= seen) AS in_time FROM e")
def _(t):
    w = over("user_id", order=("ts", "event_id")).rowsBetween(Window.unboundedPreceding, -1)
    e = t.read("events").select(((F.col("event_id") * 7919) % 10007).alias("event_id"), "user_id", "ts").withColumn("seen", F.max("event_id").over(w))
    late = F.coalesce(F.col("event_id") < F.col("seen"), F.lit(False))
    return e.agg(F.count_if(late).alias("late"), F.count_if(~late).alias("in_time"))


@query("r14_2_univariate_summary", sql("features", f", {_FC} SELECT feature, CASE WHEN fold_id < 3 THEN 'selection' ELSE 'later' END AS role, count(c) AS folds, round(avg(c), 6) AS mean, round(min(c), 6) AS low, round(max(c), 6) AS high FROM fc GROUP BY 1, 2"))
def _(t):
    role = E.fold_role(F.col("fold_id"), {"selection": [0, 1, 2]}, "later")
    return fold_corr(t).groupBy("feature", role.alias("role")).agg(F.count("corr").alias("folds"), F.avg("corr").alias("mean"), F.min("corr").alias("low"), F.max("corr").alias("high"))


@query("r14_3_multi_threshold_clusters", sql("features", f"{_NEAR}, e AS (SELECT t AS threshold, a, b FROM pc, (VALUES (0.3), (0.6), (0.9)) v(t) WHERE abs(c) >= t), r(threshold, node, seen) AS (SELECT DISTINCT threshold, a, a FROM e UNION SELECT r.threshold, r.node, e.b FROM r JOIN e ON e.a = r.seen AND e.threshold = r.threshold)").replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT threshold::DOUBLE AS threshold, node, min(seen) AS component FROM r GROUP BY 1, 2")
def _(t):
    m = T.correlation_matrix(t.features)
    out = None
    for cut in (0.3, 0.6, 0.9):
        one = T.components_of(m.filter(F.abs("corr") >= cut)).withColumn("threshold", F.lit(cut))
        out = one if out is None else out.unionByName(one)
    return out


@query("r14_4_changed_representatives", sql("features", f", {_FC}, cl(feature, cluster) AS (VALUES ('f_close', 0), ('f_volume', 0), ('f_mean', 0), ('f_errors', 1), ('f_buys', 1), ('f_ret', 1)), b AS (SELECT fold_id, cluster, feature, row_number() OVER (PARTITION BY fold_id, cluster ORDER BY abs(c) DESC NULLS LAST, feature) AS n FROM fc JOIN cl USING (feature)), o AS (SELECT * FROM b WHERE n = 1) SELECT x.fold_id, x.cluster, x.feature, y.feature AS previous, y.feature IS NOT NULL AND x.feature <> y.feature AS changed FROM o x LEFT JOIN o y ON y.cluster = x.cluster AND y.fold_id = x.fold_id - 1"))
def _(t):
    b = N.top_per(fold_corr(t).join(clusters(t), "feature"), ["fold_id", "cluster"], [F.desc_nulls_last(F.abs("corr")), F.col("feature")], 1).select("fold_id", "cluster", "feature")
    old = b.select((F.col("fold_id") + 1).alias("fold_id"), "cluster", F.col("feature").alias("previous"))
    return b.join(old, ["fold_id", "cluster"], "left").withColumn("changed", F.coalesce(F.col("feature") != F.col("previous"), F.lit(False)))


@query("r14_6_feature_priority", sql("features", f", {_RANK}, q AS (SELECT feature, count(DISTINCT value) AS u, avg((value IS NULL)::INT) AS miss FROM features GROUP BY 1) SELECT feature, place, u AS n_values, round(miss, 6) AS missing, row_number() OVER (ORDER BY miss > 0.2, place, feature) AS priority FROM rk JOIN q USING (feature)"))
def _(t):
    q = t.features.groupBy("feature").agg(F.count_distinct("value").alias("n_values"), F.avg(F.col("value").isNull().cast("double")).alias("missing"))
    j = ranked(t).select("feature", "place").join(q, "feature")
    return j.withColumn("priority", F.row_number().over(Window.orderBy(F.col("missing") > 0.2, "place", "feature")))


@query("r14_10_prediction_bundle", sql("scored", f", a AS (SELECT fold_id, auc FROM ({auc_sql('fold_id', 'scored', 'score')})), b AS (SELECT fold_id, round(avg((score - target) ** 2), 6) AS brier FROM scored GROUP BY 1), k AS (SELECT fold_id, target, row_number() OVER (PARTITION BY date ORDER BY score DESC, row_id) <= greatest(ceil(count(*) OVER (PARTITION BY date) * 0.1), 1) AS al FROM scored), p AS (SELECT fold_id, round(avg(CASE WHEN al THEN target END), 6) AS top_precision FROM k GROUP BY 1) SELECT * FROM a JOIN b USING (fold_id) JOIN p USING (fold_id)"))
def _(t):
    a = T.auc(t.scored, ["fold_id"], "score").select("fold_id", F.round("auc", 6).alias("auc"))
    b = E.probability_metrics(t.scored, "score", "target", ["fold_id"]).select("fold_id", "brier")
    p = P.confusion(P.daily_top(t.scored, "score", 0.1), F.col("alert"), by=["fold_id"]).select("fold_id", F.col("precision").alias("top_precision"))
    return a.join(b, "fold_id").join(p, "fold_id")


@query("r14_17_method_choice", sql("scored", f", {LONG}, m AS (SELECT model, fold_id, avg(CASE WHEN s >= 0.4 THEN target END) AS p FROM lng JOIN scored USING (row_id) GROUP BY 1, 2), a AS (SELECT model, round(avg(p), 9) AS p, round(min(p), 9) AS l FROM m GROUP BY 1) SELECT model, round(p, 6) AS mean_precision FROM a ORDER BY p DESC NULLS LAST, l DESC NULLS LAST, model LIMIT 1"))
def _(t):
    m = models(t).groupBy("model", "fold_id").agg(F.avg(F.when(F.col("s") >= 0.4, F.col("target"))).alias("p"))
    a = m.groupBy("model").agg(F.round(F.avg("p"), 9).alias("mean_precision"), F.round(F.min("p"), 9).alias("l"))
    return a.orderBy(F.desc_nulls_last("mean_precision"), F.desc_nulls_last("l"), "model").limit(1).select("model", "mean_precision")


@query("r14_19_policy_gate", sql("scored", ", p AS (SELECT 'global' AS policy, count(*) FILTER (score >= 0.85) AS al, count(*) FILTER (score >= 0.85 AND target = 1) AS tp FROM scored UNION ALL SELECT 'scope', count(*) FILTER (score >= CASE market WHEN 'M0' THEN 0.8 ELSE 0.9 END), count(*) FILTER (score >= CASE market WHEN 'M0' THEN 0.8 ELSE 0.9 END AND target = 1) FROM scored) SELECT policy, al AS alerts, tp, row_number() OVER (ORDER BY tp::DOUBLE / nullif(al, 0) DESC NULLS LAST, policy) AS place FROM p"))
def _(t):
    bar = {"global": F.lit(0.85), "scope": F.when(F.col("market") == "M0", 0.8).otherwise(0.9)}
    out = None
    for k, b in bar.items():
        one = t.scored.agg(F.count_if(F.col("score") >= b).alias("alerts"), F.count_if((F.col("score") >= b) & (F.col("target") == 1)).alias("tp")).withColumn("policy", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.try_divide("tp", "alerts")), "policy")))


@query("r14_23_signal_roles", sql("features", ", n AS (SELECT DISTINCT feature FROM features) SELECT feature, CASE WHEN regexp_matches(feature, 'err') THEN 'crash' WHEN regexp_matches(feature, 'ret|mean') THEN 'direction' WHEN regexp_matches(feature, 'vol|buy') THEN 'strong' ELSE 'surge' END AS role FROM n"))
def _(t):
    f = F.col("feature")
    return t.features.select("feature").distinct().select("feature", F.when(f.rlike("err"), "crash").when(f.rlike("ret|mean"), "direction").when(f.rlike("vol|buy"), "strong").otherwise("surge").alias("role"))


@query("r14_24_agreement", sql("scored", f", {LONG} SELECT row_id, round(greatest(least(1 - stddev_pop(s), 1), 0), 6) AS agreement FROM lng GROUP BY 1"))
def _(t):
    return models(t).groupBy("row_id").agg(F.greatest(F.least(1 - F.stddev_pop("s"), F.lit(1.0)), F.lit(0.0)).alias("agreement"))


@query("r14_31_bottlenecks", sql("scored", "SELECT fold_id, concat_ws(',', CASE WHEN avg(CASE WHEN score >= 0.8 THEN target END) < 0.3 THEN 'precision' END, CASE WHEN count(*) FILTER (score >= 0.8) < 30 THEN 'alerts' END, CASE WHEN count(DISTINCT CASE WHEN score >= 0.8 THEN date END) < 5 THEN 'days' END) AS missing FROM scored GROUP BY fold_id"))
def _(t):
    a = F.col("score") >= 0.8
    return t.scored.groupBy("fold_id").agg(F.concat_ws(",", F.when(F.avg(F.when(a, F.col("target"))) < 0.3, "precision"), F.when(F.count_if(a) < 30, "alerts"), F.when(F.count_distinct(F.when(a, F.col("date"))) < 5, "days")).alias("missing"))


@query("r14_33_consensus_groups", sql("features", f", {_RANK} SELECT split_part(feature, '_', 1) || '_' || left(split_part(feature, '_', 2), 1) AS grp, count(*) AS n, round(avg(abs(c)), 6) AS mean FROM rk GROUP BY 1"))
def _(t):
    f = F.split("feature", "_")
    return ranked(t).groupBy(F.concat(f[0], F.lit("_"), F.substring(f[1], 1, 1)).alias("grp")).agg(F.count("*").alias("n"), F.avg(F.abs("c")).alias("mean"))


@query("r14_34_feature_transform_map", sql("features", f", v AS (SELECT feature, fold_id, target, 'raw' AS transform, value AS x FROM {FV} UNION ALL SELECT feature, fold_id, target, 'date_rank', {pr('value', 'feature, date')} FROM {FV}) SELECT feature, fold_id, transform, CASE WHEN count(*) >= 10 AND stddev_pop(x) > 1e-12 AND stddev_pop(target) > 1e-12 THEN round(corr(x, target), 6) END AS corr, count(*) AS n FROM v GROUP BY 1, 2, 3"))
def _(t):
    f = t.features.filter("value is not null")
    v = f.withColumn("transform", F.lit("raw")).unionByName(f.withColumn("value", pct_rank(F.col("value"), "feature", "date")).withColumn("transform", F.lit("date_rank")))
    return T.correlations(v, ["feature", "fold_id", "transform"])


@query("r14_35_rank_matrix", sql("features", f", k AS (SELECT row_id, feature, round({pr('value', 'feature, date')}, 6) AS p FROM {FV}) SELECT row_id, max(p) FILTER (feature = 'f_close') AS f_close, max(p) FILTER (feature = 'f_volume') AS f_volume, max(p) FILTER (feature = 'f_ret') AS f_ret FROM k GROUP BY 1"))
def _(t):
    k = t.features.filter("value is not null").withColumn("p", pct_rank(F.col("value"), "feature", "date"))
    return k.groupBy("row_id").pivot("feature", ["f_close", "f_volume", "f_ret"]).agg(F.max("p"))


@query("r14_40_graph_tables", sql("features", f", e AS (SELECT market, feature FROM {FV} GROUP BY 1, 2) SELECT market AS node, count(*) AS degree, 'market' AS kind FROM e GROUP BY 1 UNION ALL SELECT feature, count(*), 'feature' FROM e GROUP BY 1"))
def _(t):
    e = T.correlations(t.features, ["market", "feature"])
    return N.graph_tables(e, "market", "feature", "corr")[0]


@query("r14_45_regime_columns", sql("features", ", n AS (SELECT DISTINCT feature FROM features) SELECT feature FROM n ORDER BY NOT regexp_matches(feature, 'vol|ret'), feature LIMIT 3"))
def _(t):
    return t.features.select("feature").distinct().orderBy(~F.col("feature").rlike("vol|ret"), "feature").limit(3)


@query("r14_50_weighted_lag_stats", sql("ret", f", {_SER}, c AS (SELECT a.k AS a, b.k AS b, l.lag, a.pos // 10 AS seg, count(*) AS n, corr(a.v, b.v) AS c FROM s a CROSS JOIN (VALUES (0), (1)) l(lag) JOIN s b ON b.pos = a.pos + l.lag AND a.k < b.k GROUP BY ALL HAVING count(*) >= 5) SELECT a, b, lag, round(sum(c * n) / sum(n), 6) AS mean, round(greatest(count(*) FILTER (c > 1e-12), count(*) FILTER (c < -1e-12))::DOUBLE / nullif(count(*) FILTER (abs(c) > 1e-12), 0), 6) AS consistency FROM c GROUP BY 1, 2, 3"))
def _(t):
    from functools import reduce

    from panelweave.operators.leadlag import window_correlations
    from panelweave.plans.stats import KEYS, series

    each = (window_correlations(series(t), [9, 19, 29, 39], 10, lag=k, **KEYS).withColumn("lag", F.lit(k)) for k in (0, 1))
    c = reduce(lambda x, y: x.unionByName(y), each).filter("n >= 5").withColumnRenamed("corr", "c")
    return c.groupBy("a", "b", "lag").agg((F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("mean"), T.sign_consistency(F.col("c")).alias("consistency"))


@query("r14_53_seed_rollup", sql("scored", f", {LONG}, m AS (SELECT model, fold_id, round(avg(CASE WHEN s >= 0.4 THEN target END), 9) AS p, count(*) FILTER (s >= 0.4) AS al FROM lng JOIN scored USING (row_id) GROUP BY 1, 2) SELECT model % 2 AS family, round(avg(p), 6) AS mean, round(min(p), 6) AS least, min(al) >= 1 AS always_alerts FROM m GROUP BY 1"))
def _(t):
    m = models(t).groupBy("model", "fold_id").agg(F.round(F.avg(F.when(F.col("s") >= 0.4, F.col("target"))), 9).alias("p"), F.count_if(F.col("s") >= 0.4).alias("al"))
    return m.groupBy((F.col("model") % 2).alias("family")).agg(F.avg("p").alias("mean"), F.min("p").alias("least"), (F.min("al") >= 1).alias("always_alerts"))


@query("r14_57_sequential_recalibration", sql("scored", ", h AS (SELECT s.row_id, s.fold_id, (SELECT count(*) FILTER (x.score <= s.score)::DOUBLE / nullif(count(*), 0) FROM scored x WHERE x.fold_id < s.fold_id) AS h FROM scored s) SELECT row_id, round(h, 6) AS historical_rank FROM h WHERE fold_id > 0"))
def _(t):
    return E.historical_rank(t.scored, "score", "fold_id").filter("fold_id > 0").select("row_id", "historical_rank")


@query("r14_60_posthoc_spearman", sql("scored", f", {LONG}, r AS (SELECT row_id, model, {pr('s', 'model')} AS k FROM lng) SELECT a.model AS a, b.model AS b, round(corr(a.k, b.k), 6) AS spearman FROM r a JOIN r b ON a.row_id = b.row_id AND a.model < b.model GROUP BY 1, 2"))
def _(t):
    r = models(t).withColumn("k", pct_rank(F.col("s"), "model"))
    j = r.select("row_id", F.col("model").alias("a"), F.col("k").alias("x")).join(r.select("row_id", F.col("model").alias("b"), F.col("k").alias("y")), "row_id").filter("a < b")
    return j.groupBy("a", "b").agg(complete_corr(F.col("x"), F.col("y")).alias("spearman"))


@query("r14_62_regime_scopes", sql("scored", ", m AS (SELECT date, avg(close) AS c FROM scored GROUP BY 1), r AS (SELECT date, CASE WHEN c >= avg(c) OVER () THEN 'HIGH' ELSE 'LOW' END AS regime FROM m) SELECT regime, count(*) AS n, round(avg(CASE WHEN score >= 0.8 THEN target END), 6) AS precision FROM scored JOIN r USING (date) GROUP BY 1"))
def _(t):
    m = t.scored.groupBy("date").agg(F.avg("close").alias("c"))
    r = m.withColumn("regime", F.when(F.col("c") >= F.avg("c").over(Window.partitionBy()), "HIGH").otherwise("LOW")).select("date", "regime")
    return t.scored.join(F.broadcast(r), "date").groupBy("regime").agg(F.count("*").alias("n"), F.avg(F.when(F.col("score") >= 0.8, F.col("target"))).alias("precision"))


@query("r14_65_pooled_vs_entity", sql("scored", "SELECT ticker, round(avg((score - target) ** 2) - avg((target - 0.2) ** 2), 6) AS delta FROM scored GROUP BY 1"))
def _(t):
    y = F.col("target")
    return t.scored.groupBy("ticker").agg((F.avg((F.col("score") - y) ** 2) - F.avg((y - 0.2) ** 2)).alias("delta"))


@query("r14_68_combined_table", sql("panel", ", a AS (SELECT ticker, date, close FROM panel WHERE market <> 'M2'), b AS (SELECT ticker, date, volume FROM panel WHERE bucket <> 'B0') SELECT ticker, date, round(close, 6) AS close, volume FROM a FULL JOIN b USING (ticker, date)"))
def _(t):
    from panelweave.sources.ingest import coalescing_merge

    return coalescing_merge([t.panel.filter("market <> 'M2'").select("ticker", "date", "close"), t.panel.filter("bucket <> 'B0'").select("ticker", "date", "volume")], ["ticker", "date"])


__all__ = ["series"]
