"""Queries: calibration, folds, ensembles, ablation, set operations, further compositions and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions import scalar as S
from panelweave.functions.windows import complete_corr, over, pct_rank
from panelweave.operators import evaluate as E
from panelweave.operators import policy as P
from panelweave.operators import stats as T
from panelweave.plans.crosssection import pr
from panelweave.plans.registry import query, sql
from panelweave.plans.stats import FV, auc_sql


@query("r10_1_calibration_error", sql("scored", ", b AS (SELECT fold_id, least(floor(score * 10), 9) AS b, count(*) AS k, avg(score) AS mp, avg(target) AS my FROM scored GROUP BY 1, 2) SELECT fold_id, round(sum(k * abs(mp - my)) / sum(k), 6) AS ece FROM b GROUP BY fold_id"))
def _(t):
    return E.calibration_error(t.scored, "score", "target", by=["fold_id"])


@query("r10_2_brier_logloss", sql("scored", ", q AS (SELECT *, greatest(least(score, 1 - 1e-7), 1e-7) AS q FROM scored) SELECT fold_id, count(*) AS n, round(avg((score - target) ** 2), 6) AS brier, round(avg(-(target * ln(q) + (1 - target) * ln(1 - q))), 6) AS log_loss FROM q GROUP BY fold_id"))
def _(t):
    return E.probability_metrics(t.scored, "score", "target", ["fold_id"])


@query("r10_3_walk_forward", sql("panel", ", p AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM panel)), f AS (SELECT f AS fold_id, (SELECT max(pos) FROM p) - (4 - f) * 4 + 1 AS vs FROM (VALUES (0), (1), (2), (3)) v(f)) SELECT fold_id, (SELECT min(date) FROM p) AS train_start, a.date AS train_end, b.date AS validation_start, c.date AS validation_end FROM f JOIN p a ON a.pos = vs - 3 JOIN p b ON b.pos = vs JOIN p c ON c.pos = vs + 3 WHERE vs - 3 >= 5"))
def _(t):
    return E.walk_forward_folds(t.panel, folds=4, validation=4, purge=2, least_train=5)


@query("r10_4_train_window", sql("scored", ", p AS (SELECT date, dense_rank() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM scored)) SELECT row_id FROM scored JOIN p USING (date) WHERE pos > (SELECT max(pos) FROM p) - 10"))
def _(t):
    p = t.scored.select("date").distinct().withColumn("pos", F.dense_rank().over(Window.orderBy("date")))
    last = p.agg((F.max("pos") - 10).alias("from"))
    return t.scored.join(F.broadcast(p.crossJoin(last).filter(F.col("pos") > F.col("from")).select("date")), "date", "left_semi").select("row_id")


@query("r10_5_fold_roles", sql("scored", "SELECT fold_id, CASE WHEN fold_id <= 1 THEN 'discovery' WHEN fold_id <= 3 THEN 'development' WHEN fold_id = 4 THEN 'confirmation' ELSE 'recent' END AS role, count(*) AS n FROM scored GROUP BY 1, 2"))
def _(t):
    role = E.fold_role(F.col("fold_id"), {"discovery": [0, 1], "development": [2, 3], "confirmation": [4], "recent": [5]})
    return t.scored.groupBy("fold_id", role.alias("role")).agg(F.count("*").alias("n"))


@query("r10_6_sample_weights", sql("scored", ", a AS (SELECT max(date) AS l, avg(target) AS rate_, count(*) AS n, count(DISTINCT ticker) AS e FROM scored), w AS (SELECT row_id, CASE WHEN target = 1 THEN 0.5 / rate_ ELSE 0.5 / (1 - rate_) END * pow(0.5, (l - date) / 10.0) * sqrt(n::DOUBLE / e / count(*) OVER (PARTITION BY ticker)) AS w FROM scored, a) SELECT row_id, round(w / avg(w) OVER (), 5) AS weight FROM w"))
def _(t):
    return E.sample_weights(t.scored, "target").select("row_id", F.round("weight", 5).alias("weight"))


@query("r10_7_ordinal_labels", sql("labelled", ", g AS (SELECT ticker, date, CASE first_hit_day WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS grade FROM labelled WHERE target_valid) SELECT ticker, date, grade FROM (SELECT *, min(grade) OVER (PARTITION BY date) AS l, max(grade) OVER (PARTITION BY date) AS h FROM g) WHERE l = 0 AND h > 0"))
def _(t):
    grade = F.when(F.col("first_hit_day") > 0, 4 - F.col("first_hit_day")).otherwise(0)
    w = Window.partitionBy("date")
    g = t.labelled.filter("target_valid").select("ticker", "date", grade.alias("grade"))
    return g.withColumns({"l": F.min("grade").over(w), "h": F.max("grade").over(w)}).filter("l = 0 and h > 0").select("ticker", "date", "grade")


@query("r10_10_two_stage", sql("scored", "SELECT row_id, round(greatest(least(score * (0.5 + score / 4), 1 - 1e-6), 1e-6), 6) AS p FROM scored"))
def _(t):
    return t.scored.select("row_id", S.clip(F.col("score") * (0.5 + F.col("score") / 4), 1e-6, 1 - 1e-6).alias("p"))


_KNOTS = [(0.2, 0.05), (0.5, 0.1), (0.8, 0.3), (0.95, 0.6)]


@query("r10_12_apply_calibrator", sql("scored", "SELECT row_id, round(1 / (1 + exp(-(0.7 * ln(q / (1 - q)) - 1))), 6) AS platt, round(CASE WHEN score <= 0.2 THEN 0.05 WHEN score <= 0.5 THEN 0.05 + (score - 0.2) * 0.05 / 0.3 WHEN score <= 0.8 THEN 0.1 + (score - 0.5) * 0.2 / 0.3 WHEN score <= 0.95 THEN 0.3 + (score - 0.8) * 0.3 / 0.15 ELSE 0.6 END, 6) AS isotonic FROM (SELECT *, greatest(least(score, 1 - 1e-6), 1e-6) AS q FROM scored)"))
def _(t):
    return t.scored.select("row_id", S.sigmoid(0.7 * S.logit(F.col("score")) - 1).alias("platt"), S.interpolate(F.col("score"), _KNOTS).alias("isotonic"))


@query("r10_13_tie_break", sql("scored", "SELECT row_id, round(max(round(score, 1)) OVER (PARTITION BY date ORDER BY score, row_id ROWS UNBOUNDED PRECEDING) + row_number() OVER (PARTITION BY date ORDER BY score, row_id) * 1e-4, 6) AS tie_broken FROM scored"))
def _(t):
    return E.rank_preserving(t.scored.withColumn("cal", F.round("score", 1)), "score", "cal", 1e-4).select("row_id", "tie_broken")


_HIST = "(SELECT count(*) FILTER (h.score <= s.score)::DOUBLE / nullif(count(*), 0) FROM scored h WHERE h.fold_id < s.fold_id AND h.market = s.market)"


@query("r10_14_15_historical_rank", sql("scored", f"SELECT row_id, round({_HIST}, 6) AS historical_rank FROM scored s"))
def _(t):
    return E.historical_rank(t.scored, "score", "fold_id", "market").select("row_id", "historical_rank")


@query("r10_16_score_blend", sql("scored", f"SELECT row_id, round(CASE WHEN h IS NULL THEN d ELSE 0.75 * h + 0.25 * d END, 6) AS policy_score FROM (SELECT row_id, {_HIST} AS h, {pr('score', 'date')} AS d FROM scored s)"))
def _(t):
    h = E.historical_rank(t.scored, "score", "fold_id", "market")
    return h.select("row_id", E.blend([(F.col("historical_rank"), 0.75), (pct_rank(F.col("score"), "date"), 0.25)]).alias("policy_score"))


LONG = "lng AS (SELECT row_id, date, m AS model, round(score * CASE m WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0.2 END + (row_id * (m + 3) % 17) / 100.0, 12) AS s FROM scored, (VALUES (0), (1), (2)) v(m))"


def models(t):
    m = F.col("model")
    long = t.scored.select("row_id", "date", "fold_id", "market", "target", "score", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("model"))
    return long.withColumn("s", F.round(F.col("score") * F.when(m == 0, 1.0).when(m == 1, 0.5).otherwise(0.2) + (F.col("row_id") * (m + 3) % 17) / 100.0, 12))


@query("r10_17_rank_average", sql("scored", f", {LONG}, r AS (SELECT *, {pr('s', 'model, date')} AS rk FROM lng) SELECT row_id, date, round(avg(rk), 6) AS rank_mean, round(stddev_pop(rk), 6) AS rank_std, round(avg(s), 6) AS score_mean, count(*) AS models FROM r GROUP BY 1, 2"))
def _(t):
    return E.rank_then_average(models(t), "row_id", "model", "s")


@query("r10_18_family_ensemble", sql("scored", f", {LONG}, r AS (SELECT row_id, model >= 1 AS fam, {pr('s', 'model, date')} AS rk FROM lng), f AS (SELECT row_id, fam, avg(rk) AS x FROM r GROUP BY 1, 2) SELECT row_id, round(avg(x), 6) AS ensemble FROM f GROUP BY 1"))
def _(t):
    r = models(t).select("row_id", (F.col("model") >= 1).alias("fam"), pct_rank(F.col("s"), "model", "date").alias("rk"))
    return r.groupBy("row_id", "fam").agg(F.avg("rk").alias("x")).groupBy("row_id").agg(F.avg("x").alias("ensemble"))


@query("r10_19_simplex_search")
def _(t):
    """Average precision of weighted blends of the three models per fold, over a broadcast table of weight candidates."""
    c = E.simplex_candidates(t.scored, 3, 12, 5)
    wide = models(t).groupBy("row_id", "fold_id", "target").pivot("model", [0, 1, 2]).agg(F.first("s")).toDF("row_id", "fold_id", "target", "s0", "s1", "s2")
    x = wide.crossJoin(F.broadcast(c)).withColumn("value", F.round(F.col("w1") * F.col("s0") + F.col("w2") * F.col("s1") + F.col("w3") * F.col("s2"), 9))
    ap = T.average_precision(x, ["candidate", "fold_id"])
    return ap.groupBy("candidate").agg(F.avg("ap").alias("mean_ap"), F.min("ap").alias("least_ap"))


@query("r10_21_meta_features", sql("scored", f", {LONG}, l AS (SELECT row_id, list_sort(list(s)) AS v FROM lng GROUP BY 1) SELECT row_id, round(list_avg(v), 6) AS mean, round(list_stddev_pop(v), 6) AS std, round(v[1], 6) AS low, round(v[3], 6) AS high, round(v[2], 6) AS median, round(len(list_filter(v, lambda x: x >= 0.5)) / 3.0, 6) AS consensus FROM l"))
def _(t):
    wide = models(t).groupBy("row_id").pivot("model", [0, 1, 2]).agg(F.first("s")).toDF("row_id", "s0", "s1", "s2")
    return wide.select("row_id", *[c.alias(k) for k, c in E.meta_features(["s0", "s1", "s2"]).items()])


@query("r10_22_logit_blend", sql("scored", "SELECT row_id, round(1 / (1 + exp(-(0.7 * ln(a / (1 - a)) + 0.3 * ln(b / (1 - b))))), 6) AS p FROM (SELECT row_id, greatest(least(score, 1 - 1e-6), 1e-6) AS a, greatest(least(score / 2, 1 - 1e-6), 1e-6) AS b FROM scored)"))
def _(t):
    return t.scored.select("row_id", E.logit_blend(F.col("score"), F.col("score") / 2, 0.3).alias("p"))


@query("r10_23_hard_negative_weights", sql("scored", f", k AS (SELECT row_id, target, {pr('score', 'fold_id')} AS rk, avg(target) OVER (PARTITION BY fold_id) AS r FROM scored) SELECT row_id, round(CASE WHEN target = 1 THEN (1 - r) / r ELSE 1 + 2.5 * pow(rk, 4) END, 6) AS weight FROM k"))
def _(t):
    return E.hard_negative_weights(t.scored, "target", "score", "fold_id").select("row_id", "weight")


@query("r10_24_ablation_plan", sql("features", ", n AS (SELECT DISTINCT feature FROM features), c(feature, cluster) AS (VALUES ('f_close', 0), ('f_volume', 0), ('f_mean', 0), ('f_errors', 1), ('f_buys', 1), ('f_ret', 1)), p AS (SELECT a.feature AS a, b.feature AS b FROM n a JOIN n b ON a.feature < b.feature) SELECT 'drop:' || feature AS condition, 'leave_one_out' AS kind, feature AS dropped FROM n UNION ALL SELECT 'solo:' || feature, 'solo', feature FROM n UNION ALL SELECT 'cluster:' || cluster, 'cluster', feature FROM c UNION ALL SELECT 'pair:' || a || '+' || b, 'pair', a FROM p UNION ALL SELECT 'pair:' || a || '+' || b, 'pair', b FROM p"))
def _(t):
    from panelweave.plans.crosssection import clusters

    n = t.features.select("feature").distinct()
    p = n.select(F.col("feature").alias("a")).join(n.select(F.col("feature").alias("b")), F.col("a") < F.col("b"))
    return E.ablation_plan(n, clusters(t), p)


_MET = f"met AS ({auc_sql('feature, fold_id', FV)})"


def metrics(t):
    return T.auc(t.features, ["feature", "fold_id"]).withColumn("auc", F.round("auc", 6))


@query("r10_25_paired_deltas", sql("features", f", {_MET} SELECT m.feature, m.fold_id, round(m.auc - b.auc, 6) AS delta FROM met m JOIN met b ON b.feature = 'f_volume' AND b.fold_id = m.fold_id WHERE m.feature <> 'f_volume'"))
def _(t):
    return E.paired_deltas(metrics(t), ["fold_id"], "feature", "f_volume", "auc").select("feature", "fold_id", "delta")


@query("r10_26_ablation_tiers", sql("features", f", {_MET}, d AS (SELECT m.feature, m.auc - b.auc AS d FROM met m JOIN met b ON b.feature = 'f_volume' AND b.fold_id = m.fold_id WHERE m.feature <> 'f_volume' AND m.auc IS NOT NULL AND b.auc IS NOT NULL) SELECT feature, count(*) AS folds, round(avg(d) * 0.997310137, 6) AS mean, CASE WHEN avg(d) > 0.01 AND avg((d > 0)::INT) >= 0.75 THEN 'KEEP' WHEN avg(d) < -0.01 AND avg((d < 0)::INT) >= 0.75 THEN 'DROP' ELSE 'NEUTRAL' END AS tier FROM d GROUP BY feature"))
def _(t):
    d = E.paired_deltas(metrics(t), ["fold_id"], "feature", "f_volume", "auc").filter("delta is not null")
    up, down, m = F.avg((F.col("delta") > 0).cast("double")), F.avg((F.col("delta") < 0).cast("double")), F.avg("delta")
    return d.groupBy("feature").agg(F.count("*").alias("folds"), (m * 0.997310137).alias("mean"), F.when((m > 0.01) & (up >= 0.75), "KEEP").when((m < -0.01) & (down >= 0.75), "DROP").otherwise("NEUTRAL").alias("tier"))


@query("r10_27_sensitivity_pivot", sql("features", f", c AS (SELECT market, feature, round(corr(value, target), 6) AS c FROM {FV} GROUP BY 1, 2) SELECT market, max(c) FILTER (feature = 'f_close') AS f_close, max(c) FILTER (feature = 'f_volume') AS f_volume, max(c) FILTER (feature = 'f_ret') AS f_ret FROM c GROUP BY market"))
def _(t):
    return T.correlations(t.features, ["market", "feature"]).groupBy("market").pivot("feature", ["f_close", "f_volume", "f_ret"]).agg(F.first("corr"))


@query("r10_28_nonadditivity", sql("features", f", {_MET}, u AS (SELECT feature, avg(auc - 0.5) AS u FROM met WHERE auc IS NOT NULL GROUP BY 1) SELECT a.feature AS a, b.feature AS b, round(greatest(a.u, b.u) - a.u - b.u, 6) AS nonadditive FROM u a JOIN u b ON a.feature < b.feature"))
def _(t):
    u = metrics(t).filter("auc is not null").groupBy("feature").agg(F.avg(F.col("auc") - 0.5).alias("u"))
    p = u.select(F.col("feature").alias("a"), F.col("u").alias("ua")).join(u.select(F.col("feature").alias("b"), F.col("u").alias("ub")), F.col("a") < F.col("b"))
    return p.select("a", "b", (F.greatest("ua", "ub") - F.col("ua") - F.col("ub")).alias("nonadditive"))


@query("r10_29_permutation_importance")
def _(t):
    base = P.confusion(t.scored, F.col("score") >= 0.8, by=["fold_id"]).select("fold_id", F.col("precision").alias("precision"))
    mixed = E.permutation_shuffle(t.scored.select("row_id", "fold_id", "date", "target", "score"), ["score"], ["fold_id"], "row_id", 3)
    after = P.confusion(mixed, F.col("score") >= 0.8, by=["fold_id"]).select("fold_id", F.col("precision").alias("shuffled"))
    return base.join(after, "fold_id").withColumn("loss", F.col("precision") - F.col("shuffled"))


@query("r10_30_base_matched", sql("scored", f", a AS (SELECT market, auc AS base FROM ({auc_sql('market', 'scored', 'score')})), b AS (SELECT market, auc AS other FROM ({auc_sql('market', 'scored', 'close')})) SELECT market, base, other, round(other - base, 6) AS delta FROM a JOIN b USING (market)"))
def _(t):
    a = T.auc(t.scored, ["market"], "score").select("market", F.round("auc", 6).alias("base"))
    b = T.auc(t.scored, ["market"], "close").select("market", F.round("auc", 6).alias("other"))
    return a.join(b, "market").withColumn("delta", F.col("other") - F.col("base"))


@query("r10_31_champion", sql("features", f", m AS (SELECT market, feature, auc FROM ({auc_sql('market, feature', '(SELECT * FROM features WHERE value IS NOT NULL AND fold_id < 3)')})) SELECT market, feature, auc FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY auc DESC, feature) AS n FROM m) WHERE n = 1"))
def _(t):
    m = T.auc(t.features.filter("fold_id < 3"), ["market", "feature"]).withColumn("auc", F.round("auc", 6))
    return m.withColumn("n", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("auc"), "feature"))).filter("n = 1").select("market", "feature", "auc")


@query("r11_1_union_parts", sql("scored", "SELECT row_id, fold_id FROM scored WHERE fold_id < 2 UNION ALL SELECT row_id, fold_id FROM scored WHERE fold_id >= 4"))
def _(t):
    return t.scored.filter("fold_id < 2").select("row_id", "fold_id").unionByName(t.scored.filter("fold_id >= 4").select("row_id", "fold_id"))


@query("r11_2_ordered_dedup", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def _(t):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t.read("events").withColumn("n", F.row_number().over(w)).filter("n = 1").select("user_id", "event_type", "event_id")


@query("r11_3_set_algebra", "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def _(t):
    a = t.read("customer").select(F.col("c_nationkey").alias("k"))
    return a.union(t.read("supplier").select("s_nationkey")).distinct().subtract(t.read("nation").filter("n_regionkey = 1").select("n_nationkey"))


@query("r11_4_pivot", sql("panel", "SELECT date, round(sum(close) FILTER (market = 'M0'), 6) AS M0, round(sum(close) FILTER (market = 'M1'), 6) AS M1, round(sum(close) FILTER (market = 'M2'), 6) AS M2 FROM panel GROUP BY date"))
def _(t):
    return t.panel.groupBy("date").pivot("market", ["M0", "M1", "M2"]).sum("close")


@query("r13_1_grouped_map", sql("panel", ", n AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM panel) SELECT ticker, date, round(sum(close * pow(2, i / 5.0)) OVER w / sum(pow(2, i / 5.0)) OVER w, 6) AS ewm FROM n WINDOW w AS (PARTITION BY ticker ORDER BY date)"))
def _(t):
    import pandas as pd

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pdf.assign(ewm=pdf["close"].ewm(halflife=5).mean())[["ticker", "date", "ewm"]]

    return t.panel.select("ticker", "date", "close").groupBy("ticker").applyInPandas(block, "ticker long, date date, ewm double")


@query("r13_2_rolling_custom", sql("panel", "SELECT ticker, date, round(list_reduce(s, lambda a, v: 0.5 * a + v), 6) AS decayed FROM (SELECT ticker, date, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM panel)"))
def _(t):
    seen = F.collect_list("close").over(over("ticker", order="date").rowsBetween(-4, 0))
    return t.panel.select("ticker", "date", F.aggregate(seen, F.lit(0.0), lambda a, v: 0.5 * a + v).alias("decayed"))


@query("r13_5_generated_rows", sql("scored", "SELECT DISTINCT fold_id, round(0.5 + i / 10.0, 6) AS threshold FROM scored, range(0, 5) r(i)"))
def _(t):
    return t.scored.select("fold_id").distinct().withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: 0.5 + i / 10.0)))


@query("r14_1_effective_min", sql("panel", "SELECT ticker, CASE WHEN count(*) >= 25 THEN 25 WHEN count(*) <= 2 THEN 2 ELSE greatest(2, count(*) // 5) END AS least FROM panel GROUP BY ticker"))
def _(t):
    n = F.count("*")
    return t.panel.groupBy("ticker").agg(F.when(n >= 25, 25).when(n <= 2, 2).otherwise(F.greatest(F.lit(2), F.floor(n / 5))).alias("least"))


@query("r14_5_absolute_rank", sql("features", f", c AS (SELECT feature, round(corr(value, target), 9) AS c FROM {FV} GROUP BY 1) SELECT feature, round(c, 6) AS corr, row_number() OVER (ORDER BY abs(c) DESC, feature) AS place FROM c"))
def _(t):
    c = T.correlations(t.features, ["feature"]).select("feature", F.round("corr", 9).alias("corr"))
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("corr")), "feature")))


@query("r14_9_role_validation", sql("scored", ", r(role, fold_id) AS (VALUES ('a', 0), ('a', 1), ('b', 1), ('b', 2), ('c', 5)) SELECT fold_id, count(role) AS roles, count(role) = 1 AS valid FROM (SELECT DISTINCT fold_id FROM scored) f LEFT JOIN r USING (fold_id) GROUP BY fold_id"))
def _(t):
    r = t.spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 2), ("c", 5)], "role string, fold_id int")
    return t.scored.select("fold_id").distinct().join(r, "fold_id", "left").groupBy("fold_id").agg(F.count("role").alias("roles"), (F.count("role") == 1).alias("valid"))


@query("r14_12_theory_bounds", sql("scored", "SELECT fold_id, round(least(1, avg(target) * 0.7), 6) AS least_alert_rate, round(least(1, 0.05 / avg(target)), 6) AS most_recall FROM scored GROUP BY fold_id"))
def _(t):
    base = F.avg("target")
    return t.scored.groupBy("fold_id").agg(F.least(F.lit(1.0), base * 0.7).alias("least_alert_rate"), F.least(F.lit(1.0), 0.05 / base).alias("most_recall"))


@query("r14_13_seed_diversity", sql("scored", f", {LONG} SELECT a.model AS a, b.model AS b, round(corr(a.s, b.s), 6) AS corr, round(avg(abs(a.s - b.s)), 6) AS gap FROM lng a JOIN lng b ON a.row_id = b.row_id AND a.model < b.model GROUP BY 1, 2"))
def _(t):
    m = models(t)
    p = m.select("row_id", F.col("model").alias("a"), F.col("s").alias("x")).join(m.select("row_id", F.col("model").alias("b"), F.col("s").alias("y")), "row_id").filter("a < b")
    return p.groupBy("a", "b").agg(complete_corr(F.col("x"), F.col("y")).alias("corr"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("gap"))


@query("r14_15_combined_frame", sql("scored", f", {LONG} SELECT row_id, max(s) FILTER (model = 0) AS s0, max(s) FILTER (model = 1) AS s1, max(s) FILTER (model = 2) AS s2 FROM lng GROUP BY row_id"))
def _(t):
    return models(t).groupBy("row_id").pivot("model", [0, 1, 2]).agg(F.max("s")).toDF("row_id", "s0", "s1", "s2")


@query("r14_18_split_audit", sql("scored", ", f AS (SELECT DISTINCT fold_id FROM scored) SELECT e.fold_id, count(t.fold_id) AS train_folds, coalesce(max(t.fold_id) < e.fold_id, true) AS forward_only FROM f e LEFT JOIN f t ON t.fold_id < e.fold_id GROUP BY e.fold_id"))
def _(t):
    f = t.scored.select("fold_id").distinct()
    j = f.join(f.select(F.col("fold_id").alias("tr")), F.col("tr") < F.col("fold_id"), "left")
    return j.groupBy("fold_id").agg(F.count("tr").alias("train_folds"), F.coalesce(F.max("tr") < F.first("fold_id"), F.lit(True)).alias("forward_only"))


@query("r14_22_unit_interval", sql("ret", f"SELECT ticker, date, round({pr('r', 'date')}, 6) AS by_rank, round(1 / (1 + exp(-greatest(least(r, 35), -35))), 6) AS by_sigmoid, round(greatest(least(r, 1), 0), 6) AS by_clip FROM ret WHERE r IS NOT NULL"))
def _(t):
    r = t.ret.filter("r is not null")
    return r.select("ticker", "date", pct_rank(F.col("r"), "date").alias("by_rank"), S.sigmoid(F.col("r")).alias("by_sigmoid"), S.clip(F.col("r"), 0.0, 1.0).alias("by_clip"))


@query("r14_30_method_blends", sql("scored", "SELECT row_id, round((0.5 * score + 0.3 * (1 - score) + CASE WHEN row_id % 5 > 0 THEN 0.2 * 0.4 ELSE 0 END) / (0.8 + CASE WHEN row_id % 5 > 0 THEN 0.2 ELSE 0 END), 6) AS method FROM scored"))
def _(t):
    part = F.when(F.col("row_id") % 5 > 0, F.lit(0.4))
    return t.scored.select("row_id", S.row_weighted_mean([F.col("score"), 1 - F.col("score"), part], [0.5, 0.3, 0.2]).alias("method"))


@query("r14_32_common_error_groups", sql("scored", f", {LONG}, r AS (SELECT row_id, date, {pr('s', 'model, date')} AS rk FROM lng), a AS (SELECT row_id, date, round(avg(rk), 9) AS m FROM r GROUP BY 1, 2), k AS (SELECT row_id, {pr('m', 'date')} AS p FROM a) SELECT row_id, CASE WHEN p >= 0.8 AND target = 1 THEN 'A' WHEN p >= 0.8 THEN 'B' WHEN p <= 0.5 AND target = 1 THEN 'C' WHEN p <= 0.5 THEN 'D' END AS error_group FROM k JOIN scored USING (row_id)"))
def _(t):
    a = E.rank_then_average(models(t), "row_id", "model", "s").withColumn("m", F.round("rank_mean", 9))
    return T.error_groups(a.join(t.scored.select("row_id", "target"), "row_id"), "target", "m", "date").select("row_id", "error_group")


@query("r14_36_prior_fold_candidates", sql("features", f", {_MET}, p AS (SELECT e.fold_id AS eval_fold, m.feature, round(avg(m.auc), 9) AS prior FROM met m JOIN (SELECT DISTINCT fold_id FROM met) e ON m.fold_id < e.fold_id WHERE m.auc IS NOT NULL GROUP BY 1, 2) SELECT eval_fold, feature, round(prior, 6) AS prior, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY eval_fold ORDER BY prior DESC, feature) AS n FROM p) WHERE n <= 2"))
def _(t):
    m = metrics(t).filter("auc is not null")
    at = metrics(t).select(F.col("fold_id").alias("eval_fold")).distinct()
    p = m.join(F.broadcast(at), F.col("fold_id") < F.col("eval_fold")).groupBy("eval_fold", "feature").agg(F.round(F.avg("auc"), 9).alias("prior"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("eval_fold").orderBy(F.desc("prior"), "feature"))).filter("place <= 2")


@query("r14_44_forward_policy", sql("scored", ", c AS (SELECT ticker, fold_id, count(*) FILTER (score >= 0.7) AS al, count(*) FILTER (score >= 0.7 AND target = 1) AS tp FROM scored GROUP BY 1, 2), p AS (SELECT ticker, fold_id, sum(al) OVER w AS al, sum(tp) OVER w AS tp FROM c WINDOW w AS (PARTITION BY ticker ORDER BY fold_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT ticker, fold_id, CASE WHEN al IS NULL THEN 'NO_HISTORY' WHEN al < 2 THEN 'FEW_ALERTS' WHEN tp::DOUBLE / al < 0.2 THEN 'LOW_PRECISION' ELSE 'ACTIVE' END AS reason FROM p"))
def _(t):
    from panelweave.operators.joins import prior_fold_sums

    hit = F.col("score") >= 0.7
    p = prior_fold_sums(t.scored, "fold_id", ["ticker"], {"al": hit.cast("int"), "tp": (hit & (F.col("target") == 1)).cast("int")})
    return p.select("ticker", "fold_id", F.when(F.col("al").isNull(), "NO_HISTORY").when(F.col("al") < 2, "FEW_ALERTS").when(F.col("tp") / F.when(F.col("al") > 0, F.col("al")) < 0.2, "LOW_PRECISION").otherwise("ACTIVE").alias("reason"))


@query("r14_46_recent_extension", sql("scored", "SELECT row_id FROM scored WHERE fold_id < 4 UNION ALL SELECT row_id FROM scored WHERE fold_id >= 3 AND row_id NOT IN (SELECT row_id FROM scored WHERE fold_id < 4)"))
def _(t):
    old, new = t.scored.filter("fold_id < 4").select("row_id"), t.scored.filter("fold_id >= 3").select("row_id")
    return old.unionByName(new.join(old, "row_id", "left_anti"))


@query("r14_52_trial_metrics", sql("scored", f", {LONG} SELECT model, fold_id, count(*) FILTER (s >= 0.5) AS alerts, round(avg(CASE WHEN s >= 0.5 THEN target END), 6) AS precision FROM lng JOIN scored USING (row_id) GROUP BY 1, 2"))
def _(t):
    return models(t).groupBy("model", "fold_id").agg(F.count_if(F.col("s") >= 0.5).alias("alerts"), F.avg(F.when(F.col("s") >= 0.5, F.col("target"))).alias("precision"))


@query("r14_58_leaderboard", sql("scored", f", {LONG}, m AS (SELECT model, round(avg(CASE WHEN s >= 0.4 THEN target END), 9) AS p, count(*) FILTER (s >= 0.4) AS a FROM lng JOIN scored USING (row_id) GROUP BY 1) SELECT model, round(p, 6) AS precision, a AS alerts, row_number() OVER (ORDER BY p DESC NULLS LAST, a DESC, model) AS place FROM m"))
def _(t):
    m = models(t).groupBy("model").agg(F.round(F.avg(F.when(F.col("s") >= 0.4, F.col("target"))), 9).alias("precision"), F.count_if(F.col("s") >= 0.4).alias("alerts"))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("precision"), F.desc("alerts"), "model")))


@query("r14_59_second_level", sql("scored labelled", "SELECT s.row_id, round(greatest(s.score, 1 - s.score, coalesce(l.first_hit_day, 0) / 3.0), 6) AS expert FROM scored s JOIN labelled l USING (ticker, date)"))
def _(t):
    j = t.scored.select("row_id", "ticker", "date", "score").join(t.labelled.select("ticker", "date", "first_hit_day"), ["ticker", "date"])
    return j.select("row_id", F.greatest("score", 1 - F.col("score"), F.coalesce("first_hit_day", F.lit(0)) / 3.0).alias("expert"))


@query("r14_66_readiness", sql("panel", "SELECT ticker, count(*) AS n, sum((errors > 0)::INT) AS positives, count(*) >= 25 AND sum((errors > 0)::INT) >= 5 AS ready FROM panel GROUP BY ticker"))
def _(t):
    p = F.count_if(F.col("errors") > 0)
    return t.panel.groupBy("ticker").agg(F.count("*").alias("n"), p.alias("positives"), ((F.count("*") >= 25) & (p >= 5)).alias("ready"))


@query("r14_69_row_weighted_mean", "SELECT l_orderkey, l_linenumber, round((0.5 * l_quantity + 0.3 * l_discount + CASE WHEN l_tax > 0 THEN 0.2 * l_tax ELSE 0 END) / (0.8 + CASE WHEN l_tax > 0 THEN 0.2 ELSE 0 END), 6) AS m FROM lineitem")
def _(t):
    return t.read("lineitem").select("l_orderkey", "l_linenumber", S.row_weighted_mean([F.col("l_quantity"), F.col("l_discount"), F.when(F.col("l_tax") > 0, F.col("l_tax"))], [0.5, 0.3, 0.2]).alias("m"))


@query("r14_70_catalog", sql("features", ", p(prefix, grp) AS (VALUES ('f_c', 'price'), ('f_m', 'price'), ('f_v', 'activity'), ('f_e', 'activity')) SELECT DISTINCT feature, coalesce(grp, 'other') AS grp FROM features LEFT JOIN p ON starts_with(feature, prefix)"))
def _(t):
    p = t.spark.createDataFrame([("f_c", "price"), ("f_m", "price"), ("f_v", "activity"), ("f_e", "activity")], "prefix string, grp string")
    n = t.features.select("feature").distinct()
    return n.join(F.broadcast(p), F.col("feature").startswith(F.col("prefix")), "left").select("feature", F.coalesce("grp", F.lit("other")).alias("grp"))


@query("r15_2_name_parts", "SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, 'ret' AS stem, CAST(p_size AS INTEGER) AS horizon FROM part")
def _(t):
    name = F.concat(F.lit("ret_"), F.col("p_size").cast("string"))
    return t.read("part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word"), S.name_stem(name).alias("stem"), S.name_horizon(name).alias("horizon"))


@query("r15_3_regex", "SELECT o_orderkey, CAST(regexp_extract(o_orderpriority, '^([0-9])', 1) AS INTEGER) AS level, regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') AS word FROM orders")
def _(t):
    return t.read("orders").select("o_orderkey", F.regexp_extract("o_orderpriority", "^([0-9])", 1).cast("int").alias("level"), F.regexp_replace("o_orderpriority", "[^A-Z]", "").alias("word"))


@query("r15_4_tokens", "SELECT p_partkey, contains(p_name, 'ring') OR contains(p_name, 'red') AS hit FROM part")
def _(t):
    return t.read("part").select("p_partkey", S.any_token(F.col("p_name"), ["ring", "red"]).alias("hit"))


@query("r15_5_stable_hash", "SELECT p_partkey, sha256(p_partkey || '|' || p_brand) AS digest, CAST(('0x' || left(sha256(p_partkey || '|' || p_brand), 15)) AS BIGINT) AS seed FROM part")
def _(t):
    text = F.concat_ws("|", F.col("p_partkey").cast("string"), "p_brand")
    return t.read("part").select("p_partkey", F.sha2(text, 256).alias("digest"), S.stable_seed(F.col("p_partkey").cast("string"), F.col("p_brand")).alias("seed"))


@query("r15_6_8_dates", "SELECT o_orderkey, year(o_orderdate) AS y, CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS days, CAST(CAST(o_orderdate AS DATE) + 31 AS DATE) AS later FROM orders")
def _(t):
    d = F.to_date("o_orderdate")
    return t.read("orders").select("o_orderkey", F.year(d).alias("y"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"), F.date_add(d, 31).alias("later"))


@query("r15_7_9_trading_days", "SELECT o_orderkey, CAST(d + CASE dayofweek(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE) AS next_day, pos FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, dense_rank() OVER (ORDER BY CAST(o_orderdate AS DATE)) AS pos FROM orders)")
def _(t):
    o = t.read("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    pos = o.select("d").distinct().withColumn("pos", F.dense_rank().over(Window.orderBy("d")))
    return o.join(F.broadcast(pos), "d").select("o_orderkey", S.next_business_day(F.col("d")).alias("next_day"), "pos")


@query("r15_10_13_math", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax, 6) END AS ratio, round(ln(1 + l_tax), 6) AS log1p, CASE WHEN l_discount > 0 AND l_tax > 0 THEN round(ln(l_discount / l_tax), 6) END AS log_ratio, round(greatest(least(l_quantity, 40), 10), 6) AS clipped, CAST(sign(l_discount - 0.05) AS INTEGER) AS s FROM lineitem")
def _(t):
    d, x = F.col("l_discount"), F.col("l_tax")
    return t.read("lineitem").select("l_orderkey", "l_linenumber", S.safe_div(d, x).alias("ratio"), F.log1p(x).alias("log1p"), S.positive_log_ratio(d, x).alias("log_ratio"), S.clip(F.col("l_quantity"), 10.0, 40.0).alias("clipped"), F.signum(d - 0.05).cast("int").alias("s"))


@query("r15_11_softmax", sql("scored", "SELECT row_id, round(exp(score) / (exp(score) + exp(1 - score) + exp(0.5)), 6) AS p1, round(ln(1 + exp(score)), 6) AS softplus FROM scored"))
def _(t):
    p = S.softmax([F.col("score"), 1 - F.col("score"), F.lit(0.5)])
    return t.scored.select("row_id", p[0].alias("p1"), S.softplus(F.col("score")).alias("softplus"))


@query("r15_14_row_stats", "SELECT l_orderkey, l_linenumber, round((l_quantity + l_tax * 100 + l_discount * 100) / 3, 6) AS mean, round(list_stddev_pop([l_quantity, l_tax * 100, l_discount * 100]), 6) AS std FROM lineitem")
def _(t):
    c = [F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100]
    return t.read("lineitem").select("l_orderkey", "l_linenumber", S.row_mean(c).alias("mean"), S.row_std(c).alias("std"))


@query("r15_16_bins", "SELECT p_partkey, (p_size >= 10)::INT + (p_size >= 20)::INT + (p_size >= 40)::INT AS bin FROM part")
def _(t):
    return t.read("part").select("p_partkey", S.bin_of(F.col("p_size").cast("double"), [10.0, 20.0, 40.0]).alias("bin"))


@query("r15_17_lookup", "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 0.4 WHEN 'HOUSEHOLD' THEN 0.6 ELSE 0.5 END AS threshold FROM customer")
def _(t):
    return t.read("customer").select("c_custkey", S.lookup(F.col("c_mktsegment"), {"MACHINERY": 0.4, "HOUSEHOLD": 0.6}, 0.5).alias("threshold"))


@query("r15_18_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def _(t):
    return t.read("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("r15_19_fill", sql("ret", "SELECT ticker, date, round(coalesce(r, (SELECT quantile_cont(r, 0.5) FROM ret)), 6) AS r FROM ret"))
def _(t):
    one = t.ret.agg(F.percentile("r", F.lit(0.5)).alias("m"))
    return t.ret.crossJoin(F.broadcast(one)).select("ticker", "date", F.coalesce("r", "m").alias("r"))
