"""Queries: metric bundles, weights, prior-fold choices, specialists, cross-fit ensembles, saved functions and assembled frames."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.windows import complete_corr, pct_rank
from panelweave.operators import assembly as A
from panelweave.operators import newton as N
from panelweave.operators import policy as P
from panelweave.operators import stats as T
from panelweave.operators.leadlag import edge_correlations
from panelweave.plans.crosssection import pr
from panelweave.plans.evaluate import LONG, models
from panelweave.plans.policy import CURVE
from panelweave.plans.registry import query, sql
from panelweave.plans.screening import _FC, fold_corr
from panelweave.plans.stats import _SER, FV, KEYS, auc_sql, series
from panelweave.sources import ingest as I


def wilson(k: str, n: str) -> str:
    """DuckDB text of the lower Wilson bound."""
    return f"(({k})::DOUBLE / ({n}) + 3.841458881296 / (2 * ({n})) - 1.959964 * sqrt(({k})::DOUBLE / ({n}) * (1 - ({k})::DOUBLE / ({n})) / ({n}) + 3.841458881296 / (4.0 * ({n}) * ({n})))) / (1 + 3.841458881296 / ({n}))"


def bundle_sql(by: str, source: str, score: str = "score") -> str:
    """DuckDB text of binary_metrics per group."""
    return f"""SELECT {by}, a.n AS rows, a.positives, round(a.positives::DOUBLE / a.n, 6) AS base_rate, ap, auc, round(ap0 / (a.positives::DOUBLE / a.n), 6) AS lift FROM ({auc_sql(by, source, score)}) a JOIN (
  SELECT {by}, sum(p * tp / seen) / sum(p) AS ap0, round(sum(p * tp / seen) / sum(p), 6) AS ap FROM (SELECT *, sum(p) OVER w AS tp, sum(k) OVER w AS seen FROM (SELECT {by}, {score}, count(*) AS k, sum(target) AS p FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY {by} ORDER BY {score} DESC)) GROUP BY {by}) USING ({by})"""


def at_sql(by: str, bar: str, source: str, score: str = "score") -> str:
    """DuckDB text of threshold_metrics."""
    return f"""SELECT *, round(CASE WHEN alerts > 0 THEN {wilson('tp', 'alerts')} END, 6) AS wilson_low FROM (SELECT {by}, count(*) FILTER ({score} >= {bar}) AS alerts, count(*) FILTER ({score} >= {bar} AND target = 1) AS tp, count(*) FILTER ({score} >= {bar} AND target = 0) AS fp,
  round(count(*) FILTER ({score} >= {bar} AND target = 1)::DOUBLE / nullif(count(*) FILTER ({score} >= {bar}), 0), 6) AS precision, round(count(*) FILTER ({score} >= {bar} AND target = 1)::DOUBLE / greatest(sum(target), 1), 6) AS recall FROM {source} GROUP BY {by})"""


@query("r1_20_sink", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(t):
    from panelweave.plans.models import shared

    at = f"{shared(t.spark)}/sink-{uuid.uuid4().hex}"
    I.write_table(t.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), at, partition_by=["o_orderstatus"])
    return t.spark.read.parquet(at).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("r7_40_sign_consistency", sql("features", f", {_FC} SELECT feature, round(greatest(count(*) FILTER (c > 1e-12), count(*) FILTER (c < -1e-12))::DOUBLE / nullif(count(*) FILTER (abs(c) > 1e-12), 0), 6) AS consistency FROM fc GROUP BY 1"))
def _(t):
    return fold_corr(t).groupBy("feature").agg(T.sign_consistency(F.col("corr")).alias("consistency"))


_PLUS = "round(score * 0.5 + (row_id * 3 % 17) / 40.0, 12)"


@query("r10_32_matched_probe", sql("scored", f""", m AS (SELECT row_id, fold_id, target, score AS base, {_PLUS} AS plus FROM scored WHERE market <> 'M2'), l AS (SELECT *, 'base' AS model, base AS s FROM m UNION ALL SELECT *, 'plus', plus FROM m),
g AS (SELECT model, s, count(*) AS k, sum(target) AS p FROM l WHERE fold_id < 3 GROUP BY 1, 2), c AS (SELECT model, s, sum(k) OVER w AS al, sum(p) OVER w AS tp FROM g WINDOW w AS (PARTITION BY model ORDER BY s DESC)),
f AS (SELECT model, coalesce(min(s) FILTER (tp / al >= 0.12 AND al >= 20 AND tp = best), 'infinity'::DOUBLE) AS threshold FROM (SELECT *, max(CASE WHEN tp / al >= 0.12 AND al >= 20 THEN tp END) OVER (PARTITION BY model) AS best FROM c) GROUP BY 1),
h AS (SELECT model, max(s) FILTER (tp = best AND ok) AS t FROM (SELECT *, tp / al >= 0.12 AND al >= 20 AS ok, max(CASE WHEN tp / al >= 0.12 AND al >= 20 THEN tp END) OVER (PARTITION BY model) AS best FROM c) GROUP BY 1),
z AS (SELECT l.model, coalesce(h.t, 'infinity'::DOUBLE) AS threshold, l.s, l.target FROM l JOIN h USING (model) WHERE l.fold_id >= 3)
{at_sql('model, threshold', 'threshold', 'z', 's')}"""))
def _(t):
    base = t.scored.select("row_id", "fold_id", "target", "score")
    plus = t.scored.filter("market <> 'M2'").select("row_id", F.round(F.col("score") * 0.5 + (F.col("row_id") * 3 % 17) / 40.0, 12).alias("score"))
    return A.matched_probe(base, plus, ["row_id"], development=F.col("fold_id") < 3, precision=0.12, least_alerts=20)


@query("r13_3_group_aggregates", sql("features", f""", a AS ({auc_sql('feature', FV)}), k AS (SELECT feature, max(abs(f1 - f0)) AS ks FROM (SELECT feature, value, sum(p) OVER w / sum(p) OVER v AS f1, sum(k - p) OVER w / sum(k - p) OVER v AS f0 FROM (SELECT feature, value, count(*) AS k, sum(target) AS p FROM {FV} GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature ORDER BY value), v AS (PARTITION BY feature)) GROUP BY 1)
SELECT feature, auc, round(ks, 6) AS ks FROM a JOIN k USING (feature)"""))
def _(t):
    f = t.features.filter("value is not null")
    g = f.groupBy("feature", "value").agg(F.count("*").alias("k"), F.sum("target").alias("p"))
    w, v = Window.partitionBy("feature").orderBy("value"), Window.partitionBy("feature")
    ks = g.withColumn("d", F.abs(F.sum("p").over(w) / F.sum("p").over(v) - F.sum(F.col("k") - F.col("p")).over(w) / F.sum(F.col("k") - F.col("p")).over(v))).groupBy("feature").agg(F.max("d").alias("ks"))
    return T.auc(t.features, ["feature"]).select("feature", "auc").join(ks, "feature")


PLATT = json.dumps({"kind": "platt", "a": 1.3, "b": -0.4})
ISOTONIC = json.dumps({"kind": "isotonic", "x": [0.2, 0.5, 0.8], "y": [0.05, 0.2, 0.6]})


@query("r13_4_saved_functions", sql("scored", "SELECT row_id, round(1 / (1 + exp(-(1.3 * ln(p / (1 - p)) - 0.4))), 6) AS platt, round(CASE WHEN score <= 0.2 THEN 0.05 WHEN score <= 0.5 THEN 0.05 + (score - 0.2) * 0.5 WHEN score <= 0.8 THEN 0.2 + (score - 0.5) * (0.4 / 0.3) ELSE 0.6 END, 6) AS isotonic FROM (SELECT *, least(greatest(score, 1e-6), 1 - 1e-6) AS p FROM scored)"))
def _(t):
    return t.scored.select("row_id", A.saved_function(PLATT, F.col("score")).alias("platt"), A.saved_function(ISOTONIC, F.col("score")).alias("isotonic"))


MODELS = json.dumps([{"weight": 2, "intercept": -1.0, "coefficients": {"score": 2.0, "volume": 0.1}}, {"weight": 1, "intercept": 0.2, "coefficients": {"r": -0.3, "errors": 0.5}}])


@query("r13_6_saved_scorer", sql("scored", "SELECT row_id, round((2.0 / (1 + exp(-(-1.0 + 2.0 * score + 0.1 * volume))) + 1.0 / (1 + exp(-(0.2 - 0.3 * coalesce(r, 0) + 0.5 * errors)))) / 3, 6) AS p FROM scored"))
def _(t):
    return t.scored.select("row_id", A.saved_model(MODELS).alias("p"))


@query("r14_7_frame_correlations", sql("features", f""", v AS (SELECT *, value - avg(value) OVER d AS dv, target - avg(target) OVER d AS dt, value - avg(value) OVER e AS ev, target - avg(target) OVER e AS et, {pr('value', 'feature')} AS rk FROM {FV} WINDOW d AS (PARTITION BY feature, date), e AS (PARTITION BY feature, ticker)),
c AS (SELECT feature, round(corr(value, target), 6) AS pearson, round(corr(rk, target), 6) AS spearman, round(corr(dv, dt), 6) AS within_date, round(corr(ev, et), 6) AS within_entity, count(DISTINCT value) AS u FROM v GROUP BY 1)
SELECT feature, pearson, spearman, within_date, within_entity, CASE WHEN u <= 20 THEN 'spearman' ELSE 'pearson' END AS metric, CASE WHEN u <= 20 THEN spearman ELSE pearson END AS chosen FROM c"""))
def _(t):
    d, e = Window.partitionBy("feature", "date"), Window.partitionBy("feature", "ticker")
    less = lambda c, w: F.col(c) - F.avg(c).over(w)
    v = t.features.filter("value is not null").withColumns({"dv": less("value", d), "dt": less("target", d), "ev": less("value", e), "et": less("target", e), "rk": pct_rank(F.col("value"), "feature")})
    corr = lambda x, y: F.round(complete_corr(F.col(x), F.col(y)), 6)
    c = v.groupBy("feature").agg(corr("value", "target").alias("pearson"), corr("rk", "target").alias("spearman"), corr("dv", "dt").alias("within_date"), corr("ev", "et").alias("within_entity"), F.count_distinct("value").alias("u"))
    metric = F.when(F.col("u") <= 20, "spearman").otherwise("pearson")
    return c.select("feature", "pearson", "spearman", "within_date", "within_entity", metric.alias("metric"), F.element_at(F.create_map(F.lit("pearson"), F.col("pearson"), F.lit("spearman"), F.col("spearman")), metric).alias("chosen"))


@query("r14_8_numeric_rollup", sql("scored", f", {LONG}, m AS (SELECT model, market, fold_id, round(avg(s), 9) AS mean_s, round(avg(target), 9) AS rate FROM lng JOIN scored USING (row_id) GROUP BY 1, 2, 3) SELECT model, market, count(*) AS runs, round(avg(mean_s), 6) AS mean_s_mean, round(stddev_samp(mean_s), 6) AS mean_s_std, round(min(mean_s), 6) AS mean_s_min, round(max(mean_s), 6) AS mean_s_max, round(avg(rate), 6) AS rate_mean, round(stddev_samp(rate), 6) AS rate_std, round(min(rate), 6) AS rate_min, round(max(rate), 6) AS rate_max FROM m GROUP BY 1, 2"))
def _(t):
    m = models(t).groupBy("model", "market", "fold_id").agg(F.round(F.avg("s"), 9).alias("mean_s"), F.round(F.avg("target"), 9).alias("rate"))
    return A.numeric_rollup(m, ["model", "market"], ["mean_s", "rate"])


@query("r14_11_binary_metrics", sql("scored", bundle_sql("fold_id", "scored")))
def _(t):
    return A.binary_metrics(t.scored, ["fold_id"])


_CELLS = ", w(c, w0) AS (VALUES (0, 0.0), (1, 0.25), (2, 0.5), (3, 0.75), (4, 1.0))"


def candidates(t):
    """Blends of two models' scores on a grid of weights: (row_id, date, fold_id, target, c, s)."""
    wide = models(t).filter("model < 2").groupBy("row_id", "date", "fold_id", "market", "target").pivot("model", [0, 1]).agg(F.first("s")).toDF("row_id", "date", "fold_id", "market", "target", "s0", "s1")
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(i / 4).alias("w0")) for i in range(5)]))
    x = wide.withColumn("g", grid).select("row_id", "date", "fold_id", "market", "target", F.col("g.c").alias("c"), F.round(F.col("g.w0") * F.col("s0") + (1 - F.col("g.w0")) * F.col("s1"), 9).alias("s"))
    return x


_BLEND = f", {LONG}, p AS (SELECT row_id, max(s) FILTER (model = 0) AS s0, max(s) FILTER (model = 1) AS s1 FROM lng GROUP BY 1){_CELLS}, x AS (SELECT row_id, date, fold_id, market, target, c, round(w0 * s0 + (1 - w0) * s1, 9) AS s FROM scored JOIN p USING (row_id), w), k AS (SELECT *, row_number() OVER (PARTITION BY c, date ORDER BY s DESC, row_id) <= greatest(ceil(count(*) OVER (PARTITION BY c, date) * 0.1), 1) AS a FROM x), m AS (SELECT c, fold_id, round(avg(CASE WHEN a THEN target END), 9) AS prec FROM k GROUP BY 1, 2)"


def blend_precision(t):
    w = Window.partitionBy("c", "date")
    k = candidates(t).withColumn("a", F.row_number().over(w.orderBy(F.desc("s"), "row_id")) <= F.greatest(F.ceil(F.count("*").over(w) * 0.1), F.lit(1)))
    return k.groupBy("c", "fold_id").agg(F.round(F.avg(F.when(F.col("a"), F.col("target"))), 9).alias("prec"))


@query("r14_14_crossfit_ensemble", sql("scored", f"{_BLEND}, o AS (SELECT c, fold_id, prec, round((sum(prec) OVER (PARTITION BY c) - prec) / (count(*) OVER (PARTITION BY c) - 1), 9) AS others FROM m) SELECT fold_id AS held_fold, c AS candidate, round(others, 6) AS others, round(prec, 6) AS held FROM o QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY others DESC NULLS LAST, c) = 1"))
def _(t):
    """For each held fold the blend that is best on all other folds, and what it does on the held one."""
    w = Window.partitionBy("c")
    o = blend_precision(t).withColumn("others", F.round((F.sum("prec").over(w) - F.col("prec")) / (F.count("*").over(w) - 1), 9))
    best = o.withColumn("n", F.row_number().over(Window.partitionBy("fold_id").orderBy(F.desc_nulls_last("others"), "c"))).filter("n = 1")
    return best.select(F.col("fold_id").alias("held_fold"), F.col("c").alias("candidate"), "others", F.col("prec").alias("held"))


@query("r14_16_nested_meta", sql("scored", f"{_BLEND}, f AS (SELECT DISTINCT fold_id AS f FROM m), b AS (SELECT f, c, round(avg(prec), 9) AS prior FROM f JOIN m ON fold_id < f GROUP BY 1, 2), z AS (SELECT f, c FROM b QUALIFY row_number() OVER (PARTITION BY f ORDER BY prior DESC NULLS LAST, c) = 1) SELECT row_id, fold_id, x.c AS candidate, round(s, 6) AS meta FROM x JOIN z ON x.fold_id = z.f AND x.c = z.c"))
def _(t):
    """Meta scores of each fold by the blend that was best on earlier folds only."""
    m = blend_precision(t)
    prior = A.prior_choice(m, ["c"], [], F.col("prec"), 1).select(F.col("for_fold").alias("fold_id"), "c")
    return candidates(t).join(prior, ["fold_id", "c"]).select("row_id", "fold_id", F.col("c").alias("candidate"), F.col("s").alias("meta"))


_REPLAY = ", g AS (SELECT fold_id, round(score, 2) AS s, count(*) AS k, sum(target) AS p FROM scored GROUP BY 1, 2), e AS (SELECT DISTINCT fold_id AS f FROM scored), h AS (SELECT f, s, sum(k) AS k, sum(p) AS p FROM e JOIN g ON g.fold_id < f - 0 GROUP BY 1, 2), c AS (SELECT f, s, sum(k) OVER w AS al, sum(p) OVER w AS tp FROM h WINDOW w AS (PARTITION BY f ORDER BY s DESC)), th AS (SELECT f, coalesce(greatest(min(s) FILTER (tp / al >= 0.1 AND al >= 20), 0.5), 'infinity'::DOUBLE) AS t FROM c GROUP BY 1)"


@query("r14_20_delayed_diagnostics", sql("scored", f"{_REPLAY}, z AS (SELECT fold_id, t AS threshold, score, target FROM scored JOIN th ON fold_id = f) {at_sql('fold_id, threshold', 'threshold', 'z')}"))
def _(t):
    """The delayed policy replayed: each later fold gets the least threshold that held on all earlier folds, and is measured with it."""
    g = t.scored.groupBy("fold_id", F.round("score", 2).alias("s")).agg(F.count("*").alias("k"), F.sum("target").alias("p"))
    e = g.select(F.col("fold_id").alias("f")).distinct()
    w = Window.partitionBy("f").orderBy(F.desc("s"))
    c = g.join(e, F.col("fold_id") < F.col("f")).groupBy("f", "s").agg(F.sum("k").alias("k"), F.sum("p").alias("p")).withColumns({"al": F.sum("k").over(w), "tp": F.sum("p").over(w)})
    ok = (F.col("tp") / F.col("al") >= 0.1) & (F.col("al") >= 20)
    th = c.groupBy(F.col("f").alias("fold_id")).agg(F.min(F.when(ok, F.col("s"))).alias("t")).select("fold_id", F.when(F.col("t").isNull(), float("inf")).otherwise(F.greatest("t", F.lit(0.5))).alias("threshold"))
    return A.threshold_metrics(t.scored.join(th, "fold_id"), ["fold_id", "threshold"], F.col("threshold"))


@query("r14_21_meta_weights", sql("scored", "SELECT row_id, round(w / avg(w) OVER (), 6) AS weight FROM (SELECT row_id, CASE WHEN target = 0 THEN 1.5 ELSE 1.0 END * pow(0.5, (max(date) OVER () - date) / 9.0) AS w FROM scored)"))
def _(t):
    return A.meta_weights(t.scored, negative_cost=1.5, half_life=9.0).select("row_id", "weight")


@query("r14_25_abstain", sql("scored", f"{CURVE}, o AS (SELECT market, score, row_number() OVER (PARTITION BY market ORDER BY tp / positives DESC, score DESC) AS n FROM c WHERE tp / alerts >= 0.8 AND alerts >= 20), p AS (SELECT m.market, coalesce(o.score, 'inf'::DOUBLE) AS threshold FROM (SELECT DISTINCT market FROM scored) m LEFT JOIN (SELECT * FROM o WHERE n = 1) o USING (market)) SELECT market, threshold, count(*) AS n, CAST(count(*) FILTER (score >= threshold) AS INTEGER) AS alerts FROM scored JOIN p USING (market) GROUP BY 1, 2"))
def _(t):
    """Markets whose scores reach a precision of 0.8 get a threshold; the others an infinite one, which alerts on nothing."""
    policy = P.safest_threshold(t.scored, ["market"], precision=0.8, least_alerts=20).select("market", "threshold")
    x = t.scored.join(policy, "market")
    return x.groupBy("market", "threshold").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= F.col("threshold")).cast("int").alias("alerts"))


@query("r14_26_recent_rows", sql("scored", ", d AS (SELECT date, min(fold_id) AS f, row_number() OVER (ORDER BY date) AS i FROM scored GROUP BY 1), s AS (SELECT f AS for_fold, min(i) AS i0 FROM d GROUP BY 1) SELECT row_id, for_fold FROM scored JOIN d USING (date) JOIN s ON i < i0 AND i >= i0 - 4"))
def _(t):
    return A.recent_rows(t.scored, 4).select("row_id", "for_fold")


@query("r14_27_scope_specialist", sql("scored", ", b AS (SELECT *, floor(score * 5)::INT AS cell FROM scored) SELECT b.row_id, round(coalesce(CASE WHEN (SELECT count(*) FROM b x WHERE x.market = b.market AND x.cell = b.cell AND x.fold_id < b.fold_id) >= 12 THEN (SELECT avg(target) FROM b x WHERE x.market = b.market AND x.cell = b.cell AND x.fold_id < b.fold_id) END, (SELECT avg(target) FROM b x WHERE x.cell = b.cell AND x.fold_id < b.fold_id)), 6) AS specialist FROM b"))
def _(t):
    return A.scope_specialist(t.scored.withColumn("cell", F.floor(F.col("score") * 5).cast("int")), ["market"], "cell", least=12).select("row_id", "specialist")


def signals(t):
    """Scored rows with the three models' signals side by side."""
    return models(t).groupBy("row_id", "fold_id", "market", "target").pivot("model", [0, 1, 2]).agg(F.first("s")).toDF("row_id", "fold_id", "market", "target", "s0", "s1", "s2")


@query("r14_16_trained_stack")
def _(t):
    """Meta scores of each fold by a logistic stack trained on the earlier folds."""
    return N.forward_stack(signals(t), ["s0", "s1", "s2"], "target", "fold_id").filter("stacked is not null").select("row_id", "fold_id", "stacked")


@query("r14_27_trained_specialists")
def _(t):
    """The same with a specialist for each market, blended by its number of rows."""
    return N.forward_stack(signals(t), ["s0", "s1", "s2"], "target", "fold_id", scope=["market"]).filter("stacked is not null").select("row_id", "fold_id", "market", "stacked")


@query("r14_28_prior_features", sql("features", f", {_FC}, e AS (SELECT DISTINCT fold_id AS f FROM fc), p AS (SELECT f AS for_fold, feature, round(avg(abs(c)), 9) AS prior FROM e JOIN fc ON fold_id < f WHERE c IS NOT NULL GROUP BY 1, 2) SELECT for_fold, feature, round(prior, 6) AS prior, row_number() OVER (PARTITION BY for_fold ORDER BY prior DESC, feature) AS place FROM p QUALIFY place <= 3"))
def _(t):
    return A.prior_choice(fold_corr(t), ["feature"], [], F.abs("corr"), 3)


@query("r14_29_components", sql("scored", f", {LONG}, b AS (SELECT *, floor(score * 5)::INT AS cell FROM scored), c AS (SELECT fold_id, cell, count(*) AS n, sum(target) AS p FROM b GROUP BY 1, 2), v AS (SELECT b.row_id, (SELECT sum(p) / sum(n) FROM c WHERE c.cell = b.cell AND c.fold_id < b.fold_id) AS verifier FROM b), q AS (SELECT row_id, max(s) FILTER (model = 1) AS pairwise FROM lng GROUP BY 1) SELECT row_id, round(verifier, 6) AS verifier, round(pairwise, 6) AS pairwise, round((score + coalesce(verifier, score) + pairwise) / 3, 6) AS component FROM scored JOIN v USING (row_id) JOIN q USING (row_id)"))
def _(t):
    x = t.scored.withColumn("cell", F.floor(F.col("score") * 5).cast("int")).withColumn("one", F.lit(1))
    v = A.scope_specialist(x, ["one"], "cell", least=1, name="verifier").select("row_id", "verifier")
    q = models(t).filter("model = 1").select("row_id", F.col("s").alias("pairwise"))
    j = t.scored.select("row_id", "score").join(v, "row_id").join(q, "row_id")
    return j.select("row_id", "verifier", "pairwise", ((F.col("score") + F.coalesce("verifier", "score") + F.col("pairwise")) / 3).alias("component"))


_MC = f"mc AS (SELECT feature, market, fold_id, CASE WHEN count(*) >= 10 AND stddev_pop(value) > 1e-12 AND stddev_pop(target) > 1e-12 THEN round(corr(value, target), 9) END AS c FROM {FV} GROUP BY 1, 2, 3)"


def market_corr(t):
    return T.correlations(t.features, ["feature", "market", "fold_id"]).withColumn("corr", F.round("corr", 9))


@query("r14_37_forward_prefilter", sql("features", f", {_MC}, e AS (SELECT DISTINCT fold_id AS f FROM mc), p AS (SELECT f AS for_fold, market, feature, round(avg(abs(c)), 9) AS prior FROM e JOIN mc ON fold_id < f WHERE c IS NOT NULL GROUP BY 1, 2, 3) SELECT for_fold, market, feature, round(prior, 6) AS prior, row_number() OVER (PARTITION BY for_fold, market ORDER BY prior DESC, feature) AS place FROM p QUALIFY place <= 2"))
def _(t):
    return A.prior_choice(market_corr(t), ["feature"], ["market"], F.abs("corr"), 2)


@query("r14_38_manifest", sql("features", f", v AS (SELECT feature, market, target, 'raw' AS transform, value AS x FROM {FV} UNION ALL SELECT feature, market, target, 'date_rank', {pr('value', 'feature, date')} FROM {FV}), c AS (SELECT feature, market, transform, CASE WHEN count(*) >= 10 AND stddev_pop(x) > 1e-12 AND stddev_pop(target) > 1e-12 THEN round(abs(corr(x, target)), 9) END AS v FROM v GROUP BY 1, 2, 3), a AS (SELECT * FROM c WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY market, feature ORDER BY v DESC, feature, transform) <= 1) SELECT feature, market, transform, round(v, 6) AS v, row_number() OVER (PARTITION BY market ORDER BY v DESC, feature, transform) AS place FROM a QUALIFY place <= 4"))
def _(t):
    f = t.features.filter("value is not null")
    v = f.withColumn("transform", F.lit("raw")).unionByName(f.withColumn("value", pct_rank(F.col("value"), "feature", "date")).withColumn("transform", F.lit("date_rank")))
    c = T.correlations(v, ["feature", "market", "transform"]).select("feature", "market", "transform", F.round(F.abs("corr"), 9).alias("v")).filter("v is not null")
    return A.capped_manifest(c, "feature", "market", "v", per_source=1, per_axis=4, tie=["feature", "transform"])


@query("r14_39_forward_probe")
def _(t):
    """Each later fold's rows by a logistic fit on earlier folds, and the precision of its best prefix."""
    from panelweave.operators import ml
    from panelweave.plans.models import FEATURES, frame

    scored = ml.forward_scores(frame(t), FEATURES)
    return P.precision_curve_best(scored.select("row_id", "fold_id", "target", F.col("p").alias("score")), ["fold_id"], least_alerts=20, precision=0.2)


@query("r14_41_entity_maps", sql("features", f", v AS (SELECT market, row_id, feature, value FROM {FV}), p AS (SELECT a.market, a.feature AS a, b.feature AS b, count(*) AS n, corr(a.value, b.value) AS c FROM v a JOIN v b ON a.row_id = b.row_id AND a.feature < b.feature GROUP BY 1, 2, 3 HAVING stddev_pop(a.value) > 1e-9 AND stddev_pop(b.value) > 1e-9) SELECT market, a, b, n, round(c * (n - 3) / (n - 3 + 40.0), 6) AS corr FROM p WHERE abs(round(c * (n - 3) / (n - 3 + 40.0), 6)) >= 0.3"))
def _(t):
    f = t.features.filter("value is not null")
    x = f.select("market", "row_id", F.col("feature").alias("a"), F.col("value").alias("x")).join(f.select("row_id", F.col("feature").alias("b"), F.col("value").alias("y")), "row_id").filter("a < b")
    c = x.groupBy("market", "a", "b").agg(F.count("*").alias("n"), complete_corr(F.col("x"), F.col("y")).alias("c"))
    return c.select("market", "a", "b", "n", F.round(F.col("c") * (F.col("n") - 3) / (F.col("n") - 3 + 40.0), 6).alias("corr")).filter("abs(corr) >= 0.3")


@query("r14_42_profile_manifest", sql("features", f", {_MC}, m AS (SELECT market, feature, round(avg(abs(c)), 9) AS v FROM mc WHERE c IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY v DESC, feature) AS n FROM m), p(profile, most) AS (VALUES ('small', 2), ('wide', 4)) SELECT market, profile, string_agg(feature, ',' ORDER BY n) AS nodes FROM k JOIN p ON n <= most GROUP BY 1, 2"))
def _(t):
    m = market_corr(t).filter("corr is not null").groupBy("market", "feature").agg(F.round(F.avg(F.abs("corr")), 9).alias("v"))
    k = m.withColumn("n", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("v"), "feature")))
    p = k.withColumn("profile", F.explode(F.array_compact(F.array(F.when(F.col("n") <= 2, "small"), F.when(F.col("n") <= 4, "wide")))))
    return p.groupBy("market", "profile").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "feature"))), lambda x: x["feature"]), ",").alias("nodes"))


@query("r14_43_probe_rollup", sql("scored", f", {LONG}, m AS (SELECT model, market, fold_id, round(avg(CASE WHEN s >= 0.4 THEN target END), 9) AS p FROM lng JOIN scored USING (row_id) GROUP BY 1, 2, 3) SELECT model, market, CASE WHEN fold_id < 3 THEN 'selection' ELSE 'later' END AS role, count(p) AS folds, round(avg(p), 6) AS mean, round(min(p), 6) AS least FROM m GROUP BY 1, 2, 3"))
def _(t):
    m = models(t).groupBy("model", "market", "fold_id").agg(F.round(F.avg(F.when(F.col("s") >= 0.4, F.col("target"))), 9).alias("p"))
    return m.groupBy("model", "market", F.when(F.col("fold_id") < 3, "selection").otherwise("later").alias("role")).agg(F.count("p").alias("folds"), F.avg("p").alias("mean"), F.min("p").alias("least"))


_MAPS = f"{_FC}, w AS (SELECT feature, 'all' AS scope, CASE WHEN count(*) >= 10 AND stddev_pop(value) > 1e-12 AND stddev_pop(target) > 1e-12 THEN round(corr(value, target), 9) END AS effect, count(*) AS n FROM {FV} GROUP BY 1), k AS (SELECT feature, fold_id, count(*) AS n FROM {FV} GROUP BY 1, 2), ef AS (SELECT * FROM w UNION ALL SELECT feature, 'fold ' || fold_id, c, n FROM fc JOIN k USING (feature, fold_id))"


def effects(t):
    whole = T.correlations(t.features, ["feature"]).withColumn("corr", F.round("corr", 9))
    return A.effect_frame(whole, fold_corr(t), ["feature"], effect="corr", n="n")


@query("r14_47_effect_frame", sql("features", f", {_MAPS} SELECT feature, scope, round(effect, 6) AS effect, n, round(CASE WHEN n > 3 THEN 1 / sqrt(n - 3) END, 6) AS se, CASE WHEN n > 3 THEN n - 3 END AS weight FROM ef"))
def _(t):
    return effects(t)


@query("r14_48_conservative_map", sql("features", f", {_MAPS}, c AS (SELECT feature, sum(effect * (n - 3)) / sum(n - 3) AS pooled, min(abs(effect)) AS least, count(*) AS folds, count(*) FILTER (sign(effect) = 1) AS up FROM ef WHERE scope <> 'all' AND scope <= 'fold 2' AND effect IS NOT NULL AND n > 3 GROUP BY 1) SELECT feature, round(pooled, 6) AS pooled, round(least, 6) AS least, folds, CASE WHEN greatest(up, folds - up) = folds AND abs(round(pooled, 9)) >= 0.05 THEN 'SEPARATOR' WHEN greatest(up, folds - up) = folds THEN 'STABLE' ELSE 'MIXED' END AS class FROM c"))
def _(t):
    """Pooled effects over the selection folds, and their class: stable in sign over all of them, and strong."""
    x = effects(t).filter("scope <> 'all' and scope <= 'fold 2' and effect is not null and weight is not null")
    c = x.groupBy("feature").agg((F.sum(F.col("effect") * F.col("weight")) / F.sum("weight")).alias("pooled"), F.min(F.abs("effect")).alias("least"), F.count("*").alias("folds"), F.count_if(F.signum("effect") == 1).alias("up"))
    same = F.greatest(F.col("up"), F.col("folds") - F.col("up")) == F.col("folds")
    return c.select("feature", "pooled", "least", "folds", F.when(same & (F.abs(F.round("pooled", 9)) >= 0.05), "SEPARATOR").when(same, "STABLE").otherwise("MIXED").alias("class"))


@query("r14_49_edge_recheck", sql("ret", f", {_SER}, e(a, b, lag) AS (VALUES ('B0', 'B1', 0), ('B1', 'B2', 1), ('B3', 'B0', 2)) SELECT e.a, e.b, e.lag, count(*) AS n, round(corr(x.v, y.v), 6) AS corr, abs(round(corr(x.v, y.v), 6)) >= 0.1 AS holds FROM e JOIN s x ON x.k = e.a JOIN s y ON y.k = e.b AND y.pos = x.pos + e.lag GROUP BY 1, 2, 3"))
def _(t):
    """Earlier edges tested again: only their pairs and lags are kept."""
    e = t.spark.createDataFrame([("B0", "B1", 0), ("B1", "B2", 1), ("B3", "B0", 2)], "a string, b string, lag int")
    c = edge_correlations(series(t), e, **KEYS).withColumn("corr", F.round("corr", 6))
    return c.withColumn("holds", F.abs("corr") >= 0.1)


@query("r14_51_gate_metrics", sql("scored", at_sql("market", "0.8", "scored")))
def _(t):
    return A.threshold_metrics(t.scored, ["market"], F.lit(0.8))


@query("r14_54_gate_bundle")
def _(t):
    """Two learners fitted on earlier folds, averaged with the base score."""
    from panelweave.operators import ml
    from panelweave.plans.models import FEATURES, frame

    a, b = ml.forward_scores(frame(t), FEATURES), ml.forward_scores(frame(t), FEATURES, kind="boosted", maxDepth=3)
    j = a.select("row_id", "fold_id", "target", "score", F.col("p").alias("pa")).join(b.select("row_id", F.col("p").alias("pb")), "row_id")
    return j.select("row_id", "fold_id", "target", ((F.col("score") + F.col("pa") + F.col("pb")) / 3).alias("gate"))


@query("r14_55_discovery", sql("features", f", c AS (SELECT f.* FROM (SELECT * FROM {FV}) f JOIN (SELECT row_id, {pr('score', 'ticker, fold_id')} AS k FROM scored) r USING (row_id) WHERE k > 0.65), a AS ({auc_sql('feature, fold_id', 'c')}), m AS (SELECT feature, round(avg(auc), 9) AS m, count(auc) AS folds FROM a GROUP BY 1) SELECT feature, round(m, 6) AS mean_auc, folds, CASE WHEN m >= 0.5 THEN 1 ELSE -1 END AS direction, row_number() OVER (ORDER BY round(abs(m - 0.5), 9) DESC, feature) AS place FROM m WHERE m IS NOT NULL QUALIFY place <= 3"))
def _(t):
    """Among rows that rank above 0.65 in their entity and fold: each feature's area under the curve by fold, its direction, and the best three."""
    top = t.scored.withColumn("k", pct_rank(F.col("score"), "ticker", "fold_id")).filter("k > 0.65").select("row_id")
    a = T.auc(t.features.join(top, "row_id", "left_semi"), ["feature", "fold_id"]).withColumn("auc", F.round("auc", 6))
    m = a.groupBy("feature").agg(F.round(F.avg("auc"), 9).alias("mean_auc"), F.count("auc").alias("folds")).filter("mean_auc is not null")
    w = Window.orderBy(F.desc(F.round(F.abs(F.col("mean_auc") - 0.5), 9)), "feature")
    return m.withColumns({"direction": F.when(F.col("mean_auc") >= 0.5, 1).otherwise(-1), "place": F.row_number().over(w)}).filter("place <= 3")


@query("r14_56_model_frame", sql("scored", f", {LONG}, k AS (SELECT row_id, {pr('volume', 'date')} AS volume_rank FROM scored) SELECT fold_id, row_id, ticker, scored.date, target, round(close, 6) AS close, round(volume_rank, 6) AS volume_rank, round(s, 6) AS base FROM scored JOIN k USING (row_id) JOIN lng USING (row_id) WHERE model = 0"))
def _(t):
    k = t.scored.select("row_id", pct_rank(F.col("volume"), "date").alias("volume_rank"))
    b = models(t).filter("model = 0").select("row_id", F.col("s").alias("base"))
    return t.scored.select("fold_id", "row_id", "ticker", "date", "target", "close").join(k, "row_id").join(b, "row_id")


_CAL = "round(1 / (1 + exp(-(1.3 * ln(score / (1 - score)) - 0.4))), 12)"


@query("r14_61_downside_bundle", sql("scored", f", z AS (SELECT *, {_CAL} AS cal FROM scored WHERE score > 0.01 AND score < 0.99), r AS ({bundle_sql('market', 'z')}), b AS (SELECT market, round(avg((score - target) ** 2), 6) AS brier_raw, round(avg((cal - target) ** 2), 6) AS brier_cal FROM z GROUP BY 1), k AS (SELECT market, round(avg(CASE WHEN a THEN target END), 6) AS top_precision FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY score DESC, row_id) <= greatest(ceil(count(*) OVER (PARTITION BY market) * 0.05), 1) AS a FROM z) GROUP BY 1), h AS ({at_sql('market', '0.6', 'z', 'cal')}) SELECT market, auc, ap, brier_raw, brier_cal, top_precision, alerts, precision FROM r JOIN b USING (market) JOIN k USING (market) JOIN h USING (market)"))
def _(t):
    z = t.scored.filter("score > 0.01 and score < 0.99").withColumn("cal", F.round(1 / (1 + F.exp(-(1.3 * F.log(F.col("score") / (1 - F.col("score"))) - 0.4))), 12))
    w = Window.partitionBy("market")
    k = z.withColumn("a", F.row_number().over(w.orderBy(F.desc("score"), "row_id")) <= F.greatest(F.ceil(F.count("*").over(w) * 0.05), F.lit(1))).groupBy("market").agg(F.avg(F.when(F.col("a"), F.col("target"))).alias("top_precision"))
    b = z.groupBy("market").agg(F.avg((F.col("score") - F.col("target")) ** 2).alias("brier_raw"), F.avg((F.col("cal") - F.col("target")) ** 2).alias("brier_cal"))
    h = A.threshold_metrics(z, ["market"], F.lit(0.6), score="cal").select("market", "alerts", "precision")
    return A.binary_metrics(z, ["market"]).select("market", "auc", "ap").join(b, "market").join(k, "market").join(h, "market")


@query("r14_63_ensemble_compile", sql("scored", f"{_BLEND}, b AS (SELECT c, round(avg(prec), 9) AS v FROM m WHERE fold_id < 3 GROUP BY 1), z AS (SELECT c FROM b ORDER BY v DESC NULLS LAST, c LIMIT 1), q AS (SELECT * FROM k JOIN z USING (c) WHERE fold_id >= 3) SELECT c AS candidate, scope, n, alerts, precision FROM (SELECT c, 'all' AS scope, count(*) AS n, count(*) FILTER (a) AS alerts, round(avg(CASE WHEN a THEN target END), 6) AS precision FROM q GROUP BY 1 UNION ALL SELECT c, market, count(*), count(*) FILTER (a), round(avg(CASE WHEN a THEN target END), 6) FROM q GROUP BY 1, 2)"))
def _(t):
    """The blend that is best on the selection folds, measured on the later ones over all rows and by market."""
    b = blend_precision(t).filter("fold_id < 3").groupBy("c").agg(F.round(F.avg("prec"), 9).alias("v"))
    best = b.orderBy(F.desc_nulls_last("v"), "c").limit(1).select("c")
    w = Window.partitionBy("c", "date")
    k = candidates(t).join(F.broadcast(best), "c").withColumn("a", F.row_number().over(w.orderBy(F.desc("s"), "row_id")) <= F.greatest(F.ceil(F.count("*").over(w) * 0.1), F.lit(1))).filter("fold_id >= 3")
    one = lambda scope: k.groupBy(F.col("c").alias("candidate"), scope.alias("scope")).agg(F.count("*").alias("n"), F.count_if("a").alias("alerts"), F.avg(F.when(F.col("a"), F.col("target"))).alias("precision"))
    return one(F.lit("all")).unionByName(one(F.col("market")))


@query("r14_64_bounded_calibration")
def _(t):
    """A logistic fit on the score's logit with a slope that can't be negative, by earlier folds, applied to the later ones."""
    from panelweave.functions.scalar import logit
    from panelweave.operators import ml

    x = t.scored.withColumn("a", F.col("score"))
    model = ml.nonnegative_stack(x.filter("fold_id < 4"), ["a"])
    return ml.score(model, x.filter("fold_id >= 4").withColumn("__l0", logit(F.col("a")))).select("row_id", "target", "p")


@query("r14_67_row_normalisation", "SELECT ticker, date, round(balance, 6) AS balance FROM (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS ticker, CAST(ts AS DATE) AS date, value AS balance, ts, event_id FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND CAST(ts AS DATE) <= DATE '2024-01-20') QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    """Rows of a source in the panel's form: padded entity, date, number; without bad dates or numbers; the latest of each entity and day."""
    e = t.read("events").filter("ts is not null and value is not null").select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("ticker"), F.to_date("ts").alias("date"), F.col("value").alias("balance"), "ts", "event_id").filter(F.col("date") <= F.lit("2024-01-20").cast("date"))
    w = Window.partitionBy("ticker", "date").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("n", F.row_number().over(w)).filter("n = 1").select("ticker", "date", "balance")
