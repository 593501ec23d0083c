"""Queries: statistics of features against targets, relations between series."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.windows import complete_corr, over, pct_rank
from panelweave.operators import joins as J
from panelweave.operators import leadlag as L
from panelweave.operators import stats as T
from panelweave.plans.crosssection import pr
from panelweave.plans.ingest import edges
from panelweave.plans.registry import query, sql

FV = "(SELECT * FROM features WHERE value IS NOT NULL)"


def auc_sql(by: str, source: str, score: str = "value") -> str:
    return f"SELECT {by}, count(*) AS n, sum(target) AS positives, CASE WHEN sum(target) > 0 AND sum(target) < count(*) THEN round((sum(CASE WHEN target = 1 THEN rk END) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * (count(*) - sum(target))), 6) END AS auc FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS rk FROM {source}) GROUP BY {by}"


@query("r7_1_feature_quality", sql("features", "SELECT feature, count(*) AS n_rows, round(avg((value IS NOT NULL)::INT), 6) AS complete, count(DISTINCT value) AS n_values, round(stddev_samp(value), 6) AS std, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS q{round(100 * p):02d}" for p in (0.01, 0.05, 0.5, 0.95, 0.99)) + ", round(count(DISTINCT CASE WHEN value IS NOT NULL THEN ticker END)::DOUBLE / count(DISTINCT ticker), 6) AS entity_share, round(0.45 * avg((value IS NOT NULL)::INT) + 0.25 * count(DISTINCT CASE WHEN value IS NOT NULL THEN ticker END)::DOUBLE / count(DISTINCT ticker) + 0.15 * least(count(DISTINCT value) / 100.0, 1.0) + 0.15, 6) AS quality FROM features GROUP BY feature"))
def _(t):
    return T.feature_quality(t.features)


@query("r7_2_valid_features", sql("features", "SELECT feature FROM features GROUP BY feature HAVING avg((value IS NULL)::INT) <= 0.2 AND count(DISTINCT value) >= 20 AND count(value) >= 100"))
def _(t):
    q = t.features.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("m"), F.count_distinct("value").alias("u"), F.count("value").alias("k"))
    return q.filter("m <= 0.2 and u >= 20 and k >= 100").select("feature")


@query("r7_3_target_audit", sql("scored", "SELECT ticker, fold_id, count(*) AS n, sum(target) AS positives, round(avg(target), 6) AS rate, min(date) AS first_date, max(date) AS last_date FROM scored GROUP BY GROUPING SETS ((ticker), (fold_id), ())"))
def _(t):
    g = t.scored.groupingSets([[F.col("ticker")], [F.col("fold_id")], []], F.col("ticker"), F.col("fold_id"))
    return g.agg(F.count("*").alias("n"), F.sum("target").alias("positives"), F.avg("target").alias("rate"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("r7_4_latest_metadata", "SELECT user_id, max_by(event_type, ts) FILTER (event_type <> 'view') AS last_type, max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) AS span FROM events GROUP BY 1")
def _(t):
    e = t.read("events")
    known = F.when(F.col("event_type") != "view", F.col("ts"))
    return e.groupBy("user_id").agg(F.max_by("event_type", known).alias("last_type"), F.datediff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))).alias("span"))


@query("r7_5_point_in_time_top", sql("panel", "SELECT ticker, cap FROM (SELECT ticker, max_by(close, date) AS cap FROM panel WHERE date <= DATE '2024-01-20' GROUP BY 1) ORDER BY cap DESC, ticker LIMIT 20"))
def _(t):
    return t.panel.filter(F.col("date") <= F.lit("2024-01-20").cast("date")).groupBy("ticker").agg(F.max_by("close", "date").alias("cap")).orderBy(F.desc("cap"), "ticker").limit(20)


@query("r7_6_pearson", sql("features", f"SELECT feature, count(*) AS n, round(corr(value, target), 6) AS corr FROM {FV} GROUP BY feature"))
def _(t):
    return T.correlations(t.features, ["feature"])


@query("r7_7_spearman", sql("features", f"SELECT feature, count(*) AS n, round(corr(x, target), 6) AS spearman FROM (SELECT feature, target, {pr('value', 'feature')} AS x FROM {FV}) GROUP BY feature"))
def _(t):
    return T.spearman(t.features, ["feature"])


@query("r7_8_within_date", sql("features", f"SELECT feature, count(*) AS n, round(corr(x, y), 6) AS within_corr FROM (SELECT feature, value - avg(value) OVER w AS x, target - avg(target) OVER w AS y FROM {FV} WINDOW w AS (PARTITION BY feature, date)) GROUP BY feature"))
def _(t):
    return T.within_correlation(t.features, ["feature"], "date")


@query("r7_9_fold_correlations", sql("features", f"SELECT feature, fold_id, count(*) AS n, CASE WHEN count(*) >= 10 AND stddev_pop(value) > 1e-12 AND stddev_pop(target) > 1e-12 THEN round(corr(value, target), 6) END AS corr FROM {FV} GROUP BY 1, 2"))
def _(t):
    return T.correlations(t.features, ["feature", "fold_id"])


_GC = f", g AS (SELECT feature, date, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(value) > 1e-12 AND stddev_pop(target) > 1e-12 THEN corr(value, target) END AS c FROM {FV} GROUP BY 1, 2)"


@query("r7_10_group_correlations", sql("features", f"{_GC} SELECT feature, count(*) AS groups, round(avg(c), 6) AS mean, round(sum(c * n) / sum(n), 6) AS weighted_mean, round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.25), 6) AS q25, round(quantile_cont(c, 0.75), 6) AS q75, round(greatest(count(*) FILTER (c > 1e-12), count(*) FILTER (c < -1e-12))::DOUBLE / count(*) FILTER (abs(c) > 1e-12), 6) AS consistency FROM g WHERE c IS NOT NULL GROUP BY feature"))
def _(t):
    return T.group_correlation_summary(t.features, ["feature"], "date")


@query("r7_11_correlation_matrix", sql("features", f"SELECT x.feature AS a, y.feature AS b, count(*) AS n, round(corr(x.value, y.value), 5) AS corr FROM {FV} x JOIN {FV} y ON x.row_id = y.row_id AND x.feature < y.feature GROUP BY 1, 2"))
def _(t):
    return T.correlation_matrix(t.features).withColumn("corr", F.round("corr", 5))


@query("r7_12_structure_views", sql("features", f", v AS (SELECT row_id, feature, value, {pr('value', 'feature')} AS rk, value - avg(value) OVER (PARTITION BY feature, date) AS wd FROM {FV}) SELECT x.feature AS a, y.feature AS b, round(greatest(abs(corr(x.value, y.value)), abs(corr(x.rk, y.rk)), abs(corr(x.wd, y.wd))), 5) AS combined FROM v x JOIN v y ON x.row_id = y.row_id AND x.feature < y.feature GROUP BY 1, 2"))
def _(t):
    f = t.features.filter("value is not null")
    views = {"p": f, "s": f.withColumn("value", pct_rank(F.col("value"), "feature")), "w": f.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("feature", "date")))}
    out = None
    for name, v in views.items():
        m = T.correlation_matrix(v).select("a", "b", F.abs("corr").alias(name))
        out = m if out is None else out.join(m, ["a", "b"])
    return out.select("a", "b", F.round(F.greatest("p", "s", "w"), 5).alias("combined"))


@query("r7_13_high_pairs", sql("features", f", c AS (SELECT x.fold_id, x.feature AS a, y.feature AS b, round(corr(x.value, y.value), 6) AS c FROM {FV} x JOIN {FV} y ON x.row_id = y.row_id AND x.feature < y.feature GROUP BY 1, 2, 3) SELECT a, b, round(avg(abs(c)), 5) AS mean_abs, round(min(abs(c)), 5) AS min_abs, count(*) AS folds FROM c WHERE NOT isnan(c) GROUP BY 1, 2 HAVING avg(abs(c)) >= 0.3"))
def _(t):
    f = t.features.filter("value is not null")
    x = f.select("row_id", "fold_id", F.col("feature").alias("a"), F.col("value").alias("x")).join(f.select("row_id", F.col("feature").alias("b"), F.col("value").alias("y")), "row_id").filter("a < b")
    c = x.groupBy("fold_id", "a", "b").agg(F.round(complete_corr(F.col("x"), F.col("y")), 6).alias("c")).filter("c is not null")
    return c.groupBy("a", "b").agg(F.avg(F.abs("c")).alias("m"), F.min(F.abs("c")).alias("l"), F.count("*").alias("folds")).filter("m >= 0.3").select("a", "b", F.round("m", 5).alias("mean_abs"), F.round("l", 5).alias("min_abs"), "folds")


@query("r7_14_components", "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_suppkey + 7 AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node")
def _(t):
    return T.components_of(t.read("lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + 7).alias("b")).distinct())


@query("r7_15_average_linkage")
def _(t):
    """Average-linkage clusters of features by 1 - |corr|, cut at 0.7, numbered in each market by their least feature."""
    m = T.correlation_matrix(t.features.withColumn("feature", F.concat_ws(":", "market", "feature"))).select(F.substring_index("a", ":", 1).alias("market"), "a", "b", (1 - F.abs(F.coalesce("corr", F.lit(0.0)))).alias("distance"))
    found = T.average_linkage(m, ["market"], cut=0.7)
    number = F.dense_rank().over(Window.partitionBy("market").orderBy("cluster")) - 1
    return found.select("market", F.substring_index("node", ":", -1).alias("feature"), number.cast("int").alias("cluster"))


_Q = "q AS (SELECT feature, avg((value IS NOT NULL)::INT) AS complete, count(DISTINCT value) AS u, abs(corr(value, target)) AS signal FROM features GROUP BY 1)"


@query("r7_16_representatives", sql("features", f", {_Q}, cl(feature, cluster) AS (VALUES ('f_close', 0), ('f_volume', 0), ('f_mean', 0), ('f_errors', 1), ('f_buys', 1), ('f_ret', 1)), s AS (SELECT cluster, feature, round(0.7 * {pr('signal', 'cluster')} + 0.2 * {pr('u', 'cluster')} + 0.1 * complete, 9) AS score FROM q JOIN cl USING (feature)) SELECT cluster, feature, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, feature) AS n FROM s) WHERE n = 1"))
def _(t):
    from panelweave.plans.crosssection import clusters

    q = t.features.groupBy("feature").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("complete"), F.count_distinct("value").alias("u"), F.abs(complete_corr(F.col("value"), F.col("target"))).alias("signal")).join(clusters(t), "feature")
    s = q.withColumn("score", F.round(0.7 * pct_rank(F.col("signal"), "cluster") + 0.2 * pct_rank(F.col("u"), "cluster") + 0.1 * F.col("complete"), 9))
    return s.withColumn("n", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "feature"))).filter("n = 1").select("cluster", "feature", "score")


@query("r7_17_consensus_votes", sql("features", f", c AS (SELECT fold_id, feature, round(abs(corr(value, target)), 9) AS s FROM {FV} GROUP BY 1, 2), w AS (SELECT fold_id, feature, s, row_number() OVER (PARTITION BY fold_id ORDER BY s DESC, feature) AS n FROM c WHERE s IS NOT NULL AND NOT isnan(s)) SELECT feature, count(*) FILTER (n = 1) AS votes, round(avg(s), 6) AS mean_score, round(min(s), 6) AS min_score FROM w GROUP BY feature"))
def _(t):
    c = t.features.filter("value is not null").groupBy("fold_id", "feature").agg(F.round(F.abs(complete_corr(F.col("value"), F.col("target"))), 9).alias("s")).filter("s is not null")
    w = c.withColumn("n", F.row_number().over(Window.partitionBy("fold_id").orderBy(F.desc("s"), "feature")))
    return w.groupBy("feature").agg(F.count_if(F.col("n") == 1).alias("votes"), F.avg("s").alias("mean_score"), F.min("s").alias("min_score"))


@query("r7_18_structure_stats", sql("features", f", c AS (SELECT x.feature AS f, y.feature AS g, round(abs(corr(x.value, y.value)), 6) AS c FROM {FV} x JOIN {FV} y ON x.row_id = y.row_id AND x.feature <> y.feature GROUP BY 1, 2) SELECT f AS feature, round(max(c), 5) AS top, max_by(g, c) AS peer, count(*) FILTER (c >= 0.3) AS peers FROM c GROUP BY f"))
def _(t):
    m = T.correlation_matrix(t.features).select("a", "b", F.round(F.abs("corr"), 6).alias("c"))
    both = m.select(F.col("a").alias("feature"), F.col("b").alias("g"), "c").unionByName(m.select(F.col("b").alias("feature"), F.col("a").alias("g"), "c"))
    return both.groupBy("feature").agg(F.round(F.max("c"), 5).alias("top"), F.max_by("g", "c").alias("peer"), F.count_if(F.col("c") >= 0.3).alias("peers"))


_NEAR = f", v AS (SELECT row_id, feature, value FROM {FV}), pc AS (SELECT a.feature AS a, b.feature AS b, corr(a.value, b.value) AS c FROM v a JOIN v b ON a.row_id = b.row_id AND a.feature <> b.feature GROUP BY 1, 2 HAVING count(*) >= 10)"


def greedy_sql(ranked: str, near: str, most: int) -> str:
    """DuckDB text of a greedy pass over ranked (feature, i from 1): a feature is kept unless it is near one that is kept already."""
    return f"""{_NEAR}, o AS ({ranked}), g(i, kept) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT g.i + 1, CASE WHEN len(g.kept) >= {most} OR EXISTS (SELECT 1 FROM pc WHERE pc.a = o.feature AND {near} AND list_contains(g.kept, pc.b)) THEN g.kept ELSE list_append(g.kept, o.feature) END FROM g JOIN o ON o.i = g.i + 1)"""


@query("r7_19_greedy_redundancy", sql("features", greedy_sql(f"SELECT feature, row_number() OVER (ORDER BY abs(corr(value, target)) DESC, feature) AS i FROM {FV} GROUP BY 1", "abs(pc.c) >= 0.5", 1000)).replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT unnest(kept) AS feature FROM g WHERE i = (SELECT max(i) FROM o)")
def _(t):
    """Features in order of signal, each dropped if it correlates at 0.5 or more with one kept: one fold over the short ranked list."""
    m = T.correlation_matrix(t.features).filter("abs(corr) >= 0.5")
    near = m.select(F.col("a").alias("feature"), F.col("b").alias("other")).unionByName(m.select(F.col("b").alias("feature"), F.col("a").alias("other"))).groupBy("feature").agg(F.collect_set("other").alias("near"))
    q = T.correlations(t.features, ["feature"]).join(near, "feature", "left").withColumn("near", F.coalesce("near", F.expr("cast(array() as array<string>)")))
    ranked = q.agg(F.array_sort(F.collect_list(F.struct((-F.abs("corr")).alias("s"), "feature", "near"))).alias("r"))
    kept = F.aggregate("r", F.expr("cast(array() as array<string>)"), lambda acc, x: F.when(F.arrays_overlap(acc, x["near"]), acc).otherwise(F.concat(acc, F.array(x["feature"]))))
    return ranked.select(F.explode(kept).alias("feature"))


_BIN = f", b AS (SELECT feature, target, CAST(least(floor({pr('value', 'feature')} * 8), 7) AS INTEGER) AS bin FROM {FV}), n AS (SELECT feature, bin, count(*) FILTER (target = 1) AS n1, count(*) FILTER (target = 0) AS n0 FROM b GROUP BY 1, 2), s AS (SELECT *, sum(n1 + n0) OVER w AS t, sum(n1) OVER w / sum(n1 + n0) OVER w AS p FROM n WINDOW w AS (PARTITION BY feature))"


@query("r7_20_mutual_information", sql("features", f"{_BIN} SELECT feature, round(sum(CASE WHEN n1 > 0 THEN n1 / t * ln(n1 / t / ((n1 + n0) / t * p)) ELSE 0 END + CASE WHEN n0 > 0 THEN n0 / t * ln(n0 / t / ((n1 + n0) / t * (1 - p))) ELSE 0 END), 6) AS mi, round(sum(CASE WHEN n1 > 0 THEN n1 / t * ln(n1 / t / ((n1 + n0) / t * p)) ELSE 0 END + CASE WHEN n0 > 0 THEN n0 / t * ln(n0 / t / ((n1 + n0) / t * (1 - p))) ELSE 0 END) / any_value(-(p * ln(p) + (1 - p) * ln(1 - p))), 6) AS normalised FROM s GROUP BY feature"))
def _(t):
    return T.mutual_information(t.features, ["feature"], 8)


@query("r7_22_auc", sql("features", auc_sql("feature", FV)))
def _(t):
    return T.auc(t.features, ["feature"])


@query("r7_23_average_precision", sql("features", f", s AS (SELECT feature, value, count(*) AS k, sum(target) AS p FROM {FV} GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(k) OVER w AS seen FROM s WINDOW w AS (PARTITION BY feature ORDER BY value DESC)) SELECT feature, sum(k) AS n, sum(p) AS positives, round(sum(p * tp / seen) / sum(p), 6) AS ap, round(sum(p) / sum(k), 6) AS base_rate, round(sum(p * tp / seen) / sum(p) * sum(k) / sum(p), 6) AS lift FROM c GROUP BY feature"))
def _(t):
    return T.average_precision(t.features, ["feature"])


@query("r7_24_oriented_auc", sql("features", f"SELECT feature, round(greatest(auc, 1 - auc), 6) AS oriented, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS direction FROM ({auc_sql('feature', FV)})"))
def _(t):
    a, d = T.oriented(F.round("auc", 6))
    return T.auc(t.features, ["feature"]).select("feature", a.alias("oriented"), d.alias("direction"))


@query("r7_25_auc_error", sql("features", f", a AS ({auc_sql('feature', FV)}), b AS (SELECT feature, auc, positives AS p, n - positives AS q FROM a) SELECT feature, round(sqrt((auc * (1 - auc) + (p - 1) * (auc / (2 - auc) - auc * auc) + (q - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (p * q)), 6) AS se, round(0.5 + (2.0 * p * q / (p + q)) / (2.0 * p * q / (p + q) + 80) * (auc - 0.5), 6) AS shrunk FROM b"))
def _(t):
    a = T.auc(t.features, ["feature"]).withColumn("auc", F.round("auc", 6))
    p, n = F.col("positives").cast("double"), (F.col("n") - F.col("positives")).cast("double")
    return a.select("feature", T.auc_error(F.col("auc"), p, n).alias("se"), T.shrunk_auc(F.col("auc"), p, n).alias("shrunk"))


@query("r7_26_mean_difference", sql("features", f"SELECT feature, round((avg(value) FILTER (target = 1) - avg(value) FILTER (target = 0)) / sqrt((var_samp(value) FILTER (target = 1) + var_samp(value) FILTER (target = 0)) / 2), 6) AS smd, CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 1e-12 THEN round((quantile_cont(value, 0.5) FILTER (target = 1) - quantile_cont(value, 0.5) FILTER (target = 0)) / (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 6) END AS median_gap FROM {FV} GROUP BY feature"))
def _(t):
    return T.mean_difference(t.features.filter("value is not null"), ["feature"])


@query("r7_27_ks_wasserstein", sql("features", f", s AS (SELECT feature, value, sum(target) AS p, sum(1 - target) AS q FROM {FV} GROUP BY 1, 2), c AS (SELECT feature, value, abs(sum(p) OVER w / sum(p) OVER v - sum(q) OVER w / sum(q) OVER v) AS gap, lead(value) OVER w - value AS step FROM s WINDOW w AS (PARTITION BY feature ORDER BY value), v AS (PARTITION BY feature)), i AS (SELECT feature, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM {FV} GROUP BY 1) SELECT feature, round(max(gap), 6) AS ks, CASE WHEN any_value(iqr) > 1e-12 THEN round(sum(gap * step) / any_value(iqr), 6) END AS wasserstein FROM c JOIN i USING (feature) GROUP BY feature"))
def _(t):
    return T.distribution_distances(t.features, ["feature"])


_DIV = """, x AS (SELECT feature, value, fold_id < 3 AS ref FROM features WHERE value IS NOT NULL), e AS (SELECT feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FILTER (ref)) AS edges FROM x GROUP BY 1),
b AS (SELECT feature, len(list_filter(edges, lambda g: g < value)) AS bin, len(edges) AS last, ref FROM x JOIN e USING (feature)), f AS (SELECT feature, len(edges) AS last, unnest(range(0, len(edges) + 1)) AS bin FROM e),
n AS (SELECT f.feature, f.bin, f.last, count(*) FILTER (b.ref) AS r, count(*) FILTER (NOT b.ref) AS c FROM f LEFT JOIN b USING (feature, bin) GROUP BY 1, 2, 3),
p AS (SELECT feature, greatest(r / sum(r) OVER w, 1e-5) AS rs, greatest(c / sum(c) OVER w, 1e-5) AS cs, (r + 0.5) / (sum(r) OVER w + 0.5 * (last + 1)) AS pr, (c + 0.5) / (sum(c) OVER w + 0.5 * (last + 1)) AS pc FROM n WINDOW w AS (PARTITION BY feature))
SELECT feature, round(sum((cs - rs) * ln(cs / rs)), 6) AS psi, round(sum(0.5 * pr * ln(pr / ((pr + pc) / 2)) + 0.5 * pc * ln(pc / ((pr + pc) / 2))), 6) AS js FROM p GROUP BY feature"""


@query("r7_29_30_divergences", sql("features", _DIV))
def _(t):
    f = t.features.filter("value is not null")
    return T.edge_divergences(f.filter("fold_id < 3"), f.filter("fold_id >= 3"), ["feature"])


@query("r7_31_segment_stability", sql("scored", ", s AS (SELECT market, score, target, CAST(floor((row_number() OVER (PARTITION BY market ORDER BY date, row_id) - 1) * 4 / (count(*) OVER (PARTITION BY market))::DOUBLE) AS INTEGER) AS seg FROM scored), e AS (SELECT market, seg, corr(score, target) AS c FROM s GROUP BY 1, 2), a AS (SELECT market, corr(score, target) AS t FROM scored GROUP BY 1) SELECT market, round(min(c), 6) AS least, round(max(c), 6) AS most, round(avg((sign(c) = sign(t))::INT), 6) AS agreement FROM e JOIN a USING (market) GROUP BY market"))
def _(t):
    return T.segment_stability(t.scored, "score", "target", 4, by=["market"], order=["date", "row_id"])


@query("r7_32_separation_bundle", sql("features", f"SELECT feature, fold_id, round(a.auc, 6) AS auc, round(2 * a.auc - 1, 6) AS cliff, m1, m0 FROM ({auc_sql('feature, fold_id', FV)}) a JOIN (SELECT feature, fold_id, round(quantile_cont(value, 0.5) FILTER (target = 1), 6) AS m1, round(quantile_cont(value, 0.5) FILTER (target = 0), 6) AS m0 FROM {FV} GROUP BY 1, 2) USING (feature, fold_id)"))
def _(t):
    f = t.features.filter("value is not null")
    a = T.auc(f, ["feature", "fold_id"]).select("feature", "fold_id", F.round("auc", 6).alias("auc"))
    m = f.groupBy("feature", "fold_id").agg(F.percentile(F.when(F.col("target") == 1, F.col("value")), F.lit(0.5)).alias("m1"), F.percentile(F.when(F.col("target") == 0, F.col("value")), F.lit(0.5)).alias("m0"))
    return a.join(m, ["feature", "fold_id"]).withColumn("cliff", 2 * F.col("auc") - 1)


@query("r7_33_concordance", sql("scored", ", m AS (SELECT c.row_id AS a, k.row_id AS b, abs(c.score - k.score) AS gap FROM scored c JOIN scored k ON c.date = k.date AND c.bucket = k.bucket AND c.target = 1 AND k.target = 0), p AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(gap, 9), b) AS n FROM m) SELECT round(avg(CASE WHEN x.close > y.close THEN 1.0 WHEN x.close = y.close THEN 0.5 ELSE 0 END), 6) AS concordance, count(*) AS pairs FROM p JOIN scored x ON x.row_id = p.a JOIN scored y ON y.row_id = p.b WHERE n <= 2"))
def _(t):
    pairs = J.matched_controls(t.scored, case=F.col("target") == 1, control=F.col("target") == 0, score="score", row_id="row_id", same=["date", "bucket"], penalties={}, k=2)
    x = t.scored.select(F.col("row_id").alias("case_id"), F.col("close").alias("x"))
    y = t.scored.select(F.col("row_id").alias("control_id"), F.col("close").alias("y"))
    j = pairs.join(x, "case_id").join(y, "control_id")
    return j.agg(F.avg(F.when(F.col("x") > F.col("y"), 1.0).when(F.col("x") == F.col("y"), 0.5).otherwise(0.0)).alias("concordance"), F.count("*").alias("pairs"))


_EG = f", k AS (SELECT *, {pr('score', 'date')} AS rk FROM scored), g AS (SELECT *, CASE WHEN rk >= 0.8 AND target = 1 THEN 'A' WHEN rk >= 0.8 THEN 'B' WHEN rk <= 0.5 AND target = 1 THEN 'C' WHEN rk <= 0.5 THEN 'D' END AS eg FROM k)"


@query("r7_34_error_groups", sql("scored", f"{_EG} SELECT row_id, eg AS error_group FROM g"))
def _(t):
    return T.error_groups(t.scored, "target", "score", "date").select("row_id", "error_group")


@query("r7_35_rejection", sql("scored", ", c AS (SELECT score AS cut FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM scored WHERE target = 1) WHERE i = floor(0.1 * (n - 1)) LIMIT 1) SELECT any_value(cut) AS cut, round(avg((score < cut)::INT), 6) AS rejected FROM scored, c WHERE target = 0"))
def _(t):
    s = t.scored.select("score", "target")
    one = s.withColumn("all", F.lit(1))
    return T.rejection_at_retention(one, "score", F.col("target") == 1, F.col("target") == 0, 0.9, ["all"]).drop("all")


@query("r7_36_error_map", sql("scored", f"{_EG} SELECT fold_id, count(*) FILTER (eg = 'A') AS a, count(*) FILTER (eg = 'B') AS b, round(0.5 * (avg(close) FILTER (eg = 'A') - avg(close) FILTER (eg = 'B')) + 0.4 * (avg(close) FILTER (eg = 'C') - avg(close) FILTER (eg = 'B')) + 0.1 * (avg(close) FILTER (eg = 'A') - avg(close) FILTER (eg = 'C')), 5) AS bottleneck FROM g GROUP BY fold_id"))
def _(t):
    g = T.error_groups(t.scored, "target", "score", "date")
    m = {k: F.avg(F.when(F.col("error_group") == k, F.col("close"))) for k in "ABC"}
    return g.groupBy("fold_id").agg(F.count_if(F.col("error_group") == "A").alias("a"), F.count_if(F.col("error_group") == "B").alias("b"), F.round(0.5 * (m["A"] - m["B"]) + 0.4 * (m["C"] - m["B"]) + 0.1 * (m["A"] - m["C"]), 5).alias("bottleneck"))


@query("r7_37_interaction_screen", sql("features", f", g AS (SELECT a.feature AS a, b.feature AS b, a.target AS k, count(*) AS n, sum(a.value) AS sx, sum(b.value) AS sy, sum(a.value * b.value) AS sxy FROM {FV} a JOIN {FV} b ON a.row_id = b.row_id AND a.feature < b.feature GROUP BY 1, 2, 3), m AS (SELECT a, b, k, (sxy - sx * sy / n) / n AS cov, sx / n AS mx, sy / n AS my FROM g) SELECT x.a, x.b, round(abs(y.cov - x.cov) - 0.25 * (abs(y.mx - x.mx) + abs(y.my - x.my)), 6) AS screen, row_number() OVER (ORDER BY abs(y.cov - x.cov) - 0.25 * (abs(y.mx - x.mx) + abs(y.my - x.my)) DESC, x.a, x.b) AS rank FROM m x JOIN m y ON x.a = y.a AND x.b = y.b AND x.k = 0 AND y.k = 1 QUALIFY rank <= 10"))
def _(t):
    """Pairs whose covariance differs most between positive and negative rows, less a quarter of their own differences."""
    g = {k: T.gram(t.features.filter(f"target = {k}")).select("a", "b", ((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.col("n")).alias(f"cov{k}"), (F.col("sx") / F.col("n")).alias(f"mx{k}"), (F.col("sy") / F.col("n")).alias(f"my{k}")) for k in (0, 1)}
    j = g[0].join(g[1], ["a", "b"])
    return j.select("a", "b", (F.abs(F.col("cov1") - F.col("cov0")) - 0.25 * (F.abs(F.col("mx1") - F.col("mx0")) + F.abs(F.col("my1") - F.col("my0")))).alias("screen")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("screen"), "a", "b"))).filter("rank <= 10")


@query("r7_38_fold_rollup", sql("features", f", c AS (SELECT feature, fold_id, CASE WHEN count(*) >= 10 AND stddev_pop(value) > 1e-12 AND stddev_pop(target) > 1e-12 THEN corr(value, target) END AS c FROM {FV} GROUP BY 1, 2) SELECT feature, count(*) AS folds, round(avg(c), 6) AS mean, round(quantile_cont(c, 0.5), 6) AS median, round(min(c), 6) AS min, round(max(c), 6) AS max, round(stddev_samp(c), 6) AS std, round(avg((c > 0)::INT), 6) AS positive_share, round(greatest(count(*) FILTER (c > 1e-12), count(*) FILTER (c < -1e-12))::DOUBLE / count(*) FILTER (abs(c) > 1e-12), 6) AS consistency FROM c WHERE c IS NOT NULL GROUP BY feature"))
def _(t):
    return T.fold_rollup(T.correlations(t.features, ["feature", "fold_id"]), ["feature"], "corr")


@query("r7_39_fixed_direction", sql("features", f", a AS ({auc_sql('feature, fold_id', FV)}), h AS (SELECT *, 2.0 * positives * (n - positives) / n AS h FROM a WHERE auc IS NOT NULL), d AS (SELECT feature, CASE WHEN sum(h * (auc - 0.5)) >= 0 THEN 1 ELSE -1 END AS dir FROM h WHERE fold_id < 3 GROUP BY 1) SELECT feature, any_value(dir) AS direction, round(avg(CASE WHEN dir = 1 THEN auc ELSE 1 - auc END), 6) AS later_auc, round(min(CASE WHEN dir = 1 THEN auc ELSE 1 - auc END), 6) AS least_auc FROM h JOIN d USING (feature) WHERE fold_id >= 3 GROUP BY feature"))
def _(t):
    a = T.auc(t.features, ["feature", "fold_id"]).filter("auc is not null").withColumn("auc", F.round("auc", 6)).withColumn("h", 2.0 * F.col("positives") * (F.col("n") - F.col("positives")) / F.col("n"))
    d = a.filter("fold_id < 3").groupBy("feature").agg(F.when(F.sum(F.col("h") * (F.col("auc") - 0.5)) >= 0, 1).otherwise(-1).alias("direction"))
    fixed = F.when(F.col("direction") == 1, F.col("auc")).otherwise(1 - F.col("auc"))
    return a.filter("fold_id >= 3").join(F.broadcast(d), "feature").groupBy("feature").agg(F.first("direction").alias("direction"), F.avg(fixed).alias("later_auc"), F.min(fixed).alias("least_auc"))


@query("r7_41_sign_flip", sql("features", f", c AS (SELECT feature, fold_id, round(corr(value, target), 9) AS c FROM {FV} GROUP BY 1, 2), k AS (SELECT feature, list(c) AS v FROM c WHERE c IS NOT NULL AND NOT isnan(c) GROUP BY 1), m AS (SELECT feature, v, unnest(range(0, CAST(pow(2, len(v)) AS BIGINT))) AS mask FROM k) SELECT feature, any_value(len(v)) AS n, round(avg((abs(list_sum(list_transform(v, lambda x, i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN -x ELSE x END))) >= abs(list_sum(v)) - 1e-12)::INT), 6) AS p FROM m GROUP BY feature"))
def _(t):
    c = t.features.filter("value is not null").groupBy("feature", "fold_id").agg(F.round(complete_corr(F.col("value"), F.col("target")), 9).alias("c"))
    return T.sign_flip_p(c, ["feature"], "c")


@query("r7_42_bootstrap_mean")
def _(t):
    return T.bootstrap_mean(T.correlations(t.features, ["feature", "fold_id"]), ["feature"], "corr", ["fold_id"])


@query("r7_43_date_block_bootstrap")
def _(t):
    return T.poisson_bootstrap(t.scored, [], (F.col("score") >= 0.8) & (F.col("target") == 1), F.col("score") >= 0.8, ["date"])


@query("r7_44_stratified_bootstrap")
def _(t):
    return T.poisson_bootstrap(t.scored, ["market"], (F.col("score") >= 0.8) & (F.col("target") == 1), F.col("score") >= 0.8, ["ticker", "date"], draws=100)


@query("r7_45_bh_qvalues", sql("panel", ", p AS (SELECT ticker, market, (1 + ticker % 40) / 400.0 AS p FROM (SELECT DISTINCT ticker, market FROM panel)), q AS (SELECT *, p * count(*) OVER (PARTITION BY market) / row_number() OVER (PARTITION BY market ORDER BY p, ticker) AS x FROM p) SELECT ticker, round(least(min(x) OVER (PARTITION BY market ORDER BY p, ticker ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) AS q FROM q"))
def _(t):
    p = t.panel.select("ticker", "market").distinct().withColumn("p", (1 + F.col("ticker") % 40) / 400.0)
    return T.bh_qvalues(p, "p", ["market"], ["ticker"]).select("ticker", "q")


@query("r7_46_fisher", sql("panel", ", p AS (SELECT market, (1 + ticker % 40) / 41.0 AS p FROM (SELECT DISTINCT ticker, market FROM panel)), g AS (SELECT market, count(*) AS k, -sum(ln(p)) AS h FROM p GROUP BY 1) SELECT market, k, round(2 * h, 6) AS statistic, round((SELECT sum(exp(-h + i * ln(h) - lgamma(i + 1))) FROM range(0, k) r(i)), 6) AS p FROM g"))
def _(t):
    p = t.panel.select("ticker", "market").distinct().withColumn("p", (1 + F.col("ticker") % 40) / 41.0)
    return T.fisher_combine(p, ["market"], "p")


@query("r7_47_weighted_mean", "SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS mean FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def _(t):
    return t.read("lineitem").filter("l_quantity > 0").groupBy("l_returnflag").agg((F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity")).alias("mean"))


_SER = "s AS (SELECT bucket AS k, day(date) AS pos, avg(r) AS v FROM ret WHERE r IS NOT NULL GROUP BY 1, 2)"


def series(t):
    return t.ret.filter("r is not null").groupBy(F.col("bucket").alias("k"), F.dayofmonth("date").alias("pos")).agg(F.avg("r").alias("v"))


#: What the series of a bucket are called.
KEYS = {"entity": "k", "pos": "pos", "value": "v"}


@query("r7_48_lagged_lift", sql("ret", f", {_SER}, p AS (SELECT a.k AS a, b.k AS b, l.lag, a.v AS x, b.v AS y FROM s a CROSS JOIN (VALUES (1), (2)) l(lag) JOIN s b ON b.pos = a.pos + l.lag AND a.k <> b.k) SELECT a, b, lag, round(avg((y >= 1.5)::INT), 6) AS base, round(avg(CASE WHEN x >= 1.5 THEN (y >= 1.5)::INT END), 6) AS conditional FROM p GROUP BY 1, 2, 3"))
def _(t):
    one, hit = (lambda v: v == v), (lambda v: v >= 1.5)
    s = L.lagged_sums(series(t), {"y": (one, hit), "x": (hit, one), "xy": (hit, hit)}, lags=[1, 2], **KEYS)
    return s.select("a", "b", "lag", (F.col("y") / F.col("n")).alias("base"), F.when(F.col("x") > 0, F.col("xy") / F.col("x")).alias("conditional"))


@query("r7_49_sign_tail", sql("ret", f", {_SER}, p AS (SELECT a.k AS a, b.k AS b, a.v - 1 AS x, b.v - 1 AS y FROM s a JOIN s b ON a.pos = b.pos AND a.k < b.k), q AS (SELECT a, b, quantile_cont(x, 0.3) AS qx, quantile_cont(y, 0.3) AS qy FROM p GROUP BY 1, 2) SELECT a, b, round(avg((sign(x) = sign(y))::INT), 6) AS sign_agreement, round(avg((x > 0 AND y > 0)::INT), 6) AS up_up, round(avg((x < 0 AND y < 0)::INT), 6) AS down_down, round(avg(CASE WHEN x <= qx + 1e-12 THEN (y <= qy + 1e-12)::INT END), 6) AS tail FROM p JOIN q USING (a, b) GROUP BY 1, 2"))
def _(t):
    s = series(t).withColumn("v", F.col("v") - 1)
    up, down, flat = (lambda v: v > 0), (lambda v: v < 0), (lambda v: v == 0)
    q = L.lagged_sums(s, {"uu": (up, up), "dd": (down, down), "ff": (flat, flat)}, lags=[0], ordered=False, **KEYS)
    n = F.col("n")
    signs = q.select("a", "b", ((F.col("uu") + F.col("dd") + F.col("ff")) / n).alias("sign_agreement"), (F.col("uu") / n).alias("up_up"), (F.col("dd") / n).alias("down_down"))
    return signs.join(L.tail_dependence(s, level=0.3, **KEYS), ["a", "b"])


@query("r7_50_granger")
def _(t):
    """Gain of R2 when a leader's two lags join a series' own two lags, with the F statistic: one small solve per pair."""
    import numpy as np
    import pandas as pd

    s, w = series(t), over("k", order="pos")
    lagged = s.withColumns({"l1": F.lag("v", 1).over(w), "l2": F.lag("v", 2).over(w)}).filter("l2 is not null")
    j = lagged.select(F.col("k").alias("b"), "pos", F.col("v").alias("y"), F.col("l1").alias("o1"), F.col("l2").alias("o2")).join(lagged.select(F.col("k").alias("a"), "pos", "l1", "l2"), "pos").filter("a <> b")

    def gain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if not np.isfinite(pdf[["y", "o1", "o2", "l1", "l2"]].to_numpy()).all():  # an infinite return leaves the pair undefined
            return pd.DataFrame([(key[0], key[1], None, None)], columns=["a", "b", "gain", "f"])
        y, one = pdf["y"].to_numpy(), np.ones(len(pdf))
        rss = []
        for cols in (["o1", "o2"], ["o1", "o2", "l1", "l2"]):
            x = np.column_stack([one, pdf[cols].to_numpy()])
            rss.append(float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()))
        total, df2 = float(((y - y.mean()) ** 2).sum()), len(y) - 5
        ok = df2 > 0 and rss[1] > 1e-12 and total > 1e-12
        return pd.DataFrame([(key[0], key[1], (rss[0] - rss[1]) / total if ok else None, (rss[0] - rss[1]) / 2 / (rss[1] / df2) if ok else None)], columns=["a", "b", "gain", "f"])

    return j.groupBy("a", "b").applyInPandas(gain, "a string, b string, gain double, f double")


@query("r7_51_event_response", sql("ret", f", {_SER}, p AS (SELECT a.k AS a, b.k AS b, l.lag, b.v AS y FROM s a CROSS JOIN (VALUES (0), (1), (3)) l(lag) JOIN s b ON b.pos = a.pos + l.lag AND a.k <> b.k WHERE a.v >= 1.5) SELECT a, b, lag, count(*) AS n, round(avg(y), 6) AS mean, round(quantile_cont(y, 0.5), 6) AS median, round(avg((y > 0)::INT), 6) AS up FROM p GROUP BY 1, 2, 3"))
def _(t):
    return L.event_responses(series(t), lambda v: v >= 1.5, lags=[0, 1, 3], **KEYS)


@query("r7_52_best_lag", sql("ret", f", {_SER}, c AS (SELECT a.k AS a, b.k AS b, l.lag, round(corr(a.v, b.v), 9) AS c FROM s a CROSS JOIN (SELECT unnest(range(-3, 4)) AS lag) l JOIN s b ON b.pos = a.pos + l.lag AND a.k < b.k GROUP BY 1, 2, 3) SELECT a, b, lag, round(c, 6) AS corr FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY abs(c) DESC, abs(lag), lag) AS n FROM c) WHERE n = 1"))
def _(t):
    c = L.lagged_correlations(series(t), lags=range(-3, 4), ordered=False, **KEYS).withColumn("corr", F.round("corr", 9)).drop("n")
    w = Window.partitionBy("a", "b").orderBy(F.desc(F.abs("corr")), F.abs("lag"), "lag")
    return c.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


@query("r7_53_factor_residual", sql("ret", ", f AS (SELECT ticker, bucket, date, r, avg(r) OVER (PARTITION BY date) AS m, avg(r) OVER (PARTITION BY date, bucket) AS b FROM ret WHERE r IS NOT NULL), g AS (SELECT ticker, count(*) AS n, avg(r) AS my, avg(m) AS m1, avg(b) AS m2, covar_pop(m, m) AS s11, covar_pop(b, b) AS s22, covar_pop(m, b) AS s12, covar_pop(r, m) AS sy1, covar_pop(r, b) AS sy2 FROM f WHERE date < DATE '2024-01-20' GROUP BY 1), k AS (SELECT ticker, (sy1 * s22 - sy2 * s12) / (s11 * s22 - s12 * s12) AS b1, (sy2 * s11 - sy1 * s12) / (s11 * s22 - s12 * s12) AS b2, my, m1, m2 FROM g WHERE n >= 10 AND s11 * s22 - s12 * s12 > 1e-12) SELECT f.ticker, f.date, round(r - (my - b1 * m1 - b2 * m2) - b1 * m - b2 * b, 5) AS residual FROM f JOIN k USING (ticker) WHERE date >= DATE '2024-01-20'"))
def _(t):
    f = t.ret.filter("r is not null").withColumns({"m": F.avg("r").over(Window.partitionBy("date")), "b": F.avg("r").over(Window.partitionBy("date", "bucket"))})
    k = T.ols2(f.filter("date < '2024-01-20'"), ["ticker"], "r", "m", "b")
    return f.filter("date >= '2024-01-20'").join(k, "ticker").select("ticker", "date", F.round(F.col("r") - F.col("b0") - F.col("b1") * F.col("m") - F.col("b2") * F.col("b"), 5).alias("residual"))


@query("r7_54_maxstat_permutation")
def _(t):
    """Largest |corr| over lags against block shuffles of one side, weak pairs by few draws and the others by more."""
    return L.maxstat_permutation(series(t), lags=range(-3, 4), **KEYS)


@query("r7_55_frozen_lag_rolling", sql("ret", f", {_SER}, p AS (SELECT a.k AS a, b.k AS b, a.pos, a.v AS x, b.v AS y FROM s a JOIN s b ON b.pos = a.pos + 1 AND a.k < b.k), e(e) AS (VALUES (12), (18), (24), (29)) SELECT a, b, e AS end_pos, count(*) AS n, round(corr(x, y), 6) AS corr FROM p JOIN e ON pos BETWEEN e - 9 AND e GROUP BY 1, 2, 3"))
def _(t):
    return L.window_correlations(series(t), [12, 18, 24, 29], 10, lag=1, **KEYS)


@query("r7_56_relation_states", sql("ret", f", {_SER}, p AS (SELECT a.k AS a, b.k AS b, a.pos, a.v AS x, b.v AS y FROM s a JOIN s b ON b.pos = a.pos AND a.k < b.k), r AS (SELECT *, corr(x, y) OVER w AS c, (x - y - avg(x - y) OVER w) / stddev_pop(x - y) OVER w AS z, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY a, b ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT a, b, pos, round(c, 6) AS corr, round(z, 6) AS spread_z, CASE WHEN c >= 0.5 AND abs(z) < 1 THEN 'COUPLED' WHEN c >= 0.5 THEN 'STRETCHED' WHEN c <= -0.3 THEN 'OPPOSED' WHEN abs(z) >= 2 THEN 'DIVERGED' ELSE 'LOOSE' END AS state FROM r WHERE n = 10"))
def _(t):
    p = L.rolling_relations(series(t), 10, **KEYS)
    c, z = F.col("corr"), F.abs("spread_z")
    return p.select("a", "b", "pos", "corr", "spread_z", F.when((c >= 0.5) & (z < 1), "COUPLED").when(c >= 0.5, "STRETCHED").when(c <= -0.3, "OPPOSED").when(z >= 2, "DIVERGED").otherwise("LOOSE").alias("state"))


_E = "e AS (SELECT 'N' || (l_suppkey % 9) AS src, 'N' || (l_partkey % 9) AS dst, CAST(1 + min(l_linenumber) % 3 AS INTEGER) AS lag, count(*)::DOUBLE AS weight FROM lineitem WHERE l_suppkey % 9 <> l_partkey % 9 GROUP BY 1, 2)"


@query("r7_57_leader_scores", f"WITH {_E}, o AS (SELECT src AS node, sum(weight) AS w FROM e GROUP BY 1), i AS (SELECT dst AS node, sum(weight) AS w FROM e GROUP BY 1) SELECT node, round(coalesce(o.w, 0), 6) AS out_strength, round(coalesce(i.w, 0), 6) AS in_strength, round(coalesce(o.w, 0) - coalesce(i.w, 0), 6) AS leadership FROM o FULL JOIN i USING (node)")
def _(t):
    e = edges(t)
    o, i = e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("out_strength")), e.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("in_strength"))
    j = o.join(i, "node", "full").fillna(0.0)
    return j.withColumn("leadership", F.col("out_strength") - F.col("in_strength"))


@query("r7_58_relation_features", sql("ret", ", e AS (SELECT DISTINCT 'B' || (ticker % 5) AS own, 'B' || ((ticker + 1) % 5) AS peer FROM ret), b AS (SELECT bucket AS peer, date, avg(r) AS v FROM ret WHERE r IS NOT NULL GROUP BY 1, 2), x AS (SELECT r.ticker, r.date, r.r - b.v AS gap FROM ret r JOIN e ON e.own = r.bucket JOIN b ON b.peer = e.peer AND b.date = r.date) SELECT ticker, date, round(gap, 6) AS gap, CASE WHEN count(gap) OVER w >= 5 AND stddev_pop(gap) OVER w > 1e-12 THEN round((gap - avg(gap) OVER w) / stddev_pop(gap) OVER w, 6) END AS gap_z FROM x WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"))
def _(t):
    from panelweave.operators.rolling import rolling_z

    e = t.ret.select(F.concat(F.lit("B"), (F.col("ticker") % 5).cast("string")).alias("bucket"), F.concat(F.lit("B"), ((F.col("ticker") + 1) % 5).cast("string")).alias("peer")).distinct()
    b = t.ret.filter("r is not null").groupBy(F.col("bucket").alias("peer"), "date").agg(F.avg("r").alias("v"))
    x = t.ret.join(F.broadcast(e), "bucket").join(b, ["peer", "date"]).withColumn("gap", F.col("r") - F.col("v"))
    return x.select("ticker", "date", "gap", rolling_z(F.col("gap"), over("ticker", order="date"), 10, past_only=True, least=5).alias("gap_z"))


@query("r7_59_60_lead_features", sql("ret", f", {_SER}, e AS (SELECT a.k AS leader, b.k AS follower, lag FROM (SELECT DISTINCT k FROM s) a, (SELECT DISTINCT k FROM s) b, (VALUES (1), (2)) l(lag) WHERE a.k <> b.k) SELECT e.follower AS k, x.pos + e.lag AS pos, round(avg(x.v), 6) AS mean, round(max(x.v), 6) AS top, round(min(x.v), 6) AS low, count(*) FILTER (x.v >= 1.5) AS shocks FROM e JOIN s x ON x.k = e.leader GROUP BY 1, 2"))
def _(t):
    return L.other_leaders(series(t), 1.5, lags=[1, 2], **KEYS)


@query("r7_60_top_leaders", f"WITH {_E}, s AS (SELECT 'N' || (l_suppkey % 9) AS k, year(l_shipdate) * 12 + month(l_shipdate) AS pos, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) - 25 AS v FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src, lag) AS n FROM e) SELECT dst AS k, pos + lag AS pos, round(sum(weight * v) / sum(weight), 6) AS consensus, round(sum(weight * v), 6) AS pressure, round(max(v), 6) AS top, round(min(v), 6) AS low, count(*) FILTER (v >= 0.5) AS ups, count(*) FILTER (v <= -0.5) AS downs FROM r JOIN s ON s.k = r.src WHERE n <= 5 GROUP BY 1, 2")
def _(t):
    line = t.read("lineitem")
    node, month = F.concat(F.lit("N"), (F.col("l_suppkey") % 9).cast("string")), F.year("l_shipdate") * 12 + F.month("l_shipdate")
    s = line.groupBy(node.alias("k"), month.alias("pos")).agg((F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count("*") - 25).alias("v"))
    return L.edge_leaders(s, edges(t), 0.5, **KEYS)
