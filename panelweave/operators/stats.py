"""Statistics of features against targets. Long input: one row per (row, feature) with a value; results have a row per group."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelweave.functions.scalar import safe_div
from panelweave.functions.windows import complete_corr, pct_rank
from panelweave.operators.iterate import if_small
from panelweave.operators.quantiles import exact_quantiles, null_safe_join


def feature_quality(long: DataFrame, by: Sequence[str] = ("feature",), value: str = "value", entity: str = "ticker") -> DataFrame:
    """Share present, distinct values, deviation, quantiles, share of entities covered, and a quality score."""
    v, shares = F.col(value), (0.01, 0.05, 0.5, 0.95, 0.99)
    out = long.groupBy(*by).agg(F.count("*").alias("n_rows"), F.avg(v.isNotNull().cast("double")).alias("complete"), F.count_distinct(v).alias("n_values"), F.stddev_samp(v).alias("std"), (F.count_distinct(F.when(v.isNotNull(), F.col(entity))) / F.count_distinct(entity)).alias("entity_share"))
    q = exact_quantiles(long, by, value, shares).select(*by, *(F.get("quantiles", F.lit(i)).alias(f"q{round(100 * s):02d}") for i, s in enumerate(shares)))
    out = null_safe_join(out, q, by, *q.columns[len(by) :])
    return out.withColumn("quality", 0.45 * F.col("complete") + 0.25 * F.col("entity_share") + 0.15 * F.least(F.col("n_values") / 100.0, F.lit(1.0)) + 0.15)


def correlations(long: DataFrame, by: Sequence[str], x: str = "value", y: str = "target", least: int = 10) -> DataFrame:
    """Pairwise-complete Pearson correlation per group; null under `least` rows or without spread."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    enough = (F.count(a) >= least) & (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12)
    return long.groupBy(*by).agg(F.count(a).alias("n"), F.when(enough, complete_corr(a, b)).alias("corr"))


def spearman(long: DataFrame, by: Sequence[str], x: str = "value", y: str = "target", rank_y: bool = False) -> DataFrame:
    """Pearson correlation of average ranks; y stays as it is where it is binary."""
    rows = long.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.withColumn("__x", pct_rank(F.col(x), *by)).withColumn("__y", pct_rank(F.col(y), *by) if rank_y else F.col(y).cast("double"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), complete_corr(F.col("__x"), F.col("__y")).alias("spearman"))


def within_correlation(long: DataFrame, by: Sequence[str], within: str, x: str = "value", y: str = "target") -> DataFrame:
    """Correlation after both sides have lost their group means."""
    w = Window.partitionBy(*by, within)
    rows = long.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumns({"__x": F.col(x) - F.avg(x).over(w), "__y": F.col(y) - F.avg(y).over(w)})
    return rows.groupBy(*by).agg(F.count("*").alias("n"), complete_corr(F.col("__x"), F.col("__y")).alias("within_corr"))


def group_correlation_summary(long: DataFrame, by: Sequence[str], group: str, least: int = 5) -> DataFrame:
    """Correlation in each group (date, entity), then mean, weighted mean, quartiles and the share of the commoner sign."""
    each = correlations(long, [*by, group], least=least).filter("corr is not null")
    c, n = F.col("corr"), F.col("n")
    return each.groupBy(*by).agg(F.count("*").alias("groups"), F.avg(c).alias("mean"), (F.sum(c * n) / F.sum(n)).alias("weighted_mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.percentile(c, F.lit(0.25)).alias("q25"), F.percentile(c, F.lit(0.75)).alias("q75"), sign_consistency(c).alias("consistency"))


def sign_consistency(c: Column) -> Column:
    """Greater of the shares of positive and of negative values, among those that aren't zero."""
    n = F.count_if(F.abs(c) > 1e-12)
    return safe_div(F.greatest(F.count_if(c > 1e-12), F.count_if(c < -1e-12)), n)


def gram(long: DataFrame, *, row: str = "row_id", feature: str = "feature", value: str = "value") -> DataFrame:
    """Pairwise-complete sums for all pairs of features: (a, b, n, sx, sy, sxx, syy, sxy), a < b.

    A row's features are gathered (a few hundred at most, by the table's design) and its pairs summed map-side, so what is
    shuffled is a row per pair and task, not per pair and row.
    """
    rows = long.filter(F.col(value).isNotNull()).groupBy(row).agg(F.array_sort(F.collect_list(F.struct(F.col(feature).alias("f"), F.col(value).alias("v")))).alias("fs"))
    pairs = F.flatten(F.transform("fs", lambda p: F.transform(F.filter("fs", lambda q: q["f"] > p["f"]), lambda q: F.struct(p["f"].alias("a"), q["f"].alias("b"), p["v"].alias("x"), q["v"].alias("y")))))
    p = rows.select(F.explode(pairs).alias("p")).select("p.*")
    x, y = F.col("x"), F.col("y")
    return p.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))


def correlation_matrix(long: DataFrame, *, least: int = 10, shrink: float | None = None, **names) -> DataFrame:
    """(a, b, n, corr) of all feature pairs from their power sums; with `shrink`, times (n - 3) / (n - 3 + shrink)."""
    g = gram(long, **names)
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    corr = F.when((n >= least) & (vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy))
    return g.select("a", "b", "n", (corr * (n - 3) / (n - 3 + shrink) if shrink else corr).alias("corr"))


def components_of(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph: least labels spread over the edges and jump along labels until nothing changes. Labels only fall, so it ends."""
    from panelweave.operators.iterate import cut_lineage

    both = cut_lineage(edges.select(F.col(a).alias("s"), F.col(b).alias("t")).unionByName(edges.select(F.col(b).alias("s"), F.col(a).alias("t"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("s").alias("node")).agg(F.least(F.min("t"), F.col("s")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("t"), F.col("component").alias("c")), "t").groupBy(F.col("s").alias("node")).agg(F.min("c").alias("c"))
        moved = labels.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        jump = moved.join(moved.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
        new = cut_lineage(jump.select("node", F.coalesce(F.least("component", "root"), "component").alias("component"), "old"))
        if new.filter("component <> old").isEmpty():
            return new.drop("old")
        labels = new.drop("old")


def average_linkage(pairs: DataFrame, by: Sequence[str], *, cut: float, absent: float = 1.0, a: str = "a", b: str = "b", distance: str = "distance") -> DataFrame:
    """(by, node, cluster): average-linkage clusters at the cut; a cluster is named by its least node. A pair counts once; pairs that aren't there lie `absent` apart (beyond the cut).

    Clusters that are each other's nearest are merged, all such pairs of all groups in one round: average linkage is reducible (a merger is no
    nearer to a third cluster than the nearer of its parts), so this gives the clusters of merging pair by pair, up to ties, which go to lesser
    names. The table holds a row for each pair of clusters with sums of distances and counts; it only shrinks, and is never gathered.
    """
    from panelweave.operators.iterate import cut_lineage

    if cut >= absent:
        raise ValueError("the cut must lie below the distance of absent pairs")
    keys = list(by)
    both = pairs.filter(F.col(a) != F.col(b))
    labels = cut_lineage(both.select(*keys, F.col(a).alias("node")).unionByName(both.select(*keys, F.col(b).alias("node"))).distinct().withColumn("cluster", F.col("node")))
    d = both.filter(F.col(distance) < absent).groupBy(*keys, F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(F.min(distance).cast("double").alias("s"), F.lit(1).cast("long").alias("n"))
    d = cut_lineage(d)
    while True:
        size = labels.groupBy(*keys, "cluster").agg(F.count("*").alias("m"))
        sized = lambda df, c: df.join(size.select(*keys, F.col("cluster").alias(c), F.col("m").alias(f"m{c}")), [*keys, c])  # noqa: B023, E731
        cells = F.col("mx") * F.col("my")
        near = sized(sized(d, "x"), "y").withColumn("v", F.round((F.col("s") + (cells - F.col("n")) * absent) / cells, 12))
        best = F.min(F.struct("v", "x", "y")).alias("best")
        each = near.groupBy(*keys, F.col("x").alias("c")).agg(best).unionByName(near.groupBy(*keys, F.col("y").alias("c")).agg(best)).groupBy(*keys, "c").agg(F.min("best").alias("best"))
        merged = each.filter(F.col("best.v") <= cut).groupBy(*keys, F.col("best.x").alias("x"), F.col("best.y").alias("y")).agg(F.count("*").alias("votes")).filter("votes = 2")
        merged = cut_lineage(merged.select(*keys, F.col("y").alias("gone"), F.col("x").alias("into")))
        if merged.isEmpty():
            return labels
        renamed = lambda df, c: df.join(merged.withColumnRenamed("gone", c), [*keys, c], "left").withColumn(c, F.coalesce("into", c)).drop("into")  # noqa: B023, E731
        labels = cut_lineage(renamed(labels, "cluster").select(*labels.columns))
        moved = renamed(renamed(d, "x"), "y").filter("x <> y")
        d = cut_lineage(moved.groupBy(*keys, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("s").alias("s"), F.sum("n").alias("n")))


def auc(long: DataFrame, by: Sequence[str], score: str = "value", target: str = "target") -> DataFrame:
    """Tie-aware area under the ROC curve: (rank sum of positives - P(P+1)/2) / (P N). Rows are first reduced to distinct scores."""
    s = long.filter(F.col(score).isNotNull() & F.col(target).isin(0, 1)).groupBy(*by, score).agg(F.count("*").alias("k"), F.sum(target).alias("p"))
    below = F.sum("k").over(Window.partitionBy(*by).orderBy(score)) - F.col("k")
    s = s.withColumn("rank_sum", F.col("p") * (below + (F.col("k") + 1) / 2.0))
    out = s.groupBy(*by).agg(F.sum("k").alias("n"), F.sum("p").alias("positives"), F.sum("rank_sum").alias("rs"))
    p, n = F.col("positives").cast("double"), (F.col("n") - F.col("positives")).cast("double")
    return out.withColumn("auc", F.when((p > 0) & (n > 0), (F.col("rs") - p * (p + 1) / 2) / (p * n))).drop("rs")


def average_precision(long: DataFrame, by: Sequence[str], score: str = "value", target: str = "target") -> DataFrame:
    """Sum of precision times recall gained over falling distinct scores, the base rate and the lift."""
    s = long.filter(F.col(score).isNotNull() & F.col(target).isin(0, 1)).groupBy(*by, score).agg(F.count("*").alias("k"), F.sum(target).alias("p"))
    w = Window.partitionBy(*by).orderBy(F.desc(score))
    s = s.withColumns({"tp": F.sum("p").over(w), "at": F.sum("k").over(w)})
    out = s.groupBy(*by).agg(F.sum("k").alias("n"), F.sum("p").alias("positives"), F.sum(F.col("p") * F.col("tp") / F.col("at")).alias("gain"))
    out = out.withColumn("ap", F.when(F.col("positives") > 0, F.col("gain") / F.col("positives"))).drop("gain")
    return out.withColumns({"base_rate": F.col("positives") / F.col("n"), "lift": F.col("ap") * F.col("n") / F.when(F.col("positives") > 0, F.col("positives"))})


def oriented(a: Column) -> tuple[Column, Column]:
    """(max(a, 1 - a), direction)."""
    return F.greatest(a, 1 - a), F.when(a >= 0.5, 1).when(a.isNotNull(), -1)


def auc_error(a: Column, p: Column, n: Column) -> Column:
    """Hanley-McNeil standard error."""
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    return F.sqrt(F.greatest((a * (1 - a) + (p - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a)) / (p * n), F.lit(0.0)))


def shrunk_auc(a: Column, p: Column, n: Column, strength: float = 80.0) -> Column:
    """Towards one half by the harmonic mean of the class sizes."""
    h = 2.0 * p * n / (p + n)
    return 0.5 + h / (h + strength) * (a - 0.5)


def mean_difference(long: DataFrame, by: Sequence[str], value: str = "value", target: str = "target") -> DataFrame:
    """Standardised difference of means, and the median gap over the pooled quartile range."""
    one, zero = F.when(F.col(target) == 1, F.col(value)), F.when(F.col(target) == 0, F.col(value))
    pooled = F.sqrt((F.var_samp(one) + F.var_samp(zero)) / 2)
    means = long.groupBy(*by).agg(F.when(pooled > 1e-12, (F.avg(one) - F.avg(zero)) / pooled).alias("smd"))
    # a value counts among all, and among those of its class
    twice = long.withColumn("__of", F.explode(F.array(F.lit(-1), F.when(F.col(target).isin(0, 1), F.col(target).cast("int"))))).filter("__of is not null")
    q = exact_quantiles(twice, [*by, "__of"], value, (0.25, 0.5, 0.75))
    at = lambda of, i: F.max(F.when(F.col("__of") == of, F.get("quantiles", F.lit(i))))
    wide = q.groupBy(*by).agg((at(-1, 2) - at(-1, 0)).alias("iqr"), (at(1, 1) - at(0, 1)).alias("gap"))
    return null_safe_join(means, wide, by, "iqr", "gap").withColumn("median_gap", F.when(F.col("iqr") > 1e-12, F.col("gap") / F.col("iqr"))).drop("iqr", "gap")


def distribution_distances(long: DataFrame, by: Sequence[str], value: str = "value", target: str = "target") -> DataFrame:
    """Kolmogorov-Smirnov distance and Wasserstein distance over the quartile range, from cumulative counts of distinct values."""
    rows = long.filter(F.col(value).isNotNull() & F.col(target).isin(0, 1))
    s = rows.groupBy(*by, value).agg(F.sum(F.col(target)).alias("p"), F.sum(1 - F.col(target)).alias("q"))
    w, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    gap = F.abs(F.sum("p").over(w) / F.sum("p").over(whole) - F.sum("q").over(w) / F.sum("q").over(whole))
    s = s.withColumns({"gap": gap, "step": F.lead(value).over(w) - F.col(value)})
    iqr = exact_quantiles(rows, by, value, (0.25, 0.75)).select(*by, (F.get("quantiles", F.lit(1)) - F.get("quantiles", F.lit(0))).alias("iqr"))
    out = s.groupBy(*by).agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * F.col("step")).alias("area"))
    return out.join(iqr, list(by)).withColumn("wasserstein", F.when(F.col("iqr") > 1e-12, F.col("area") / F.col("iqr"))).drop("area", "iqr")


def binned_counts(long: DataFrame, by: Sequence[str], bins: int, value: str = "value", target: str = "target") -> DataFrame:
    """(group, bin, n1, n0) over bins of equal shares of ranks: min(floor(pct_rank * bins), bins - 1)."""
    rows = long.filter(F.col(value).isNotNull() & F.col(target).isin(0, 1))
    code = F.least(F.floor(pct_rank(F.col(value), *by) * bins), F.lit(bins - 1)).cast("int")
    return rows.withColumn("bin", code).groupBy(*by, "bin").agg(F.count_if(F.col(target) == 1).alias("n1"), F.count_if(F.col(target) == 0).alias("n0"))


def mutual_information(long: DataFrame, by: Sequence[str], bins: int = 8, **names) -> DataFrame:
    """Mutual information of the binned value and the target in nats, and its share of the target's entropy."""
    c = binned_counts(long, by, bins, **names)
    w = Window.partitionBy(*by)
    total, ones = F.sum(F.col("n1") + F.col("n0")).over(w), F.sum("n1").over(w)
    c = c.withColumns({"t": total, "p": ones / total})

    def term(k: str, prior: Column) -> Column:
        joint = F.col(k) / F.col("t")
        return F.when(F.col(k) > 0, joint * F.log(joint / ((F.col("n1") + F.col("n0")) / F.col("t") * prior))).otherwise(0.0)

    out = c.groupBy(*by).agg(F.sum(term("n1", F.col("p")) + term("n0", 1 - F.col("p"))).alias("mi"), F.first("p").alias("p"))
    h = -(F.col("p") * F.log("p") + (1 - F.col("p")) * F.log(1 - F.col("p")))
    return out.withColumn("normalised", F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("mi") / h)).drop("p")


def edge_divergences(reference: DataFrame, current: DataFrame, by: Sequence[str], value: str = "value", bins: int = 10, eps: float = 1e-5) -> DataFrame:
    """Population stability index and Jensen-Shannon divergence (counts + 0.5) of two samples, on the reference's quantile edges with open ends."""
    inner = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(reference, by, value, inner).select(*by, F.array_distinct("quantiles").alias("edges"))
    both = reference.select(*by, value, F.lit(1).alias("__ref")).unionByName(current.select(*by, value, F.lit(0).alias("__ref"))).filter(F.col(value).isNotNull())
    coded = both.join(if_small(edges), list(by)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(value))))
    each = coded.groupBy(*by, "bin", F.size("edges").alias("last")).agg(F.sum("__ref").alias("r"), F.sum(1 - F.col("__ref")).alias("c"))
    frame = edges.select(*by, F.size("edges").alias("last"), F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    full = frame.join(each, [*by, "last", "bin"], "left").fillna(0, ["r", "c"])
    w = Window.partitionBy(*by)
    k = F.col("last") + 1
    full = full.withColumns({"rs": F.greatest(F.col("r") / F.sum("r").over(w), F.lit(eps)), "cs": F.greatest(F.col("c") / F.sum("c").over(w), F.lit(eps)), "pr": (F.col("r") + 0.5) / (F.sum("r").over(w) + 0.5 * k), "pc": (F.col("c") + 0.5) / (F.sum("c").over(w) + 0.5 * k)})
    m = (F.col("pr") + F.col("pc")) / 2
    return full.groupBy(*by).agg(F.sum((F.col("cs") - F.col("rs")) * F.log(F.col("cs") / F.col("rs"))).alias("psi"), F.sum(0.5 * F.col("pr") * F.log(F.col("pr") / m) + 0.5 * F.col("pc") * F.log(F.col("pc") / m)).alias("js"))


def segment_stability(df: DataFrame, x: str, y: str, segments: int, *, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Correlation in consecutive segments of equal length, and the share of segments that agree with the overall sign."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(*by))
    seg = df.withColumn("segment", F.floor((F.row_number().over(w) - 1) * segments / n).cast("int"))
    each = seg.groupBy(*by, "segment").agg(complete_corr(F.col(x), F.col(y)).alias("corr"))
    total = df.groupBy(*by).agg(complete_corr(F.col(x), F.col(y)).alias("total"))
    return each.join(total, list(by)).groupBy(*by).agg(F.min("corr").alias("least"), F.max("corr").alias("most"), F.avg((F.signum("corr") == F.signum("total")).cast("double")).alias("agreement"))


def error_groups(df: DataFrame, target: str, score: str, *by: str, top: float = 0.8, low: float = 0.5) -> DataFrame:
    """A and B: positive and negative of high rank; C and D: of low rank; null between."""
    r = pct_rank(F.col(score), *by)
    out = df.withColumn("__rank", r)
    high, deep, y = F.col("__rank") >= top, F.col("__rank") <= low, F.col(target) == 1
    return out.withColumn("error_group", F.when(high & y, "A").when(high, "B").when(deep & y, "C").when(deep, "D")).drop("__rank")


def rejection_at_retention(df: DataFrame, score: str, positive: Column, negative: Column, retention: float, by: Sequence[str] = ()) -> DataFrame:
    """Share of negatives below the score that keeps `retention` of the positives (an order statistic, no interpolation)."""
    w = Window.partitionBy(*by).orderBy(score)
    p = df.filter(positive).withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy(*by))})
    cut = p.filter(F.col("__i") == F.floor((1 - retention) * (F.col("__n") - 1))).select(*by, F.col(score).alias("cut"))
    neg = df.filter(negative).select(*by, score)
    joined = neg.join(if_small(cut), list(by)) if by else neg.crossJoin(F.broadcast(cut))
    return joined.groupBy(*by).agg(F.first("cut").alias("cut"), F.avg((F.col(score) < F.col("cut")).cast("double")).alias("rejected"))


def fold_rollup(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    m = F.col(metric)
    return df.filter(m.isNotNull()).groupBy(*by).agg(F.count("*").alias("folds"), F.avg(m).alias("mean"), F.percentile(m, F.lit(0.5)).alias("median"), F.min(m).alias("min"), F.max(m).alias("max"), F.stddev_samp(m).alias("std"), F.avg((m > 0).cast("double")).alias("positive_share"), sign_consistency(m).alias("consistency"))


def sign_flip_p(df: DataFrame, by: Sequence[str], value: str, *, most: int = 16) -> DataFrame:
    """Exact two-sided sign-flip p-value of a mean: all 2^n sign vectors of a group's values are compared with what was seen.

    A group of more than `most` values, whose vectors are too many, has its n and no p; the values of such groups are never gathered.
    """
    rows = df.filter(F.col(value).isNotNull())
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    g = rows.join(sizes.filter(F.col("n") <= most).select(*by), list(by), "left_semi").groupBy(*by).agg(F.collect_list(value).alias("v"))
    flips = g.withColumn("seen", F.abs(F.aggregate("v", F.lit(0.0), lambda a, x: a + x))).select(*by, "v", "seen", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size("v")) - 1)).alias("mask"))
    signed = F.aggregate(F.transform("v", lambda x, i: F.when(F.call_function("shiftright", F.col("mask"), i).bitwiseAND(F.lit(1)) == 1, -x).otherwise(x)), F.lit(0.0), lambda a, x: a + x)
    p = flips.groupBy(*by).agg(F.avg((F.abs(signed) >= F.col("seen") - 1e-12).cast("double")).alias("p"))
    return sizes.join(p, list(by), "left").select(*by, "n", "p")


def replicate_sums(df: DataFrame, by: Sequence[str], unit: Sequence[str], sums: dict[str, Column], *, draws: int, seed: int) -> DataFrame:
    """(by, rep, sums): the columns' sums in each of `draws` replicates, in which a unit (a date, a stratum row) counts a Poisson(1) number of times.

    A unit's numbers come from a generator seeded by its name, so they are the same in all groups and on any cluster. Tasks add whole vectors of
    replicates to their groups and hand on one vector a group; no group is gathered.
    """
    names = list(sums)
    units = df.groupBy(*by, *unit).agg(*(F.sum(c).cast("double").alias(n) for n, c in sums.items()))
    keyed = units.select(*by, F.concat_ws("|", *(F.coalesce(F.col(u).cast("string"), F.lit("-")) for u in unit)).alias("__u"), *names)
    schema = T.StructType([*keyed.select(*by).schema, *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in names)])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def told() -> pd.DataFrame:
            return pd.DataFrame([(*k, *v.tolist()) for k, v in held.items()], columns=schema.names)

        for pdf in batches:
            groups = zip(*(pdf[b] for b in by), strict=True) if by else [()] * len(pdf)
            for key, u, values in zip(groups, pdf["__u"], pdf[names].to_numpy(float), strict=True):
                times = np.random.default_rng(zlib.crc32(f"{seed}|{u}".encode())).poisson(1.0, draws)
                held[key] = held.get(key, 0.0) + np.nan_to_num(values)[:, None] * times[None, :]
            if len(held) * draws > 4_000_000:
                yield told()
                held.clear()
        if held:
            yield told()

    vectors = keyed.mapInPandas(add, schema)
    each = vectors.select(*by, F.posexplode(F.arrays_zip(*names)).alias("rep", "x"))
    return each.groupBy(*by, "rep").agg(*(F.sum(f"x.{n}").alias(n) for n in names))


def bootstrap_mean(df: DataFrame, by: Sequence[str], value: str, unit: Sequence[str], *, draws: int = 200, seed: int = 7, alpha: float = 0.1) -> DataFrame:
    """Percentile interval of a group's mean over Poisson replicates of its units; replicates without any are left out."""
    v = F.col(value)
    sums = replicate_sums(df.filter(v.isNotNull()), by, unit, {"__s": v, "__n": F.lit(1)}, draws=draws, seed=seed).filter("__n > 0").withColumn("m", F.col("__s") / F.col("__n"))
    return sums.groupBy(*by).agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))


def poisson_bootstrap(df: DataFrame, by: Sequence[str], tp: Column, alerts: Column, unit: Sequence[str], *, draws: int = 200, seed: int = 11, quantile: float = 0.05) -> DataFrame:
    """Lower quantile of precision over Poisson replicates of the units; replicates without alerts are left out."""
    sums = replicate_sums(df.filter(alerts), by, unit, {"tp": tp.cast("int"), "al": alerts.cast("int")}, draws=draws, seed=seed)
    return sums.filter("al > 0").groupBy(*by).agg(F.count("*").alias("draws"), F.percentile(F.col("tp") / F.col("al"), F.lit(quantile)).alias("precision_low"))


def bh_qvalues(df: DataFrame, p: str, by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg q-values: p * m / rank, made monotone from the largest p down."""
    whole = Window.partitionBy(*by)
    out = df.withColumn("__rank", F.row_number().over(whole.orderBy(p, *tie)))
    out = out.withColumn("__q", F.col(p) * F.count(p).over(whole) / F.col("__rank"))
    # from the largest rank down: a frame that reaches to the end would be gone through anew for each row
    down = whole.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("q", F.least(F.min("__q").over(down), F.lit(1.0))).drop("__q", "__rank")


def fisher_combine(df: DataFrame, by: Sequence[str], p: str) -> DataFrame:
    """-2 sum ln p and its chi-square tail for 2k degrees, which is a finite sum; its terms are summed as logarithms, for groups of any size."""
    g = df.groupBy(*by).agg(F.count(p).alias("k"), (-2.0 * F.sum(F.log(F.greatest(F.col(p), F.lit(1e-300))))).alias("statistic"))
    half = F.col("statistic") / 2
    both = lambda x, y: F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log(half / i)
        return F.struct(term.alias("term"), F.when(i < F.col("k"), both(a["sum"], term)).otherwise(a["sum"]).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("k") - 1, F.lit(1)).cast("int")), F.struct((-half).alias("term"), (-half).alias("sum")), add, lambda a: a["sum"])
    return g.withColumn("p", F.when(half > 0, F.least(F.exp(tail), F.lit(1.0))).when(half == 0, 1.0))


def ols2(df: DataFrame, by: Sequence[str], y: str, x1: str, x2: str, weight: Column | None = None, least: int = 10) -> DataFrame:
    """Closed-form least squares of y on a constant and two regressors per group: (b0, b1, b2, n). weight: rows that count (1) or not (0)."""
    ok = F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull() & (weight if weight is not None else F.lit(True))
    f = df.filter(ok)
    g = f.groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.covar_pop(x1, x1).alias("s11"), F.covar_pop(x2, x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"), F.covar_pop(y, x1).alias("sy1"), F.covar_pop(y, x2).alias("sy2"))
    det = F.col("s11") * F.col("s22") - F.col("s12") ** 2
    b1 = F.when(det > 1e-12, (F.col("sy1") * F.col("s22") - F.col("sy2") * F.col("s12")) / det)
    b2 = F.when(det > 1e-12, (F.col("sy2") * F.col("s11") - F.col("sy1") * F.col("s12")) / det)
    out = g.filter(F.col("n") >= least).withColumns({"b1": b1, "b2": b2}).filter("b1 is not null")
    return out.select(*by, (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"), "b1", "b2", "n")
