"""Pooling of effects over levels: priors without the entity itself, disjoint rings, posteriors, evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.scalar import clip, logit, normal_two_sided, safe_div
from panelweave.operators.iterate import if_small


def prior_without_self(df: DataFrame, level: Sequence[str], effect: str, weight: str, name: str) -> DataFrame:
    """Weighted mean of the level's other members."""
    w = Window.partitionBy(*level)
    wx, ww = F.sum(F.col(effect) * F.col(weight)).over(w), F.sum(weight).over(w)
    return df.withColumn(name, safe_div(wx - F.col(effect) * F.col(weight), F.when(F.abs(ww - F.col(weight)) > 1e-12, ww - F.col(weight)).otherwise(0.0)))


def peer_rings(df: DataFrame, stratum: Sequence[str], bucket: str, market: str, effect: str, weight: str) -> DataFrame:
    """Disjoint rings of peers: the bucket without the row, the market outside the bucket, and the rest. Each with mean, Kish's effective size and standard error, from four window sums."""
    x, w = F.col(effect), F.col(weight)
    moments = {"w": w, "w2": w * w, "wx": w * x, "wxx": w * x * x}
    total = {k: F.sum(m).over(Window.partitionBy(*stratum)) for k, m in moments.items()}
    in_market = {k: F.sum(m).over(Window.partitionBy(*stratum, market)) for k, m in moments.items()}
    in_bucket = {k: F.sum(m).over(Window.partitionBy(*stratum, market, bucket)) for k, m in moments.items()}
    rings = {"bucket": {k: in_bucket[k] - moments[k] for k in moments}, "market": {k: in_market[k] - in_bucket[k] for k in moments}, "rest": {k: total[k] - in_market[k] for k in moments}}
    out = {}
    for ring, s in rings.items():
        there = s["w"] > 1e-9
        mean = s["wx"] / s["w"]
        neff = s["w"] * s["w"] / s["w2"]
        out |= {f"{ring}_mean": F.when(there, mean), f"{ring}_neff": F.when(there, neff), f"{ring}_se": F.when(there, F.sqrt(F.greatest(s["wxx"] / s["w"] - mean * mean, F.lit(0.0)) / neff))}
    return df.withColumns(out)


def combined_prior(levels: Sequence[tuple[Column, float]]) -> Column:
    """Mean of the levels that are there, by their weights."""
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in levels), F.lit(0.0))
    bottom = sum((F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in levels), F.lit(0.0))
    return F.when(bottom > 0, top / bottom)


def partial_pooling(df: DataFrame, raw: str, prior: str, n: str, support: Column, strength: float) -> DataFrame:
    """reliability = n / (n + strength) * sqrt(support); posterior = reliability * raw + (1 - reliability) * prior."""
    rel = F.col(n) / (F.col(n) + strength) * F.sqrt(support)
    return df.withColumn("reliability", rel).withColumn("posterior", F.col("reliability") * F.col(raw) + (1 - F.col("reliability")) * F.coalesce(F.col(prior), F.lit(0.0)))


def taxonomy(own: Column, prior: Column, reliability: Column, *, weak: float = 0.02, ratio: float = 1.5, least: float = 0.3) -> Column:
    """What an entity's effect is against its prior's: low evidence, weak, reversal, unique, amplified, dampened or shared."""
    return (
        F.when(reliability < least, "LOW_EVIDENCE")
        .when((F.abs(own) < weak) & (F.abs(F.coalesce(prior, F.lit(0.0))) < weak), "WEAK")
        .when(prior.isNull() | (F.abs(prior) < weak), "UNIQUE")
        .when(F.signum(own) != F.signum(prior), "REVERSAL")
        .when(F.abs(own) > ratio * F.abs(prior), "AMPLIFIED")
        .when(F.abs(own) * ratio < F.abs(prior), "DAMPENED")
        .otherwise("SHARED")
    )


def sensitivity(long: DataFrame, by: Sequence[str], effect: str, z: str) -> DataFrame:
    """Over several strengths: median effect, least |z|, share of the commoner sign, its two-sided p."""
    from panelweave.operators.stats import sign_consistency

    out = long.groupBy(*by).agg(F.count("*").alias("strengths"), F.percentile(effect, F.lit(0.5)).alias("median"), F.min(F.abs(F.col(z))).alias("least_z"), sign_consistency(F.col(effect)).alias("consistency"))
    return out.withColumn("p", normal_two_sided(F.col("least_z")))


def smoothed_prior(df: DataFrame, entity: str, target: str, strength: float = 80.0) -> DataFrame:
    """(sum + strength * overall rate) / (n + strength) per entity, and its logit."""
    total = df.agg(F.avg(target).alias("__rate"))
    g = df.groupBy(entity).agg(F.sum(target).alias("hits"), F.count("*").alias("n")).crossJoin(F.broadcast(total))
    return g.withColumn("prior", (F.col("hits") + strength * F.col("__rate")) / (F.col("n") + strength)).withColumn("prior_logit", logit(F.col("prior"))).drop("__rate")


def robust_state(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Median and scale (quartile range / 1.349, else the deviation, else 1) per group, to be applied to later rows."""
    iqr = (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))) / 1.349
    out = long.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("centre"), iqr.alias("iqr"), F.stddev_pop(value).alias("std"))
    return out.withColumn("scale", F.when(F.col("iqr") > 1e-9, F.col("iqr")).when(F.col("std") > 1e-9, F.col("std")).otherwise(1.0)).drop("iqr", "std")


def evidence(long: DataFrame, state: DataFrame, directions: DataFrame, by: Sequence[str], row: str = "row_id", bound: float = 6.0) -> DataFrame:
    """Per row: oriented, clipped z of its features as count, weighted mean, least, greatest, deviation, and favourable and adverse shares."""
    z = clip((F.col("value") - F.col("centre")) / F.col("scale"), -bound, bound) * F.col("direction")
    x = long.join(if_small(state), list(by)).join(if_small(directions), "feature").withColumn("z", z).filter("z is not null")
    return x.groupBy(row).agg(F.count("*").alias("slots"), (F.sum(F.col("z") * F.col("weight")) / F.sum("weight")).alias("mean"), F.min("z").alias("low"), F.max("z").alias("high"), F.stddev_pop("z").alias("std"), F.avg((F.col("z") > 0.5).cast("double")).alias("favourable"), F.avg((F.col("z") < -0.5).cast("double")).alias("adverse"))


def adaptive_eligibility(counts: DataFrame, *, recent_from: int, rows: int, fraction: float, floor: int, least_pos: int, least_neg: int, entity: str = "ticker", fold: str = "fold_id") -> DataFrame:
    """Whether an entity's fold has enough rows, positives and negatives; recent folds need only a fraction of the entity's largest."""
    top = F.max("n").over(Window.partitionBy(entity))
    need = F.when(F.col(fold) >= recent_from, F.least(F.lit(rows), F.greatest(F.lit(floor), F.ceil(fraction * top)))).otherwise(rows)
    return counts.withColumn("need", need.cast("long")).withColumn("eligible", (F.col("n") >= F.col("need")) & (F.col("pos") >= least_pos) & (F.col("n") - F.col("pos") >= least_neg))


def entity_similarity(effects: DataFrame, entity: str, node: str, effect: str, *, top: int = 3) -> DataFrame:
    """(a, b, cosine, spearman, similarity, rank): 0.6 cosine + 0.4 rank correlation over common nodes, the `top` of each entity."""
    from panelweave.functions.windows import complete_corr, pct_rank

    x = effects.select(F.col(entity).alias("a"), F.col(node).alias("node"), F.col(effect).alias("x"))
    y = effects.select(F.col(entity).alias("b"), F.col(node).alias("node"), F.col(effect).alias("y"))
    p = x.join(y, "node").filter("a <> b")
    p = p.withColumns({"rx": pct_rank(F.col("x"), "a", "b"), "ry": pct_rank(F.col("y"), "a", "b")})
    out = p.groupBy("a", "b").agg((F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") ** 2) * F.sum(F.col("y") ** 2))).alias("cosine"), complete_corr(F.col("rx"), F.col("ry")).alias("spearman"))
    out = out.withColumn("similarity", F.round(0.6 * F.col("cosine") + 0.4 * F.coalesce("spearman", F.lit(0.0)), 9))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).filter(F.col("rank") <= top)
