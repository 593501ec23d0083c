"""Gates, tiers, profiles and leaderboards built from per-fold feature statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.scalar import clip


def alignment_gate(fold_corr: DataFrame, train: Column, *, by: str = "feature", value: str = "corr", least_match: float = 0.6, least_mean: float = 0.02) -> DataFrame:
    """Per feature: mean over training folds, share of the other folds with the same sign, whether both reach their minimums, and why not."""
    m = fold_corr.filter(F.col(value).isNotNull()).withColumn("__train", F.avg(F.when(train, F.col(value))).over(Window.partitionBy(by)))
    out = m.groupBy(by).agg(F.first("__train").alias("train_mean"), F.avg(F.when(~train, (F.signum(value) == F.signum("__train")).cast("double"))).alias("match"))
    low, off = F.abs("train_mean") < least_mean, F.coalesce(F.col("match"), F.lit(0.0)) < least_match
    return out.withColumns({"passes": F.coalesce(~low & ~off, F.lit(False)), "reasons": F.concat_ws(",", F.when(low, "weak"), F.when(off, "unstable"))})


def direction_relation(a: Column, b: Column, strong: float = 0.03, weak: float = 0.01) -> Column:
    """How a feature relates to two targets: specific to one, to both with the same or the opposite sign, or to neither."""
    return F.when((F.abs(a) >= strong) & (F.abs(b) < weak), "FIRST_ONLY").when((F.abs(b) >= strong) & (F.abs(a) < weak), "SECOND_ONLY").when((F.abs(a) >= weak) & (F.abs(b) >= weak) & (F.signum(a) != F.signum(b)), "OPPOSITE").when((F.abs(a) >= weak) & (F.abs(b) >= weak), "COMMON").otherwise("NONE")


def evidence_grade(selection: Column, confirmation: Column, *, strong: float = 0.05, weak: float = 0.02) -> Column:
    """A to D: strong and confirmed, confirmed, unconfirmed, weak."""
    same = F.signum(selection) == F.signum(confirmation)
    return F.when((F.abs(selection) >= strong) & same & (F.abs(confirmation) >= weak), "A").when((F.abs(selection) >= weak) & same, "B").when(F.abs(selection) >= weak, "C").otherwise("D")


def profiles(ranked: DataFrame, *, top: int, strict: Column, representative: Column) -> DataFrame:
    """(profile, feature): all, the top by place, strict ones, representatives, and strict representatives, as set algebra of one table."""
    made = {"P0": F.lit(True), "P1": F.col("place") <= top, "P2": strict, "P3": representative, "P4": strict & representative, "P5": (F.col("place") <= top) & ~representative}
    out = None
    for name, cond in made.items():
        one = ranked.filter(F.coalesce(cond, F.lit(False))).select(F.lit(name).alias("profile"), "feature")
        out = one if out is None else out.unionByName(one)
    return out


def clipped_scale(df: DataFrame, value: str, by: Sequence[str] = (), low: float = 0.05, high: float = 0.95, name: str = "scaled", reverse: bool = False) -> DataFrame:
    """(x - q05) / (q95 - q05) between 0 and 1."""
    q = df.groupBy(*by).agg(F.percentile(value, F.lit(low)).alias("__l"), F.percentile(value, F.lit(high)).alias("__h"))
    x = df.join(F.broadcast(q), list(by)) if by else df.crossJoin(F.broadcast(q))
    s = F.when(F.col("__h") > F.col("__l"), clip((F.col(value) - F.col("__l")) / (F.col("__h") - F.col("__l")), 0.0, 1.0))
    return x.withColumn(name, 1 - s if reverse else s).drop("__l", "__h")


def separation_score(auc: Column, coverage: Column, consistency: Column, *, least_coverage: float = 0.5) -> Column:
    """Weighted distance of the oriented AUC from one half and sign consistency, times the root of coverage; 0 below the least coverage."""
    raw = 0.7 * 2 * F.abs(auc - 0.5) + 0.3 * F.coalesce(consistency, F.lit(0.0))
    return F.when(coverage >= least_coverage, raw * F.sqrt(coverage)).otherwise(0.0)


def top_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def graph_tables(effects: DataFrame, source: str, target: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a bipartite relation: nodes with kind and degree, edges with weight."""
    edges = effects.select(F.col(source).cast("string").alias("src"), F.col(target).cast("string").alias("dst"), F.col(weight).alias("weight"))
    left = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).withColumn("kind", F.lit(source))
    right = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("degree")).withColumn("kind", F.lit(target))
    return left.unionByName(right), edges
