"""Compositions over scores, folds and feature statistics: metric bundles, weights, prior-fold choices, specialists, frames."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.scalar import interpolate, safe_div, wilson_lower
from panelweave.operators import policy as P
from panelweave.operators import stats as T


def binary_metrics(df: DataFrame, by: Sequence[str], score: str = "score", target: str = "target") -> DataFrame:
    """Rows, positives, base rate, area under the ROC curve, average precision, and its lift over the base rate."""
    a = T.auc(df, by, score, target).select(*by, "auc")
    return T.average_precision(df, by, score, target).join(a, list(by)).select(*by, F.col("n").alias("rows"), "positives", "base_rate", "ap", "auc", "lift")


def threshold_metrics(df: DataFrame, by: Sequence[str], threshold: Column, score: str = "score", target: str = "target") -> DataFrame:
    """Alerts, hits, precision, recall and the Wilson bound of precision at a threshold; recall 0 without positives."""
    a, y = F.col(score) >= threshold, F.col(target) == 1
    out = df.groupBy(*by).agg(F.count_if(a).alias("alerts"), F.count_if(a & y).alias("tp"), F.count_if(y).alias("positives"))
    rate = lambda n, d: F.when(d > 0, n / d)
    alerts, tp, p = (F.col(c) for c in ("alerts", "tp", "positives"))
    return out.select(*by, "alerts", "tp", (alerts - tp).alias("fp"), rate(tp, alerts).alias("precision"), (tp / F.greatest(p, F.lit(1))).alias("recall"), F.when(alerts > 0, wilson_lower(tp, alerts)).alias("wilson_low"))


def meta_weights(df: DataFrame, *, negative_cost: float, half_life: float, target: str = "target", date: str = "date", name: str = "weight") -> DataFrame:
    """Weights for a fit on scores: negatives cost `negative_cost`, rows lose half their weight every `half_life` days before the last date, mean 1."""
    last = df.agg(F.max(date).alias("__last"))
    age = F.greatest(F.datediff("__last", F.col(date)), F.lit(0))
    raw = df.crossJoin(F.broadcast(last)).withColumn("__w", F.when(F.col(target) == 0, negative_cost).otherwise(1.0) * F.pow(F.lit(0.5), age / half_life))
    mean = raw.agg(F.avg("__w").alias("__mean"))
    return raw.crossJoin(F.broadcast(mean)).withColumn(name, F.when(F.col("__mean") > 0, F.col("__w") / F.col("__mean")).otherwise(F.col("__w"))).drop("__w", "__mean", "__last")


def numeric_rollup(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, least and greatest of each numeric column over the runs of a group."""
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(F.count("*").alias("runs"), *aggs)


def recent_rows(df: DataFrame, days: int, *, fold: str = "fold_id", date: str = "date") -> DataFrame:
    """(row columns, for_fold): for each fold the rows of the last `days` trading dates before its first date. Dates are numbered in a row per date."""
    cal = df.groupBy(date).agg(F.min(fold).alias("__fold")).withColumn("__i", F.row_number().over(Window.orderBy(date)))
    starts = cal.groupBy(F.col("__fold").alias("for_fold")).agg(F.min("__i").alias("__start"))
    held = cal.join(starts, (F.col("__i") < F.col("__start")) & (F.col("__i") >= F.col("__start") - days)).select(date, "for_fold")
    return df.join(held, date)


def prior_choice(stats: DataFrame, keys: Sequence[str], by: Sequence[str], value: Column, most: int, *, fold: str = "fold_id", digits: int = 9) -> DataFrame:
    """For each fold and group, the `most` keys of the highest mean over earlier folds only (ties by key): (for_fold, by, keys, prior, place)."""
    folds = stats.select(F.col(fold).alias("for_fold")).distinct()
    each = stats.select(fold, *by, *keys, value.alias("__v")).filter(F.col("__v").isNotNull())
    prior = each.join(folds, F.col(fold) < F.col("for_fold")).groupBy("for_fold", *by, *keys).agg(F.round(F.avg("__v"), digits).alias("prior"))
    w = Window.partitionBy("for_fold", *by).orderBy(F.desc("prior"), *keys)
    return prior.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def capped_manifest(df: DataFrame, source: str, axis: str, value: str, *, per_source: int, per_axis: int, tie: Sequence[str]) -> DataFrame:
    """Candidates by value: at most per_source of a source on an axis, then at most per_axis of an axis."""
    a = df.withColumn("__a", F.row_number().over(Window.partitionBy(axis, source).orderBy(F.desc(value), *tie))).filter(F.col("__a") <= per_source)
    return a.withColumn("place", F.row_number().over(Window.partitionBy(axis).orderBy(F.desc(value), *tie))).filter(F.col("place") <= per_axis).drop("__a")


def scope_specialist(df: DataFrame, level: Sequence[str], cell: str, *, least: int, fold: str = "fold_id", target: str = "target", name: str = "specialist") -> DataFrame:
    """The event rate of a row's score cell in earlier folds: of its own scope if that has `least` rows there, else of all scopes, else null."""
    def prior(by: Sequence[str], tag: str) -> DataFrame:
        each = df.groupBy(*by, cell, fold).agg(F.count("*").alias("__n"), F.sum(target).alias("__p"))
        # every fold of the group, also those where the cell has no row
        folds = df.select(*by, fold).distinct().join(each.select(*by, cell).distinct(), list(by)) if by else df.select(fold).distinct().crossJoin(each.select(cell).distinct())
        full = folds.join(each, [*by, cell, fold], "left")
        w = Window.partitionBy(*by, cell).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
        return full.select(*by, cell, fold, F.sum("__n").over(w).alias(f"__n{tag}"), F.sum("__p").over(w).alias(f"__p{tag}"))

    out = df.join(prior(level, "s"), [*level, cell, fold]).join(prior([], "a"), [cell, fold])
    own = F.when(F.col("__ns") >= least, F.col("__ps") / F.col("__ns"))
    return out.withColumn(name, F.coalesce(own, safe_div(F.col("__pa"), F.col("__na")))).drop("__ns", "__ps", "__na", "__pa")


def saved_function(spec: str, x: Column) -> Column:
    """A column from saved parameters (JSON): platt (a, b on the logit), isotonic (x, y knots)."""
    s = json.loads(spec)
    if s["kind"] == "platt":
        p = F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
        return 1 / (1 + F.exp(-(s["a"] * F.log(p / (1 - p)) + s["b"])))
    if s["kind"] == "isotonic":
        return interpolate(x, list(zip(s["x"], s["y"], strict=True)))
    raise ValueError(f"unknown kind {s['kind']}")


def saved_model(spec: str) -> Column:
    """Weighted mean of saved logistic scorers (JSON list of weight, intercept and coefficients by column); nulls count as 0."""
    models = json.loads(spec)
    out = F.lit(0.0)
    for m in models:
        z = F.lit(float(m["intercept"]))
        for c, b in sorted(m["coefficients"].items()):
            z = z + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(b)
        out = out + float(m["weight"]) / (1 + F.exp(-z))
    return out / sum(float(m["weight"]) for m in models)


def effect_frame(summary: DataFrame, by_fold: DataFrame, keys: Sequence[str], *, effect: str, n: str) -> DataFrame:
    """Base and per-fold maps as one frame: scope, signed effect, its standard error 1/sqrt(n-3), and inverse-variance weight (null where n <= 3)."""
    one = lambda df, fold: df.select(*keys, fold.alias("scope"), F.col(effect).alias("effect"), F.col(n).alias("n"))
    both = one(summary, F.lit("all")).unionByName(one(by_fold, F.concat(F.lit("fold "), F.col("fold_id").cast("string"))))
    return both.withColumns({"se": F.when(F.col("n") > 3, 1 / F.sqrt(F.col("n") - 3)), "weight": F.when(F.col("n") > 3, F.col("n") - 3)})


def matched_probe(base: DataFrame, plus: DataFrame, keys: Sequence[str], *, development: Column, precision: float, least_alerts: int) -> DataFrame:
    """Base and plus scores on the same rows only: each one's threshold is frozen on the development rows, then both are measured on the others."""
    rows = base.join(plus.select(*keys, F.col("score").alias("__plus")), list(keys))
    long = rows.select("*", F.explode(F.array(F.struct(F.lit("base").alias("model"), F.col("score").alias("s")), F.struct(F.lit("plus").alias("model"), F.col("__plus").alias("s")))).alias("m")).select(*keys, "target", development.alias("dev"), "m.*")
    frozen = P.safest_threshold(long.filter("dev"), ["model"], precision=precision, least_alerts=least_alerts, score="s").select("model", "threshold")
    return threshold_metrics(long.filter("not dev").join(frozen, "model"), ["model", "threshold"], F.col("threshold"), score="s")
