"""Calibration metrics, folds, weights, ensembles and ablation tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.scalar import clip, logit, sigmoid
from panelweave.functions.windows import pct_rank


def calibration_error(df: DataFrame, p: str, target: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error over bins of equal width, the last one closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    g = df.withColumn("__b", b).groupBy(*by, "__b").agg(F.count("*").alias("k"), F.avg(p).alias("mp"), F.avg(target).alias("my"))
    return g.groupBy(*by).agg((F.sum(F.col("k") * F.abs(F.col("mp") - F.col("my"))) / F.sum("k")).alias("ece"))


def probability_metrics(df: DataFrame, p: str, target: str, by: Sequence[str] = (), eps: float = 1e-7) -> DataFrame:
    q, y = clip(F.col(p), eps, 1 - eps), F.col(target)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(p) - y) ** 2).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"))


def walk_forward_folds(dates: DataFrame, *, folds: int, validation: int, purge: int, least_train: int, time: str = "date") -> DataFrame:
    """(fold_id, train_start, train_end, validation_start, validation_end): validation blocks at the calendar's end, `purge` dates before each left out. One row per date goes in."""
    pos = dates.select(time).distinct().withColumn("pos", F.row_number().over(Window.orderBy(time)))
    n = pos.agg(F.max("pos").alias("n"), F.min(time).alias("first"))
    f = n.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    f = f.withColumn("vs", F.col("n") - (folds - F.col("fold_id")) * validation + 1)
    f = f.withColumns({"ve": F.col("vs") + validation - 1, "te": F.col("vs") - purge - 1}).filter(F.col("te") >= least_train)
    for name, c in (("train_end", "te"), ("validation_start", "vs"), ("validation_end", "ve")):
        f = f.join(F.broadcast(pos.select(F.col("pos").alias(c), F.col(time).alias(name))), c)
    return f.select("fold_id", F.col("first").alias("train_start"), "train_end", "validation_start", "validation_end")


def fold_role(fold: Column, roles: dict[str, Sequence[int]], default: str = "other") -> Column:
    out = F.lit(default)
    for name, ids in roles.items():
        out = F.when(fold.isin(*ids), name).otherwise(out)
    return out


def sample_weights(df: DataFrame, target: str, *, time: str = "date", entity: str = "ticker", half_life: float = 10.0) -> DataFrame:
    """weight: class balance times decay from the last date times the root of the entity's rarity, scaled to mean 1."""
    whole = df.agg(F.max(time).alias("__last"), F.avg(target).alias("__rate"), F.count("*").alias("__n"), F.count_distinct(entity).alias("__e"))
    per = df.groupBy(entity).agg(F.count("*").alias("__k"))
    x = df.join(F.broadcast(whole)).join(per, entity)
    balance = F.when(F.col(target) == 1, 0.5 / F.col("__rate")).otherwise(0.5 / (1 - F.col("__rate")))
    decay = F.pow(F.lit(0.5), F.datediff("__last", time) / half_life)
    x = x.withColumn("__w", balance * decay * F.sqrt(F.col("__n") / F.col("__e") / F.col("__k")))
    mean = x.agg(F.avg("__w").alias("__mean"))
    return x.join(F.broadcast(mean)).withColumn("weight", F.col("__w") / F.col("__mean")).drop("__last", "__rate", "__n", "__e", "__k", "__w", "__mean")


def rank_preserving(df: DataFrame, raw: str, calibrated: str, eps: float = 1e-8, by: Sequence[str] = ("date",), tie: str = "row_id") -> DataFrame:
    """The calibrated score made rising in the raw score's order: running maximum plus a small ramp."""
    w = Window.partitionBy(*by).orderBy(raw, tie)
    return df.withColumn("tie_broken", F.max(calibrated).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.row_number().over(w) * eps)


def historical_rank(df: DataFrame, score: str, fold: str, *by: str, name: str = "historical_rank") -> DataFrame:
    """Share of scores of smaller folds (of the group) at or below the row's; null for the first fold.

    Scores are reduced to counts per fold and value; the past of each fold is then a join of those counts with the folds after
    them, and a cumulative count.
    """
    counts = df.groupBy(*by, fold, score).agg(F.count("*").alias("__k"))
    folds = df.select(fold).distinct().select(F.col(fold).alias("__at"))
    past = counts.join(F.broadcast(folds), F.col(fold) < F.col("__at")).groupBy(*by, "__at", score).agg(F.sum("__k").alias("__k"))
    now = counts.select(*by, F.col(fold).alias("__at"), score, F.lit(0).cast("long").alias("__k"))
    both = past.unionByName(now).groupBy(*by, "__at", score).agg(F.sum("__k").alias("__k"))
    w = Window.partitionBy(*by, "__at")
    both = both.withColumn(name, F.sum("__k").over(w.orderBy(score)) / F.when(F.sum("__k").over(w) > 0, F.sum("__k").over(w)))
    return df.join(both.select(*by, F.col("__at").alias(fold), score, name), [*by, fold, score], "left")


def blend(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted sum; a missing part gives its weight to the others."""
    top = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, w in parts])
    total = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in parts])
    return F.when(total > 0, top / total)


def rank_then_average(long: DataFrame, row: str, model: str, score: str, date: str = "date") -> DataFrame:
    """Mean and deviation, over models or seeds, of each row's date rank, and the mean score."""
    r = long.withColumn("__rank", pct_rank(F.col(score), model, date))
    return r.groupBy(row, date).agg(F.avg("__rank").alias("rank_mean"), F.coalesce(F.stddev_pop("__rank"), F.lit(0.0)).alias("rank_std"), F.avg(score).alias("score_mean"), F.count("*").alias("models"))


def simplex_candidates(df: DataFrame, dimension: int, draws: int, seed: int) -> DataFrame:
    """(candidate, w1..wd): vertices, edge midpoints and hashed Dirichlet(1) draws."""
    fixed = [[1.0 if i == j else 0.0 for j in range(dimension)] for i in range(dimension)] + [[0.5 if k in (i, j) else 0.0 for k in range(dimension)] for i in range(dimension) for j in range(i + 1, dimension)]
    spark = df.sparkSession
    base = spark.createDataFrame([(i, *w) for i, w in enumerate(fixed)], "candidate int, " + ", ".join(f"w{k} double" for k in range(1, dimension + 1)))
    ids = spark.range(draws).withColumn("candidate", (F.col("id") + len(fixed)).cast("int"))
    exps = [-F.log((F.pmod(F.xxhash64(F.lit(seed), "candidate", F.lit(k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)) for k in range(dimension)]
    total = reduce(lambda a, b: a + b, exps)
    return base.unionByName(ids.select("candidate", *[(e / total).alias(f"w{k}") for k, e in enumerate(exps, 1)]))


def logit_blend(base: Column, gate: Column, alpha: float) -> Column:
    return sigmoid((1 - alpha) * logit(base) + alpha * logit(gate))


def meta_features(cols: Sequence[str], bar: float = 0.5) -> dict[str, Column]:
    """Row statistics of several signals: mean, deviation, least, greatest, median, and the share above a bar. Array functions only, no shuffle."""
    a = F.array(*[F.col(c) for c in cols])
    s = F.array_sort(F.filter(a, lambda x: x.isNotNull()))
    n = F.size(s)
    mean = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x) / n
    middle = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.ceil((n + 1) / 2).cast("int"))) / 2
    return {"mean": mean, "std": F.sqrt(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n), "low": F.array_min(s), "high": F.array_max(s), "median": middle, "consensus": F.size(F.filter(s, lambda x: x >= bar)) / n}


def hard_negative_weights(df: DataFrame, target: str, score: str, *by: str, factor: float = 2.5, power: int = 4) -> DataFrame:
    """Negatives weigh 1 + factor * rank ** power, positives the ratio of the classes."""
    r = pct_rank(F.col(score), *by)
    rate = F.avg(target).over(Window.partitionBy(*by))
    return df.withColumn("weight", F.when(F.col(target) == 1, (1 - rate) / F.when(rate > 0, rate)).otherwise(1 + factor * F.pow(r, F.lit(power))))


def ablation_plan(features: DataFrame, clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(condition, kind, dropped): leave-one-out, solo, cluster and pair conditions; one row per dropped feature (for solo: per feature kept)."""
    loo = features.select(F.concat(F.lit("drop:"), "feature").alias("condition"), F.lit("leave_one_out").alias("kind"), F.col("feature").alias("dropped"))
    solo = features.select(F.concat(F.lit("solo:"), "feature").alias("condition"), F.lit("solo").alias("kind"), F.col("feature").alias("dropped"))
    cluster = clusters.select(F.concat(F.lit("cluster:"), F.col("cluster").cast("string")).alias("condition"), F.lit("cluster").alias("kind"), F.col("feature").alias("dropped"))
    pair = pairs.select(F.concat_ws("", F.lit("pair:"), "a", F.lit("+"), "b").alias("condition"), F.lit("pair").alias("kind"), F.explode(F.array("a", "b")).alias("dropped"))
    return loo.unionByName(solo).unionByName(cluster).unionByName(pair)


def paired_deltas(metrics: DataFrame, keys: Sequence[str], condition: str, baseline: str, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Each condition's gain over the baseline on the same keys; positive is useful whatever the metric's sign."""
    base = metrics.filter(F.col(condition) == baseline).select(*keys, F.col(metric).alias("__base"))
    gain = (F.col(metric) - F.col("__base")) * (1 if higher_is_better else -1)
    return metrics.filter(F.col(condition) != baseline).join(base, list(keys)).withColumn("delta", gain).drop("__base")


def permutation_shuffle(df: DataFrame, columns: Sequence[str], strata: Sequence[str], row: str, seed: int) -> DataFrame:
    """The columns permuted within strata: the i-th row by id takes the values of the i-th row by hash."""
    a = df.drop(*columns).withColumn("__i", F.row_number().over(Window.partitionBy(*strata).orderBy(row)))
    b = df.select(*strata, *columns, F.row_number().over(Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), row), row)).alias("__i"))
    return a.join(b, [*strata, "__i"]).drop("__i")
