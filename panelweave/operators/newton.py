"""Many logistic fits at once, one for each group (fold, scope): Newton steps whose sums are made by Spark, map-side first."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.operators.iterate import cut_lineage


def _margin(x: Sequence[Column], w: str = "w") -> Column:
    return reduce(lambda a, b: a + b, (F.get(w, F.lit(k)) * c for k, c in enumerate(x)))


def grouped_logistic(df: DataFrame, by: Sequence[str], features: Sequence[str], label: str, *, ridge: float = 1.0, steps: int = 25, tol: float = 1e-8, most_broadcast: int = 10_000) -> DataFrame:
    """(by, n, positives, w): for each group the weights (intercept first) that minimise the log loss plus ridge / 2 times the features' squared weights.

    One pass over the rows a step, for all groups together: a group's loss, gradient and Hessian are sums, added up within tasks before the
    shuffle, and its small system is solved where its one row of sums lies. A step that raised the loss is halved, so every fit
    converges; an error is raised if `steps` don't suffice. Rows with a null feature, label or group, and labels other than 0 and 1, are left out. A group
    of one class has finite weights, since the ridge holds the others and its intercept is held within +-20.
    """
    d = len(features) + 1
    used = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*by, *features, label])) & F.col(label).isin(0, 1)
    rows = df.filter(used).select(*by, *(F.col(f).cast("double").alias(f"__x{k}") for k, f in enumerate(features, 1)), F.col(label).cast("double").alias("__y"))
    x = [F.lit(1.0), *(F.col(f"__x{k}") for k in range(1, d))]
    p = 1 / (1 + F.exp(-_margin(x)))
    z = _margin(x)
    loss = F.greatest(z, F.lit(0.0)) - z * F.col("__y") + F.log1p(F.exp(-F.abs(z)))
    sums = [F.sum(loss).alias("loss"), *(F.sum((p - F.col("__y")) * x[k]).alias(f"g{k}") for k in range(d)), *(F.sum(p * (1 - p) * x[k] * x[m]).alias(f"h{k}_{m}") for k in range(d) for m in range(k, d))]
    state = "w array<double>, kept array<double>, best double, done boolean"
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("__y").cast("long").alias("positives"))
    start = F.array(*[F.lit(0.0)] * d)
    fits = cut_lineage(groups.withColumns({"w": start, "kept": start, "best": F.lit(float("inf")), "done": F.lit(False)}))
    small = fits.count() <= most_broadcast
    schema = T.StructType([*groups.schema, *T.StructType.fromDDL(state)])
    pull = np.r_[0.0, np.full(d - 1, ridge)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w, kept, best, done = (pdf[c].to_list() for c in ("w", "kept", "best", "done"))
            grad, hess = pdf[[f"g{k}" for k in range(d)]].to_numpy(float), np.zeros((len(pdf), d, d))
            for k in range(d):
                for m in range(k, d):
                    hess[:, k, m] = hess[:, m, k] = pdf[f"h{k}_{m}"]
            for i in range(len(pdf)):
                now = np.asarray(w[i], float)
                value = float(pdf["loss"].iloc[i]) + float(pull @ (now * now)) / 2
                if value > best[i] + 1e-10 * (1 + abs(best[i])):  # too far: half way back to the best weights so far
                    w[i] = (now + np.asarray(kept[i], float)) / 2
                    done[i] = bool(np.abs(w[i] - now).max() < tol)
                    continue
                step = np.linalg.solve(hess[i] + np.diag(pull + 1e-9), grad[i] + pull * now)
                new = now - step
                new[0] = np.clip(new[0], -20.0, 20.0)
                kept[i], best[i], w[i], done[i] = now, value, new, bool(np.abs(new - now).max() < tol)
            yield pdf[[*by, "n", "positives"]].assign(w=w, kept=kept, best=best, done=done)

    for _ in range(steps):
        # groups that are done stay as they are and cost no pass
        open_ = fits.filter("not done")
        side = open_.select(*by, "w")
        met = rows.join(F.broadcast(side) if small else side, list(by)) if by else rows.crossJoin(F.broadcast(side))  # without groups: a side of one row
        total = met.groupBy(*by).agg(*sums)
        both = open_.join(total, list(by)) if by else open_.crossJoin(total)
        fits = cut_lineage(fits.filter("done").unionByName(both.mapInPandas(solve, schema)))
        if fits.filter("not done").isEmpty():
            return fits.select(*by, "n", "positives", "w")
    raise RuntimeError(f"logistic fits still change after {steps} steps")


def score_groups(df: DataFrame, fits: DataFrame, by: Sequence[str], features: Sequence[str], name: str, *, most_broadcast: int = 10_000) -> DataFrame:
    """df with the probability by its group's weights; null where the group has no fit or a feature is null."""
    side = fits.select(*by, F.col("w").alias("__w"))
    joined = df.join(F.broadcast(side) if side.count() <= most_broadcast else side, list(by), "left")
    return joined.withColumn(name, 1 / (1 + F.exp(-_margin([F.lit(1.0), *(F.col(f).cast("double") for f in features)], "__w")))).drop("__w")


def forward_stack(df: DataFrame, features: Sequence[str], label: str, fold: str, *, scope: Sequence[str] = (), least: int = 30, least_positives: int = 5, shrink: float = 50.0, ridge: float = 1.0) -> DataFrame:
    """df with `stacked`: each fold's rows scored by a fit on all earlier folds only; null in the first fold.

    With `scope`, a scope's own fit on its earlier rows (at least `least` of them, `least_positives` of each class) is blended with the pooled one: it weighs
    n / (n + shrink). A row is used once for each later fold, so the work is rows times folds.
    """
    folds = df.select(F.col(fold).alias("__for")).distinct().filter("__for is not null")
    train = df.join(F.broadcast(folds), F.col(fold) < F.col("__for"))  # a row per fold: a fold calendar is short
    keyed = df.withColumn("__for", F.col(fold))
    pooled = score_groups(keyed, grouped_logistic(train, ["__for"], features, label, ridge=ridge), ["__for"], features, "__pooled")
    if not scope:
        return pooled.withColumnRenamed("__pooled", "stacked").drop("__for")
    ones = F.sum(F.col(label).cast("long"))
    enough = train.groupBy("__for", *scope).agg(F.count("*").alias("__n"), ones.alias("__p")).filter((F.col("__n") >= least) & (F.col("__p") >= least_positives) & (F.col("__n") - F.col("__p") >= least_positives))
    own = grouped_logistic(train.join(F.broadcast(enough.select("__for", *scope)) if enough.count() <= 10_000 else enough.select("__for", *scope), ["__for", *scope], "left_semi"), ["__for", *scope], features, label, ridge=ridge)
    both = score_groups(pooled, own, ["__for", *scope], features, "__own").join(own.select("__for", *scope, F.col("n").alias("__n")), ["__for", *scope], "left")
    share = F.col("__n") / (F.col("__n") + shrink)
    return both.withColumn("stacked", F.coalesce(share * F.col("__own") + (1 - share) * F.col("__pooled"), "__pooled")).drop("__for", "__own", "__pooled", "__n")
