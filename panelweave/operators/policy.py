"""Alert policies: selection, metrics, thresholds, budgets, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.scalar import bin_of, safe_div, wilson_lower


def daily_top(df: DataFrame, score: str, fraction: float, *, date: str = "date", tie: str = "row_id") -> DataFrame:
    """Adds alert: the top ceil(n * fraction) of each date, one at least; ties by row order."""
    w = Window.partitionBy(date).orderBy(F.desc(score), tie)
    k = F.greatest(F.ceil(F.count("*").over(Window.partitionBy(date)) * fraction), F.lit(1))
    return df.withColumn("alert", F.row_number().over(w) <= k)


def daily_budget(df: DataFrame, score: str | Column, fraction: float, cap: int, *, date: str = "date", tie: str = "row_id") -> DataFrame:
    """Adds alert: the top min(floor(n * fraction), cap) of each date, which may be none."""
    order = F.desc(score) if isinstance(score, str) else score.desc()
    w = Window.partitionBy(date).orderBy(order, tie)
    k = F.least(F.floor(F.count("*").over(Window.partitionBy(date)) * fraction + 1e-12), F.lit(cap))
    return df.withColumn("alert", F.row_number().over(w) <= k)


def with_bias(score: str, group: str, bias: dict[str, float]) -> Column:
    """The score plus its group's allocation bias."""
    from panelweave.functions.scalar import lookup

    return F.col(score) + lookup(F.col(group), bias, 0.0)


def pooled_top(df: DataFrame, score: str, fraction: float, *, tie: str = "row_id", error: float = 0.001) -> DataFrame:
    """The top ceil(n * fraction) rows of the table; null scores come last.

    Two approximate quantiles enclose the cut. Rows above are counted and taken; only those in between are laid in order, over as
    many tasks as there are shuffle partitions.
    """
    from panelweave.operators.joins import places

    rows = df.withColumn("__s", F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))))
    n = rows.count()
    if not n:
        return df
    k = max(1, -(-int(n * fraction * 1_000_000) // 1_000_000))
    low, high = rows.approxQuantile("__s", [max(0.0, 1 - fraction - 2 * error), min(1.0, 1 - fraction + 2 * error)], error)
    above = rows.filter(F.col("__s") > high)
    left = k - above.count()
    about = rows.filter(F.col("__s").between(low, high)).withColumns({"__c": F.lit(1), "__d": -F.col("__s")})
    return above.select(*df.columns).unionByName(places(about, [], ["__d", tie], ["__c"], ["__at"]).filter(F.col("__at") <= left).select(*df.columns))


def confusion(df: DataFrame, alert: Column, target: str = "target", by: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Counts, precision, recall, specificity, lift, alert rate and alert days."""
    a, y = F.coalesce(alert, F.lit(False)), F.col(target) == 1
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(a & y).alias("tp"), F.count_if(a & ~y).alias("fp"), F.count_if(~a & y).alias("fn"), F.count_if(~a & ~y).alias("tn"), F.count_distinct(F.when(a, F.col(date))).alias("alert_days"))
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    return out.withColumns({"precision": safe_div(tp, tp + fp), "recall": safe_div(tp, tp + fn), "specificity": safe_div(tn, tn + fp), "alert_rate": (tp + fp) / n}).withColumn("lift", F.col("precision") / F.when(tp + fn > 0, (tp + fn) / n))


def score_curve(df: DataFrame, by: Sequence[str], score: str = "score", target: str = "target", date: str | None = "date") -> DataFrame:
    """One row per distinct score: alerts and hits at or above it. Everything that looks for a threshold reads this curve."""
    g = df.groupBy(*by, score).agg(F.count("*").alias("__k"), F.sum(target).alias("__p"))
    w, whole = Window.partitionBy(*by).orderBy(F.desc(score)), Window.partitionBy(*by)
    return g.withColumns({"alerts": F.sum("__k").over(w), "tp": F.sum("__p").over(w), "positives": F.sum("__p").over(whole), "rows": F.sum("__k").over(whole)}).drop("__k", "__p").withColumns({"precision": F.col("tp") / F.col("alerts"), "recall": safe_div(F.col("tp"), F.col("positives"))})


def threshold_for_recall(df: DataFrame, recall: float, by: Sequence[str] = (), score: str = "score", target: str = "target") -> DataFrame:
    """The score of the ceil(P * recall)-th positive from the top; all ties come in."""
    c = score_curve(df, by, score, target)
    ok = c.filter(F.col("tp") >= F.ceil(F.col("positives") * recall))
    return ok.groupBy(*by).agg(F.max(score).alias("threshold"), F.max_by("precision", score).alias("precision"), F.max_by("alerts", score).alias("alerts"))


def safest_threshold(df: DataFrame, by: Sequence[str], *, precision: float, least_alerts: int, least_recall: float = 0.0, least_wilson: float = 0.0, score: str = "score", target: str = "target") -> DataFrame:
    """Per scope the feasible threshold of the highest recall (ties: highest score); infinite, that is no alert, where none is feasible."""
    c = score_curve(df, by, score, target)
    ok = (F.col("precision") >= precision) & (F.col("alerts") >= least_alerts) & (F.col("recall") >= least_recall) & (wilson_lower(F.col("tp"), F.col("alerts")) >= least_wilson)
    best = F.max_by(F.struct(F.col(score).alias("s"), "alerts", "tp"), F.struct(F.when(ok, F.col("recall")), F.col(score)))
    found = c.groupBy(*by).agg(F.count_if(ok).alias("feasible"), best.alias("b"), F.max("positives").alias("positives"))
    hit = F.col("feasible") > 0
    return found.select(*by, F.when(hit, F.col("b.s")).otherwise(float("inf")).alias("threshold"), F.when(hit, F.col("b.alerts")).otherwise(0).alias("alerts"), F.when(hit, F.col("b.tp")).otherwise(0).alias("tp"), "positives")


def precision_curve_best(df: DataFrame, by: Sequence[str], *, least_alerts: int, precision: float, score: str = "score", target: str = "target", tie: str = "row_id") -> DataFrame:
    """Best precision of any prefix of at least `least_alerts` rows (the shortest such), and the highest recall at the wanted precision."""
    w, whole = Window.partitionBy(*by).orderBy(F.desc(score), tie), Window.partitionBy(*by)
    c = df.withColumns({"__k": F.row_number().over(w), "__tp": F.sum(target).over(w), "__p": F.sum(target).over(whole)})
    c = c.withColumn("__prec", F.col("__tp") / F.col("__k"))
    good = F.col("__k") >= least_alerts
    return c.groupBy(*by).agg(F.max(F.when(good, F.col("__prec"))).alias("best_precision"), F.min_by("__k", F.when(good, F.struct(-F.col("__prec"), F.col("__k")))).alias("best_alerts"), F.max(F.when(good & (F.col("__prec") >= precision), F.col("__tp") / F.col("__p"))).alias("recall_at_precision"))


def at_thresholds(df: DataFrame, grid: DataFrame, by: Sequence[str], score: str = "score", target: str = "target") -> DataFrame:
    """(group, threshold, alerts, tp, positives): counts at each threshold of a small grid, by a cumulative sum over scores and thresholds together, so no row meets every threshold."""
    c = df.groupBy(*by, F.col(score).alias("__s")).agg(F.count("*").alias("__k"), F.sum(target).alias("__p")).withColumn("__g", F.lit(0))
    keys = df.select(*by).distinct() if by else None
    g = grid.select(F.col("threshold").alias("__s")).distinct()
    g = keys.crossJoin(F.broadcast(g)) if by else g
    both = c.unionByName(g.select(*by, "__s", F.lit(0).cast("long").alias("__k"), F.lit(0).cast("long").alias("__p"), F.lit(1).alias("__g")))
    w, whole = Window.partitionBy(*by).orderBy(F.desc("__s"), "__g"), Window.partitionBy(*by)
    out = both.withColumns({"alerts": F.sum("__k").over(w), "tp": F.sum("__p").over(w), "positives": F.sum("__p").over(whole), "rows": F.sum("__k").over(whole)}).filter("__g = 1")
    return out.select(*by, F.col("__s").alias("threshold"), "alerts", "tp", "positives", "rows")


def minimax_budget(df: DataFrame, fractions: DataFrame, fold: str, *, cap: int, recall: float, lift: float, score: str = "score", target: str = "target", date: str = "date", tie: str = "row_id") -> DataFrame:
    """Per fraction of a small grid: the least recall and lift over the folds, the share of folds that pass, and the alert rate; the best first by place."""
    w = Window.partitionBy(date).orderBy(F.desc(score), tie)
    ranked = df.withColumns({"__r": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(date))})
    grid = ranked.crossJoin(F.broadcast(fractions))
    chosen = grid.withColumn("__a", F.col("__r") <= F.least(F.floor(F.col("__n") * F.col("fraction") + 1e-12), F.lit(cap)))
    f = chosen.groupBy("fraction", fold).agg(F.count("*").alias("n"), F.count_if("__a").alias("alerts"), F.count_if(F.col("__a") & (F.col(target) == 1)).alias("tp"), F.sum(target).alias("p"))
    f = f.withColumns({"recall": safe_div(F.col("tp"), F.col("p")), "lift": safe_div(F.col("tp") * F.col("n"), F.col("alerts") * F.col("p"))})
    ok = (F.coalesce(F.col("recall"), F.lit(0.0)) >= recall) & (F.coalesce(F.col("lift"), F.lit(0.0)) >= lift)
    out = f.groupBy("fraction").agg(F.avg(ok.cast("double")).alias("pass_rate"), F.min(F.coalesce("recall", F.lit(0.0))).alias("least_recall"), F.min(F.coalesce("lift", F.lit(0.0))).alias("least_lift"), (F.sum("alerts") / F.sum("n")).alias("alert_rate"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("pass_rate"), F.desc("least_recall"), F.desc("least_lift"), "alert_rate", "fraction")))


def cascade(df: DataFrame, features: Sequence[str], grids: dict[str, Sequence[float]], target: str = "target", *, precision: float, least_alerts: int) -> DataFrame:
    """All conjunctions of one threshold per feature: rows are first counted by grid cell, so rules are combined with cells and not with rows."""
    cells = df.withColumns({f"__{f}": bin_of(F.col(f), list(grids[f])) for f in features})
    cells = cells.groupBy(*[f"__{f}" for f in features]).agg(F.count("*").alias("k"), F.sum(target).alias("p"))
    rules = cells.select(F.lit(1).alias("one")).limit(1)
    for f in features:
        rules = rules.withColumn(f"c_{f}", F.explode(F.sequence(F.lit(0), F.lit(len(grids[f])))))
    cond = F.lit(True)
    for f in features:
        cond = cond & (F.col(f"__{f}") >= F.col(f"c_{f}"))
    out = cells.join(F.broadcast(rules.drop("one")), cond).groupBy(*[f"c_{f}" for f in features]).agg(F.sum("k").alias("alerts"), F.sum("p").alias("tp"))
    return out.withColumn("precision", F.col("tp") / F.col("alerts")).filter((F.col("precision") >= precision) & (F.col("alerts") >= least_alerts))


def grouping_metrics(df: DataFrame, scopes: Sequence[str], alert: Column, target: str = "target") -> DataFrame:
    """The same counts over everything and over each level of each scope, in one pass."""
    x = df.withColumn("__a", alert.cast("int"))
    sets = [[], *[[s] for s in scopes]]
    out = x.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in scopes]).agg(F.count("*").alias("n"), F.sum("__a").alias("alerts"), F.sum(F.col("__a") * F.col(target)).alias("tp"), F.sum(target).alias("positives"))
    return out.withColumns({"precision": safe_div(F.col("tp"), F.col("alerts")), "recall": safe_div(F.col("tp"), F.col("positives"))})


def alert_status(missing: Column, regime: Column, seen: Column, score: Column, *, most_missing: float = 0.5, least_history: int = 5) -> Column:
    """POOR_COVERAGE, NO_REGIME, SHORT_HISTORY, NO_SCORE or SCORED: the first that applies."""
    return F.when(missing > most_missing, "POOR_COVERAGE").when(regime.isNull(), "NO_REGIME").when(seen < least_history, "SHORT_HISTORY").when(score.isNull(), "NO_SCORE").otherwise("SCORED")


def beta_lower_bound(df: DataFrame, successes: str, failures: str, *, confidence: float = 0.95, name: str = "beta_low") -> DataFrame:
    """Lower quantile of Beta(1 + successes, 1 + failures), by bisection on the incomplete beta's continued fraction, in Arrow batches."""
    import pandas as pd

    def low(batches):
        from math import exp, lgamma, log

        def cdf(a: float, b: float, x: float) -> float:
            if x > (a + 1) / (a + b + 2):
                return 1 - cdf(b, a, 1 - x)
            front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(max(x, 1e-300)) + b * log(max(1 - x, 1e-300))) / a
            c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-30)
            total = d
            for m in range(1, 300):
                for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                    d = 1 / ((1 + num * d) or 1e-30)
                    c = (1 + num / c) or 1e-30
                    total *= c * d
                if abs(c * d - 1) < 1e-12:
                    break
            return front * total

        def quantile(k: float, n: float) -> float:
            lo, hi = 0.0, 1.0
            for _ in range(50):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if cdf(1 + k, 1 + n, mid) < 1 - confidence else (lo, mid)
            return (lo + hi) / 2

        for pdf in batches:
            yield pdf.assign(**{name: [quantile(a, b) for a, b in zip(pdf[successes], pdf[failures], strict=True)]}) if len(pdf) else pd.DataFrame(columns=[*pdf.columns, name])

    return df.mapInPandas(low, f"{', '.join(f'`{c}` {k}' for c, k in df.dtypes)}, {name} double")
