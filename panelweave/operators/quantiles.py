"""Exact quantiles of groups of any size: a mergeable sketch brackets each wanted rank, and only what lies in the bracket is counted value by value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.operators.iterate import cut_lineage

#: Bins that a bracket with too many values is cut into.
BINS = 1024


def _join(rows: DataFrame, side: DataFrame, by: Sequence[str], most_broadcast: int) -> DataFrame:
    """rows with side, which has one row per group (nulls are groups too): sent to all tasks if it is small, else each group's rows are dealt over salts."""
    few = side.count() <= most_broadcast
    keys = [rows[b].eqNullSafe(side[f"__{b}"]) for b in by]
    if few:
        return rows.join(F.broadcast(side), keys) if keys else rows.crossJoin(F.broadcast(side))  # a side of one row
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(32)))
    spread = side.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return dealt.join(spread, [dealt[b].eqNullSafe(spread[f"__{b}"]) for b in by] + [dealt["__salt"] == spread["__at"]]).drop("__salt", "__at")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: Column | str, shares: Sequence[float], *, small: int = 200_000, accuracy: int = 1000, most: int = 100_000, most_broadcast: int = 10_000, passes: int = 6) -> DataFrame:
    """(by, n, quantiles): the number of values in each group, and an array with their quantile at each share, linear between neighbours.

    Same numbers as `percentile`, whose state holds every different value of a group in one task: it is used where the largest group has
    `small` values at most. Else the first pass keeps a sketch per
    group (approx_percentile, about `accuracy` entries, merged map-side) and brackets each rank between two of its values; the second counts what lies below
    a bracket, and the values inside it one by one. Brackets that still hold over `most` different values are cut into bins and narrowed, in up to
    `passes` passes (each a thousandth of the width), before the inside is counted by value, over all tasks. Nulls and NaNs are left out; groups without a value have no row.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*by, v.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    if (rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= small:
        return rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("__v", F.array(*map(F.lit, shares))).alias("quantiles"))
    near = 3 / accuracy
    sketch = lambda shift: F.percentile_approx("__v", F.array(*(F.lit(min(max(s + shift, 0.0), 1.0)) for s in shares)), accuracy)
    first = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"), sketch(-near).alias("low"), sketch(near).alias("high"))

    def wanted(i: int, s: float) -> Column:
        rank = F.floor(F.lit(s) * (F.col("n") - 1)).cast("long")
        few = F.col("n") < 3 * accuracy  # a sketch's error is less than a rank: nothing to bracket
        low = F.when(few | F.lit(s - near <= 0), F.col("least")).otherwise(F.get("low", F.lit(i)))
        high = F.when(few | F.lit(s + near >= 1), F.col("most")).otherwise(F.get("high", F.lit(i)))
        return F.struct(F.lit(i).alias("i"), rank.alias("rank"), low.alias("low"), high.alias("high"))

    brackets = cut_lineage(first.select(*(F.col(b).alias(f"__{b}") for b in by), "n", F.array(*(wanted(i, s) for i, s in enumerate(shares))).alias("ws")))
    names = [f"__{b}" for b in by]
    for number in range(passes):
        met = _join(rows, brackets, by, most_broadcast)
        # each value of a bracket in its bin; values below the bracket in bin -1; above it: nowhere
        width = lambda w: (w["high"] - w["low"]) / BINS
        place = lambda w: F.when(F.col("__v") < w["low"], -1).when(F.col("__v") > w["high"], BINS + 1).when((width(w) > 0) & (width(w) < float("inf")), F.least(F.floor((F.col("__v") - w["low"]) / width(w)), F.lit(BINS - 1))).otherwise(0)
        at = F.explode(F.filter(F.transform("ws", lambda w: F.struct(w["i"].alias("i"), w["rank"].alias("rank"), w["low"].alias("low"), w["high"].alias("high"), place(w).cast("int").alias("bin"))), lambda x: x["bin"] <= BINS)).alias("x")
        laid = met.select(*names, "n", "__v", at).select(*names, "n", "__v", "x.*")
        below = laid.filter("bin = -1").groupBy(*names, "i").agg(F.count("*").alias("below"))
        inside = laid.filter("bin >= 0")
        bins = inside.groupBy(*names, "n", "i", "rank", "low", "high", "bin").agg(F.count("*").alias("c"), F.approx_count_distinct("__v").alias("d"), F.min("__v").alias("bl"), F.max("__v").alias("bh"))
        bins = cut_lineage(null_safe_join(bins, below, [*names, "i"], "below"))
        w = Window.partitionBy(*names, "i")
        seen = F.sum("c").over(w.orderBy("bin")) + F.coalesce("below", F.lit(0))
        told = bins.withColumns({"upto": seen, "values": F.sum("d").over(w)})
        if number + 1 < passes and not told.filter((F.col("values") > most) & (F.col("low") < F.col("high"))).isEmpty():
            # the bins that hold the rank and the one after it are the next bracket
            hold = (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank") + 1)
            narrow = told.filter(hold).groupBy(*names, "n", "i", "rank").agg(F.min("bl").alias("low"), F.max("bh").alias("high"))
            brackets = cut_lineage(narrow.groupBy(*names, "n").agg(F.array_sort(F.collect_list(F.struct("i", "rank", "low", "high"))).alias("ws")))
            continue
        counts = inside.groupBy(*names, "n", "i", "rank", F.col("__v").alias("v")).agg(F.count("*").alias("c"))
        counts = null_safe_join(counts, below, [*names, "i"], "below")
        upto = F.sum("c").over(Window.partitionBy(*names, "i").orderBy("v")) + F.coalesce("below", F.lit(0))
        ends = counts.withColumn("upto", upto)
        k = F.col("rank")
        two = ends.groupBy(*names, "n", "i", "rank").agg(F.min(F.when(F.col("upto") > k, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > k + 1, F.col("v"))).alias("b"), F.coalesce(F.min("below"), F.lit(0)).alias("below"))
        if not two.filter((F.col("below") > k) | F.col("a").isNull() | (F.col("b").isNull() & (k + 1 < F.col("n")))).isEmpty():
            raise RuntimeError("a bracket missed its rank; use a higher accuracy")
        share = F.get(F.array(*map(F.lit, shares)), F.col("i"))
        part = share * (F.col("n") - 1) - k
        q = F.when((part <= 0) | F.col("b").isNull(), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b"))
        done = two.groupBy(*names, "n").agg(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))).alias("qs"))
        return done.select(*(F.col(f"__{b}").alias(b) for b in by), "n", F.col("qs.q").alias("quantiles"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """left with right's columns where all keys agree, nulls as equal; right has one row per key."""
    side = right.select(*(F.col(k).alias(f"r_{k}") for k in keys), *columns)
    return left.join(side, [left[k].eqNullSafe(side[f"r_{k}"]) for k in keys], "left").drop(*(f"r_{k}" for k in keys))
