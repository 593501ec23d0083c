"""Filters, checks on keys and names, availability, and deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Name parts that give a column away as made from the future, and those of feature families.
FUTURE_PARTS = ("label", "target", "future", "forward", "first_hit", "best_forward")
MAGNITUDE_PARTS = ("vol", "range", "abs", "std", "turnover", "shock")
DIRECTION_PARTS = ("ret", "slope", "flow", "momentum", "gap", "trend")


def valid_rows(df: DataFrame, label: str, valid: str) -> DataFrame:
    return df.filter(F.col(valid) & F.col(label).isin(0, 1))


def require_none(df: DataFrame, flag: Column, what: str) -> DataFrame:
    """df, unless a row has the flag: then the job that reads it fails with `what`. The check costs no extra pass."""
    return df.filter(F.coalesce(F.when(flag, F.raise_error(F.lit(what)).cast("boolean")), F.lit(True)))


def leakage_reason(name: Column) -> Column:
    """Why a column may not be a feature, or null. Names of past leads and lags stay allowed."""
    low = F.lower(name)
    past = low.rlike("(^|_)(lag|past|hist)(_|$)")
    out = F.lit(None).cast("string")
    for part in reversed(FUTURE_PARTS):
        out = F.when(low.contains(part), F.lit(f"contains {part}")).otherwise(out)
    return F.when(past, None).otherwise(out)


def feature_family(name: Column) -> Column:
    """magnitude, direction, mixed, metadata or unknown by the parts of a name; a skew counts as direction."""
    low = F.lower(name)
    m, d = low.rlike("|".join(MAGNITUDE_PARTS)), low.rlike("|".join(DIRECTION_PARTS) + "|skew")
    return F.when(low.rlike("(^|_)(id|key|name|date)$"), "metadata").when(m & d, "mixed").when(m, "magnitude").when(d, "direction").otherwise("unknown")


def key_contract(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, keys with several rows, and rows with a null in the key."""
    null_key = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0))
    per_key = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.max(null_key).alias("__null"))
    return per_key.agg(F.sum("__n").alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("__n") > 1).alias("repeated_keys"), F.sum(F.col("__n") * F.col("__null")).alias("null_rows"))


def join_contract(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys only on the left, only on the right, and on both."""
    sides = left.select(*keys).distinct().withColumn("__l", F.lit(1)).join(right.select(*keys).distinct().withColumn("__r", F.lit(1)), list(keys), "full")
    return sides.agg(F.count_if(F.col("__r").isNull()).alias("left_only"), F.count_if(F.col("__l").isNull()).alias("right_only"), F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("both"))


def family_available(columns: Sequence[str]) -> Column:
    """1 if any column of a family is there."""
    return F.greatest(*[F.col(c).isNotNull().cast("int") for c in columns], F.lit(0))


def mask_scope(df: DataFrame, columns: Sequence[str], scope: Column) -> DataFrame:
    """The columns as null where the scope holds."""
    return df.withColumns({c: F.when(scope, None).otherwise(F.col(c)) for c in columns})


def whole_group_sample(df: DataFrame, group: str, order: Column, most: int) -> DataFrame:
    """Whole groups (dates) in the given pseudo-random order until `most` rows are reached; the first group always."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    run = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy(order, F.col(group))) - F.col("__n"))
    return df.join(run.filter((F.col("__before") + F.col("__n") <= most) | (F.col("__before") == 0)).select(group), group, "left_semi")


def spread_sample(df: DataFrame, k: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """About k rows per group, evenly spread in order: those where floor(place * k / size) rises."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(*by))
    place = F.row_number().over(w) - 1
    return df.withColumns({"__p": place, "__n": n}).filter((F.col("__p") == 0) | (F.floor(F.col("__p") * k / F.col("__n")) > F.floor((F.col("__p") - 1) * k / F.col("__n")))).drop("__p", "__n")


def common_start(df: DataFrame, columns: Sequence[str], *, time: str = "date", bar: float = 0.8, smooth: int = 10, sustain: int = 10, share: float = 0.9) -> DataFrame:
    """The first date whose smoothed daily coverage, and 90 percent of that of the following rows, reach the bar. Works on one row per date."""
    there = [F.avg(F.col(c).isNotNull().cast("double")) for c in columns]
    daily = df.groupBy(time).agg((sum(there[1:], there[0]) / len(there)).alias("coverage"))
    w = Window.orderBy(time)
    daily = daily.withColumn("smooth", F.percentile("coverage", F.lit(0.5)).over(w.rowsBetween(1 - smooth, 0)))
    ok = (F.col("smooth") >= bar).cast("double")
    daily = daily.withColumn("held", F.avg(ok).over(w.rowsBetween(0, sustain - 1)))
    return daily.filter((F.col("smooth") >= bar) & (F.col("held") >= share)).agg(F.min(time).alias("start"))
