"""Window expressions over (entity, time) and (date, group): everything else in the package builds on these."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def over(*by: str, order: tuple[str, ...] | str = ()) -> WindowSpec:
    order = (order,) if isinstance(order, str) else order
    w = Window.partitionBy(*by)
    return w.orderBy(*order) if order else w


def rows(w: WindowSpec, size: int, past_only: bool = False) -> WindowSpec:
    """The last `size` rows, with the current one or only those before it."""
    return w.rowsBetween(-size, -1) if past_only else w.rowsBetween(1 - size, 0)


def default_min(size: int) -> int:
    return max(5, size // 3)


def rolling(agg: Column, value: Column, w: WindowSpec, size: int, least: int | None = None, past_only: bool = False) -> Column:
    """A window aggregate that is null unless at least `least` values are there."""
    frame = rows(w, size, past_only)
    return F.when(F.count(value).over(frame) >= (default_min(size) if least is None else least), agg.over(frame))


def pct_rank(value: Column, *by: str | Column) -> Column:
    """Share of the rank among the values that are there, ties at their average; null stays null.

    (least rank + (ties - 1) / 2) / count, which is not Spark's percent_rank.
    """
    there = value.isNotNull()
    w = Window.partitionBy(*by)
    least = F.rank().over(Window.partitionBy(*by, there).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.when(there, (least + (ties - 1) / 2.0) / F.count(value).over(w))


def complete_corr(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Pearson correlation over rows where both are there; null (not an error) where one side has no spread."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    c, sa, sb = [p.over(w) for p in parts] if w is not None else parts
    return F.when((sa > 1e-12) & (sb > 1e-12), F.try_divide(c, sa * sb))


def zscore(value: Column, *by: str) -> Column:
    """(x - mean) / sample deviation in the group; null where there is none."""
    w = Window.partitionBy(*by)
    std = F.stddev_samp(value).over(w)
    return F.when(std > 0, (value - F.avg(value).over(w)) / std)


def leave_one_out_mean(value: Column, *by: str) -> Column:
    """Mean of the group's other values; null when alone."""
    w = Window.partitionBy(*by)
    n = F.count(value).over(w) - F.when(value.isNotNull(), 1).otherwise(0)
    return F.when(n > 0, (F.sum(value).over(w) - F.coalesce(value, F.lit(0.0))) / n)


def run_id(flag: Column, w: WindowSpec) -> Column:
    """A number for each run of rows with equal flags, rising in order."""
    return F.sum(F.when(flag.eqNullSafe(F.lag(flag).over(w)), 0).otherwise(1)).over(w)
