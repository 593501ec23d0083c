"""Per-entity transforms in time order. Every window is partitioned by entity and ordered by time; past-only ones end a row before."""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.scalar import clip, ln, ratio, safe_div, sign
from panelweave.functions.windows import complete_corr, over, rolling, rows


def change(x: Column, k: int, w: WindowSpec) -> Column:
    return x - F.lag(x, k).over(w)


def ratio_change(x: Column, k: int, w: WindowSpec) -> Column:
    """(x - x[-k]) / max(|x[-k]|, 1e-9)."""
    past = F.lag(x, k).over(w)
    return (x - past) / F.greatest(F.abs(past), F.lit(1e-9))


def rolling_z(x: Column, w: WindowSpec, size: int, *, past_only: bool, least: int | None = None, sample: bool = False, bound: float | None = None) -> Column:
    """(x - mean) / deviation of the last rows, with or without the current one; null without spread."""
    std = rolling(F.stddev_samp(x) if sample else F.stddev_pop(x), x, w, size, least, past_only)
    z = F.when(std > 1e-12, (x - rolling(F.avg(x), x, w, size, least, past_only)) / std)
    return clip(z, -bound, bound) if bound else z


def rolling_rank(x: Column, w: WindowSpec, size: int, *, past_only: bool, least: int) -> Column:
    """Past only: share of earlier values below, ties half. Otherwise: share of the last values at or below."""
    seen = F.filter(F.collect_list(x).over(rows(w, size, past_only)), lambda v: v.isNotNull())
    n = F.size(seen)
    if past_only:
        score = F.aggregate(seen, F.lit(0.0), lambda a, v: a + F.when(v < x, 1.0).when(v == x, 0.5).otherwise(0.0))
    else:
        score = F.aggregate(seen, F.lit(0.0), lambda a, v: a + F.when(v <= x, 1.0).otherwise(0.0))
    return F.when(x.isNotNull() & (n >= least), score / n)


def rolling_slope(y: Column, pos: Column, w: WindowSpec, size: int, least: int) -> Column:
    return F.when(F.count(y).over(rows(w, size)) >= least, F.regr_slope(y, pos).over(rows(w, size)))


def rolling_pair(kind: str, a: Column, b: Column, w: WindowSpec, size: int, least: int) -> Column:
    """corr, cov or beta (cov / var of b) over rows where both are there."""
    both = a.isNotNull() & b.isNotNull()
    x, y, f = F.when(both, a), F.when(both, b), rows(w, size)
    value = {"corr": lambda: complete_corr(x, y, f), "cov": lambda: F.covar_samp(x, y).over(f), "beta": lambda: safe_div(F.covar_samp(x, y).over(f), F.var_samp(y).over(f))}[kind]()
    spread = (F.stddev_pop(x).over(f) > 1e-12) & (F.stddev_pop(y).over(f) > 1e-12)
    return F.when((F.count(x).over(f) >= least) & spread, value)


def rolling_moments(x: Column, w: WindowSpec, size: int, least: int) -> tuple[Column, Column]:
    """Bias-corrected skew and excess kurtosis, from the power sums of the window."""
    f = rows(w, size)
    n = F.count(x).over(f).cast("double")
    m = F.avg(x).over(f)
    r2, r3, r4 = (F.avg(x**k).over(f) for k in (2, 3, 4))
    m2 = r2 - m**2
    m3 = r3 - 3 * m * r2 + 2 * m**3
    m4 = r4 - 4 * m * r3 + 6 * m**2 * r2 - 3 * m**4
    enough = (n >= least) & (m2 > 1e-12)
    skew = F.when(enough & (n > 2), F.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5)
    kurt = F.when(enough & (n > 3), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / m2**2 - 3 * (n - 1)))
    return skew, kurt


def compound(r: Column, w: WindowSpec, size: int) -> Column:
    """Product of 1 + r over a full window, less 1; right for any sign."""
    seen = F.collect_list(r).over(rows(w, size))
    return F.when(F.count(r).over(rows(w, size)) == size, F.aggregate(seen, F.lit(1.0), lambda a, v: a * (1 + v)) - 1)


def drawdown(x: Column, w: WindowSpec, size: int) -> Column:
    return ratio(x, F.max(x).over(rows(w, size))) - 1


def rows_since_peak(df: DataFrame, x: str, w: WindowSpec, name: str) -> DataFrame:
    """Rows since the last time the running maximum was reached."""
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"__pos": F.row_number().over(w), "__top": F.max(x).over(back)})
    out = out.withColumn(name, F.col("__pos") - F.last(F.when(F.col(x) >= F.col("__top"), F.col("__pos")), ignorenulls=True).over(back))
    return out.drop("__pos", "__top")


def rows_since_low(df: DataFrame, x: str, w: WindowSpec, size: int, name: str) -> DataFrame:
    """Rows since the (latest) least value of the window."""
    out = df.withColumn("__pos", F.row_number().over(w))
    return out.withColumn(name, F.col("__pos") - F.min_by("__pos", F.struct(F.col(x), -F.col("__pos"))).over(rows(w, size))).drop("__pos")


def signed_streak(df: DataFrame, r: str, w: WindowSpec, name: str, entity: str) -> DataFrame:
    """Length of the run of equal signs that the row is in so far, with the sign; 0 for zero, NaN and null."""
    out = df.withColumn("__s", F.coalesce(sign(F.col(r)), F.lit(0.0)).cast("int")).withColumn("__new", F.when(F.col("__s") == F.lag("__s").over(w), 0).otherwise(1))
    out = out.withColumn("__run", F.sum("__new").over(w))
    time = [c for c in df.columns if c == "date"] or df.columns[:1]
    return out.withColumn(name, F.col("__s") * F.row_number().over(over(entity, "__run", order=tuple(time)))).drop("__s", "__new", "__run")


def semivolatility(r: Column, w: WindowSpec, size: int, least: int) -> Column:
    low = F.least(r, F.lit(0.0))
    return F.when(F.count(r).over(rows(w, size)) >= least, F.sqrt(F.avg(F.when(r.isNotNull(), low * low)).over(rows(w, size))))


def expected_shortfall(r: Column, w: WindowSpec, size: int, q: float, least: int) -> Column:
    """Mean of the window's values at or below its q-quantile."""
    f = rows(w, size)
    seen, cut = F.collect_list(r).over(f), F.percentile(r, F.lit(q)).over(f)
    low = F.filter(seen, lambda v: v <= cut + 1e-12)
    return F.when(F.count(r).over(f) >= least, F.aggregate(low, F.lit(0.0), lambda a, v: a + v) / F.size(low))


def event_decay(flag: Column, time: Column, w: WindowSpec, half_life: float) -> Column:
    """exp(-ln 2 * days since the last event / half-life); 0 before the first."""
    last = F.last(F.when(flag, time), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.exp(F.lit(-log(2.0) / half_life) * F.datediff(time, last)), F.lit(0.0))


def self_state(df: DataFrame, r: str, *, entity: str = "ticker", time: str = "date", size: int = 10) -> DataFrame:
    """Past-only state of a series: lag-1 autocorrelation, z, mean after rises and falls, asymmetry, same-sign share, sums of 3 and 5."""
    w = over(entity, order=time)
    out = df.withColumns({"__p1": F.lag(r, 1).over(w), "__p2": F.lag(r, 2).over(w)})
    p1, p2 = F.col("__p1"), F.col("__p2")
    f = w.rowsBetween(1 - size, 0)
    up, down = F.when(p2 > 0, p1), F.when(p2 < 0, p1)
    out = out.withColumns({
        "autocorr": rolling_pair("corr", p1, p2, w, size, 5),
        "z": rolling_z(p1, w, size, past_only=False, least=5),
        "after_up": F.avg(up).over(f),
        "after_down": F.avg(down).over(f),
        "same_sign": F.avg(F.when(p1.isNotNull() & p2.isNotNull(), (F.signum(p1) == F.signum(p2)).cast("double"))).over(f),
        "sum3": F.sum(p1).over(w.rowsBetween(-2, 0)),
        "sum5": F.sum(p1).over(w.rowsBetween(-4, 0)),
    })
    return out.withColumn("asymmetry", F.col("after_up") - F.col("after_down")).drop("__p1", "__p2")


def autocorrelation_map(df: DataFrame, r: str, lags: Sequence[int], *, entity: str = "ticker", time: str = "date") -> DataFrame:
    """Per entity and lag: correlation with its own past, P(up after up), P(down after down), and a class by +-0.05."""
    w = over(entity, order=time)
    parts = [df.select(entity, F.col(r).alias("y"), F.lag(r, k).over(w).alias("x"), F.lit(k).alias("lag")) for k in lags]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    long = long.filter("x is not null and y is not null")
    out = long.groupBy(entity, "lag").agg(F.count("*").alias("n"), complete_corr(F.col("x"), F.col("y")).alias("corr"), F.avg(F.when(F.col("x") > 0, (F.col("y") > 0).cast("double"))).alias("up_after_up"), F.avg(F.when(F.col("x") < 0, (F.col("y") < 0).cast("double"))).alias("down_after_down"))
    return out.withColumn("kind", F.when(F.col("corr") > 0.05, "momentum").when(F.col("corr") < -0.05, "mean_reversion").otherwise("none"))


def range_volatility(df: DataFrame, o: str, h: str, l: str, c: str, *, entity: str = "ticker", time: str = "date", size: int = 5, least: int = 3) -> DataFrame:  # noqa: E741
    """Parkinson, Garman-Klass, Rogers-Satchell and Yang-Zhang volatility of the last rows, and bipower variation with its jump share."""
    w = over(entity, order=time)
    f = rows(w, size)
    log_ratio = lambda a, b: ln(ratio(a, b))
    hl, co = log_ratio(F.col(h), F.col(l)), log_ratio(F.col(c), F.col(o))
    ho, lo = log_ratio(F.col(h), F.col(o)), log_ratio(F.col(l), F.col(o))
    gap = log_ratio(F.col(o), F.lag(c).over(w))
    rs = ho * (ho - co) + lo * (lo - co)
    out = df.withColumns({"__hl": hl * hl, "__gk": 0.5 * hl * hl - (2 * log(2.0) - 1) * co * co, "__rs": rs, "__gap": gap, "__co": co, "__r": log_ratio(F.col(c), F.lag(c).over(w))})
    out = out.withColumn("__bp", F.abs(F.col("__r")) * F.abs(F.lag("__r").over(w)))
    enough = F.count("__hl").over(f) >= least
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    k = 0.34 / (1.34 + (size + 1) / (size - 1))
    yz = F.var_samp("__gap").over(f) + k * F.var_samp("__co").over(f) + (1 - k) * F.avg("__rs").over(f)
    realised, bipower = F.sum(F.col("__r") * F.col("__r")).over(f), F.lit(1.5707963267948966) * F.sum("__bp").over(f)
    return out.withColumns({
        "parkinson": F.when(enough, root(F.avg("__hl").over(f) / (4 * log(2.0)))),
        "garman_klass": F.when(enough, root(F.avg("__gk").over(f))),
        "rogers_satchell": F.when(enough, root(F.avg("__rs").over(f))),
        "yang_zhang": F.when(F.count("__gap").over(f) >= least, root(yz)),
        "jump_share": F.when((F.count("__bp").over(f) >= least) & (realised > 1e-12), F.greatest(realised - bipower, F.lit(0.0)) / realised),
    }).drop("__hl", "__gk", "__rs", "__gap", "__co", "__r", "__bp")


def microstructure(df: DataFrame, o: str, h: str, l: str, c: str, v: str, *, entity: str = "ticker", time: str = "date", size: int = 5, least: int = 3) -> DataFrame:  # noqa: E741
    """Illiquidity (|r| per value traded), spread from successive price covariance, close location, signed volume, zero-return share, turnover shock."""
    w = over(entity, order=time)
    f = rows(w, size)
    out = df.withColumns({"__r": ratio(F.col(c), F.lag(c).over(w)) - 1, "__d": F.col(c) - F.lag(c).over(w)})
    out = out.withColumn("__dl", F.lag("__d").over(w))
    cov = F.covar_samp("__d", "__dl").over(f)
    enough = F.count("__r").over(f) >= least
    return out.withColumns({
        "illiquidity": F.when(enough, F.avg(ratio(F.abs(F.col("__r")), F.col(c) * F.col(v))).over(f)),
        "roll_spread": F.when(F.count("__dl").over(f) >= least, 2 * F.sqrt(F.greatest(-cov, F.lit(0.0)))),
        "close_location": safe_div(2 * F.col(c) - F.col(h) - F.col(l), F.col(h) - F.col(l)),
        "signed_volume": F.when(enough, F.sum(sign(F.col("__r")) * F.col(v)).over(f)),
        "zero_share": F.when(enough, F.avg(F.when(F.col("__r").isNotNull(), (F.col("__r") == 0).cast("double"))).over(f)),
        "turnover_shock": safe_div(F.col(v), F.avg(v).over(rows(w, size, True))),
    }).drop("__r", "__d", "__dl")


def limit_stress(df: DataFrame, o: str, h: str, l: str, c: str, *, bar: float, entity: str = "ticker", time: str = "date", size: int = 5) -> DataFrame:  # noqa: E741
    """Close against the day's low, gap down, sell-off from the high, extreme falls of the last rows and the run of falls."""
    w = over(entity, order=time)
    f = rows(w, size)
    out = df.withColumn("__r", ratio(F.col(c), F.lag(c).over(w)) - 1)
    out = out.withColumns({
        "close_to_low": safe_div(F.col(c) - F.col(l), F.col(h) - F.col(l)),
        "gap_down": F.least(ratio(F.col(o), F.lag(c).over(w)) - 1, F.lit(0.0)),
        "selloff": ratio(F.col(c), F.col(h)) - 1,
        "extreme_falls": F.sum(F.when(F.col("__r") <= -bar, 1).otherwise(0)).over(f),
    })
    return signed_streak(out, "__r", w, "fall_run", entity).withColumn("fall_run", F.greatest(-F.col("fall_run"), F.lit(0))).drop("__r")


def tail_dependence(df: DataFrame, r: str, m: str, *, entity: str = "ticker", time: str = "date", size: int = 10, q: float = 0.3, least: int = 5) -> DataFrame:
    """Beta on falling markets, beta below the market's rolling quantile, correlation when falling, and share of joint falls."""
    w = over(entity, order=time)
    f = rows(w, size)
    out = df.withColumn("__cut", F.percentile(m, F.lit(q)).over(f))
    fall, tail = F.col(m) < 0, F.col(m) <= F.col("__cut")

    def beta(cond: Column) -> Column:
        x, y = F.when(cond & F.col(r).isNotNull(), F.col(r)), F.when(cond & F.col(r).isNotNull(), F.col(m))
        return F.when((F.count(x).over(f) >= 3) & (F.stddev_pop(y).over(f) > 1e-12), F.covar_samp(x, y).over(f) / F.var_samp(y).over(f))

    x, y = F.when(fall, F.col(r)), F.when(fall & F.col(r).isNotNull(), F.col(m))
    joint = F.when(F.col(r).isNotNull() & F.col(m).isNotNull(), (fall & (F.col(r) < 0)).cast("double"))
    return out.withColumns({"downside_beta": beta(fall), "tail_beta": beta(tail), "down_corr": rolling_pair("corr", x, y, w, size, 3), "co_fall": F.when(F.count(r).over(f) >= least, F.avg(joint).over(f))}).drop("__cut")


def event_counts(df: DataFrame, kind: str, kinds: Sequence[str], severity: str, *, sizes: Sequence[int] = (5, 20), entity: str = "ticker", time: str = "date") -> DataFrame:
    """Daily events per entity as counts per kind over the last rows, and the greatest severity of the longest window."""
    daily = df.groupBy(entity, time).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds], F.max(severity).alias("__sev"))
    w = over(entity, order=time)
    counts = {f"{k}_{s}": F.sum(k).over(rows(w, s)) for k in kinds for s in sizes}
    return daily.withColumns(counts | {"max_severity": F.max("__sev").over(rows(w, max(sizes)))}).drop("__sev", *kinds)


def sequences(df: DataFrame, values: Sequence[str], length: int, *, entity: str = "ticker", time: str = "date") -> DataFrame:
    """The last `length` rows of each entity as an array of structs, only where there are that many."""
    w = over(entity, order=time)
    return df.withColumn("window", F.collect_list(F.struct(*values)).over(rows(w, length))).filter(F.size("window") == length)
