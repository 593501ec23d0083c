"""Transforms across entities on a date, and date-level aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.windows import leave_one_out_mean, over, pct_rank, rows, zscore
from panelweave.operators.iterate import if_small


def global_pct_rank(df: DataFrame, value: str, name: str, *, parts: int = 64) -> DataFrame:
    """Percentile rank over the whole table (ties at their average) without a single sorted partition.

    Rows are first counted by value; the counts are cut into ranges of about equal size, numbered inside each range, and offset
    by the ranges before it. The ranges are checkpointed, so that a task that runs again sees the same ones.
    """
    from panelweave.operators.iterate import cut_lineage

    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    ranged = cut_lineage(counts.repartitionByRange(parts, value).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum("__n").alias("__size"), F.min(value).alias("__from"))
    before = sums.withColumns({"__before": F.sum("__size").over(Window.orderBy("__from")) - F.col("__size"), "__total": F.sum("__size").over(Window.partitionBy())}).select("__part", "__before", "__total")
    inside = F.sum("__n").over(Window.partitionBy("__part").orderBy(value)) - F.col("__n")
    ranks = ranged.withColumn("__in", inside).join(F.broadcast(before), "__part").select(value, ((F.col("__before") + F.col("__in") + 1 + (F.col("__n") - 1) / 2.0) / F.col("__total")).alias(name))
    return df.join(ranks, value, "left")


def robust_z(df: DataFrame, value: str, by: Sequence[str], name: str, bound: float = 8.0) -> DataFrame:
    """(x - median) / (1.4826 * MAD) in the group; the standard deviation stands in for a MAD of zero."""
    w = Window.partitionBy(*by)
    out = df.withColumn("__med", F.percentile(value, F.lit(0.5)).over(w))
    out = out.withColumn("__mad", 1.4826 * F.percentile(F.abs(F.col(value) - F.col("__med")), F.lit(0.5)).over(w))
    scale = F.when(F.col("__mad") > 1e-12, F.col("__mad")).otherwise(F.stddev_pop(value).over(w))
    return out.withColumn(name, F.when(scale > 1e-12, F.greatest(F.least((F.col(value) - F.col("__med")) / scale, F.lit(bound)), F.lit(-bound)))).drop("__med", "__mad")


def median_delta(value: Column, *by: str) -> Column:
    return value - F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*by))


def demean(value: Column, *by: str) -> Column:
    return value - F.avg(value).over(Window.partitionBy(*by))


def peer_mean(value: Column, date: str, group: str) -> Column:
    """Leave-one-out mean of the date's group, or of the date where the group has no other member."""
    return F.coalesce(leave_one_out_mean(value, date, group), leave_one_out_mean(value, date))


def peer_block(df: DataFrame, r: str, *, date: str = "date", group: str = "bucket", entity: str = "ticker", fall: float = 0.03) -> DataFrame:
    """Return against peers, share of peers that fell, their dispersion, and peers' return one and three rows before."""
    out = df.withColumns({
        "peer": leave_one_out_mean(F.col(r), date, group),
        "peers_down": leave_one_out_mean(F.when(F.col(r).isNotNull(), (F.col(r) <= -fall).cast("double")), date, group),
        "dispersion": F.stddev_samp(r).over(Window.partitionBy(date, group)),
    })
    w = over(entity, order=date)
    return out.withColumns({"relative": F.col(r) - F.col("peer"), "peer_lag1": F.lag("peer", 1).over(w), "peer_lag3": F.lag("peer", 3).over(w)})


def cluster_innovation(long: DataFrame, clusters: DataFrame, *, row: str = "row_id", date: str = "date") -> DataFrame:
    """Long features (row, date, feature, value): own date rank less the median date rank of the other features of its cluster."""
    ranked = long.withColumn("rank", pct_rank(F.col("value"), date, "feature")).join(if_small(clusters), "feature")
    pairs = ranked.select(row, "feature", "rank", "cluster").join(ranked.select(row, F.col("feature").alias("peer"), F.col("rank").alias("peer_rank"), "cluster"), [row, "cluster"]).filter("feature <> peer")
    return pairs.groupBy(row, "feature").agg((F.first("rank") - F.percentile("peer_rank", F.lit(0.5))).alias("innovation"))


def weighted_peer_innovation(long: DataFrame, edges: DataFrame, *, row: str = "row_id", date: str = "date") -> DataFrame:
    """Own date rank less the weighted mean date rank of the features that edges (feature, peer, weight) name."""
    ranked = long.withColumn("rank", pct_rank(F.col("value"), date, "feature")).select(row, "feature", "rank")
    peers = ranked.select(row, F.col("feature").alias("peer"), F.col("rank").alias("peer_rank")).join(if_small(edges), "peer")
    mean = peers.groupBy(row, "feature").agg((F.sum(F.col("weight") * F.col("peer_rank")) / F.sum("weight")).alias("mean"))
    return ranked.join(mean, [row, "feature"]).select(row, "feature", (F.col("rank") - F.col("mean")).alias("innovation"))


def horizon_spreads(df: DataFrame, pairs: Sequence[tuple[str, str]], date: str = "date") -> DataFrame:
    """Short-horizon date rank less long-horizon date rank, a column for each pair of features of one stem."""
    return df.withColumns({f"{a}__{b}": pct_rank(F.col(a), date) - pct_rank(F.col(b), date) for a, b in pairs})


def pair_transforms(df: DataFrame, a: str, b: str, date: str = "date") -> DataFrame:
    """Difference, product, least, greatest and absolute difference of two features' date ranks."""
    out = df.withColumns({"ra": pct_rank(F.col(a), date), "rb": pct_rank(F.col(b), date)})
    ra, rb = F.col("ra"), F.col("rb")
    return out.withColumns({"difference": ra - rb, "product": ra * rb, "low": F.least(ra, rb), "high": F.greatest(ra, rb), "disagreement": F.abs(ra - rb)})


def relative_features(df: DataFrame, value: str, scopes: Sequence[str], date: str = "date") -> DataFrame:
    """A feature as date rank and date z, and as rank and median distance within each scope of the date."""
    out = {"date_rank": pct_rank(F.col(value), date), "date_z": zscore(F.col(value), date)}
    for s in scopes:
        out |= {f"{s}_rank": pct_rank(F.col(value), date, s), f"{s}_delta": median_delta(F.col(value), date, s)}
    return df.withColumns(out)


def one_hot_top(df: DataFrame, column: str, n: int, other: str = "__OTHER__") -> DataFrame:
    """(level, rank) of the n most frequent levels joined on: the column with rarer levels as `other`."""
    top = df.groupBy(column).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), column).limit(n).select(column, F.col(column).alias("level"))
    return df.join(if_small(top), column, "left").withColumn("level", F.coalesce("level", F.lit(other)))


def breadth(df: DataFrame, r: str, size: str, *, date: str = "date", crash: float = 0.5, top: int = 10) -> DataFrame:
    """Per date: share up, down and crashed, deviation, quartile range, median size, and the share of size in the `top` largest."""
    rank = F.row_number().over(Window.partitionBy(date).orderBy(F.desc(size), "ticker"))
    x = df.withColumn("__r", rank)
    share = lambda c: F.avg(F.when(F.col(r).isNotNull(), c.cast("double")))
    return x.groupBy(date).agg(
        share(F.col(r) > 0).alias("advance"), share(F.col(r) < 0).alias("decline"), share(F.col(r) <= -crash).alias("crash"), F.stddev_samp(r).alias("std"),
        (F.percentile(r, F.lit(0.75)) - F.percentile(r, F.lit(0.25))).alias("iqr"), F.percentile(size, F.lit(0.5)).alias("median_size"),
        (F.sum(F.when(F.col("__r") <= top, F.col(size))) / F.sum(size)).alias("top_share"),
    )


def regime_calendar(daily: DataFrame, r: str, *, date: str = "date", short: int = 3, long: int = 5, vol: int = 5, least_history: int = 10) -> DataFrame:
    """One row per date in, with compound returns, volatility rank among past ones, drawdown, and a state.

    CRASH_STRESS by a deep drawdown with a falling short return, REBOUND by one with a rising, else the sign of the long return
    (BULL, BEAR, SIDEWAYS) with HIGH_VOL or LOW_VOL.
    """
    from panelweave.operators.rolling import compound, rolling_rank

    w = Window.orderBy(date)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumns({"ret_short": compound(F.col(r), w, short), "ret_long": compound(F.col(r), w, long), "vol": F.when(F.count(r).over(rows(w, vol)) == vol, F.stddev_pop(r).over(rows(w, vol)))})
    level = F.aggregate(F.collect_list(r).over(back), F.lit(1.0), lambda a, v: a * (1 + v))
    out = out.withColumns({"level": level, "seen": F.count(r).over(back), "vol_rank": rolling_rank(F.col("vol"), w, 252, past_only=False, least=3)})
    out = out.withColumn("drawdown", F.col("level") / F.max("level").over(back) - 1)
    high = F.when(F.col("vol_rank") >= 0.7, "HIGH_VOL").otherwise("LOW_VOL")
    state = F.when((F.col("drawdown") <= -0.2) & (F.col("ret_short") < 0), "CRASH_STRESS").when((F.col("drawdown") <= -0.2) & (F.col("ret_short") > 0.05), "REBOUND")
    trend = F.when(F.col("ret_long") > 0.02, "BULL").when(F.col("ret_long") < -0.02, "BEAR").otherwise("SIDEWAYS")
    return out.withColumns({"state": F.when(F.col("ret_long").isNotNull(), F.coalesce(state, F.concat_ws("_", trend, high))), "history_sufficient": F.col("seen") >= least_history})
