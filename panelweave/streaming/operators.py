"""Streams of scores, labels and events: delayed labels, windows, sessions, keep-latest, stateful rolling values, threshold control."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def delayed_label_join(scores: DataFrame, labels: DataFrame, *, key: str, ts: str = "ts", label_ts: str = "label_ts", delay: str = "3 days", late: str = "1 day") -> DataFrame:
    """Scores with the labels that become known within `delay` after them; a score whose label never comes is emitted without one when the watermark has passed."""
    s = scores.withWatermark(ts, late)
    l = labels.withColumnRenamed(key, "__k").withWatermark(label_ts, late)  # noqa: E741
    on = (F.col(key) == F.col("__k")) & (F.col(label_ts) >= F.col(ts)) & (F.col(label_ts) <= F.col(ts) + F.expr(f"interval {delay}"))
    return s.join(l, on, "leftOuter").drop("__k")


def windowed_breadth(events: DataFrame, *, ts: str = "ts", length: str = "1 day", slide: str | None = None, late: str = "1 hour", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Rows, mean and share above zero of each time window (tumbling or sliding)."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    g = events.withWatermark(ts, late).groupBy(w.alias("w"), *by)
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("advance")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "mean", "advance")


def episode_sessions(events: DataFrame, flag: Column, *, key: str, ts: str = "ts", gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Runs of flagged events of a key, closed by a gap."""
    g = events.filter(flag).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return g.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, keys: Sequence[str], *, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def upsert_batch(path: str, keys: Sequence[str], order: str):
    """For foreachBatch: merge a batch into the table at `path`, the last row of each key kept. A batch that is repeated leaves the same table.

    Versions are written side by side, and the newest complete one is read, so a reader never sees half a table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        both = batch
        if batch_id > 0:
            both = spark.read.parquet(f"{path}/version={batch_id - 1}").unionByName(batch, allowMissingColumns=True)
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return merge


def rolling_state(events: DataFrame, *, key: str, ts: str, value: str, size: int, late: str = "1 day", idle_days: float = 365.0) -> DataFrame:
    """Past-only z and signed streak per key, from a ring of the last values kept as state: (key, ts, value, z, streak).

    A key's rows of a micro-batch come in several parts, cut anywhere: they are put in one order, by time and then value. A null
    value has no z and no streak, ends a run and takes a place in the ring that counts for nothing.
    A key's state goes once the watermark (the newest time less `late`) is idle_days past its last row: state holds the keys of that
    time, not all that ever came. A key that comes back later begins anew. Rows behind the watermark are left out.
    """
    import numpy as np
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names, at_once = [key, ts, value, "z", "streak"], 20_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({n: [] for n in names})
            return
        ring, streak, last = state.get if state.exists else ([], 0, 0)
        rows = pd.concat([pdf[[ts, value]] for pdf in batches]).sort_values([ts, value], ignore_index=True)
        ring = np.array([np.nan if x is None else x for x in ring], float)
        for i in range(0, len(rows), at_once):
            some = rows.iloc[i : i + at_once]
            x = some[value].to_numpy(float)
            held = np.r_[np.full(size - len(ring), np.nan), ring, x]
            past = np.lib.stride_tricks.sliding_window_view(held, size)[:-1]
            known = ~np.isnan(past)
            n = known.sum(1)
            mean = np.where(known, past, 0).sum(1) / np.maximum(n, 1)
            std = np.sqrt(np.where(known, (past - mean[:, None]) ** 2, 0).sum(1) / np.maximum(n, 1))
            fine = (n >= max(2, size // 3)) & (std > 1e-12)
            z = np.where(fine, (x - mean) / np.where(fine, std, 1), np.nan)
            sign, place = np.sign(x), np.arange(len(x))
            first = np.r_[True, ~(sign[1:] == sign[:-1])]
            run = place - np.maximum.accumulate(np.where(first, place, 0)) + 1 + np.where(np.cumsum(first) == 1, abs(streak) * (sign[0] == np.sign(streak)), 0)
            whole = pd.array(np.where(np.isnan(x), 0, sign * run).astype(np.int64), dtype="Int64")
            streak = int(whole[-1])
            whole[np.isnan(x)] = pd.NA
            yield pd.DataFrame({key: k[0], ts: some[ts], value: some[value], "z": z, "streak": whole})
            ring = held[len(held) - size :]
        state.update((ring.tolist(), streak, last := max(last, int(rows[ts].iloc[-1].timestamp() * 1000))))
        state.setTimeoutTimestamp(max(last + int(idle_days * 86_400_000), state.getCurrentWatermarkMs() + 1))

    kinds = dict(events.dtypes)
    out = f"{key} {kinds[key]}, {ts} {kinds[ts]}, {value} {kinds[value]}, z double, streak long"
    kept = events.select(key, ts, value).withWatermark(ts, late)
    return kept.groupBy(key).applyInPandasWithState(step, out, "ring array<double>, streak long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def safe_step(curve_path: str, base: float, *, precision: float, least_alerts: int):
    """For foreachBatch over matured rows (score, target): after each batch, the lowest threshold whose precision holds over all matured rows.

    It never falls below `base`; without a feasible one it is infinite, that is abstain. Counts per score are kept as a small table of
    versions; one row per batch is added to the policies.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = batch.groupBy(F.round("score", 4).alias("score")).agg(F.count("*").alias("k"), F.sum("target").alias("p"))
        if batch_id > 0:
            counts = spark.read.parquet(f"{curve_path}/counts/version={batch_id - 1}").unionByName(counts).groupBy("score").agg(F.sum("k").alias("k"), F.sum("p").alias("p"))
        counts.write.mode("overwrite").parquet(f"{curve_path}/counts/version={batch_id}")
        w = Window.orderBy(F.desc("score"))
        c = spark.read.parquet(f"{curve_path}/counts/version={batch_id}").withColumns({"alerts": F.sum("k").over(w), "tp": F.sum("p").over(w)})
        ok = (F.col("tp") / F.col("alerts") >= precision) & (F.col("alerts") >= least_alerts)
        found = c.agg(F.min(F.when(ok, F.col("score"))).alias("t"))
        policy = found.select(F.lit(batch_id).alias("batch"), F.when(F.col("t").isNull(), float("inf")).otherwise(F.greatest("t", F.lit(base))).alias("threshold"))
        policy.write.mode("overwrite").parquet(f"{curve_path}/policy/batch={batch_id}")

    return update
