"""Forward labels, path labels and runs of events (per entity, in time order)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.windows import over, run_id


def cumulative_leads(r: str, horizon: int, entity: str, time: str) -> list[Column]:
    """c_k = product of (1 + r) over the next k rows, less 1; null where any is missing."""
    w = over(entity, order=time)
    steps = [1 + F.lead(r, k).over(w) for k in range(1, horizon + 1)]
    return [reduce(lambda a, b: a * b, steps[:k]) - 1 for k in range(1, horizon + 1)]


def forward_labels(df: DataFrame, r: str, *, horizon: int = 3, threshold: float = 0.05, entity: str = "ticker", time: str = "date", slack: float = 1e-12) -> DataFrame:
    """Adds c1.., best, label, target_valid, first_hit_day: whether the compound return reaches the threshold within the horizon.

    Valid only where all returns of the horizon are there. first_hit_day is 0 without a hit.
    """
    names = [f"c{k}" for k in range(1, horizon + 1)]
    out = df.withColumns(dict(zip(names, cumulative_leads(r, horizon, entity, time), strict=True)))
    out = out.withColumn("best", F.when(F.col(names[-1]).isNotNull(), F.greatest(*names) if horizon > 1 else F.col(names[0])))
    bar = threshold - slack
    hit = F.when(F.col("best").isNull(), None)
    for k, c in enumerate(names, 1):
        hit = hit.when(F.col(c) >= bar, k)
    return out.withColumns({"label": F.when(F.col("best") >= bar, 1).when(F.col("best").isNotNull(), 0), "target_valid": F.col("best").isNotNull(), "first_hit_day": hit.otherwise(0)})


def multi_horizon_labels(df: DataFrame, r: str, *, threshold: float, entity: str = "ticker", time: str = "date") -> DataFrame:
    """surge_d1..d3 (reached within k days), crash_d3, first_hit_day, best and valid, in one pass."""
    c = cumulative_leads(r, 3, entity, time)
    out = df.withColumns({"c1": c[0], "c2": c[1], "c3": c[2]}).withColumn("valid", F.col("c3").isNotNull())
    up, ok = threshold - 1e-12, F.col("valid")
    return out.withColumns({
        "surge_d1": F.when(ok, (F.col("c1") >= up).cast("int")),
        "surge_d2": F.when(ok, (F.greatest("c1", "c2") >= up).cast("int")),
        "surge_d3": F.when(ok, (F.greatest("c1", "c2", "c3") >= up).cast("int")),
        "crash_d3": F.when(ok, (F.least("c1", "c2", "c3") <= -up).cast("int")),
    })


def move_and_direction(df: DataFrame, r: str, *, threshold: float, entity: str = "ticker", time: str = "date") -> DataFrame:
    """Excursions up and down over three days, whether the larger is a move, its direction (-1 without a move) and the margin between them."""
    c = cumulative_leads(r, 3, entity, time)
    out = df.withColumns({"up": F.greatest(*c, F.lit(0.0)), "down": F.least(*c, F.lit(0.0)), "valid": c[2].isNotNull()}).filter("valid")
    out = out.withColumn("move", (F.greatest("up", F.abs("down")) >= threshold).cast("int"))
    return out.withColumns({"direction": F.when(F.col("move") == 1, (F.col("up") >= threshold).cast("int")).otherwise(-1), "margin": F.col("up") - F.abs("down")})


def competing_risks(df: DataFrame, r: str, *, up: float, down: float, entity: str = "ticker", time: str = "date") -> DataFrame:
    """First day up and first day down (0 none), hazards h1..h3 of going up on a day not reached before, and which came first (ties go up)."""
    c = cumulative_leads(r, 3, entity, time)
    out = df.withColumns({"c1": c[0], "c2": c[1], "c3": c[2]}).filter(F.col("c3").isNotNull())

    def first(test) -> Column:
        return F.when(test(F.col("c1")), 1).when(test(F.col("c2")), 2).when(test(F.col("c3")), 3).otherwise(0)

    out = out.withColumns({"first_up": first(lambda x: x >= up - 1e-12), "first_down": first(lambda x: x <= -down + 1e-12)})
    u, d = F.col("first_up"), F.col("first_down")
    hazard = {f"h{k}": F.when((u == 0) | (u >= k), (u == k).cast("int")) for k in (1, 2, 3)}
    return out.withColumns(hazard | {"up_before_down": ((u > 0) & ((d == 0) | (u <= d))).cast("int"), "down_before_up": ((d > 0) & ((u == 0) | (d < u))).cast("int")})


def hazard_to_probability(hazards: list[Column]) -> Column:
    """1 - product of (1 - h)."""
    return 1 - reduce(lambda a, b: a * b, [1 - h for h in hazards])


def label_audit(df: DataFrame, stored: Column, rebuilt: Column) -> DataFrame:
    """Rows, rows where the labels differ, and their share."""
    differs = (stored != rebuilt).cast("int")
    return df.agg(F.count("*").alias("n"), F.sum(differs).alias("mismatches"), F.avg(differs).alias("rate"))


def mature(df: DataFrame, calendar: DataFrame, today: str, horizon: int, time: str = "date") -> DataFrame:
    """Rows whose label is known on `today`: their date lies at least `horizon` calendar positions before it. The calendar has one row per date."""
    pos = calendar.select(time).distinct().withColumn("pos", F.row_number().over(over(order=time)))
    last = pos.filter(F.col(time) <= F.lit(today).cast("date")).agg((F.max("pos") - horizon).alias("last_pos"))
    return df.join(pos.crossJoin(last).filter("pos <= last_pos").select(time), time, "left_semi")


def episodes(df: DataFrame, flag: Column, *, entity: str = "ticker", time: str = "date") -> DataFrame:
    """Adds episode (a number per entity) and episode_weight (1 / length) to the rows of each run of positive flags; others have nulls and weight 1."""
    w = over(entity, order=time)
    out = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__run", run_id(F.col("__f"), w))
    size = F.count("*").over(over(entity, "__run"))
    return out.withColumns({"episode": F.when(F.col("__f"), F.col("__run")), "episode_weight": F.when(F.col("__f"), 1.0 / size).otherwise(1.0)}).drop("__f", "__run")


def episode_table(df: DataFrame, flag: Column, *, entity: str = "ticker", time: str = "date", alert: Column | None = None) -> DataFrame:
    """One row per run: entity, episode, start, end, length, and whether any of its rows was alerted."""
    rows = episodes(df, flag, entity=entity, time=time).filter("episode is not null")
    caught = F.max((alert if alert is not None else F.lit(False)).cast("int"))
    return rows.groupBy(entity, "episode").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("length"), caught.alias("captured"))
