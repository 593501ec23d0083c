"""As-of, interval, prior-fold and matching joins."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.operators.iterate import cut_lineage


def asof_backward(left: DataFrame, right: DataFrame, *, on: str, by: Sequence[str] = (), values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the latest right row at or before it (per key).

    Both sides are laid in one order and the last right row is carried on, so the cost is one sort and never a product of sides.
    A right row's values come together, nulls included.
    """
    keys = [*by, on]
    carried = F.struct(*values)
    l = left.select(*[F.col(k) for k in keys], F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).alias("__val"))  # noqa: E741
    r = right.select(*[F.col(k) for k in keys], F.lit(0).alias("__side"), F.lit(None).alias("__row"), carried.alias("__val"))
    both = l.unionByName(r)
    w = Window.partitionBy(*by).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__val", F.last("__val", ignorenulls=True).over(w)).filter("__side = 1")
    return out.select("__row.*", *[F.col("__val")[v].alias(v) for v in values])


def next_date(events: DataFrame, calendar: DataFrame, *, at: str, time: str = "date", name: str = "effective") -> DataFrame:
    """Each event with the first calendar date strictly after it (null beyond the calendar). The calendar is laid among the events in falling order."""
    cal = calendar.select(F.col(time).alias(at)).distinct().select(at, F.lit(1).alias("__side"), F.lit(None).alias("__row"), F.col(at).alias("__d"))
    ev = events.select(F.col(at), F.lit(0).alias("__side"), F.struct(*events.columns).alias("__row"), F.lit(None).cast("date").alias("__d"))
    w = Window.partitionBy("__zone").orderBy(F.desc(at), "__side").rowsBetween(Window.unboundedPreceding, 0)
    zoned = ev.unionByName(cal).withColumn("__zone", F.lit(0))
    # events only meet the calendar through distinct days, so the single ordered partition has one row per day
    days = zoned.filter("__side = 1").unionByName(zoned.filter("__side = 0").select(at).distinct().select(at, F.lit(0).alias("__side"), F.lit(None).alias("__row"), F.lit(None).cast("date").alias("__d"), F.lit(0).alias("__zone")))
    found = days.withColumn("__n", F.last("__d", ignorenulls=True).over(w)).filter("__side = 0").select(at, F.col("__n").alias(name))
    return events.join(found, at, "left")


def fold_membership(df: DataFrame, folds: DataFrame, *, time: str = "date") -> DataFrame:
    """(row columns, fold_id, role) for every fold range that holds the row. The fold calendar has a few rows and is broadcast."""
    train = F.col(time).between(F.col("train_start"), F.col("train_end"))
    valid = F.col(time).between(F.col("validation_start"), F.col("validation_end"))
    return df.join(F.broadcast(folds), train | valid).withColumn("role", F.when(valid, "validation").otherwise("train")).drop("train_start", "train_end", "purge_start", "purge_end", "validation_start", "validation_end")


def prior_fold_sums(df: DataFrame, fold: str, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """For each group and fold, the sums over the group's smaller folds only. Rows are first reduced to a row per group and fold."""
    each = df.groupBy(*by, fold).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*by).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumns({n: F.sum(n).over(w) for n in sums})


def matched_controls(df: DataFrame, *, case: Column, control: Column, score: str, row_id: str, same: Sequence[str], penalties: dict[str, float], k: int, near: int = 512) -> DataFrame:
    """(case_id, control_id, penalty, rank): for each case the k controls of its group with the least penalty.

    Penalty: absolute score gap, plus a fixed amount for each of the given columns that differs; ties by control id. A case first
    meets the controls within a score gap that holds about `near` rows of its group. Its k best are final if the k-th penalty is
    within that gap, since any other control is further off; the cases left go on with four times the gap, until it spans the
    group. So a case of a large group meets a part of it that doesn't grow with the group.
    """
    cols = [*dict.fromkeys([*same, score, row_id, *penalties])]
    span = df.groupBy(*same).agg(F.count("*").alias("__n"), F.min(score).alias("__lo"), (F.max(score) - F.min(score)).alias("__span"))
    rows = cut_lineage(df.filter((case | control) & F.col(score).isNotNull()).select(*cols, case.alias("__case"), control.alias("__control")).join(span, list(same)))
    cost = F.abs(F.col(f"a_{score}") - F.col(f"b_{score}"))
    for c, p in penalties.items():
        cost = cost + F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), 0.0).otherwise(p)
    left, out, turn = rows.filter("__case"), None, 0
    while True:
        width = F.col("__span") * near / F.col("__n") * float(4**turn)
        whole = (width >= F.col("__span")) | (width <= 0)
        cell = F.when(whole, 0).otherwise(F.floor((F.col(score) - F.col("__lo")) / width)).cast("long")
        cells = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.array(cell - 1, cell, cell + 1))
        other = [c for c in cols if c not in same]
        a = left.select(*same, *[F.col(c).alias(f"a_{c}") for c in other], width.alias("__width"), whole.alias("__whole"), F.explode(cells).alias("__cell"))
        b = rows.filter("__control").select(*same, *[F.col(c).alias(f"b_{c}") for c in other], cell.alias("__cell"))
        pairs = a.join(b, [*same, "__cell"]).select(F.col(f"a_{row_id}").alias("case_id"), F.col(f"b_{row_id}").alias("control_id"), F.round(cost, 9).alias("penalty"), "__width", "__whole")
        w = Window.partitionBy("case_id")
        best = pairs.withColumn("rank", F.row_number().over(w.orderBy("penalty", "control_id"))).filter(F.col("rank") <= k)
        sure = F.col("__whole") | ((F.count("*").over(w) >= k) & (F.max("penalty").over(w) < F.col("__width") - 1e-9))
        final = best.withColumn("__sure", sure).filter("__sure").select("case_id", "control_id", "penalty", "rank")
        if turn == 0 and not left.filter(~whole).limit(1).count():
            return final  # every group is met whole
        final = cut_lineage(final)
        out = final if out is None else out.unionByName(final)
        left = cut_lineage(left.filter(~whole).join(final.select(F.col("case_id").alias(row_id)), row_id, "left_anti").select(*left.columns))
        if left.isEmpty():
            return out
        turn += 1


def greedy_pairs(cases: pd.DataFrame, controls: pd.DataFrame, *, most: int, day_cost: float, use_cost: float) -> list[tuple[int, int, float]]:
    """(place of the case, place of the control, cost) of one small group: always the pair of least cost, then least ids, among those still free, until no case or no room is left."""
    gap = np.abs(cases["s"].to_numpy()[:, None] - controls["s"].to_numpy()[None, :])
    days = np.minimum(np.abs(cases["d"].to_numpy()[:, None] - controls["d"].to_numpy()[None, :]), 756)
    fixed, used = gap + day_cost * days, controls["used"].to_numpy().copy()
    i_id, j_id, free, out = cases["id"].tolist(), controls["id"].tolist(), np.ones(len(cases), bool), []
    cost = lambda i, j: round(float(fixed[i, j] + use_cost * used[j]), 9)
    heap = [(cost(i, j), i_id[i], j_id[j], i, j) for i in range(len(cases)) for j in range(len(controls)) if used[j] < most]
    heapq.heapify(heap)
    while heap:
        c, _, _, i, j = heapq.heappop(heap)
        if free[i] and used[j] < most:
            now = cost(i, j)
            if now > c:  # the control has been taken meanwhile, and costs more
                heapq.heappush(heap, (now, i_id[i], j_id[j], i, j))
            else:
                out.append((i, j, c))
                free[i] = False
                used[j] += 1
    return out


def hierarchical_matching(df: DataFrame, *, case: Column, control: Column, row_id: str, score: str, date: str, levels: Sequence[Sequence[str]], most: int, reach: int = 16, day_cost: float = 0.1 / 756, use_cost: float = 0.01, small_pairs: int = 200_000) -> DataFrame:
    """(case_id, control_id, level, cost): one control for each case, each control for `most` cases at most.

    Levels are tried in order, each a list of columns that must agree (none: any control). Cost (nine digits): score gap, days apart (two
    years at most), and a price that rises by use_cost each time the control is taken. At a level pairs are matched by least cost: the stable
    matching, in which no case and control would both rather have each other. Cases left after the last level find no room anywhere.
    Rows without a score, a date or an id take no part, nor do rows with a null in a level's column at that level.

    Groups of up to small_pairs case-control pairs are matched in one go each, ties by case id, then control id. A larger group's free rows are laid in
    order of score, then of a hash; a case may have the `reach` free controls on either side of its place, and the matching that is stable
    over these pairs (ties by a hash of the pair) is found by rounds in which all pairs that are each other's best are matched at once. Cases left
    over go on with the controls that still have room, and a reach twice as wide, up to 512. The result doesn't depend on how rows are partitioned.
    """
    cols = [*dict.fromkeys(c for level in levels for c in level)]
    rows = cut_lineage(df.filter(case | control).select(F.col(row_id).alias("id"), F.col(score).cast("double").alias("s"), F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).alias("d"), *cols, control.alias("is_control")).filter("s is not null and d is not null and id is not null"))
    pair = f"case_id {rows.schema['id'].dataType.simpleString()}, control_id {rows.schema['id'].dataType.simpleString()}, cost double"
    taken = cut_lineage(rows.limit(0).select(F.col("id").alias("case_id"), F.col("id").alias("control_id"), F.lit(0).alias("level"), F.lit(0.0).alias("cost")))

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (x.sort_values("id", ignore_index=True) for x in (pdf[~pdf["is_control"]], pdf[pdf["is_control"]]))
        got = greedy_pairs(a, b, most=most, day_cost=day_cost, use_cost=use_cost)
        return pd.DataFrame({"case_id": [a["id"].iloc[i] for i, _, _ in got], "control_id": [b["id"].iloc[j] for _, j, _ in got], "cost": [c for _, _, c in got]})

    for number, level in enumerate(levels):
        wide, first = reach, True
        while True:
            used = taken.groupBy(F.col("control_id").alias("id")).agg(F.count("*").cast("int").alias("used"))
            free = rows.filter("is_control").join(used, "id", "left").withColumn("used", F.coalesce("used", F.lit(0))).filter(F.col("used") < most)
            both = free.unionByName(rows.filter("not is_control").join(taken.select(F.col("case_id").alias("id")), "id", "left_anti").withColumn("used", F.lit(0)))
            for c in level:
                both = both.filter(F.col(c).isNotNull())
            ks = F.sum(F.col("is_control").cast("long"))
            sizes = both.groupBy(*level).agg((ks * (F.count("*") - ks)).alias("pairs")).filter("pairs > 0")
            keyed = lambda kept: both.join(sizes.filter(kept).drop("pairs"), list(level), "left_semi") if level else both  # noqa: B023, E731
            if first:
                first = False
                few = F.col("pairs") <= small_pairs
                if level or not sizes.filter(few).isEmpty():
                    new = keyed(few).groupBy(*level).applyInPandas(small, pair)
                    taken = cut_lineage(taken.unionByName(new.select("case_id", "control_id", F.lit(number).alias("level"), "cost")))
                    continue
            if sizes.isEmpty():
                break
            new = _stable_pass(keyed(F.lit(True)), level, wide, most, day_cost, use_cost)
            taken, wide = cut_lineage(taken.unionByName(new.select("case_id", "control_id", F.lit(number).alias("level"), "cost"))), min(512, 2 * wide)
    return taken


def _stable_pass(both: DataFrame, level: Sequence[str], wide: int, most: int, day_cost: float, use_cost: float) -> DataFrame:
    """(case_id, control_id, cost): the stable matching of free cases with the free controls up to `wide` places off."""
    laid = places(both.withColumn("h", F.xxhash64("id")), level, ["s", "h", "id"], ["is_control"], ["at"])
    near = F.explode(F.sequence(F.col("at") - wide + 1, F.col("at") + wide)).alias("at")
    ask = laid.filter("not is_control").select(*level, F.col("id").alias("case_id"), F.col("s").alias("cs"), F.col("d").alias("cd"), near)
    offer = laid.filter("is_control").select(*level, "at", F.col("id").alias("control_id"), F.col("s").alias("ks"), F.col("d").alias("kd"), "used")
    fixed = F.abs(F.col("cs") - F.col("ks")) + day_cost * F.least(F.abs(F.col("cd") - F.col("kd")), F.lit(756))
    pairs = cut_lineage(ask.join(offer, [*level, "at"]).select("case_id", "control_id", fixed.alias("fixed"), "used", F.xxhash64("case_id", "control_id").alias("tie")))
    out = None
    while True:
        priced = pairs.withColumn("cost", F.round(F.col("fixed") + use_cost * F.col("used"), 9))
        mine = priced.groupBy("case_id").agg(F.min(F.struct("cost", "tie", "control_id")).alias("m")).select("case_id", F.col("m.control_id").alias("control_id"), F.col("m.cost").alias("cost"))
        theirs = priced.groupBy("control_id").agg(F.min(F.struct("cost", "tie", "case_id")).alias("m")).select("control_id", F.col("m.case_id").alias("case_id"))
        new = cut_lineage(mine.join(theirs, ["case_id", "control_id"]))
        out = new if out is None else out.unionByName(new)
        left = pairs.join(new.select("case_id"), "case_id", "left_anti").join(new.select("control_id", F.lit(1).alias("__more")), "control_id", "left")
        pairs = cut_lineage(left.withColumn("used", F.col("used") + F.coalesce("__more", F.lit(0))).drop("__more").filter(F.col("used") < most).select(*pairs.columns))
        if pairs.isEmpty():
            return out


def places(df: DataFrame, by: Sequence[str], order: Sequence[str], counted: Sequence[str], names: Sequence[str]) -> DataFrame:
    """df with the number of `counted` rows up to and with each row, in order within a group of any size, one column for each of `counted`.

    The rows are range-partitioned and checkpointed, so that what follows sees one assignment of rows to partitions; counts of
    the partitions before are added.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut_lineage(df.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))
    sums = laid.groupBy(*by, "__part").agg(*(F.sum(F.col(c).cast("long")).alias(f"__{c}") for c in counted))
    w = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "__part", *(F.coalesce(F.sum(f"__{c}").over(w), F.lit(0)).alias(f"__{c}") for c in counted))
    own = Window.partitionBy(*by, "__part").orderBy(*order)
    return laid.join(before, [*by, "__part"]).withColumns({n: F.sum(F.col(c).cast("long")).over(own) + F.col(f"__{c}") for c, n in zip(counted, names, strict=True)}).drop("__part", *(f"__{c}" for c in counted))


def two_hop(edges: DataFrame, *, longest: int = 5) -> DataFrame:
    """Paths a -> b -> c, a and c different, total lag within bounds, scored by the root of the product of strengths."""
    first = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("lag").alias("lag1"), F.col("weight").alias("w1"))
    second = edges.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("lag").alias("lag2"), F.col("weight").alias("w2"))
    out = first.join(second, "b").filter((F.col("a") != F.col("c")) & (F.col("lag1") + F.col("lag2") <= longest))
    return out.select("a", "b", "c", (F.col("lag1") + F.col("lag2")).alias("lag"), F.sqrt(F.col("w1") * F.col("w2")).alias("score"))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many key rows each side has beyond the other's."""
    a = left.select(*keys).exceptAll(right.select(*keys)).agg(F.count("*").alias("left_extra"))
    b = right.select(*keys).exceptAll(left.select(*keys)).agg(F.count("*").alias("right_extra"))
    return a.crossJoin(b)
