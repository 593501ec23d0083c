"""Hand-made cases: label boundaries, past-only windows, ties, budgets, joins, sources and streams."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelweave.functions.windows import over, pct_rank
from panelweave.operators import contracts, crosssection, joins, labels, policy, rolling, stats
from panelweave.plans import QUERIES
from panelweave.sources import ingest
from panelweave.streaming import operators as streaming

DAYS = [dt.date(2026, 1, d) for d in (1, 2, 5, 6, 7, 8)]


def returns(spark):
    a, b = [0.0, 0.03, 0.02, 0.0, 0.0, 0.0], [0.0, 0.05, 0.0, 0.0, 0.0, 0.0]
    rows = [(d, "000660", r) for d, r in zip(DAYS, a, strict=True)] + [(d, "005930", r) for d, r in zip(DAYS, b, strict=True)]
    return spark.createDataFrame(rows, "date date, ticker string, r double")


def test_forward_label_boundaries(spark):
    out = labels.forward_labels(returns(spark), "r", horizon=3, threshold=0.05).orderBy("ticker", "date").collect()
    assert [r["target_valid"] for r in out] == [True] * 3 + [False] * 3 + [True] * 3 + [False] * 3
    assert (out[0]["label"], out[0]["first_hit_day"]) == (1, 2)
    assert (out[6]["label"], out[6]["first_hit_day"]) == (1, 1)  # exactly five percent counts
    assert (out[1]["label"], out[1]["first_hit_day"]) == (0, 0)


def test_past_only_windows_ignore_the_future(spark):
    w = over("ticker", order="date")
    df = returns(spark).withColumn("x", F.col("r") + F.dayofmonth("date"))
    bent = df.withColumn("x", F.when(F.col("date") >= F.lit(DAYS[4]), 1e6).otherwise(F.col("x")))
    z = lambda d: d.select("ticker", "date", rolling.rolling_z(F.col("x"), w, 3, past_only=True, least=2).alias("z"), rolling.rolling_rank(F.col("x"), w, 3, past_only=True, least=1).alias("k"))
    before = lambda d: sorted(map(tuple, z(d).filter(F.col("date") < F.lit(DAYS[4])).collect()), key=str)
    assert before(df) == before(bent)


def test_ranks_average_ties_and_global_rank_agrees(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, None, 2.0, 3.0])], "i int, v double")
    one = {r["i"]: r["p"] for r in df.withColumn("p", pct_rank(F.col("v"))).collect()}
    assert one == {0: 0.8, 1: 0.2, 2: 0.8, 3: None, 4: 0.4, 5: 0.8}
    assert {r["i"]: r["p"] for r in crosssection.global_pct_rank(df, "v", "p", parts=3).collect()} == one


def test_budget_may_be_zero_and_ties_follow_rows(spark):
    df = spark.createDataFrame([(i, DAYS[0], 0.5, i % 2) for i in range(9)], "row_id long, date date, score double, target int")
    assert policy.daily_budget(df, "score", 0.1, 5).filter("alert").count() == 0
    assert [r["row_id"] for r in policy.daily_top(df, "score", 0.2).filter("alert").orderBy("row_id").collect()] == [0, 1]
    none = policy.safest_threshold(df.withColumn("k", F.lit(1)), ["k"], precision=0.99, least_alerts=1).first()
    assert none["threshold"] == float("inf") and none["alerts"] == 0


def test_episodes_and_weights(spark):
    df = spark.createDataFrame([("a", d, y) for d, y in zip(DAYS, [1, 1, 0, 1, 0, 1], strict=True)], "ticker string, date date, y int")
    t = labels.episode_table(df, F.col("y") == 1).orderBy("start").collect()
    assert [(r["start"], r["end"], r["length"]) for r in t] == [(DAYS[0], DAYS[1], 2), (DAYS[3], DAYS[3], 1), (DAYS[5], DAYS[5], 1)]


def test_asof_and_next_date(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, None), ("b", 9, "y")], "k string, t int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in joins.asof_backward(left, right, on="t", by=["k"], values=["v"]).collect()}
    assert got == {("a", 1): None, ("a", 5): None, ("b", 5): None}
    ev = spark.createDataFrame([(DAYS[1],), (dt.date(2026, 1, 3),), (DAYS[5],)], "day date")
    cal = spark.createDataFrame([(d,) for d in DAYS], "date date")
    assert sorted((r["day"], r["effective"]) for r in joins.next_date(ev, cal, at="day").filter("effective is not null").collect()) == [(DAYS[1], DAYS[2]), (dt.date(2026, 1, 3), DAYS[2])]


def test_whole_table_queries_leave_no_row_out(spark, tmp_path):
    day = dt.datetime(2026, 1, 1)
    spark.createDataFrame([(1, day + dt.timedelta(2), 1)], "o_orderkey long, o_orderdate timestamp, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, day, 5.0), (97, day - dt.timedelta(9), 1.0)], "l_orderkey long, l_shipdate timestamp, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1,), (3,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(3, day, 7, "view", 2.0), (9, day, 8, "purchase", 4.0)], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    run = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert run("r3_5_asof_global") == [(1, 5.0)]
    assert [r.asDict() for r in QUERIES["r2_8_join_contract"](spark, str(tmp_path)).collect()] == [{"left_only": 0, "right_only": 1, "both": 1}]
    assert sorted(r["event_id"] for r in QUERIES["r1_12_upsert"](spark, str(tmp_path)).collect()) == [3, 9]


@pytest.mark.parametrize("near", [2, 8, 10_000])
def test_matched_controls_equal_all_pairs(spark, near):
    import random

    rng = random.Random(3)
    rows = [(i, "d" if i % 9 else "e", rng.choice("xy"), round(rng.random() ** 3, 3), int(rng.random() < 0.3)) for i in range(120)] + [(500, "f", "x", 0.5, 1)]
    df = spark.createDataFrame(rows, "row_id long, day string, market string, score double, target int")
    got = joins.matched_controls(df, case=F.col("target") == 1, control=F.col("target") == 0, score="score", row_id="row_id", same=["day"], penalties={"market": 0.08}, k=3, near=near)
    want = []
    for i, day, market, s, y in rows:
        if y == 1:
            cost = sorted((round(abs(s - t) + (0.08 if m != market else 0.0), 9), j) for j, d, m, t, z in rows if z == 0 and d == day)
            want += [(i, j, c, n) for n, (c, j) in enumerate(cost[:3], 1)]
    assert sorted((r["case_id"], r["control_id"], r["penalty"], r["rank"]) for r in got.collect()) == sorted(want)


def test_matching_leaves_no_case_while_a_control_has_room(spark):
    rows = [(i, "a", "x", DAYS[0], 0.5, 1) for i in range(40)] + [(100 + i, "a", "x", DAYS[0], 0.5, 0) for i in range(10)]  # a hot group of equal scores
    rows += [(200 + i, "b", "x", DAYS[1], 0.4 + i / 100, 0) for i in range(4)] + [(300, None, None, DAYS[2], 0.9, 0), (301, "c", None, DAYS[2], 0.1, 1)]
    df = spark.createDataFrame(rows, "row_id long, bucket string, market string, date date, score double, target int")
    out = joins.hierarchical_matching(df, case=F.col("target") == 1, control=F.col("target") == 0, row_id="row_id", score="score", date="date", levels=[["bucket"], ["market"], []], most=3, reach=2).collect()
    used = {}
    for r in out:
        used[r["control_id"]] = used.get(r["control_id"], 0) + 1
    assert len(out) == len({r["case_id"] for r in out}) == 41 and max(used.values()) <= 3
    levels = [sum(r["level"] == k for r in out) for k in range(3)]
    assert levels == [30, 10, 1] and [r["level"] for r in out if r["case_id"] == 301] == [2]
    assert joins.hierarchical_matching(df.filter("target = 1"), case=F.col("target") == 1, control=F.col("target") == 0, row_id="row_id", score="score", date="date", levels=[[]], most=1).count() == 0


def brute_matching(rows, levels, most, day_cost=0.1 / 756, use_cost=0.01):
    """Always the least (cost, case, control) of all pairs still free, level by level."""
    cases, controls, used, out = [r for r in rows if r[-1] == 1], [r for r in rows if r[-1] == 0], {}, []
    for number, level in enumerate(levels):
        while True:
            free = [c for c in cases if c[0] not in {o[0] for o in out} and all(c[k] is not None for k in level)]
            pairs = [(round(abs(c[4] - k[4]) + day_cost * min(abs((c[3] - k[3]).days), 756) + use_cost * used.get(k[0], 0), 9), c[0], k[0]) for c in free for k in controls if used.get(k[0], 0) < most and all(c[x] == k[x] for x in level)]
            if not pairs:
                break
            cost, i, j = min(pairs)
            out.append((i, j, number, cost))
            used[j] = used.get(j, 0) + 1
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"small_pairs": 0, "reach": 512}, {"small_pairs": 0, "reach": 2}])
def test_matching_is_the_stable_one(spark, options):
    rng = __import__("random").Random(6)
    rows = [(i, rng.choice("ab") if i % 11 else None, rng.choice("xy"), DAYS[rng.randrange(3)], round(rng.random() ** 2, 4) + i * 1e-7, int(rng.random() < 0.5)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, bucket string, market string, date date, score double, target int")
    match = lambda d: joins.hierarchical_matching(d, case=F.col("target") == 1, control=F.col("target") == 0, row_id="row_id", score="score", date="date", levels=[["bucket"], ["market"], []], most=2, **options)
    got = sorted((r.case_id, r.control_id, r.level, r.cost) for r in match(df.repartition(3)).collect())
    want = brute_matching(rows, [[1], [2], []], 2)
    if options.get("reach") == 2:  # stable within reach only: the same rows whatever the partitions, and all that can be matched
        assert got == sorted((r.case_id, r.control_id, r.level, r.cost) for r in match(df.repartition(5, "score")).collect())
        assert len(got) == len(want) and [sum(g[2] == k for g in got) for k in range(3)] == [sum(w[2] == k for w in want) for k in range(3)]
    else:
        assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want, strict=True))


def test_components_and_bh(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 10)], "a long, b long")
    assert {r["node"]: r["component"] for r in stats.components_of(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9, 10: 9}
    q = [r["q"] for r in stats.bh_qvalues(spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double"), "p").orderBy("p").collect()]
    assert q == pytest.approx([0.03, 0.04, 0.04])


def test_long_chains_and_large_fisher_groups(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(1, 1501)], "l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["node"]: r["component"] for r in QUERIES["r7_14_components"](spark, str(tmp_path)).collect()}
    assert got == {i: (i - 1) % 7 + 1 for i in range(1, 1508)}
    day = dt.datetime(2026, 1, 1)
    spark.createDataFrame([(i, day, 1.0, "view") for i in range(6000)], "user_id long, ts timestamp, value double, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    for r in QUERIES["r7_46_fisher"](spark, str(tmp_path)).collect():
        ps = [(1 + i % 40) / 41 for i in range(6000) if i % 3 == int(r["market"][1:])]
        h = -sum(map(math.log, ps))
        want = math.fsum(math.exp(-h + i * math.log(h) - math.lgamma(i + 1)) for i in range(len(ps)))
        assert (r["k"], r["statistic"], r["p"]) == (2000, pytest.approx(2 * h), pytest.approx(want, abs=2e-6))
    ones = stats.fisher_combine(spark.createDataFrame([("a", 1.0), ("b", 0.2)], "g string, p double"), ["g"], "p")
    assert {r["g"]: r["p"] for r in ones.collect()} == {"a": 1.0, "b": pytest.approx(0.2)}


def test_auc_and_precision_on_known_scores(spark):
    df = spark.createDataFrame([("f", s, y) for s, y in [(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)]], "feature string, value double, target int")
    assert stats.auc(df, ["feature"]).first()["auc"] == pytest.approx(0.875)
    assert stats.average_precision(df, ["feature"]).first()["ap"] == pytest.approx((1 + 2 / 3) / 2)


@pytest.mark.parametrize("name", ["r10_8_forward_logistic", "r10_8_boosted_trees"])
def test_forward_queries_score_every_later_fold(spark, name):
    folder = "/root/testdata/sf0.001"
    from panelweave.plans.registry import Tables

    want = {(r[0], r[1]) for r in Tables(spark, folder).scored.filter("fold_id >= 2").select("row_id", "fold_id").collect()}
    got = [(r["row_id"], r["fold_id"]) for r in QUERIES[name](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {f for _, f in got} == {2, 3, 4, 5}


def test_sealed_rows_fail_the_job(spark):
    df = spark.createDataFrame([(1,), (-1,)], "x int")
    with pytest.raises(Exception, match="sealed"):
        contracts.require_none(df, F.col("x") < 0, "sealed rows").count()


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    ingest.write_table(df, str(tmp_path / "t.parquet"))
    assert ingest.read_table(spark, str(tmp_path / "t.parquet"), ["v"]).columns == ["v"]
    ingest.write_table(df.withColumn("w", F.lit(1)), str(tmp_path / "tree/x"))
    ingest.write_table(df, str(tmp_path / "tree/y"))
    assert ingest.read_tree(spark, str(tmp_path / "tree")).filter("w is null").count() == 2
    with pytest.raises(ValueError):
        ingest.read_table(spark, "x.feather")


def test_streams_equal_batches(spark, tmp_path):
    rows = [(f"k{i % 3}", dt.datetime(2026, 1, 1) + dt.timedelta(hours=i), float((-1) ** i * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name):
        q = out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(out.schema).parquet(str(tmp_path / name))

    got = run(streaming.rolling_state(stream(), key="key", ts="ts", value="value", size=4), "rolling")
    w = over("key", order="ts")
    want = df.select("key", "ts", rolling.rolling_z(F.col("value"), w, 4, past_only=True, least=2).alias("z"))
    diff = got.alias("a").join(want.alias("b"), ["key", "ts"]).select(F.abs(F.coalesce("a.z", F.lit(-99.0)) - F.coalesce("b.z", F.lit(-99.0))).alias("d"))
    assert diff.count() == 40 and diff.agg(F.max("d")).first()[0] < 1e-9

    path = str(tmp_path / "table")
    q = stream().writeStream.foreachBatch(streaming.upsert_batch(path, ["key"], "ts")).option("checkpointLocation", str(tmp_path / "u")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/version=0").collect()} == {"k0": -39.0, "k1": -37.0, "k2": 38.0}

    scored = df.select(F.abs("value").alias("value"), (F.col("value") > 0).cast("int").alias("target")).withColumn("score", F.col("value") / 40).drop("value")
    streaming.safe_step(str(tmp_path / "pol"), 0.5, precision=0.45, least_alerts=5)(scored, 0)
    assert spark.read.parquet(str(tmp_path / "pol/policy")).first()["threshold"] >= 0.5


def test_rolling_state_orders_all_parts_of_a_batch(spark, tmp_path):
    """Rows of keys in mixed order, handed on five at a time, with equal times and nulls: as if each key's rows came by time and value."""
    import numpy as np

    rng, begin = np.random.default_rng(8), dt.datetime(2026, 1, 1)
    rows = [(f"k{i % 3}", int(i // 2 % 40), None if i % 17 == 5 else float(rng.integers(-9, 10))) for i in rng.permutation(200).tolist()]
    spark.createDataFrame([(k, begin + dt.timedelta(minutes=m), v) for k, m, v in rows], "key string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        out = streaming.rolling_state(spark.readStream.schema("key string, ts timestamp, value double").parquet(str(tmp_path / "in")), key="key", ts="ts", value="value", size=6)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [(r.key, int((r.ts - begin).total_seconds() // 60), r.value, None if r.z is None else round(r.z, 6), r.streak) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()]
    want = []
    for key in ("k0", "k1", "k2"):
        ring, streak = [], 0
        for _, m, x in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2] is None, r[2] or 0.0)):
            known = [v for v in ring[-6:] if v is not None]
            z = None if x is None or len(known) < 2 or np.std(known) <= 1e-12 else round(float((x - np.mean(known)) / np.std(known)), 6)
            streak = 0 if not x else streak + int(np.sign(x)) if streak * x > 0 else int(np.sign(x))
            want.append((key, m, x, z, None if x is None else streak))
            ring.append(x)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_bh_qvalues_go_once_through_a_group(spark):
    """Equal to the rule as stated, with ties, by a frame that isn't gone through anew for each row."""
    rows = [(i % 2, i, (1 + i * 7 % 50) / 400.0) for i in range(300)]
    out = stats.bh_qvalues(spark.createDataFrame(rows, "g int, i int, p double"), "p", ["g"], ["i"])
    want = {}
    for g in (0, 1):
        here, least = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])), 1.0
        for rank in range(len(here), 0, -1):
            least = min(least, here[rank - 1][2] * len(here) / rank)
            want[here[rank - 1][1]] = round(least, 12)
    assert {r["i"]: round(r["q"], 12) for r in out.collect()} == want
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_state_of_idle_keys_goes(spark, tmp_path):
    begin = dt.datetime(2026, 1, 1)
    batches = [[("a", 0, 1.0), ("b", 0, 2.0), ("c", 1, -1.0)], [("a", 5, 3.0)], [("a", 40, -2.0), ("d", 40, 1.0)], [("d", 41, 4.0)], [("b", 41, 5.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, begin + dt.timedelta(days=d), v) for k, d, v in rows], "key string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema("key string, ts timestamp, value double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    out = streaming.rolling_state(source, key="key", ts="ts", value="value", size=4, late="1 day", idle_days=20)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) >= 3 and kept[-1] <= 3  # a, d and the new b; the old b's and c's are gone
    rows = {(r.key, (r.ts - begin).days): r.streak for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
    assert rows == {("a", 0): 1, ("b", 0): 1, ("c", 1): -1, ("a", 5): 2, ("a", 40): -1, ("d", 40): 1, ("d", 41): 2, ("b", 41): 1}


def test_average_linkage_of_many_groups(spark):
    import numpy as np

    from panelweave.operators.stats import average_linkage

    rng, rows, want = np.random.default_rng(5), [], {}
    for g, n in (("a", 25), ("b", 9), ("c", 2), ("d", 40)):
        points = rng.random((n, 2)) * 1.2
        dist = np.minimum(np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)), 1.0)
        rows += [(g, f"{g}{i:02d}", f"{g}{j:02d}", float(dist[i, j])) for i in range(n) for j in range(i) if dist[i, j] < 1.0 or rng.random() < 0.5]
        rows += [(g, f"{g}{i:02d}", f"{g}{i:02d}", 0.0) for i in range(n)]
        here = sorted({x for r in rows if r[0] == g and r[1] != r[2] for x in r[1:3]})
        groups = [[int(x[1:])] for x in here]
        while len(groups) > 1:
            d, i, j = min((dist[np.ix_(x, y)].mean(), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
            if d > 0.4:
                break
            groups[i] += groups.pop(j)
        want |= {(g, f"{g}{k:02d}"): f"{g}{min(c):02d}" for c in groups for k in c}
    df = spark.createDataFrame(rows, "g string, a string, b string, distance double")
    assert {(r.g, r.node): r.cluster for r in average_linkage(df, ["g"], cut=0.4).collect()} == want
    assert average_linkage(df.filter("false"), ["g"], cut=0.4).count() == 0


def test_names_of_the_queries_are_known():
    """Each name that a query's code reads is one of its module's or a builtin: an import that goes missing shows without running the query."""
    import builtins
    import dis
    import sys
    import types

    def read(code):
        yield from (i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL")
        for c in code.co_consts:
            if isinstance(c, types.CodeType):
                yield from read(c)

    plans = [m for n, m in sys.modules.items() if n.startswith("panelweave.plans.")]
    assert len(plans) > 5
    for m in plans:
        with open(m.__file__) as f:
            unknown = {n for n in read(compile(f.read(), m.__file__, "exec")) if not hasattr(m, n) and not hasattr(builtins, n)}
        assert not unknown, (m.__name__, unknown)
