"""Queries: model fits and streams (rows only; the streams' results are held against batch SQL where they are deterministic)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelweave.functions.scalar import finite
from panelweave.functions.windows import pct_rank
from panelweave.operators import ml
from panelweave.plans.registry import Tables, query
from panelweave.streaming import operators as ST

FEATURES = ["close", "volume", "errors", "buys", "r"]


def frame(t: Tables):
    """Scored rows with their features as doubles; infinite and NaN returns are null, which the fits impute."""
    return t.scored.withColumns({c: finite(F.col(c)) for c in FEATURES})


@query("r10_8_forward_logistic")
def _(t):
    return ml.forward_scores(frame(t), FEATURES).select("row_id", "fold_id", "target", "p")


@query("r10_8_boosted_trees")
def _(t):
    return ml.forward_scores(frame(t), FEATURES, kind="boosted", maxDepth=3).select("row_id", "fold_id", "target", "p")


@query("r10_9_entity_models")
def _(t):
    return ml.entity_logistic(frame(t), ["close", "volume", "buys"])


@query("r10_11_calibration_choice")
def _(t):
    raw = frame(t).withColumn("raw", pct_rank(F.col("score"), "date"))
    past = raw.filter("fold_id < 4")
    return ml.apply_calibrator(ml.calibrate(past, "raw"), raw.filter("fold_id >= 4"), "raw", "p").select("row_id", "target", "p")


@query("r10_20_stack")
def _(t):
    x = frame(t).withColumns({"a": F.col("score"), "b": 1 - F.col("score") / 2})
    model = ml.nonnegative_stack(x.filter("fold_id < 4"), ["a", "b"])
    later = x.filter("fold_id >= 4")
    from panelweave.functions.scalar import logit

    return ml.score(model, later.withColumns({"__l0": logit(F.col("a")), "__l1": logit(F.col("b"))})).select("row_id", "target", "p")


def shared(spark) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="panelweave-")
    return base.rstrip("/")


def run_stream(t: Tables, build, *, name: str, mode: str = "append"):
    """Run a streaming query over the events table to its end, into a table of the shared folder, and return what it holds."""
    base = shared(t.spark)
    at = f"{base}/{name}-{uuid.uuid4().hex}"
    source = t.read("events")
    stream = t.spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(t.sf_dir + "/event[s].parquet")
    out = build(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    q = out.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/data").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    done = t.spark.read.schema(out.schema).parquet(f"{at}/data")
    return done.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in done.dtypes])


@query("r12_8_windowed_breadth", "SELECT start, \"end\", event_type, n, round(mean, 6) AS mean, advance FROM (SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, avg(value) AS mean, avg((value > 0)::INT) AS advance FROM events GROUP BY 1, 2, 3) WHERE \"end\" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def _(t):
    return run_stream(t, lambda s: ST.windowed_breadth(s, by=["event_type"]), name="breadth")


@query("r12_7_episode_sessions", "WITH e AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM e)) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", count(*) AS n FROM g GROUP BY user_id, run HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR")
def _(t):
    return run_stream(t, lambda s: ST.episode_sessions(s, F.col("event_type") == "error", key="user_id"), name="sessions")


@query("r12_5_first_of_each")
def _(t):
    return run_stream(t, lambda s: ST.first_of_each(s, ["user_id", "event_type"]), name="first")


@query("r12_6_rolling_state", "WITH n AS (SELECT user_id, ts, value, count(value) OVER w AS k, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, sign(value)::INT AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - row_number() OVER (PARTITION BY user_id, sign(value) ORDER BY ts, value) AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT user_id, ts, value, CASE WHEN k >= 3 AND s > 1e-12 THEN round((value - m) / s, 6) END AS z, CAST(g * row_number() OVER (PARTITION BY user_id, g, run ORDER BY ts, value) AS BIGINT) AS streak FROM n")
def _(t):
    return run_stream(t, lambda s: ST.rolling_state(s, key="user_id", ts="ts", value="value", size=10), name="rolling")


@query("r12_1_delayed_labels", "WITH s AS (SELECT user_id AS key, ts, value AS score FROM events WHERE event_type = 'view'), l AS (SELECT user_id AS k, ts AS label_ts, value AS label FROM events WHERE event_type = 'purchase') SELECT key, ts, score, label_ts, label FROM s LEFT JOIN l ON key = k AND label_ts >= ts AND label_ts <= ts + INTERVAL 3 DAY WHERE label_ts IS NOT NULL OR ts + INTERVAL 3 DAY < (SELECT least((SELECT max(ts) FROM s), (SELECT max(label_ts) FROM l))) - INTERVAL 1 DAY")
def _(t):
    def build(s):
        scores = s.filter("event_type = 'view'").select(F.col("user_id").alias("key"), "ts", F.col("value").alias("score"))
        labels = s.filter("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("ts").alias("label_ts"), F.col("value").alias("label"))
        return ST.delayed_label_join(scores, labels, key="key")

    return run_stream(t, build, name="labels")
