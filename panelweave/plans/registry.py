"""Registry of queries, and the frames that they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.scalar import ratio
from panelweave.functions.windows import pct_rank
from panelweave.operators.labels import forward_labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder and the panels derived from them; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def panel(self) -> DataFrame:
        """One row per user and day: summed value as close, events as volume, and group columns."""
        day = self.read("events").groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(
            F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("close"),
            F.count("*").alias("volume"),
            F.count_if(F.col("event_type") == "error").alias("errors"),
            F.count_if(F.col("event_type") == "purchase").alias("buys"),
        )
        group = lambda letter, n: F.concat(F.lit(letter), (F.col("ticker") % n).cast("string"))
        return day.withColumns({"market": group("M", 3), "bucket": group("B", 5), "industry": group("I", 7)})

    @cached_property
    def ret(self) -> DataFrame:
        """The panel with r, the change of close against the row before: infinite (or NaN, 0 against 0) after a close of 0."""
        w = Window.partitionBy("ticker").orderBy("date")
        return self.panel.withColumn("r", ratio(F.col("close"), F.lag("close").over(w)) - 1)

    @cached_property
    def labelled(self) -> DataFrame:
        """The panel with its 3-day forward label (at least 3.0 up) and its parts."""
        return forward_labels(self.ret, "r", horizon=3, threshold=3.0)

    @cached_property
    def scored(self) -> DataFrame:
        """Valid labelled rows with a score, a fold of five days and a stable row id."""
        base = self.labelled.filter("target_valid").withColumn("fold_id", F.least(F.floor(F.datediff("date", F.lit("2024-01-01").cast("date")) / 5), F.lit(5)).cast("int"))
        score = F.round(0.6 * (1 - pct_rank(F.col("close"), "date")) + 0.4 * pct_rank(F.col("volume").cast("double"), "date"), 6) * 0.997310137  # no short decimals: halves of a last digit round either way
        return base.select("ticker", "date", "fold_id", "market", "bucket", "industry", "close", "volume", "errors", "buys", "r", F.col("label").alias("target"), "best", score.alias("score"), (F.col("ticker") * 100000 + F.datediff("date", F.lit("2024-01-01").cast("date"))).alias("row_id"))

    @cached_property
    def features(self) -> DataFrame:
        """Scored rows in long form: one row per feature."""
        wide = self.scored.select("row_id", "ticker", "date", "fold_id", "market", "target", F.col("close").alias("f_close"), F.col("volume").cast("double").alias("f_volume"), F.col("errors").cast("double").alias("f_errors"), F.col("buys").cast("double").alias("f_buys"), F.col("r").alias("f_ret"), (F.col("close") / F.col("volume")).alias("f_mean"))
        return wide.unpivot(["row_id", "ticker", "date", "fold_id", "market", "target"], ["f_close", "f_volume", "f_errors", "f_buys", "f_ret", "f_mean"], "feature", "value")

    @cached_property
    def monthly(self) -> DataFrame:
        """One row per supplier and month: quantity, revenue, mean discount and lines; month as a running number."""
        m = self.read("lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.trunc("l_shipdate", "month").alias("date")).agg(
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("rev"),
            (F.sum(F.col("l_discount").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("disc"),
            F.count("*").alias("lines"),
        )
        return m.withColumn("pos", F.year("date") * 12 + F.month("date"))


#: The same frames as DuckDB common table expressions, each with those that it needs before it.
CTE = {
    "panel": """panel AS (SELECT *, 'M' || (ticker % 3) AS market, 'B' || (ticker % 5) AS bucket, 'I' || (ticker % 7) AS industry FROM (
  SELECT user_id AS ticker, CAST(ts AS DATE) AS date, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS close, count(*) AS volume,
    count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS buys FROM events GROUP BY 1, 2))""",
    "ret": "ret AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM panel)",
    "labelled": """labelled AS (SELECT *, CASE WHEN best >= 3.0 - 1e-12 THEN 1 WHEN best IS NOT NULL THEN 0 END AS label,
  best IS NOT NULL AS target_valid, CASE WHEN best IS NULL THEN NULL WHEN c1 >= 3.0 - 1e-12 THEN 1 WHEN c2 >= 3.0 - 1e-12 THEN 2 WHEN c3 >= 3.0 - 1e-12 THEN 3 ELSE 0 END AS first_hit_day FROM (
  SELECT *, CASE WHEN c3 IS NOT NULL THEN greatest(c1, c2, c3) END AS best FROM (
  SELECT *, (1 + r1) - 1 AS c1, (1 + r1) * (1 + r2) - 1 AS c2, (1 + r1) * (1 + r2) * (1 + r3) - 1 AS c3 FROM (
  SELECT *, lead(r, 1) OVER w AS r1, lead(r, 2) OVER w AS r2, lead(r, 3) OVER w AS r3 FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date)))))""",
    "scored": """scored AS (SELECT ticker, date, CAST(least(floor((date - DATE '2024-01-01') / 5.0), 5) AS INTEGER) AS fold_id, market, bucket, industry, close, volume, errors, buys, r, label AS target, best,
  round(0.6 * (1 - (rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0) / count(*) OVER (PARTITION BY date))
      + 0.4 * ((rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY date)), 6) * 0.997310137 AS score,
  ticker * 100000 + (date - DATE '2024-01-01') AS row_id FROM labelled WHERE target_valid)""",
    "features": """features AS (FROM (SELECT row_id, ticker, date, fold_id, market, target, close AS f_close, CAST(volume AS DOUBLE) AS f_volume, CAST(errors AS DOUBLE) AS f_errors, CAST(buys AS DOUBLE) AS f_buys, r AS f_ret, close / volume AS f_mean FROM scored)
  UNPIVOT INCLUDE NULLS (value FOR feature IN (f_close, f_volume, f_errors, f_buys, f_ret, f_mean)))""",
    "monthly": """monthly AS (SELECT *, year(date) * 12 + month(date) AS pos FROM (SELECT l_suppkey AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS rev, CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS disc, count(*) AS lines FROM lineitem GROUP BY 1, 2))""",
}
NEEDS = {"panel": [], "ret": ["panel"], "labelled": ["panel", "ret"], "scored": ["panel", "ret", "labelled"], "features": ["panel", "ret", "labelled", "scored"], "monthly": []}


def sql(frames: str, body: str) -> str:
    """A query text with the named frames in front; further expressions may begin the body with a comma."""
    names: list[str] = []
    for f in frames.split():
        names += [n for n in [*NEEDS[f], f] if n not in names]
    head = "WITH " + ",\n".join(CTE[n] for n in names) if names else ""
    return f"{head}{'' if body.lstrip().startswith(',') else chr(10)}{body}"


def rd(names: str) -> str:
    """Comma-separated round(x, 6) AS x of the names."""
    return ", ".join(f"round({n}, 6) AS {n}" for n in names.split())


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, so that the order of a sum doesn't show."""
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(name: str, text: str | None = None) -> Callable:
    """Register a function of Tables as a query, with its SQL where there is some."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
        if text:
            SQL[name] = text
        return f

    return register
