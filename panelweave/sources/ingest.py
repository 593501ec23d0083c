"""Scans, schema probes, column resolution, cleaning, merges of sources, and sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.scalar import finite, next_business_day


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV (also .gz) by suffix; only the columns asked for reach the scan. Other suffixes raise."""
    kind = next((k for s, k in ((".parquet", "parquet"), (".orc", "orc"), (".json", "json"), (".jsonl", "json"), (".csv", "csv"), (".csv.gz", "csv")) if path.endswith(s)), None)
    if kind is None:
        raise ValueError(f"no reader for {path}")
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    df = (reader.schema(schema) if schema else reader).format(kind).load(path)
    return df.select(*columns) if columns else df


def read_tree(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """All Parquet files below a folder as one table; columns that some files lack are null there."""
    return spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).option("pathGlobFilter", pattern).parquet(root)


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), kind: str = "parquet") -> None:
    """Overwrite a folder; the commit protocol makes it visible as a whole. Parquet is zstd-compressed, CSV has a header and gzip."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    (writer.option("compression", "zstd").parquet(path) if kind == "parquet" else writer.option("compression", "gzip").csv(path, header=True))


def schema_probe(df: DataFrame) -> DataFrame:
    """One row per column: position, name and type, with the table's row count (from file footers where the source has them)."""
    names = df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "position int, name string, kind string")
    return names.crossJoin(df.agg(F.count(F.lit(1)).alias("n_rows")))


def first_column(df: DataFrame, candidates: Sequence[str], default: Column | None = None) -> Column:
    """The first of the candidates that the table has, whatever its case; else the default (null)."""
    have = {c.lower(): c for c in df.columns}
    found = next((have[c.lower()] for c in candidates if c.lower() in have), None)
    return F.col(found) if found else (default if default is not None else F.lit(None))


def canonical_name(name: str) -> str:
    """A header without byte-order mark, blanks and _()%/- , in lower case."""
    return re.sub(r"[\s_()%/\-﻿]", "", name).lower()


def canonical_header(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Columns renamed by their canonical form; unknown ones keep their name."""
    known = {canonical_name(k): v for k, v in aliases.items()}
    return df.toDF(*[known.get(canonical_name(c), c) for c in df.columns])


def unit_scaled(df: DataFrame, column: str, *, quantile: float = 0.99, bar: float = 1.0) -> DataFrame:
    """Percent to fraction: if the quantile of the absolute values is above the bar, the column is divided by 100. The quantile is one row."""
    one = df.agg(F.percentile(F.abs(F.col(column)), F.lit(quantile)).alias("__q"))
    return df.crossJoin(F.broadcast(one)).withColumn(column, F.when(F.col("__q") > bar, F.col(column) / 100.0).otherwise(F.col(column))).drop("__q")


def stamp_rows(df: DataFrame, *order: str, name: str = "source_row_id") -> DataFrame:
    """A row number from 0 in the order of the given key columns, the same however the table is partitioned.

    Rows are numbered within the ranges of the first key and offset by the rows of smaller keys, so that no single task holds
    the table.
    """
    first = order[0]
    sizes = df.groupBy(first).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy(first)) - F.col("__n")).drop("__n")
    return df.join(before, first).withColumn(name, F.col("__before") + F.row_number().over(Window.partitionBy(first).orderBy(*order)) - 1).drop("__before")


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    down = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("__r", F.row_number().over(down)).filter("__r = 1").drop("__r")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Both tables together, the last row of each key kept; an incoming row wins a tie."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return keep_latest(both, keys, [F.col(order), F.col("__new")]).drop("__new")


def coalescing_merge(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join on the keys; a column that several sources have is filled in their order."""
    out = frames[0]
    for nxt in frames[1:]:
        shared = [c for c in nxt.columns if c in out.columns and c not in keys]
        renamed = nxt.withColumnsRenamed({c: f"__{c}" for c in shared})
        out = out.join(renamed, list(keys), "full").withColumns({c: F.coalesce(c, f"__{c}") for c in shared}).drop(*[f"__{c}" for c in shared])
    return out


def collapse_endpoints(df: DataFrame, keys: Sequence[str], endpoint: str, value: str, order: str, endpoints: Sequence[str]) -> DataFrame:
    """One row per key, one column per endpoint: the last value of each."""
    pick = [F.max_by(F.when(F.col(endpoint) == e, F.col(value)), F.when(F.col(endpoint) == e, F.col(order))).alias(e) for e in endpoints]
    return df.groupBy(*keys).agg(*pick)


def correction_chains(df: DataFrame, entity: str, title: Column, order: Sequence[str], row_id: str) -> DataFrame:
    """Adds chain (entity and normalised title), seq, previous_id and is_latest to reports that amend each other."""
    out = df.withColumn("chain", F.concat_ws("|", F.col(entity).cast("string"), title))
    w = Window.partitionBy("chain").orderBy(*order)
    return out.withColumns({"seq": F.row_number().over(w), "previous_id": F.lag(row_id).over(w), "is_latest": F.lead(row_id).over(w).isNull()})


def available_from(observed: Column, monthly: Column) -> Column:
    """When an observation may be used: the next business day, 31 days later for monthly series."""
    return F.when(monthly, F.date_add(observed, 31)).otherwise(next_business_day(observed))


def coverage(df: DataFrame, entity: str, time: str, required: Sequence[str], *, least_rows: int, least_span: int, least_ratio: float) -> DataFrame:
    """Per entity: rows, days spanned, the share of values that are there for each required column, and whether all minimums hold."""
    ratios = [F.avg(finite(F.col(c)).isNotNull().cast("double")).alias(f"{c}_ratio") for c in required]
    out = df.groupBy(entity).agg(F.count("*").alias("n_rows"), F.datediff(F.max(time), F.min(time)).alias("span"), *ratios)
    return out.withColumn("ready", (F.col("n_rows") >= least_rows) & (F.col("span") >= least_span) & (F.least(*[F.col(f"{c}_ratio") for c in required], F.lit(1.0)) >= least_ratio))


def classify(text: Column, rules: Sequence[tuple[str, str, int]], default: tuple[str, int] = ("other", 0)) -> tuple[Column, Column]:
    """(category, severity) of the first rule (pattern, category, severity) that the text matches."""
    kind, level = F.lit(default[0]), F.lit(default[1])
    for pattern, name, severity in reversed(rules):
        kind, level = F.when(text.rlike(pattern), name).otherwise(kind), F.when(text.rlike(pattern), severity).otherwise(level)
    return kind, level


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """An order-free digest of a table: rows, and the xor and sum of row hashes."""
    h = F.crc32(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("hash_xor"), F.sum(h).alias("hash_sum"))
