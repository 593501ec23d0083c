"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that `per_text` hands on at once.
SLICE = 2_000
_LOCAL: list[str] = []
_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only where that is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="panelweave-"))
    return _LOCAL[0]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and any executor can reread it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged() -> int:
    """How many staged tables there are: a mark for `discard`."""
    return len(_STAGED)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Remove the tables staged after the mark, but for the last `keep` ones. Only for tables that no frame still needs."""
    end = len(_STAGED) - keep
    for path in _STAGED[since:end]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _STAGED[since:end]


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def bounded_sample(df: DataFrame, key: str, rows: int, salt: int = 0) -> DataFrame:
    """At most `rows` rows, those with the smallest hash of the key: the same rows however the table is partitioned.

    The rows are counted first, and only those whose hash lies in the least share that holds `rows` of them (and six standard
    deviations more) are ordered: all tasks together send the driver hardly more than the sample, however large the table.
    """
    h = F.xxhash64(F.lit(salt), F.col(key))
    n = df.count()
    want = rows + 6 * math.sqrt(rows) + 20
    if n > want:
        df = df.filter(h <= int(-(2**63) + 2**64 * (want / n)) if want < n else F.lit(True))
    return df.orderBy(h, F.col(key)).limit(rows)


def with_null_safe_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, null texts as empty ones; other columns, whatever their names, are left out."""
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def per_text(frame: DataFrame, columns: str, compute: Callable[[list[str]], Iterator[tuple[Sequence[int] | None, dict]]], text: str = "text") -> DataFrame:
    """Rows computed from each whole text of frame, beside the row's other columns.

    compute gets some texts and yields parts (rows, values): which of them the values belong to (None: all, in order) and a list or
    array for each of `columns`. The other columns pass as Arrow arrays, so ids of any type keep their exact values, nulls
    included. At most SLICE texts of a batch are Python strings at a time.
    """
    others = [c for c in frame.columns if c != text]
    schema = T.StructType([*frame.select(*others).schema, *T.StructType.fromDDL(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in (whole.slice(a, SLICE) for whole in batches for a in range(0, whole.num_rows, SLICE)):
            for rows, values in compute(batch.column(text).to_pylist()):
                kept = batch.select(others) if rows is None else batch.select(others).take(pa.array(rows, pa.int64()))
                own = [pa.array(values[f.name], f.type) for f in list(arrow)[len(others) :]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip([*kept.columns, *own], arrow, strict=True)], schema=arrow)

    return frame.mapInArrow(run, schema)


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Components of an undirected graph with (src, dst) long columns as (node, root): root is the component's least node.

    Alternating large-star and small-star steps: each step rewires edges towards smaller nodes and keeps at most as many
    edges as there were. A node's neighbours are only ever reduced to their least, never gathered. Each step's edges are written
    to the shared folder, and those of the step before removed. An isolated node has no row. An error is raised if `rounds` steps don't suffice (their number grows with the logarithm of the nodes).
    """
    spark = edges.sparkSession
    cur = stage(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    before = digest(cur)
    for _ in range(rounds):
        mark = staged() - 1
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        cur = stage(small.filter("u <> v").distinct(), "cc")
        discard(spark, mark, keep=1)
        after = digest(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {rounds} steps")
    roots = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
