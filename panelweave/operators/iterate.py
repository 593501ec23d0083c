"""Helpers for plans that depend on the data: cut lineage between rounds, and sides sent to all tasks only if they are small."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir, which all executors share; a folder of our own only where that is unset and all tasks run on this machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if found is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="panelweave-"))
    return df.checkpoint()


def if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df to be sent to all tasks if it has at most `rows` rows, which are counted first; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
