"""Cutting lineage in the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpoint(frame: DataFrame) -> DataFrame:
    """The rows as they stand in the shared checkpoint folder, so that a lost executor costs nothing; only a local master may do without one."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return frame.checkpoint(eager=True)


def spread(frame: DataFrame, *keys) -> DataFrame:
    """The rows dealt by key into as many partitions as the session shuffles into; adaptive execution, which goes by bytes, merges none of them."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
