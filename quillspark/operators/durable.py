"""Cutting lineage into the folder all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the session's checkpoint folder and read from there.

    The folder is the one the cluster names in spark.checkpoint.dir; only a local session without one gets its own.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillspark-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
