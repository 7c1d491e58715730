"""Cut the lineage of iterative jobs with reliable checkpoints only."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster names a shared folder in spark.checkpoint.dir; use it as it is.

    A single-machine master without that setting, as in tests, gets a folder of its own
    that goes when the process ends; any other master without it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="trackframe-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget how it was made."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
