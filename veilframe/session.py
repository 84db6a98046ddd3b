"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsized(rows: DataFrame) -> DataFrame:
    """``rows`` as the side of a join that is sorted, never sent to the driver for a broadcast.

    Spark guesses how large a side is, by the columns' types and the rows before an explode, a parser or an Arrow step; it
    then may broadcast a table of any size. For sides without a bound.
    """
    return rows.hint("merge")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoint(): the one already set, else the one that ``spark.checkpoint.dir`` names.

    Only a local master, whose executors share this machine, gets a folder of its own where none is named.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.mkdtemp(prefix="veilframe-"), "checkpoints")
    sc.setCheckpointDir(named)
    return named
