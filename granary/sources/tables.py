"""Fixture tables, the shared folder and lineage cuts."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` below ``sf_dir``, by Spark's reader only, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the session names none and all runs on one machine (tests, a laptop) is a local one set; a cluster without one is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="granary-checkpoints-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def stage_boundary(df: DataFrame, release: bool = False) -> DataFrame:
    """Write df to the shared folder and cut its lineage there.

    A lost executor then costs a re-read of this boundary, not the work behind it.
    release lets go of the shuffle files of that work at once: Spark drops them when the driver collects the plan that made them.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint()
    del df
    if release:
        gc.collect()
        spark._jvm.System.gc()
    return out
