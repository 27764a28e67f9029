"""Table access and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One Parquet table of a data directory, pruned to ``columns`` where given (the scan then reads only those)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a local one is set only where a local session has none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("a cluster has no machine-local checkpoints: set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="acervo-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in shared storage; the work is done once and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
