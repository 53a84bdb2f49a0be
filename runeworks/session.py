"""Session settings and the cutting of lineage."""

from __future__ import annotations

import os

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("runeworks")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("RUNEWORKS_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and cut its lineage.

    The folder named by ``spark.checkpoint.dir`` is shared by all executors, so
    the result outlives a lost executor. Only on one machine, as in tests, a missing setting
    is replaced by a folder of the warehouse directory; a cluster without it is an error.
    Set ``spark.cleaner.referenceTracking.cleanCheckpoints``, as :func:`local_session` does,
    to have the files removed once nothing refers to them.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.sparkContext.setCheckpointDir(base + "/_checkpoints")
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that is heavy on the CPU.

    Only an input read in fewer partitions than cores is moved, and as one partition holds at
    most ``spark.sql.files.maxPartitionBytes``, that input is small. Larger ones stay as read.
    """
    try:
        cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    except PySparkException:  # a client without access to the plan leaves the rows as they are
        return df
    return df.repartition(cores) if parts < cores else df
