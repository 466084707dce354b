"""Session factory and the settings every job shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "guestlens", **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on. Extra settings: keyword `conf` with `__` for dots."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is unset (tests, a single machine) a local folder is made and set.
    """
    d = spark.conf.get(CHECKPOINT_CONF, None)
    if not d:
        d = spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        d = "file://" + os.path.join(tempfile.gettempdir(), "guestlens-shared")
        spark.conf.set(CHECKPOINT_CONF, d)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that cuts lineage."""
    path = f"{shared_dir(spark)}/guestlens-{name}-{uuid.uuid4().hex[:12]}"
    SCRATCH.append(path)
    return path


SCRATCH: list[str] = []


def remove_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables of this process; call it once the results that read them are written or collected."""
    while SCRATCH:
        p = spark._jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_at_most(df: DataFrame, n: int) -> bool:
    """Whether df has at most n rows; reads no more than n + 1 of them."""
    return df.limit(n + 1).count() <= n
