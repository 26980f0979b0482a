"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings of the README; pass ``master`` only for local work."""
    builder = SparkSession.builder.appName("logtel")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the configured checkpoint folder.

    Only a session inside one process (``local[n]``) without one gets a temporary
    folder of its own; wherever executors are processes of their own a missing
    setting is an error, as a machine-local folder would be lost together with
    its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Whether Parquet files get VARIANT members as columns of their own, which costs more than reading documents whole.
SHREDDING = "spark.sql.variant.inferShreddingSchema"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, whatever reads it afterwards, and only the columns that are read."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(SHREDDING, None)
    spark.conf.set(SHREDDING, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHREDDING) if before is None else spark.conf.set(SHREDDING, before)
    return spark.read.schema(df.schema).parquet(path)


def ship_package() -> None:
    """Send this package's functions along with the tasks that use them.

    Python workers, and the driver-side ones of stateful streams, need not have
    the package on their path then.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
