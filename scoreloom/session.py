"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"   # a query's shuffles go when it ends

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, name: str = "scoreloom") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(cores))
        # Small test tables: keep a task per core instead of one per megabyte.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "12g")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The context's checkpoint folder, else the one named in the configuration. Only a local master may do
    without: a folder of this machine is of no use to the executors of a cluster.
    """
    context = spark.sparkContext
    base = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="scoreloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def is_local(master: str) -> bool:
    """Do driver and executors live in one process?"""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, conf: dict[str, str] | None = None) -> DataFrame:
    """The rows, made once and read back from a compressed table in the shared folder; ``conf`` holds while they are made.

    What was shuffled on the way there is deleted as soon as the table stands, so a chain of stored tables takes the disk
    of its tables and of one step. Rows that a file cannot hold as they are, go to a checkpoint.
    """
    spark = df.sparkSession
    names = [c.lower() for c in df.columns]
    conf = {RELEASE: "true"} | (conf or {})
    held = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        if len(set(names)) < len(names) or any("void" in t or "interval" in t for _, t in df.dtypes):
            shared_dir(spark)
            return df.checkpoint()
        path = scratch_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in held.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
