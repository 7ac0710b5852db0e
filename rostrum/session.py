"""Session and materialisation helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rostrum", cpus: int | None = None) -> SparkSession:
    """Session for local tests and benches; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        # Hash-aggregate up to 10,000 groups per task before sorting instead (default 128).
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "10000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint that survives the loss of executors.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A scratch
    folder stands in for it only on a local master, where all tasks share the machine.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name in the storage that all executors share."""
    spark_dir = spark.conf.get("spark.checkpoint.dir", None)
    if spark_dir is None:
        materialize(spark.range(1))  # settles the checkpoint folder of a local session
        spark_dir = spark.sparkContext.getCheckpointDir()
    return f"{spark_dir.rstrip('/')}/rostrum-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and the planner knows the size."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
