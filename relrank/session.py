"""Session settings and stages stored in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot docid or qid even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Runs are small in bytes, but each row costs a look at a document: let AQE keep many small tasks.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


def get_session(app: str = "relrank", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="relrank-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def stage_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; ``release`` removes it."""
    return f"{shared_dir(spark)}/relrank-{spark.sparkContext.applicationId}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Store ``df`` as Parquet in the shared folder, which cuts its lineage, and read it back. ``release`` removes it."""
    path = f"{stage_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove the stages that this application has stored; call it when all results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
