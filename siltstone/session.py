"""Session factory."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the engine's results rely on: UTC, adaptive execution, ANSI mode."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("_", "."): v for k, v in conf.items()},
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there: its lineage ends, and a lost executor costs nothing.

    The folder is spark.checkpoint.dir; a local session that has none gets one.
    """
    _shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the checkpoint folder: as settled(), but by columns and compressed, and without order or partitions.

    It goes when the driver ends.
    """
    spark = df.sparkSession
    at = f"{_shared(spark)}/rows-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)
    files.deleteOnExit(path)
    df.write.parquet(f"{at}/files")
    return spark.read.schema(df.schema).parquet(f"{at}/files")


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="siltstone-"))
    return context.getCheckpointDir().rstrip("/")
