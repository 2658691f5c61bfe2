"""A Spark session with the settings that this engine expects, and tables that outlive a stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lrforge", **settings: str) -> SparkSession:
    """Adaptive execution, UTC and ANSI on; what the caller or the cluster sets comes first."""
    builder = SparkSession.builder.appName(app)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which all executors share.

    Where it is unset, a local session gets a temporary folder of its own; on a
    cluster, where such a folder isn't shared, that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-lrforge-"))
    return sc.getCheckpointDir()


class Scratch:
    """Tables in the shared folder for the time of a `with` block; those that are kept stay, all others go at its end.

    Tables are read by plans later than they are made, so a result that leaves the block
    must be kept.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame) -> DataFrame:
        """Written and read back; Spark knows its size then."""
        self.n += 1
        return self._written(df, f"{self.root}/{self.n}")

    def kept(self, df: DataFrame) -> DataFrame:
        return self._written(df, f"{self.root}-result")

    def __exit__(self, *_: object) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
