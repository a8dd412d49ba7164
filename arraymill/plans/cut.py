"""Cutting lineage in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one beside the warehouse's tables.

    The setting is static, so it is read and never set. A warehouse in a machine's own file system serves
    only where all tasks run on that machine; elsewhere an error asks for the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    place = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_arraymill"
    scheme = spark._jvm.org.apache.hadoop.fs.Path(place).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme()
    if scheme == "file" and not spark.sparkContext.master.startswith("local"):
        raise ValueError("executors do not share the warehouse's folder: set spark.checkpoint.dir to one that they do")
    return place


def cut(df: DataFrame) -> DataFrame:
    """``df`` as computed once and kept in the checkpoint folder.

    Two uses of a plan may sample other ranges and number partitions otherwise; two uses of this
    don't, and a lost executor costs no more than reading again.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, *key: str) -> DataFrame:
    """``df`` dealt out by its key, for work that costs far more than a table's bytes say: Spark gives a small file to few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *key)


class Tables:
    """Tables of one computation, in a folder of their own in the shared place, until nothing reads them any more.

    What a table's writing shuffled is deleted with its end, not with the driver's next collection of garbage. A reader
    takes a file's rows at once where they pack well, so large ones need a number of ``rows`` to a file.
    """

    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str, rows: int = 0):
        self.spark, self.rows, self.folder = spark, rows, f"{checkpoint_folder(spark)}/arraymill/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, *by: str) -> str:
        """The table's path; one for each value of ``by`` lies below it."""
        path, before = f"{self.folder}/{uuid.uuid4().hex}", self.spark.conf.get(self._CLEANUP)
        self.spark.conf.set(self._CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").option("maxRecordsPerFile", self.rows).partitionBy(*by).parquet(path)
        finally:
            self.spark.conf.set(self._CLEANUP, before)
        return path

    def read(self, schema: str, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def drop(self, *paths: str) -> None:
        for path in paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
