"""Session settings, staging in the shared folder and input columns for the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farol.session import prepare, staged

SETTINGS = {
    # the files of a shuffle go as soon as the job that wrote them ends; what later jobs need is staged as a table
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Python tasks get small batches whatever the length of the texts
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings that these operators rely on."""
    prepare(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


class Stages:
    """Intermediate tables of one run in the folder of ``spark.checkpoint.dir``, removed once they are used up.

    A table is written by one job and read by the next, which cuts lineage: an executor lost later
    costs the tasks of the running job only.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def put(self, name: str, df: DataFrame, **options: str) -> DataFrame:
        self.folders[name], table = staged(df, name, **options)
        return table

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folders.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *prefixes: str) -> None:
        """Drop all tables but those whose name starts with one of the prefixes."""
        self.drop(*[name for name in self.folders if not name.startswith(prefixes)])


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that document operators read; further columns of any name are ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


Job = Callable[[SparkSession, str], DataFrame]
