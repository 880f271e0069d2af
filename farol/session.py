"""Session set-up, shared scratch folder and the report date."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings every job here relies on; all can be set on a live session.
RUNTIME_CONF = {
    # date and timestamp text is parsed and shown in UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when an aggregate on the same key follows
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # HotSpot leaves methods above 8,000 bytes to its interpreter; such stages run faster operator by operator
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # long values reach Python a few at a time
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # results that are fetched part by part read their shuffle files after the query counts as ended
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "false",
    # a re-run of one source file replaces that file's partition only
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "farol", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder;
    on a cluster a machine-local folder would not be seen by the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="farol-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder below the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_of_date(as_of: dt.date | str | None = None) -> Column:
    """Report date: a given day, or the current date when none is given."""
    if as_of is None:
        return F.current_date()
    return F.lit(str(as_of)).cast("date")


def discard(spark: SparkSession, *folders: str) -> None:
    """Remove staged folders that no later job reads."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files: for writes, whose results nobody fetches afterwards."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def staged(df: DataFrame, name: str, **options: str) -> tuple[str, DataFrame]:
    """Write to the shared scratch folder and read back: later steps start from the files."""
    folder = scratch_dir(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.options(**options).parquet(folder)
    return folder, df.sparkSession.read.schema(df.schema).parquet(folder)
