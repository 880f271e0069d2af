"""JDBC queries and appends. Addresses and credentials come from the caller."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Split:
    """Numeric or date column that divides a read into parallel ranges."""

    column: str
    lower: str
    upper: str
    parts: int


# Time limits in seconds of the reading clients, rows per insert statement.
CONNECT_SECONDS = 10
SOCKET_SECONDS = 10
INSERT_ROWS = 2000


def read_options(url: str, sql: str, split: Split | None = None, **options: str) -> dict[str, str]:
    """Reader options; a split read needs the query as a derived table."""
    out = {"url": url, "connectTimeout": str(CONNECT_SECONDS), "socketTimeout": str(SOCKET_SECONDS),
           "queryTimeout": "0", **options}
    text = sql.strip().rstrip(";")
    if split is None:
        return {**out, "query": text}
    return {**out, "dbtable": f"({text}) q", "partitionColumn": split.column, "lowerBound": split.lower,
            "upperBound": split.upper, "numPartitions": str(split.parts)}


def read_query(spark: SparkSession, url: str, sql: str, split: Split | None = None, **options: str) -> DataFrame:
    """Result of one SQL text; a LIMIT inside it runs in the database."""
    return spark.read.format("jdbc").options(**read_options(url, sql, split, **options)).load()


def append_table(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Append rows in batched inserts."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(INSERT_ROWS), **options).mode("append").save()
