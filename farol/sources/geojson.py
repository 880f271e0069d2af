"""Feature properties of GeoJSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farol.functions.text import accent_key

PROPERTIES = T.MapType(T.StringType(), T.StringType())
FEATURES = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", PROPERTIES)])))])
#: What stands before the properties of every feature.
MARK = '"properties"'


def _whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(properties) of the features of files that are read whole, a file in one task."""
    return spark.read.schema(FEATURES).option("multiLine", True).json(paths).select(F.explode("features").alias("f")).select("f.properties")


def feature_properties(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(properties) of every feature; shapes are not parsed.

    A collection is one large array, often on one line. It is cut where a feature's properties begin, which the text source
    finds in every part of a file, so a large file is read by many tasks. The object after the mark is parsed, the rest of the
    piece (the shape, the next feature's start) is passed over. Files in which a piece is no whole object, as the mark stands
    inside properties, are read whole.
    """
    # what stands before the first mark of a file is no feature, and neither is what follows no colon
    pieces = spark.read.option("lineSep", MARK).text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"(?s)^\s*:\s*(\{.*)", 1).alias("piece")).where("piece != ''")
    parsed = pieces.select("path", F.from_json("piece", PROPERTIES, {"mode": "PERMISSIVE"}).alias("properties"))
    odd = [r["path"] for r in parsed.where(F.col("properties").isNull()).select("path").distinct().toLocalIterator()]
    if not odd:
        return parsed.select("properties")
    return parsed.where(~F.col("path").isin(odd)).select("properties").unionByName(_whole(spark, odd))


def feature_names(spark: SparkSession, paths: list[str], name: str = "name") -> DataFrame:
    """Name of every feature, '' without one, and its accent-free key."""
    return feature_properties(spark, paths).select(F.coalesce(F.col("properties")[name], F.lit("")).alias("name")).withColumn(
        "name_key", accent_key(F.col("name")))
