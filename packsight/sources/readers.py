"""Readers: catalog CSV, image listings and pixels, declared schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with every column as text (ids keep their digits), and row_id in file order."""
    header = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header.columns])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumn("row_id", F.monotonically_increasing_id())


def image_listing(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """path, length and modification time of image files; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def image_files(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """Image files with their bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (Spark's image source; bytes are BGR or BGRA)."""
    return spark.read.format("image").option("dropInvalid", True).load(path)


def format_report(pixels: DataFrame, listing: DataFrame) -> DataFrame:
    """path, width, height, megapixels, channels, transparent, kilobytes of each image."""
    sized = pixels.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.round(F.col("image.width") * F.col("image.height") / 1e6, 2).alias("megapixels"), F.col("image.nChannels").alias("channels"), (F.col("image.nChannels") == 4).alias("transparent"))
    return sized.join(listing.select("path", F.round(F.col("length") / 1024, 1).alias("kilobytes")), "path", "left")


def declared_schema(text: str) -> T.StructType:
    """A declared field list ({"fields": [{name, type, required}]}) as a schema."""
    kinds = {"string": T.StringType(), "boolean": T.BooleanType(), "number": T.DoubleType()}
    return T.StructType([T.StructField(f["name"], kinds.get(f.get("type"), T.StringType()), not f.get("required", False), {"description": f.get("description", "")}) for f in json.loads(text)["fields"]])
