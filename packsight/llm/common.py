"""Helpers shared by the corpus operators: word rule, shared storage, Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import shared_dir, stored  # noqa: F401

#: A word is a longest run without these six characters (space, tab, LF, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """All words of a text in order; no words for a null or empty text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run), with this package sent to the executors first."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    while name in df.columns:
        name += "_"
    return name


def dropped(df: DataFrame) -> None:
    """Delete the files behind a frame from stored() that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if f"{shared_dir(spark)}/packsight/".split("://")[-1] in path.toString():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array) -> pa.Array:
    """A string column as bytes, without decoding it."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of the column, or a single row."""
    for batch in batches:
        values = batch.column(column)
        start, held = 0, 0
        for row, length in enumerate(pa.compute.binary_length(utf8(values)).to_pylist()):
            if held and held + (length or 0) > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def released(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished queries, which it does after a collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
