"""Sinks: records as JSON, texts by product, caches, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.recognise import latest


def record_json(record: Column) -> Column:
    """A record as JSON with all its fields, nulls kept, in the record's order."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def write_records(records: DataFrame, path: str) -> None:
    """One JSON line a product, product_key in the folder's name."""
    records.select("product_key", record_json(F.col("record")).alias("value")).write.mode("overwrite").partitionBy("product_key").text(path)


def product_texts(lines: DataFrame) -> DataFrame:
    """product_key, value: a product's texts in blocks, each headed by its image. lines: product_key, image, line_no, text."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    blocks = lines.groupBy("product_key", "image").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    each = F.array_sort(F.collect_list(F.struct("image", "text")))
    return blocks.groupBy("product_key").agg(F.array_join(F.transform(each, lambda b: F.concat(F.lit("=== "), b["image"], F.lit(" ===\n"), b["text"])), "\n\n").alias("value"))


def write_texts(lines: DataFrame, path: str) -> None:
    product_texts(lines).write.mode("overwrite").partitionBy("product_key").text(path)


def append_cache(rows: DataFrame, path: str) -> None:
    """Append cache rows with the time of writing as their order."""
    rows.withColumn("seq", F.unix_micros(F.current_timestamp())).write.mode("append").parquet(path)


def compacted(cache: DataFrame) -> DataFrame:
    """The last row of each key and engine."""
    return latest(cache)


def write_report(report: DataFrame, path: str, command: str) -> None:
    """A report with the time and command that made it, in place of the last one."""
    report.withColumns({"made_at": F.current_timestamp(), "command": F.lit(command)}).write.mode("overwrite").parquet(path)


def write_catalog(rows: DataFrame, path: str) -> str:
    """Rows as CSV files with a header, as readers.catalog_csv reads them; the path is given back."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path
