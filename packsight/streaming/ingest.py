"""Incremental recognition: new payloads are read once and merged into the cache table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.recognise import Engine, cached, run_engine
from ..sources.writers import append_cache


def ingest(source: DataFrame, engine: Engine, cache_path: str, checkpoint: str, review_path: str | None = None, least: float = 0.65) -> StreamingQuery:
    """Start a query over a stream of (key, payload) rows.

    Each batch calls the engine for keys without a usable cache row and appends the results. A batch
    that is run again finds its rows in the cache. Reads below the least confidence are also written
    to review_path.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark: SparkSession = rows.sparkSession
        todo = rows.dropDuplicates(["key"])
        if spark._jvm.org.apache.hadoop.fs.Path(cache_path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(cache_path)):
            todo = todo.join(cached(spark.read.parquet(cache_path), engine.name), "key", "left_anti")
        append_cache(run_engine(todo, engine), cache_path)
        if review_path:
            mine = cached(spark.read.parquet(cache_path), engine.name).join(rows.select("key").distinct(), "key", "left_semi")
            weak = F.size(F.filter("lines", lambda x: x["confidence"] < least)) > 0
            mine.where(weak | (F.size("lines") == 0)).withColumn("batch", F.lit(number)).write.mode("append").parquet(review_path)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def engine_costs(calls: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Calls and cost by engine and time window of a stream of (ts, engine, cost_usd) rows."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", window), "engine").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"))
