"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source are shuffled by a hash and laid end to end; the stream is cut into blocks
of equally many words. Slot i of the mix belongs to the source in whose share of the unit interval
the golden-ratio point frac(i * phi) falls; the k-th slot of a source takes the k-th block of its
stream, which starts again once it is used up. A last slot is cut so that a source gives exactly
its target. Points are 40-bit integers, so that every machine gives the same schedule; prefix sums
are taken in two levels, so that no task orders the documents or slots of a source.

Defined results: a null text has size 0; sources are ordered by code point with null last; a
document without words takes part with nothing; repeated rows are documents of their own, of which
any may come first; null and repeated ids are shuffled by their texts; very long texts are cut into
blocks like others; empty tables give empty mixes; other columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, released, stored

POINTS = 2**40  # points of the schedule, and slots that it can have
GOLDEN = int(POINTS * (5**0.5 - 1) / 2) | 1  # odd: i -> i * GOLDEN mod POINTS meets every point once
CELLS = 4096  # equal parts of the unit interval by which slots meet their sources
CHUNK = 4096  # slots that are ranked together
SPAN = 4096  # rows that are summed together in a prefix sum
BUCKET = 1024  # documents of a source that are laid out together


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row a source: number, n_docs, source_size, target.

    sizes has source and size. Weights repeat over the sources in order; together the sources give
    `share` of all words, none more than `most` times its own; what a capped source can't give is
    shared out by weight among the others. One row a source is ordered in one task.
    """
    totals = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = totals.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    capped = weighed.select("*", (most * F.col("source_size")).cast("double").alias("cap")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "number").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    leveled = capped.withColumn("level", level)
    # Sources below the water level are full; the first that isn't fixes the level for all others.
    free = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "number", "level"))).over(everything)
    full = F.struct("ratio", "number") < F.struct(free["ratio"], free["number"])
    return leveled.select("source", "number", "n_docs", "source_size", F.when(full, F.col("cap")).otherwise(F.least("cap", free["level"] * F.col("weight"))).alias("target"))


def _point(slot: Column) -> Column:
    """slot * GOLDEN mod POINTS, in two halves of 20 bits so that no product exceeds 64 bits."""
    low, high = slot.bitwiseAND(2**20 - 1), F.shiftright(slot, 20).bitwiseAND(2**20 - 1)
    return (low * GOLDEN + F.shiftleft(high * (GOLDEN % 2**20) % 2**20, 20)).bitwiseAND(POINTS - 1)


def _before(rows: DataFrame, at: str, value: str, into: str) -> DataFrame:
    """rows plus the sum of value over the rows of the same number that come earlier by `at`."""
    running = lambda by, order, x: F.coalesce(F.sum(x).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = rows.withColumn("__far", F.expr(f"{at} div {SPAN}"))
    far = wide.groupBy("number", "__far").agg(F.sum(value).alias("__sum"))
    base = far.select("number", "__far", running(["number"], "__far", "__sum").alias("__base"))
    near = wide.withColumn(into, running(["number", "__far"], at, value))
    return near.join(base, ["number", "__far"]).withColumn(into, F.col(into) + F.col("__base")).drop("__far", "__base")


def _slots(targets: DataFrame, block: int) -> DataFrame:
    """The schedule: position of each slot in the mix, its source's number and rank."""
    spark = targets.sparkSession
    asked = targets.select("number", F.floor("target").cast("long").alias("words")).withColumn("blocks", F.ceil(F.col("words") / block).cast("long"))
    n = asked.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    if n > POINTS:
        raise ValueError(f"{n} slots; block_words has to be raised to keep them to 2**40")
    until = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = F.floor(F.sum("words").over(until) / F.greatest(F.lit(1), F.sum("words").over(everything)) * float(POINTS)).cast("long")
    edges = asked.select("*", edge.alias("high")).withColumn("low", F.lag("high", 1, 0).over(Window.orderBy("number")))
    width = POINTS // CELLS
    spans = edges.where("high > low").select("number", "low", "high", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), _point(F.col("id")).alias("point")).withColumn("cell", F.expr(f"point div {width}"))
    drawn = points.join(spans, "cell").where("point >= low and point < high").select("slot", "number", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = drawn.groupBy("number", "chunk").count()
    offsets = _before(counts, "chunk", "count", "offset").select("number", "chunk", "offset")
    ranked = drawn.withColumn("k", F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot")) - 1).join(offsets, ["number", "chunk"]).select("slot", "number", (F.col("offset") + F.col("k")).alias("rank"))
    # A source that the points gave a block or two too few gets them after the others.
    given = counts.groupBy("number").agg(F.sum("count").alias("given"))
    missing = asked.join(given, "number", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < blocks")
    late = missing.select("number", F.explode(F.sequence(F.col("given"), F.col("blocks") - 1)).alias("rank")).select((F.lit(n) + F.col("rank")).alias("slot"), "number", "rank")
    return ranked.unionByName(late)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block_words: int = 64, seed: int = 20, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix of docs (doc_id, text, source), and the documents with their sources' targets.

    The mix has one row for each part of a document in a block: slot, row, doc_id, pass (0 for the
    first use of the document), from_word, to_word. The documents have row, doc_id, source, size,
    source_size and target; `row` tells repeated rows apart: a column of docs, if one is named.

    block_words is the schedule's grain; there can be up to 2**40 slots.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    hash_ = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    numbers = F.monotonically_increasing_id() if row is None else F.col(row)
    sizes = stored(docs.select("doc_id", "source", size.alias("size"), hash_.alias("hash"), numbers.alias("row")), "sizes")
    targets = stored(source_targets(sizes, weights, share, most), "targets")
    released(docs.sparkSession)
    documents = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select("row", "doc_id", sizes["source"], "size", "hash", "number", "n_docs", "source_size", "target")

    buckets = F.ceil(F.col("n_docs") / BUCKET).cast("long")
    placed = documents.withColumn("bucket", F.shiftright(F.shiftrightunsigned("hash", 33) * buckets, 31))
    held = placed.groupBy("number", "bucket").agg(F.sum("size").alias("words"))
    starts = _before(held, "bucket", "words", "start").select("number", "bucket", "start")
    inside = Window.partitionBy("number", "bucket").orderBy(F.shiftrightunsigned("hash", 1), "doc_id", "size", "row")
    laid = placed.withColumn("ahead", F.sum("size").over(inside) - F.col("size")).join(starts, ["number", "bucket"])
    used = (
        laid.where("size > 0")
        .select("row", "doc_id", "number", "size", F.floor("target").cast("long").alias("words"), "source_size", (F.col("start") + F.col("ahead")).alias("at"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"))
        .withColumn("first", F.col("at") + F.col("pass") * F.col("source_size"))
        .where("first < words")
        .withColumn("end", F.least(F.col("first") + F.col("size"), "words"))
    )
    parts = used.select("*", F.explode(F.sequence(F.expr(f"first div {block_words}"), F.expr(f"(end - 1) div {block_words}"))).alias("rank"))
    joined = parts.join(_slots(targets, block_words), ["number", "rank"])
    mixed = joined.select(
        "slot",
        "row",
        "doc_id",
        "pass",
        (F.greatest(F.col("first"), F.col("rank") * block_words) - F.col("first")).alias("from_word"),
        (F.least(F.col("end"), (F.col("rank") + 1) * block_words) - F.col("first")).alias("to_word"),
    )
    return mixed, documents.select("row", "doc_id", "source", "size", "source_size", "target")
