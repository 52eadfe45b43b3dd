"""Evaluation reports as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity

PANEL_FIELDS = ("Mrp", "Fssai No", "Upc / Ean", "Manufacturer")
CATALOG_IMAGES, PAID_USD = 20_746, 0.0015


def field_recall(checks: DataFrame) -> DataFrame:
    """field, n, pre, raw and shares; the row of a null field is over all. checks: field, pre, raw (null: no value)."""
    known = checks.where("pre is not null")
    totals = known.rollup("field").agg(F.count("*").alias("n"), F.sum(F.col("pre").cast("int")).alias("pre"), F.sum(F.col("raw").cast("int")).alias("raw"))
    return totals.select(F.coalesce("field", F.lit("OVERALL")).alias("field"), "n", "pre", "raw", (F.col("pre") / F.col("n")).alias("pre_share"), (F.col("raw") / F.col("n")).alias("raw_share"))


def escalation(reads: DataFrame, images: int = CATALOG_IMAGES, cost: float = PAID_USD) -> DataFrame:
    """Reads, weak reads, their share, projected paid cost, reads with non-ASCII text. reads: reason, non_latin."""
    rate = F.avg(F.col("reason").isNotNull().cast("double"))
    return reads.agg(F.count("*").alias("n"), F.count("reason").alias("weak"), rate.alias("rate"), (rate * images * cost).alias("projected_usd"), F.count_if("non_latin").alias("non_latin"))


def recall_vs_ceiling(checks: DataFrame) -> DataFrame:
    """field, in_truth, reachable, got, shares of both. checks: field, got (null: no value), panel."""
    reach = F.when(F.col("field").isin(*PANEL_FIELDS), F.col("panel")).otherwise(F.lit(True))
    sums = checks.where("got is not null").groupBy("field").agg(F.count("*").alias("in_truth"), F.count_if(reach).alias("reachable"), F.count_if("got").alias("got"))
    return sums.select("*", F.try_divide("got", "in_truth").alias("recall"), F.try_divide("got", "reachable").alias("recall_of_reachable"))


def distinct_views(images: DataFrame) -> DataFrame:
    """listed, distinct, duplicates, products. images: product_key, content_key."""
    one = images.groupBy("product_key").agg(F.count("*").alias("listed"), F.countDistinct("content_key").alias("distinct"))
    return one.agg(F.sum("listed").alias("listed"), F.sum("distinct").alias("distinct"), F.sum(F.col("listed") - F.col("distinct")).alias("duplicates"), F.count("*").alias("products"))


def extraction_report(scores: DataFrame) -> DataFrame:
    """field, n, f1, coverage, f1 of fields filled on one side, both empty. scores: field, f1, truth_blank, guess_blank."""
    empty = F.col("truth_blank") & F.col("guess_blank")
    return scores.groupBy("field").agg(
        F.count("*").alias("n"),
        F.avg("f1").alias("f1"),
        F.avg((~F.col("guess_blank")).cast("double")).alias("coverage"),
        F.avg(F.when(~empty, F.col("f1"))).alias("f1_filled"),
        F.count_if(empty).alias("both_empty"),
    )


def macro_f1(report: DataFrame) -> DataFrame:
    return report.agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("fields"))


def engine_comparison(reads: DataFrame) -> DataFrame:
    """Totals by engine. reads: engine, product_key, found, reachable, chars, cjk, devanagari, seconds, failed."""
    return reads.groupBy("engine").agg(
        F.countDistinct("product_key").alias("products"),
        F.sum("found").alias("found"),
        F.try_divide(F.sum("found"), F.sum("reachable")).alias("of_reachable"),
        F.sum("chars").alias("chars"),
        F.sum("cjk").alias("cjk"),
        F.sum("devanagari").alias("devanagari"),
        F.try_divide(F.sum("seconds"), F.countDistinct("product_key")).alias("seconds_a_product"),
        F.count_if("failed").alias("errors"),
    )


def hard_subset(reads: DataFrame, engine: str) -> DataFrame:
    """engine_comparison over the products whose read by one engine is weak. reads: also reason."""
    hard = reads.where((F.col("engine") == engine) & F.col("reason").isNotNull()).select("product_key").distinct()
    return engine_comparison(reads.join(hard, "product_key", "left_semi"))


def paired(truth: DataFrame, guess: DataFrame) -> DataFrame:
    """product_key, truth, guess, precision, recall, f1 of the products that both (product_key, record) have.

    Here and in field_summary scores are rounded to four places as SQL does, half away from zero.
    """
    both = truth.select("product_key", F.col("record").alias("truth")).join(guess.select("product_key", F.col("record").alias("guess")), "product_key")
    return both.withColumn("s", similarity.score_records(F.col("truth"), F.col("guess"), rounded=False)).select("product_key", "truth", "guess", *(F.round(F.col("s")[c], 4).alias(c) for c in ("precision", "recall", "f1")))


def score_summary(pairs: DataFrame) -> DataFrame:
    """products and the means of precision, recall and f1."""
    return pairs.agg(F.count("*").alias("products"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))


def field_summary(pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, n, f1, coverage over pairs' records; a field blank on both sides counts as found."""
    scores = F.coalesce(similarity.score_fields(F.col("truth"), F.col("guess"), rounded=False), F.create_map().cast("map<string,double>"))
    each = pairs.select(scores.alias("s"), F.from_json("guess", "map<string,string>").alias("g"))
    rows = each.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.round(F.coalesce(F.col("s")[f], F.lit(1.0)), 4).alias("f1"), F.col("g")[f].isNotNull().cast("double").alias("filled")) for f in fields))).alias("m")).select("m.*")
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.avg("f1").alias("f1"), F.avg("filled").alias("coverage"))


def barcode_funnel(results: DataFrame) -> DataFrame:
    """Counts along the barcode pipeline, one row a product.

    results: product_key, code, source, valid, truth (13 digits), lookup_source, unverified, closeness, brand_match.
    """
    loose = F.col("code").isNull() & F.col("unverified").isNotNull()
    return results.agg(
        F.count("*").alias("products"),
        F.count_if(F.col("source") == "bars").alias("bars"),
        F.count_if("valid").alias("valid"),
        F.count_if(F.col("valid") & (F.col("code") == F.col("truth"))).alias("exact"),
        F.count_if(F.col("lookup_source") == "primary").alias("found_primary"),
        F.count_if(F.col("lookup_source") == "secondary").alias("found_secondary"),
        F.count_if(loose).alias("unverified"),
        F.avg(F.when(loose, F.col("closeness"))).alias("closeness"),
        F.count_if(loose & (F.col("closeness") >= 0.85)).alias("near_misses"),
        F.avg("brand_match").alias("brand_match"),
        F.count_if(F.col("brand_match") < 0.5).alias("brand_low"),
    )


def recovery_by_setup(hits: DataFrame) -> DataFrame:
    """setup, products, recovered: a product counts where any image hits. hits: setup, product_key, hit."""
    one = hits.groupBy("setup", "product_key").agg(F.max(F.col("hit").cast("int")).alias("hit"))
    return one.groupBy("setup").agg(F.count("*").alias("products"), F.sum("hit").alias("recovered"))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("engine").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def latency_summary(calls: DataFrame, key: str = "tier") -> DataFrame:
    """key, n, least, mean, upper median and most seconds. calls: key, seconds.

    The median is the exact upper one, from a count and a rank in each group's value counts.
    """
    counts = calls.groupBy(key, "seconds").agg(F.count("*").alias("c"))
    total = counts.groupBy(key).agg(F.sum("c").alias("n"), F.min("seconds").alias("least"), (F.sum(F.col("c") * F.col("seconds")) / F.sum("c")).alias("mean"), F.max("seconds").alias("most"))
    run = F.sum("c").over(Window.partitionBy(key).orderBy("seconds"))
    at = counts.withColumn("run", run).join(total.select(key, "n"), key).where(F.col("run") > F.floor(F.col("n") / 2)).groupBy(key).agg(F.min("seconds").alias("median"))
    return total.join(at, key)


def confusion(cells: DataFrame, classes: list[str]) -> DataFrame:
    """field and a count of each class. cells: field, outcome."""
    return cells.groupBy("field").pivot("outcome", classes).count().na.fill(0)
