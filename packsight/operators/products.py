"""Products from image names: parsing, grouping, ground-truth pairing, first-wins lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

NAME = r"(?i)^Image_([0-9]+)_(.+)\.jpg$"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def product_key(path: Column) -> Column:
    """The product's part of an image name; null for other names."""
    return F.nullif(F.regexp_extract(file_name(path), NAME, 2), F.lit(""))


def view_number(path: Column) -> Column:
    """The view of an image name; 0 for other names."""
    return F.coalesce(F.regexp_extract(file_name(path), NAME, 1).try_cast("int"), F.lit(0))


def group_images(images: DataFrame) -> DataFrame:
    """product_key and its images' names by view: one row a product. images: path."""
    parsed = images.select(product_key(F.col("path")).alias("product_key"), F.struct(view_number(F.col("path")).alias("view"), F.col("path").alias("path")).alias("v"))
    grouped = parsed.where("product_key is not null").groupBy("product_key").agg(F.array_sort(F.collect_list("v")).alias("views"))
    return grouped.select("product_key", F.transform("views", lambda v: v["path"]).alias("images"))


def listed_names(truth: DataFrame, key: str = "row_id") -> DataFrame:
    """key, position, name of every filled column whose name contains "Filename"."""
    columns = [c for c in truth.columns if "Filename" in c]
    if not columns:
        return truth.select(key, F.lit(0).alias("position"), F.lit("").alias("name")).limit(0)
    names = F.array(*(F.struct(F.lit(k).alias("position"), tx.blank_to_null(F.col(f"`{c}`")).alias("name")) for k, c in enumerate(columns)))
    return truth.select(key, F.explode(names).alias("n")).where("n.name is not null").select(key, "n.position", "n.name")


def images_of_rows(listed: DataFrame, images: DataFrame, key: str = "row_id") -> DataFrame:
    """key, image, view: all images of the product that a row's first parsable name is of.

    Rows none of whose names parses get their own names back. images: path.
    """
    seeds = listed.withColumn("product_key", product_key(F.col("name")))
    first = seeds.where("product_key is not null").groupBy(key).agg(F.min_by("product_key", "position").alias("product_key"))
    parsed = images.select("path", product_key(F.col("path")).alias("product_key"), view_number(F.col("path")).alias("view")).where("product_key is not null")
    found = first.join(parsed, "product_key").select(key, F.col("path").alias("image"), "view")
    rest = listed.join(first, key, "left_anti").select(key, F.col("name").alias("image"), view_number(F.col("name")).alias("view"))
    return found.unionByName(rest)


def existing(names: DataFrame, images: DataFrame, column: str = "image") -> DataFrame:
    """Only names that are among the images (a semi join)."""
    return names.join(images.select(file_name(F.col("path")).alias(column)).distinct(), column, "left_semi")


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the first in the given order."""
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("__k = 1").drop("__k")


def strongest_barcode(results: DataFrame) -> DataFrame:
    """One result a product: a bar decode before others, then the first view. results: product_key, view, source, code, ..."""
    best = F.min_by(F.struct(*[c for c in results.columns if c != "product_key"]), F.struct((F.col("source") != "bars").cast("int"), F.col("view"))).alias("b")
    return results.where("code is not null").groupBy("product_key").agg(best).select("product_key", "b.*")


def text_union(lines: DataFrame, keep_blank: bool = False) -> DataFrame:
    """product_key, text: a product's line texts in order, joined by line ends."""
    kept = lines if keep_blank else lines.where(tx.strip(F.col("text")) != "")
    ordered = F.array_sort(F.collect_list(F.struct("view", "crop", "line_no", "text")))
    return kept.groupBy("product_key").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def coalesced_lookup(codes: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """code, name, brand, lookup_source from two tables (code, name, brand); the second serves misses only.

    A row without name and brand is a cached miss.
    """
    known = lambda t: t.where("name is not null or brand is not null").dropDuplicates(["code"])
    one = codes.join(known(primary).withColumn("lookup_source", F.lit("primary")), "code", "left")
    missed = one.where("lookup_source is null").select(*codes.columns)
    two = missed.join(known(secondary).withColumn("lookup_source", F.lit("secondary")), "code", "left")
    return one.where("lookup_source is not null").unionByName(two)
