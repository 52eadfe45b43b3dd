"""Compositions: barcode validation, extraction modes, sampling, retried JSON engines."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import barcode, geometry, similarity
from ..shipping import ship
from . import images, labels, products, rules
from .recognise import Ladder


def read_crops(crops: DataFrame, ladder: Ladder, cache: DataFrame | None = None) -> DataFrame:
    """Lines of crops (key, payload and any of product_key, view, crop, arm): one row a line.

    Equal crops are read once, whatever products, views or arms (prepared or raw) they belong to.
    """
    places = [c for c in crops.columns if c != "payload"]
    reads = ladder.read(crops.select("key", "payload"), cache).select("key", "engine", "reason", F.posexplode_outer("lines").alias("line_no", "l"))
    rows = reads.select("key", "engine", "reason", "line_no", F.col("l.text").alias("text"), F.col("l.confidence").alias("confidence"))
    return crops.select(*places).join(rows, "key")


def collect_pools(crops: DataFrame, ladder: Ladder, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(text lines, layout lines, texts) of products: the best transcription, the one with geometry, the union text.

    crops: product_key, view, crop, key, payload and, if known, height in pixels. Lines are numbered
    through a product's crops; their height and top are shares of the crop's height, 0 without a box.
    """
    reads = ladder.read_dual(crops.select("key", "payload"), cache)
    tall = F.col("height") if "height" in crops.columns else F.lit(None).cast("int")
    placed = crops.select("product_key", "view", "crop", "key", tall.alias("tall")).join(reads, "key")

    def pool(column: str) -> DataFrame:
        rows = placed.select("product_key", "view", "crop", "tall", F.posexplode(column).alias("at", "l"))
        number = F.shiftleft(F.col("view").cast("long"), 40) + F.shiftleft(F.col("crop").cast("long"), 20) + F.col("at")
        place = {"height": geometry.height_frac(F.col("l.box"), F.col("tall")), "top": geometry.top_frac(F.col("l.box"), F.col("tall"))}
        return rows.select("product_key", "view", "crop", number.alias("line_no"), "l.text", "l.confidence", "l.box", *(c.alias(name) for name, c in place.items()))

    text = pool("text_lines")
    return text, pool("layout_lines"), products.text_union(text)


def collect_products(pictures: DataFrame, ladder: Ladder, decode: Callable, primary: DataFrame, secondary: DataFrame, cache: DataFrame | None = None, decodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(text lines, layout lines, texts, barcodes) of products: all that extract_products needs.

    pictures: what prepare_images(uncropped=True) has written. The ladder reads the crops, its payload
    being a struct of height, width and data; bars are looked for in the pictures before cropping, and
    printed digits in the product's text. Pictures whose names aren't a product's are left out; a
    product without a code has no row among the barcodes. decodes: as decode_images's cache.
    """
    named = pictures.withColumns({"product_key": products.product_key(F.col("path")), "view": products.view_number(F.col("path"))}).where("product_key is not null")
    crops = named.where("crop >= 0").select("product_key", "view", "crop", "key", "height", F.struct("height", "width", "data").alias("payload"))
    text, layout, texts = collect_pools(crops, ladder, cache)
    whole = named.where("crop = -1")
    codes = ladder.store(images.decode_images(whole, decode, barcode.is_valid, decodes), "decodes")
    reads = whole.select("product_key", "view", "key").join(codes.select("key", F.col("code").alias("decoded")), "key").join(texts, "product_key", "left")
    none = F.lit(None).cast("string")
    checked = validate_barcodes(reads.select("product_key", "view", "decoded", F.coalesce("text", F.lit("")).alias("text"), none.alias("ocr_brand"), none.alias("ocr_name")), primary, secondary)
    # Written before it is filtered, as a filter on a code would repeat the whole search for it in the plan.
    found = products.strongest_barcode(ladder.store(checked, "barcodes")).withColumnsRenamed({"brand": "canonical_brand", "name": "canonical_name"})
    return text, layout, texts, found


def fetch_codes(codes: DataFrame, fetch: Callable[[str], dict | None]) -> DataFrame:
    """code, name, brand of looked-up codes, each asked for once; a miss is a row without values.

    A code whose lookup raises gives no row, so that a later run asks again.
    """
    ship(codes.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for code in frame["code"]:
                try:
                    found = fetch(code) or {}
                except Exception:
                    continue
                rows.append((code, found.get("name"), found.get("brand")))
            yield pd.DataFrame(rows, columns=["code", "name", "brand"])

    return codes.select("code").where("code is not null").distinct().mapInPandas(run, "code string, name string, brand string")


def validate_barcodes(reads: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The barcode result of every read (product_key, view, decoded, text, ocr_brand, ocr_name).

    Adds code, source, unverified, valid_checksum, text_match, text_match_ok, name, brand,
    lookup_source, brand_match, name_match and trail. Lookup tables have code, name, brand.
    """
    # The search is a row that is generated once: a filter or a second use of a code can't repeat it.
    found = reads.select("*", F.explode(F.array(barcode.find_barcode(F.col("decoded"), F.col("text")))).alias("b")).select(*reads.columns, "b.*")
    checked = found.withColumns({"valid_checksum": F.coalesce(barcode.checksum_valid(F.col("code")), F.lit(False)), "text_match": F.when(F.col("code").isNotNull(), barcode.text_match(F.col("code"), F.col("text")))})
    checked = checked.withColumn("text_match_ok", F.col("text_match") >= barcode.TEXT_MATCH)
    known = products.coalesced_lookup(checked.where("valid_checksum").select("code").distinct(), primary, secondary)
    joined = checked.join(known, "code", "left")
    matched = joined.withColumns({"brand_match": similarity.str_sim(F.col("ocr_brand"), F.col("brand")), "name_match": similarity.str_sim(F.col("ocr_name"), F.col("name"))})
    trail = F.array_compact(
        F.array(
            F.when(F.col("code").isNotNull(), F.concat(F.lit("code from "), F.col("source"), F.lit(": "), F.col("code"))).otherwise("no verified code"),
            F.when(F.col("unverified").isNotNull(), F.concat(F.lit("for review: "), F.col("unverified"))),
            F.when(F.col("code").isNotNull(), F.format_string("printed digits: %.0f %%", 100 * F.col("text_match"))),
            F.when(F.col("lookup_source").isNotNull(), F.concat(F.lit("found in "), F.col("lookup_source"))),
            F.when(F.col("brand_match").isNotNull(), F.format_string("brand similarity %.2f", F.col("brand_match"))),
            F.when(F.col("name_match").isNotNull(), F.format_string("name similarity %.2f", F.col("name_match"))),
        )
    )
    return matched.withColumn("trail", trail)


def extract_products(text_lines: DataFrame, layout_lines: DataFrame | None = None, barcodes: DataFrame | None = None, labelled_words: DataFrame | None = None, mode: str = "heuristic") -> tuple[DataFrame, DataFrame | None]:
    """(fields, bullets) by rules, by a token model's labelled words, or by both merged.

    Where both have a field, the more confident value stays; of equals, that of the rules.
    """
    model = labels.fields_from_spans(labels.spans(labelled_words)) if mode != "heuristic" and labelled_words is not None else None
    if mode == "model":
        if model is None:
            return text_lines.sparkSession.createDataFrame([], "product_key string, field string, value string, confidence double, source string"), None
        return model, None
    fields, bullets = rules.parse(text_lines, layout_lines, barcodes)
    if mode == "heuristic" or model is None:
        return fields, bullets
    if mode != "merged":
        raise ValueError(f"unknown mode {mode!r}")
    return rules.keep_best(fields.withColumn("order", F.lit(0)).unionByName(model.withColumn("order", F.lit(1)))), bullets


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, the same for the same seed whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def row_range(rows: DataFrame, start: int, n: int, key: str = "row_id") -> DataFrame:
    """Rows whose persistent id lies in a range; the filter reaches the scan."""
    return rows.where(F.col(key).between(start, start + n - 1))


def licence_probe(values: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The first n values (key, value) that are digits only, ten at least: a look at what licence numbers there are."""
    return values.where(F.rlike("value", F.lit("^[0-9]{10,}$"))).orderBy(key).limit(n)


def names_with(names: DataFrame, part: str, most: int = 500, column: str = "path") -> DataFrame:
    return names.where(F.contains(F.lower(column), F.lit(part.lower()))).orderBy(column).limit(most)


def first_reasons(reads: DataFrame, n: int = 8) -> DataFrame:
    """The first n weak reads by key."""
    return reads.where("reason is not null").orderBy("key").limit(n)


def patient(generate: Callable[[object, float], str], limited: Callable[[Exception], bool], wait: Callable[[int], None], waits: int = 5) -> Callable[[object, float], str]:
    """generate for a hosted service: while it is rate-limited, wait and ask again with the same warmth.

    Waiting isn't an attempt of json_engine's. An error that isn't the limit's, or the limit after all
    waits, is raised.
    """

    def run(payload: object, warmth: float) -> str:
        for k in range(waits):
            try:
                return generate(payload, warmth)
            except Exception as error:
                if not limited(error):
                    raise
                wait(k)
        return generate(payload, warmth)

    return run


def json_engine(generate: Callable[[object, float], str], attempts: int = 3, repair: bool = True) -> Callable[[object], dict | None]:
    """A function of a payload to a JSON object; each attempt is a little warmer than the last.

    A reply without an object, or an error, leads to the next attempt; a cut-off object is closed
    where that saves three fields. None is returned when all attempts fail.
    """

    def run(payload: object) -> dict | None:
        for k in range(attempts):
            try:
                text = generate(payload, min(0.2 + 0.15 * k, 0.7)).strip()
            except Exception:
                continue
            text = re.sub(r"^```(?:json)?\s*|\s*```$", "", text)
            try:
                found = json.loads(text)
            except json.JSONDecodeError:
                found = similarity.repaired_json(text) if repair else None
            if isinstance(found, dict):
                return found
        return None

    return run
