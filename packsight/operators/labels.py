"""Token labels: weak labels from known values, and fields from labelled spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shipping import ship
from .records import LABEL_FIELDS

# Labels in id order, and the ground-truth column of each, in order of precedence.
LABELS = ("O", "BRAND", "MRP", "NET_QUANTITY", "FSSAI", "MANUFACTURER", "COUNTRY", "PRODUCT_NAME", "FLAVOUR", "MINERAL_SOURCE", "RECOMMENDED_AGE", "THEME_OCCASION", "HAIR_TYPE", "CAFFEINE_CONTENT", "PACK_QUANTITY")
TEXTUAL = (("BRAND", "Brand"), ("MANUFACTURER", "Manufacturer"), ("COUNTRY", "Country Of Origin"), ("PRODUCT_NAME", "Product Name"), ("FLAVOUR", "Flavours & Spices"), ("MINERAL_SOURCE", "Mineral Source"), ("THEME_OCCASION", "Theme/ Occasion Type"), ("HAIR_TYPE", "Hair Type"))
NUMERIC = (("MRP", "Mrp"), ("FSSAI", "Fssai No"), ("RECOMMENDED_AGE", "Recommended Age"), ("CAFFEINE_CONTENT", "Caffeine Content"), ("PACK_QUANTITY", "Pack Quantity"))


def token(word: Column) -> Column:
    """A word's letters and digits in lower case."""
    return F.regexp_replace(F.lower(word), "[^a-z0-9]", "")


def wanted_tokens(truth: DataFrame) -> DataFrame:
    """product_key, kind (text or digits), token, label, precedence. truth: product_key, field, value."""
    order = {label: k for k, (label, _) in enumerate(TEXTUAL + NUMERIC)}
    labels = F.create_map(*(F.lit(x) for label, field in TEXTUAL + NUMERIC for x in (field, label)))
    ranks = F.create_map(*(F.lit(x) for label, field in TEXTUAL + NUMERIC for x in (field, order[label])))
    numeric = [field for _, field in NUMERIC]
    named = truth.where(F.col("value").isNotNull() & (F.col("value") != "")).select("product_key", "field", "value", labels[F.col("field")].alias("label"), ranks[F.col("field")].alias("precedence")).where("label is not null")
    words = named.where(~F.col("field").isin(numeric)).select("product_key", F.lit("text").alias("kind"), F.explode(F.array_distinct(F.transform(F.split("value", r"\s+"), token))).alias("token"), "label", "precedence").where(F.length("token") >= 2)
    signature = F.when(F.col("field") == "Caffeine Content", tx.first_number(F.col("value"))).otherwise(tx.digits(F.col("value")))
    numbers = named.where(F.col("field").isin(numeric)).select("product_key", F.lit("digits").alias("kind"), signature.alias("token"), "label", "precedence").where("token not in ('', '0')")
    return words.union(numbers)


def weak_labels(words: DataFrame, truth: DataFrame) -> DataFrame:
    """Add label and label_id to words (product_key, word_no, word): the first field that has the word, else O.

    Neither side is ever sent whole to the driver or to a task: both are sorted by product, whose
    wanted tokens are one row, and a word looks its label up there.
    """
    first = wanted_tokens(truth).groupBy("product_key", "kind", "token").agg(F.min(F.struct("precedence", "label")).alias("first"))
    entry = F.struct(F.concat_ws(":", "kind", "token").alias("key"), F.col("first").alias("value"))
    wanted = first.groupBy("product_key").agg(F.map_from_entries(F.collect_list(entry)).alias("wanted"))
    joined = words.join(wanted.hint("merge"), "product_key", "left")
    # A word without letters or figures has no key of its own, and an empty token is never wanted.
    found = F.least(*(F.try_element_at("wanted", F.concat(F.lit(f"{kind}:"), of(F.col("word")))) for kind, of in (("text", token), ("digits", tx.digits))))
    ids = F.create_map(*(x for k, name in enumerate(LABELS) for x in (F.lit(name), F.lit(k))))
    out = joined.select(*words.columns, F.coalesce(found["label"], F.lit("O")).alias("label"))
    return out.withColumn("label_id", ids[F.col("label")])


def training_examples(labelled: DataFrame) -> DataFrame:
    """One row a crop (product_key, view, crop): words, boxes and label ids in word order.

    Crops without any label are left out.
    """
    w = F.array_sort(F.collect_list(F.struct("word_no", "word", "box", "label_id")))
    rows = labelled.groupBy("product_key", "view", "crop").agg(w.alias("w"), F.max("label_id").alias("most")).where("most > 0")
    part = lambda name: F.transform("w", lambda x: x[name])
    return rows.select("product_key", "view", "crop", part("word").alias("words"), part("box").alias("boxes"), part("label_id").alias("label_ids"))


def classify(words: DataFrame, predict: Callable[[list[str], list], list[tuple[str, float]]]) -> DataFrame:
    """product_key, view, crop, word_no, word, label, confidence by a token model, a call a crop.

    words: product_key, view, crop, word_no, word, box (in thousandths). predict takes a crop's words
    in order with their boxes and gives (label, confidence) of the first ones, as many as its window
    holds; the others are O with a confidence of 0. A crop has as many words as fit on an image.
    """
    ship(words.sparkSession)
    keys = ["product_key", "view", "crop"]
    type_of = lambda name: words.schema[name].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            labelled = []
            for crop in frame["words"]:
                found = list(predict([w["word"] for w in crop], [w["box"] for w in crop])) if len(crop) else []
                labelled.append([{"word_no": w["word_no"], "word": w["word"], "label": label, "confidence": float(sure)} for w, (label, sure) in zip(crop, found + [("O", 0.0)] * (len(crop) - len(found)))])
            yield frame[keys].assign(words=labelled)

    ordered = F.array_sort(F.collect_list(F.struct("word_no", "word", "box"))).alias("words")
    crops = words.where("word is not null").groupBy(*keys).agg(ordered)
    result = ", ".join(f"{k} {type_of(k)}" for k in keys) + f", words array<struct<word_no:{type_of('word_no')},word:string,label:string,confidence:double>>"
    return crops.mapInPandas(run, result).select(*keys, F.inline("words"))


def spans(words: DataFrame) -> DataFrame:
    """product_key, view, crop, span, label, value, confidence: neighbouring words of one label in a crop.

    words: product_key, view, crop, word_no, word, label, confidence.
    """
    w = Window.partitionBy("product_key", "view", "crop").orderBy("word_no")
    change = F.when(F.lag("label").over(w).eqNullSafe(F.col("label")), 0).otherwise(1)
    numbered = words.withColumn("change", change).withColumn("span", F.sum("change").over(w))
    ordered = F.array_sort(F.collect_list(F.struct("word_no", "word")))
    grouped = numbered.where("label <> 'O'").groupBy("product_key", "view", "crop", "span", "label").agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("value"), F.avg("confidence").alias("confidence"))
    return grouped


def fields_from_spans(found: DataFrame, weight: float = 0.7, source: str = "token-model") -> DataFrame:
    """The most confident span of each field, as field rows; of equals, the first."""
    names = F.create_map(*(F.lit(x) for pair in LABEL_FIELDS.items() for x in pair))
    best = F.max_by(F.struct("value", "confidence"), F.struct("confidence", -F.col("view"), -F.col("crop"), -F.col("span"))).alias("b")
    named = found.withColumn("field", names[F.col("label")]).where("field is not null")
    return named.groupBy("product_key", "field").agg(best).select("product_key", "field", "b.value", (F.lit(weight) * F.col("b.confidence")).alias("confidence"), F.lit(source).alias("source"))
