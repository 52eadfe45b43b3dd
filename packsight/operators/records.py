"""Projection of extracted fields to records, provenance and target fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# The record's fields in order, and the target fields of scoring.
RECORD = (
    "Category",
    "Sub_Category",
    "Product_Name",
    "Net_Quantity",
    "UOM",
    "Product_Description",
    "Bullet_Point",
    "Manufacturer",
    "Country_Of_Origin",
    "Images",
    "Brand",
    "Pack_Quantity",
    "Pack_Size",
    "UPC_or_EAN",
    "FSSAI_no",
    "Dimension",
    "Preservatives",
    "Preservatives_Details",
    "Flavours_or_Spices",
    "Diet_Type",
    "Ready_to_cook",
    "Ready_to_eat",
    "Ingredients",
    "Nutritional_Details",
    "Usage_Details",
    "Storage_Instructions",
    "Recommended_Age",
    "Baby_Weight",
    "Absorption_Duration",
    "Scented_Flavoured",
    "Herbal_or_Ayurvedic",
    "Theme_or_Occasion_Type",
    "Hair_Type",
    "Mineral_Source",
    "Caffeine_Content",
    "Capacity",
    "Variants",
)
TARGETS = ("Product Name", "Brand", "Mrp", "Net Quantity", "Upc / Ean", "Fssai No", "Manufacturer", "Country Of Origin")
#: Record fields whose extracted field has another name.
NAMES = {"Product_Name": "Product Name", "Country_Of_Origin": "Country Of Origin", "UPC_or_EAN": "Upc / Ean", "FSSAI_no": "Fssai No"}
#: Token label -> extracted field, the third vocabulary.
LABEL_FIELDS = {
    "BRAND": "Brand",
    "MRP": "Mrp",
    "NET_QUANTITY": "Net Quantity",
    "FSSAI": "Fssai No",
    "MANUFACTURER": "Manufacturer",
    "COUNTRY": "Country Of Origin",
    "PRODUCT_NAME": "Product Name",
    "FLAVOUR": "Flavours_or_Spices",
    "MINERAL_SOURCE": "Mineral_Source",
    "RECOMMENDED_AGE": "Recommended_Age",
    "THEME_OCCASION": "Theme_or_Occasion_Type",
    "HAIR_TYPE": "Hair_Type",
    "CAFFEINE_CONTENT": "Caffeine_Content",
    "PACK_QUANTITY": "Pack_Quantity",
}


def field_map(fields: DataFrame) -> DataFrame:
    """product_key, fields: map of field to struct<value, confidence, source>."""
    entry = F.struct("field", F.struct("value", "confidence", "source"))
    return fields.groupBy("product_key").agg(F.map_from_entries(F.collect_list(entry)).alias("fields"))


def target_values(fields: Column) -> Column:
    """struct of the target fields' values, null where missing."""
    return F.struct(*(fields[name]["value"].alias(name) for name in TARGETS))


def provenance(fields: Column) -> Column:
    """map of target field to "value   (confidence, source)"."""
    text = lambda f: F.coalesce(F.format_string("%s   (%.2f, %s)", f["value"], f["confidence"], f["source"]), F.lit("—"))
    known = lambda f: F.when(f.isNull(), F.lit("—")).otherwise(text(f))
    return F.create_map(*(x for name in TARGETS for x in (F.lit(name), known(fields[name]))))


def record(fields: Column, bullets: Column) -> Column:
    """The record struct of a product, in the record's field order."""
    value = lambda name: fields[name]["value"]
    net = value("Net Quantity")
    parts = F.split(tx.strip(net), r"[\x20\x09-\x0D]+", 2)
    special = {
        "Category": F.lit("Grocery"),
        "Net_Quantity": tx.safe_int(F.get(parts, F.lit(0))),
        "UOM": F.when(F.size(parts) > 1, tx.strip(F.get(parts, F.lit(1)))),
        "Bullet_Point": F.coalesce(bullets, F.array().cast("array<string>")),
        "Images": F.array().cast("array<string>"),
        "Variants": F.array().cast("array<string>"),
        "Sub_Category": F.lit(None).cast("string"),
        "Pack_Size": F.lit(None).cast("string"),
        "Pack_Quantity": tx.safe_int(value("Pack_Quantity")),
        "Scented_Flavoured": F.when(value("Flavours_or_Spices").isNotNull(), F.lit("Yes")),
        "Capacity": F.coalesce(tx.blank_to_null(value("Capacity")), net),
    }
    return F.struct(*(special.get(name, value(NAMES.get(name, name)) if name not in special else None).alias(name) for name in RECORD))


def records(fields: DataFrame, bullets: DataFrame | None = None) -> DataFrame:
    """product_key and its record. fields: product_key, field, value, confidence, source."""
    held = field_map(fields)
    if bullets is not None:
        held = held.join(bullets, "product_key", "left")
    else:
        held = held.withColumn("bullets", F.lit(None).cast("array<string>"))
    return held.select("product_key", record(F.col("fields"), F.col("bullets")).alias("record"))


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence.isNull() | (confidence >= 0.9), "good").when(confidence >= 0.7, "medium").otherwise("weak")
