"""Inputs of the registered queries, made from the shared tables by SQL that every engine reads alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = "p_partkey"


def _case(modulus: int, *texts: str, key: str = _K) -> str:
    return f"case {key} % {modulus} " + " ".join(f"when {k} then {t}" for k, t in enumerate(texts)) + " end"


#: Label lines of a product, one for each part.
LABEL_LINES = (
    "upper(p_name)",
    "p_brand || ' ' || p_name",
    _case(2, "'MRP Rs. ' || cast(p_size as string) || '.50 incl. of all taxes'", "'Price Rs ' || cast(p_size as string)"),
    _case(3, "'Net Qty: ' || cast(p_size as string) || ' ML'", "'Contents ' || cast(p_size as string) || ' g pouch'", "'no size here'"),
    f"'Lic.  No. ' || cast(10012345678901 + {_K} as string)",
    "'Marketed by: Acme ' || p_name || ' Foods Pvt. Ltd., 12 Road'",
    _case(4, "'Country of origin: india'", "'Made in new zealand.'", "'Product of   sri lanka'", "'nothing to see'"),
    "'INGREDIENTS: Water, Sugar'",
    "'salt and ' || p_name || ' spice'",
    "'NUTRITION FACTS'",
    "'Energy 100 kcal per serve and much more'",
    _case(5, "'No added preservatives'", "'contains preservatives'", "'plain text line here'", "'100% natural claim'", "'zero sugar'"),
    _case(6, "'Ready to cook'", "'ready  to eat'", "'herbal tea'", "'flavour: mango twist'", "'Wild Berry flavour'", "'Caffeine 99mg/330ml can'"),
    _case(7, "'Recommended age: 18+'", "'baby weight 3 - 6 kg'", "'absorption up to 12 hours'", "'10 x 20 cm'", "'pack of 6'", "'non-veg item'", "'pure veg'"),
    _case(4, "'Diwali festive box'", "'for dry hair'", "'with calcium and zinc'", "'high in fibre'"),
    "'this is a long sentence about the ' || p_name || ' which people love to use daily'",
    "'Store in: a cool dry place'",
    "'keep away from sunlight'",
)
CONFIDENCE = f"cast((line_no * 7 + product_key) % 10 as double) / 10"
HEIGHT = f"cast((line_no * 13 + product_key * 5) % 17 as double) / 100"

#: Codes and texts of orders.
CODE = "lpad(cast(8900000000000 + o_orderkey * 7919 % 99999999 as string), 13, '0')"
CODE12 = "lpad(cast(900000000000 + o_orderkey * 104729 % 999999999 as string), 12, '0')"
CODE_TEXT = (
    f"case o_orderkey % 5 when 0 then 'net 12' || chr(10) || {CODE} || chr(10) || 'Lic 123'"
    f" when 1 then substr({CODE}, 1, 7) || chr(10) || substr({CODE}, 8, 6) || chr(10) || '12'"
    f" when 2 then 'call ' || {CODE} || ' or 18005551234'"
    f" when 3 then {CODE12} || chr(10) || '> ' || substr({CODE}, 1, 6) || chr(10) || '1' || chr(10) || substr({CODE}, 7, 6)"
    f" else 'none' || chr(10) || substr({CODE}, 1, 9) end"
)


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of products, dealt by product before they are made, so that no extractor has to shuffle them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), _K)
    rows = part.selectExpr("p_partkey as product_key", f"posexplode(array({', '.join(LABEL_LINES)})) as (line_no, text)")
    return rows.selectExpr("product_key", "line_no", "text", f"{CONFIDENCE} as confidence", f"{HEIGHT} as height")


LABEL_LINES_SQL = (
    f"lines as (select product_key, line_no, text, {CONFIDENCE} as confidence, {HEIGHT} as height from "
    f"(select p_partkey as product_key, unnest(range(0, {len(LABEL_LINES)})) as line_no, unnest([{', '.join(LABEL_LINES)}]) as text from part))"
)


def order_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", f"{CODE} as code", f"{CODE12} as run", f"{CODE_TEXT} as text")


ORDER_CODES_SQL = f"codes as (select o_orderkey, {CODE} as code, {CODE12} as run, {CODE_TEXT} as text from orders)"


def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.selectExpr(f"{IMAGE_NAME} as path")


IMAGE_NAME = f"case when {_K} % 11 = 10 then 'photo_' || cast({_K} as string) || '.png' else 'Image_' || cast({_K} % 5 + 1 as string) || '_' || cast(8900000 + cast(floor({_K} / 5) as bigint) as string) || '.0.jpg' end"


#: A wide ground-truth row a supplier, with two file name columns.
TRUTH = (
    "s_suppkey as row_id",
    "case when s_suppkey % 4 = 0 then ' ' else 'IMG ' || cast(s_suppkey as string) end as `Front Filename`",
    "case when s_suppkey % 3 = 0 then null else 'Image_1_' || cast(8900000 + s_suppkey % 50 as string) || '.0.jpg' end as `Back Filename`",
    "cast(s_suppkey * 5 % 97 as string) || '.0' as Mrp",
    "s_name as Manufacturer",
)


def truth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(*TRUTH)


TRUTH_SQL = f"truth as (select {', '.join(TRUTH)} from supplier)".replace("`", '"')

#: Recogniser calls from events: engine, seconds, cost.
CALLS = ("event_id", "event_type as engine", "user_id", "cast(user_id % 50 as string) as key", "value as seconds", "cast(floor(value) as bigint) as cents", "ts")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*CALLS)


CALLS_SQL = f"calls as (select {', '.join(CALLS)} from events)"
