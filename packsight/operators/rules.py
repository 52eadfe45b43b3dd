"""Field extraction: a catalog of pattern rules, evaluated line by line, best match per field.

Lines are rows: product_key, line_no, text, confidence, height (share of the image). A rule gives at
most one value for a line; a field takes the value of its first pass that matches, in line order
(or from the tallest line, where the rule says so). One shuffle on the product serves all rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# The patterns, weights and sources of the fields.
_UNIT = r"(?:kg|kgs|g|gm|gms|grams?|mg|ml|l|ltr|litres?|liters?|pcs?|pieces?|units?|nos?|tea\s?bags?|sachets?|N)"
MRP = r"(?i)(?:m\.?\s?r\.?\s?p\.?|maximum\s+retail\s+price)\b[^0-9₹]{0,15}(?:rs\.?|inr|₹)?\s*([0-9]{1,5}(?:\.[0-9]{1,2})?)"
PRICE = r"(?i)(?:rs\.?|inr|₹)\s*([0-9]{1,5}(?:\.[0-9]{1,2})?)"
NET_LABELLED = rf"(?i)net\s*(?:qty|quantity|wt\.?|weight|content|vol\.?|volume)\b[^0-9]{{0,10}}([0-9]+(?:\.[0-9]+)?)\s*({_UNIT})\b"
NET_ANY = rf"(?i)\b([0-9]+(?:\.[0-9]+)?)\s*({_UNIT})\b"
FSSAI = r"(?i)(?:fssai|lic\.?\s*no\.?|licence\s*no\.?|license\s*no\.?)\b[^0-9]{0,12}([0-9]{14})"
MADE_BY = r"(?i)(?:manufactured|mfd|mfg|marketed|mktd|packed|produced)\.?\s*(?:&\s*(?:marketed|packed|distributed))?\s*by\s*[:\-]?\s*(.+)"
ORIGIN = r"(?i)(?:country\s*of\s*origin|made\s+in|product\s+of|origin)\b[^a-z]{0,6}([a-z][a-z .]{2,30})"
HEADERS = {
    "Ingredients": r"(?i)^ingredients?\s*[:\-]?\s*(.*)$",
    "Nutritional_Details": r"(?i)^nutrition(?:al)?\s*(?:information|facts|value)?\s*[:\-]?\s*(.*)$",
    "Usage_Details": r"(?i)^(?:directions?\s*(?:for\s+)?use|how\s+to\s+use|preparation|usage\s*(?:instructions?)?)\s*[:\-]?\s*(.*)$",
    "Storage_Instructions": r"(?i)^(?:storage(?:\s+instructions?)?|store\s+in)\s*[:\-]?\s*(.*)$",
}
CLAIMS = ("no added", "no artificial", "zero", "100%", "high in", "rich in", "source of", "low fat", "sugar free", "gluten free", "vegan", "fortified", "clinically proven", "recommended by", "no.1", "no. 1", "#")
THEMES = ("diwali", "christmas", "rakhi", "raksha bandhan", "holi", "valentine", "birthday", "wedding", "festive", "new year", "summer edition", "monsoon edition")
HAIR_TYPES = ("dry hair", "oily hair", "normal hair", "damaged hair", "frizzy hair", "curly hair", "all hair types")
MINERALS = ("calcium", "zinc", "iron", "magnesium", "himalayan", "phosphate")
DEFAULT_CONFIDENCE = 0.8


@dataclass(frozen=True)
class Rule:
    """One pattern: `form` says how its groups become a value.

    Whatever the pattern matches holds one of `marks` in lower case, and a figure if `figure` is set:
    only such lines are searched, as a search costs many times more than a look for a fixed text.
    """

    field: str
    step: int
    pattern: str
    weight: float
    source: str
    form: str = "group"  # group | amount | entity | country | title | strip | constant
    constant: str = ""
    tallest: bool = False
    needs: tuple[str, ...] = ()
    squeeze: bool = False
    marks: tuple[str, ...] = ()
    figure: bool = False


CATALOG = (
    Rule("Mrp", 1, MRP, 0.9, "regex:mrp-labelled", marks=("p",), figure=True),
    Rule("Mrp", 2, PRICE, 0.5, "regex:price-mark", marks=("rs", "inr", "₹"), figure=True),
    Rule("Net Quantity", 1, NET_LABELLED, 0.9, "regex:net-qty-labelled", "amount", marks=("net",), figure=True),
    Rule("Net Quantity", 2, NET_ANY, 0.6, "layout:prominent-size", "amount", tallest=True, figure=True),
    Rule("Fssai No", 1, FSSAI, 0.95, "regex:fssai", squeeze=True, marks=("fssai", "lic"), figure=True),
    Rule("Manufacturer", 1, MADE_BY, 0.85, "regex:mktd-by", "entity", marks=("by",)),
    Rule("Country Of Origin", 1, ORIGIN, 0.85, "regex:origin", "country", marks=("origin", "made", "product")),
    Rule("Preservatives", 1, r"(?i)no\s+added\s+preservatives?|preservative[\s\-]?free", 0.8, "regex:no-preservative-claim", "constant", "No", marks=("preservative",)),
    Rule("Preservatives", 2, r"(?i)contains?\s+preservatives?|preservatives?\s*[:(]", 0.6, "regex:preservative-claim", "constant", "Yes", marks=("preservative",)),
    Rule("Ready_to_cook", 1, r"(?i)\bready\s*to\s*cook\b", 0.75, "regex:ready-to-cook", "constant", "Yes", marks=("ready",)),
    Rule("Ready_to_eat", 1, r"(?i)\bready\s*to\s*eat\b", 0.75, "regex:ready-to-eat", "constant", "Yes", marks=("ready",)),
    Rule("Herbal_or_Ayurvedic", 1, r"(?i)\bherbal\b|\bayurvedic\b", 0.7, "regex:herbal-claim", "constant", "Yes", marks=("herbal", "ayurvedic")),
    Rule("Flavours_or_Spices", 1, r"(?i)flavou?rs?\s*[:\-]\s*([a-z][a-z \-]{2,30})", 0.7, "regex:flavour-label", "title", marks=("flavo",)),
    Rule("Flavours_or_Spices", 2, r"([A-Z][a-zA-Z\-]+(?:\s+[A-Z][a-zA-Z\-]+){0,2})\s+flavou?r\b", 0.5, "regex:flavour-name", "strip", marks=("flavo",)),
    Rule("Caffeine_Content", 1, r"(?i)caffeine\b[^0-9]{0,15}([0-9]+(?:\.[0-9]+)?\s*mg(?:\s*/\s*[0-9]+\s*ml)?(?:\s*(?:can|serve|bottle))?)", 0.75, "regex:caffeine-content", "strip", marks=("caffeine",), figure=True),
    Rule("Recommended_Age", 1, r"(?i)(?:recommended\s+age)\s*[:\-]?\s*([0-9]{1,2}\s*\+|[0-9]{1,2}\s*(?:years?|yrs?)\s*(?:and\s*)?(?:above|older)?)", 0.6, "regex:recommended-age", "strip", marks=("recommended",), figure=True),
    Rule("Baby_Weight", 1, r"(?i)([0-9]+(?:\.[0-9]+)?\s*-\s*[0-9]+(?:\.[0-9]+)?\s*kg)", 0.55, "regex:baby-weight-range", "strip", needs=("weight", "kg"), marks=("kg",), figure=True),
    Rule("Absorption_Duration", 1, r"(?i)absorption[^0-9]{0,15}([0-9]+(?:\.[0-9]+)?\s*(?:hrs?|hours?))", 0.6, "regex:absorption-duration", "strip", marks=("absorption",), figure=True),
    Rule("Dimension", 1, r"((?i:[0-9]+(?:\.[0-9]+)?\s*[xX×]\s*[0-9]+(?:\.[0-9]+)?(?:\s*[xX×]\s*[0-9]+(?:\.[0-9]+)?)?\s*(?:cm|mm|inch(?:es)?|in)\b))", 0.6, "regex:dimension", "strip", marks=("x", "×"), figure=True),
    Rule("Pack_Quantity", 1, r"(?i)pack\s*of\s*([0-9]+)", 0.7, "regex:pack-of-n", marks=("pack",), figure=True),
    Rule("Diet_Type", 1, r"(?i)\bnon[\s\-]?veg(?:etarian)?\b", 0.7, "regex:non-veg-mark", "constant", "Non-Vegetarian", marks=("veg",)),
    Rule("Diet_Type", 2, r"(?i)\bvegetarian\b|\bveg\b", 0.6, "regex:veg-mark", "constant", "Vegetarian", marks=("veg",)),
)
KEYWORDS = (("Theme_or_Occasion_Type", THEMES), ("Hair_Type", HAIR_TYPES), ("Mineral_Source", MINERALS))


def sure(confidence: Column) -> Column:
    """A line's confidence; the default where it is null or zero."""
    return F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(DEFAULT_CONFIDENCE))


def value_of(rule: Rule, text: Column) -> Column:
    """What a rule gives for a line, or null: its groups are empty where the pattern doesn't match, so it is searched once."""
    text = F.regexp_replace(text, r"\s+", " ") if rule.squeeze else text
    needed = lambda hit: tx.contains_any(text, rule.needs) & hit if rule.needs else hit
    filled = lambda value: tx.once(tx.strip(value), lambda s: F.when(s != "", s))
    if rule.form == "constant":
        return F.when(needed(F.rlike(text, F.lit(rule.pattern))), F.lit(rule.constant))

    def shaped(group: Column) -> Column:
        value = group
        if rule.form == "amount":
            value = F.concat(value, F.lit(" "), F.lower(F.regexp_extract(text, rule.pattern, 2)))
        elif rule.form in ("entity", "country"):
            country = rule.form == "country"
            value = tx.once(tx.clean_entity(value), lambda c: F.when(F.length(c).between(3, 30) if country else F.length(c) >= 3, tx.title(c) if country else c))
        elif rule.form == "title":
            value = tx.title(tx.strip(value))
        return F.when(needed(group != ""), filled(value))

    return tx.once(F.regexp_extract(text, rule.pattern, 1), shaped)


def keyword_of(text: Column, words: Sequence[str], lowered: bool = False) -> Column:
    """The first word of the list that the line contains, in title form; or null. lowered: the text is in lower case."""
    text = text if lowered else F.lower(text)
    found = F.lit(None).cast("string")
    for word in reversed(words):
        found = F.when(F.contains(text, F.lit(word)), F.lit(word.title())).otherwise(found)
    return found


def may_match(rule: Rule, lowered: Column, figure: Column) -> Column:
    """Whether a line can match at all, by its lower-case text and whether it has a figure."""
    held = F.lit(True)
    if rule.figure:
        held = figure
    if rule.marks:
        held = held & reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(m)) for m in rule.marks))
    return held


def extract_fields(lines: DataFrame, catalog: Sequence[Rule] = CATALOG, keywords: Sequence[tuple[str, Sequence[str]]] = KEYWORDS) -> DataFrame:
    """product_key, field, value, confidence, source for every rule and keyword field that matches."""
    lines = lines.select("product_key", "line_no", "text", "confidence", "height", F.lower("text").alias("lowered"), F.rlike("text", F.lit("[0-9]")).alias("figure"))
    gated = lambda r: F.when(may_match(r, F.col("lowered"), F.col("figure")), value_of(r, F.col("text")))
    matches = [(r.field, r.step, -F.col("height") if r.tallest else F.lit(0.0), gated(r), r.weight, r.source) for r in catalog]
    matches += [(name, 1, F.lit(0.0), keyword_of(F.col("lowered"), words, lowered=True), 0.4, f"keyword:{name.lower()}") for name, words in keywords]
    each = F.array(
        *(
            F.struct(F.lit(f).alias("field"), F.lit(step).alias("step"), order.cast("double").alias("order"), v.alias("value"), F.lit(weight).alias("weight"), F.lit(source).alias("source"))
            for f, step, order, v, weight, source in matches
        )
    )
    # A line's values are a column, as explode asks for its array's type in each row, and are generated
    # as one row before they are exploded, so that no inferred filter makes them again.
    made = lines.select("product_key", "line_no", "confidence", F.filter(each, lambda m: m["value"].isNotNull()).alias("made"))
    held = made.select("product_key", "line_no", "confidence", F.explode(F.array("made")).alias("held"))
    found = held.select("product_key", "line_no", "confidence", F.explode("held").alias("m"))
    taken = F.struct("m.value", (F.col("m.weight") * sure(F.col("confidence"))).alias("confidence"), "m.source")
    best = F.min_by(taken, F.struct("m.step", "m.order", "line_no")).alias("m")
    return found.groupBy("product_key", F.col("m.field").alias("field")).agg(best).select("product_key", "field", "m.value", "m.confidence", "m.source")


def new_section(text: Column) -> Column:
    """Whether a line starts a section of its own: blank, labelled, or a short line in capitals."""
    s = tx.strip(text)
    labelled = F.lit(False)
    for pattern in (MRP, FSSAI, MADE_BY, ORIGIN, NET_LABELLED):
        labelled = labelled | F.rlike(s, F.lit(pattern))
    words = F.size(F.split(s, r"\s+"))
    return (s == "") | labelled | ((words <= 6) & (F.upper(s) == s) & tx.has_letter(s))


def extract_blocks(lines: DataFrame, most: int = 8) -> DataFrame:
    """product_key, field, value, confidence, source of the labelled blocks.

    A block is what follows its header on the line, and up to `most` lines before a new section;
    a header without any content is passed over. A product's lines are gathered in one row.
    """
    row = F.struct("line_no", tx.strip(F.col("text")).alias("text"), new_section(F.col("text")).alias("stop"))
    heads = [F.when(F.rlike(tx.strip(F.col("text")), F.lit(p)), tx.strip(F.regexp_extract(tx.strip(F.col("text")), p, 1))).alias(f"h{k}") for k, p in enumerate(HEADERS.values())]
    rows = lines.select("product_key", row.alias("r"), F.struct(*heads).alias("h"))
    gathered = rows.groupBy("product_key").agg(F.array_sort(F.collect_list(F.struct(F.col("r.line_no").alias("line_no"), "r", "h"))).alias("all"))

    def block(k: int) -> Column:
        def at(x: Column, i: Column) -> Column:
            after = F.slice("all", i + 2, F.lit(most))
            stop = F.array_position(F.transform(after, lambda y: y["r"]["stop"]), F.lit(True))
            kept = F.when(stop > 0, F.slice(after, F.lit(1), stop.cast("int") - 1)).otherwise(after)
            own = F.filter(F.array(x["h"][f"h{k}"]), lambda t: t != "")
            return F.when(x["h"][f"h{k}"].isNotNull(), F.concat(own, F.transform(kept, lambda y: y["r"]["text"])))

        parts = F.get(F.filter(F.transform("all", at), lambda p: p.isNotNull() & (F.size(p) > 0)), F.lit(0))
        return F.nullif(F.btrim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " "), F.lit(" .,:;-")), F.lit(""))

    fields = [F.struct(F.lit(f).alias("field"), block(k).alias("value"), F.lit(0.5).alias("confidence"), F.lit(f"heuristic:block:{f.lower()}").alias("source")) for k, f in enumerate(HEADERS)]
    return gathered.select("product_key", F.explode(F.array(*fields)).alias("m")).select("product_key", "m.*").where("value is not null")


def extract_bullets(lines: DataFrame, most: int = 6) -> DataFrame:
    """product_key, bullets: the first distinct short lines with a claim, in line order."""
    s = tx.strip(F.col("text"))
    words = F.size(F.split(s, r"\s+"))
    claims = lines.select("product_key", "line_no", s.alias("text")).where(words.between(2, 10) & tx.contains_any(s, CLAIMS))
    first = claims.groupBy("product_key", "text").agg(F.min("line_no").alias("line_no"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return first.groupBy("product_key").agg(F.slice(F.transform(ordered, lambda x: x["text"]), 1, most).alias("bullets"))


def extract_front(layout: DataFrame, barcodes: DataFrame | None = None) -> DataFrame:
    """Brand and Product Name: the barcode's canonical values, else the tallest front lines.

    barcodes: product_key, canonical_brand, canonical_name.
    """
    front = layout.where(tx.is_front_text(F.col("text"))).select("product_key", F.struct((-F.col("height")).alias("h"), "line_no", "text", sure(F.col("confidence")).alias("c")).alias("s"))
    # Each task keeps the two tallest lines of a product, so that two lines of any task are gathered.
    rank = F.row_number().over(Window.partitionBy("product_key").orderBy("s.h", "s.line_no", "s.text"))
    two = front.withColumn("k", rank).where("k <= 2").groupBy("product_key").agg(F.array_sort(F.collect_list("s")).alias("top"))
    c = F.get("top", F.lit(0))["c"]
    rows = two.select(
        "product_key",
        F.explode(
            F.array(
                F.struct(F.lit("Brand").alias("field"), tx.strip(F.get("top", F.lit(0))["text"]).alias("value"), (0.4 * c).alias("confidence"), F.lit("layout:largest-text").alias("source")),
                F.struct(F.lit("Product Name").alias("field"), tx.strip(F.array_join(F.transform("top", lambda t: t["text"]), " ")).alias("value"), (0.35 * c).alias("confidence"), F.lit("layout:top-lines").alias("source")),
            )
        ).alias("m"),
    ).select("product_key", "m.*")
    if barcodes is None:
        return rows
    known = barcodes.select(
        "product_key",
        F.explode(
            F.array(
                F.struct(F.lit("Brand").alias("field"), tx.blank_to_null(F.col("canonical_brand")).alias("value"), F.lit(0.9).alias("confidence"), F.lit("barcode:lookup").alias("source")),
                F.struct(F.lit("Product Name").alias("field"), tx.blank_to_null(F.col("canonical_name")).alias("value"), F.lit(0.85).alias("confidence"), F.lit("barcode:lookup").alias("source")),
            )
        ).alias("m"),
    ).select("product_key", "m.*")
    return keep_best(known.where("value is not null").withColumn("order", F.lit(0)).unionByName(rows.withColumn("order", F.lit(1))))


def extract_description(lines: DataFrame, claimed: DataFrame) -> DataFrame:
    """The longest unclaimed sentence of a product; claimed: product_key, value."""
    s = tx.strip(F.col("text"))
    sentence = lines.where((F.size(F.split(s, r"\s+")) >= 8) & (F.upper(F.col("text")) != F.col("text")) & ~tx.contains_any(F.col("text"), tx.BACK_PANEL_WORDS)).withColumn("value", s)
    free = sentence.join(claimed.select("product_key", "value").distinct(), ["product_key", "value"], "left_anti")
    best = F.min_by(F.struct("value", (0.4 * sure(F.col("confidence"))).alias("confidence")), F.struct(-F.length("text"), F.col("line_no")))
    return free.groupBy("product_key").agg(best.alias("m")).select("product_key", F.lit("Product_Description").alias("field"), "m.value", "m.confidence", F.lit("heuristic:longest-front-sentence").alias("source"))


def keep_best(fields: DataFrame) -> DataFrame:
    """One row a field: the most confident; of equals, the smallest `order`. Blank values don't count."""
    held = fields.where(tx.strip(F.col("value")) != "")
    best = F.max_by(F.struct("value", "confidence", "source"), F.struct("confidence", -F.col("order"))).alias("m")
    return held.groupBy("product_key", "field").agg(best).select("product_key", "field", "m.value", "m.confidence", "m.source")


def parse(text_lines: DataFrame, layout_lines: DataFrame | None = None, barcodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fields, bullets) of every product. barcodes: product_key, code, valid_checksum, canonical_*.

    The fields are used twice, as the description is a sentence that none of them has taken; adaptive
    execution computes their shuffles once. Lines already dealt by product_key aren't shuffled again.
    """
    parts = extract_fields(text_lines).unionByName(extract_blocks(text_lines)).unionByName(extract_front(layout_lines if layout_lines is not None else text_lines, barcodes))
    if barcodes is not None:
        codes = barcodes.where("code is not null and valid_checksum").select("product_key", F.lit("Upc / Ean").alias("field"), F.col("code").alias("value"), F.lit(1.0).alias("confidence"), F.lit("barcode:decoded").alias("source"))
        parts = parts.unionByName(codes)
    return parts.unionByName(extract_description(text_lines, parts)), extract_bullets(text_lines)
