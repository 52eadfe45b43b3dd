"""Text functions as Column expressions: normalisation, digit signatures, presence tests, counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from both ends of a normalised text, and texts that mean "blank".
EDGE = " \t.,:;-_/|®™©()[]"
BLANKS = ("", "null", "none", "n/a", "na", "-", "--")

# Markers of a back panel.
PANEL_MARKERS = (
    "ingredient",
    "nutrition",
    "nutritional",
    "fssai",
    "lic no",
    "best before",
    "customer care",
    "manufactured",
    "mfd",
    "mfg",
    "packed",
    "net wt",
    "net weight",
    "storage",
    "allergen",
    "consumer",
    "shelf life",
    "batch",
    "expiry",
)

# Words that mark a line as back-panel print, never as a brand or product name.
BACK_PANEL_WORDS = (
    "ingredient",
    "nutrition",
    "manufactured",
    "marketed",
    "packed",
    "fssai",
    "lic",
    "customer",
    "care",
    "consumer",
    "storage",
    "store in",
    "best before",
    "batch",
    "mfg",
    "www.",
    ".com",
    "email",
    "phone",
    "toll",
    "regd",
    "office",
    "address",
    "net wt",
    "net qty",
    "allergen",
    "contains",
    "shelf life",
    "expiry",
    "recycle",
    "@",
)

NUMERIC_FIELDS = ("Mrp", "Fssai No", "Upc / Ean")
WHITE = "[\\x20\\x09-\\x0D]"


def strip(text: Column) -> Column:
    """Without white space at both ends (ASCII white space, tabs and line ends included)."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def norm(text: Column) -> Column:
    """Lower case, white space collapsed, edge punctuation removed."""
    return F.btrim(F.regexp_replace(strip(F.lower(text)), f"{WHITE}+", " "), F.lit(EDGE))


def is_blank(text: Column) -> Column:
    """Null, or one of the texts that mean blank."""
    return text.isNull() | norm(text).isin(*BLANKS)


def array_is_empty(values: Column) -> Column:
    return values.isNull() | (F.size(values) == 0)


def blank_to_null(text: Column) -> Column:
    """The stripped text; null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def digits(value: Column) -> Column:
    """Digit signature: a number with an integral value gives its integer's digits (155.0 -> 155)."""
    s = strip(value)
    numeric = F.rlike(s, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"))
    wide = F.when(numeric, s).try_cast("decimal(30,10)")
    whole = wide.try_cast("decimal(20,0)")
    return F.when(numeric & wide.isNotNull() & (wide == whole), whole.cast("string")).otherwise(only_digits(s))


def first_number(value: Column) -> Column:
    return F.regexp_extract(value, "[0-9]+", 0)


def number_in(value: Column) -> Column:
    """The first signed decimal of a text, or null."""
    return F.nullif(F.regexp_extract(value, r"-?[0-9]+\.?[0-9]*", 0), F.lit("")).try_cast("double")


def safe_int(value: Column) -> Column:
    """Integer part of a number in text; null where it isn't one."""
    return strip(value).try_cast("double").try_cast("int")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text contains one of the words."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(w)) for w in words))


def has_panel(text: Column) -> Column:
    return contains_any(text, PANEL_MARKERS)


def has_letter(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\p{L}"))


def is_front_text(text: Column) -> Column:
    """Three characters or more, a letter, no back-panel word."""
    return (F.length(strip(text)) >= 3) & has_letter(text) & ~contains_any(text, BACK_PANEL_WORDS)


def non_latin(text: Column) -> Column:
    """Any character outside of ASCII."""
    return F.rlike(text, F.lit(r"[^\x00-\x7F]"))


def count_range(text: Column, low: str, high: str) -> Column:
    """Characters between two code points."""
    return F.length(F.regexp_replace(text, f"[^{low}-{high}]", ""))


def cjk(text: Column) -> Column:
    return count_range(text, "一", "鿿")


def devanagari(text: Column) -> Column:
    return count_range(text, "ऀ", "ॿ")


def found(field: Column, value: Column, text: Column) -> Column:
    """Whether a ground-truth value can be recovered from the text; null if there is no value.

    Numeric fields look for the digit signature in all digits of the text, net quantity for the
    value's digits; other fields for the normalised value, or three quarters of its words.
    """
    s = strip(value)
    none = value.isNull() | s.isin("", "-", "--")
    all_digits = only_digits(text)
    signature, plain = digits(value), only_digits(value)
    v, t = norm(value), norm(text)
    tokens = F.filter(F.split(v, " "), lambda x: x != "")
    hit = F.size(F.filter(tokens, lambda x: F.contains(t, x)))
    textual = F.when(v == "", F.lit(None).cast("boolean")).otherwise(F.contains(t, v) | (hit * 4 >= F.size(tokens) * 3))
    return (
        F.when(none, F.lit(None).cast("boolean"))
        .when(field.isin(*NUMERIC_FIELDS), (signature != "") & F.contains(all_digits, signature))
        .when(field == "Net Quantity", (plain != "") & F.contains(all_digits, plain))
        .otherwise(textual)
    )


def found_strict(value: Column, text: Column) -> Column:
    """The digit signature as a number of its own, not across neighbouring numbers."""
    d = digits(value)
    return (d != "") & F.array_contains(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), d)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the sets of normalised words; 0 if either has none."""
    ta, tb = (F.array_distinct(F.filter(F.split(norm(x), " "), lambda w: w != "")) for x in (a, b))
    both = F.size(ta) + F.size(tb)
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), 2.0 * F.size(F.array_intersect(ta, tb)) / both).otherwise(0.0)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def title(text: Column) -> Column:
    """Each letter after a non-letter in upper case, all others in lower case."""

    def join(chars: Column) -> Column:
        after = lambda i: (i == 0) | ~F.rlike(F.get(chars, i - 1), F.lit(r"\p{L}"))
        return F.array_join(F.transform(chars, lambda c, i: F.when(after(i), F.upper(c)).otherwise(F.lower(c))), "")

    return once(F.split(text, ""), join)


def clean_entity(text: Column) -> Column:
    """A captured name up to the first hard delimiter, without edge punctuation."""
    cut = F.get(F.split(text, r"[,;|]|[\x20\x09-\x0D]{3,}|[0-9]{5,}", 2), F.lit(0))
    return strip(F.btrim(cut, F.lit(" .,:;-–")))


def strip_fence(text: Column) -> Column:
    """JSON text without a code fence around it."""
    s = strip(text)
    opened = F.regexp_replace(s, r"^```[^\n]*\n", "")
    bare = strip(F.regexp_replace(F.regexp_replace(opened, r"^```", ""), r"```$", ""))
    return F.when(F.startswith(s, F.lit("```")), strip(F.regexp_replace(bare, r"^json", ""))).otherwise(s)
