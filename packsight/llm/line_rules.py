"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: punctuation (share of symbol characters), navigation (separators
between few words), shouting, boilerplate phrases, and lines already seen in the same text. Failing
lines are removed; a document that loses too large a share of its characters is rejected. A base
test on word count and repeated five-word windows rejects documents before that.

Defined results: a null text counts as empty; an empty text has no words and fails the base test;
lines without a word are dropped and weigh nothing; very long texts are read whole; repeated rows are
judged each by itself; an empty table gives an empty one; columns other than doc_id are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›·•"
WINDOW = 5

# Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign in",
    "subscribe to our",
    "terms of use",
)


def _count(text: Column, characters: str) -> Column:
    """How many characters of the text are among the given ones."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(found: Column) -> Column:
    """A hash of each five-word window, in order."""
    starts = F.when(F.size(found) >= WINDOW, F.sequence(F.lit(1), F.size(found) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    return _let(F.transform(found, lambda w: F.xxhash64(w)), lambda each: F.transform(starts, lambda i: F.xxhash64(*(F.get(each, i + k) for k in range(-1, WINDOW - 1)))))


def _covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more."""

    def repeated(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        marked = F.transform(ordered, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    at = _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + WINDOW).alias("end"))
    return F.when(F.size(hashes) > F.size(F.array_distinct(hashes)), F.aggregate(at, zero, step)["n"]).otherwise(0)


def line_fails(line: Column) -> Column:
    """Whether a line fails the punctuation, navigation, shouting or boilerplate rule."""
    solid = F.length(F.translate(line, WHITE, ""))
    spaces = _count(line, WHITE)
    punctuation = 100 * _count(line, SYMBOLS + "!?") > 20 * solid
    separators = _count(line, SEPARATORS)
    navigation = (separators >= 3) & (3 * separators >= spaces)
    shouting = (spaces >= 4) & (F.upper(line) == line) & (F.lower(line) != line)
    boilerplate = F.rlike(line, F.lit("(?iu)" + "|".join(BOILERPLATE)))
    return punctuation | navigation | shouting | boilerplate


def clean_lines(docs: DataFrame, max_loss: float = 0.3, min_words: int = 10, max_repeat: float = 0.2) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts, verdict and the text that is left.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    lost_chars, kept, clean_text. kept is false where the base test fails or where more than
    max_loss of the word characters are in removed lines.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        words(F.col("text")).alias("found"),
        F.split("text", "\n", -1).alias("lines"),
    )
    full = read.select(
        "doc_id",
        F.size("found").alias("n_words"),
        F.length(F.translate("text", WHITE, "")).alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        F.filter("lines", lambda x: F.rlike(x, F.lit(WORD))).alias("full"),
        _windows(F.col("found")).alias("hashes"),
    )
    judged = full.select(
        "*",
        (F.size("full") - F.size(F.array_distinct("full"))).alias("n_dup_lines"),
        _covered(F.col("hashes")).alias("n_repeat_words"),
        F.filter(F.array_distinct("full"), lambda x: ~line_fails(x)).alias("good"),
    )
    good_chars = F.aggregate(F.transform("good", lambda x: F.length(F.translate(x, WHITE, ""))), F.lit(0), lambda a, n: a + n)
    result = judged.select(
        "doc_id",
        *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > F.lit(round(100 * max_repeat)) * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") - good_chars).cast("long").alias("lost_chars"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= F.lit(round(100 * max_loss)) * F.col("word_chars"))
    return result.withColumn("kept", kept)
