"""Barcode functions as Column expressions (EAN-13, with UPC-A as its zero-padded form)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_letter, only_digits, strip

TEXT_MATCH = 0.4  # least share of a code's digits that its text must show


def _weighted(code: Column, odd: int) -> Column:
    """Sum of the first twelve digits; those at odd places weigh `odd`, the others 4 - odd."""
    total = F.lit(0)
    for k in range(12):
        total = total + F.substring(code, k + 1, 1).cast("int") * (odd if k % 2 == 0 else 4 - odd)
    return total


def checksum_valid(code: Column) -> Column:
    """Whether a 13-digit code (or a 12-digit one, with a leading 0) has the right check digit."""
    full = F.when(F.rlike(code, F.lit("^[0-9]{12}$")), F.concat(F.lit("0"), code)).when(F.rlike(code, F.lit("^[0-9]{13}$")), code)
    last = F.substring(full, 13, 1).cast("int")
    return F.coalesce((10 - _weighted(full, 1) % 10) % 10 == last, F.lit(False))


def is_valid(code: str) -> bool:
    """checksum_valid of one code, for decoders that run outside of a query."""
    if not code.isascii() or not code.isdigit() or len(code) not in (12, 13):
        return False
    figures = [int(c) for c in code.zfill(13)]
    return (sum(figures[::2]) + 3 * sum(figures[1::2])) % 10 == 0


def restricted_prefix(code: Column) -> Column:
    """Prefixes that no retail product carries."""
    return F.rlike(code, F.lit("^(2|02|04)"))


def recover_leading_digit(run: Column) -> Column:
    """The 13-digit code of a 12-digit run whose first digit was lost; null if there is none.

    The first place has weight 1, so exactly one digit makes the checksum right.
    """
    held = F.when(F.rlike(run, F.lit("^[0-9]{12}$")), run)
    total = F.lit(0)
    for k in range(11):
        total = total + F.substring(held, k + 1, 1).cast("int") * (3 if k % 2 == 0 else 1)
    total = total + F.substring(held, 12, 1).cast("int")
    code = F.concat(((10 - total % 10) % 10).cast("string"), held)
    return F.when(~restricted_prefix(code), code)


def _by_distance(runs: Column) -> Column:
    """Runs by their length's distance from 13, then by value."""
    ordered = F.array_sort(F.transform(F.array_distinct(runs), lambda r: F.struct(F.abs(F.length(r) - 13).alias("d"), r.alias("r"))))
    return F.transform(ordered, lambda s: s["r"])


def candidates_from_text(text: Column) -> Column:
    """Distinct digit runs of 11 to 14, longest first, then by value."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]{11,14}"), F.lit(0)))
    ordered = F.array_sort(F.transform(runs, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r"))))
    return F.transform(ordered, lambda s: s["r"])


def digit_lines(text: Column) -> Column:
    """The digits of each line that has digits and no letters."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda s: ~has_letter(s))
    return F.filter(F.transform(lines, lambda s: only_digits(strip(s))), lambda d: d != "")


def barcode_line_runs(text: Column) -> Column:
    """Runs of 11 to 14 digits from digit-only lines, two or three short neighbours merged.

    Nearest to 13 digits first, then by value.
    """

    def runs(ds: Column) -> Column:
        def at(d: Column, i: Column) -> Column:
            one, two = F.get(ds, i + 1), F.get(ds, i + 2)
            short = lambda x: F.coalesce(F.length(x) < 11, F.lit(False))
            fits = lambda x: F.length(x).between(11, 14)
            pair, three = F.concat(d, one), F.concat(d, one, two)
            none = F.lit(None).cast("string")
            own = F.when(fits(d), d).otherwise(none)
            merged = F.when(short(d) & short(one) & fits(pair), pair).otherwise(none)
            longer = F.when(short(d) & short(one) & (F.length(pair) <= 14) & short(two) & fits(three), three).otherwise(none)
            return F.array(own, merged, longer)

        return F.filter(F.flatten(F.transform(ds, at)), lambda x: x.isNotNull())

    return _by_distance(F.get(F.transform(F.array(digit_lines(text)), runs), F.lit(0)))


def text_match(code: Column, text: Column) -> Column:
    """Length of the longest part of the code that the text's digits show, as a share of the code."""
    shown = only_digits(text)
    n = F.length(code)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(code, i, k))))
    longest = F.array_max(F.transform(F.filter(parts, lambda p: F.contains(shown, p)), lambda p: F.length(p)))
    return F.when((n > 0) & (shown != ""), F.coalesce(longest, F.lit(0)) / n).otherwise(0.0)


def trusted_decode(code: Column, text: Column) -> Column:
    """A decoded code is trusted unless its first digit is 0, 1 or 2 and the print doesn't bear it out."""
    return checksum_valid(code) & (~F.rlike(code, F.lit("^[012]")) | (text_match(code, text) >= 0.5))


def find_barcode(decoded: Column, text: Column) -> Column:
    """struct<code, source, unverified>: the best code by decode, digit line, then any digit run.

    Where nothing is verified, `unverified` holds a recovered or raw run from a digit line.
    """
    lines, others = barcode_line_runs(text), candidates_from_text(text)
    sound = lambda runs: F.get(F.filter(runs, lambda r: (F.length(r) == 13) & checksum_valid(r)), F.lit(0))
    bars = F.when(trusted_decode(decoded, text), decoded)
    code = F.coalesce(bars, sound(lines), sound(others))
    recovered = F.get(F.filter(F.transform(lines, recover_leading_digit), lambda r: r.isNotNull()), F.lit(0))
    source = F.when(bars.isNotNull(), "bars").when(code.isNotNull(), "ocr_digits").otherwise("")
    return F.struct(code.alias("code"), source.alias("source"), F.when(code.isNull(), F.coalesce(recovered, F.get(lines, F.lit(0)))).alias("unverified"))
