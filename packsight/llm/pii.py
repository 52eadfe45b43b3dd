"""Personal data by candidate boosting, in DataFrame functions only.

High-recall generators (one pattern a kind) propose spans, which may overlap between kinds. The base
spans (email, ip, card, phone with their validity tests) always stay. Every other candidate
that isn't inside a base span gets format and context features, a score from boosted trees, and is
selected by its kind's threshold.
The trees are fitted on a generated table of labelled examples and applied as a SQL expression;
each kind's threshold is calibrated on the half of the examples that the trees have not seen.

Patterns use possessive quantifiers and look-behinds where these give the same matches, so that
long runs of digits or letters cost linear time and no deep recursion.

Defined results: a null text counts as empty; an empty text has no spans; very long texts are searched
whole; positions are code points, ends exclusive; spans of different kinds may overlap and are ordered
by start, then kind as listed; repeated rows are searched each by itself; an empty table gives an
empty one; an existing column of the result's name is replaced, others stay.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import fresh

_LOCAL = r"A-Za-z0-9._%+-"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"

#: kind -> pattern of its generator; the first four are the base kinds.
GENERATORS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9])(?![\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "phone_local": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
    "email_spelled": r"(?i)(?<![A-Z0-9._-])[A-Z0-9._-]++\x20?[\[(]at[\])]\x20?[A-Z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?<![A-Z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key|key)\x20?[=:]\x20?[\"']?[A-Z0-9/+_.-]{6,}+[\"']?",
}
KINDS = tuple(GENERATORS)
BASE = KINDS[:4]
#: A text without a match of this has no candidate of the kind.
_NEEDS = {"email": "@", "phone": "+", "email_spelled": "(?i)at", "secret": "[=:]"}

FEATURES = ("kind", "length", "digits", "letters", "digit_share", "distinct_share", "groups", "upper_share", "valid", "cue", "contrary", "glued", "figures")
_CUES = r"(?i)(?:phone|tel|call|mobile|fax|mail|contact|card|visa|account|acct|iban|ssn|social|security|id|password|passwd|token|secret|key|ip|address|login)\W{0,3}(?:no|number|nr|is)?\W{0,4}$"
_CONTRARY = r"(?i)(?:version|build|release|isbn|order|invoice|item|sku|part|figure|section|page|model|serial|width|example|ratio|score)\W{0,3}(?:no|number|nr|is)?\W{0,4}$"
CONTEXT = 24


def _valid(kind: str, value: Column) -> Column:
    """Whether a match passes its kind's own test."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches: array of kind number, start, end, value, valid."""
    pattern = GENERATORS[kind]
    number = KINDS.index(kind)
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,value:string,valid:boolean>>")
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, m: Column) -> Column:
        start, value = acc["at"] + m["gap"], m["value"]
        end = start + F.coalesce(F.length(value), F.lit(0))
        span = F.struct(F.lit(number).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"), _valid(kind, value).alias("valid"))
        return F.struct(end.alias("at"), F.when(value.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    found = F.aggregate(pairs, zero, step)["out"]
    return F.when(F.rlike(text, F.lit(_NEEDS.get(kind, "[0-9]").replace("+", r"\+"))), found).otherwise(empty)


def _features(value: Column, kind: Column, valid: Column, before: Column, after: Column) -> Column:
    """The struct of FEATURES of a candidate."""
    length = F.length(value)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(value, "[^A-Z]", ""))
    distinct = F.size(F.array_distinct(F.split(value, "")))
    glued = F.rlike(before, F.lit(r"[A-Za-z0-9.#/-]$")).cast("int") + F.rlike(after, F.lit(r"^[A-Za-z0-9/-]")).cast("int")
    values = (
        kind,
        length,
        digits,
        letters,
        digits / F.greatest(F.lit(1), length),
        distinct / F.greatest(F.lit(1), length),
        F.size(F.split(value, r"[^A-Za-z0-9]+")),
        upper / F.greatest(F.lit(1), letters),
        valid.cast("int"),
        F.rlike(before, F.lit(_CUES)).cast("int"),
        F.rlike(before, F.lit(_CONTRARY)).cast("int"),
        glued,
        (digits > 0).cast("int"),
    )
    return F.struct(*(v.cast("double").alias(name) for name, v in zip(FEATURES, values)))


def examples(spark: SparkSession, rows: int = 7200) -> DataFrame:
    """Generated labelled candidates: kind, value, before, after, label.

    Positives have a kind's format with a fitting or neutral context; negatives are look-alikes
    (failed checksums, version numbers, measures, placeholders) or stand in contrary contexts.
    """
    r = lambda salt, n: f"cast(pmod(xxhash64(id, {salt}), {n}) as int)"
    pick = lambda salt, *words: f"element_at(array({', '.join(repr(w) for w in words)}), {r(salt, len(words))} + 1)"
    num = lambda salt, n: f"lpad(cast({r(salt, 10**n)} as string), {n}, '0')"
    hexa = lambda salt, n: f"substr(sha2(concat(id, '-{salt}'), 256), 1, {n})"
    octet = lambda salt: f"cast({r(salt, 256)} as string)"
    good = {
        "email": f"concat({hexa(1, 6)}, '@', {pick(2, 'mail', 'corp', 'host')}, '.example')",
        "ip": f"concat_ws('.', {octet(3)}, {octet(4)}, {octet(5)}, {octet(6)})",
        "card": f"get(filter(transform(sequence(0, 9), d -> concat('4', {num(7, 4)}, {num(8, 5)}, {num(9, 5)}, d)), x -> luhn_check(x)), 0)",
        "phone": f"concat('+', {pick(10, '1', '44', '49')}, ' ', {num(11, 3)}, ' ', {num(12, 7)})",
        "phone_local": f"concat({pick(65, '(', '')}, {num(13, 3)}, case when {r(65, 2)} = 0 then ') ' else {pick(66, '-', '.')} end, {num(14, 3)}, case when {r(65, 2)} = 0 then '-' else {pick(66, '-', '.')} end, {num(15, 4)})",
        "email_spelled": f"concat(repeat({hexa(16, 5)}, case when {r(73, 3)} = 0 then 6 + {r(74, 14)} else 1 end), ' [at] ', {pick(17, 'mail', 'corp')}, ' [dot] example')",
        "iban": f"concat({pick(18, 'DE', 'FR', 'GB')}, {num(19, 2)}, {num(20, 8)}, {num(21, 8)}, {num(22, 2)})",
        "national_id": f"concat({num(23, 3)}, '-', {num(24, 2)}, '-', {num(25, 4)})",
        "secret": f"concat({pick(26, 'password', 'token', 'api_key')}, {pick(27, '=', ' = ', ': ')}, case when {r(67, 2)} = 0 then concat({pick(68, 'hunter', 'Summer', 'blue', 'Tiger')}, substr({num(69, 3)}, 1, {r(72, 3)} + 1), {pick(70, 'secret', 'x', 'Moon', '')}) else {hexa(28, 20)} end)",
    }
    bad = {
        "email": f"concat({pick(31, 'user', 'name')}, '@', {pick(32, '1', '2')}, '.0')",
        "ip": f"concat_ws('.', {num(33, 3)}, {num(34, 4)}, {num(35, 1)}, {num(36, 3)})",
        "card": f"get(filter(transform(sequence(0, 9), d -> concat({num(37, 5)}, {num(53, 5)}, {num(54, 5)}, d)), x -> not luhn_check(x)), {r(55, 9)})",
        "phone": f"concat('+', {num(38, 1)}, '.', {num(39, 2)})",
        "phone_local": f"concat({num(40, 3)}, {pick(71, ' ', ' ', '-', '.')}, {num(41, 3)}, {pick(71, ' ', ' ', '-', '.')}, {num(42, 4)})",
        "email_spelled": f"concat({pick(43, 'look', 'meet')}, ' (at) ', {pick(44, 'noon', 'home')}, ' (dot) ', {num(45, 1)})",
        "iban": f"concat('AA00', {pick(46, 'ABCD', 'WXYZ')}, 'ABCDEFGH')",
        "national_id": f"concat({num(47, 3)}, '-', {num(48, 2)}, '-', {num(49, 4)})",
        "secret": f"concat({pick(50, 'key', 'token', 'password')}, {pick(51, ': ', '=')}, {pick(52, 'required', 'optional', 'changeme', 'element', 'words')})",
    }
    case = lambda values: "case k " + " ".join(f"when {i} then {values[kind]}" for i, kind in enumerate(KINDS)) + " end"
    base = spark.range(rows).selectExpr("id", f"cast(id % {len(KINDS)} as int) as k", f"{r(60, 2)} as label")
    made = base.selectExpr(
        "k",
        "label",
        f"if(label = 1, {case(good)}, {case(bad)}) as value",
        f"if(label = 1, {pick(61, 'my phone: ', 'contact ', 'card number ', 'the ', 'and ', 'account ', 'IBAN: ', 'ssn ', '')}, {pick(62, 'version ', 'order no ', 'part ', 'the ', 'isbn ', 'item x', 'figure ', 'serial ')}) as before",
        f"if(label = 1, {pick(63, ' and', '.', ', the', '')}, {pick(64, ' and', 'x', '-7', '/2', ' mm')}) as after",
    )
    valid = reduce(lambda rest, kind: F.when(F.col("k") == KINDS.index(kind), _valid(kind, F.col("value"))).otherwise(rest), BASE, F.lit(True))
    return made.select("k", "label", _features(F.col("value"), F.col("k"), valid, F.col("before"), F.col("after")).alias("f"))


def fit(spark: SparkSession, precision: float = 0.95) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees, and each kind's lowest threshold that keeps the precision on unseen examples."""
    rows = examples(spark).select("k", "label", "f.*").collect()
    x = np.array([[r[name] for name in FEATURES] for r in rows])
    y, k = np.array([r["label"] for r in rows], dtype=float), np.array([r["k"] for r in rows])
    unseen = np.arange(len(rows)) // len(KINDS) % 2 == 1
    model = BoostedTrees.fit(FEATURES, x[~unseen], y[~unseen])
    scores, thresholds = model.score(x[unseen]), {}
    for number, kind in enumerate(KINDS):
        own = k[unseen] == number
        s, t = scores[own], y[unseen][own]
        enough = [cut for cut in np.linspace(0.5, 0.99, 50) if (s >= cut).any() and t[s >= cut].mean() >= precision]
        thresholds[kind] = float(min(enough, default=1.0))
    return model, thresholds


def find(docs: DataFrame, text: str = "text", into: str = "pii", model: tuple[BoostedTrees, dict[str, float]] | None = None) -> DataFrame:
    """Add an array of spans (kind, start, end, value, base, score), ordered by start and kind."""
    trees, thresholds = model or fit(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    found = fresh(docs, "__found")
    candidates = docs.withColumn(found, F.concat(*(_matches(whole, kind) for kind in KINDS)))
    cuts = F.array(*(F.lit(thresholds[kind]) for kind in KINDS))
    names = F.array(*map(F.lit, KINDS))

    def judged(c: Column) -> Column:
        base = (c["kind"] < len(BASE)) & c["valid"]
        before = F.substring(whole, F.greatest(F.lit(1), c["start"] - CONTEXT + 1), F.least(F.lit(CONTEXT), c["start"]))
        row = _features(c["value"], c["kind"], c["valid"], before, F.substring(whole, c["end"] + 1, F.lit(3)))
        score = F.get(F.transform(F.array(row), trees.column), F.lit(0))
        return F.struct(
            c["start"].alias("start"), c["kind"].alias("number"), F.get(names, c["kind"]).alias("kind"), c["end"].alias("end"), c["value"].alias("value"), base.alias("base"), F.when(base, F.lit(1.0)).otherwise(score).alias("score")
        )

    within = lambda s: F.exists(found, lambda b: (b["kind"] < len(BASE)) & b["valid"] & (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    chosen = lambda s: s["base"] | ((s["score"] >= F.get(cuts, s["number"])) & ~within(s))
    kept = F.filter(F.transform(found, judged), chosen)
    return candidates.withColumn(into, F.sort_array(kept)).drop(found)


def redact(docs: DataFrame, text: str = "text", model: tuple[BoostedTrees, dict[str, float]] | None = None) -> DataFrame:
    """Replace every selected span by its kind in brackets; spans that overlap become one.

    A null text stays null. Columns and their order stay.
    """
    pii, spans = fresh(docs, "__pii"), fresh(docs, "__spans")
    found = find(docs, text, pii, model)
    item = "struct<kind:string,start:int,end:int>"
    zero = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast(item).alias("open"))

    def step(acc: Column, s: Column) -> Column:
        span = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        joins = acc["open"].isNotNull() & (s["start"] < acc["open"]["end"])
        longer = F.struct(acc["open"]["kind"].alias("kind"), acc["open"]["start"].alias("start"), F.greatest(acc["open"]["end"], s["end"]).alias("end"))
        closed = F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(F.when(joins, acc["done"]).otherwise(closed).alias("done"), F.when(joins, longer).otherwise(span).alias("open"))

    finish = lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
    merged = F.aggregate(pii, zero, step, finish)
    cut = found.withColumn(spans, merged)
    from_ = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    parts = F.transform(spans, lambda s, i: F.concat(F.substring(F.col(text), from_(i) + 1, s["start"] - from_(i)), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rest = F.substring(F.col(text), F.element_at(spans, -1)["end"] + 1, F.length(text))
    clean = F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col(text))
    return cut.withColumn(text, clean).select(*docs.columns)
