"""Recognisers in cost order: a registry, one call a distinct input, staged escalation, caches.

A recogniser is any function of (image bytes or text) to a list of lines; engines that need models or
services are plugged in here. A later stage is planned only over rows that the earlier one left
weak, and each stage's results are written before the next is planned, so that neither a retry nor
a second branch calls an engine twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shipping import ship

LINES = "array<struct<text:string,confidence:double,box:array<struct<x:int,y:int>>>>"
CACHE = f"key string, engine string, lines {LINES}, cost_usd double, failed boolean"


@dataclass(frozen=True)
class Engine:
    """`run` takes one payload and returns lines; it may raise.

    A line is (text, confidence) or, of engines that see where it is, (text, confidence, box), the box
    being its corners as (x, y) pairs in pixels.
    """

    name: str
    run: Callable[[object], list[tuple]]
    cost_usd: float = 0.0
    paid: bool = False
    available: Callable[[], bool] = lambda: True


@dataclass(frozen=True)
class Policy:
    min_confidence: float = 0.65
    min_chars: int = 40
    require_digits: bool = False
    allow_paid: bool = False
    union_free: bool = False
    budget_usd: float | None = None


@dataclass
class Registry:
    """Engines in the order in which they are tried; the first free one is tier 1."""

    engines: list[Engine] = field(default_factory=list)

    def add(self, engine: Engine) -> None:
        self.engines.append(engine)

    def ready(self, paid: bool) -> list[Engine]:
        return [e for e in self.engines if e.paid == paid and e.available()]


def content_key(payload: Column, *shape: Column) -> Column:
    """Hash of a payload and, for pixels, its shape."""
    return F.sha2(F.concat(*(F.concat(s.cast("string"), F.lit(":")).cast("binary") for s in shape), payload.cast("binary")), 256)


def char_count(lines: Column) -> Column:
    return F.aggregate(F.transform(lines, lambda x: F.length(x["text"])), F.lit(0), lambda a, n: a + n)


def mean_confidence(lines: Column) -> Column:
    """Mean of the known confidences; null without any."""
    known = F.filter(F.transform(lines, lambda x: x["confidence"]), lambda c: c.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, c: a + c), F.size(known))


def weakness(lines: Column, policy: Policy) -> Column:
    """The first reason not to trust a read, or null. Lines without a character are no text."""
    reason = F.when(lines.isNull() | (F.size(lines) == 0) | (char_count(lines) == 0), "no text").when(char_count(lines) < policy.min_chars, "few characters").when(mean_confidence(lines) < policy.min_confidence, "low confidence")
    if policy.require_digits:
        reason = reason.when(~F.exists(lines, lambda x: F.rlike(x["text"], F.lit("[0-9]"))), "no digits")
    return reason


def _line(text: str, confidence: float | None, box: list[tuple[int, int]] | None = None) -> dict:
    return {"text": text, "confidence": confidence, "box": None if box is None else [{"x": int(x), "y": int(y)} for x, y in box]}


def run_engine(inputs: DataFrame, engine: Engine) -> DataFrame:
    """Cache rows of distinct inputs (key, payload). An engine's error gives a failed row."""
    ship(inputs.sparkSession)
    run, name, cost = engine.run, engine.name, engine.cost_usd

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, payload in zip(frame["key"], frame["payload"]):
                try:
                    lines, failed = [_line(*line) for line in run(payload)], False
                except Exception:
                    lines, failed = [], True
                rows.append((key, name, lines, 0.0 if failed else cost, failed))
            yield pd.DataFrame(rows, columns=["key", "engine", "lines", "cost_usd", "failed"])

    return inputs.dropDuplicates(["key"]).select("key", "payload").mapInPandas(apply, CACHE)


def cached(cache: DataFrame, engine: str) -> DataFrame:
    """An engine's usable cache rows; failed reads are tried again."""
    return cache.where((F.col("engine") == engine) & ~F.col("failed"))


def missing(inputs: DataFrame, cache: DataFrame, engine: str) -> DataFrame:
    """Inputs that an engine has no usable cache row for (an anti join)."""
    return inputs.join(cached(cache, engine), "key", "left_anti")


def within_budget(inputs: DataFrame, engine: Engine, budget_usd: float | None) -> DataFrame:
    """The inputs, in key order, that a paid engine may be called for."""
    if budget_usd is None or not engine.cost_usd:
        return inputs
    return inputs.dropDuplicates(["key"]).orderBy("key").limit(int(budget_usd / engine.cost_usd + 1e-9))


def merge_engines(reads: DataFrame) -> DataFrame:
    """One read a key from those of several engines (key, engine, lines, cached).

    Lines follow each other by engine name; the merged read costs nothing again and counts as cached
    only if all of its parts were. A key has one row an engine.
    """
    parts = F.array_sort(F.collect_list(F.struct("engine", "lines", "cached"))).alias("parts")
    grouped = reads.groupBy("key").agg(parts)
    each = lambda name: F.transform("parts", lambda x: x[name])
    return grouped.select("key", F.array_join(each("engine"), "+").alias("engine"), F.flatten(each("lines")).alias("lines"), F.lit(0.0).alias("cost_usd"), F.forall("parts", lambda x: x["cached"]).alias("cached"))


def latest(cache: DataFrame) -> DataFrame:
    """One row a key and engine, the last written (by `seq`)."""
    w = Window.partitionBy("key", "engine").orderBy(F.desc("seq"))
    return cache.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def dedupe_then_apply(rows: DataFrame, key: str, value: str, function: Callable[[Column], Column], into: str) -> DataFrame:
    """Evaluate an expensive expression once a distinct key, then join it back."""
    distinct = rows.select(key, value).dropDuplicates([key]).select(key, function(F.col(value)).alias(into))
    return rows.join(distinct, key, "left")


@dataclass
class Ladder:
    """Staged escalation. `store(df, name)` writes a stage's new cache rows and returns them as read back."""

    registry: Registry
    policy: Policy
    store: Callable[[DataFrame, str], DataFrame]

    def _stage(self, inputs: DataFrame, cache: DataFrame | None, engine: Engine, budget_usd: float | None = None) -> DataFrame:
        todo = inputs if cache is None else missing(inputs, cache, engine.name)
        if engine.paid:
            todo = within_budget(todo, engine, budget_usd)
        new = self.store(run_engine(todo, engine), engine.name).withColumn("cached", F.lit(False))
        if cache is None:
            return new
        old = cached(cache, engine.name).join(inputs.select("key").distinct(), "key", "left_semi").withColumns({"cached": F.lit(True), "cost_usd": F.lit(0.0)})
        return new.unionByName(old.select(*new.columns))

    def read(self, inputs: DataFrame, cache: DataFrame | None = None) -> DataFrame:
        """key, engine, lines, cost_usd, cached, reason, trail for every distinct input (key, payload).

        A later free engine replaces an earlier read if it has more characters; a paid one if it is
        not weak or has more. What fails or is unavailable leaves the best read so far.
        """
        free, paid = self.registry.ready(False), self.registry.ready(True) if self.policy.allow_paid else []
        best: DataFrame | None = None
        left = self.policy.budget_usd
        for engine in [*free, *paid]:
            todo = inputs if best is None or (self.policy.union_free and not engine.paid) else inputs.join(best.where("reason is not null"), "key", "left_semi")
            stage = self._stage(todo, cache, engine, left)
            if engine.paid and left is not None:  # what this engine has cost isn't there for the next
                left -= stage.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).first()[0]
            got = stage.select("key", F.struct("engine", "lines", "cost_usd", "cached", weakness(F.col("lines"), self.policy).alias("reason")).alias("new"))
            if best is None:
                best = got.select("key", "new.*").withColumn("trail", F.array(F.concat_ws(" ", "engine", F.coalesce(F.concat(F.lit("weak: "), F.col("reason")), F.lit("accepted")))))
                continue
            joined = best.join(got, "key", "left")
            if self.policy.union_free and not engine.paid:
                lines = F.concat("lines", F.coalesce("new.lines", F.array().cast(LINES)))
                merged = joined.withColumn("lines", lines).withColumn("engine", F.concat_ws("+", "engine", "new.engine")).withColumn("cached", F.col("cached") & F.coalesce("new.cached", F.lit(True)))
                best = merged.withColumn("reason", weakness(F.col("lines"), self.policy)).withColumn("trail", F.concat("trail", F.array(F.concat(F.lit(engine.name), F.lit(" merged"))))).drop("new")
                continue
            more = char_count(F.col("new.lines")) > F.coalesce(char_count(F.col("lines")), F.lit(0))
            take = F.col("new").isNotNull() & ((F.col("new.reason").isNull() | more) if engine.paid else more)
            step = F.when(F.col("new").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat_ws(" ", F.lit(engine.name), F.when(take, F.lit("kept")).otherwise(F.lit("no better")))))
            chosen = {c: F.when(take, F.col(f"new.{c}")).otherwise(F.col(c)) for c in ("engine", "lines", "cost_usd", "cached", "reason")}
            best = joined.select("key", *(v.alias(c) for c, v in chosen.items()), F.concat("trail", step).alias("trail"))
        if best is None:
            raise ValueError("no recogniser is available")
        return best

    def read_dual(self, inputs: DataFrame, cache: DataFrame | None = None) -> DataFrame:
        """key, layout_lines (tier 1, with geometry), text_lines (the next free engine's, else tier 1's)."""
        free = self.registry.ready(False)
        layout = self._stage(inputs, cache, free[0]).select("key", F.col("lines").alias("layout_lines"))
        if len(free) < 2:
            return layout.withColumn("text_lines", F.col("layout_lines"))
        other = self._stage(inputs, cache, free[1]).where("not failed and size(lines) > 0").select("key", F.col("lines").alias("text_lines"))
        return layout.join(other, "key", "left").withColumn("text_lines", F.coalesce("text_lines", "layout_lines"))


def lines_of(reads: DataFrame) -> DataFrame:
    """key, line_no, text, confidence, box of reads' lines; blank ones are left out."""
    rows = reads.select("key", F.posexplode("lines").alias("line_no", "l")).select("key", "line_no", F.col("l.text").alias("text"), F.col("l.confidence").alias("confidence"), F.col("l.box").alias("box"))
    return rows.where(tx.strip(F.col("text")) != "")
