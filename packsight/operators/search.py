"""Search of many passages in many texts: the passages are the stated query set, taken in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shipping import ship

BLOCK = 5_000  # passages that are searched together, about


def passages_found(docs: DataFrame, passages: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id of every passage (item_id, text) that a document (doc_id, text) holds.

    A passage is held where three quarters of its normalised words occur in the normalised text, be
    it within longer words; one without words is held by none. All words of a block of passages are
    found in one pass over a text, so the work follows the texts and not the pairs.
    """
    ship(docs.sparkSession)
    words = F.filter(F.split(tx.norm(F.col("text")), " "), lambda x: x != "")
    asked = passages.select("item_id", words.alias("words")).where(F.size("words") > 0)
    blocks = max(1, -(-asked.count() // block))
    texts = docs.select("doc_id", tx.norm(F.col("text")).alias("text")).where("text is not null")
    schema = docs.select("doc_id").schema.add("item_id", passages.schema["item_id"].dataType)

    def searched(items: list, all_words: list[list[str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick
            import numpy as np

            holders: dict[str, list[int]] = {}
            for k, found in enumerate(all_words):
                for word in found:
                    holders.setdefault(word, []).append(k)
            machine = ahocorasick.Automaton()
            for word, held in holders.items():
                machine.add_word(word, (word, np.array(held)))
            machine.make_automaton()
            need = np.array([len(found) for found in all_words]) * 3
            for batch in batches:
                rows, hits = [], []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    met = dict(value for _, value in machine.iter(text)) if holders else {}
                    if met:
                        counts = np.bincount(np.concatenate(list(met.values())), minlength=len(need))
                        at = np.flatnonzero(4 * counts >= need)
                        rows += [k] * len(at)
                        hits += at.tolist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([items[h] for h in hits], out_type)], names=["doc_id", "item_id"])

        return texts.mapInArrow(run, schema)

    out_type = pa.int64() if passages.schema["item_id"].dataType.typeName() == "long" else pa.int32() if passages.schema["item_id"].dataType.typeName() == "integer" else pa.string()
    parts = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        parts.append(searched([r.item_id for r in own], [r.words for r in own]))
    return reduce(DataFrame.unionByName, parts)


def closest_passage(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id, f1 of the passage whose set of normalised words is nearest to each document's.

    Only words that both have are joined; of equal passages the smallest id wins, and documents that
    share no word with any passage give no row.
    """

    def sets(rows: DataFrame, key: str) -> DataFrame:
        distinct = F.array_distinct(F.filter(F.split(tx.norm(F.col("text")), " "), lambda w: w != ""))
        return rows.select(key, distinct.alias("words")).select(key, F.size("words").alias(f"{key}_n"), F.explode("words").alias("word"))

    both = sets(docs, "doc_id").join(sets(passages, "item_id"), "word").groupBy("doc_id", "doc_id_n", "item_id", "item_id_n").agg(F.count("*").alias("common"))
    scored = both.select("doc_id", "item_id", (2.0 * F.col("common") / (F.col("doc_id_n") + F.col("item_id_n"))).alias("f1"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("f1"), "item_id")
    return scored.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")
