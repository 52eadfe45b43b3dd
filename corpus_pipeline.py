"""A corpus pipeline: quality filter, near duplicates, personal data, source mixing, tokens.

Every stage takes (spark, docs, sf_dir); what it returns is written as Parquet in the shared folder
and read again as the next one's docs. All but the last return the columns of documents.

Defined results: null and empty texts are scored, compared, searched and encoded as empty texts
(an empty document is linked with nothing); repeated rows of a document count as copies of it, of
which one stays; documents without a doc_id are compared like others; extra columns of the input are
dropped; empty tables give empty results.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packsight.llm import bpe, mixing, ngram_join, pii, quality_crf
from packsight.llm.common import stored
from packsight.llm.queries import quality_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores 0.7 or more."""
    docs = docs.select(*COLUMNS)
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.score(docs, model, into="__score").where("__score >= 0.7").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles with a Jaccard of 0.8 or more link.

    Of a group the smallest doc_id stays, a null last; documents without words all stay.
    """
    docs = docs.select(*COLUMNS)
    linked = ngram_join.link(docs, 5, Fraction(4, 5))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    first = linked.where("group is not null").groupBy("group").agg(F.min(order)["row"].alias("__row")).select("__row")
    alone = linked.where("group is null").select(F.col("row").alias("__row")).distinct()
    kept = docs.withColumn("__row", ngram_join.row_hash(docs)).join(first.union(alone).hint("merge"), "__row")
    again = Window.partitionBy("__row", "doc_id").orderBy("lang", "source", "n_chars")
    return kept.withColumn("__k", F.row_number().over(again)).where("__k = 1").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every selected span of personal data is replaced by its kind; n_chars follows."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them, whole: a use counts where its first word is taken.

    Documents without words take no part in a mix and stay once.
    """
    docs = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")), "mixture_input")
    mixed, listed = mixing.mix(docs, row="__row")
    starts = mixed.where("from_word = 0").groupBy(F.col("row").alias("__row")).agg(F.count("*").alias("__uses"))
    times = listed.select(F.col("row").alias("__row"), "size").join(starts, "__row", "left").select("__row", F.when(F.col("size") == 0, 1).otherwise(F.coalesce("__uses", F.lit(0))).cast("int").alias("__uses"))
    used = docs.join(times.where("__uses > 0").hint("merge"), "__row")
    return used.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("__uses"))).alias("__use")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids of every document."""
    import public_tokenizers

    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: The classifier and the tokenizer can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
