"""The operators over their whole tables, with the columns that their contracts name."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, license_scan, line_rules, mixing, ngram_join, nn_descent, pii, quality_crf, url_filter
from .sql import ORACLE_SQL

URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans, of every document."""
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    listed = found.select("doc_id", base.alias("base"), _joined(F.col("pii")).alias("spans"))
    of = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    return listed.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), "spans")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for each hundredth vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    nodes, graph = nn_descent.index(vectors)
    return nn_descent.search(nodes, graph, nn_descent.own_queries(vectors))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licence of every document.

    Documents have no paths of their own: a source is a repository, a thousand ids a directory in
    it, ten ids a directory in that, whose first document is its LICENSE file.
    """
    docs = _table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.expr("doc_id div 1000"), F.expr("doc_id div 10"), name)
    return license_scan.scan(docs.select("doc_id", path.alias("path"), "text"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed, documents = mixing.mix(_table(spark, sf_dir, "documents"))
    taken = mixed.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return documents.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every document."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    both = bpe.decode(ids, vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: three-word shingles, Jaccard 0.9 or more."""
    return ngram_join.link(_table(spark, sf_dir, "documents"), 3, Fraction(9, 10))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and verdict of every document."""
    counts = line_rules.clean_lines(_table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_crf.LineCrf:
    """The quality model, learnt from the labelled rows that aren't held out."""
    known = labels.where(~quality_crf.held_out()).select("doc_id", F.col("quality").alias("label"))
    return quality_crf.fit(docs, known)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_crf.score(docs, quality_model(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_crf.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict:
    return {"op1_pii": op1_pii, "op2_neighbours": op2_neighbours, "op3_licences": op3_licences, "op4_mix": op4_mix, "op5_bpe": op5_bpe, "op6_html": op6_html, "op7_ngrams": op7_ngrams, "op8_urls": op8_urls, "op9_rules": op9_rules, "op10_quality": op10_quality}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL
