"""Queries of the training-data operators, by the number of their problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import language, leaks, markup, mixing, pagebody, reading, residue, sentences, spam
from quillspark.operators.rows import spread
from quillspark.sources import tables


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table in at least as many partitions as there are cores: its rows go through Python."""
    return spread(tables.table(spark, folder, name))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading.find_hard(table(spark, folder, "papers")).distinct()


def p1_levels(spark: SparkSession, folder: str) -> DataFrame:
    papers, documents = table(spark, folder, "papers"), table(spark, folder, "documents")
    profiles = language.fit(documents)
    a = reading.levels(papers, reading.fit_papers(papers), None, "paper_id", "abstract").distinct()
    b = reading.levels(documents, reading.fit_documents(documents, profiles), profiles, "doc_id", "text")
    return a.withColumnRenamed("paper_id", "id").unionByName(b.withColumn("id", F.col("doc_id").cast("string")).drop("doc_id"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pagebody.furniture_lines(table(spark, folder, "scrape_responses"))


def p2_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return pagebody.main_bodies(_last_rows(table(spark, folder, "scrape_responses"), "response_id", "ingested_at"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "scrape_responses")).select("response_id")


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "scrape_responses").select("response_id", "host", "page_url").dropDuplicates(["response_id"])
    return pages.join(p3_found(spark, folder), "response_id", "left_anti")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.split_sentences(table(spark, folder, "split_texts")).select("text_id", "start_byte", "end_byte")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_drawn(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.draw(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.draw(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.find_spam(table(spark, folder, "documents")).select("doc_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    pages = spam.find_spam(documents).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_page"))  # spam is joined by its hash, so texts aren't judged twice
    found = language.detect_languages(documents.withColumn("_text", F.xxhash64("text")), language.fit(documents), keep=["lang", "_text"])
    return language.mislabelled(found.join(pages, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_page")), "left_anti"))


def _latest(df: DataFrame, key: str, time: str) -> DataFrame:
    """One row a key: redelivered rows count once, the last delivery stands."""
    return df.groupBy(key).agg(F.max_by(F.struct("*"), time).alias("_r")).select("_r.*")


def _last_rows(df: DataFrame, key: str, time: str) -> DataFrame:
    """As _latest, for wide rows: only keys that were delivered more than once are shuffled."""
    again = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return df.join(again, key, "left_anti").unionByName(_latest(df.join(again, key, "left_semi"), key, time))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    articles = table(spark, folder, "articles")
    return markup.markup_families(articles, markup.fit(articles, "extract_text", "article_no"), "article_no", "extract_text", "retrieved_at")


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    articles = _last_rows(table(spark, folder, "articles"), "article_no", "retrieved_at")
    pages = _last_rows(table(spark, folder, "scrape_responses"), "response_id", "ingested_at")
    a = markup.clean_texts(articles, "article_no", "extract_text", markup.fit(table(spark, folder, "articles"), "extract_text", "article_no")).select(F.lit("article").alias("kind"), F.col("article_no").alias("id"), "clean_text", "blocks")
    return a.unionAll(markup.clean_texts(pages, "response_id", "markdown", markup.fit(table(spark, folder, "scrape_responses"), "markdown", "response_id")).select(F.lit("page").alias("kind"), F.col("response_id").alias("id"), "clean_text", "blocks"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_levels": p1_levels,
    "p2_found": p2_found,
    "p2_bodies": p2_bodies,
    "p3_found": p3_found,
    "p3_clean": p3_clean,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_clean": p6_clean,
    "p7_found": p7_found,
    "p8_drawn": p8_drawn,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
}
ORACLES: dict[str, str] = {}
