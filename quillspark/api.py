"""Facade: one function a command."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import strip as strip_
from quillspark.operators import analyze as analyze_
from quillspark.operators import entities as entities_
from quillspark.operators import lint as lint_
from quillspark.operators import readability as readability_
from quillspark.sources import containers, inputs, remote, workspace
from quillspark.sources.errors import TextError


def readability(df: DataFrame, id_col: str = "id", text_col: str = "text", metrics: list[str] | None = None, lang: str = "auto", stats: bool = False, strip: str = "auto") -> DataFrame:
    """Metric rows of documents, with the statistics beside them if asked."""
    readability_.resolve(metrics, None if lang == "auto" else lang)
    s = analyze_.analyze(df.select(id_col, text_col), text_col, lang, strip)
    kept = [c for c in s.columns if c != text_col] if stats else [id_col, "language", "detected"]
    return readability_.scores(s, metrics, kept)


def lint(df: DataFrame, id_col: str = "id", text_col: str = "text", rules: list[str] | None = None, severity: str = "info", lang: str = "auto", config: lint_.Config | None = None, strip: str = "auto") -> DataFrame:
    """Findings of documents. Offsets are into the stripped text."""
    if severity not in lint_.SEVERITIES:
        raise TextError("invalid_args", f"unknown severity {severity}")
    text = df.withColumn(text_col, strip_.strip_column(F.col(text_col), strip)) if strip != "none" else df
    return lint_.lint(text, id_col, text_col, lang, rules, severity, config)


def diff(before: DataFrame, after: DataFrame, on: str = "id", text_col: str = "text", metrics: list[str] | None = None, strip: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(metric deltas, statistics deltas) of paired documents."""
    b, a = (analyze_.analyze(x.select(on, text_col), text_col, "auto", strip) for x in (before, after))
    return readability_.diff(b, a, on, metrics), readability_.stats_delta(b, a, on)


def metrics(spark: SparkSession) -> DataFrame:
    return readability_.metrics_df(spark)


def rules(spark: SparkSession) -> DataFrame:
    return lint_.rules_df(spark)


def entities(df: DataFrame, provider: remote.EntityProvider, types: list[str] | None = None, least: float = 0.0, by: str = "salience", top: int = 0, id_col: str = "id", text_col: str = "text") -> DataFrame:
    answers = remote.ask_provider(df, provider, "entities", id_col, text_col).where(F.col("error").isNull())
    rows = entities_.parse_response(answers.select(F.col(id_col).alias("doc"), "response"))
    return entities_.pipeline(rows, types, least, by, top)


def aggregate_entities(df: DataFrame, by: str = "salience", top: int = 0) -> DataFrame:
    return entities_.top(entities_.aggregate(df), top, by, within=None)


def enrich(df: DataFrame, articles: DataFrame) -> DataFrame:
    return entities_.enrich(df, articles)


def sentiment(df: DataFrame, provider: remote.EntityProvider | None = None, id_col: str = "id", text_col: str = "text", lang: str | None = None) -> DataFrame:
    """Score, magnitude and label of documents by a provider; without one, labels of rows that have score and magnitude."""
    if provider is None:
        return entities_.label_sentiment(df)
    return entities_.parse_sentiment(remote.ask_provider(df, provider, "sentiment", id_col, text_col, lang))


def classify(df: DataFrame, least: float = 0.0, top: int = 0, provider: remote.EntityProvider | None = None, id_col: str = "id", text_col: str = "text", lang: str | None = None) -> DataFrame:
    """Ranked categories of documents with words enough, by a provider; without one, of rows that have doc, name and confidence."""
    if provider is not None:
        answers = remote.ask_provider(entities_.classifiable(df, text_col), provider, "categories", id_col, text_col, lang)
        df = entities_.parse_categories(answers.where(F.col("error").isNull()).select(F.col(id_col).alias("doc"), "response"))
    return entities_.categories(df, least, top)


def extract(spark: SparkSession, path: str, want: str = "auto") -> DataFrame:
    return containers.read_files(spark, path, want)


def fetch(urls: DataFrame, fetchers: list[remote.Fetcher]) -> DataFrame:
    return remote.fetch_pages(urls, fetchers)


def kb_lookup(requests: DataFrame, source: remote.Encyclopedia) -> DataFrame:
    return remote.lookup_articles(requests, source)


def kb_search(queries: DataFrame, source: remote.Encyclopedia, limit: int = 10) -> DataFrame:
    return remote.search_articles(queries, source, limit)


def papers(queries: DataFrame, source: remote.Literature, limit: int = 10, **filters: object) -> DataFrame:
    return remote.search_papers(queries, source, limit, **filters)


def related(papers_: DataFrame, source: remote.Literature, relation: str = "similar", limit: int = 10) -> DataFrame:
    return remote.related_papers(papers_, source, relation, limit)


def inspect(papers_: DataFrame, source: remote.Literature) -> DataFrame:
    return remote.inspect_papers(papers_, source)


def tools(queries: DataFrame, source: remote.DataTools, limit: int = 10) -> DataFrame:
    return remote.find_tools(queries, source, limit)


def run_tool(calls: DataFrame, source: remote.DataTools, tool: str) -> DataFrame:
    return remote.run_tool(calls, source, tool)


def read_workspace(df: DataFrame, tab: str | None = None, markdown: bool = True) -> DataFrame:
    return workspace.read_documents(df, tab=tab, markdown=markdown)


def load(spark: SparkSession, **options) -> DataFrame:
    return inputs.load(spark, **options)
