"""Python data sources: pages and articles through spark.read, with the transport named by its import path.

    datasource.register(spark)
    spark.read.format("quill_pages").option("transport", "my.module:call").option("base_url", "https://...").option("urls", "a.org\\nb.org").load()
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.sources import remote
from quillspark.sources.errors import TextError


def imported(path: str) -> remote.Transport:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


class _Slice(InputPartition):
    def __init__(self, items: list[str]):
        self.items = items


class _Reader(DataSourceReader):
    """A partition holds at most `batch` keys, each asked for once."""

    def __init__(self, options: dict, key: str):
        self.options, self.key = dict(options), key
        self.keys = list(dict.fromkeys(x.strip() for x in options.get(key, "").split("\n") if x.strip()))

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("batch", "50"))
        return [_Slice(self.keys[i:i + n]) for i in range(0, len(self.keys), n)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for k in partition.items:
            try:
                yield (k, *self.ask(k), None)
            except TextError as e:
                yield (k, *[None] * self.width, f"{e.code}: {e.message}")


class _PageReader(_Reader):
    width = 7

    def ask(self, url: str) -> tuple:
        return remote.Fetcher(imported(self.options["transport"]), self.options["base_url"]).fetch(url)


class _ArticleReader(_Reader):
    width = 8

    def ask(self, title: str) -> tuple:
        return remote.Encyclopedia(imported(self.options["transport"]), self.options["base_url"]).lookup(title, self.options.get("lang", "en"))


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill_pages"

    def schema(self) -> str:
        return f"requested_url string, {remote.PAGE}, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _PageReader(self.options, "urls")


class Articles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill_articles"

    def schema(self) -> str:
        return "requested string, title string, description string, extract string, url string, lang string, aliases array<string>, disambiguation boolean, thumbnail string, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _ArticleReader(self.options, "titles")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)
    spark.dataSource.register(Articles)
