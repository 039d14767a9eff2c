"""The text operators as SQL functions: scalar ones, and table functions for LATERAL joins.

    SELECT d.id, s.* FROM docs d, LATERAL quill_sentences(d.text) s
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark.functions import pytext, strip
from quillspark.operators import lint


class Sentences:
    """sent, sent_text, start, end (bytes), words."""

    def eval(self, text: str) -> Iterator[tuple]:
        text = text or ""
        found = [(a, b, n) for a, b in pytext.sentence_spans(text) if (n := len(pytext.words(text[a:b])))]
        at = pytext.byte_offsets(text, [x for a, b, _ in found for x in (a, b)])
        for i, (a, b, n) in enumerate(found):
            yield i + 1, text[a:b], at[2 * i], at[2 * i + 1], n


class Tokens:
    """idx, word, syllables."""

    def eval(self, text: str, lang: str) -> Iterator[tuple]:
        k = pytext.detect(text) if lang == "auto" else lang
        for i, w in enumerate(pytext.words(text)):
            yield i + 1, w, pytext.syllables(w, k)


class Findings:
    """The columns of lint.FINDING."""

    def eval(self, text: str, lang: str) -> Iterator[tuple]:
        yield from lint.findings(text, lang)


def register(spark: SparkSession, prefix: str = "quill_") -> list[str]:
    """Registers the functions under a prefix; returns their names."""
    tables = {
        "sentences": F.udtf(Sentences, returnType="sent int, sent_text string, `start` bigint, `end` bigint, words int"),
        "tokens": F.udtf(Tokens, returnType="idx int, word string, syllables int"),
        "lint": F.udtf(Findings, returnType=lint.FINDING),
    }
    scalars = {
        "detect": F.pandas_udf(lambda s: s.map(pytext.detect), "string"),
        "strip": F.pandas_udf(lambda s: s.map(strip.apply), "string"),
        "sniff": F.pandas_udf(lambda s: s.map(strip.sniff), "string"),
        "ease": F.pandas_udf(_ease, "double"),
    }
    for n, f in tables.items():
        spark.udtf.register(prefix + n, f)
    for n, f in scalars.items():
        spark.udf.register(prefix + n, f)
    return sorted(prefix + n for n in (*tables, *scalars))


def _ease(texts: pd.Series, langs: pd.Series) -> pd.Series:
    def one(t: str | None, k: str) -> float | None:
        k = pytext.detect(t) if k == "auto" else k
        return pytext.reading_ease(*pytext.counts(t, k)[:3], k)

    return pd.Series([one(t, k) for t, k in zip(texts, langs)], dtype="float64")
