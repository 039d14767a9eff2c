"""Documents to counts: language, sentences, tokens and the ten statistics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from quillspark.functions import pytext, strip
from quillspark.operators.rows import flat_map

LANGUAGES = ("auto", "en", "de")
_FIELDS = [StructField("language", StringType()), StructField("detected", BooleanType()), *(StructField(f, LongType()) for f in pytext.STAT_FIELDS)]


def _check(lang: str) -> None:
    if lang not in LANGUAGES:
        raise ValueError(f"unsupported language {lang}")


def analyze(df: DataFrame, text_col: str = "text", lang: str = "auto", mode: str = "none", cap: int | None = None) -> DataFrame:
    """The input with language, detected and the statistics: seven counts and three averages.

    Null and blank texts count zero of everything, and their averages are 0. Columns of the same names are replaced. One
    Arrow stage; the other columns stay in the JVM.
    """
    _check(lang)

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            t = t if isinstance(t, str) else ""
            if cap is not None and len(raw := t.encode("utf-8", "surrogatepass")) > cap:
                t = raw[:cap].decode("utf-8", "ignore")
            t = strip.apply(t, mode) if mode != "none" else t
            k = pytext.detect(t) if lang == "auto" else lang
            rows.append((k, lang == "auto", *pytext.counts(t, k)))
        return pd.DataFrame(rows, columns=[f.name for f in _FIELDS])

    # marked so that no rule copies the call into filters and projections above it
    udf = F.pandas_udf(run, StructType(_FIELDS)).asNondeterministic()
    own = [f.name for f in _FIELDS] + ["avg_sentence_length", "avg_syllables_per_word", "avg_word_length"]
    kept = [c for c in df.columns if c.lower() not in own]
    s = df.withColumn("_stats", udf(F.col(text_col))).select(*kept, "_stats.*")
    return with_averages(s)


def with_averages(df: DataFrame) -> DataFrame:
    def ratio(a: str, b: str):  # noqa: ANN202
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return df.withColumns({
        "avg_sentence_length": ratio("words", "sentences"), "avg_syllables_per_word": ratio("syllables", "words"), "avg_word_length": ratio("characters", "words"),
    })


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a sentence that has a word: sent (from 1), sent_text, start, end (bytes), words."""

    def make() -> Callable[..., list[tuple]]:
        def rows(key, text):  # noqa: ANN001, ANN202
            text = text or ""
            found = [(a, b, n) for a, b in pytext.sentence_spans(text) if (n := len(pytext._TOKEN.findall(text, a, b)))]
            at = pytext.byte_offsets(text, [x for a, b, _ in found for x in (a, b)])
            return [(key, i + 1, text[a:b], at[2 * i], at[2 * i + 1], n) for i, (a, b, n) in enumerate(found)]

        return rows

    kind = df.schema[id_col].dataType.simpleString()
    return flat_map(df, [id_col, text_col], make, f"`{id_col}` {kind}, sent int, sent_text string, `start` bigint, `end` bigint, words int")


def tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "auto") -> DataFrame:
    """The token table: sent, idx (from 1 in the document), word, lower, runes, syllables, start, end (bytes)."""
    _check(lang)

    def make() -> Callable[..., list[tuple]]:
        def rows(key, text):  # noqa: ANN001, ANN202
            text = text or ""
            k = pytext.detect(text) if lang == "auto" else lang
            found, n = [], 0
            for a, b in pytext.sentence_spans(text):
                hits = [*pytext._TOKEN.finditer(text, a, b)]
                n += bool(hits)
                found += [(n, m) for m in hits]
            at = pytext.byte_offsets(text, [x for _, m in found for x in m.span()])
            return [(key, s, i + 1, w := m.group(), w.lower(), len(w), pytext.syllables(w, k), at[2 * i], at[2 * i + 1]) for i, (s, m) in enumerate(found)]

        return rows

    kind = df.schema[id_col].dataType.simpleString()
    return flat_map(df, [id_col, text_col], make, f"`{id_col}` {kind}, sent int, idx int, word string, lower string, runes int, syllables int, `start` bigint, `end` bigint")
