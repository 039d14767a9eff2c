"""Twelve readability metrics as column expressions over the statistics, with bands, gates and comparison."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.native import rounded
from quillspark.functions.pytext import STAT_FIELDS

UP, DOWN = "higher_is_easier", "lower_is_easier"
#: Bands (fixed values): edges, levels and grades of schooling, easiest first; scales, notes and descriptions of the metrics.
EASE_EDGES = (90, 80, 70, 60, 50, 30)
FLESCH = ("very easy", "easy", "fairly easy", "standard", "fairly difficult", "difficult", "very confusing")
FLESCH_GRADES = ("5th grade", "6th grade", "7th grade", "8th–9th grade", "10th–12th grade", "college", "college graduate")
AMSTAD = ("sehr leicht", "leicht", "mittelleicht", "mittel", "mittelschwer", "schwer", "sehr schwer")
AMSTAD_GRADES = ("4th grade", "5th–6th grade", "7th grade", "8th–9th grade", "10th–12th grade", "Studium", "akademisch")
GRADE_EDGES, GRADE = (6, 9, 12, 16), ("very easy", "easy", "medium", "difficult", "very difficult")
US_GRADES = ("elementary school (up to 6th grade)", "middle school (7th–9th grade)", "high school (10th–12th grade)", "college", "college graduate")
WSTF_EDGES, WSTF = (6, 8, 10, 12), ("sehr leicht", "leicht", "mittel", "schwer", "sehr schwer")
WSTF_GRADES = ("4.–6. Schulstufe", "6.–8. Schulstufe", "8.–10. Schulstufe", "10.–12. Schulstufe", "Studium")
LIX_EDGES, LIX = (25, 35, 45, 55), ("very easy", "easy", "medium", "difficult", "very difficult")
LIX_GRADES = ("children's literature", "fiction, popular press", "normal prose", "technical, non-fiction", "academic")
FLESCH_SCALE, AMSTAD_SCALE, US_SCALE, LIX_SCALE = "0–100, higher is easier", "0–100, höher ist leichter", "US grade level (1–18+), lower is easier", "20–60+, lower is easier"
WSTF_SCALE = "4–15 Schulstufe, niedriger ist leichter; Werte außerhalb 4–15 liegen unter bzw. über der Skala"
SHORT_SAMPLE = "SMOG is calibrated on samples of 30+ sentences; this document has %d, so the score is indicative only."
UNDER_SCALE = "score %s is below the calibrated range 4–15: the text is easier than the Schulstufe scale measures, not a school grade."
OVER_SCALE = "score %s is above the calibrated range 4–15: the text is harder than the Schulstufe scale measures, not a school grade."
DESCRIPTIONS = {
    "flesch": "English reading ease: 206.835 − 1.015×ASL − 84.6×ASW, 0–100, higher is easier.",
    "amstad": "German reading ease (Amstad 1978): 180 − ASL − 58.5×ASW, 0–100, higher is easier.",
    "flesch-kincaid": "US grade level: 0.39×ASL + 11.8×ASW − 15.59, LOWER is easier.",
    "gunning-fog": "US grade level from long words: 0.4×(ASL + 100×polysyllabic/words), LOWER is easier.",
    "smog": "US grade level: 1.0430×sqrt(polysyllabic×30/sentences) + 3.1291; meaningful on 30+ sentences, LOWER is easier.",
    "coleman-liau": "US grade level from characters, no syllables: 0.0588×L − 0.296×S − 15.8, LOWER is easier.",
    "ari": "US grade level: 4.71×(characters/words) + 0.5×(words/sentences) − 21.43, LOWER is easier.",
    "wstf1": "German school grade (Bamberger/Vanecek 1984): 0.1935×MS + 0.1672×SL + 0.1297×IW − 0.0327×ES − 0.875, 4–15, LOWER is easier.",
    "wstf2": "German school grade, without the monosyllable term: 0.2007×MS + 0.1682×SL + 0.1373×IW − 2.779, LOWER is easier.",
    "wstf3": "German school grade from syllables and sentence length: 0.2963×MS + 0.1905×SL − 1.1144, LOWER is easier.",
    "wstf4": "German school grade, shortest variant: 0.2744×MS + 0.2656×SL − 1.693, LOWER is easier.",
    "lix": "Language-agnostic difficulty index: words/sentences + 100×longWords/words, 20–60+, LOWER is easier.",
}


@dataclass(frozen=True)
class Metric:
    name: str
    title: str
    languages: tuple[str, ...]
    direction: str
    score: Callable[[], Column]
    level: Callable[[Column], Column]
    grade: Callable[[Column], Column]
    scale: str
    aliases: tuple[str, ...] = ()
    extra: dict[str, Callable[[], Column]] = field(default_factory=dict)
    note: Callable[[Column], Column] | None = None

    @property
    def description(self) -> str:
        return DESCRIPTIONS.get(self.name, "")


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def asl() -> Column:
    return _d("words") / _d("sentences")


def asw() -> Column:
    return _d("syllables") / _d("words")


def awl() -> Column:
    return _d("characters") / _d("words")


def share(name: str) -> Callable[[], Column]:
    return lambda: 100 * _d(name) / _d("words")


_MS, _IW, _ES = share("polysyllabic_words"), share("long_words"), share("monosyllabic_words")


def _bands(edges: tuple, levels: tuple, test: Callable[[Column, int], Column], clamp: bool = False) -> Callable[[Column], Column]:
    def level(score: Column) -> Column:
        x = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)) if clamp else score
        first, *rest = [(test(x, e), v) for e, v in zip(edges, levels)]
        return reduce(lambda w, tv: w.when(*tv), rest, F.when(*first)).otherwise(levels[-1])

    return level


def _ease(levels: tuple) -> Callable[[Column], Column]:
    return _bands(EASE_EDGES, levels, lambda x, e: x >= e, clamp=True)


def _us(levels: tuple) -> Callable[[Column], Column]:
    return _bands(GRADE_EDGES, levels, lambda x, e: x <= e)


def _lix(levels: tuple) -> Callable[[Column], Column]:
    return _bands(LIX_EDGES, levels, lambda x, e: x < e)


def _wstf(levels: tuple, under: str, over: str) -> Callable[[Column], Column]:
    inside = _bands(WSTF_EDGES, levels, lambda x, e: x <= e)
    return lambda score: F.when(score < 4, under).when(score > 15, over).otherwise(inside(score))


def _plain(score: Column) -> Column:
    """A number of one decimal as it is written: no decimal where it is whole."""
    return F.regexp_replace(score.cast("decimal(18,1)").cast("string"), "\\.0$", "")


_COUNTS = {n: (lambda n=n: _d(n)) for n in STAT_FIELDS}
_EASE_EXTRA = {"asl": asl, "asw": asw} | {n: _COUNTS[n] for n in ("words", "sentences", "syllables")}
METRICS: dict[str, Metric] = {}


def register(m: Metric) -> None:
    taken = {x for k in METRICS.values() for x in (k.name, *k.aliases)}
    if taken & {m.name, *m.aliases}:
        raise ValueError(f"metric {m.name} is registered already")
    METRICS[m.name] = m


_US_LEVEL, _US_GRADE = _us(GRADE), _us(US_GRADES)
for _m in (
    Metric("flesch", "Flesch Reading Ease", ("en",), UP, lambda: 206.835 - 1.015 * asl() - 84.6 * asw(), _ease(FLESCH), _ease(FLESCH_GRADES), FLESCH_SCALE, ("fre", "flesch-reading-ease"), _EASE_EXTRA),
    Metric("amstad", "Amstad (Flesch für Deutsch)", ("de",), UP, lambda: 180 - asl() - 58.5 * asw(), _ease(AMSTAD), _ease(AMSTAD_GRADES), AMSTAD_SCALE, ("flesch-de", "flesch-amstad", "fre-de"), _EASE_EXTRA),
    Metric("flesch-kincaid", "Flesch-Kincaid Grade Level", ("en",), DOWN, lambda: 0.39 * asl() + 11.8 * asw() - 15.59, _US_LEVEL, _US_GRADE, US_SCALE, ("fkgl", "flesch-kincaid-grade"), _EASE_EXTRA),
    Metric("gunning-fog", "Gunning Fog Index", ("en",), DOWN, lambda: 0.4 * (asl() + _MS()), _US_LEVEL, _US_GRADE, US_SCALE, ("fog", "gunning-fog-index"), {"asl": asl, "ms": _MS} | {n: _COUNTS[n] for n in ("polysyllabic_words", "words", "sentences")}),
    Metric("smog", "SMOG Index", ("en",), DOWN, lambda: 1.0430 * F.sqrt(_d("polysyllabic_words") * 30 / _d("sentences")) + 3.1291, _US_LEVEL, _US_GRADE, US_SCALE, ("smog-index",), {n: _COUNTS[n] for n in ("polysyllabic_words", "words", "sentences")},
           lambda s: F.when(F.col("sentences") < 30, F.format_string(SHORT_SAMPLE, F.col("sentences").cast("bigint")))),
    Metric("coleman-liau", "Coleman-Liau Index", ("en",), DOWN, lambda: 0.0588 * (100 * awl()) - 0.296 * (100 * _d("sentences") / _d("words")) - 15.8, _US_LEVEL, _US_GRADE, US_SCALE, ("cli", "coleman-liau-index"),
           {"l": lambda: 100 * awl(), "s": lambda: 100 * _d("sentences") / _d("words")} | {n: _COUNTS[n] for n in ("characters", "words", "sentences")}),
    Metric("ari", "Automated Readability Index", ("en",), DOWN, lambda: 4.71 * awl() + 0.5 * asl() - 21.43, _US_LEVEL, _US_GRADE, US_SCALE, ("automated-readability-index",), {"asl": asl, "chars_per_word": awl} | {n: _COUNTS[n] for n in ("characters", "words", "sentences")}),
    *(Metric(n, f"Wiener Sachtextformel {n[-1]}", ("de",), DOWN, f, _wstf(WSTF, "unter der Skala", "über der Skala"), _wstf(WSTF_GRADES, "unter der 4. Schulstufe", "über der 12. Schulstufe"), WSTF_SCALE, a,
             {"ms": _MS, "sl": asl} | x | {c: _COUNTS[c] for c in ("words", "sentences", "polysyllabic_words")},
             lambda s: F.when(s < 4, F.format_string(UNDER_SCALE, _plain(s))).when(s > 15, F.format_string(OVER_SCALE, _plain(s))))
      for n, f, a, x in (
        ("wstf1", lambda: 0.1935 * _MS() + 0.1672 * asl() + 0.1297 * _IW() - 0.0327 * _ES() - 0.875, ("wstf", "wiener", "wiener-sachtextformel"), {"iw": _IW, "es": _ES} | {c: _COUNTS[c] for c in ("long_words", "monosyllabic_words")}),
        ("wstf2", lambda: 0.2007 * _MS() + 0.1682 * asl() + 0.1373 * _IW() - 2.779, ("wiener-sachtextformel-2",), {"iw": _IW, "long_words": _COUNTS["long_words"]}),
        ("wstf3", lambda: 0.2963 * _MS() + 0.1905 * asl() - 1.1144, ("wiener-sachtextformel-3",), {}),
        ("wstf4", lambda: 0.2744 * _MS() + 0.2656 * asl() - 1.693, ("wiener-sachtextformel-4",), {}))),
    Metric("lix", "LIX (Läsbarhetsindex)", ("en", "de"), DOWN, lambda: asl() + _IW(), _lix(LIX), _lix(LIX_GRADES), LIX_SCALE, ("lasbarhetsindex", "läsbarhetsindex", "lesbarkeitsindex"), {"asl": asl, "iw": _IW} | {n: _COUNTS[n] for n in ("long_words", "words", "sentences")}),
):
    register(_m)


def resolve(names: list[str] | None, language: str | None = None) -> list[Metric]:
    """Metrics of a selection: all valid ones, or a de-duplicated list by name or alias."""
    by = {x: m for m in METRICS.values() for x in (m.name, *m.aliases)}
    if not names or names in (["auto"], ["all"]):
        chosen = [METRICS[n] for n in sorted(METRICS)]
        return [m for m in chosen if language is None or language in m.languages]
    out: dict[str, Metric] = {}
    for n in names:
        m = by.get(n.strip().lower())
        if m is None:
            raise ValueError(f"unknown metric {n}")
        if language and language not in m.languages:
            raise ValueError(f"metric {m.name} doesn't apply to {language}")
        out[m.name] = m
    return [*out.values()]


def scores(stats: DataFrame, names: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per document and metric of its language: metric, title, score, level, grade, scale, direction, extra, note.

    stats needs language and the seven counts; documents without words or sentences have no row. One narrow stage: the
    metrics are an array of structs that is exploded.
    """
    keep = keep if keep is not None else [c for c in stats.columns if c not in STAT_FIELDS and not c.startswith("avg_")]
    parts = []
    for m in resolve(names):
        s = rounded(m.score(), 1)
        extra = F.map_from_arrays(F.array(*map(F.lit, m.extra)), F.array(*(rounded(f(), 2) for f in m.extra.values())))
        one = F.struct(
            F.lit(m.name).alias("metric"), F.lit(m.title).alias("title"), s.alias("score"), m.level(s).alias("level"), m.grade(s).alias("grade"), F.lit(m.scale).alias("scale"), F.lit(m.direction).alias("direction"),
            extra.alias("extra"), (m.note(s) if m.note else F.lit(None)).cast("string").alias("note"),
        )
        parts.append(F.when(F.col("language").isin(*m.languages), one))
    full = stats.where((F.col("words") > 0) & (F.col("sentences") > 0))
    rows = full.select(*keep, F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("_m"))
    return rows.select(*keep, "_m.*")


def metrics_df(spark: SparkSession) -> DataFrame:
    rows = [(m.name, m.title, m.description, list(m.aliases), list(m.languages), m.direction, m.scale) for m in resolve(None)]
    return spark.createDataFrame(rows, "metric string, title string, description string, aliases array<string>, languages array<string>, direction string, scale string")


def _fails(under: dict[str, float] | None, over: dict[str, float] | None) -> Column:
    tests = []
    for given, direction in ((under or {}, UP), (over or {}, DOWN)):
        for name, limit in given.items():
            (m,) = resolve([name])
            if m.direction != direction:
                raise ValueError(f"{name} is {m.direction}; it needs the other gate")
            x = F.col("score")
            tests.append((F.col("metric") == m.name) & ((x < limit) if direction == UP else (x > limit)))
    if not tests:
        raise ValueError("no gate given")
    return reduce(Column.__or__, tests)


def gate(scored: DataFrame, under: dict[str, float] | None = None, over: dict[str, float] | None = None) -> DataFrame:
    """Failing rows of the gates: below on metrics where higher is easier, above where lower is."""
    return scored.where(_fails(under, over))


def gate_verdict(scored: DataFrame, id_col: str, under: dict[str, float] | None = None, over: dict[str, float] | None = None) -> DataFrame:
    """One row: documents, judged, failing, passed. A gate that judged nothing fails."""
    names = [m.name for n in (*(under or {}), *(over or {})) for m in resolve([n])]
    each = scored.groupBy(id_col).agg(F.bool_or(F.col("metric").isin(*names)).alias("judged"), F.bool_or(_fails(under, over)).alias("failing"))  # metric rows of a document meet before the shuffle
    t = each.agg(F.count("*").alias("documents"), F.count_if("judged").alias("judged"), F.count_if("failing").alias("failing"))
    return t.withColumn("passed", (F.col("judged") > 0) & (F.col("failing") == 0))


def run_meta(stats: DataFrame) -> DataFrame:
    """Language where all documents agree, detected for all, truncated for any."""
    truncated = F.bool_or("truncated") if "truncated" in stats.columns else F.lit(False)
    return stats.agg(
        F.when(F.min("language") == F.max("language"), F.min("language")).alias("language"), F.bool_and("detected").alias("detected"),
        truncated.alias("truncated"), F.count("*").alias("documents"),
    )


def diff(before: DataFrame, after: DataFrame, key: str, names: list[str] | None = None) -> DataFrame:
    """Per key and metric: before, after, delta and improved, by the metric's direction.

    Both frames carry statistics; metrics follow the language of after and are applied to both sides.
    """
    b = before.drop("language", "detected").join(after.select(key, "language"), key)
    x = scores(b, names, [key]).select(key, "metric", F.col("score").alias("before"))
    y = scores(after, names, [key]).select(key, "metric", F.col("score").alias("after"), "direction")
    d = rounded(F.col("after") - F.col("before"), 1)
    return y.join(x, [key, "metric"]).select(
        key, "metric", "before", "after", d.alias("delta"), F.when(F.col("direction") == UP, d > 0).otherwise(d < 0).alias("improved"))


def stats_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """after - before of the ten statistics, averages to two decimals."""
    avg = ["avg_sentence_length", "avg_syllables_per_word", "avg_word_length"]
    x = before.select(key, *(F.col(c).alias(f"_{c}") for c in [*STAT_FIELDS, *avg]))
    y = after.join(x, key)
    return y.select(key, *((F.col(c) - F.col(f"_{c}")).alias(c) for c in STAT_FIELDS), *(rounded(F.col(c) - F.col(f"_{c}"), 2).alias(c) for c in avg))
