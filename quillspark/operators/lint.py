"""Style findings: 13 rules, some with a variant a language, as one row a finding.

A document's rules share one view of its tokens, so a document is one Arrow row and the whole operator one narrow
stage. Null and wordless texts have no finding; texts of any length are read whole.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import pytext
from quillspark.functions import wordlists as W
from quillspark.operators.rows import flat_map

SEVERITIES = ("info", "warn")


@dataclass(frozen=True)
class Config:
    """Thresholds; zero or less means the default."""

    max_sentence_words: int = 25
    warn_sentence_words: int = 35
    max_word_chars: int = 20
    worst: int = 5
    hard_ease: float = 50
    hard_warn_ease: float = 30
    min_hard_words: int = 6
    repeat_window: int = 40
    min_repeat_chars: int = 5
    start_run: int = 3
    min_variance_sentences: int = 5
    min_cv: float = 0.25
    max_cv: float = 0.90
    min_density_words: int = 40
    min_density_hits: int = 3
    max_density_shown: int = 5
    nominalization_density: float = 0.06
    modal_density: float = 0.025
    adverb_density: float = 0.05
    passive_lookahead: int = 12

    def filled(self) -> Config:
        d = Config()
        own = {k: v if v > 0 else getattr(d, k) for k, v in self.__dict__.items()}
        own["warn_sentence_words"] = max(own["warn_sentence_words"], own["max_sentence_words"])
        return replace(self, **own)


class View:
    """Tokens of a document by position: text, lower case, syllables, character span, sentence number."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang
        self.word: list[str] = []
        self.low: list[str] = []
        self.syll: list[int] = []
        self.at: list[tuple[int, int]] = []
        self.of: list[int] = []
        self.sentences: list[tuple[int, int, int, int]] = []  # first token, one past the last, character span
        for a, b in pytext.sentence_spans(text):
            first = len(self.word)
            for m in pytext._TOKEN.finditer(text, a, b):
                self.word.append(m.group())
                self.at.append(m.span())
                self.of.append(len(self.sentences) + 1)
            if len(self.word) > first:
                self.sentences.append((first, len(self.word), a, b))
        self.low = [w.lower() for w in self.word]
        self.syll = [pytext.syllables(w, lang) for w in self.word]

    def broken(self, i: int) -> bool:
        """Whether a clause ends between token i and the next."""
        return any(c in ",;:–—()" for c in self.text[self.at[i][1]:self.at[i + 1][0]])


def _round(x: float, places: int) -> float:
    p = 10.0**places
    return math.copysign(math.floor(abs(x) * p + 0.5), x) / p


def _num(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


def _quote(s: str) -> str:
    return json.dumps(s, ensure_ascii=False)


#: (rule, language or any, title, description, severity, check)
RULES: list[tuple[str, str, str, str, str, Callable]] = []


def rule(name: str, lang: str, title: str, description: str, severity: str) -> Callable:
    """Register a check: a generator of (first token or None, last token, severity, value, message key, fields)."""

    def add(check: Callable) -> Callable:
        if any(n == name and (x == lang or "any" in (x, lang)) for n, x, *_ in RULES):
            raise ValueError(f"rule {name} is registered for {lang} already")
        RULES.append((name, lang, title, description, severity, check))
        return check

    return add


@rule("long-sentence", "any", "Long sentence", "Sentences over the word limit.", "info")
def _long_sentence(v: View, c: Config) -> Iterator[tuple]:
    for first, end, a, b in v.sentences:
        if (n := end - first) > c.max_sentence_words:
            yield (a, b), v.of[first], "warn" if n > c.warn_sentence_words else "info", float(n), "long-sentence", {"n": n, "limit": c.max_sentence_words}


@rule("hard-sentence", "any", "Hard sentence", "The worst sentences by their own reading ease.", "info")
def _hard_sentence(v: View, c: Config) -> Iterator[tuple]:
    if v.lang not in ("en", "de"):
        return
    found = []
    for first, end, a, b in v.sentences:
        n = end - first
        if n >= c.min_hard_words:
            x = float(n)
            asw = sum(v.syll[first:end]) / x
            score = 180 - x - 58.5 * asw if v.lang == "de" else 206.835 - 1.015 * x - 84.6 * asw
            if score < c.hard_ease:
                found.append((score, a, b, first, n))
    for score, a, b, first, n in sorted(found)[:c.worst]:
        shown = _round(score, 1)
        yield (a, b), v.of[first], "warn" if score < c.hard_warn_ease else "info", shown, "hard-sentence", {"score": _num(shown), "n": n}


@rule("sentence-length-variance", "any", "Sentence rhythm", "Sentence lengths that hardly vary, or vary wildly.", "info")
def _variance(v: View, c: Config) -> Iterator[tuple]:
    n = len(v.sentences)
    if n < c.min_variance_sentences:
        return
    sizes = [end - first for first, end, *_ in v.sentences]
    mean = sum(sizes) / n
    cv = math.sqrt(sum((x - mean) ** 2 for x in sizes) / n) / mean
    if c.min_cv <= cv <= c.max_cv:
        return
    yield (0, 0), 0, "info", _round(cv, 2), "monotone" if cv < c.min_cv else "erratic", {"n": n, "mean": _num(_round(mean, 1)), "cv": _num(_round(cv, 2))}


def _lettered(w: str) -> bool:
    return any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w)


@rule("repeated-word", "any", "Repeated word", "The same word again within a short window.", "info")
def _repeated(v: View, c: Config) -> Iterator[tuple]:
    skip = {"de": W.FUNCTION_DE, "en": W.FUNCTION_EN}.get(v.lang, frozenset())
    last: dict[str, int] = {}
    for i, low in enumerate(v.low):
        if len(v.word[i]) < c.min_repeat_chars or low in skip or not _lettered(v.word[i]):
            continue
        gap = i - last.get(low, -(10**9))
        if gap <= c.repeat_window:
            yield v.at[i], v.of[i], "info", float(gap), "repeated-word", {"word": v.word[i], "gap": gap}
        last[low] = i


@rule("repeated-sentence-start", "any", "Repeated opening", "Consecutive sentences that open alike.", "info")
def _starts(v: View, c: Config) -> Iterator[tuple]:
    heads = [first for first, *_ in v.sentences]
    i = 0
    while i < len(heads):
        j = i
        while j < len(heads) and v.low[heads[j]] == v.low[heads[i]]:
            j += 1
        if j - i >= c.start_run:
            t = heads[i]
            yield v.at[t], v.of[t], "info", float(j - i), "repeated-sentence-start", {"run": j - i, "word": v.word[t]}
        i = j


@rule("long-word", "any", "Long word", "Words over the character limit.", "info")
def _long_word(v: View, c: Config) -> Iterator[tuple]:
    for i, w in enumerate(v.word):
        if len(w) > c.max_word_chars and _lettered(w):
            yield v.at[i], v.of[i], "info", float(len(w)), "long-word", {"word": w, "n": len(w)}


def participle_de(word: str, low: str) -> bool:
    if word[0].isupper() or not low.endswith(("t", "en")) or low in W.PARTICIPLE_EXCEPT_DE or low.endswith(W.PARTICIPLE_I_DE):
        return False
    n = len(word)
    return (
        low.startswith("ge") and n >= 5
        or any(low.startswith(p) and n >= len(p) + 4 for p in W.PREFIX_PARTICIPLE_DE)
        or any(low.startswith(p + "ge") and n >= len(p) + 5 for p in W.SEPARABLE_DE)
    )


def participle_en(word: str, low: str) -> bool:
    return low in W.IRREGULAR_EN or low.endswith("ed") and len(word) >= 5


@rule("passive", "de", "Passiv", "Werden-Form mit Partizip II.", "warn")
def _passive_de(v: View, c: Config) -> Iterator[tuple]:
    used: set[int] = set()
    for first, end, *_ in v.sentences:
        for i in range(first, end):
            if v.low[i] not in W.AUXILIARY_DE:
                continue
            stop = i
            while stop < min(i + c.passive_lookahead, end - 1) and not v.broken(stop):
                stop += 1
            free = (j for j in range(stop, i, -1) if j not in used and participle_de(v.word[j], v.low[j]))
            j = next(free, None)
            if j is None and i > first and i - 1 not in used and participle_de(v.word[i - 1], v.low[i - 1]) and not v.broken(i - 1):
                j = i - 1
            if j is None:
                continue
            used.add(j)
            a, b = sorted((i, j))
            pair = f"{v.word[i]} … {v.word[j]}" if j > i else f"{v.word[j]} {v.word[i]}"
            yield (v.at[a][0], v.at[b][1]), v.of[i], "warn", 0.0, "passive", {"pair": pair}


@rule("passive", "en", "Passive voice", "A form of be with a past participle.", "warn")
def _passive_en(v: View, c: Config) -> Iterator[tuple]:
    for first, end, *_ in v.sentences:
        for i in range(first, end):
            if v.low[i] not in W.BE_EN:
                continue
            for j in range(i + 1, min(i + 5, end)):
                if v.broken(j - 1):
                    break
                if participle_en(v.word[j], v.low[j]):
                    yield (v.at[i][0], v.at[j][1]), v.of[i], "warn", 0.0, "passive", {"word": v.word[i], "other": _quote(v.word[j])}
                    break


def _phrases(v: View, table: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """(first, last token, suggestion) of the longest phrases, not overlapping, inside sentences."""
    by: dict[str, list[tuple[list[str], str]]] = {}
    for p, tip in table.items():
        w = p.lower().split()
        by.setdefault(w[0], []).append((w, tip))
    for first, end, *_ in v.sentences:
        i = first
        while i < end:
            fits = [(len(w), tip) for w, tip in by.get(v.low[i], ()) if v.low[i:min(i + len(w), end)] == w]
            if fits:
                n, tip = max(fits)
                yield i, i + n - 1, tip
                i += n
            else:
                i += 1


def _phrase_rule(name: str, lang: str, title: str, description: str, severity: str, table: dict[str, str], plain: str) -> None:
    @rule(name, lang, title, description, severity)
    def check(v: View, c: Config) -> Iterator[tuple]:
        for a, b, tip in _phrases(v, table):
            span = v.text[v.at[a][0]:v.at[b][1]]
            yield (v.at[a][0], v.at[b][1]), v.of[a], severity, 0.0, name, {"span": span, "word": span, "tip": tip or plain}


_phrase_rule("filler", "de", "Füllwort", "Wörter, die nichts zur Aussage beitragen.", "info", W.FILLER_DE, "streichen")
_phrase_rule("filler", "en", "Filler", "Words that add nothing.", "info", W.FILLER_EN, "delete")
_phrase_rule("hedge", "en", "Hedge", "Words that weaken a claim.", "info", W.HEDGE_EN, "a direct statement")
_phrase_rule("bureaucratic", "de", "Behördendeutsch", "Amtssprache mit einfacherer Entsprechung.", "warn", W.BUREAUCRATIC_DE, "umformulieren")


def _dense(v: View, c: Config, hits: list[tuple[int, int]], least: float, name: str, severity: str) -> Iterator[tuple]:
    words = len(v.word)
    if len(hits) < c.min_density_hits or words < c.min_density_words or len(hits) / words < least:
        return
    d = len(hits) / words
    for a, b in hits[:c.max_density_shown]:
        fields = {"hits": len(hits), "words": words, "pct": _num(_round(d * 100, 1)), "word": v.word[a]}
        yield (v.at[a][0], v.at[b][1]), v.of[a], severity, _round(d, 4), name, fields


@rule("nominalization", "de", "Substantivstil", "Häufung von Nominalisierungen.", "warn")
def _nominal_de(v: View, c: Config) -> Iterator[tuple]:
    hits = []
    for i, (w, low) in enumerate(zip(v.word, v.low)):
        if w[0].isupper() and (low in W.NOMINAL_WORDS_DE or len(w) >= 6 and low not in W.NOMINAL_EXCEPT_DE and low.endswith(W.NOMINAL_SUFFIX_DE)):
            follows = i + 1 < len(v.word) and v.of[i + 1] == v.of[i] and v.low[i + 1] == "von"
            hits.append((i, i + follows))
    yield from _dense(v, c, hits, c.nominalization_density, "nominalization", "warn")


@rule("nominalization", "en", "Nominalization", "Density of nouns that hide a verb.", "warn")
def _nominal_en(v: View, c: Config) -> Iterator[tuple]:
    hits = [(i, i) for i, (w, low) in enumerate(zip(v.word, v.low)) if len(w) >= 7 and low not in W.NOMINAL_EXCEPT_EN and low.endswith(W.NOMINAL_SUFFIX_EN)]
    yield from _dense(v, c, hits, c.nominalization_density, "nominalization", "warn")


@rule("modal-hedge", "de", "Konjunktiv", "Häufung unverbindlicher Formen.", "info")
def _modal_de(v: View, c: Config) -> Iterator[tuple]:
    forms = frozenset(W.MODAL_DE)
    yield from _dense(v, c, [(i, i) for i, low in enumerate(v.low) if low in forms], c.modal_density, "modal-hedge", "info")


@rule("adverb", "en", "Adverbs", "Density of -ly adverbs.", "info")
def _adverb_en(v: View, c: Config) -> Iterator[tuple]:
    hits = [(i, i) for i, (w, low) in enumerate(zip(v.word, v.low)) if len(w) >= 5 and low.endswith("ly") and low not in W.ADVERB_EXCEPT_EN]
    yield from _dense(v, c, hits, c.adverb_density, "adverb", "info")


def select_rules(names: list[str] | None, lang: str) -> list[tuple]:
    """Rules valid for the language; a list is de-duplicated; unknown names and names of other languages are errors."""
    valid = {n: r for r in RULES for n in (r[0],) if r[1] in ("any", lang)}
    if not names or names in (["auto"], ["all"]):
        return [valid[n] for n in sorted(valid)]
    out = []
    for n in dict.fromkeys(x.strip().lower() for x in names):
        if n not in {r[0] for r in RULES}:
            raise ValueError(f"unknown rule {n}")
        if n not in valid:
            raise ValueError(f"rule {n} doesn't apply to {lang}")
        out.append(valid[n])
    return out


def findings(text: str | None, lang: str = "auto", names: list[str] | None = None, config: Config | None = None) -> list[tuple]:
    """(rule, severity, message, suggestion, sentence, start, end, excerpt, value) in order; offsets in bytes."""
    text = text or ""
    if lang == "auto":
        lang = pytext.detect(text)
    v = View(text, lang)
    if not v.sentences:
        return []
    c = (config or Config()).filled()
    out = []
    for name, _, _, _, _, check in select_rules(names, lang):
        for (a, b), sentence, severity, value, key, fields in check(v, c):
            if "word" in fields:
                fields["quoted"] = _quote(fields["word"])
            m = W.MESSAGES[key]
            msg, tip = (x.format(**fields) for x in (m[:2] if lang == "de" else m[2:]))
            out.append((name, severity, msg, tip, sentence, a, b, text[a:b], value))
    marks = sorted({x for f in out for x in f[5:7]})
    at = dict(zip(marks, pytext.byte_offsets(text, marks)))
    return sorted(((*f[:5], at[f[5]], at[f[6]], *f[7:]) for f in out), key=lambda f: (f[5], f[0], f[6], f[2]))


FINDING = "rule string, severity string, message string, suggestion string, sentence int, `start` bigint, `end` bigint, excerpt string, value double"


def lint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "auto", rules: list[str] | None = None, severity: str = "info", config: Config | None = None) -> DataFrame:
    """One row a finding, in canonical order within each document."""
    if rules and lang != "auto":
        select_rules(rules, lang)
    least = SEVERITIES.index(severity)

    def make() -> Callable[..., list[tuple]]:
        return lambda k, text: [(k, *f) for f in findings(text, lang, rules, config) if SEVERITIES.index(f[1]) >= least]

    return flat_map(df, [id_col, text_col], make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {FINDING}")


def rank(severity: Column) -> Column:
    return F.when(severity == "warn", 1).otherwise(0)


def filter_severity(found: DataFrame, least: str) -> DataFrame:
    return found.where(rank(F.col("severity")) >= rank(F.lit(least)))


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Findings per document and rule."""
    return found.groupBy(id_col, "rule").agg(F.count("*").alias("findings"))


def rules_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted((n, x, t, d, s) for n, x, t, d, s, _ in RULES), "name string, language string, title string, description string, severity string")
