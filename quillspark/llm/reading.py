"""Reading level of papers and documents from the surprisal of their own prose.

Words become syllable classes and sentence ends, so that a sequence says how long its words and sentences are.
Interpolated trigram models are trained a language, one on each of PARTS graded parts of all its rows
and one on all of them. The surprisals of a whole document under them, at its words and at its sentence ends, place it on
a line (least squares), and isotonic regression maps the place monotonically to the reading ease of the language (Flesch
for English, Amstad for German, 100 minus the LIX index elsewhere), hence to a grade. Quantiles of the surprisals are
kept as the document's distribution. The exact ease is what the models are trained on; beside that it decides only texts
whose estimate lies in the band around the limit, which reaches to the farthest estimate of any row that erred.

Texts are read once: their symbols and exact ease are written to the checkpoint folder, and edges of the parts, trigram
counts, sums of the least squares, pooled steps and the band are made from all of these rows, added up by Spark. The driver
gets tables of fixed size a language, and the pooled steps.

Cases: null, blank and wordless texts, and notes in place of an abstract, have no level (null); a language with under LEAST_ROWS
rows gets its exact ease, marked by modelled = false; repeated rows get equal levels; texts of any length are read
whole; ties in the regression are pooled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import pytext
from quillspark.llm.language import Profiles
from quillspark.llm.whole import fold
from quillspark.operators.durable import checkpointed
from quillspark.operators.rows import flat_map

HARD = 40.0
SLACK = 2.0  # reading-ease points added to the band of the exact check
PARTS = 5  # graded models a language
RIDGE = 1e-3
NEAR = 25.0  # reading-ease points
LEAST_ROWS = 8  # rows of a language that get a model
FEW_ROWS = 60  # fewer rows say less about where estimates err
CHUNK = 100_000  # symbols scored at a time

LABELS = """
abstract summary background introduction objective objectives aim aims purpose method methods design setting participants materials
results result findings discussion conclusion conclusions interpretation significance context motivation
zusammenfassung hintergrund einleitung ziel ziele zielsetzung methode methoden methodik ergebnis ergebnisse befunde diskussion fazit
schlussfolgerung schlussfolgerungen kurzfassung fragestellung material
""".split()
_LABEL = "|".join(sorted(LABELS, key=len, reverse=True))
_NOTE = re.compile(r"^\W*(?:n/?a|none|null|tba|tbd|no (?:abstract|summary)\b.{0,40}|(?:abstract|summary|zusammenfassung|kurzfassung)\s+(?:is\s+|ist\s+|wurde\s+)?(?:not|nicht|un|withheld|missing|fehlt|removed).{0,60}|(?:kein|keine) (?:abstract|zusammenfassung|kurzfassung).{0,40})\W*$", re.I | re.S)
_STEPS = [
    (re.compile(r"<!--.*?-->|<(?:sup|sub)>.*?</(?:sup|sub)>", re.S | re.I), " "),
    (re.compile(r"</?(?:p|div|br|li|ul|ol|h\d|title|sec|section)\b[^<>]*>", re.I), "\n\n"),
    (re.compile(r"</?[A-Za-z][^<>]{0,80}>"), ""),
    (re.compile(r"(\w)[-­]\s*\n\s*(?=[a-zäöüß])"), r"\1"),
    (re.compile(r"\s*\(\s*\$[^$]{1,200}\$\s*\)|\$\$?[^$\n]{1,200}\$\$?|\\\[.*?\\\]|\\\(.*?\\\)", re.S), ""),
    (re.compile(r"~?\\(?:cite[pt]?|ref|footnote)\{[^{}]*\}"), ""),
    (re.compile(r"\\[a-zA-Z]+\*?\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\s*\((?:see |e\.g\.,? |cf\. |vgl\. |siehe )?[A-ZÄÖÜ][^()\d]{1,120}[ ,]\d{4}[a-z]?(?:[;,][^()]*\d{4}[a-z]?)*\)|\s*\[\d{1,3}(?:\s*[,–-]\s*\d{1,3})*\]"), ""),
    (re.compile(r"(?:Supplement\w*|Additional (?:data|material)|Ergänzend\w*)\b[^.:\n]{0,120}[:.]\s*(?=https?://|doi:|www\.)", re.I), ""),
    (re.compile(r"\b(?:doi:\s*|https?://|www\.)\S+|\b10\.\d{4,9}/\S+|\b[\w.+-]+@[\w-]+\.[\w.]+|\barXiv:\S+", re.I), ""),
    (re.compile(r"(?:\b(?:key\s?words?(?: and phrases)?|index terms|schlagw[oö]rter|schlüssel(?:wörter|begriffe)|stichw[oö]rter|subject (?:terms|headings)|mesh terms)\s*[:—–.-])[^\n]*?(?=(?:\.\s+[A-ZÄÖÜ©])|\n|\Z)\.?", re.I), ""),
    (re.compile(r"(?:©|\(c\)\s*\d{4}|copyright\b)[^.\n]*(?:\.|\Z)", re.I), ""),
    (re.compile(r"(?:all rights reserved|alle rechte vorbehalten|distributed under|published (?:by|under|in)|veröffentlicht unter|this (?:article|work) is licensed|licensed under)[^.\n]*(?:\.|\Z)", re.I), ""),
    (re.compile(r"(?:^|(?<=[.!?]\s)|(?<=\n))\s*(?:running (?:title|head)|short title|kurztitel|kolumnentitel|correspond\w*(?: author| to)?|korrespondenz\w*|address|anschrift|e-?mail|funding|received|accepted|editor|author note)\s*[:—–][^.\n]*(?:\.(?=\s|\Z)|\n|\Z)", re.I), ""),
    (re.compile(r"(?:^|(?<=[.!?]\s)|(?<=\n))\s*(?:(?:\w+ )?(?:Institut|Institute|Department|Abteilung|Universität|University|Hochschule|Fakultät|Faculty|Lehrstuhl|School|Akademie|Academy|Klinik|Zentrum|Centre|Center)\b (?:für|for|of|der|des|at)\b[^.\n]{0,120},[^.\n]{0,60})(?:\.(?=\s|\Z)|\n|\Z)"), ""),
    (re.compile(rf"(?:\A|(?<=[.!?]\s)|(?<=[.!?]\s\s)|(?<=\n))\s*(?:{_LABEL})(?:\s+(?:and|und|&)\s+(?:{_LABEL}))?\s*(?:[:.—–]|\s-)+\s*(?=\S)", re.I), " "),
]


def own_prose(text: str | None) -> str:
    """The running text alone: no labels, titles, keyword lists, citations, notices, addresses or markup."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    if _NOTE.match(text.strip()):
        return ""
    for rx, by in _STEPS:
        text = rx.sub(by, text)
    text = re.sub(r"\s+(?=[.,;:!?](?:\s|\Z))", "", text)
    return re.sub(r"[ \t]*\n(?!\s*\n)[ \t]*", " ", text).strip()


def ease(prose: str, lang: str) -> float | None:
    """Reading ease on the scale of the language, rounded as the scale is: to one decimal, halves away from zero."""
    n, w, s, *rest = pytext.counts(prose, lang)
    if lang in ("en", "de"):
        x = pytext.reading_ease(n, w, s, lang)
    else:
        x = 100 - (w / n + 100 * rest[-1] / w) if n and w else None
    return _rounded(x)


def _rounded(x: float | None) -> float | None:
    return None if x is None else math.copysign(math.floor(abs(x) * 10 + 0.5) / 10, x)


SYMBOLS = 14  # words of 0 to 11 syllables, words of scripts without spaces, sentence ends
MOST, WIDE, END = 11, 12, 13
PLACES = SYMBOLS**3


def measure(prose: str, lang: str) -> tuple[list[int], float | None]:
    """(sequence, ease) in one reading."""
    out: list[int] = []
    n = w = total = long = 0
    for a, b in pytext.sentence_spans(prose):
        found = pytext.words(prose[a:b])
        if not found:
            continue
        n += 1
        w += len(found)
        for x in found:
            k = pytext.syllables(x, lang)
            total += k
            out.append(WIDE if x[0] >= "฀" else min(MOST, k))
        if lang not in ("en", "de"):
            long += sum(pytext.measure(x) > 6 for x in found)
        out.append(END)
    if lang in ("en", "de"):
        x = pytext.reading_ease(n, w, total, lang)
    else:
        x = 100 - (w / n + 100 * long / w) if n and w else None
    return out, _rounded(x)


def sequence(prose: str, lang: str) -> np.ndarray:
    """Syllable class of every word, END after each sentence."""
    return np.array(measure(prose, lang)[0], np.int64)


def _places(s: np.ndarray) -> np.ndarray:
    """Place of each symbol's trigram in a table of all trigrams."""
    x = np.concatenate([[END, END], s])
    return (x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:]


def _costs(n: np.ndarray) -> np.ndarray:
    """Surprisal of every trigram, from the counts of all trigrams, under models up to order 0 (all symbols alike), 1, 2 and 3.

    The weight of an order grows with how often its history was seen.
    """
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    p = np.full((SYMBOLS,) * 3, 1 / SYMBOLS)
    out = [p]
    for c in (n.sum((0, 1))[None, None], n.sum(0)[None], n):
        seen = c.sum(-1, keepdims=True)
        w = seen / (seen + 4)
        p = w * (c / np.maximum(seen, 1)) + (1 - w) * p
        out.append(p)
    return -np.log(np.array(out)).reshape(4, -1)


def counted(rows: Iterable[np.ndarray]) -> np.ndarray:
    """How often each trigram occurs in the rows."""
    n = np.zeros(PLACES, np.int64)
    for s in rows:
        n += np.bincount(_places(s), minlength=PLACES)
    return n


def surprisals(rows: list[np.ndarray]) -> np.ndarray:
    """Surprisal of every trigram under models of the rows."""
    return _costs(counted(rows))


def pooled(blocks: Iterable[tuple[float, float, float]]) -> list[list[float]]:
    """Blocks (sum of y, rows, last x) in the order of x, pooled until their means fall strictly.

    Pooling what was pooled apart before gives the same blocks, so ranges of x may be pooled each by itself first.
    """
    out: list[list[float]] = []
    for b in blocks:
        out.append([*b])
        while len(out) > 1 and (out[-2][0] * out[-1][1] <= out[-1][0] * out[-2][1] or out[-2][2] == out[-1][2]):
            s, n, last = out.pop()
            out[-1][0] += s
            out[-1][1] += n
            out[-1][2] = last
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-increasing fit by pooling: the steps' x and their values."""
    order = np.argsort(x, kind="stable")
    blocks = pooled((b, 1, a) for a, b in zip(x[order], y[order]))
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def edges(eases: Iterable[tuple[float, int]], rows: int) -> list[float]:
    """Eases at which the next part begins, from (ease, rows) with falling ease: parts of equal size but for ties."""
    parts = min(PARTS, max(2, rows // 4))
    out: list[float] = []
    before = 0
    for e, n in eases:
        before += n
        while len(out) < parts - 1 and before > (len(out) + 1) * rows // parts:
            out.append(e)
    return out


class Level:
    """Models of one language: surprisal tables of graded parts of its rows, the weights of the surprisals, the isotonic steps.

    Each step of the fit takes sums over the rows, so that they can be added up here or by Spark.
    """

    def __init__(self, edges: list[float], rows: int):
        self.edges, self.rows = edges, rows

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, float]]) -> Level:
        """From (sequence, ease)."""
        level = cls(edges(sorted(Counter(e for _, e in rows).items(), reverse=True), len(rows)), len(rows))
        level.learn(np.array([counted(s for s, e in rows if level.part(e) == i) for i in range(len(level.edges) + 1)]))
        x, y = level.features([s for s, _ in rows]), np.array([e for _, e in rows])
        level.weigh(level.moments(x, y))
        level.x, level.y = isotonic(-(x @ level.weights), y)
        level.bound(level.farthest(x, y))
        return level

    def part(self, x: float) -> int:
        return sum(x <= e for e in self.edges)

    def learn(self, n: np.ndarray) -> None:
        """Surprisal tables, from the trigram counts of each part."""
        self.whole = _costs(n.sum(0))
        self.costs = np.ascontiguousarray(np.vstack([_costs(c)[1::2] for c in n] + [self.whole]).T)

    def moments(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums of the least squares: odd texts far off must not bend the line where the grades lie."""
        near = x / (1 + ((y - HARD) / NEAR) ** 2)[:, None]
        return near.T @ np.column_stack([x, y])

    def weigh(self, m: np.ndarray) -> None:
        self.weights = np.linalg.solve(m[:, :-1] + RIDGE * np.eye(len(m)), m[:, -1])

    def farthest(self, x: np.ndarray, y: np.ndarray) -> float:
        """How far from HARD an estimate lies that is on the wrong side of it."""
        z = self.placed(x)
        return float(np.abs(z - HARD)[(z < HARD) != (y < HARD)].max(initial=0.0))

    def bound(self, off: float) -> None:
        self.band = off + (SLACK if self.rows >= FEW_ROWS else 2 * SLACK)  # nearer to HARD the estimate isn't sure

    def features(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of each row the surprisals a word at words and at sentence ends under each part's models of order 1 and 3, and of the words a sentence."""
        at = [_places(s) for s in rows]
        begin = np.cumsum([0, *map(len, at[:-1])])
        at = np.concatenate(at)
        end = (at % SYMBOLS == END)[:, None]
        costs = self.costs[at]
        words, ends = (np.maximum(1, np.add.reduceat(k.astype(np.int64), begin)) for k in (~end, end))
        a, b = np.add.reduceat(costs * ~end, begin), np.add.reduceat(costs * end, begin)
        return np.column_stack([np.ones(len(rows)), a[:, :-4] / words, b[:, :-4] / words, a[:, -4:] / words, b[:, -3:] / words, a[:, -4:] / ends])

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Reading ease by the isotonic steps, linear between them."""
        return np.interp(-(x @ self.weights), self.x, self.y)

    def estimate(self, s: np.ndarray) -> tuple[float, np.ndarray]:
        """Reading ease, and the surprisal of every symbol."""
        return float(self.placed(self.features([s]))[0]), self.whole[3, _places(s)]


class Reader:
    def __init__(self, rows: list[tuple[str, str]]):
        """From (language, prose)."""
        by: dict[str, list] = defaultdict(list)
        for lang, prose in rows:
            x = ease(prose, lang)
            if x is not None:
                by[lang].append((sequence(prose, lang), x))
        self.levels = {k: Level.of(v) for k, v in by.items() if len(v) >= LEAST_ROWS}

    def read(self, prose: str, lang: str) -> tuple[float, bool, float | None, float | None, float | None] | None:
        """(ease, whether by the model, mean, median and 90 % quantile of the surprisal); None without words.

        A language without a model gets its exact ease, and no surprisal.
        """
        level = self.levels.get(lang)
        if level is None:
            x = ease(prose, lang)
            return None if x is None else (x, False, None, None, None)
        s = sequence(prose, lang)
        if not len(s):
            return None
        x, costs = level.estimate(s)
        return x, True, float(costs.mean()), float(np.median(costs)), float(np.quantile(costs, 0.9))

    def hard(self, prose: str, lang: str) -> bool:
        """Below HARD by the estimate; within the band around HARD in which estimates of held-out rows erred, the exact scale checks it."""
        level = self.levels.get(lang)
        if level is not None:
            s = sequence(prose, lang)
            if not len(s):
                return False
            x = level.estimate(s)[0]
            if abs(x - HARD) > level.band:
                return x < HARD
        x = ease(prose, lang)
        return x is not None and x < HARD


def grade(x: float | None) -> int | None:
    """Five grades of the ease scale, 1 the easiest."""
    return None if x is None else 1 + sum(x < edge for edge in (80, 60, 40, 20))


def measured(df: DataFrame, id_col: str, text_col: str, profiles: Profiles | None = None) -> DataFrame:
    """Id, language, ease in tenths and symbols of every text with words, read once; profiles None means English or German by vote."""
    sent = df.sparkSession.sparkContext.broadcast(profiles)

    def make() -> Callable[..., list[tuple]]:
        known = sent.value

        def rows(key, text):  # noqa: ANN001, ANN202
            p = own_prose(text)
            lang = (known.best(p) if known else pytext.detect(p)) if p else None
            s, x = measure(p, lang) if lang else ([], None)
            return [] if x is None else [(key, lang, round(x * 10), bytes(s))]

        return rows

    return checkpointed(flat_map(df, [id_col, text_col], make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, lang string, tenths long, symbols binary"))


def _chunks(rows: Iterable[tuple], levels: dict[str, Level]) -> Iterator[tuple[str, list, list[np.ndarray], np.ndarray]]:
    """(language, ids, sequences, eases) of up to CHUNK symbols; rows are (language, tenths, symbols, ...)."""
    held: dict[str, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))
    size: Counter = Counter()
    for lang, tenths, symbols, *key in rows:
        if lang in levels:
            keys, seqs, eases = held[lang]
            keys.append(key)
            seqs.append(np.frombuffer(symbols, np.uint8).astype(np.int64))
            eases.append(tenths / 10)
            size[lang] += len(symbols)
            if size[lang] >= CHUNK:
                del held[lang], size[lang]
                yield lang, keys, seqs, np.array(eases)
    for lang, (keys, seqs, eases) in held.items():
        yield lang, keys, seqs, np.array(eases)


def fit_measured(m: DataFrame) -> Reader:
    """The models of every language, from all rows of measured()."""
    sc = m.sparkSession.sparkContext
    sizes = {r[0]: r[1] for r in m.groupBy("lang").count().collect() if r[1] >= LEAST_ROWS}
    by = m.groupBy("lang", "tenths").count().where(F.col("lang").isin(*sizes)).orderBy("lang", F.desc("tenths"))
    rows = ((r[0], r[1] / 10, r[2]) for r in by.toLocalIterator())
    levels = {k: Level(edges(((e, n) for _, e, n in g), sizes[k]), sizes[k]) for k, g in groupby(rows, lambda r: r[0])} if sizes else {}

    def sums(run: Callable[[Iterator[tuple], dict[str, Level]], Iterable[tuple]], kind: str) -> DataFrame:
        sent = sc.broadcast(levels)
        return fold(m, ["lang", "tenths", "symbols"], lambda rows: run(rows, sent.value), f"lang string, {kind}")

    def count(rows, levels):  # noqa: ANN001, ANN202
        n = {k: np.zeros((len(x.edges) + 1, PLACES), np.int64) for k, x in levels.items()}
        for lang, tenths, symbols in rows:
            if lang in n:
                n[lang][levels[lang].part(tenths / 10)] += np.bincount(_places(np.frombuffer(symbols, np.uint8).astype(np.int64)), minlength=PLACES)
        return ((k, int(at), int(c.flat[at])) for k, c in n.items() for at in np.flatnonzero(c))

    def moments(rows, levels):  # noqa: ANN001, ANN202
        m: dict[str, np.ndarray] = {}
        for lang, _, seqs, eases in _chunks(rows, levels):
            m[lang] = m.get(lang, 0.0) + levels[lang].moments(levels[lang].features(seqs), eases)
        return ((k, at, float(x)) for k, c in m.items() for at, x in enumerate(c.flat))

    def places(rows, levels):  # noqa: ANN001, ANN202
        for lang, _, seqs, eases in _chunks(rows, levels):
            for x, y in zip(-(levels[lang].features(seqs) @ levels[lang].weights), eases):
                yield lang, float(x), round(y * 10)

    def off(rows, levels):  # noqa: ANN001, ANN202
        for lang, _, seqs, eases in _chunks(rows, levels):
            yield lang, levels[lang].farthest(levels[lang].features(seqs), eases)

    def steps(rows):  # noqa: ANN001, ANN202
        for lang, g in groupby(rows, lambda r: r[0]):
            yield from ((lang, *b) for b in pooled((s, n, x) for _, x, s, n in g))

    if not levels:
        return Reader([])
    n = {k: np.zeros((len(x.edges) + 1, PLACES), np.int64) for k, x in levels.items()}
    for k, at, c in sums(count, "at int, n long").groupBy("lang", "at").agg(F.sum("n")).collect():
        n[k].flat[at] = c
    for k, x in levels.items():
        x.learn(n[k])
    got: dict[str, dict[int, float]] = defaultdict(dict)
    for k, at, c in sums(moments, "at int, x double").groupBy("lang", "at").agg(F.sum("x")).collect():
        got[k][at] = c
    for k, x in levels.items():
        size = 2 * x.costs.shape[1] + 4  # features
        x.weigh(np.array([got[k][i] for i in range(size * (size + 1))]).reshape(size, size + 1))
    at = sums(places, "x double, tenths long").groupBy("lang", "x").agg(F.sum("tenths").alias("s"), F.count("*").alias("n"))
    blocks = fold(at.repartitionByRange("lang", "x").sortWithinPartitions("lang", "x"), ["lang", "x", "s", "n"], steps, "lang string, s long, n long, x double").collect()
    for k, x in levels.items():
        own = pooled(sorted(((b.s, b.n, b.x) for b in blocks if b.lang == k), key=lambda b: b[2]))
        x.x, x.y = np.array([b[2] for b in own]), np.array([b[0] / b[1] / 10 for b in own])
    for k, c in sums(off, "off double").groupBy("lang").agg(F.max("off")).collect():
        levels[k].bound(c)
    reader = Reader([])
    reader.levels = levels
    return reader


def fit_papers(df: DataFrame, id_col: str = "paper_id", text_col: str = "abstract") -> Reader:
    return fit_measured(measured(df, id_col, text_col))


def find_hard(df: DataFrame, id_col: str = "paper_id", text_col: str = "abstract") -> DataFrame:
    """hard_papers with models of the same rows, whose texts are read once for both."""
    m = measured(df, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(fit_measured(m))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        levels = sent.value.levels

        def modelled() -> Iterator[tuple]:
            for row in rows:
                if row[0] in levels:
                    yield row
                elif row[1] / 10 < HARD:
                    exact.append((row[3],))

        exact: list[tuple] = []
        for lang, keys, seqs, eases in _chunks(modelled(), levels):
            z = levels[lang].placed(levels[lang].features(seqs))
            hard = np.where(np.abs(z - HARD) > levels[lang].band, z, eases) < HARD
            yield from ((k,) for (k,), h in zip(keys, hard) if h)
            yield from exact
            exact.clear()
        yield from exact

    return fold(m, ["lang", "tenths", "symbols", id_col], run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}")


def hard_papers(df: DataFrame, reader: Reader, id_col: str = "paper_id", text_col: str = "abstract") -> DataFrame:
    """Ids of the texts whose own prose is hard, English or German by vote."""
    sent = df.sparkSession.sparkContext.broadcast(reader)

    def make() -> Callable[..., list[tuple]]:
        r = sent.value

        def rows(key, text):  # noqa: ANN001, ANN202
            p = own_prose(text)
            return [(key,)] if p and r.hard(p, pytext.detect(p)) else []

        return rows

    return flat_map(df, [id_col, text_col], make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}")


def fit_documents(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> Reader:
    """Models of every language; the profiles say what language a text is in."""
    return fit_measured(measured(df, id_col, text_col, profiles))


def levels(df: DataFrame, reader: Reader, profiles: Profiles | None, id_col: str, text_col: str) -> DataFrame:
    """Language, estimated ease, grade, whether a model gave them, and surprisal distribution of every row; profiles None means English or German by vote."""
    sent = df.sparkSession.sparkContext.broadcast((reader, profiles))

    def make() -> Callable[..., list[tuple]]:
        r, known = sent.value

        def rows(key, text):  # noqa: ANN001, ANN202
            p = own_prose(text)
            lang = (known.best(p) if known else pytext.detect(p)) if p else None
            got = r.read(p, lang) if lang else None
            return [(key, lang, *((round(got[0], 1), grade(got[0]), got[1], *(None if x is None else round(x, 4) for x in got[2:])) if got else (None,) * 6))]

        return rows

    kind = df.schema[id_col].dataType.simpleString()
    return flat_map(df, [id_col, text_col], make, f"`{id_col}` {kind}, lang_code string, reading_ease double, grade int, modelled boolean, surprisal_mean double, surprisal_median double, surprisal_p90 double")
