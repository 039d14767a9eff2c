"""Language of each document and of each of its segments by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (1 to 5, word borders as spaces); a text is
given the language to whose profile its own ranking is least out of place. Profiles are fitted on all labelled documents,
then these are labelled anew and the profiles are fitted again, twice, which throws out wrong labels and labels that name
no language of the corpus. N-grams and words are counted within each split and added up by Spark; texts labelled anew are
moved from one label's counts to the other's. The driver gets core words and profiles alone. Everything else is one narrow
pass over all documents.

Cases: null, blank and wordless texts have no language (null, confidence 0); ties go to the first code in
alphabetical order; equal texts get equal answers; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.sentences import spans
from quillspark.llm.whole import at_ranks, fold
from quillspark.operators.durable import checkpointed
from quillspark.operators.rows import flat_map

PROFILE = 500  # n-grams a profile
CORE = 0.1  # share of a label's texts that have a core word
NEAR = 0.75  # of the usual coverage by core words
KEPT_WORDS = 100_000
KEPT_ITEMS = 4_000_000  # n-grams and words of texts held in a task before their counts are sent
TOGETHER = 64  # texts measured in one go
_EMPTY = np.zeros(0, np.int32)
DENSE = ("zh", "ja", "ko")
TIE = 0.04  # a lead under which the label's word counts
LEAST_WORDS = 4  # of a sentence that counts as prose
LEAST_LETTERS = 24  # fewer letters, in a script with spaces, say too little against the rest of the text
LEAST_SENTENCES = 2
MARGIN = 0.03  # by how much a sentence must be nearer to another language than to the text's own
LEAST_CONFIDENCE = 0.15  # mean of the sentences of a further language

#: ISO 639-2 to 639-1 (fixed values).
CODES = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "nld": "nl", "dut": "nl", "por": "pt",
    "rus": "ru", "zho": "zh", "chi": "zh", "jpn": "ja", "ara": "ar", "hin": "hi", "swe": "sv", "dan": "da", "nor": "no", "fin": "fi",
    "pol": "pl", "ces": "cs", "cze": "cs", "tur": "tr", "tha": "th", "kor": "ko", "ukr": "uk", "ell": "el", "gre": "el", "hun": "hu",
}
MEANINGLESS = {"", "und", "unknown", "auto", "??", "n/a", "x-default", "null", "none", "mul", "zxx", "mis", "na", "xx", "-", "?"}

_LETTER = re.compile(r"[^\W\d_]")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_NOISE = re.compile(r"https?://\S+|<[^<>]{1,200}>|\]\([^()\s]*\)|[\w.+-]+@[\w-]+\.\w+|[\w-]+\.example\S*")


def label(value: str | None) -> str | None:
    """Two-letter code of a stored label; None if it is missing or means nothing."""
    x = (value or "").strip().lower()
    if x in MEANINGLESS:
        return None
    x = re.split("[-_]", x)[0].strip()
    x = CODES.get(x, x)
    return x if len(x) == 2 and x.isalpha() and x != "xx" else None


def label_column(c: Column) -> Column:
    """label() in SQL; the cleaned value is bound once by a one-element transform."""
    by: dict[str, list[str]] = defaultdict(list)
    for three, two in CODES.items():
        by[two].append(three)

    def code(x: Column) -> Column:
        out = F.when(x.rlike("^[a-z]{2}$") & (x != "xx"), x)
        for two, threes in by.items():
            out = out.when(x.isin(*threes), two)
        return out

    low = F.lower(F.trim(c))
    base = F.when(~low.isin(*MEANINGLESS), F.trim(F.regexp_extract(low, "^[^_-]*", 0)))
    return F.transform(F.array(base), code)[0]


def word_grams(w: str) -> list[str]:
    if w[0] >= "฀":  # no spaces between words
        return [*w, *(w[i:i + 2] for i in range(len(w) - 1))]
    w = f" {w} "
    n = len(w)
    return [*w[1:-1], *(w[i:i + k] for k in (2, 3, 4, 5) for i in range(n - k + 1))]


def grams(text: str) -> set[str]:
    return {g for w in set(_WORDS.findall(_NOISE.sub(" ", text).lower())) for g in word_grams(w)}


def text_words(text: str) -> set[str]:
    """Words of a text; pairs of characters where words aren't spaced."""
    out: set[str] = set()
    for w in _WORDS.findall(_NOISE.sub(" ", text).lower()):
        out.update([w[i:i + 2] for i in range(len(w) - 1)] if w[0] >= "฀" else [w])
    return out


class Profiles:
    """Ranked n-grams of every language."""

    def __init__(self, ranked: dict[str, list[str]]):
        self.langs = sorted(ranked)
        self.index: dict[str, int] = {}
        for k in self.langs:
            for g in ranked[k]:
                self.index.setdefault(g, len(self.index))
        self.words: dict[str, np.ndarray] = {}
        self.rank = np.full((len(self.index), max(1, len(self.langs))), 2 * PROFILE, np.float32)  # not in the profile: as far as can be
        for j, k in enumerate(self.langs):
            for r, g in enumerate(ranked[k]):
                self.rank[self.index[g], j] = r

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], sizes: dict[str, int] | None = None) -> Profiles:
        """From (label, text); sizes are the labels' counts in the whole corpus.

        A label is no language of its own, but a wrong name of others, if the core words of commoner labels cover most of
        its texts as well as those labels' own texts. Then the texts are labelled anew and the profiles made again.
        """
        counted = [(k, grams(t), t) for k, t in rows]
        sizes = sizes or Counter(k for k, *_ in counted)

        def make(said: list[str]) -> Profiles:
            by: dict[str, Counter] = defaultdict(Counter)
            for k, (_, c, _) in zip(said, counted):
                if k:
                    by[k].update(c)  # document frequency: no long text rules a profile
            return cls({k: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]] for k, c in by.items()})

        # core words of a label: those that many of its texts share, so that stray texts add none
        texts: dict[str, list[set[str]]] = defaultdict(list)
        for k, _, t in counted:
            if w := text_words(t):
                texts[k].append(w)
        core = {k: {w for w, n in Counter(w for x in v for w in x).items() if n >= max(2, CORE * len(v))} for k, v in texts.items()}
        usual = {k: float(np.median([len(x & core[k]) / len(x) for x in v])) for k, v in texts.items()}
        true = sorted(texts, key=lambda k: (-sizes.get(k, 0), k))
        for k in reversed(true[1:]):
            more = [j for j in true if j != k and (sizes.get(j, 0), j) > (sizes.get(k, 0), k) and len(texts[j]) >= 5]
            foreign = sum(any(len(x & core[j]) >= NEAR * usual[j] * len(x) for j in more) for x in texts[k])
            if foreign * 2 >= len(texts[k]):
                true.remove(k)
        said = [k for k, *_ in counted]
        said = [k if k in true else "" for k in said]
        for _ in range(2):
            model = make(said)
            said = [model.best(t) or "" for *_, t in counted]
        return make(said)

    def ids(self, word: str) -> np.ndarray:
        """Places of a word's n-grams among those of any profile; words come again and again, so they are kept."""
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            index = self.index
            got = self.words[word] = np.array([index[g] for g in word_grams(word) if g in index], np.int32)
        return got

    def text_ids(self, text: str) -> np.ndarray:
        parts = [self.ids(w) for w in _WORDS.findall(_NOISE.sub(" ", text).lower())]
        return np.concatenate(parts) if parts else _EMPTY

    def distances(self, ids: np.ndarray) -> np.ndarray | None:
        """Mean out-of-place distance to each language, 0 to 1; None for a text without an n-gram of any profile."""
        return self.distances_of([ids])[0]

    def distances_of(self, texts: list[np.ndarray]) -> list[np.ndarray | None]:
        """distances() of many texts over arrays, TOGETHER in one go."""
        return [d for i in range(0, len(texts), TOGETHER) for d in self._distances_of(texts[i:i + TOGETHER])]

    def _distances_of(self, texts: list[np.ndarray]) -> list[np.ndarray | None]:
        if not self.langs or not any(map(len, texts)):
            return [None] * len(texts)
        size = len(self.index)
        all_ids = np.concatenate([t + np.int64(k * size) for k, t in enumerate(texts)])
        if len(texts) * size <= 64 * len(all_ids):  # a count of every n-gram takes less than a sort
            n = np.bincount(all_ids, minlength=len(texts) * size)
            found = np.flatnonzero(n)
            n = n[found]
        else:
            found, n = np.unique(all_ids, return_counts=True)
        of, gram = found // size, found % size
        begin = np.searchsorted(of, np.arange(len(texts) + 1))
        kinds = np.diff(begin)
        # ties share their middle rank; a short text's ranks are spread over the profile's length
        key = of * np.int64(1 << 32) - n
        order = np.sort(key)
        middle = (np.searchsorted(order, key, "left") + np.searchsorted(order, key, "right") - 1) * 0.5 - begin[of]
        own = middle * (PROFILE / np.clip(kinds, 1, PROFILE))[of]
        off = np.minimum(np.abs(self.rank[gram] - own[:, None].astype(np.float32)), PROFILE)
        off[own >= PROFILE] = 0  # beyond the profile's length a rank says nothing
        counted = np.add.reduceat(np.append(own < PROFILE, False).astype(np.int64), begin[:-1])
        sums = np.add.reduceat(np.vstack([off, np.zeros((1, off.shape[1]), off.dtype)]), begin[:-1], axis=0)
        return [sums[k] / (PROFILE * max(1, counted[k])) if kinds[k] else None for k in range(len(texts))]

    def best(self, text: str) -> str | None:
        d = self.distances(self.text_ids(text))
        return None if d is None else self.langs[int(d.argmin())]


class Tally:
    """How many texts of each label hold each n-gram, each word (marked by a line break) and any word at all (the empty item)."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.words: dict[str, np.ndarray] = {}
        self.held: dict[tuple[str, int], list[np.ndarray]] = defaultdict(list)
        self.size = 0
        self.mark = np.zeros(1 << 16, np.int32)

    def _id(self, item: str) -> int:
        return self.index.setdefault(item, len(self.index))

    def ids(self, text: str) -> np.ndarray:
        """The items of a text, each once."""
        parts = []
        for w in set(_WORDS.findall(_NOISE.sub(" ", text).lower())):
            got = self.words.get(w)
            if got is None:
                own = [w[i:i + 2] for i in range(len(w) - 1)] if w[0] >= "฀" else [w]  # as text_words
                got = self.words[w] = np.array([self._id(x) for x in ["", *word_grams(w), *("\n" + x for x in own)]], np.int32)
            parts.append(got)
        if not parts:
            return _EMPTY
        out = np.concatenate(parts)
        if len(self.index) > len(self.mark):
            self.mark = np.zeros(2 * len(self.index), np.int32)
        at = np.arange(len(out), dtype=np.int32)
        self.mark[out] = at
        return out[self.mark[out] == at]

    def add(self, label: str, ids: np.ndarray, sign: int = 1) -> None:
        if label and len(ids):
            self.held[label, sign].append(ids)
            self.size += len(ids)

    def send(self, least: int = KEPT_ITEMS) -> Iterator[tuple[str, str, int]]:
        """(label, item, texts) once at least so many items are held."""
        if self.size >= least:
            names = list(self.index)
            for (label, sign), parts in self.held.items():
                for i, n in zip(*np.unique(np.concatenate(parts), return_counts=True)):
                    yield label, names[i], sign * int(n)
            self.held.clear()
            self.size = 0
        if len(self.words) >= KEPT_WORDS and not self.held:
            self.words.clear()
            self.index.clear()


def _added(counts: DataFrame) -> DataFrame:
    return counts.groupBy("label", "item").agg(F.sum("n").alias("n"))


def _ranked(counts: DataFrame) -> Profiles:
    """Profiles of the commonest n-grams of each label."""
    order = Window.partitionBy("label").orderBy(F.desc("n"), "item")
    rows = counts.where("n > 0 and item <> '' and not startswith(item, '\n')").withColumn("r", F.row_number().over(order)).where(F.col("r") <= PROFILE).collect()
    by: dict[str, list[str]] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.label, r.r)):
        by[r.label].append(r.item)
    return Profiles(by)


def _true_labels(known: DataFrame, counts: DataFrame, sizes: dict[str, int]) -> list[str]:
    """The labels that aren't wrong names of others, as in Profiles.fit."""
    sc = known.sparkSession.sparkContext
    texts = {r.label: r.n for r in counts.where("item = ''").collect()}
    true = sorted(texts, key=lambda k: (-sizes[k], k))
    if len(true) < 2:
        return true
    least = F.create_map(*(F.lit(x) for k, n in sorted(texts.items()) for x in (k, float(max(2, CORE * n)))))
    core: dict[str, np.ndarray] = {}
    for r in counts.where(F.startswith("item", F.lit("\n")) & (F.col("n") >= F.element_at(least, F.col("label")))).collect():
        core.setdefault(r.item[1:], np.zeros(len(true), np.int64))[true.index(r.label)] = 1
    sent = sc.broadcast((true, core))

    def cover(rows: Iterator[tuple]) -> Iterator[tuple]:
        true, core = sent.value
        for k, text in rows:
            if words := text_words(text):
                yield k, len(words), sum((core[w] for w in words if w in core), np.zeros(len(true), np.int64)).tolist()

    covered = checkpointed(fold(known, ["label", "text"], cover, "label string, words int, core array<int>"))
    place = F.create_map(*(F.lit(x) for i, k in enumerate(true, 1) for x in (k, i)))
    own = covered.select(F.col("label").alias("key"), (F.element_at("core", F.element_at(place, F.col("label"))) / F.col("words")).alias("value"), F.lit(1).cast("long").alias("n"))
    usual = {k: (a + b) / 2 for k, (a, b) in at_ranks(own, lambda n: [(n - 1) // 2, n // 2]).items()}
    tell = sc.broadcast((true, usual, {k: [j for j in true if (sizes[j], j) > (sizes[k], k) and texts[j] >= 5] for k in true}, sizes))

    def foreign(rows: Iterator[tuple]) -> Iterator[tuple]:
        true, usual, more, sizes = tell.value
        at = {k: i for i, k in enumerate(true)}
        out: Counter = Counter()
        for k, words, core in rows:
            over = [j for j in more[k] if core[at[j]] >= NEAR * usual[j] * words]
            commoner = any(sizes[j] > sizes[k] for j in over)
            out[k, commoner, "" if commoner else " ".join(over)] += 1  # labels of the same size may have been dropped before
        return ((*x, n) for x, n in out.items())

    told = fold(covered, ["label", "words", "core"], foreign, "label string, commoner boolean, alike string, n long").groupBy("label", "commoner", "alike").agg(F.sum("n").alias("n")).collect()
    for k in reversed(true[1:]):
        if 2 * sum(r.n for r in told if r.label == k and (r.commoner or any(j in true for j in r.alike.split()))) >= texts[k]:
            true.remove(k)
    return true


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from all labelled rows: those Profiles.fit makes of them."""
    known = df.select(label_column(F.col(lang_col)).alias("label"), F.col(text_col).alias("text")).where("label is not null and text is not null")
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}

    def tally(rows: Iterator[tuple]) -> Iterator[tuple]:
        t = Tally()
        for k, text in rows:
            t.add(k, t.ids(text))
            yield from t.send()
        yield from t.send(0)

    kind = "label string, item string, n long"
    counts = checkpointed(_added(fold(known, ["label", "text"], tally, kind)))
    true = _true_labels(known, counts, sizes)
    first = counts.where(F.col("label").isin(*true))
    model = _ranked(first)

    for _ in range(2):
        sent = df.sparkSession.sparkContext.broadcast((model, frozenset(true)))

        def anew(rows: Iterator[tuple]) -> Iterator[tuple]:
            model, true = sent.value
            t = Tally()
            while some := list(islice(rows, TOGETHER)):
                for (k, text), d in zip(some, model.distances_of([model.text_ids(text) for _, text in some])):
                    said = "" if d is None else model.langs[int(d.argmin())]
                    before = k if k in true else ""
                    if said != before:
                        ids = t.ids(text)
                        t.add(before, ids, -1)
                        t.add(said, ids)
                yield from t.send()
            yield from t.send(0)

        model = _ranked(_added(first.unionAll(fold(known, ["label", "text"], anew, kind))))
    return model


def _prose(words: list[str], unit: str) -> bool:
    """Whether a unit is a sentence: words enough, and a stop where the script has stops and spaces."""
    wide = any(w[0] >= "฀" for w in words)
    return sum(len(w) // 2 if w[0] >= "฀" else 1 for w in words) >= LEAST_WORDS and (wide or unit.rstrip("\"'’”»«)]*_ ")[-1:] in ".!?…:;।؟。！？")


class Detector:
    def __init__(self, profiles: Profiles):
        self.p = profiles

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, str, float, bool]], np.ndarray | None]:
        """(start, end, language, confidence, prose) of each sentence that shows a language."""
        text = text or ""
        out = []
        plain = _NOISE.sub(lambda m: " " * len(m.group()), text)
        units = [(a, b, _WORDS.findall(plain, a, b)) for a, b in spans(text)]
        parts = [np.concatenate([self.p.ids(w.lower()) for w in words]) if words else _EMPTY for *_, words in units]
        prose = [_prose(words, text[a:b]) for a, b, words in units]
        told = [ids for ids, p in zip(parts, prose) if p] or parts  # phrases don't speak for the text where sentences do
        whole, *each = self.p.distances_of([np.concatenate(told) if told else _EMPTY, *parts])
        if whole is None:
            return [], None
        main = int(whole.argmin())
        for (a, b, found), d, p in zip(units, each, prose):
            if d is None:
                continue
            k = int(d.argmin())
            if k != main and d[main] - d[k] < MARGIN:
                k = main
            near = np.partition(d, 1)[1] if len(d) > 1 else 1.0  # next best, if this is the best
            conf = float(max(0.0, (near - d[k]) / max(near, 1e-6)))
            if k != main and sum(map(len, found)) < LEAST_LETTERS and not any(w[0] >= "฀" for w in found):
                k = main
            out.append((a, b, self.p.langs[k], conf, p))
        return out, whole

    def document(self, text: str | None) -> tuple[str | None, float, str | None, list[str], list[tuple[int, int, str, float]]]:
        """(language, confidence, next best language, languages of its running prose, merged segments)."""
        found, whole = self.segments(text)
        if not found:
            return None, 0.0, None, [], []
        prose: dict[str, list[float]] = defaultdict(list)
        for a, b, k, c, p in found:
            if p:
                prose[k].append(c)
        order = sorted(zip(whole, self.p.langs))
        weight: dict[str, float] = defaultdict(float)
        for a, b, k, c, p in found:  # running prose speaks for the text before phrases do; dense scripts say more a character
            weight[k] += (b - a) * (2.5 if k in DENSE else 1) * (10 if p else 1)
        main = max(sorted(weight), key=lambda k: weight[k])
        conf = (order[1][0] - order[0][0]) / max(order[1][0], 1e-6) if len(order) > 1 else 1.0
        langs = [k for k in sorted(prose) if len(prose[k]) >= LEAST_SENTENCES and (k == main or sum(prose[k]) >= LEAST_CONFIDENCE * len(prose[k]))] or [main]
        merged: list[list] = []
        for a, b, k, c, _ in found:
            if merged and merged[-1][2] == k:
                merged[-1][1] = b
                merged[-1][3] = max(merged[-1][3], c)
            else:
                merged.append([a, b, k, c])
        second = next((k for _, k in order if k != main), None)
        return main, round(float(conf), 4), second, langs, [tuple(m) for m in merged]


def detect_languages(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, without: Callable[[str | None], bool] | None = None) -> DataFrame:
    """One row per document: detected, confidence, languages, segments (character offsets), and the kept columns.

    Texts for which `without` holds have no row; the test runs in the same pass, so nothing is joined.
    """
    sent = df.sparkSession.sparkContext.broadcast((profiles, without))
    keep = keep or []
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [id_col, *keep])

    def make() -> Callable[..., Iterator[tuple]]:
        fitted, skip = sent.value
        detector = Detector(fitted)

        def rows(text, *own):  # noqa: ANN001, ANN202
            if skip is not None and skip(text):
                return
            main, conf, second, langs, segments = detector.document(text)
            yield (*own, main, conf, second, langs, [{"start": a, "end": b, "lang_code": k, "confidence": c} for a, b, k, c in segments])

        return rows

    schema = f"{kinds}, detected string, confidence double, second string, languages array<string>, segments array<struct<start:int,end:int,lang_code:string,confidence:double>>"
    return flat_map(df, [text_col, id_col, *keep], make, schema)


def mislabelled(found: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """Rows of detect_languages (with the label kept) whose label is missing or wrong, or whose text is mixed: one per language."""
    said = label_column(F.col(lang_col))
    wrong = said.isNull() | (F.size("languages") > 1) | ~F.array_contains("languages", said)
    tie = (F.size("languages") == 1) & (F.col("confidence") < TIE) & F.coalesce(said == F.col("second"), F.lit(False))
    return found.where(F.col("detected").isNotNull() & wrong & ~tie).select(id_col, F.explode("languages").alias("lang_code"))
