"""Keyword-stuffed and link-list pages by the perplexity of their function-word and word-class sequences.

Each document becomes a sequence of word classes: articles, pronouns, conjunctions, auxiliaries and prepositions
of its languages stand for themselves as groups, other words fall into classes by shape (content, name, number,
code, tag, link) and by whether they repeat a word of the document's keywords. An interpolated trigram model
fitted on prose gives every segment (line or sentence) a perplexity; segments outside the band that prose shows
are abnormal, and only documents with most of their words in abnormal segments can be flagged. An exact check follows:
of the abnormal segments those count that hold repeated keywords, search phrases, bare links or product tags and no
grammar of a sentence.

The model is fitted on the prose segments of all documents. Texts are read once: the class sequences go to the checkpoint
folder, counted within each split, and the trigrams and the ends of the band are made from all of them by Spark. So do
the texts that could be flagged whatever the band (their unwritten segments hold most of their words); those alone are
judged again.

Cases: null and blank texts, and texts of under LEAST_WORDS words (two search phrases are no run), are never flagged; equal texts get
equal answers; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.whole import at_ranks, fold
from quillspark.operators.durable import checkpointed
from quillspark.operators.rows import flat_map

LEAST_WORDS = 8
SHARE = 0.5
AGAIN = 0.45  # a keyword before ever new names repeats every second word
KEPT = 1_000_000  # symbols of sequences counted within a split before they are sent
STANDS_OUT = 0.2  # share of the commonest keyword in segments of a script whose function words aren't all listed; 5 times at least
BAND = 0.01  # prose share beyond either end of the normal band

#: Function words that make sentences: D articles and demonstratives, S pronouns, K conjunctions, V auxiliaries.
FUNCTION = {
    "D": "the a an this that these those every each der die das den dem des ein eine einen einem einer dieser dieses diese jeder jede jedes el la los las un una unos este esta estos cada le les une ce cette ces chaque l il lo gli i uno questo questa ogni het een deze dit elke o os as um uma este esta",
    "S": "it he she they we you i his her their our its my who what nobody er es sie wir ich man ihr sich niemand que quien nadie lo se su sus il elle ils nous vous on qui personne leur son sa si che ne nessuno hij zij ze wij we er men niemand ele ela eles ninguém isso он она они мы вы это никто кто каждая каждый каждое эта этот эти",
    "K": "and but or because while if when so than then although yet und aber oder denn weil wenn doch als obwohl y e pero o porque cuando aunque mientras et mais ou quand tandis parce ma perché quando mentre maar of want omdat als mas porque quando и но а или что потому если когда",
    "V": "is are was were be been has have had do does did will would can not ist sind war waren hat haben hatte wird wurde nicht es son fue era ha han no est sont était a ont n pas è sono era non zijn was heeft is niet é são foi não há",
    "P": "of in on at to for with from by near about after before during von in im am an auf für mit zu zur zum aus bei nach über unter vor ohne de del en con para por sin sobre du des dans pour avec sur sans au aux à di del della al nel con per da van in op met voor bij na do da no na com para por sem в на с со до от по из у за к для о об без после",
}
_GROUP: dict[str, str] = {}
for _k in "PVKSD":
    for _w in FUNCTION[_k].split():
        _GROUP[_w] = _k
_STRONG = frozenset("DSK")

_TOKEN = re.compile(
    r"(?P<link>https?://\S+|www\.\S+|<a\s[^>]*>|\]\([^)\s]*\))|(?P<close></a>|<[^<>]{1,80}>)|(?P<tag>#[^\W_]\w*)"
    r"|(?P<num>[-+]?\d+(?:[.,:]\d+)*%?(?![^\W_]))|(?P<word>[^\W_]+(?:['’-][^\W_]+)*)|(?P<end>[.!?…。！？।؟]+)|(?P<mark>[,;:|/·•>«»\"()\[\]–—*-])"
)
_WIDE = re.compile("[฀-࿿぀-ヿ㐀-鿿가-힯ऀ-෿؀-ۿЀ-ӿ]")
_CODE = re.compile(r"(?=.*\d)(?=.*[^\W\d_])")
_SPLIT = re.compile(r"\n+|(?<=[.!?…])\s+(?=[^\W\da-z_])|(?<=[。！？।؟])")
_PLAIN = re.compile(r"[^\W\d_]+")
_SLUG = re.compile("[^\\W\\d_]{3,}")
_DUTCH = frozenset("het een van voor bij zonder naar deze dit elke enkele tijdens".split())
_CAMEL = re.compile("[A-ZÀ-Þ]?[a-zß-ÿ]+|[A-ZÀ-Þ]+|[0-9]+")


def _parts(kind: str, raw: str) -> list[str]:
    return [x.lower() for x in _CAMEL.findall(raw)] if kind == "tag" else [raw.lower()]


class Segment:
    __slots__ = ("classes", "content", "links", "codes", "tags", "marks", "strong", "words", "wide", "ended_ever", "slugs", "held", "functions")

    def __init__(self, text: str, bound: frozenset[str] | set[str] = frozenset()):
        self.classes: list[str] = []
        self.content: list[str] = []
        self.slugs: list[str] = []
        self.functions: set[str] = set()
        self.held = 0  # strong function words that are bound to one successor
        self.links = self.codes = self.tags = self.marks = self.strong = self.words = self.wide = 0
        self.ended_ever = False
        for m in _TOKEN.finditer(text):
            kind, raw = m.lastgroup, m.group()
            if kind == "link":
                self.links += 1
                self.classes.append("L")
                slug = [w.lower() for w in _SLUG.findall(raw.rstrip("/").rpartition("/")[2])]
                self.words += len(slug)
                self.slugs += slug
            elif kind == "close":
                continue
            elif kind == "tag":
                self.tags += 1
                self.words += 1
                self.classes.append("H")
                self.content += _parts(kind, raw)
            elif kind == "num":
                self.classes.append("N")
            elif kind == "end":
                self.classes.append("E")
                self.ended_ever = True
            elif kind == "mark":
                self.marks += raw in ",|/"
                self.classes.append(raw if raw in ",|:" else "M")
            else:
                self.words += 1
                low = raw.lower()
                g = _GROUP.get(low) or (_GROUP.get(low.split("'")[0].split("’")[0]) if "'" in low or "’" in low else None)
                if g:
                    self.functions.add(low if low in _GROUP else re.split("['’]", low)[0])
                if low in bound:
                    self.held += g in _STRONG if g else 0
                    g = None
                if _WIDE.match(raw) and not g:
                    self.wide += 1
                    self.classes.append("W")
                    self.content.append(low)
                elif g:
                    self.classes.append(g)
                    self.strong += g in _STRONG
                    if g not in _STRONG:
                        self.content.append(low)
                elif _CODE.match(raw):
                    self.codes += 1
                    self.classes.append("#")
                    self.content.append(low)
                else:
                    self.classes.append("C")
                    self.content.append(low)


def trigrams(sequences: Iterable[tuple[str, int]]) -> Counter:
    """Trigrams of (sequence, how often)."""
    out: Counter = Counter()
    for s, n in sequences:
        s = f"<<{s}>"
        for g in zip(s, s[1:], s[2:]):
            out[g] += n
    return out


class Trigram:
    """Interpolated trigram model over classes, from the counts of trigrams."""

    def __init__(self, counted: dict[tuple[str, str, str], int]):
        self.n = [Counter(), Counter(), Counter()]
        self.c = [Counter(), Counter(), Counter()]
        for g, n in counted.items():
            for k in range(3):
                self.n[k][g[2 - k:]] += n
                self.c[k][g[2 - k:2]] += n
        self.kinds = max(20, len(self.n[0]))
        self.memo: dict[tuple[str, str, str], float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        """Surprisal in nats; each order's weight grows with how often its history was seen."""
        got = self.memo.get((a, b, c))
        if got is None:
            p = 1 / self.kinds
            for k, (g, h) in enumerate((((c,), ()), ((b, c), (b,)), ((a, b, c), (a, b)))):
                seen = self.c[k][h]
                w = seen / (seen + 5)
                p = w * (self.n[k][g] / seen if seen else 0) + (1 - w) * p
            got = self.memo[a, b, c] = -math.log(p)
        return got

    def perplexity(self, s: list[str] | str) -> float:
        x = ["<", "<", *s, ">"]
        return math.exp(sum(self.cost(x[i - 2], x[i - 1], x[i]) for i in range(2, len(x))) / (len(x) - 2))


def bound_words(text: str) -> set[str]:
    """Function words that this document uses as part of a keyword: nearly always before the same word."""
    after: dict[str, Counter] = {}
    words = _PLAIN.findall(text.lower())
    for a, b in zip(words, words[1:]):
        if a in _GROUP:
            after.setdefault(a, Counter())[b] += 1
    bound = {a for a, c in after.items() if (n := sum(c.values())) >= 3 and c.most_common(1)[0][1] >= 0.7 * n}
    # sentences said again and again bind many function words, keywords one or two
    return bound if sum(_GROUP[a] in _STRONG for a in bound) <= 2 else set()


def segments(text: str | None) -> list[Segment]:
    bound = bound_words(text or "")
    return [s for x in _SPLIT.split(text or "") if (s := Segment(x, bound)).classes]


def keyed(found: list[Segment]) -> Counter:
    """Content words by how often they occur; a repeated one becomes class R in its segment's sequence."""
    return Counter(w for s in found for w in s.content)


def sequence(s: Segment, often: Counter, least: int) -> list[str]:
    """The segment's classes, its repeated content words as R."""
    out, at = [], 0
    for c in s.classes:
        if c in "CWPV#":
            word = s.content[at]
            at += 1
            out.append("R" if c in "CW" and often[word] >= least else c)
        else:
            if c == "H":
                return s.classes
            out.append(c)
    return out


def prose(found: list[Segment]) -> Iterator[str]:
    """Sequences of the segments that the model is fitted on."""
    often = keyed(found)
    least = max(4, sum(often.values()) // 20)
    for s in found:
        if s.classes[-1] == "E" and s.strong >= 1 and len(q := sequence(s, often, least)) >= 5:
            yield "".join(q)  # a class is one character


def ends(n: int) -> list[int]:
    """Places of the band's ends among n sorted perplexities."""
    return [int(n * BAND), min(n - 1, int(n * (1 - BAND)))]


class Model:
    def __init__(self, texts: Iterable[str] = ()):
        found = Counter(q for t in texts for q in prose(segments(t)))
        self.trigram = Trigram(trigrams(found.items()))
        scores = sorted(self.trigram.perplexity(q) for q in found.elements())
        self.low, self.high = (scores[i] for i in ends(len(scores))) if scores else (0.0, math.inf)

    def judge(self, text: str | None) -> tuple[float, float, bool]:
        """(share of words in segments of abnormal perplexity, share in keyword segments, spam)."""
        found = [s for s in segments(text) if s.words]
        total = sum(s.words for s in found)
        if total < LEAST_WORDS:
            return 0.0, 0.0, False
        often = keyed(found)
        least = max(4, sum(often.values()) // 20)
        odd = [s for s in found if not self.low <= self.trigram.perplexity(sequence(s, often, least)) <= self.high]
        share = sum(s.words for s in odd) / total
        if share <= SHARE:
            return share, 0.0, False
        bad = keyword_words(unwritten_of(odd, found), often) / total
        return share, bad, bad > SHARE

    def is_spam(self, text: str | None) -> bool:
        return self.judge(text)[2]


def unwritten_of(some: list[Segment], found: list[Segment]) -> list[Segment]:
    """The unwritten among some of a document's segments."""
    dutch = sum(len(_DUTCH & s.functions) + len(_DUTCH.intersection(s.content)) for s in found) >= 2  # "de" is then an article
    return [s for s in some if unwritten(s, s.strong + (s.content.count("de") if dutch else 0))]


def possible(found: list[Segment]) -> bool:
    """Whether any band could make a document of these segments spam: judge() flags none without."""
    total = sum(s.words for s in found)
    return total >= LEAST_WORDS and sum(s.words for s in unwritten_of([s for s in found if s.words], found)) > SHARE * total


def unwritten(s: Segment, strong: int) -> bool:
    """Whether a segment lacks the function words of a sentence, or is made of tags or bare links."""
    if s.tags >= 2 and s.tags * 2 >= s.words:
        return True
    if s.classes[-2:] == ["E", "N"]:
        return False  # a line of contents: leaders and a page
    if s.wide:
        return strong == 0 or s.ended_ever and not s.links
    if s.ended_ever and not s.links:
        return strong == 0 and not (s.held and (len(s.functions) >= 2 or s.words >= 9))
    if (strong + s.held) * 20 >= s.words and sum(_GROUP[w] in _STRONG for w in s.functions) >= 2:
        return False  # a text without stops; keywords hold one strong function word at most
    return strong * 7 < s.words


def keyword_words(suspects: list[Segment], often: Counter) -> int:
    """Exact check: words of the unwritten segments that stand in repeated keywords, bare links, tags or product codes.

    Lists that serve a reader name different things (their words hardly repeat), so they count for nothing.
    """
    bare = [s for s in suspects if s.links or s.tags]
    rest = [s for s in suspects if not (s.links or s.tags)]
    count = sum(s.words for s in bare)
    if any(s.wide for s in rest):  # no list of function words is whole there: one keyword must stand out
        named = Counter(w for s in rest for w in s.content)
        if max(named.values()) < max(5, STANDS_OUT * sum(named.values())):
            rest = [s for s in rest if not (s.wide and s.ended_ever)]
    real = [w for s in rest for w in s.content if len(w) > 2 or w in _GROUP]
    again = sum(often[w] >= 2 for w in real)
    if real and again >= AGAIN * len(real) and max((often[w] for w in real), default=0) >= 3:
        count += sum(s.words for s in rest)
    return count


def _read(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sequence, n) of the prose of all documents, and (id, text) of those that could be spam; texts are read once."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        counted: Counter = Counter()
        size = 0
        for key, text in rows:
            found = segments(text)
            for q in prose(found):
                counted[q] += 1
                size += len(q)
            if possible(found):
                yield key, text, None, None
            if size >= KEPT:
                yield from ((None, None, q, n) for q, n in counted.items())
                counted.clear()
                size = 0
        yield from ((None, None, q, n) for q, n in counted.items())

    return checkpointed(fold(df, [id_col, text_col], run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string, sequence string, n long"))


def _fit(read: DataFrame) -> Model:
    found = read.where("sequence is not null")
    sc = read.sparkSession.sparkContext

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        return (("".join(g), n) for g, n in trigrams(rows).items())

    model = Model()
    model.trigram = Trigram({tuple(g): n for g, n in fold(found, ["sequence", "n"], count, "gram string, n long").groupBy("gram").agg(F.sum("n")).collect()})
    sent = sc.broadcast(model.trigram)

    def score(rows: Iterator[tuple]) -> Iterator[tuple]:
        t = sent.value
        return (("", t.perplexity(q), n) for q, n in rows)

    for low, high in at_ranks(fold(found, ["sequence", "n"], score, "key string, value double, n long"), ends).values():
        model.low, model.high = low, high
    return model


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The prose model, from all documents."""
    return _fit(_read(df, id_col, text_col))


def find_spam(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text of the spam by the model of the same documents, whose texts are read once for both."""
    read = _read(df, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(_fit(read))

    def make() -> Callable[..., list[tuple]]:
        m = sent.value
        return lambda key, text: [(key, text)] if m.is_spam(text) else []

    return flat_map(read.where("sequence is null"), [id_col, "text"], make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string")


def score_pages(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: abnormal_share, keyword_share, is_spam."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[..., list[tuple]]:
        m = sent.value
        return lambda k, text: [(k, *m.judge(text))]

    return flat_map(df, [id_col, text_col], make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, abnormal_share double, keyword_share double, is_spam boolean")
