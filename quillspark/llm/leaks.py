"""Evaluation passages inside a training corpus.

The normalised word n-grams of the test items form a set of sorted 64-bit hashes; every document's token windows are looked
up in it, and a hit is verified by aligning the words of document and item around it. One narrow pass over the corpus, no
shuffle: the set is sent to the executors in blocks of at most BLOCK_NGRAMS n-grams (16 bytes each, and the items' words), so
what is broadcast is bounded whatever the number of items; beyond one block the corpus is scanned once a block.

n = 6 misses no run: of 20 words with at most 2 changed or put in, 6 at least stand unbroken. The alignment looks six words
ahead at each error; where more than four errors stand so close that it gives up, the longer side of the run is found by itself.

Cases: null or empty texts and items give no rows; a pair is reported once, however often the passage occurs;
repeated documents are each reported; items shorter than the least run can't leak; ties don't occur.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.rows import flat_map

N = 6
LEAST = 20
ERRORS = 10  # one word in ten
BLOCK_NGRAMS = 8_000_000

_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]{0,300}>|<!--.*?-->|&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z]{2,10});|(?<=\])\([^()\s]*\)|(?<=[^\W_])[*_~`]{1,3}(?=[^\W_])", re.S)
_WORD = re.compile(r"[^\W_](?:[^\W_]|[­​-‍]|[-­][ \t]*\r?\n[ \t]*(?=[a-zß-ÿ]))*")
_JOIN = re.compile(r"[­​-‍\s-]+")


def _plain(word: str) -> str:
    word = word.lower()
    if word.isascii() and word.isalnum():
        return word
    word = _JOIN.sub("", word).replace("ß", "ss")
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def tokens(text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words and their character spans in the text."""
    text = text or ""
    if "<" in text or "&" in text or "](" in text or "*" in text or "`" in text or "~" in text or "_" in text:
        text = _TAG.sub(lambda m: ("​" if m.group()[0] in "*_~`" else " ") * len(m.group()), text)
    found = [*_WORD.finditer(text)]
    return [_plain(m.group()) for m in found], [m.span() for m in found]


def words(text: str | None) -> list[str]:
    return tokens(text)[0]


def _extend(d: list[str], t: list[str], i: int, j: int, step: int) -> list[tuple[str, int, int]]:
    """Operations from document word i and item word j on in one direction: M same, S changed, I put in, D left out."""
    out = []
    nd, nt = len(d), len(t)
    wrong = same = 0
    at = lambda x, y: 0 <= x < nd and 0 <= y < nt and d[x] == t[y]
    while 0 <= i < nd and 0 <= j < nt:
        if d[i] == t[j]:
            out.append(("M", i, j))
            i, j, same = i + step, j + step, same + 1
            wrong = max(0, wrong - (same % 4 == 0))
            continue
        wrong, same = wrong + 1, 0
        if wrong > 4:
            break
        ways = []
        for rank, (kind, di, dj) in enumerate((("S", 1, 1), ("I", 1, 0), ("D", 0, 1), ("SI", 2, 1), ("II", 2, 0), ("SS", 2, 2))):
            x, y = i + step * di, j + step * dj
            ahead = 0
            while ahead < 6 and at(x + step * ahead, y + step * ahead):
                ahead += 1
            ways.append((ahead, -rank, kind, di, dj))
        ahead, _, kind, di, dj = max(ways)
        if not ahead:
            kind, di, dj = "S", 1, 1
        x, y = i, j
        for k in kind:
            out.append((k, x, y))
            x, y = x + step * (k != "D"), y + step * (k != "I")
        i, j = x, y
    return out


def best_run(d: list[str], t: list[str], i: int, j: int) -> tuple[int, int, int] | None:
    """(item words, first, last document word) of the longest allowed run through a seed, or None."""
    path = _extend(d, t, i - 1, j - 1, -1)[::-1] + _extend(d, t, i, j, 1)
    best = None
    for a, (kind, *_) in enumerate(path):
        if kind != "M":
            continue
        if best and len(path) - a <= best[0]:
            break
        item = wrong = 0
        for b in range(a, len(path)):
            k = path[b][0]
            item += k != "I"
            wrong += k != "M"
            if k == "M" and item >= LEAST and wrong * ERRORS <= item and (best is None or item > best[0]):
                best = (item, path[a][1], path[b][1])
    return best


_WORD_HASH = lru_cache(200_000)(xxhash.xxh64_intdigest)
_STEPS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(N)], np.uint64)  # odd, so no word's hash is lost


def gram_hashes(w: list[str]) -> np.ndarray:
    """64-bit hashes of the n-grams of a list of words."""
    h = np.fromiter(map(_WORD_HASH, w), np.uint64, len(w))
    n = len(h) - N + 1
    return sum((h[k:k + n] * _STEPS[k] for k in range(N)), np.zeros(n, np.uint64)) if n > 0 else h[:0]


class Index:
    """Hashed n-grams of some test items in order of the hash, 16 bytes each, and the items' words for the verification.

    It is built once on the driver; a worker loads the arrays once, whatever the number of its tasks.
    """

    def __init__(self, items: list[tuple[int, str | None]]):
        found = [(k, w) for k, text in items if len(w := words(text)) >= LEAST]
        self.ids = [k for k, _ in found]
        self.text = [" ".join(w) for _, w in found]
        parts = [gram_hashes(w) for _, w in found]
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])[order]
        self.place = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts])[order] if parts else np.zeros(0, np.int32)

    def scan(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """Item to (item words, first, end character) of its longest verified run."""
        w, spans = tokens(text)
        out: dict[int, tuple[int, int, int]] = {}
        if not len(self.hashes) or len(w) < N:
            return out
        grams = gram_hashes(w)
        low = np.searchsorted(self.hashes, grams)
        near = np.minimum(low, len(self.hashes) - 1)
        hits = np.nonzero(self.hashes[near] == grams)[0]
        if not len(hits):
            return out
        high = np.searchsorted(self.hashes, grams[hits], "right")
        done: dict[tuple[int, int], int] = {}
        said: dict[int, list[str]] = {}
        for i, a, b in zip(hits.tolist(), low[hits].tolist(), high.tolist()):
            for at in range(a, b):
                k, j = int(self.item[at]), int(self.place[at])
                if done.get((k, i - j), -1) >= i:
                    continue
                if k not in said:
                    said[k] = self.text[k].split(" ")
                run = best_run(w, said[k], i, j)
                done[k, i - j] = run[2] if run else i
                item = self.ids[k]
                if run and (item not in out or run[0] > out[item][0]):
                    out[item] = (run[0], spans[run[1]][0], spans[run[2]][1])
        return out


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of at most BLOCK_NGRAMS n-grams; read from the driver's iterator, one partition at a time."""
    block, size = [], 0
    for r in items.select(item_col, text_col).orderBy(item_col).toLocalIterator():
        n = len(words(r[1]))
        if size + n > BLOCK_NGRAMS and block:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and leaked item: run_words, start_char, end_char of its longest run."""
    spark = df.sparkSession
    key, item = df.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {key}, `{item_col}` {item}, run_words int, start_char int, end_char int"

    def scan(block: list[tuple[int, str | None]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(Index(block))

        def make() -> Callable[..., list[tuple]]:
            index = sent.value
            return lambda k, text: [(k, i, *run) for i, run in index.scan(text).items()]

        return flat_map(df, [id_col, text_col], make, schema)

    parts = [scan(b) for b in _blocks(items, item_col, item_text)]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def remove_leaks(df: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The corpus with the leaked spans cut out of the texts; documents without a leak pass unchanged."""
    cuts = leaks.groupBy(id_col).agg(F.sort_array(F.collect_set(F.struct("start_char", "end_char"))).alias("_cuts"))
    kept = F.aggregate(
        "_cuts",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, c: F.when(c["end_char"] <= acc["at"], acc).otherwise(
            F.struct(
                F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.greatest(c["start_char"] - acc["at"], F.lit(0)))).alias("out"),
                c["end_char"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))),
    )
    return df.join(cuts, id_col, "left").withColumn(text_col, F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(kept)).drop("_cuts")
