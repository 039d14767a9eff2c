"""Mixing sources to target shares of the tokens.

Every document gets a membership vector over the listed sources and "other": the posterior of a naive Bayes
classifier over its words, fitted on a bounded sample of labelled rows (SAMPLE a source) and tempered so that it is
honest on held-out rows (where words say nothing of the source it is the prior), joined with its label, which is trusted with
weight TRUST where there is one. Rates (expected copies, from 0 to the cap of the likeliest source) are fitted by
projected-gradient least squares, so that the expected tokens of each source match its share of the budget. Rows with the
same membership move alike, so they are summed into cells before the fit; every step is a distributed aggregate to one
number a source. Copies are drawn by a hash of the id, so a rerun draws the same; the chances of a source's fractional
copies are scaled so that its drawn tokens fit its share, from one histogram a source.

The budget is the largest at which all sources that have documents can reach their share within their caps, unless one is
given; a source without documents gets nothing, and the others keep their proportions. The report has the actual shares, the
tokens that carry the source as label, those that were given to it by posterior alone, the share that the soft memberships
expect, and the classifier's accuracy on held-out rows.

Cases: null and empty texts have no tokens and are never drawn; a null source counts by its posterior and is drawn only where that
names a listed source before other, an unlisted one is other; repeated target names keep the first by cap; without targets or
documents the result is empty.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import sample as samples
from quillspark.operators.durable import checkpointed
from quillspark.operators.rows import flat_map

SAMPLE = 400
TRUST = 0.98
GRID = 256  # memberships are rounded to 1/GRID
TEMPERS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0)
BINS = 2048  # of the histogram of the chances at which a fractional copy is drawn, from 0 to twice the fitted chance
STEPS = 40
MOST_SOURCES = 1000
BUCKETS = 1 << 15
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splitting pattern of the public byte-level vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WORD = re.compile(r"[^\W\d_]+")


def counter(path: str) -> Callable[[str], int]:
    """Token counter of a vocabulary of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def _features(text: str) -> list[int]:
    return [hash_word(w) for w in {x[:12] for x in _WORD.findall(text.lower())}]


def hash_word(w: str) -> int:
    return xxhash.xxh32_intdigest(w) % BUCKETS


class Bayes:
    """Naive Bayes over hashed words; the last class is other. A quarter of the rows chooses the temper and is then fitted, too."""

    def __init__(self, names: list[str], rows: list[tuple[str | None, str]], sizes: dict[str | None, int] | None = None):
        self.names = names
        self.at = {s: i for i, s in enumerate(names)}
        k = len(names) + 1
        known = [(self.at.get(source, k - 1), _features(text)) for source, text in rows]
        sizes = sizes or {}
        n = np.zeros(k)
        for source, size in (sizes or {None: 1}).items():
            n[self.at.get(source, k - 1)] += size
        if not sizes:
            n = np.bincount([i for i, _ in known], minlength=k).astype(float)
        self.prior = n / n.sum() if n.sum() else np.full(k, 1 / k)
        held = known[::4] if len(known) >= 40 else []
        self.temper, self.accuracy = 0.0, None
        if held:
            self._fit([r for i, r in enumerate(known) if i % 4], k)
            share = np.bincount([i for i, _ in held], minlength=k)
            weight = np.array([self.prior[i] / share[i] for i, _ in held])  # the sample has as many rows of a rare source as of a common one
            best = -np.inf
            for self.temper in TEMPERS:
                p = np.array([self.posterior(f) for _, f in held])
                own = p[np.arange(len(held)), [i for i, _ in held]]
                fits = float((weight * np.log(np.maximum(own, 1e-9))).sum())
                if fits > best:
                    best, chosen = fits, self.temper
                    self.accuracy = float((weight * (p.argmax(1) == [i for i, _ in held])).sum() / weight.sum())
            self.temper = chosen
        self._fit(known, k)

    def _fit(self, known: list[tuple[int, list[int]]], k: int) -> None:
        n = np.full((k, BUCKETS), 0.2)
        docs = np.ones(k)
        for i, f in known:
            docs[i] += 1
            n[i, f] += 1
        self.log = np.log(n / (docs[:, None] + 0.4)).T.astype(np.float32).copy()

    def posterior(self, f: list[int]) -> np.ndarray:
        with np.errstate(divide="ignore"):
            x = np.log(self.prior)  # a source without rows gets no posterior
        if f and self.temper:
            x = x + self.temper * self.log[f].sum(0).astype(np.float64) / math.sqrt(len(f))  # words of a text are far from independent
        p = np.exp(x - x.max())
        return p / p.sum()

    def membership(self, source: str | None, text: str) -> list[float]:
        p = self.posterior(_features(text) if self.temper else [])
        if source is not None:
            p = (1 - TRUST) * p
            p[self.at.get(source, len(self.names))] += TRUST
        q = np.round(p * GRID)
        q[p.argmax()] += GRID - q.sum()
        return (q / GRID).tolist()


def fit(df: DataFrame, names: list[str], id_col: str, text_col: str, source_col: str, sample: int = SAMPLE) -> Bayes:
    label = F.when(F.col(source_col).isin(*names), F.col(source_col)).when(F.col(source_col).isNotNull(), F.lit(""))
    got, sizes = samples.labelled(df, label, id_col, text_col, sample)
    return Bayes(names, [(k or None, t) for k in sorted(got) for t in got[k]], {k or None: n for k, n in sizes.items()})


def weigh(df: DataFrame, model: Bayes, id_col: str, text_col: str, source_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens and membership of every document."""
    sc = df.sparkSession.sparkContext
    sent = sc.broadcast(model)
    sc.addFile(vocabulary)  # executors get the file from the driver
    name = os.path.basename(vocabulary)

    def make() -> Callable[..., list[tuple]]:
        count, m = counter(SparkFiles.get(name)), sent.value

        def rows(key, source, text):  # noqa: ANN001, ANN202
            return [(key, source, count(text), m.membership(source, text))] if text else []

        return rows

    key = df.schema[id_col].dataType.simpleString()
    return flat_map(df, [id_col, source_col, text_col], make, f"`{id_col}` {key}, source string, tokens bigint, membership array<double>")


def _dot(weights: list[float]) -> Column:
    return sum((F.element_at("membership", i + 1) * F.lit(float(w)) for i, w in enumerate(weights)), F.lit(0.0))


def draw(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(drawn documents with copies, report by source). Targets: source_name, target_share, max_repeats."""
    listed = targets.where("source_name is not null and target_share > 0").orderBy("source_name", "max_repeats").take(MOST_SOURCES + 1)
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} target sources")
    wanted = {r["source_name"]: r for r in reversed(listed)}
    names = sorted(wanted)
    k = len(names)
    if not k:
        key = df.schema[id_col].dataType.simpleString()
        empty = df.sparkSession.createDataFrame
        columns = "documents bigint, copies bigint, tokens bigint, own_tokens bigint, guessed_tokens bigint, most_copies int, actual_share double, expected_share double, held_out_accuracy double"
        return empty([], f"`{id_col}` {key}, source string, tokens bigint, copies int"), empty([], f"source_name string, target_share double, max_repeats int, {columns}")
    model = fit(df, names, id_col, text_col, source_col)
    weighed = checkpointed(weigh(df, model, id_col, text_col, source_col, vocabulary))
    caps = [int(wanted[s]["max_repeats"] or 1) for s in names] + [0]
    top = F.array_position("membership", F.array_max("membership")).cast("int")
    cap = F.element_at(F.array(*map(F.lit, caps)), top).cast("double")
    cells = checkpointed(weighed.where("tokens > 0").groupBy("membership").agg(F.sum("tokens").cast("double").alias("tokens")).withColumn("cap", cap))

    def totals(state: DataFrame) -> list[float]:
        row = state.agg(*(F.coalesce(F.sum(F.col("tokens") * F.col("rate") * F.element_at("membership", i + 1)), F.lit(0.0)) for i in range(k))).first()
        return [float(x) for x in row]

    most = totals(cells.withColumn("rate", F.col("cap")))
    share = [float(wanted[s]["target_share"]) if most[i] > 0 else 0.0 for i, s in enumerate(names)]
    whole = sum(share) or 1.0
    share = [x / whole for x in share]
    if budget is None:
        budget = min((most[i] / share[i] for i in range(k) if share[i] > 0), default=0.0)
    goal = [budget * x for x in share]
    # each source's step is scaled by what it can give; a step undoes a source's error at once where memberships don't overlap
    state = cells.withColumn("rate", F.least(_dot([goal[i] / most[i] * caps[i] if most[i] else 0.0 for i in range(k)]), F.col("cap")))
    last = math.inf
    for step in range(1, STEPS + 1):
        now = totals(state)
        error = [(now[i] - goal[i]) / most[i] if most[i] else 0.0 for i in range(k)]
        loss = sum(e * e for e in error)
        if loss < 1e-10 or loss > last * 0.98:
            break
        last = loss
        state = state.withColumn("rate", F.greatest(F.lit(0.0), F.least(F.col("rate") - _dot([e * c for e, c in zip(error, caps)]), F.col("cap"))))
        if step % 4 == 0:
            state = checkpointed(state)
    rates = state.select("membership", "rate")
    belongs = F.coalesce(F.when(F.col("source").isin(*names), F.col("source")), F.element_at(F.array(*map(F.lit, [*names, "other"])), top))
    coin = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    rated = weighed.where("tokens > 0").join(rates, "membership").withColumns({"_k": belongs, "_whole": F.floor("rate"), "_rest": F.col("rate") - F.floor("rate"), "_coin": coin})
    # the coins' luck is taken out: a fractional copy is drawn from a multiple of its chance on (coin over chance), and each source's
    # multiple is set where its drawn tokens come nearest to its goal
    from_ = F.least(F.floor(F.col("_coin") / F.col("_rest") * F.lit(BINS / 2)), F.lit(BINS)).cast("int")
    counted = rated.where(F.col("_k").isin(*names)).select("_k", (F.col("tokens") * F.col("_whole")).alias("sure"), F.when(F.col("_rest") > 0, from_).otherwise(F.lit(BINS)).alias("bin"), "tokens")
    bins: dict[str, np.ndarray] = {s: np.zeros(BINS + 1) for s in names}
    sure = dict.fromkeys(names, 0.0)
    for r in counted.groupBy("_k", "bin").agg(F.sum("sure").alias("sure"), F.sum("tokens").alias("tokens")).collect():  # BINS rows a listed source at most
        sure[r["_k"]] += float(r["sure"] or 0)
        bins[r["_k"]][r["bin"]] = float(r["tokens"])
    scale = {}
    for i, name in enumerate(names):
        drawn_at = sure[name] + np.concatenate([[0.0], np.cumsum(bins[name][:BINS])])
        scale[name] = int(np.abs(drawn_at - goal[i]).argmin())
    own = F.element_at(F.create_map(*(F.lit(v) for kv in scale.items() for v in kv)), F.col("_k"))
    again = F.when(F.col("_rest") > 0, from_ < F.coalesce(own, F.lit(BINS // 2))).otherwise(F.lit(False))
    drawn = rated.withColumn("copies", (F.col("_whole") + again.cast("int")).cast("int")).where("copies > 0")
    by = drawn.groupBy(F.col("_k").alias("source_name")).agg(
        F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"),
        F.sum(F.when(F.col("source").isNotNull(), F.col("tokens") * F.col("copies")).otherwise(F.lit(0))).alias("own_tokens"), F.max("copies").alias("most_copies"),
    )
    by = by.withColumn("_all", F.sum("tokens").over(Window.partitionBy()))  # one row a listed source
    soft = totals(state)
    expected = F.element_at(F.create_map(*(F.lit(x) for s, v in zip(names, soft) for x in (s, v / (sum(soft) or 1.0)))), F.col("source_name"))
    report = targets.join(by, "source_name", "left").select(
        "source_name", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "tokens", "own_tokens")),
        F.coalesce(F.col("tokens") - F.col("own_tokens"), F.lit(0)).alias("guessed_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share"), F.coalesce(expected, F.lit(0.0)).alias("expected_share"),
        F.lit(model.accuracy).cast("double").alias("held_out_accuracy"),
    )
    return drawn.select(id_col, "source", "tokens", "copies"), report
