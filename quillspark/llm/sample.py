"""Bounded samples of rows to fit models on.

The rows are those whose hashed ids lie under a threshold, so each split sends only what it holds of the sample and nothing
is sorted whole. Of a text over PASSAGE characters the sample holds one passage, begun at a place its hash gives: that
bounds what the driver holds, and no text is left out for its length. Scores, counts and searches read whole texts.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 20_000  # characters of a sampled text
LABELLED = 20_000  # rows of all labels together
LABELLED_PASSAGE = 4_000


def _under(h: str, share: float) -> Column:
    return F.col(h) <= int(-(2**63) + min(share * 2**64, 2**64 - 1))


def _passage(text: str, size: int) -> Column:
    length = F.length(text)
    return F.when(length <= size, F.col(text)).otherwise(F.substring(text, (1 + F.pmod(F.col("_h"), length - size)).cast("int"), F.lit(size)))


def texts(df: DataFrame, id_col: str, text_col: str, rows: int, passage: int = PASSAGE) -> list[str]:
    """At most `rows` texts, those of least hashed id; equal inputs give equal samples."""
    n = df.where(F.col(text_col).isNotNull()).count()
    if not n:
        return []
    some = df.select(F.xxhash64(id_col).alias("_h"), F.col(text_col).alias("_t")).where(F.col("_t").isNotNull() & _under("_h", 1.3 * rows / n))
    return [r[0] for r in some.select("_h", _passage("_t", passage).alias("_t")).orderBy("_h", "_t").select("_t").limit(rows).collect()]


def labelled(df: DataFrame, label: Column, id_col: str, text_col: str, rows: int, passage: int = LABELLED_PASSAGE) -> tuple[dict[str, list[str]], dict[str, int]]:
    """(at most `rows` texts of each label, fewer where the labels are so many that they would be over LABELLED in all; sizes of the labels)."""
    known = df.select(label.alias("_k"), F.xxhash64(id_col).alias("_h"), F.col(text_col).alias("_t")).where("_k is not null and _t is not null")
    sizes = {r[0]: r[1] for r in known.groupBy("_k").count().collect()}  # one row a label
    if not sizes:
        return {}, {}
    rows = max(1, min(rows, LABELLED // len(sizes)))
    share = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, int(-(2**63) + min(1.3 * rows / n * 2**64, 2**64 - 1)))))
    some = known.where(F.col("_h") <= F.element_at(share, F.col("_k"))).select("_k", "_h", _passage("_t", passage).alias("_t"))
    got: dict[str, list[str]] = defaultdict(list)
    for r in some.orderBy("_h", "_t").limit(2 * rows * len(sizes)).collect():
        if len(got[r[0]]) < rows:
            got[r[0]].append(r[2])
    return dict(got), sizes
