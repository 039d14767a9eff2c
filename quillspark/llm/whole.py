"""Counts over every row of a table: sums kept a partition by a kernel, added up by Spark."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quillspark import shipping
from quillspark.operators.durable import checkpointed


def fold(df: DataFrame, columns: list[Column | str], run: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that run yields from a partition's rows; it sees all of them, so it can send sums instead of rows."""
    shipping.ensure(df.sparkSession)
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in run(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))):
            out.append(row)
            if len(out) >= 4096:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    picked = [(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(columns)]
    return df.select(*picked).mapInArrow(go, kind)


def at_ranks(df: DataFrame, ranks: Callable[[int], list[int]]) -> dict[str, list[float]]:
    """Of every key the values at the places ranks(rows of the key) of its sorted rows; df is (key string, value double, n long).

    Values are ordered in ranges, so no task and not the driver holds a key's rows.
    """
    by = df.groupBy("key", "value").agg(F.sum("n").alias("n")).repartitionByRange("key", "value").sortWithinPartitions("key", "value")
    by = checkpointed(by).withColumn("part", F.spark_partition_id())
    sums: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for k, part, n in sorted(by.groupBy("key", "part").agg(F.sum("n")).collect()):
        sums[k].append((part, n))
    sought: dict[tuple[str, int], list[tuple[int, int]]] = defaultdict(list)  # (place in the answer, rank in the range)
    for k, own in sums.items():
        for at, r in enumerate(ranks(sum(n for _, n in own))):
            for part, n in own:
                if r < n:
                    sought[k, part].append((at, r))
                    break
                r -= n
    sent = df.sparkSession.sparkContext.broadcast(dict(sought))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (k, part), own in groupby(rows, lambda r: (r[0], r[1])):
            left, end = sorted(sent.value.get((k, part), []), key=lambda x: -x[1]), 0
            for _, _, value, n in own:
                end += n
                while left and left[-1][1] < end:
                    yield k, left.pop()[0], value

    got: dict[str, dict[int, float]] = defaultdict(dict)
    for k, at, value in fold(by, ["key", "part", "value", "n"], run, "key string, at int, value double").collect():
        got[k][at] = value
    return {k: [v[i] for i in range(len(v))] for k, v in got.items()}
