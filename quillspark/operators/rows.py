"""Arrow-batched row functions: the one bridge from DataFrames to Python kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quillspark import shipping


def flat_map(df: DataFrame, columns: list[Column | str], make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Rows that fn = make() yields for each row's columns; fn is made once a partition.

    Only the named columns leave the JVM, in Arrow batches; there is no shuffle. Output batches are cut at 4,096
    rows, so a row that yields many never fills memory.
    """
    shipping.ensure(df.sparkSession)
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out.extend(fn(*row))
                if len(out) >= 4096:
                    yield batch()
                    out = []
        if out:
            yield batch()

    picked = [(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(columns)]
    return df.select(*picked).mapInArrow(run, kind)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores.

    Only an input of fewer splits than cores is moved, which is less than one split a core; larger inputs keep their splits
    and see no shuffle.
    """
    sc = df.sparkSession.sparkContext
    return df.repartition(sc.defaultParallelism) if df.rdd.getNumPartitions() < sc.defaultParallelism else df
