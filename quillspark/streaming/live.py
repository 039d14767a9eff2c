"""The stateless operators on streams, and the three stateful ones a service needs: watermarked de-duplication, windowed
counts and a cache with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators import analyze, readability


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Each new non-blank line of a folder of text files is a document."""
    lines = spark.readStream.format("text").load(folder)
    return lines.where(F.trim("value") != "").select(F.sha2("value", 256).alias("id"), F.col("value").alias("text"))


def score_stream(documents: DataFrame, lang: str = "auto", metrics: list[str] | None = None) -> DataFrame:
    """Metric rows of a stream of documents; no state, append mode."""
    return readability.scores(analyze.analyze(documents, "text", lang), metrics)


def first_seen(requests: DataFrame, keys: list[str], time_col: str, delay: str = "1 hour") -> DataFrame:
    """Requests without repeats inside the watermark; state is dropped as it passes."""
    return requests.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, time_col: str, key: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts and sums per window and key, late rows up to the delay."""
    return events.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), key).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events", "total")


def cached(requests: DataFrame, ttl_seconds: int, key: str = "key", payload: str = "payload") -> DataFrame:
    """Hit or miss of each request; a key's payload lives ttl_seconds after it was last put, however often it is asked for.

    Only a put sets the time to live; a request that finds the time over is a miss, whether the state was cleared yet or not.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        kept, until = state.get if state.exists else (None, 0)
        if until <= now:
            kept = None
        for b in batches:
            out = []
            for p in b[payload]:
                hit = kept is not None and p is None
                if p is not None:
                    kept, until = p, now + ttl_seconds * 1000
                out.append((k[0], kept, hit))
            yield pd.DataFrame(out, columns=["key", "payload", "hit"])
        if kept is not None:
            state.update((kept, until))
            state.setTimeoutDuration(max(1, until - now))
        elif state.exists:
            state.remove()

    return requests.groupBy(key).applyInPandasWithState(step, "key string, payload string, hit boolean", "payload string, until bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def to_sink(results: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Each micro-batch appended once as JSON lines."""
    return results.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


