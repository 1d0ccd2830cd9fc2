"""Streams: micro-batches as documents, and run lengths and deltas with state carried from batch to batch.

Order within a key is that of the column given; rows that arrive after later ones have been emitted start from the carried state, so use a
watermark and keys whose events arrive in order, or encode_batches, whose blocks stand alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framepack.sources.writer import encoded_lines


def encode_batches(stream: DataFrame, path: str, order_by: Sequence[str], checkpoint: str, name: str = "rows", mode: str = "stream", **trigger: Any):
    """Starts a query that writes each micro-batch as a document of its own under path/batch=N; a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        lines = encoded_lines(batch, order_by, name, mode)
        lines.repartition(1).sortWithinPartitions("ord").select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def running_deltas(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, value, delta): the difference from the key's previous value, across batches; null for the key's first."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, order, value)}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(order)
        before = rows[value].shift(1)
        if last is not None:
            before.iloc[0] = last
        state.update((float(rows[value].iloc[-1]),))
        yield pd.DataFrame({key: k[0], order: rows[order], value: rows[value], "delta": rows[value] - before})

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}, delta double", "last double", "append", GroupStateTimeout.NoTimeout)


def closed_runs(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, run, value, length) of the runs of equal values that have ended; a key's last run stays open in the state."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, held, n = state.get if state.exists else (0, None, 0)
        out = []
        for v in pd.concat(list(parts)).sort_values(order)[value].astype("string"):
            v = None if pd.isna(v) else v
            if n and v == held:
                n += 1
                continue
            if n:
                out.append((k[0], run, held, n))
                run += 1
            held, n = v, 1
        state.update((run, held, n))
        yield pd.DataFrame(out, columns=[key, "run", "value", "length"])

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, run long, value string, length long", "run long, value string, length long", "append", GroupStateTimeout.NoTimeout)


def windowed_stats(stream: DataFrame, time: str, value: str, width: str, late: str, *keys: str) -> DataFrame:
    """Count, sum, min and max of a value per window of event time and keys; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
