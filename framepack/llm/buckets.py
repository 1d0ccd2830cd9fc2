"""Buckets of an index, handed to vectorised code in bounded blocks.

A bucket with more members than a block holds is dealt into blocks by the members' hash; every pair of blocks is a group of its own, so each
pair of members meets in exactly one group and no group outgrows two blocks, whatever the data. Groups are sorted within their partition and
read as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members in a block.
BLOCK = 1024


def dealt(members: DataFrame, sizes: DataFrame | None, member: str, block: int = BLOCK) -> DataFrame:
    """members(key, ...) with columns bi, bj (the pair of blocks) and b (the row's own block); sizes(key, n) has the buckets over `block`."""
    if sizes is None:
        return members.withColumns({c: F.lit(0) for c in ("bi", "bj", "b")})
    blocks = sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    out = members.join(blocks, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    out = out.withColumn("b", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumns({"bi": F.least("b", "other"), "bj": F.greatest("b", "other")}).drop("blocks", "other")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with each group's first row and, last, the number of rows. Rows come sorted by key, bi, bj."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        starts = _starts(table)
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1])), starts
            table = table.slice(int(starts[-1]))
        held = table
    if held is not None and held.num_rows:
        yield held, np.append(_starts(held), held.num_rows)


def _starts(table: pa.Table) -> np.ndarray:
    change = np.zeros(table.num_rows, dtype=bool)
    change[:1] = True
    for name in ("key", "bi", "bj"):
        col = table.column(name).to_numpy()
        change[1:] |= col[1:] != col[:-1]
    return np.flatnonzero(change)


def near_pairs(starts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within the groups of at most `most` rows, a distance in rows at a time."""
    sizes = np.diff(starts)
    end = np.repeat(np.where(sizes <= most, starts[1:], 0), sizes)
    left = np.flatnonzero(np.arange(len(end)) + 1 < end)
    step = 1
    while len(left):
        yield left, left + step
        step += 1
        left = left[left + step < end[left]]


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a symmetric matrix of links: rows and a row of the same component, one pair less than rows in each component."""
    n = len(linked)
    fresh = np.ones(n, dtype=bool)
    a, b = [], []
    degree = linked.sum(axis=1)
    for seed in np.flatnonzero(degree):
        if not fresh[seed]:
            continue
        fresh[seed] = False
        front = np.array([seed])
        while len(front):
            found = np.flatnonzero(linked[front].any(axis=0) & fresh)
            fresh[found] = False
            a.append(found)
            b.append(np.full(len(found), seed))
            front = found
    if not a:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(a), np.concatenate(b)
