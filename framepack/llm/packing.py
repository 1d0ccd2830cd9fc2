"""Packing of token streams into windows of fixed capacity by Karmarkar-Karp multiway differencing.

Each task packs its own rows, so nothing is shuffled. Whole windows of a document stand alone; the remainders, in groups whose total is a
multiple of the capacity, are split into near-equal windows by differencing: the two partial partitions of greatest spread are merged, the
fullest window of one with the emptiest of the other. While a window exceeds the capacity, the window count rises. The emptiest windows, as
many as it rose by, are then dissolved: their pieces, cut where they must be, fill the room that the others have, so a group leaves no
padding. The last tokens of a batch of texts, fewer than the capacity, go to windows whose lengths are powers of two.

Documents of equal size are taken in the order of their rows, so ties do not change from run to run.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepack.llm.bpe import codec, slices

#: Windows that one differencing fills.
WINDOWS = 64
_ITEM = (1 << 32) - 1


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of indices into sizes with near-equal sums. Ties go to the partial partition that was made first.

    A partial partition lists its parts, fullest first, each as sum << 32 | an item that stands for the part; empty parts are left out. So
    two that fill no more than k parts together are merged by sorting, and only parts that meet are added up."""
    part = list(range(len(sizes)))  # an item of the same part, up to the one that stands for it
    heap = [(-size, n, [size << 32 | n]) for n, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if (free := k - len(b)) < len(a):
            met = []
            for x, y in zip(a[free:], reversed(b)):
                part[y & _ITEM] = x & _ITEM
                met.append(x + (y & ~_ITEM))
            a = a[:free] + met + b[: max(0, k - len(a))]
        else:
            a = a + b
        a.sort(reverse=True)
        if len(a) == k and (least := a[-1] & ~_ITEM):
            a = [x - least for x in a]
        heapq.heappush(heap, (-(a[0] >> 32), made, a))
        made += 1
    found: dict[int, list[int]] = {x & _ITEM: [] for x in (heap[0][2] if heap else [])}
    for i in range(len(sizes)):
        at = i
        while part[at] != at:
            part[at] = at = part[part[at]]
        found[at].append(i)
    return [*found.values(), *([] for _ in range(k - len(found)))]


def partition(sizes: list[int], capacity: int, least: int = 1) -> list[list[int]]:
    """Windows of indices, `least` or more, none over capacity, of near-equal sums; no size may exceed the capacity."""
    if any(s > capacity for s in sizes):
        raise ValueError("a piece exceeds the capacity")
    k = max(least, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return found
        k += 1


def windows(sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (index, start, length) that hold every unit of every size once: full ones, then powers of two."""
    out: list[list[tuple[int, int, int]]] = []
    for i in np.flatnonzero(sizes >= capacity).tolist():
        out += [[(i, s, capacity)] for s in range(0, int(sizes[i]) // capacity * capacity, capacity)]
    group, room = [], WINDOWS * capacity
    for i in np.flatnonzero(sizes % capacity).tolist():
        start, left = int(sizes[i]) // capacity * capacity, int(sizes[i]) % capacity
        while left:
            take = min(left, room)
            group.append((i, start, take))
            start, left, room = start + take, left - take, room - take
            if not room:
                out += _group(group, capacity)
                group, room = [], WINDOWS * capacity
    held = WINDOWS * capacity - room
    rest, tail = held % capacity, []
    while rest:  # the last pieces, cut off from the end
        i, start, n = group.pop()
        take = min(n, rest)
        if take < n:
            group.append((i, start, n - take))
        tail.append((i, start + n - take, take))
        rest -= take
    if group:
        out += _group(group, capacity)
    size = capacity
    left = held % capacity
    tail = tail[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        window, need = [], size
        while need:
            i, start, n = tail.pop(0)
            take = min(n, need)
            if take < n:
                tail.insert(0, (i, start + take, n - take))
            window.append((i, start, take))
            need -= take
        out.append(window)
    return out


def _group(pieces: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Full windows from pieces whose total is a multiple of the capacity."""
    k = sum(n for _, _, n in pieces) // capacity
    # Full windows without a cut would need sums that are equal to the last token, so the count begins with one window more.
    every = [[pieces[i] for i in w] for w in partition([n for _, _, n in pieces], capacity, k + 1)]
    every.sort(key=lambda w: -sum(n for _, _, n in w))
    found, over = every[:k], [p for w in every[k:] for p in w]
    short = [(w, room) for w in found if (room := capacity - sum(n for _, _, n in w))]
    for w, room in short:
        while room:
            i, start, n = over.pop()
            take = min(n, room)
            if take < n:
                over.append((i, start + take, n - take))
            w.append((i, start, take))
            room -= take
    return found


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and its ids if asked for.

    A document is the ids of its text and then end_id; a null or empty text is end_id alone. Rows with equal or null ids are documents of
    their own. sequence_id is the task's number and a count, so a task that is run again gives the same rows. Other columns are ignored.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                ids, n = c.encode(part.column(1).to_pylist())
                at = np.cumsum(n) - n
                found = windows(n + 1, capacity)
                rows = np.array([(i, s, k, base + w, 0) for w, window in enumerate(found) for i, s, k in window], dtype=np.int64).reshape(-1, 5)
                base += len(found)
                ends = np.cumsum(rows[:, 2])
                first = np.concatenate([[True], rows[1:, 3] != rows[:-1, 3]]) if len(rows) else np.zeros(0, bool)
                before = ends - rows[:, 2]
                rows[:, 4] = before - np.maximum.accumulate(np.where(first, before, 0))
                own = [_ids(ids, at, n, i, s, k, end_id) for i, s, k in rows[:, :3].tolist()]
                cols = [part.column(0).take(pa.array(rows[:, 0])), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array((n + 1)[rows[:, 0]]), pa.array(rows[:, 3]), pa.array(rows[:, 4])]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    flat = np.concatenate(own) if own else np.zeros(0, np.uint32)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _ids(ids: np.ndarray, at: np.ndarray, n: np.ndarray, i: int, start: int, length: int, end_id: int) -> np.ndarray:
    """Ids start to start + length of document i, the end id counted."""
    own = ids[at[i] + start : at[i] + min(start + length, n[i])].astype("<u4")
    return np.append(own, np.uint32(end_id)) if start + length > n[i] else own
