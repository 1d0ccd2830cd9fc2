"""Passages that repeat across documents, found with compact windows.

The words of a text become hashes of 5-word shingles. For a hash function, the least shingle of a subsequence is its signature, and all
subsequences with the same least shingle form a compact window (l, c, r): they begin in l..c and end in c..r. Of the Cartesian tree over
the hashes only the nodes with windows of a passage's length matter; they are the minima of the sliding windows of that length, and their
extents follow from the next smaller minimum on either side. A signature that texts of different content have is shared.

Within a document the compact windows with shared signatures are joined as intervals. Where those of all hash functions meet, a passage may
be repeated word for word: every run of a passage's length there gets a hash of its own, and each document is told the least document that
has the whole run. So no document that has but a part of a passage stands between those that have all of it, and every exact repetition is
found. Runs that go on in the same document, or go on after a few other words, are one passage.

Where the windows of enough functions meet, a passage may be repeated with edits. At this similarity an edited passage holds long unedited
stretches; those beside the least shingles become seeds. A seed that no exact repetition covers is joined with the least document that has
it, and the passages are compared shingle by shingle. Of a seed that nothing found so far covers, the surroundings in all documents that have
it are compared, in bounded blocks: a passage of this similarity has a place where they agree that far. The lesser document that agrees most
is compared whole, and then ever more of those that agree, until the seed is covered or none is left. A few words said over and over tell
nothing, so most shingles of a seed differ: such stuttering is found where it is repeated word for word, but not where it was edited.

A row is told apart by its id and its text, so rows with equal ids and different texts are documents of their own, in the order of a hash;
repeated rows are one document. Of rows with the same text that of the least id stands for the others, each of which is a repetition as a
whole. Words are separated by ASCII white space. Null texts, and texts shorter than a passage, have none. Rows with a null id are left out:
a result names documents. Ties, a passage that stands several times in the least document, go to its first place there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepack.llm.bpe import slices
from framepack.llm.buckets import dealt, groups, near_pairs
from framepack.llm.common import discard, fresh, materialise

#: Words in a shingle and in a passage, least similarity, hash functions, and how many of them must meet where a passage was edited.
SHINGLE, PASSAGE, SIMILAR, FUNCTIONS, OVERLAP = 5, 50, 0.8, 4, 2
#: Unmatched shingles that may lie between matched ones of a passage: two edited words.
GAP = 2 * SHINGLE
#: Shingles in a seed: a passage of the least length and similarity has 41 unedited ones in two stretches, so 21 in one, of which as many
#: lie on one side of any. So many of a seed's shingles differ.
SEED, DIFFERENT = 10, 8
#: Documents that agree around a seed that the second round looks at, how many times as many each further one, and the members of a block.
TAKE, MORE, BLOCK = 2, 16, 512

_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _rng.integers(1, 1 << 63, 16, dtype=np.uint64)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_DIVIDE = np.uint64(pow(int(_MULT), -1, 1 << 64))
_UP = np.uint64(0xA0761D6478BD642F)
_DOWN = np.uint64(pow(int(_UP), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.where(_SPACE, np.uint64(0), _BYTE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers; not to be written to."""
    if n > _KEPT:
        out = np.full(n, base, dtype=np.uint64)
        out[:1] = 1
        return np.cumprod(out, out=out)
    if base not in _kept:
        _kept[base] = np.cumprod(np.append(np.uint64(1), np.full(_KEPT - 1, base)))
    return _kept[base][:n]


#: So many powers of a base are kept.
_KEPT = 1 << 15
_kept: dict[np.uint64, np.ndarray] = {}


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after another, and the number of words of each text."""
    data = [(t or "").encode("utf-8", "surrogatepass") + b" " for t in texts]
    raw = np.frombuffer(b"".join(data), dtype=np.uint8)
    space = _SPACE[raw]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.cumsum([len(d) for d in data])
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    if not len(start):
        return np.zeros(0, np.uint64), counts
    # Powers rise over all texts; a word's first one is divided out again.
    part = _LETTER[raw] * _powers(_MULT, len(raw))
    return mix(np.add.reduceat(part, start) * _powers(_DIVIDE, len(raw))[start]), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and the number of shingles of each."""
    n = np.maximum(counts - SHINGLE + 1, 0)
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64), n
    power = _powers(np.uint64(0xD6E8FEB86659FD93), SHINGLE)
    m = len(words) - SHINGLE + 1
    h = sum(words[k : k + m] * power[k] for k in range(SHINGLE))
    text = np.repeat(np.arange(len(counts)), counts)
    return mix(h[text[:m] == text[SHINGLE - 1 :]]), n


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """least over every run of `width` values."""
    done, out = 1, x
    while done * 2 <= width:
        out = least(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return least(out[: len(out) - rest], out[rest:]) if rest else out


def leasts(h: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Where the least hashes of all runs of `width` hashes stand, over all texts at once; text is each hash's text, ascending."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    low = _slide(h, width, np.minimum)
    inside = text[: len(low)] == text[width - 1 :]
    pad = np.zeros(width - 1, np.uint64)
    high = _slide(np.concatenate([pad, np.where(inside, low, np.uint64(0)), pad]), width, np.maximum)
    c = np.flatnonzero(high == h)
    # A hash of zero is no less than the padding, but least only where a run covers it.
    zero = h[c] == 0
    if zero.any():
        sums = _sums(inside)
        c = c[~zero | (sums[np.minimum(c + 1, len(low))] > sums[np.minimum(np.maximum(c - width + 1, 0), len(low))])]
    return c


def windows(h: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The compact windows (l, c, r) of at least `width` hashes, over all texts at once; text is each hash's text, ascending."""
    c = leasts(h, text, width)
    if not len(c):
        return c, c, c
    # The next smaller hash on either side, by jumping from one window to the next while it is no smaller.
    v, t, n = h[c], text[c], len(c)
    bounds = np.searchsorted(text, np.arange(int(t.max()) + 2))
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    for jump, stop in ((after, n), (before, -1)):
        live = np.arange(n)
        while len(live):
            to = jump[live]
            ok = to != stop
            live, to = live[ok], to[ok]
            more = (t[to] == t[live]) & (v[to] >= v[live])
            live, to = live[more], to[more]
            jump[live] = jump[to]
    right = np.where((after < n) & (t[np.minimum(after, n - 1)] == t), c[np.minimum(after, n - 1)] - 1, bounds[t + 1] - 1)
    left = np.where((before >= 0) & (t[np.maximum(before, 0)] == t), c[np.maximum(before, 0)] + 1, bounds[t])
    return left, c, right


def _long(words: np.ndarray, counts: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that may hold a passage, and their signatures as a whole."""
    starts = np.cumsum(counts) - counts
    part = words * _powers(_UP, int(counts.max(initial=0)))[np.arange(len(words)) - np.repeat(starts, counts)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
    long = np.flatnonzero(counts >= passage)
    return long, mix(mix(sums[(starts + counts)[long]] - sums[starts[long]]) + np.uint64(FUNCTIONS))


def signatures(texts: list[str | None], passage: int = PASSAGE) -> tuple[np.ndarray, ...]:
    """(text, key, function, l, c, r) of all compact windows of the texts; positions are shingles of the text. A text that may hold a passage
    has a signature as a whole besides, with function -1 and l its number of words."""
    width = passage - SHINGLE + 1
    words, counts = word_hashes(texts)
    s, n = shingle_hashes(words, counts)
    text = np.repeat(np.arange(len(n)), n)
    before = np.cumsum(n) - n
    out = []
    for f in range(FUNCTIONS):
        h = mix(s ^ _SEED[f])
        l, c, r = windows(h, text, width)
        out.append((c, mix(h[c] + np.uint64(f)), np.full(len(c), f), l, r))
    c, key, f, l, r = (np.concatenate(x) for x in zip(*out))
    own = text[c] if len(c) else c
    at = before[own] if len(c) else c
    long, whole = _long(words, counts, passage)
    none = np.zeros(len(long), np.int64)
    return np.append(own, long), np.append(key, whole), np.append(f, none - 1), np.append(l - at, counts[long]), np.append(c - at, none), np.append(r - at, none)


def keys(texts: list[str | None], passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key) of the windows of signatures() and (text, key) of the whole texts."""
    width = passage - SHINGLE + 1
    words, counts = word_hashes(texts)
    s, n = shingle_hashes(words, counts)
    text = np.repeat(np.arange(len(n)), n)
    out = []
    for f in range(FUNCTIONS):
        h = mix(s ^ _SEED[f])
        c = leasts(h, text, width)
        out.append((text[c], mix(h[c] + np.uint64(f))))
    return *(np.concatenate(x) for x in zip(*out)), *_long(words, counts, passage)


def _shared(docs: DataFrame, kind: str, passage: int) -> DataFrame:
    """(key, least): the signatures that texts of different content have, and with the least of their rows those of whole texts that several
    rows have. A batch's rows of a window's signature are summed up before Spark sees them."""

    def run(batches):
        for batch in batches:
            own, key, long, whole, done = [], [], [], [], 0
            for part in slices(batch, "text"):
                x = keys(part.column(2).to_pylist(), passage)
                own.append(x[0] + done)
                key.append(x[1])
                long.append(x[2] + done)
                whole.append(x[3])
                done += part.num_rows
            if not done:
                continue
            key, h = np.concatenate(key), batch.column(1).to_numpy()
            order = np.argsort(key)
            key, hashes = key[order], h[np.concatenate(own)[order]]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            if len(first):
                a, b = np.minimum.reduceat(hashes, first), np.maximum.reduceat(hashes, first)
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(a), pa.array(b), pa.nulls(len(first), batch.schema.field(0).type)], ["key", "a", "b", "id"])
            pick = pa.array(np.concatenate(long))
            same = batch.column(1).take(pick)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(whole).view(np.int64)), same, same, batch.column(0).take(pick)], ["key", "a", "b", "id"])

    rows = docs.select("id", "h", "text").mapInArrow(run, f"key long, a long, b long, id {kind}")
    by_key = rows.groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("id").alias("least"), F.max("id").alias("last"))
    return by_key.where("coalesce(least <> last, a <> b)").select("key", "least")


def _indexed(docs: DataFrame, kind: str, passage: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                text, key, f, l, c, r = signatures(part.column(2).to_pylist(), passage)
                pick = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), pa.array(key.view(np.int64)), pa.array(f.astype(np.int8)), *(pa.array(v.astype(np.int32)) for v in (l, c, r))], ["id", "h", "key", "f", "l", "c", "r"])

    return docs.select("id", "h", "text").mapInArrow(run, f"id {kind}, h long, key long, f byte, l int, c int, r int")


def marks(texts: list[str], owner: np.ndarray, f: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, whole, key, pos): hashes of the runs of a passage's length (whole) and of seeds, and the shingles where they begin. The windows
    (f, l, c, r) with shared signatures belong to texts[owner]; they are joined as intervals of the places where a passage may begin."""
    width = passage - SHINGLE + 1
    s, n = shingle_hashes(*word_hashes(texts))
    before = np.cumsum(n) - n
    text = np.repeat(np.arange(len(n)), n)
    at = before[owner]
    lo, hi = np.maximum(l, c - width + 1) + at, np.minimum(c, r - width + 1) + at
    count = np.zeros(len(s), np.int8)
    for k in range(FUNCTIONS):
        own = f == k
        step = np.bincount(lo[own], minlength=len(s) + 1) - np.bincount(hi[own] + 1, minlength=len(s) + 1)
        count += np.cumsum(step)[:-1] > 0
    whole = np.flatnonzero(count == FUNCTIONS)
    some = np.concatenate([[0], np.cumsum(count >= OVERLAP)])
    c = np.unique((c + at)[some[hi + 1] > some[lo]]) if len(c) else c
    if len(c):
        seed = np.unique(np.concatenate([c[c + SEED <= (before + n)[text[c]]], c[c - SEED + 1 >= before[text[c]]] - SEED + 1]))
        again = np.zeros(len(s), bool)
        for k in range(1, SEED):
            again[k:] |= s[k:] == s[:-k]
        sums, differ = _sums(again), np.full(len(seed), SEED)
        some = np.flatnonzero(sums[seed + SEED] > sums[seed])  # few stutter
        run = np.sort(s[seed[some, None] + np.arange(SEED)], axis=1)
        differ[some] = 1 + (run[:, 1:] != run[:, :-1]).sum(axis=1)
        seed = seed[differ >= DIFFERENT]
    else:
        seed = c
    key = np.concatenate([grams(s, width)[whole], grams(s, SEED)[seed]])
    pos = np.concatenate([whole, seed])
    own = text[pos] if len(pos) else pos
    return own, np.arange(len(pos)) < len(whole), key, pos - before[own] if len(pos) else pos


def _marked(df: DataFrame, kind: str, passage: int) -> DataFrame:
    """marks() of df(id, h, text, w), w the windows with shared signatures."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = part.column(3)
                flat, at = w.flatten(), w.offsets.to_numpy()
                f, l, c, r = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
                own, whole, key, pos = marks(part.column(2).to_pylist(), np.repeat(np.arange(part.num_rows), np.diff(at)), f, l, c, r, passage)
                pick = pa.array(own)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), pa.array(whole), pa.array(key.view(np.int64)), pa.array(pos.astype(np.int32))], ["id", "h", "whole", "key", "pos"])

    return df.select("id", "h", "text", "w").mapInArrow(run, f"id {kind}, h long, whole boolean, key long, pos int")


_FOUND = ["id", "h", "start", "end", "first_id", "first_h", "first_start", "first_end", "similarity"]


def _schema(kind: str) -> str:
    return f"id {kind}, h long, start long, end long, first_id {kind}, first_h long, first_start long, first_end long, similarity double"


def _joined_runs(rows: DataFrame, kind: str, passage: int, similar: float) -> DataFrame:
    """Passages from rows (id, h, pos, first_id, first_h, first_pos) of equal runs: runs of one document that go on in the same first
    document are one passage, also after a few other words, while they stay similar. Rows come sorted by id, h, pos; a document's rows are
    as many as its words at most."""
    width = passage - SHINGLE + 1

    def run(batches):
        held: pa.Table | None = None

        def done(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            pos, at = (table.column(k).to_numpy().astype(np.int64) for k in ("pos", "first_pos"))
            other = _changes(table, ("id", "h", "first_id", "first_h"))
            begin = np.flatnonzero(other | (np.diff(pos, prepend=-9) != 1) | (np.diff(at, prepend=-9) != 1))
            end = np.append(begin[1:], len(pos)) - 1
            # Row, first and last shingle, the same in the first document, and the shingles that count: here, there and in both.
            out: list[list[int]] = []
            for i, x, y, u, v, begun in zip(begin.tolist(), pos[begin].tolist(), (pos[end] + width).tolist(), at[begin].tolist(), (at[end] + width).tolist(), other[begin].tolist()):
                if out and not begun:
                    last = out[-1]
                    if x <= last[2] and last[3] <= u <= last[4]:  # what the first document has there, over again
                        more = max(0, v - last[4])
                        last[2], last[4] = max(y, last[2]), last[4] + more
                        last[5:] = [z + more for z in last[5:]]
                        continue
                    here, there, both = last[5] + y - last[2], last[6] + v - last[4], last[7] + y - x
                    if 0 <= x - last[2] <= GAP and 0 <= u - last[4] <= GAP and both >= similar * (here + there - both):
                        out[-1] = [last[0], last[1], y, last[3], v, here, there, both]
                        continue
                out.append([i, x, y, u, v, y - x, y - x, y - x])
            cols = np.array(out, dtype=np.int64).reshape(-1, 8).T
            pick, more = pa.array(cols[0]), SHINGLE - 1
            share = cols[7] / np.maximum(cols[5] + cols[6] - cols[7], 1)
            values = [table.column("id").take(pick), table.column("h").take(pick), pa.array(cols[1]), pa.array(cols[2] + more), table.column("first_id").take(pick), table.column("first_h").take(pick), pa.array(cols[3]), pa.array(cols[4] + more), pa.array(share)]
            return pa.Table.from_arrays(values, _FOUND)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            starts = np.flatnonzero(_changes(table, ("id", "h")))
            if len(starts) > 1:
                yield from done(table.slice(0, int(starts[-1]))).to_batches()
                table = table.slice(int(starts[-1]))
            held = table
        if held is not None and held.num_rows:
            yield from done(held).to_batches()

    return rows.repartition("id", "h").sortWithinPartitions("id", "h", "pos").select("id", "h", "pos", "first_id", "first_h", "first_pos").mapInArrow(run, _schema(kind))


def _changes(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(table.num_rows, dtype=bool)
    out[:1] = True
    for name in names:
        col = table.column(name).combine_chunks()
        out[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
    return out


class _Places:
    """Where the shingles of a text stand: what passages() needs of the text that others are compared with, for all of them."""

    def __init__(self, y: np.ndarray):
        self.y = y
        self.order = np.argsort(y, kind="stable")
        self.sorted = y[self.order]
        new = np.append(True, self.sorted[1:] != self.sorted[:-1])[: len(y)]
        self.rank = np.cumsum(new) - 1
        self.key = self.rank * (len(y) + 1) + self.order
        single = np.zeros(len(y), bool)
        single[self.order] = new & np.append(new[1:], True)[: len(y)]
        self.single = _sums(single)
        self._runs: tuple[np.ndarray, ...] | None = None
        self._differ: np.ndarray | None = None

    def differ(self, width: int) -> np.ndarray:
        """The number of different shingles in each run of `width`."""
        if self._differ is None:
            self._differ = _differ(self.order, self.sorted, np.ones(len(self.y), bool), width)
        return self._differ

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the runs of `width` shingles, their order and themselves in order."""
        if self._runs is None:
            h = grams(self.y, width)
            order = np.argsort(h, kind="stable")
            self._runs = h, order, h[order]
        return self._runs


def _differ(order: np.ndarray, ordered: np.ndarray, of: np.ndarray, width: int) -> np.ndarray:
    """The number of different values, where `of` holds, in each run of `width`; `order` sorts the values stably. All equal ones are `of` or none."""
    n = len(order)
    before = np.full(n, -1)
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    before[order[same + 1]] = order[same]
    # A value counts in the runs that begin behind the one before it.
    own = np.flatnonzero(of)
    begin, end = np.maximum(before[own], own - width) + 1, own + 1
    begin = np.maximum(begin, 0)
    return np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1))[: n - width + 1]


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def passages(x: np.ndarray, y: np.ndarray | _Places, passage: int = PASSAGE, similar: float = SIMILAR) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start in y, end in y, similarity) in words of the passages of x, shingle hashes, that repeat in y; Jaccard similarity.

    A stretch of shingles that y has is compared with where they first stand in y, and if that fails with all places where they stand: the
    runs that are the same word for word, each diagonal's stretches on their own, and within a stretch that is not similar as a whole the runs
    of a passage's length that are. Stretches whose counts of shingles already tell that they are not similar are not compared."""
    width = passage - SHINGLE + 1
    places = y if isinstance(y, _Places) else None
    y = places.y if places else y
    if len(x) < width or len(y) < width:
        return []
    places = places or _Places(y)
    at = np.searchsorted(places.sorted, x)
    at[at == len(y)] = 0
    hit = places.sorted[at] == x
    where = places.order[at]
    found = np.flatnonzero(hit)
    if not len(found):
        return []
    stretches = _stretches(found, width)
    if not stretches:
        return []

    # Most stretches are short, where sets of numbers are faster than sorted arrays.
    here, there = x.tolist(), y.tolist()
    # Shingles up to a place that y has, and those that stand once in their text.
    sorts = np.argsort(x, kind="stable")
    ordered = x[sorts]
    hits, ones, singles = _sums(hit), _sums(_once(sorts, ordered)), places.single
    differ: list[np.ndarray] = []  # where x stutters, the different shingles of each run, all and those that y has

    def likely(a, b, lo, hi):
        """Whether x[a..b] may be similar to y[lo..hi], which have no more in common than y's shingles in x, and no fewer different ones than
        those that stand once; for numbers and arrays."""
        both = hits[b + 1] - hits[a]
        return both >= similar * (ones[b + 1] - ones[a] + singles[hi + 1] - singles[lo] - both) - 1e-6

    def checked(a: int, b: int, lo: int, hi: int) -> tuple | None:
        u, v = set(here[a : b + 1]), set(there[lo : hi + 1])
        both = len(u & v)
        j = both / (len(u) + len(v) - both)
        return (a, b + SHINGLE, lo, hi + SHINGLE, j) if j >= similar else None

    least = similar * (width + SHINGLE - 1)

    def dense(a: int, b: int, i: np.ndarray, j: np.ndarray) -> list[tuple]:
        """Similar runs of a passage's length in x[a..b], of the hits (i, j) on neighbouring diagonals; one after another."""
        if len(i) < least:
            return []
        has = np.zeros(b - a + 1, bool)
        has[i - a] = True
        sums = _sums(has)
        got, upto = [], -1
        both = sums[width:] - sums[:-width]
        enough = (both >= least).nonzero()[0]
        if not len(enough):
            return []
        by = i.argsort(kind="stable")
        at, to = i[by] - a, j[by]
        first = sums[enough] if len(i) == sums[-1] else np.searchsorted(at, enough)
        last = (sums[enough + width] if len(i) == sums[-1] else np.searchsorted(at, enough + width)) - 1
        apart = np.abs(to[last] - to[first]) + 1
        some = enough[both[enough] >= (similar - 0.03) * (width + apart - both[enough])]
        if not len(some):
            return []
        low, high = np.full(b - a + 1, len(y)), np.full(b - a + 1, -1)
        np.minimum.at(low, at, to)
        np.maximum.at(high, at, to)
        low, high = _slide(low, width, np.minimum)[some], _slide(high, width, np.maximum)[some]
        may = likely(some + a, some + a + width - 1, low, high)
        if ones[-1] < len(x):
            if not differ:
                differ.extend(_differ(sorts, ordered, of, width) for of in (np.ones(len(x), bool), hit))
            u, both = differ[0][some + a], differ[1][some + a]
            v = np.where(high - low + 1 >= width, places.differ(width)[np.minimum(low, len(y) - width)], singles[high + 1] - singles[low])
            may &= both >= similar * (u + v - both) - 1e-6
        for s, lo, hi, ok in zip(some.tolist(), low.tolist(), high.tolist(), may.tolist()):
            if s > upto:
                if ok and (p := checked(a + s, a + s + width - 1, lo, hi)):
                    got.append(p)
                    upto = s + width // 2
                else:
                    upto = s + SHINGLE - 1  # an edit further on changes so many
        return got

    # Where a run of a passage's length may begin that y has as well.
    runs = np.flatnonzero(hits[width:] - hits[:-width] == width)
    out = []
    for a, b in stretches:
        own = np.flatnonzero(hit[a : b + 1]) + a
        shift = where[own] - own
        near = where[own[np.abs(shift - np.median(shift)) <= max(GAP, (b - a + 1) // 8)]]
        if len(near):
            lo, hi = int(near.min()), int(near.max())
            if likely(a, b, lo, hi) and (got := checked(a, b, lo, hi)):
                out.append(got)
                continue
        begin, upto = np.searchsorted(runs, (a, b - width + 2))
        parts = [(s, e + SHINGLE, q, q + e - s + SHINGLE, 1.0) for s, e, q in _runs(x, places, a, b, width)] if begin < upto else []
        covered = np.zeros(b - a + 1, bool)
        for s, e, *_ in parts:
            covered[s - a : e - SHINGLE + 1 - a] = True
        for i, j in _diagonals(x[a : b + 1], y, places.order, places):
            if covered[i].all():  # text said over and over has many diagonals
                continue
            known = len(parts)
            met = np.zeros(b - a + 1, bool)
            met[i] = True
            for s, e in _stretches(met.nonzero()[0], width):
                inside = (i >= s) & (i <= e)
                to = j[inside]
                lo, hi = int(to.min()), int(to.max())
                if likely(a + s, a + e, lo, hi) and (got := checked(a + s, a + e, lo, hi)):
                    parts.append(got)
                elif e - s >= width:
                    parts += dense(a + s, a + e, i[inside] + a, to)
            for s, e, *_ in parts[known:]:
                covered[s - a : e - SHINGLE + 1 - a] = True
        # Of parts that lie within another one, the longer stands.
        end = -1
        for p in sorted(set(parts), key=lambda p: (p[0], -p[1], -p[4], p[2])):
            if p[1] > end:
                out.append(p)
                end = p[1]
    return out


def _once(order: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value stands once; `order` sorts the values."""
    new = np.append(True, ordered[1:] != ordered[:-1])
    out = np.zeros(len(order), bool)
    out[order] = new & np.append(new[1:], True)
    return out


def _stretches(found: np.ndarray, width: int) -> list[tuple[int, int]]:
    """First and last of the stretches of at least `width` in ascending positions, with no more than GAP missing at a place."""
    if not len(found):
        return []
    breaks = (found[1:] - found[:-1] > GAP + 1).nonzero()[0]
    ends = zip([int(found[0]), *found[breaks + 1].tolist()], [*found[breaks].tolist(), int(found[-1])])
    return [(a, b) for a, b in ends if b - a + 1 >= width]


def grams(s: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` shingles."""
    if len(s) < width:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s * _powers(_UP, len(s)), dtype=np.uint64)])
    return mix((sums[width:] - sums[:-width]) * _powers(_DOWN, len(s) - width + 1))


def _runs(x: np.ndarray, places: _Places, a: int, b: int, width: int) -> list[tuple[int, int, int]]:
    """(first, last, first in y) of runs of shingles in x[a..b] that stand so in y; together they hold every such run of `width`."""
    g, (h, order, sorted_) = grams(x[a : b + 1], width), places.runs(width)
    if not len(g) or not len(h):
        return []
    at = np.searchsorted(sorted_, g)
    at[at == len(h)] = 0
    same = np.flatnonzero(sorted_[at] == g)
    out, upto = [], -1
    for p in same.tolist():
        if p <= upto:
            continue
        q = int(order[at[p]])
        n = min(len(g) - p, len(h) - q)
        differ = np.flatnonzero(g[p : p + n] != h[q : q + n])
        upto = p + (int(differ[0]) if len(differ) else n) - 1
        m = min(p, q)
        differ = np.flatnonzero(g[p - m : p][::-1] != h[q - m : q][::-1])
        back = int(differ[0]) if len(differ) else m
        out.append((a + p - back, a + upto + width - 1, q - back))
    return out


#: Hits looked at together.
_HITS = 1 << 21


def _diagonals(x: np.ndarray, y: np.ndarray, order: np.ndarray, places: _Places | None = None):
    """Positions (i, j) of equal shingles in x and y, a band of diagonals at a time: two GAPs wide, one apart, so that whatever shifts by a
    GAP or less lies in one of them. `order` sorts y. Many hits are found in parts of the diagonals."""
    places = places or _Places(y)
    ys, rank, key, m = places.sorted, places.rank, places.key, len(y) + 1
    at = ys.searchsorted(x)
    at[at == len(ys)] = 0
    own = (ys[at] == x).nonzero()[0]
    base = rank[at[own]] * m
    total = int((ys.searchsorted(x[own], "right") - at[own]).sum())
    first, last = -(-len(x) // GAP) * -1, len(y) // GAP
    step = max(1, (last - first + 1) * _HITS // max(total, 1))
    for k in range(first, last + 1, step):
        upto = min(k + step, last + 1)  # and one bin more, for the last band
        lo = key.searchsorted(base + np.minimum(np.maximum(own + k * GAP, 0), m - 1))
        n = key.searchsorted(base + np.minimum(np.maximum(own + (upto + 1) * GAP, 0), m - 1)) - lo
        i = np.repeat(own, n)
        if not len(i):
            continue
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        bin_ = (j - i) // GAP - k
        by = bin_.argsort(kind="stable")
        i, j = i[by], j[by]
        edge = bin_[by].searchsorted(np.arange(upto - k + 2))
        # A stretch has a hit in every GAP + 1 places. A band next to one with the same hits is that band over again.
        many = edge[2:] - edge[:-2] >= 4
        many[1:] &= (edge[1:-2] > edge[:-3]) | (edge[3:] > edge[2:-1])
        for band in many.nonzero()[0].tolist():
            yield i[edge[band] : edge[band + 2]], j[edge[band] : edge[band + 2]]


def _open(seeds: DataFrame, found: DataFrame) -> DataFrame:
    """The seeds (id, h, pos, ...) that no passage found covers."""
    spans = found.groupBy("id", "h").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    return seeds.join(spans, ["id", "h"], "left").where(f"s is null or not exists(s, x -> x.start <= pos and pos + {SEED + SHINGLE - 1} <= x.end)").drop("s")


def _passages(df: DataFrame, id_col: str, text_col: str, passage: int, similar: float) -> DataFrame:
    """Rows as repeats() returns them, with the hashes of the two texts: (id, h, start, end, first_id, first_h, first_start, ...)."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).where("id is not null and text is not null")
    # What texts of different content have; and whole texts that several rows have, with the least of them.
    shared = materialise(_shared(docs, kind, passage), "shared")
    # Of the windows few are shared, so these are looked up by a hash instead of sorting all.
    members = _indexed(docs, kind, passage).join(shared.hint("shuffle_hash"), "key").groupBy("id", "h").agg(F.collect_list(F.expr("if(f < 0, null, struct(f, l, c, r))")).alias("w"), F.max("least").alias("least"), F.max(F.expr("if(f < 0, l, null)")).alias("n_words"))
    members = materialise(members, "members")
    discard(shared)
    copies = members.where("least <> id")
    some = members.where(F.col("least").isNull() | (F.col("least") == F.col("id"))).where(F.size("w") >= OVERLAP)
    texts = docs.join(some.select("id", "h", "w"), ["id", "h"]).groupBy("id", "h").agg(F.max("text").alias("text"), F.first("w").alias("w"))
    texts = materialise(texts, "texts")
    places = materialise(_marked(texts, kind, passage), "places")

    # Word for word: each run's least document.
    runs = places.where("whole").select("id", "h", "key", "pos")
    firsts = runs.groupBy("key").agg(F.min(F.struct("id", "h", "pos")).alias("first"), F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b")
    firsts = materialise(firsts.select("key", F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h"), F.col("first.pos").alias("first_pos")), "firsts")
    found = materialise(_joined_runs(runs.join(firsts, "key").where("id <> first_id or h <> first_h"), kind, passage, similar), "found")

    # Edited: seeds that are left over, with the least document first.
    seeds = places.where("not whole").select("id", "h", "key", "pos")
    often = seeds.groupBy("key").agg(F.min(F.struct("id", "h")).alias("least"), F.count(F.lit(1)).alias("n"), F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b")
    often = materialise(often.select("key", "n", F.col("least.id").alias("first_id"), F.col("least.h").alias("first_h")), "often")
    rest = materialise(_open(seeds.join(often, "key").where("id <> first_id or h <> first_h"), found), "rest")
    near, rest, take = rest.select(*_PAIR).distinct(), rest.where("n > 2").select("id", "h", "key", "pos"), TAKE
    tried, large = near, often.where(F.col("n") > BLOCK).select("key", "n")
    named = near.select("id", "h").union(near.select(F.col("first_id").alias("id"), F.col("first_h").alias("h"))).distinct()
    looked = materialise(texts.select("id", "h", "text").join(named, ["id", "h"], "left_semi"), "looked")
    older = [looked]
    while True:
        edited = materialise(_verified(near, looked, kind, passage, similar), "edited")
        discard(*older)
        found = found.unionByName(edited)
        rest = materialise(_open(rest, edited), "rest")
        if rest.isEmpty():
            break
        # Only the documents that have a seed still open are looked at again, so each round moves less text.
        members = seeds.join(rest.select("key").distinct(), "key", "left_semi").join(rest.withColumn("wanted", F.lit(True)), ["id", "h", "key", "pos"], "left")
        members = members.groupBy("id", "h").agg(F.collect_list(F.struct("key", "pos", F.coalesce("wanted", F.lit(False)).alias("wanted"))).alias("w"))
        looked = materialise(texts.select("id", "h", "text").join(members, ["id", "h"]), "looked")
        discard(texts)
        texts, older = looked, []
        agreeing = materialise(_agreeing(looked, large, kind, passage, similar, take), "near")
        near = agreeing.select(*_PAIR).distinct().join(tried, _PAIR, "left_anti")
        rest = rest.join(agreeing.where("more").select("id", "h", "key").distinct(), ["id", "h", "key"], "left_semi")
        tried, take = tried.union(agreeing.select(*_PAIR)), take * MORE
    found = materialise(_outermost(found, kind), "passages")
    whole = copies.select("id", "h", F.lit(0).cast("long").alias("start"), F.col("n_words").cast("long").alias("end"), F.col("least").alias("first_id"), F.col("h").alias("first_h"), F.lit(0).cast("long").alias("first_start"), F.col("n_words").cast("long").alias("first_end"), F.lit(1.0).alias("similarity"))
    discard(places, firsts, often, texts)
    return found.unionByName(whole)


_PAIR = ["id", "h", "first_id", "first_h"]


def _outermost(found: DataFrame, kind: str) -> DataFrame:
    """The passages that lie within no other passage of their document; of equal ones that of the least first document."""

    def run(batches):
        last, upto = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            change = _changes(table, ("id", "h"))
            own = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            change[0] = own != last
            end = batch.column(3).to_numpy()
            # Ends of all documents on one scale, so that a running maximum stays within a document.
            nth, most = np.cumsum(change), int(end.max()) + max(upto, 0) + 1
            high = np.maximum.accumulate(np.concatenate([[upto], nth * most + end]))
            keep = nth * most + end > high[:-1]
            last, upto = (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py()), int(high[-1] - nth[-1] * most)
            yield batch.filter(pa.array(keep))

    order = ["id", "h", "start", F.desc("end"), "first_id", "first_h", "first_start"]
    return found.repartition("id", "h").sortWithinPartitions(*order).select(*_FOUND).mapInArrow(run, _schema(kind))


def _different(s: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The number of different values in each s[lo:hi]; s are 32-bit values of texts, n of each, and no slice goes beyond its text."""
    key = (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32)) | s
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    before = np.full(len(s), -1)
    before[order[same + 1]] = order[same]
    # Few values stand twice so near each other that a slice can hold both.
    near = np.concatenate([[0], np.cumsum((before >= 0) & (np.arange(len(s)) - before < int((hi - lo).max(initial=0))))])
    out = hi - lo
    for k in np.flatnonzero(near[hi] > near[lo]).tolist():
        out[k] -= np.count_nonzero(before[lo[k] : hi[k]] >= lo[k])
    return out


def _agreeing(looked: DataFrame, large: DataFrame, kind: str, passage: int, similar: float, take: int) -> DataFrame:
    """(key, id, h, first_id, first_h, more) from looked(id, h, text, w), w the seeds (key, pos, wanted) of a text: for each document's wanted
    seed the lesser documents whose surroundings of the seed have enough shingles in common with it, the `take` of each group of blocks that
    have most, and whether there are more."""
    width = passage - SHINGLE + 1

    def surroundings(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = part.column(3)
                flat, at = w.flatten(), w.offsets.to_numpy()
                s, n = shingle_hashes(*word_hashes(part.column(2).to_pylist()))
                own = np.repeat(np.arange(part.num_rows), np.diff(at))
                first = (np.cumsum(n) - n)[own]
                pos = flat.field(1).to_numpy() + first
                lo, hi = np.maximum(pos - width + SEED, first), np.minimum(pos + width, first + n[own])
                s = s.astype(np.uint32)
                differ, size = _different(s, n, lo, hi), hi - lo
                offsets = np.concatenate([[0], np.cumsum(size)])
                around = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(s[np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], size)].view(np.int32)))
                # However a passage lies there, so many different shingles it has at least, and this share of them in common.
                need = np.ceil(2 * similar / (1 + similar) * (differ - (hi - lo - width)) - 1e-9)
                pick = pa.array(own)
                yield pa.RecordBatch.from_arrays([flat.field(0), part.column(0).take(pick), part.column(1).take(pick), flat.field(2), pa.array(np.maximum(need, SEED // 2).astype(np.int32)), around], ["key", "id", "h", "wanted", "need", "around"])

    around = looked.select("id", "h", "text", "w").mapInArrow(surroundings, f"key long, id {kind}, h long, wanted boolean, need int, around array<int>")
    rows = dealt(around, large, "id", BLOCK).repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "id", "h")

    def compare(batches):
        for table, starts in groups(batches):
            x, y, more = _most_alike(table, starts, take, width, similar)
            x, y = pa.array(x), pa.array(y)
            ids, h = table.column("id").combine_chunks(), table.column("h").combine_chunks()
            yield pa.RecordBatch.from_arrays([table.column("key").combine_chunks().take(x), ids.take(x), h.take(x), ids.take(y), h.take(y), pa.array(more)], ["key", "id", "h", "first_id", "first_h", "more"])

    return rows.select("key", "bi", "bj", "b", "id", "h", "wanted", "need", "around").mapInArrow(compare, f"key long, id {kind}, h long, first_id {kind}, first_h long, more boolean")


#: Groups up to this size are compared pair by pair, larger ones by matrix, so many columns at a time; so many pairs are judged together.
_FEW, _COLUMNS, _PAIRS = 16, 4096, 4000


def _most_alike(table: pa.Table, starts: np.ndarray, take: int, width: int, similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, the lesser rows of their groups that have most in common with them, and whether there are more. Groups are sorted by id, h.

    Two rows need enough different shingles in common, and runs that have enough of each other's to be similar, as far as places tell."""
    around = table.column("around").combine_chunks()
    flat, at = around.flatten().to_numpy(), around.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    need, wanted, b, bi, bj = (table.column(k).to_numpy() for k in ("need", "wanted", "b", "bi", "bj"))
    doc = np.cumsum(_changes(table, ("key", "bi", "bj", "id", "h")))
    size = np.diff(at)
    wide = max(int(size.max()) if len(size) else 0, width)
    lengths = np.arange(width, wide + 1, 2)
    inside = np.arange(wide)[None, :] < size[:, None]
    place = np.minimum(at[:-1, None] + np.arange(wide), max(len(flat) - 1, 0))
    xs, ys, counts = [], [], []

    def met(m):
        """The most shingles met in a run of each of the lengths, a row for each length; m: which shingles are met, a row for each pair."""
        sums = np.zeros((wide + 1, len(m)), np.int16)
        np.cumsum(m.T, axis=0, out=sums[1:])
        return np.stack([(sums[n:] - sums[:-n]).max(axis=0) for n in lengths.tolist()])

    # An edit leaves SHINGLE - 1 shingles on either side without a match, so a run of n shingles of a passage has this many at least.
    least = np.ceil(similar * (lengths + SHINGLE - 1) - 1e-9)[:, None]

    def alike(here, there):
        """The greatest similarity that runs of lengths up to GAP apart may have, as they meet each other's shingles."""
        best = np.zeros(here.shape[1])
        here, there = here.astype(np.float32), there.astype(np.float32)
        for apart in range(-(GAP // 2), GAP // 2 + 1):
            lo, hi = max(0, -apart), min(len(lengths), len(lengths) - apart)
            if lo < hi:
                both = np.minimum(here[lo:hi], there[lo + apart : hi + apart])
                np.maximum(best, (both / ((lengths[lo:hi] + lengths[lo + apart : hi + apart]).astype(np.float32)[:, None] - both)).max(axis=0), out=best)
        return best

    def judge(p, q, forth, back):
        """Holds of pairs those that may share a passage, and how similar it may be; forth and back: which shingles are met."""
        here = met(forth)
        ok = (here >= least).any(axis=0)
        p, q, here, there = p[ok], q[ok], here[:, ok], met(back[ok])
        ok = (there >= least).any(axis=0)
        p, q, j = p[ok], q[ok], alike(here[:, ok], there[:, ok])
        ok = j >= similar - 0.01  # every other length is looked at
        xs.append(p[ok])
        ys.append(q[ok])
        counts.append(j[ok])

    def eligible(x, y):
        return wanted[x] & (doc[x] != doc[y]) & ((b[x] != b[y]) | (bi[x] == bj[x]))

    for y, x in near_pairs(starts, _FEW):
        own = eligible(x, y)
        x, y = x[own], y[own]
        for k in range(0, len(x), 2000):
            p, q = x[k : k + 2000], y[k : k + 2000]
            left, right = (np.where(inside[z], flat[place[z]].astype(np.int64), -(1 << 40) - i) for i, z in enumerate((p, q)))
            same = left[:, :, None] == right[:, None, :]
            judge(p, q, same.any(axis=2), same.any(axis=1))
    held: list[tuple[np.ndarray, ...]] = []  # pairs of several groups, judged together
    for g in np.flatnonzero(np.diff(starts) > _FEW):
        s, e = int(starts[g]), int(starts[g + 1])
        if not wanted[s:e].any():
            continue
        values, column, n = np.unique(flat[at[s] : at[e]], return_inverse=True, return_counts=True)
        often = n > 1
        column = np.where(often, np.cumsum(often), 0)[column]  # 0: a value that no other row has
        row = np.repeat(np.arange(e - s), size[s:e])
        has = np.zeros((e - s, int(often.sum()) + 1), bool)
        has[row, column] = True
        has[:, 0] = False
        common = np.zeros((e - s, e - s), np.float32)
        for k in range(1, has.shape[1], _COLUMNS):
            m = has[:, k : k + _COLUMNS].astype(np.float32)
            common += m @ m.T
        x, y = np.nonzero(np.tril(common >= np.maximum.outer(need[s:e], need[s:e]), -1))
        ok = eligible(x + s, y + s)
        x, y = x[ok], y[ok]
        columns = np.where(inside[s:e], column[np.minimum(place[s:e] - at[s], len(column) - 1)], 0)
        for k in range(0, len(x), _PAIRS):
            p, q = x[k : k + _PAIRS], y[k : k + _PAIRS]
            held.append((p + s, q + s, has[q[:, None], columns[p]], has[p[:, None], columns[q]]))
            if sum(len(z[0]) for z in held) >= _PAIRS:
                judge(*(np.concatenate(z) for z in zip(*held)))
                held = []
    if held:
        judge(*(np.concatenate(z) for z in zip(*held)))
    if not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    x, y, common = (np.concatenate(z) for z in (xs, ys, counts))
    # Of two documents the rows that agree most; of each document's seed in this group the documents that agree most.
    order = np.lexsort((-common, doc[y], doc[x]))
    x, y, common = x[order], y[order], common[order]
    best = np.append(True, (doc[x[1:]] != doc[x[:-1]]) | (doc[y[1:]] != doc[y[:-1]]))[: len(x)]
    x, y, common = x[best], y[best], common[best]
    order = np.lexsort((y, -common, doc[x]))
    x, y = x[order], y[order]
    begin = np.flatnonzero(np.diff(doc[x], prepend=-1))
    many = np.diff(np.append(begin, len(x)))
    nth = np.arange(len(x)) - np.repeat(begin, many)
    left = np.repeat(many, many) > take
    return x[nth < take], y[nth < take], left[nth < take]


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, similar: float = SIMILAR) -> DataFrame:
    """(id, start, end, first_id, first_start, first_end, similarity): a passage of a document that the document first_id, of lesser id, has
    too. Positions are words, ends exclusive. Every document but the least of those that share a passage is named. Other columns are ignored."""
    found = _passages(df, id_col, text_col, passage, similar)
    return found.select(F.col("id").alias(id_col), "start", "end", "first_id", "first_start", "first_end", "similarity")


def _verified(pairs: DataFrame, texts: DataFrame, kind: str, passage: int, similar: float) -> DataFrame:
    """The passages of pairs(id, h, first_id, first_h) of documents."""
    both = pairs.join(texts.select("id", "h", F.col("text").alias("x")), ["id", "h"])
    both = both.join(texts.select(F.col("id").alias("first_id"), F.col("h").alias("first_h"), F.col("text").alias("y")), ["first_id", "first_h"])

    def run(batches):
        for batch in batches:
            for longer in slices(batch, "x"):
                for part in slices(longer, "y"):
                    rows = []
                    last, seen = None, None
                    words, counts = word_hashes(part.column(4).to_pylist())
                    shingles, n = shingle_hashes(words, counts)
                    ends = np.cumsum(n)
                    for i, (x, y, of) in enumerate(zip(np.split(shingles, ends[:-1]), part.column(5).to_pylist(), part.column(3).to_pylist())):
                        if last != (of, len(y)):
                            last, seen = (of, len(y)), _Places(shingle_hashes(*word_hashes([y]))[0])
                        rows += [(i, *p) for p in passages(x, seen, passage, similar)]
                    cols = list(zip(*rows)) if rows else [[]] * 6
                    pick = pa.array(cols[0], pa.int64())
                    a, b, u, v = (pa.array(c, pa.int64()) for c in cols[1:5])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), a, b, part.column(2).take(pick), part.column(3).take(pick), u, v, pa.array(cols[5], pa.float64())], _FOUND)

    return both.select("id", "h", "first_id", "first_h", "x", "y").mapInArrow(run, _schema(kind))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the space after them."""
    if not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    space = _SPACE[np.frombuffer(data, dtype=np.uint8)]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    out, at = [], 0
    for a, b in sorted(spans):
        lo, hi = int(start[a]), int(start[b]) if b < len(start) else len(data)
        if lo > at:
            out.append(data[at:lo])
        at = max(at, hi)
    return (b"".join(out) + data[at:]).decode("utf-8", "surrogatepass")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, similar: float = SIMILAR) -> DataFrame:
    """df with repeated passages removed from all documents but the first of each; all rows and columns stay, texts may become empty. Each
    row is cut by its own text's passages; rows with a null id or text stay as they are, and repeated rows are cut alike."""
    spans_, key, of = fresh(df, "spans"), fresh(df, "key"), fresh(df, "of")
    found = _passages(df, id_col, text_col, passage, similar)
    spans = materialise(found.groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias(spans_)), "spans").select(F.col("id").alias(of), F.col("h").alias(key), spans_)
    named = F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
    some = df.where(named).join(spans, (F.col(id_col) == F.col(of)) & (F.xxhash64(text_col) == F.col(key)), "left").select(*df.columns, spans_)
    nth = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            where = batch.column(batch.num_columns - 1)
            cols = batch.columns[:-1]
            if where.null_count < batch.num_rows:
                texts = [t if s is None else without(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(cols[nth].to_pylist(), where.to_pylist())]
                cols[nth] = pa.array(texts, cols[nth].type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return some.mapInArrow(run, df.schema).unionByName(df.where(~named))
