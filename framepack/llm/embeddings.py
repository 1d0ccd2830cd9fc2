"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated at random by signs and fast Hadamard transforms, three times; its hash is the axis, with sign, that it then lies closest
to. A table joins such hashes into a bucket, and a vector also visits the buckets of its next-closest axes (multiprobe). How many hashes are
joined follows from the number of vectors, so that buckets stay small, and how many tables there are from how often pairs at the threshold
meet in one, found out by trying random pairs. Vectors that share a bucket, a label and a dimension are compared exactly, in double precision.
Buckets are compared in bounded blocks, and every pair in the first bucket that it shares only, so that links are counted once and never
written out pair by pair.

Null, zero and non-finite vectors, vectors with null components, and rows with a null label link with nothing. Vectors are scaled by powers of
two, which changes no cosine, so that squares of the largest and smallest numbers neither overflow nor vanish. Equal vectors of a label are
one class, linked with each other; each row counts as a vector of its own, also among rows with equal ids. Ties, several least ids, are one id.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepack.llm.buckets import BLOCK, dealt, groups, near_pairs, spanning
from framepack.llm.common import connected, materialise

#: Next-closest axes tried, hashes joined in a table and tables at most, share of the pairs at the threshold that must be found, and the seed.
NEXT, MOST_JOINED, MOST_TABLES, FOUND, SEED = 2, 5, 40, 0.999, 11
FEW = 24


@lru_cache(maxsize=8)
def _signs(size: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).choice([-1.0, 1.0], (n, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row, its length a power of two."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def bucket_codes(x: np.ndarray, tables: int, joined: int) -> np.ndarray:
    """Codes (rows, tables, 1 + joined * NEXT) of the buckets that vectors of one dimension visit, own bucket first."""
    size = _size(x.shape[1])
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    signs = _signs(size, tables * joined)
    out = np.zeros((len(x), tables, 1 + joined * NEXT), dtype=np.uint64)
    tries = min(1 + NEXT, 2 * size)
    weight = np.cumprod(np.full(joined + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    for t in range(tables):
        best = []
        for k in range(joined):
            y = x
            for r in range(3):
                y = hadamard(y * signs[t * joined + k, r])
            both = np.concatenate([y, -y], axis=1)
            best.append(np.argsort(-both, axis=1, kind="stable")[:, :tries].astype(np.uint64) * weight[k])
        own = sum(b[:, 0] for b in best) + np.uint64(t * int(weight[joined]) & (1 << 64) - 1)
        out[:, t] = own[:, None]
        for k, b in enumerate(best):
            for i in range(1, tries):
                out[:, t, 1 + k * NEXT + i - 1] = own - b[:, 0] + b[:, i]
    return out.view(np.int64)


def _size(dimension: int) -> int:
    """The length of the rotated vectors: a power of two, and large enough for tables that differ."""
    return max(16, 1 << (dimension - 1).bit_length())


@lru_cache(maxsize=64)
def plan(dimension: int, n: int, threshold: float) -> tuple[int, int]:
    """(tables, joined) for n vectors of one label and dimension: as many codes as vectors, and tables enough to find the pairs at the threshold."""
    axes, joined = 2 * _size(dimension), 2
    while joined < MOST_JOINED and axes**joined < n:
        joined += 1
    rng = np.random.default_rng([SEED, dimension, joined])
    x, other = rng.normal(size=(2, 1000, max(dimension, 2)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * other
    tables = 3
    while tables < MOST_TABLES:
        a, b = (bucket_codes(z, tables, joined) for z in (x, y))
        if (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= FOUND:
            break
        tables += 1
    return tables, joined


def _float(df: DataFrame, vector_col: str) -> str:
    """What vectors travel as: single precision if that is what they are in, else double."""
    return "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"


def _classes(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows with the hash of their class, null if they link with nothing; and the classes."""
    v = F.col("v")
    whole = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = _float(df, vector_col)
    rows = df.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col).cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind)).alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumn("class", F.when(F.coalesce(whole, F.lit(False)), F.sha2(F.to_json(F.struct("label", "v")), 256)))
    rows = materialise(rows, "vectors")
    classes = rows.where("`class` is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("v").alias("v"), F.first("label").alias("label"))
    return rows, classes.withColumn("size", F.size("v"))


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id) of every row. Other columns are ignored; a null id counts as a row but is never a component's name."""
    rows, classes = _classes(df, id_col, vector_col, label_col)

    sizes = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("size").agg(F.max("n").alias("n")).collect()  # a row per dimension
    tables, joined = 3, 2
    for r in sizes:
        t, j = plan(r["size"], r["n"], threshold)
        tables, joined = max(tables, t), max(joined, j)

    def visit(batches):
        for batch in batches:
            at_v = batch.schema.get_field_index("v")
            v, sizes = batch.column(at_v), batch.column(batch.schema.get_field_index("size")).to_numpy()
            flat, at = v.flatten().to_numpy(), v.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            codes: list = [None] * batch.num_rows
            scaled = flat.copy()
            for size in np.unique(sizes):
                who = np.flatnonzero(sizes == size)
                place = at[who][:, None] + np.arange(size)
                x = flat[place]
                x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
                scaled[place] = x
                for i, c in zip(who, bucket_codes(x.astype(np.float64), tables, joined)):
                    codes[i] = c.ravel()
            columns = list(batch.columns)
            columns[at_v] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(scaled))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.list_(pa.int64()))], [*batch.schema.names, "codes"])

    kind = df.schema[label_col].dataType.simpleString()
    id_kind = df.schema[id_col].dataType.simpleString()
    found = materialise(classes.select("class", "n", "least", "label", "size", "v").mapInArrow(visit, f"class string, n long, least {id_kind}, label {kind}, size int, v array<{_float(df, vector_col)}>, codes array<long>"), "classes")
    members = found.select("class", F.explode(F.array_distinct("codes")).alias("code"), "label", "size").select("class", F.xxhash64("label", "size", "code").alias("key"))
    counts = materialise(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    large = counts.where(F.col("n") > block)
    shared = members.join(counts.select("key"), "key", "left_semi")
    # A vector travels to the buckets in which it meets others, no further.
    rows_in = dealt(shared, None if large.isEmpty() else large, "class", block).join(found.select("class", "n", "label", "size", "v", "codes"), "class")
    rows_in = rows_in.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "class")
    own = F.transform("codes", lambda c: F.xxhash64("label", "size", c))
    rows_in = rows_in.select("key", "bi", "bj", "b", "class", "n", "v", own.alias("keys"))

    def compare(batches):
        for table, starts in groups(batches):
            yield _compared(table, starts, threshold, tables)

    seen = materialise(rows_in.mapInArrow(compare, "class string, other string, links long"), "links")
    parts = connected(seen.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    least = materialise(found.select("class", "least", "n").join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")), "least")
    named = materialise(least.groupBy("component").agg(F.min("least").alias("component_id")), "named")
    counted = seen.groupBy("class").agg(F.sum("links").alias("links"))
    result = least.join(named, "component").join(counted, "class", "left").select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "class").join(materialise(result, "components"), "class", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _compared(table: pa.Table, starts: np.ndarray, threshold: float, tables: int) -> pa.RecordBatch:
    """Rows (class, null, links), the vectors linked with a class in these groups, and (class, other, 0), pairs that span the components."""
    key, bi, bj, b, n = (table.column(c).to_numpy() for c in ("key", "bi", "bj", "b", "n"))
    names = table.column("class").to_numpy(zero_copy_only=False)
    v, k = table.column("v").combine_chunks(), table.column("keys").combine_chunks()
    keys = k.flatten().to_numpy().reshape(len(key), -1)
    flat, at = v.flatten().to_numpy().astype(np.float64), v.offsets.to_numpy()
    at = at - at[0]
    links = np.zeros(len(key), dtype=np.int64)
    a, c = [], []
    norm = np.sqrt(np.add.reduceat(flat * flat, at[:-1])) if len(key) else np.zeros(0)
    width = np.diff(at)

    def first_here(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the pair shares no bucket before this one, in the order of x's and y's tables."""
        ok = np.ones(len(x), dtype=bool)
        kx, ky = (keys[z].reshape(len(z), tables, -1) for z in (x, y))
        here = key[x]
        open_ = np.ones(len(x), dtype=bool)  # no shared bucket in the tables so far
        for t in range(tables):
            least = np.full(len(x), np.iinfo(np.int64).max)
            for i in range(kx.shape[2]):
                hit = (kx[:, t, i, None] == ky[:, t]).any(axis=1)
                least[hit] = np.minimum(least[hit], kx[hit, t, i])
            some = least != np.iinfo(np.int64).max
            ok[open_ & some] = least[open_ & some] == here[open_ & some]
            open_ &= ~some
        return ok & ~open_

    def linked(x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(links, x, n[y])
        np.add.at(links, y, n[x])

    def cosines(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What decides at the threshold, whatever group a pair meets in."""
        dots = np.zeros(len(p))
        for w in np.unique(width[p]):
            i = np.flatnonzero(width[p] == w)
            span = np.arange(w)
            dots[i] = np.einsum("ij,ij->i", flat[at[p[i], None] + span], flat[at[q[i], None] + span])
        return dots / (norm[p] * norm[q])

    for x, y in near_pairs(starts, FEW):
        for s in range(0, len(x), 20_000):
            p, q = x[s : s + 20_000], y[s : s + 20_000]
            same = (b[p] != b[q]) | (bi[p] == bj[p])
            p, q = p[same], q[same]
            hit = cosines(p, q) >= threshold
            p, q = p[hit], q[hit]
            once = first_here(p, q) if len(p) else np.zeros(0, bool)
            linked(p[once], q[once])
            a.append(p[once])
            c.append(q[once])
    for g in np.flatnonzero(np.diff(starts) > FEW):
        s, e = int(starts[g]), int(starts[g + 1])
        m = flat[at[s] : at[e]].reshape(e - s, -1)
        cos = (m @ m.T) / (norm[s:e, None] * norm[s:e])
        near = cos >= threshold
        x, y = np.nonzero(np.triu(np.abs(cos - threshold) < 1e-9, 1))  # a product of matrices may round otherwise
        near[x, y] = near[y, x] = cosines(x + s, y + s) >= threshold
        if bi[s] != bj[s]:
            near &= b[s:e, None] != b[s:e]
        np.fill_diagonal(near, False)
        x, y = spanning(near)
        a.append(x + s)
        c.append(y + s)
        for r in range(0, e - s, 64):
            x, y = np.nonzero(np.triu(near, 1)[r : r + 64])
            x, y = x + s + r, y + s
            once = first_here(x, y) if len(x) else np.zeros(0, bool)
            linked(x[once], y[once])
    a, c = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, c))
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([names[some], names[a]]), pa.string()), pa.array(np.concatenate([np.full(len(some), None, object), names[c]]), pa.string()), pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]))],
        ["class", "other", "links"],
    )
