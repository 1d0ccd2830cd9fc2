"""SimHash near-duplicates, searched with deletion-variant signatures.

A fingerprint has a bit set where over half the 64-bit hashes of a text's word shingles have it. Two fingerprints within 4 bits are linked.
Cut into 3 segments, two linked fingerprints differ by at most one bit in some segment: so each segment is indexed once for every bit
position with that bit left out (a one-wildcard variant), equal variants are joined, and the whole fingerprints are compared. Equal
fingerprints are one class throughout, and a bucket's verified links go on as a spanning forest, so groups of copies stay linear in size.

Texts are lower-cased for A-Z, words are separated by ASCII white space. Fewer words than a shingle has are one shingle; a text without
words, or null, has fingerprint 0 and links like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepack.llm.bpe import slices
from framepack.llm.buckets import BLOCK, dealt, groups, near_pairs, spanning
from framepack.llm.common import connected, discard, materialise

#: (lowest bit, bits) of the segments; one more bit may differ in all than there are segments, plus one.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
BITS = 4
#: Groups up to this size are compared pair by pair, larger ones by matrix.
FEW = 48


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 8192):
        counts += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp, text_hash) of every row; fp is the fingerprint as a signed long. Other columns are ignored."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), part.column(2)], ["id", "fp", "text_hash"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).mapInArrow(run, f"id {kind}, fp long, text_hash long").withColumnRenamed("id", id_col)


def _variants(fps: DataFrame) -> DataFrame:
    """(fp, key) of all one-wildcard variants of all segments: the key is the wildcard's bit and what is left of its segment."""
    bit = F.col("bit")
    low = F.when(bit < SEGMENTS[1][0], SEGMENTS[0][0]).when(bit < SEGMENTS[2][0], SEGMENTS[1][0]).otherwise(SEGMENTS[2][0])
    size = F.when(bit < SEGMENTS[2][0], SEGMENTS[0][1]).otherwise(SEGMENTS[2][1])
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select("fp", _key(F.col("fp"), bit, low, size).alias("key"))


def _key(fp, bit, low, size):
    one = F.lit(1).cast("long")
    segment = F.call_function("shiftrightunsigned", fp, low).bitwiseAND(F.call_function("shiftleft", one, size) - 1)
    return F.call_function("shiftleft", bit.cast("long"), F.lit(32)).bitwiseOR(segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, bit - low))))


def _large_buckets(fps: DataFrame, block: int) -> DataFrame | None:
    """(key, n) of buckets that may hold more than a block, n an upper bound, from the segments' frequencies; None if there are none.

    A variant's bucket holds the fingerprints of two segment values, the wildcard bit set or not.
    """
    parts = [F.struct(F.lit(i).alias("i"), F.call_function("shiftrightunsigned", F.col("fp"), F.lit(low)).bitwiseAND(F.lit((1 << n) - 1)).alias("v")) for i, (low, n) in enumerate(SEGMENTS)]
    often = fps.select(F.inline(F.array(*parts))).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block // 2)
    often = materialise(often, "often")
    if often.isEmpty():
        return None
    lows, sizes = (F.array(*[F.lit(s[k]) for s in SEGMENTS]) for k in (0, 1))
    low, size = F.get(lows, F.col("i")), F.get(sizes, F.col("i"))
    each = often.select(F.call_function("shiftleft", F.col("v"), low).alias("fp"), "n", low.alias("low"), size.alias("size"), F.explode(F.sequence(low, low + size - 1)).alias("bit"))
    return each.select(_key(F.col("fp"), F.col("bit"), F.col("low"), F.col("size")).alias("key"), "n").groupBy("key").agg((F.sum("n") + block // 2).alias("n"))


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(a, b) that span the components of the distinct fingerprints fps(fp) linked within `bits` (at most 5)."""
    if bits > 5:
        raise ValueError("3 segments find at most 5 differing bits")
    rows = dealt(_variants(fps), _large_buckets(fps, block), "fp", block)
    rows = rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "fp")

    def run(batches):
        for table, starts in groups(batches):
            fp = table.column("fp").to_numpy().view(np.uint64)
            key, bi, bj, b = (table.column(c).to_numpy() for c in ("key", "bi", "bj", "b"))
            out_a, out_b = [], []
            for x, y in near_pairs(starts, FEW):
                diff = fp[x] ^ fp[y]
                ok = (np.bitwise_count(diff) <= bits) & ((b[x] != b[y]) | (bi[x] == bj[x]))
                x, y, diff = x[ok], y[ok], diff[ok]
                ok = _first_bit(diff) == key[x] >> 32  # every other bucket that they share leaves the pair to this one
                out_a.append(fp[x[ok]])
                out_b.append(fp[y[ok]])
            for g in np.flatnonzero(np.diff(starts) > FEW):
                s, e = int(starts[g]), int(starts[g + 1])
                own = fp[s:e]
                linked = np.bitwise_count(own[:, None] ^ own) <= bits
                if bi[s] != bj[s]:
                    linked &= b[s:e, None] != b[s:e]
                np.fill_diagonal(linked, False)
                x, y = spanning(linked)
                out_a.append(own[x])
                out_b.append(own[y])
            a, c = (np.concatenate(z).view(np.int64) if z else np.zeros(0, np.int64) for z in (out_a, out_b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _first_bit(diff: np.ndarray) -> np.ndarray:
    """The wildcard of the first variant that two fingerprints with this difference share."""
    out = np.full(len(diff), 64, dtype=np.int64)
    for low, size in SEGMENTS[::-1]:
        part = (diff >> np.uint64(low)) & np.uint64((1 << size) - 1)
        n = np.bitwise_count(part)
        out[n == 0] = low
        one = n == 1
        out[one] = low + np.bitwise_count(part[one] - np.uint64(1)).astype(np.int64)
    return out


def cluster(prints: DataFrame, id_col: str = "doc_id", bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """prints(id, fp) with class_fp and component_id: a fingerprint that stands for the row's component, and the least id in it. Rows with a
    null id get their component's least id too, null if it has none."""
    classes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    found = connected(links(classes.select("fp"), bits, block))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("class_fp"))
    named = materialise(named, "named")
    per = materialise(named.groupBy("class_fp").agg(F.min("least").alias("component_id")), "least")  # a join of its own, which may split a hub
    out = materialise(named.select("fp", "class_fp").join(per, "class_fp"), "components")
    discard(classes, named, per)
    return prints.join(out, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = BITS) -> DataFrame:
    """(id, fp, text_hash, class_fp, component_id) of every row."""
    return cluster(materialise(fingerprints(df, id_col, text_col, shingle), "prints"), id_col, bits)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = BITS) -> DataFrame:
    """One row of each component of df: that of the least id, nulls last; of repeated rows one stays. Columns stay as they are."""
    found = materialise(near_duplicates(df, id_col, text_col, shingle, bits).select(F.col(id_col).alias("id"), "text_hash", "class_fp"), "near")
    kept = found.groupBy("class_fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("k"))
    kept = materialise(kept.select(F.col("k.id").alias("__id"), F.col("k.text_hash").alias("__h")), "kept")
    out = df.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__h")), "left_semi")
    again = found.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return out if again.isEmpty() else out.dropDuplicates([id_col, text_col])
