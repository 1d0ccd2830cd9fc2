"""Token counts of documents in flat token files, found by scanning for the end-of-document id.

A flat file is nothing but ids, little-endian, 2 or 4 bytes each: no index says where documents begin. It is read in blocks. One pass searches
each block for separators; a block's first document may have begun blocks before, so its length and number need the ids since the last
separator and the separators so far: a running maximum and a running sum over the blocks of a file. Those prefix scans run in two levels,
within runs of blocks and then over runs, so that no task holds all blocks of a long file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framepack.llm.bpe import codec, slices
from framepack.llm.common import materialise

#: Ids in a block, and blocks in a run of the prefix scan.
BLOCK, RUN = 1 << 16, 4096


def flatten(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Flat token streams of all texts, one per task, in blocks: rows (file, block, payload), and rows (file, ordinal, id) that name the
    documents in their order. Each document is its ids and end_id; strings of special tokens in a text are ordinary text, so end_id ends
    documents and nothing else. A null text is empty."""
    kind = df.schema[id_col].dataType.simpleString()
    dtype, names = f"<u{width}", ["file", "block", "payload", "ordinal", "id"]
    id_type = to_arrow_type(df.schema[id_col].dataType)

    def run(batches):
        c = codec(path, False)
        file, block, ordinal, held = TaskContext.get().partitionId(), 0, 0, np.zeros(0, dtype)

        def blocks(ids, last):
            nonlocal block
            n = len(ids) if last else len(ids) // BLOCK * BLOCK
            data = [ids[i : min(i + BLOCK, n)].tobytes() for i in range(0, n, BLOCK)]
            rows = pa.RecordBatch.from_arrays([pa.array([file] * len(data), pa.int64()), pa.array(range(block, block + len(data)), pa.int64()), pa.array(data, pa.binary()), pa.nulls(len(data), pa.int64()), pa.nulls(len(data), id_type)], names)
            block += len(data)
            return rows, ids[n:]

        for batch in batches:
            for part in slices(batch, "text"):
                ids, n = c.encode(part.column(1).to_pylist())
                if max(int(ids.max(initial=0)), end_id) >= 1 << 8 * width:
                    raise ValueError(f"ids do not fit into {width} bytes")
                flat = np.insert(ids.astype(dtype), np.cumsum(n), end_id)
                rows, held = blocks(np.concatenate([held, flat]), False)
                yield rows
                m = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([file] * m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(range(ordinal, ordinal + m), pa.int64()), part.column(0)], names)
                ordinal += m
        yield blocks(held, True)[0]

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"file long, block long, payload binary, ordinal long, id {kind}")


def read_files(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Blocks (file, block, payload) of flat token files; file is the path. Each file is read by one task, which cuts it into blocks."""
    size = BLOCK * width
    files = spark.read.format("binaryFile").load(path)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("length") / size).cast("int") - 1)), lambda b: F.struct(b.cast("long").alias("block"), F.substring(F.col("content"), b * size + 1, F.lit(size)).alias("payload")))
    return files.select(F.col("path").alias("file"), F.inline(cut))


def scan(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in blocks(file, block, payload): ids before its separator, which is not counted.

    Ids after a file's last separator are a document without an end; it is returned too, if there are any. Null payloads are empty.
    """
    kind = blocks.schema["file"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_py() or b"", dtype=f"<u{width}")
                ends = np.flatnonzero(ids == end_id)
                out.append((len(ids), ends, np.diff(ends) - 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _, _ in out], pa.int64()), pa.array([int(e[0]) if len(e) else None for _, e, _ in out], pa.int64()), pa.array([int(e[-1]) + 1 if len(e) else None for _, e, _ in out], pa.int64()), pa.array([x.astype(np.int64) for _, _, x in out], pa.list_(pa.int64()))],
                ["file", "block", "n", "head", "last", "inner"],
            )

    found = blocks.select("file", "block", "payload").mapInArrow(run, f"file {kind}, block long, n long, head long, last long, inner array<long>")
    found = found.select("*", F.expr(f"block div {RUN}").alias("run"), F.when(F.col("head").isNull(), 0).otherwise(F.size("inner") + 1).cast("long").alias("seps"))
    own = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    near = found.select("*", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("at"), F.coalesce(F.sum("seps").over(own), F.lit(0)).alias("nth"))
    near = near.withColumn("past", F.max(F.col("at") + F.col("last")).over(own))
    runs = near.groupBy("file", "run").agg(F.sum("n").alias("rn"), F.sum("seps").alias("rs"), F.max(F.col("at") + F.col("last")).alias("rl"))
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("*", F.coalesce(F.sum("rn").over(over), F.lit(0)).alias("r_at"), F.coalesce(F.sum("rs").over(over), F.lit(0)).alias("r_nth"))
    runs = runs.withColumn("r_past", F.coalesce(F.max(F.col("r_at") + F.col("rl")).over(over), F.lit(0))).select("file", "run", "r_at", "r_nth", "r_past")
    whole = near.join(runs, ["file", "run"])
    begun = F.col("r_at") + F.col("at") - F.coalesce(F.col("r_at") + F.col("past"), F.col("r_past"))  # ids since the last separator
    closed = whole.where("head is not null").select("file", (F.col("r_nth") + F.col("nth")).alias("first"), F.concat(F.array(begun + F.col("head")), F.col("inner")).alias("lens"))
    closed = closed.select("file", "first", F.posexplode("lens").alias("k", "n_tokens")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens")
    total = whole.groupBy("file").agg(F.sum("n").alias("n"), F.sum("seps").alias("ordinal"), F.coalesce(F.max(F.col("r_at") + F.col("at") + F.col("last")), F.lit(0)).alias("end"))
    return closed.union(total.where("n > end").select("file", "ordinal", (F.col("n") - F.col("end")).alias("n_tokens")))


def count_tokens(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, file, ordinal) of every row: its text is flattened to token streams, written, and counted by the scan alone."""
    flat = materialise(flatten(df, path, end_id, id_col, text_col), "tokens")
    names = flat.where("ordinal is not null").select("file", "ordinal", "id")
    counts = scan(flat.where("payload is not null").select("file", "block", "payload"), end_id)
    return names.join(counts, ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens", "file", "ordinal")
