"""Shared pieces: the shared folder, written tables, value binding in expressions, and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a fresh temporary folder if all runs on one machine, as in
    tests; a cluster has no folder to share then, so that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="framepack-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and a lost executor costs no recomputation. The
    shuffle files of the write are deleted with its end. The table stays until discard() or the end of the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written[path] = spark
    out = spark.read.schema(schema).parquet(path)
    out.written_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables that materialise() returned and no later step reads."""
    for df in frames:
        spark = _written.pop(df.written_path, None)
        if spark is not None:
            _delete(spark, df.written_path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is already gone
            return


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bind(value: Column, use) -> Column:
    """use(value) with value computed once per row: a lambda variable holds it, so no later projection repeats the work."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def connected(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Components of the undirected graph edges(a, b): rows (node, component), component being the least node reachable.

    Alternates large-star and small-star steps: each turns a node's neighbourhood into a star around its least member, so the number of
    rounds grows with the logarithm of the node count. Minima are pre-aggregated before the shuffle and joined back, so that a hub's
    edges may be split over tasks. Each round is written to the shared folder. Nodes without edges do not appear. Nulls and loops are ignored.
    """
    cur = materialise(_clean_edges(edges), "edges")
    last = None
    for _ in range(rounds):
        new = materialise(_small_star(_large_star(cur)), "edges")
        digest = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(cur)
        cur = new
        if tuple(digest) == last:
            break
        last = tuple(digest)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _clean_edges(edges: DataFrame) -> DataFrame:
    """Each edge once, from the greater to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Connects each node's greater neighbours to the least of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connects each node's smaller neighbours, and the node itself, to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    moved = edges.join(least, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
