"""Rows in a given order, without a task that holds them all.

Codecs depend on row order, which DataFrames do not have: every positional operator takes the columns to order by, and optionally groups
within which positions count. A large table without groups is cut into ranges of the order, one per partition, and written out. Positions,
previous values and running sums are then computed within ranges and corrected by a table of one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framepack.folders import new_path

#: Tables up to this many rows are ordered by one window.
SMALL = 200_000


def _written(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession, "ordered")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Ordered:
    """A table with pos, the 0-based position within its group, and, if it was cut into ranges, part, the range."""

    df: DataFrame
    by: tuple[str, ...] = ()
    cut: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def _window(self):
        keys = [*self.by, *["part"] * self.cut]
        return Window.partitionBy(*keys or [F.lit(0)]).orderBy("pos")

    def with_df(self, df: DataFrame) -> Ordered:
        return Ordered(df, self.by, self.cut)

    def previous(self, value: Column, into: str) -> Ordered:
        """Adds the value of the row before; null in the first."""
        df = self.df.withColumn("__v", value)
        out = df.withColumn(into, F.lag("__v").over(self._window()))
        if self.cut:
            last = _shifted(df.groupBy("part").agg(F.max_by("__v", "pos").alias("__last")), "__last")
            out = out.join(F.broadcast(last), "part", "left").withColumn(into, F.when(F.row_number().over(self._window()) == 1, F.col("__last")).otherwise(F.col(into))).drop("__last")
        return self.with_df(out.drop("__v"))

    def running(self, value: Column, into: str) -> Ordered:
        """Adds the sum of the values up to and with the row."""
        df = self.df.withColumn("__v", value)
        out = df.withColumn(into, F.sum("__v").over(self._window().rowsBetween(Window.unboundedPreceding, 0)))
        if self.cut:
            sums = df.groupBy("part").agg(F.sum("__v").alias("__s"))
            sums = sums.withColumn("__before", F.coalesce(F.sum("__s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
            out = out.join(F.broadcast(sums), "part").withColumn(into, F.col(into) + F.col("__before")).drop("__before")
        return self.with_df(out.drop("__v"))

    def runs(self, value: str, into: str = "run") -> Ordered:
        """Adds the number of the run of equal values (nulls are equal) that the row lies in, from 0."""
        seen = self.previous(F.struct(value), "__p")
        changed = F.when((F.col("pos") > 0) & F.struct(value).eqNullSafe(F.col("__p")), 0).otherwise(1)
        out = seen.running(changed.cast("long"), into)
        return out.with_df(out.df.withColumn(into, F.col(into) - 1).drop("__p"))


def _shifted(per_part: DataFrame, value: str) -> DataFrame:
    """Each range's value moved to the next range; the table has a row per range."""
    return per_part.withColumn(value, F.lag(value).over(Window.orderBy("part")))


def ordered(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), small: int = SMALL, parts: int | None = None) -> Ordered:
    """Positions of df's rows by order_by, which should be unique (ties are put in any order), within groups of partition_by."""
    by = list(partition_by)
    if by or df.count() <= small:
        w = Window.partitionBy(*by or [F.lit(0)]).orderBy(*order_by)
        return Ordered(df.withColumn("pos", (F.row_number().over(w) - 1).cast("long")), tuple(by))
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = _written(df.repartitionByRange(n, *order_by).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__at", F.coalesce(F.sum("__n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    w = Window.partitionBy("part").orderBy(*order_by)
    df = ranged.withColumn("pos", F.row_number().over(w).cast("long") - 1).join(F.broadcast(before), "part").withColumn("pos", F.col("pos") + F.col("__at")).drop("__at")
    return Ordered(df, (), True)
