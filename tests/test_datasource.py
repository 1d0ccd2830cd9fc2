"""The data source keeps what is there and loses nothing."""

import decimal
import os

import pytest
from pyspark.sql import functions as F

from framepack.sources import datasource, grammar, writer


def files(path):
    return sorted(f for f in os.listdir(path) if f.endswith(".fp"))


def test_append_and_overwrite(spark, tmp_path):
    datasource.register(spark)
    path = str(tmp_path / "t")

    def put(df, mode):
        df.write.format("framepack").mode(mode).option("rows", 4).save(path)

    read = lambda: sorted(r["id"] for r in spark.read.format("framepack").schema("id long").load(path).collect())
    put(spark.range(10).repartition(2), "append")
    assert read() == list(range(10)) and len(files(path)) >= 3
    put(spark.range(100, 105), "append")
    put(spark.range(100, 105), "append")
    assert read() == sorted([*range(10), *range(100, 105), *range(100, 105)])
    put(spark.range(2).coalesce(1), "overwrite")
    assert read() == [0, 1] and len(files(path)) == 1


def test_failed_write_leaves_what_was_there(spark, tmp_path):
    datasource.register(spark)
    path = str(tmp_path / "t")
    spark.range(5).write.format("framepack").mode("append").save(path)
    bad = spark.range(100).repartition(4).select(F.expr("if(id = 77, raise_error('no'), id)").cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("framepack").mode("overwrite").save(path)
    assert sorted(r["id"] for r in spark.read.format("framepack").schema("id long").load(path).collect()) == list(range(5))
    assert all(f.startswith((".part", "part", "_")) for f in os.listdir(path)) and len(files(path)) <= 5  # tasks stopped late may leave hidden files


def test_decimals_and_documents(spark, tmp_path):
    rows = [(1, decimal.Decimal("12345678901234567.8901"), "a|b\tc"), (2, decimal.Decimal("1.5000"), None), (3, None, "")]
    df = spark.createDataFrame(rows, "id long, d decimal(30,4), s string")
    datasource.save(df, f"file://{tmp_path}/docs", rows=2)
    assert sorted(map(tuple, datasource.load(spark, f"file://{tmp_path}/docs", df.schema).collect())) == rows
    datasource.save(df.where("id < 0"), f"file://{tmp_path}/none")
    assert datasource.load(spark, f"file://{tmp_path}/none", df.schema).count() == 0


@pytest.mark.parametrize("delimiter", ["|", ",", "\t"])
def test_delimiters_round_trip(spark, delimiter):
    rows = [(i, None if i % 4 == 0 else f"n\t{i}|,", float(i) / 4, i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, s string, x double, b boolean")
    for options in ({}, {"compression": True}):
        text = writer.encode(df, ["id"], "t", mode="compact", delimiter=delimiter, **options)
        assert [tuple(r.values()) for r in grammar.decode(text)["t"]] == rows
