"""Tables as several documents: all rows come back, whatever the layout and the cuts."""

import pytest

from framepack.sources import datasource, grammar, writer
from framepack.sources import queries as sources

TEXTS = ["plain", "", "null", "a|b", "|", "line\n", "a\r\n", 'q"b\\', "\\", "x\x85", "~", "12", "@dict:x", "// no", "é\U0001f389", None, "t\tt"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "FOP"[i // 40 % 3], f"{i % 4}-LOW" if i % 7 else None, i % 2 == 0, i / 8 if i % 5 else None, 10**8 + 10 * i) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, s string, run string, kind string, flag boolean, x double, up long")
    return df.repartition(5).cache(), rows


@pytest.mark.parametrize("mode,compression", [("compact", False), ("compact", True), ("columnar", False), ("stream", False), ("sparse", False)])
def test_all_rows_come_back(spark, table, mode, compression):
    df, want = table
    docs = writer.encoded_documents(df, ["id"], "t", mode, compression=compression, rows=90)
    texts = [r["text"] for r in docs.orderBy("block").collect()]
    parts = [grammar.decode(t)["t"] for t in texts]
    assert [tuple(r.values()) for p in parts for r in p] == want
    assert max(map(len, parts)) <= 90
    if compression:
        assert all("@rle:run" in t and "@dict:kind" in t and "@bits:flag" in t and "@delta:up" in t for t in texts)
    assert sorted(map(tuple, datasource.decoded_rows(docs.select("text"), df.schema).collect())) == want


def test_no_rows(spark, table):
    docs = writer.encoded_documents(table[0].where("id < 0"), ["id"], "t", "stream")
    assert docs.count() == 0 and datasource.decoded_rows(docs.select("text"), table[0].schema).count() == 0


def test_a_large_row_stands_alone(spark):
    df = spark.createDataFrame([(i, "x" * (3000 if i == 5 else 10)) for i in range(10)], "id long, s string")
    docs = writer.encoded_documents(df, ["id"], "t", "columnar", rows=100, size=1000)
    parts = [[r["id"] for r in grammar.decode(x["text"])["t"]] for x in docs.orderBy("block").collect()]
    assert sum(parts, []) == list(range(10)) and parts[-1] == [6, 7, 8, 9]


@pytest.mark.parametrize("name", ["roundtrip_sparse_events", "roundtrip_stream_documents", "roundtrip_columnar_pages", "roundtrip_compressed_orders"])
def test_no_document_passes_the_driver(spark, sf_dir, name):
    df = sources.queries()[name](spark, sf_dir)
    assert df.inputFiles()


@pytest.mark.parametrize("name", ["roundtrip_columnar_pages", "roundtrip_compressed_orders"])
def test_documents_are_read_one_at_a_time(spark, sf_dir, name):
    """Arrow batches of whole documents would hold as many as fit in 64 MB, in the JVM and in Python."""
    plan = sources.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapGroupsInArrow", "")


def test_documents_with_a_key(spark):
    texts = spark.createDataFrame([(k, f"t::[2] id:u8|s:str\n  {k}|x\n  {k + 1}|null" if k % 3 else (None if k else "")) for k in range(0, 40, 2)], "block long, text string").repartition(4)
    got = datasource.decoded_rows(texts, "id long, s string", "block").collect()
    want = [(k + i, (None if i else "x")) for k in range(0, 40, 2) if k % 3 for i in (0, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sorted(map(tuple, datasource.decoded_rows(texts.select("text"), "id long, s string").collect())) == sorted(want)
