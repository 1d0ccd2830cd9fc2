"""Rules and edge cases of the operators that the driver's tables do not show."""

import pytest
from pyspark.sql import functions as F

from framepack.errors import SchemaError, XmlParseError
from framepack.functions import typed
from framepack.operators import codecs, hints, modes, profile
from framepack.ordered import ordered
from framepack.plans.registry import Field, Schema, SchemaRegistry
from framepack.plans.validate import violations
from framepack.sources import xml


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def column(spark, values, kind):
    return ordered(spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}"), ["i"])


@pytest.mark.parametrize("text,ok", [("2025-01-15", True), ("2024-02-29", True), ("2025-13-01", False), ("2025-01-32", False), ("2023-02-29", False), ("25-01-15", False), ("2025/01/15", False)])
def test_dates(spark, text, ok):
    assert one(spark, typed.is_date(F.lit(text))) is ok


@pytest.mark.parametrize("text,ok", [("10:30:00", True), ("23:59:59", True), ("00:00:00.123", True), ("24:00:00", False), ("10:60:00", False), ("10:30:60", False), ("10:30", False), ("10-30-00", False)])
def test_times(spark, text, ok):
    assert one(spark, typed.is_time(F.lit(text))) is ok


@pytest.mark.parametrize("text,ok", [("2025-01-15T10:30:00Z", True), ("2025-01-15T10:30:00.123Z", True), ("2025-01-15T10:30:00+01:00", True), ("2025-01-15T10:30:00", True), ("2025-01-15", False), ("10:30:00", False), ("2025-01-15 10:30:00", False)])
def test_timestamps(spark, text, ok):
    assert one(spark, typed.is_timestamp(F.lit(text))) is ok


def test_short_uuids(spark):
    zero, full = "00000000-0000-0000-0000-000000000000", "ffffffff-ffff-ffff-ffff-ffffffffffff"
    df = spark.createDataFrame([(zero,), (full,), ("550e8400-e29b-41d4-a716-446655440000",), (None,)], "u string")
    got = df.select("u", typed.short_uuid(F.col("u")).alias("s")).select("u", "s", typed.long_uuid(F.col("s")).alias("b")).collect()
    assert [r["b"] for r in got] == [r["u"] for r in got]
    assert got[0]["s"] == "0" and all(len(r["s"]) <= 22 for r in got if r["s"])


def test_run_lengths(spark):
    t = column(spark, ["a", "a", "a", "b", "b", "c"], "string")
    assert codecs.rle_text(t, "v").first()["text"] == "a*3, b*2, c*1"
    assert codecs.rle_text(t, "v", "|", False).first()["text"] == "a*3|b*2|c"
    assert one(spark, codecs.rle_decoded(F.lit("a*2, b*1"))) == ["a", "a", "b"]
    with pytest.raises(Exception, match="not a run"):
        one(spark, codecs.rle_decoded(F.lit("a*2, b")))
    assert codecs.rle_runs(column(spark, [None, None, "x"], "string"), "v").count() == 2


@pytest.mark.parametrize("parts", [1, 2, 3, 8])
def test_ranges_agree_with_one_window(spark, parts):
    values = [x // 3 % 4 if x % 11 else None for x in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int")
    whole, cut = ordered(df, ["i"]), ordered(df, ["i"], small=0, parts=parts)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(codecs.rle_runs(cut, "v").select("run", "start", "length")) == key(codecs.rle_runs(whole, "v").select("run", "start", "length"))
    assert key(codecs.deltas(cut, "v").fillna(-99)) == key(codecs.deltas(whole, "v").fillna(-99))
    assert key(codecs.dictionary(cut, "v").fillna(-99)) == key(codecs.dictionary(whole, "v").fillna(-99))


def test_deltas_bits_varints(spark):
    assert codecs.delta_text(column(spark, [10, 15, 15, 20, 18], "int"), "v").first()["text"] == "10, +5, +0, +5, -2"
    assert one(spark, codecs.delta_decoded(F.lit("100, +50, -30"))) == [100, 150, 120]
    flags = column(spark, [True, False, True, True, False, False, True, True], "boolean")
    assert codecs.bits_text(flags, F.col("v")).first()["text"] == "10110011"
    assert codecs.hex_text(flags, F.col("v")).first()["text"] == "B3"
    assert one(spark, codecs.hex_decoded(F.lit("A"), F.lit(3))) == [True, False, True]
    for n, size in ((0, 1), (127, 1), (128, 2), (300, 2), (16383, 2), (16384, 3), (1000000, 3), (2**31, 5), (2**62, 9)):
        got = one(spark, codecs.varint_bytes(F.lit(n)))
        assert len(got) == size and one(spark, codecs.varint_value(F.array(*map(F.lit, got)))) == n
    assert one(spark, codecs.varint_bytes(F.lit(300))) == [172, 2]
    with pytest.raises(Exception, match="negative"):
        one(spark, codecs.varint_bytes(F.lit(-1)))


def test_dictionaries(spark):
    t = column(spark, ["Berlin", "Munich", "Berlin", "Hamburg", None], "string")
    assert [r["value"] for r in codecs.dictionary(t, "v").orderBy("idx").collect()] == ["Berlin", "Munich", "Hamburg", None]
    assert [r["idx"] for r in codecs.dictionary_indices(t, "v").orderBy("pos").collect()] == [0, 1, 0, 2, 3]
    with pytest.raises(Exception, match="out of range"):
        one(spark, codecs.dictionary_decoded(F.array(F.lit("a")), F.array(F.lit(1))))
    assert one(spark, codecs.dictionary_decoded(F.array(F.lit("a")), F.array(F.lit(1)), False)) == [""]


def test_type_fold_depends_on_order(spark):
    fold = lambda values: profile.infer_type_in_order(column(spark, values, "int"), "v").first()["type"]
    assert [fold([1, -1]), fold([1, -1, 1]), fold([1, -1, 1, 1])] == ["i16", "i32", "i64"]
    assert profile.infer_types(spark.createDataFrame([(1,), (-1,), (1,)], "v int")).first()["type"] == "i8"


def test_modes(spark):
    wide = spark.range(200).selectExpr("id", "id AS value", "id AS score")
    assert modes.select_mode(wide) == "columnar"
    assert modes.select_mode(wide.withColumn("timestamp", F.lit("x"))) == "stream"
    assert modes.select_mode(wide.limit(50).selectExpr("id", "nullif(1, 1) AS a", "nullif(1, 1) AS b")) == "sparse"
    assert modes.select_mode(wide.limit(3)) == "compact" and modes.select_mode(wide.limit(0)) == "compact"
    assert modes.select_mode(wide, "stream") == "stream"
    with pytest.raises(ValueError):
        modes.select_mode(wide, "other")


def test_hints(spark):
    df = spark.createDataFrame([(1, "a", "x@y", 5, "2025", 1.5, 2), (2, "b", "z@y", 5, "2025", 2.5, 3)], "id int, name string, email string, customer_id int, created string, revenue double, quantity int")
    got = {r["type"]: r["fields"] for r in hints.query_hints(df).collect()}
    assert got == {"primary": ["id"], "search": ["name", "email"], "timeseries": ["created"], "aggregate": ["revenue", "quantity"], "join": ["id", "customer_id"], "index": ["id", "created", "customer_id"]}
    assert hints.detect_primary_key(spark.createDataFrame([(1, "a"), (1, "b")], "id int, name string")) == "name"
    assert hints.detect_primary_key(spark.createDataFrame([(1, "a"), (1, "a")], "value int, other string")) is None


def test_schemas(spark):
    r = SchemaRegistry()
    r.register(Schema("base", (Field("id", "i32"), Field("name", "str"))))
    r.register(Schema("admin", (Field("level", "u8"),), extends="base"))
    assert [f.name for f in r.resolved("admin").fields] == ["id", "name", "level"]
    for bad in (Schema("", (Field("a", "str"),)), Schema("x", ()), Schema("x", (Field("a", "str"), Field("a", "str")))):
        with pytest.raises(SchemaError):
            r.register(bad)
    r.register(Schema("loop", (Field("a", "str"),), extends="loop"))
    with pytest.raises(SchemaError):
        r.resolved("loop")
    df = spark.createDataFrame([(0, 127, "a"), (1, 300, None), (2, None, "b")], "i int, id int, name string")
    got = violations(df, Schema("t", (Field("id", "u8"), Field("name", "str", optional=True))), ["i"]).orderBy("pos").collect()
    assert [(x["path"], x["actual"]) for x in got] == [("[1].id", "300"), ("[2].id", "null")]


def test_xml(spark):
    text = '<?xml version="1.0" encoding="UTF-8"?><a x="1"><b>t</b><b>u</b><b/>tail &amp;quot;<c><![CDATA[<z>]]></c></a>'
    doc = xml.parse(text)
    assert xml.serialize(doc, pretty=False, newline="") == text
    assert xml.document_to_xml(xml.xml_to_document(text), pretty=False, newline="") == text
    assert "encoding" not in xml.document_to_xml(xml.xml_to_document('<?xml version="1.0"?><a/>'))
    for bad in ("<a>", "<a></b>", "<a x=1/>", "", '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>'):
        with pytest.raises(XmlParseError):
            xml.parse(bad)
    kept = xml.parse("<?xml version='1.0' standalone='yes'?><!--c--><?p d?><!DOCTYPE a PUBLIC 'p' 's'><a/>", preserve_comments=True, preserve_instructions=True)
    assert (kept["comments"], kept["standalone"], kept["doctype"]["public"], kept["instructions"][0]["target"]) == (["c"], True, "p", "p")
    items = "".join(f"<item id='{i}'><name>n</name></item>" for i in range(20))
    df = spark.createDataFrame([(1, f"<r>{items}</r>"), (2, "<r>text <b>x</b> more</r>"), (3, "<r><a/></r>"), (4, None)], "i int, x string")
    got = {r["i"]: (r["mode"], r["reduction"]) for r in xml.analysis(xml.nodes(df, "i", "x"), "i").collect()}
    assert got == {1: ("xml-compact", 65), 2: ("xml-mixed", 25), 3: ("xml-nested", 40)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "i int, v double, s string")
    assert profile.summary_stats(df).count() == 0
    assert profile.field_stats(df, "v").first()["count"] is None
    assert profile.sparsity(df).first()["ratio"] is None
    assert hints.query_hints(df).count() == 0
    assert {r["type"] for r in profile.infer_types(df).collect()} == {"str"}
    assert codecs.rle_runs(ordered(df, ["i"]), "s").count() == 0
