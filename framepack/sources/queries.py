"""Queries over text formats, XML and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepack.folders import new_path
from framepack.sources import datasource, documents, writer, xml
from framepack.streaming import blocks

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'null' WHEN regexp_full_match({c}, '[A-Za-z_][A-Za-z0-9_.\\-]*') AND {c} NOT IN ('true', 'false', 'null') THEN {c} ELSE '\"' || replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '\"' END"


_NAMES = _cell_sql("n_name")


@query(f"SELECT n_nationkey::BIGINT AS ord, '  ' || n_nationkey || '|' || {_NAMES} || '|' || n_regionkey AS line FROM nation UNION ALL SELECT -1, 'nations::[' || count(*) || '] n_nationkey:u8|n_name:str|n_regionkey:u8' FROM nation")
def compact_lines_nation(spark, sf_dir):
    return writer.encoded_lines(_table(spark, sf_dir, "nation"), ["n_nationkey"], "nations", "compact")


@query(f"SELECT -1::BIGINT AS ord, 'nations::[' || count(*) || ']@columnar {{' AS line FROM nation UNION ALL SELECT 0, '  n_nationkey:u8: [' || string_agg(n_nationkey, ', ' ORDER BY n_nationkey) || ']' FROM nation UNION ALL SELECT 1, '  n_name:str: [' || string_agg({_NAMES}, ', ' ORDER BY n_nationkey) || ']' FROM nation UNION ALL SELECT 2, '  n_regionkey:u8: [' || string_agg(n_regionkey, ', ' ORDER BY n_nationkey) || ']' FROM nation UNION ALL SELECT 3, '}}'")
def columnar_lines_nation(spark, sf_dir):
    return writer.encoded_lines(_table(spark, sf_dir, "nation"), ["n_nationkey"], "nations", "columnar")


_DOC = f"'  ' || doc_id || '|' || {_cell_sql('text')} || '|' || {_cell_sql('lang')}"


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, {_DOC} AS line FROM documents UNION ALL SELECT -1, 'docs::[' || count(*) || ']@stream doc_id|text|lang' FROM documents")
def stream_lines_documents(spark, sf_dir):
    return writer.encoded_lines(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"], "docs", "stream")


@query(f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS ord, '  ' || event_id || '|' || CASE WHEN event_id % 3 = 0 THEN {_cell_sql('event_type')} ELSE '' END AS line FROM events UNION ALL SELECT -1, 'events::[' || count(*) || ']@sparse event_id|kind?' FROM events")
def sparse_lines_events(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"))
    return writer.encoded_lines(df, ["event_id"], "events", "sparse")


@query("SELECT 'lines' AS kind, count(*) + 1 AS n FROM orders")
def compact_lines_orders_by_ranges(spark, sf_dir):
    return writer.encoded_lines(_table(spark, sf_dir, "orders"), ["o_orderkey"], "orders", "compact").agg(F.count(F.lit(1)).alias("n")).select(F.lit("lines").alias("kind"), "n")


_CSV = "CASE WHEN regexp_matches({0}, '[,\"]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query(f"SELECT doc_id || ',' || {_CSV.format('text')} || ',' || source AS line FROM documents")
def csv_lines_documents(spark, sf_dir):
    return writer.csv_lines(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _round_trip(spark, df: DataFrame, key: str, mode: str, compression: bool = False) -> DataFrame:
    """The rows of a table after it was written as documents, of the size that a task holds, and read again."""
    return datasource.decoded_rows(writer.encoded_documents(df, [key], "t", mode=mode, compression=compression), df.schema, "block")


@query("SELECT * FROM customer")
def roundtrip_compact_customer(spark, sf_dir):
    return _round_trip(spark, _table(spark, sf_dir, "customer"), "c_custkey", "compact")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderstatus = 'F' AS filled FROM orders")
def roundtrip_compressed_orders(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("filled"))
    return _round_trip(spark, df, "o_orderkey", "compact", True)


@query("SELECT page_id, url, html FROM pages")
def roundtrip_columnar_pages(spark, sf_dir):
    return _round_trip(spark, _table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id", "columnar")


@query("SELECT doc_id, text, lang FROM documents")
def roundtrip_stream_documents(spark, sf_dir):
    return _round_trip(spark, _table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", "stream")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS value, CASE WHEN event_id % 5 = 0 THEN props END AS props FROM events")
def roundtrip_sparse_events(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 == 0, F.col("props")).alias("props"))
    return _round_trip(spark, df, "event_id", "sparse")


@query("SELECT p_partkey, p_name, p_size::BIGINT AS p_size, p_retailprice FROM part")
def datasource_roundtrip_part(spark, sf_dir):
    datasource.register(spark)
    path = new_path(spark, "query")
    df = _table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").cast("long"), "p_retailprice")
    df.write.format("framepack").mode("append").save(path)
    return spark.read.format("framepack").schema("p_partkey long, p_name string, p_size long, p_retailprice double").load(path)


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def datasource_append_nation(spark, sf_dir):
    datasource.register(spark)
    path, df = new_path(spark, "query"), _table(spark, sf_dir, "nation")
    df.select("n_nationkey", "n_name").repartition(3).write.format("framepack").mode("append").save(path)
    df.where("n_regionkey = 1").select((F.col("n_nationkey") + 100).alias("n_nationkey"), "n_name").write.format("framepack").mode("append").save(path)
    return spark.read.format("framepack").schema("n_nationkey long, n_name string").load(path)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
def datasource_overwrite_supplier(spark, sf_dir):
    datasource.register(spark)
    path, df = new_path(spark, "query"), _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    df.repartition(4).write.format("framepack").mode("append").save(path)
    df.where("s_suppkey % 2 = 0").coalesce(1).write.format("framepack").mode("overwrite").save(path)
    return spark.read.format("framepack").schema("s_suppkey long, s_name string, s_acctbal double").load(path)


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def documents_roundtrip_customer(spark, sf_dir):
    path = new_path(spark, "query")
    datasource.save(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path, "customer", rows=100)
    return datasource.load(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def nested_roundtrip_conversations(spark, sf_dir):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text")))
    made = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.lit("x").alias("kind"), turns.alias("turns"))).alias("j"))
    back = made.select("conv_id", documents.decoded_json(documents.encoded(F.col("j"))).alias("j"))
    v = F.from_json("j", "kind string, turns array<struct<turn:long,role:string,text:string>>")
    return back.select("conv_id", v["turns"].alias("t")).select("conv_id", F.size("t").cast("long").alias("turns"), F.array_join("t.role", ",").alias("roles"))


@query("SELECT n_nationkey, count(*) AS n FROM (SELECT n_nationkey, unnest(['WORD', ':', 'NUMBER', 'END']) FROM nation) GROUP BY 1")
def tokens_nation(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("key: "), F.col("n_nationkey").cast("string"), F.lit(" # a comment")).alias("t"))
    return documents.tokens(df, "n_nationkey", "t").groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name AS a, n_regionkey AS b FROM nation")
def rows_from_columns_nation(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").groupBy("n_nationkey").agg(F.collect_list("n_name").alias("a"), F.collect_list("n_regionkey").alias("b"))
    return documents.rows_from_columns(df, "a", "b")


def _xml(spark, sf_dir) -> DataFrame:
    """A region and its nations as an XML document."""
    item = F.concat(F.lit('<nation key="'), F.col("n_nationkey").cast("string"), F.lit('"><name>'), "n_name", F.lit("</name></nation>"))
    nations = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("x")))), lambda s: s["x"]), "").alias("x"))
    return nations.select("n_regionkey", F.concat(F.lit('<?xml version="1.0"?><region xmlns:r="urn:r">'), "x", F.lit("</region>")).alias("xml"))


@query("SELECT n_regionkey, 1 + 2 * count(*) AS elements, count(*) AS texts FROM nation GROUP BY 1")
def xml_nodes_nation(spark, sf_dir):
    tree = xml.nodes(_xml(spark, sf_dir), "n_regionkey", "xml")
    return tree.groupBy("n_regionkey").agg(F.sum(F.when(F.col("kind") == "element", 1).otherwise(0)).cast("long").alias("elements"), F.count("text").alias("texts"))


@query("SELECT n_regionkey, 1 + 2 * count(*) AS element_count, 2 AS max_depth, false AS has_mixed_content, false AS has_cdata, true AS has_namespaces, true AS has_attributes, count(*) >= 2 AS has_uniform_children, round(2 * count(*) / (1 + 2 * count(*)), 6)::DOUBLE AS avg_children, 'name,nation,region' AS names, CASE WHEN count(*) >= 2 AND 1 + 2 * count(*) > 10 THEN 'xml-compact' ELSE 'xml-nested' END AS mode, CASE WHEN count(*) >= 2 AND 1 + 2 * count(*) > 10 THEN 65 WHEN 1 + 2 * count(*) < 10 THEN 40 ELSE 45 END AS reduction FROM nation GROUP BY 1")
def xml_analysis_nation(spark, sf_dir):
    found = xml.analysis(xml.nodes(_xml(spark, sf_dir), "n_regionkey", "xml"), "n_regionkey")
    return found.withColumns({"names": F.array_join("names", ","), "avg_children": F.round("avg_children", 6)})


@query("SELECT n_regionkey, true AS same FROM nation GROUP BY 1")
def xml_document_roundtrip_nation(spark, sf_dir):
    return _xml(spark, sf_dir).select("n_regionkey", (xml.texts(xml.documents(F.col("xml"))) == F.col("xml")).alias("same"))


@query("SELECT n_regionkey, 1 + 2 * count(*) > 0 AS ok FROM nation GROUP BY 1")
def xml_report_nation(spark, sf_dir):
    found = xml.analysis(xml.nodes(_xml(spark, sf_dir), "n_regionkey", "xml"), "n_regionkey")
    return found.select("n_regionkey", xml.report(found).startswith("XML analysis\nlayout: xml-").alias("ok"))


@query("SELECT n_regionkey, xml_tokens, round(xml_tokens * (1 - r / 100.0))::BIGINT AS document_tokens, r AS reduction FROM (SELECT n_regionkey, (2 * (2 + 4 * count(*)) + 2 * (2 + count(*)) + 2 + count(*) + sum(len(list_filter(regexp_split_to_array(n_name, ' '), lambda x: x <> ''))))::BIGINT AS xml_tokens, CASE WHEN count(*) >= 2 AND 1 + 2 * count(*) > 10 THEN 65 WHEN 1 + 2 * count(*) < 10 THEN 40 ELSE 45 END AS r FROM nation GROUP BY 1)")
def xml_token_reduction_nation(spark, sf_dir):
    return xml.token_reduction(_xml(spark, sf_dir), "n_regionkey", "xml")


@query("SELECT n_nationkey, 'rle' AS type, 'c' AS field, n_name || '*2' AS data, true AS none FROM nation")
def directives_nation(spark, sf_dir):
    from framepack.operators.codecs import parsed_directive

    line = parsed_directive(F.concat(F.lit("@rle:c "), "n_name", F.lit("*2")))
    return _table(spark, sf_dir, "nation").select("n_nationkey", line["type"].alias("type"), line["field"].alias("field"), line["data"].alias("data"), parsed_directive(F.lit("@other:c x")).isNull().alias("none"))


@query("SELECT page_id, html FROM pages")
def json_scan_pages(spark, sf_dir):
    path = new_path(spark, "query")
    _table(spark, sf_dir, "pages").select("page_id", "html").write.mode("overwrite").json(path)
    return spark.read.schema("page_id long, html string").json(path)


def _streamed(spark, sf_dir, columns: list[str]) -> DataFrame:
    df = _table(spark, sf_dir, "events").select(*columns)
    path = new_path(spark, "query")
    df.repartition(3).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _run(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    name = "t" + uuid.uuid4().hex
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", new_path(spark, "query")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _stored(spark, stream: DataFrame) -> DataFrame:
    """All rows that a stream appends, by way of files in the shared folder: the driver holds none."""
    path = new_path(spark, "query")
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", new_path(spark, "query")).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("SELECT event_id, user_id, value, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS delta FROM events")
def streaming_deltas_events(spark, sf_dir):
    found = _stored(spark, blocks.running_deltas(_streamed(spark, sf_dir, ["user_id", "event_id", "value"]), "user_id", "event_id", "value"))
    return found.select("event_id", "user_id", "value", F.round("delta", 6).alias("delta"))


@query("SELECT user_id, run::BIGINT AS run, value, length FROM (SELECT user_id, run, any_value(event_type) AS value, count(*) AS length, max(run) OVER (PARTITION BY user_id) AS last FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) OR lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL THEN 1 ELSE 0 END AS c FROM events)) GROUP BY user_id, run) WHERE run < last")
def streaming_runs_events(spark, sf_dir):
    return _stored(spark, blocks.closed_runs(_streamed(spark, sf_dir, ["user_id", "event_id", "event_type"]), "user_id", "event_id", "event_type"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(value) AS n, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def streaming_windows_events(spark, sf_dir):
    stream = _streamed(spark, sf_dir, ["event_type", "ts", "value"]).withColumn("ts", F.col("ts").cast("timestamp"))
    found = _run(spark, blocks.windowed_stats(stream, "ts", "value", "1 hour", "10 minutes", "event_type"), "complete")
    return found.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", F.round("sum", 4).alias("sum"), "min", "max")


@query("SELECT count(*) AS n FROM events")
def streaming_blocks_events(spark, sf_dir):
    out = new_path(spark, "query")
    q = blocks.encode_batches(_streamed(spark, sf_dir, ["event_id", "event_type", "value"]), out, ["event_id"], new_path(spark, "query"), "events")
    q.awaitTermination()
    read = spark.read.text(out, wholetext=True).where("value <> ''").select(documents.decoded_json(F.col("value")).alias("j"))
    return read.agg(F.sum(F.size(F.from_json("j", "events array<struct<event_id:long>>").getField("events"))).cast("long").alias("n"))
