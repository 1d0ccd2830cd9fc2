"""Queries over the driver's tables: each applies an operator to a whole table. SQL says what it returns, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepack.functions import text, typed
from framepack.operators import advisor, codecs, hints, modes, profile
from framepack.ordered import ordered
from framepack.plans.registry import Field, Schema
from framepack.plans.validate import dangling_references, violations

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
    from framepack.sources import queries as sources

    return _queries | sources.queries()


def oracle_sql() -> dict[str, str]:
    from framepack.sources import queries as sources

    return _sql | sources.oracle_sql()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# -- statistics ----------------------------------------------------------------------------------------------------------------------

_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_EMPTY = "CAST(NULL AS DOUBLE) AS {0}"


def _stats_sql(t: str, columns: list[str], categorical: list[str]) -> str:
    parts = []
    for c in columns:
        if c in categorical:
            nulls = ", ".join(_EMPTY.format(x) for x in ("sum", "avg", "min", "max"))
            parts.append(f"SELECT '{c}' AS field, {nulls}, count(*) AS count, {_EMPTY.format('median')}, {_EMPTY.format('stddev')}, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS \"distinct\" FROM {t}")
        else:
            parts.append(f"SELECT '{c}' AS field, round(sum({c}::DOUBLE), 2) AS sum, round(avg({c}::DOUBLE), 6) AS avg, min({c}::DOUBLE) AS min, max({c}::DOUBLE) AS max, count(*) AS count, median({c}::DOUBLE) AS median, round(stddev_pop({c}::DOUBLE), 6) AS stddev, CAST(NULL AS BIGINT) AS \"distinct\" FROM {t}")
    return _union(parts)


def _stats(df: DataFrame) -> DataFrame:
    return _rounded(_rounded(profile.summary_stats(df), "avg", "stddev"), "sum", digits=2)


@query(_stats_sql("lineitem", _LINEITEM, _LINEITEM[8:]))
def summary_stats_lineitem(spark, sf_dir):
    return _stats(table(spark, sf_dir, "lineitem"))


@query(_stats_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], ["c_name", "c_mktsegment"]))
def summary_stats_customer(spark, sf_dir):
    return _stats(table(spark, sf_dir, "customer"))


@query("SELECT 'o_totalprice' AS field, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 6) AS avg, min(o_totalprice) AS min, max(o_totalprice) AS max, count(o_totalprice) AS count, median(o_totalprice) AS median, round(stddev_pop(o_totalprice), 6) AS stddev, CAST(NULL AS BIGINT) AS \"distinct\" FROM orders")
def field_stats_orders(spark, sf_dir):
    return _rounded(_rounded(profile.field_stats(table(spark, sf_dir, "orders"), "o_totalprice"), "avg", "stddev"), "sum", digits=2)


@query(_union([f"SELECT '{c}' AS field, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS \"distinct\" FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]))
def distinct_counts_orders(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "orders"))


@query("SELECT 'o_custkey' AS field, count(DISTINCT o_custkey) + max(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END) AS \"distinct\" FROM orders")
def distinct_count_custkey(spark, sf_dir):
    return profile.distinct_count(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT coalesce(event_type, 'null') AS value, count(*) AS count FROM events GROUP BY 1")
def distribution_event_type(spark, sf_dir):
    return profile.distribution(table(spark, sf_dir, "events"), "event_type")


_BLOCK = "SELECT '@distribution: {{' || chr(10) || '  {c}: {{' || chr(10) || string_agg('    ' || v || ': ' || n || ',', chr(10) ORDER BY n DESC, f) || chr(10) || '  }}' || chr(10) || '}}' AS text FROM (SELECT {c} AS v, count(*) AS n, min({k}) AS f FROM {t} GROUP BY 1)"


@query(_BLOCK.format(c="event_type", k="event_id", t="events"))
def distribution_block_event_type(spark, sf_dir):
    return profile.format_distribution(table(spark, sf_dir, "events"), "event_type", ["event_id"])


@query("SELECT '@computed: {' || chr(10) || '  c_mktsegment_distinct: ' || count(DISTINCT c_mktsegment) || chr(10) || '  c_nationkey_sum: ' || sum(c_nationkey) || chr(10) || '  c_nationkey_avg: ' || printf('%.2f', avg(c_nationkey)) || chr(10) || '  c_nationkey_min: ' || min(c_nationkey) || chr(10) || '  c_nationkey_max: ' || max(c_nationkey) || chr(10) || '  c_nationkey_count: ' || count(*) || chr(10) || '}' AS text FROM customer")
def computed_block_customer(spark, sf_dir):
    return profile.format_stats(profile.summary_stats(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"]))


def _sparse_events(spark, sf_dir):
    third = F.col("event_id") % 3 == 0
    return table(spark, sf_dir, "events").select("event_id", F.when(third, F.col("event_type")).alias("event_type"), F.when(third, F.col("value")).alias("value"), F.when(third, F.col("props")).alias("props"))


@query("SELECT count(*) AS rows, CAST(3 * count(*) FILTER (event_id % 3 <> 0) AS BIGINT) AS nulls, round(3 * count(*) FILTER (event_id % 3 <> 0) / (count(*) * 4.0), 6)::DOUBLE AS ratio FROM events")
def sparsity_events(spark, sf_dir):
    return _rounded(profile.sparsity(_sparse_events(spark, sf_dir)), "ratio")


# -- logical types -------------------------------------------------------------------------------------------------------------------


def _int_type(low: str, high: str) -> str:
    return f"CASE WHEN {low} >= 0 THEN CASE WHEN {high} <= 255 THEN 'u8' WHEN {high} <= 65535 THEN 'u16' WHEN {high} <= 4294967295 THEN 'u32' ELSE 'u64' END ELSE CASE WHEN {low} >= -128 AND {high} <= 127 THEN 'i8' WHEN {low} >= -32768 AND {high} <= 32767 THEN 'i16' WHEN {low} >= -2147483648 AND {high} <= 2147483647 THEN 'i32' ELSE 'i64' END END"


def _infer_sql(t: str, numbers: list[str], strings: list[str]) -> str:
    parts = [f"SELECT '{c}' AS field, CASE WHEN bool_or({c} <> floor({c})) THEN CASE WHEN bool_or({c} = floor({c})) THEN 'f64' ELSE 'f32' END ELSE {_int_type(f'min({c})', f'max({c})')} END AS type FROM {t}" for c in numbers]
    return _union(parts + [f"SELECT '{c}' AS field, 'str' AS type" for c in strings])


@query(_infer_sql("lineitem", _LINEITEM[:8], _LINEITEM[8:]))
def infer_types_lineitem(spark, sf_dir):
    return profile.infer_types(table(spark, sf_dir, "lineitem"))


@query(_infer_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]))
def infer_types_customer(spark, sf_dir):
    return profile.infer_types(table(spark, sf_dir, "customer"))


@query(f"SELECT o_orderkey, {_int_type('o_custkey', 'o_custkey')} AS key_type, CASE WHEN o_totalprice = floor(o_totalprice) THEN {_int_type('o_totalprice', 'o_totalprice')} ELSE 'f32' END AS price_type, 'str' AS status_type FROM orders")
def value_types_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    kind = lambda c: profile.value_type(F.col(c), df.schema[c].dataType)
    return df.select("o_orderkey", kind("o_custkey").alias("key_type"), kind("o_totalprice").alias("price_type"), kind("o_orderstatus").alias("status_type"))


def _widen_sql() -> str:
    unsigned, signed = ["u8", "u16", "u32", "u64"], ["i8", "i16", "i32", "i64"]
    names = [*unsigned, *signed, "f32", "f64", "bool", "str"]
    rows = []
    for i, a in enumerate(names):
        for b in names:
            num = [x not in ("bool", "str") for x in (a, b)]
            if a == b:
                r = a
            elif num[0] != num[1]:
                r = "str"
            elif not num[0]:
                r = a
            elif "f" in (a[0], b[0]):
                r = "f64"
            elif a[0] == b[0]:
                group = unsigned if a[0] == "u" else signed
                r = group[max(group.index(a), group.index(b))]
            else:
                r = ["i16", "i32", "i64", "i64"][max(unsigned.index(a) if a in unsigned else signed.index(a), unsigned.index(b) if b in unsigned else signed.index(b))]
            rows.append(f"('{a}', '{b}', '{r}')")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(a, b, widened)"


@query(_widen_sql())
def widening_table(spark, sf_dir):
    names = [n for n in (*profile.BITS, "f32", "f64", "bool", "str")]
    return spark.createDataFrame([(a, b, profile.widen(a, b)) for a in names for b in names], "a string, b string, widened string")


@query(f"SELECT user_id, CASE WHEN bool_or(value <> floor(value)) THEN CASE WHEN bool_or(value = floor(value)) THEN 'f64' ELSE 'f32' END ELSE {_int_type('min(value)', 'max(value)')} END AS type FROM events GROUP BY 1")
def infer_type_in_order_events(spark, sf_dir):
    return profile.infer_type_in_order(ordered(table(spark, sf_dir, "events"), ["event_id"], ["user_id"]), "value")


@query("SELECT count(*) AS rows, true AS all_objects, count(DISTINCT list_sort(json_keys(props))) = 1 AS uniform, array_to_string(min(list_sort(json_keys(props))), ',') AS keys FROM events")
def uniformity_events(spark, sf_dir):
    return profile.uniformity(table(spark, sf_dir, "events"), "props")


# -- layout and hints ----------------------------------------------------------------------------------------------------------------


def _mode_sql(t: str, numeric: str, timed: str, sparse: str = "0.0") -> str:
    return f"SELECT CASE WHEN n >= 20 AND {sparse} > 0.5 THEN 'sparse' WHEN n >= 50 AND {timed} THEN 'stream' WHEN n >= 100 AND {numeric} > 0.5 THEN 'columnar' ELSE 'compact' END AS mode, n AS length, n > 0 AS is_uniform, {numeric} > 0.5 AS is_numeric_heavy, {timed} AS has_time_field, {sparse}::DOUBLE AS sparsity_ratio FROM (SELECT count(*) AS n FROM {t})"


def _mode(df: DataFrame, timed: str | None = None) -> DataFrame:
    return _rounded(modes.mode_recommendation(df), "sparsity_ratio").drop("reason")


@query(_mode_sql("lineitem", "8 / 11.0", "true"))
def mode_lineitem(spark, sf_dir):
    return _mode(table(spark, sf_dir, "lineitem"))


@query(_mode_sql("embeddings", "2 / 3.0", "false"))
def mode_embeddings(spark, sf_dir):
    return _mode(table(spark, sf_dir, "embeddings"))


@query(_mode_sql("supplier", "3 / 4.0", "false"))
def mode_supplier(spark, sf_dir):
    return _mode(table(spark, sf_dir, "supplier"))


@query("SELECT 'sparse' AS mode, n AS length, true AS is_uniform, false AS is_numeric_heavy, false AS has_time_field, round(m * 3 / (n * 3.0), 6)::DOUBLE AS sparsity_ratio FROM (SELECT count(*) AS n, count(*) FILTER (event_id % 3 <> 0) AS m FROM events)")
def mode_sparse_events(spark, sf_dir):
    return _mode(_sparse_events(spark, sf_dir).drop("event_id"))


@query("SELECT * FROM (VALUES ('sparse', false), ('stream', true), ('columnar', true)) AS t(mode, fits)")
def mode_predicates_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return spark.createDataFrame([("sparse", modes.should_use_sparse(df)), ("stream", modes.should_use_stream(df)), ("columnar", modes.should_use_columnar(df))], "mode string, fits boolean")


@query("SELECT * FROM (VALUES (0, 'primary', 'event_id'), (2, 'timeseries', 'ts'), (3, 'aggregate', 'value'), (4, 'join', 'event_id,user_id'), (5, 'index', 'event_id,ts,user_id')) AS t(ord, type, fields) WHERE (SELECT count(DISTINCT event_id) = count(*) FROM events)")
def hints_events(spark, sf_dir):
    return hints.query_hints(table(spark, sf_dir, "events")).withColumn("fields", F.array_join("fields", ","))


@query("SELECT * FROM (VALUES (0, 'primary', 'doc_id'), (1, 'search', 'text'), (4, 'join', 'doc_id'), (5, 'index', 'doc_id')) AS t(ord, type, fields) WHERE (SELECT count(DISTINCT doc_id) = count(*) FROM documents)")
def hints_documents(spark, sf_dir):
    return hints.query_hints(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).withColumn("fields", F.array_join("fields", ","))


@query("SELECT '!primary:event_id !timeseries:ts !aggregate:value !join:event_id,user_id !index:event_id,ts,user_id' AS text")
def hints_text_events(spark, sf_dir):
    return hints.format_hints(hints.query_hints(table(spark, sf_dir, "events")))


# -- codecs --------------------------------------------------------------------------------------------------------------------------

_RUNS = "SELECT {g}run, any_value(v) AS value, min(pos) AS start, count(*) AS length FROM (SELECT *, sum(c) OVER ({p}ORDER BY pos) - 1 AS run FROM (SELECT *, CASE WHEN pos = 0 OR v IS DISTINCT FROM lag(v) OVER ({p}ORDER BY pos) THEN 1 ELSE 0 END AS c FROM (SELECT {g}{v} AS v, row_number() OVER ({p}ORDER BY {k}) - 1 AS pos FROM {t}))) GROUP BY ALL"
_ORDER_RUNS = _RUNS.format(g="", p="", v="o_orderstatus", k="o_orderkey", t="orders")


def _orders(spark, sf_dir, **kw):
    return ordered(table(spark, sf_dir, "orders"), ["o_orderkey"], **kw)


@query(f"SELECT run::BIGINT AS run, value, start, length FROM ({_ORDER_RUNS})")
def rle_orderstatus(spark, sf_dir):
    return codecs.rle_runs(_orders(spark, sf_dir), "o_orderstatus")


@query(f"SELECT run::BIGINT AS run, value, start, length FROM ({_ORDER_RUNS})")
def rle_orderstatus_by_ranges(spark, sf_dir):
    return codecs.rle_runs(_orders(spark, sf_dir, small=0, parts=4), "o_orderstatus")


@query(f"SELECT user_id, run::BIGINT AS run, value, start, length FROM ({_RUNS.format(g='user_id, ', p='PARTITION BY user_id ', v='event_type', k='event_id', t='events')})")
def rle_event_type_by_user(spark, sf_dir):
    return codecs.rle_runs(ordered(table(spark, sf_dir, "events"), ["event_id"], ["user_id"]), "event_type")


_USER_RUNS = _RUNS.format(g="user_id, ", p="PARTITION BY user_id ", v="event_type", k="event_id", t="events")


@query(f"SELECT user_id, string_agg(value || '*' || length, ', ' ORDER BY run) AS library, string_agg(CASE WHEN length > 1 THEN value || '*' || length ELSE value END, '|' ORDER BY run) AS directive FROM ({_USER_RUNS}) GROUP BY 1")
def rle_text_by_user(spark, sf_dir):
    t = ordered(table(spark, sf_dir, "events"), ["event_id"], ["user_id"])
    return codecs.rle_text(t, "event_type").withColumnRenamed("text", "library").join(codecs.rle_text(t, "event_type", "|", False).withColumnRenamed("text", "directive"), "user_id")


@query("SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS library, string_agg(event_type, ',' ORDER BY event_id) AS directive FROM events GROUP BY 1")
def rle_roundtrip_by_user(spark, sf_dir):
    found = rle_text_by_user(spark, sf_dir)
    lib, direct = codecs.rle_decoded(F.col("library"), ", "), codecs.runs_decoded(F.col("directive"))
    return found.select("user_id", F.size(lib).cast("long").alias("n"), F.array_join(lib, ",").alias("library"), F.array_join(direct, ",").alias("directive"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderstatus AS value FROM orders")
def rle_expand_orderstatus(spark, sf_dir):
    return codecs.expand_runs(codecs.rle_runs(_orders(spark, sf_dir), "o_orderstatus"))


@query(f"SELECT sum(length)::BIGINT AS n, count(*) AS runs, (sum(length) FILTER (length > 1))::BIGINT AS in_runs, round((sum(length) FILTER (length > 1)) / sum(length), 6)::DOUBLE AS run_share, sum(length) >= 10 AND (sum(length) FILTER (length > 1)) / sum(length) > 0.3 AS use, round((sum(len(value) + 1 + len(length::VARCHAR)) + 2 * (count(*) - 1)) / (sum(len(value) * length) + sum(length) - 1), 6)::DOUBLE AS ratio FROM ({_ORDER_RUNS})")
def rle_advice_orderstatus(spark, sf_dir):
    t = _orders(spark, sf_dir)
    return _rounded(codecs.rle_advice(t, "o_orderstatus").join(codecs.rle_ratio(t, "o_orderstatus")), "run_share", "ratio")


_DICT = "SELECT {c} AS value, min({k}) AS f, count(*) AS n FROM {t} GROUP BY 1"


@query(f"SELECT row_number() OVER (ORDER BY f) - 1 AS idx, value, f AS first_pos, n AS count FROM (SELECT value, min(pos) AS f, count(*) AS n FROM (SELECT c_mktsegment AS value, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) GROUP BY 1)")
def dictionary_mktsegment(spark, sf_dir):
    return codecs.dictionary(ordered(table(spark, sf_dir, "customer"), ["c_custkey"]), "c_mktsegment")


@query(f"SELECT pos, idx FROM (SELECT c_mktsegment AS value, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) JOIN (SELECT value, row_number() OVER (ORDER BY f) - 1 AS idx FROM ({_DICT.format(c='c_mktsegment', k='c_custkey', t='customer')})) USING (value)")
def dictionary_indices_mktsegment(spark, sf_dir):
    return codecs.dictionary_indices(ordered(table(spark, sf_dir, "customer"), ["c_custkey"]), "c_mktsegment")


@query("SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS decoded FROM orders GROUP BY 1")
def dictionary_roundtrip_by_customer(spark, sf_dir):
    t = ordered(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_custkey"])
    entries = codecs._joined(codecs.dictionary(t, "o_orderstatus"), ("o_custkey",), "idx", F.col("value"), ", ", "entries")
    indices = codecs._joined(codecs.dictionary_indices(t, "o_orderstatus"), ("o_custkey",), "pos", F.col("idx").cast("string"), ",", "indices")
    got = codecs.dictionary_decoded(codecs.parsed_dictionary(F.concat(F.lit("["), F.col("entries"), F.lit("]"))), codecs.parsed_indices(F.col("indices")))
    return entries.join(indices, "o_custkey").select("o_custkey", F.array_join(got, ",").alias("decoded"))


@query(f"SELECT row_number() OVER (ORDER BY n DESC, f) - 1 AS rank, value, n AS count FROM ({_DICT.format(c='p_brand', k='p_partkey', t='part')})")
def frequency_dictionary_brand(spark, sf_dir):
    return codecs.frequency_dictionary(ordered(table(spark, sf_dir, "part"), ["p_partkey"]), "p_brand")


@query(f"SELECT sum(n)::BIGINT AS n, count(*) AS \"distinct\", sum(n) >= 20 AND count(*) / sum(n) < 0.3 AS use, round((sum(len(value)) + count(*) - 1 + sum(len(idx::VARCHAR) * n) + sum(n) - 1) / (sum(len(value) * n) + sum(n) - 1), 6)::DOUBLE AS ratio FROM (SELECT *, row_number() OVER (ORDER BY f) - 1 AS idx FROM ({_DICT.format(c='p_brand', k='p_partkey', t='part')}))")
def dictionary_advice_brand(spark, sf_dir):
    t = ordered(table(spark, sf_dir, "part"), ["p_partkey"])
    return _rounded(codecs.dictionary_advice(t, "p_brand").join(codecs.dictionary_ratio(t, "p_brand")), "ratio")


_DELTA = "SELECT pos, CASE WHEN pos = 0 THEN v END AS base, CASE WHEN pos > 0 THEN v - lag(v) OVER (ORDER BY pos) END AS delta FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {k}) - 1 AS pos FROM {t})"


@query(_DELTA.format(c="o_custkey", k="o_orderkey", t="orders"))
def delta_custkey(spark, sf_dir):
    return codecs.deltas(_orders(spark, sf_dir), "o_custkey")


@query(_DELTA.format(c="o_custkey", k="o_orderkey", t="orders"))
def delta_custkey_by_ranges(spark, sf_dir):
    return codecs.deltas(_orders(spark, sf_dir, small=0, parts=5), "o_custkey")


@query("SELECT user_id, string_agg(CASE WHEN pos = 0 THEN event_id::VARCHAR ELSE CASE WHEN d < 0 THEN '' ELSE '+' END || d END, ', ' ORDER BY pos) AS text, string_agg(event_id, ',' ORDER BY pos) AS decoded FROM (SELECT *, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY pos) AS d FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)) GROUP BY 1")
def delta_text_by_user(spark, sf_dir):
    found = codecs.delta_text(ordered(table(spark, sf_dir, "events"), ["event_id"], ["user_id"]), "event_id")
    return found.withColumn("decoded", F.array_join(F.transform(codecs.delta_decoded(F.col("text")), lambda x: x.cast("string")), ","))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_custkey AS value FROM orders")
def delta_restored_custkey(spark, sf_dir):
    t = _orders(spark, sf_dir, small=0, parts=3)
    found = codecs.deltas(t, "o_custkey")
    return codecs.restored(ordered(found, ["pos"]), "base", "delta").df.select("pos", "value")


@query("SELECT count(*) AS n, round(avg(abs(v - p)), 6) AS mean_step, round(avg(abs(v)), 6) AS mean_size, count(*) >= 10 AND avg(abs(v - p)) < 0.2 * avg(abs(v)) AS use, round((sum(CASE WHEN p IS NULL THEN len(v::BIGINT::VARCHAR) ELSE len((v - p)::BIGINT::VARCHAR) + CASE WHEN v < p THEN 0 ELSE 1 END END) + 2 * (count(*) - 1)) / (sum(len(v::BIGINT::VARCHAR)) + count(*) - 1), 6)::DOUBLE AS ratio FROM (SELECT p_size::DOUBLE AS v, lag(p_size::DOUBLE) OVER (ORDER BY p_partkey) AS p FROM part)")
def delta_advice_size(spark, sf_dir):
    t = ordered(table(spark, sf_dir, "part"), ["p_partkey"])
    return _rounded(codecs.delta_advice(t, "p_size").join(codecs.delta_ratio(t, "p_size")), "mean_step", "mean_size", "ratio")


@query("SELECT pos, CASE WHEN pos = 0 THEN ts END AS base, CASE WHEN pos > 0 THEN ((epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (ORDER BY pos)) // 1000)::BIGINT END AS delta FROM (SELECT ts, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)")
def timestamp_deltas_events(spark, sf_dir):
    return codecs.timestamp_deltas(ordered(table(spark, sf_dir, "events"), ["event_id"]), "ts")


@query("WITH d AS (SELECT user_id, event_id, ts, coalesce((epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w) // 1000, 0) AS d, first_value(ts) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, max(epoch_ms(f) // 1000 + s)::BIGINT AS last_second, count(*) AS n FROM (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM d) GROUP BY 1")
def timestamps_restored_by_user(spark, sf_dir):
    t = ordered(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"], ["user_id"])
    found = codecs.timestamp_deltas(t, "ts").groupBy("user_id").agg(F.min("base").alias("first"), F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", F.coalesce("delta", F.lit(0)).alias("delta"))))).alias("d"))
    back = found.select("user_id", "first", codecs.timestamps_restored(F.col("first"), F.transform("d", lambda x: x["delta"])).alias("back"))
    # The latest of the restored times, which is not the last where times go back. The first counts in milliseconds, rounded, as epoch_ms does.
    start = "(unix_micros(first) + if(unix_micros(first) < 0, -500, 500)) div 1000 div 1000"
    latest = F.expr(f"{start} + (unix_micros(array_max(back)) - unix_micros(first)) div 1000000")
    return back.select("user_id", latest.alias("last_second"), F.size("back").cast("long").alias("n"))


_FLAGS = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS pos, l_returnflag = 'R' AS b FROM lineitem"


def _flags(spark, sf_dir):
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return ordered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", *keys), keys, ["l_orderkey"])


@query(f"SELECT l_orderkey, any_value(bits) AS bits, string_agg(format('{{:X}}', v), '' ORDER BY nib) AS hex, any_value(bits) AS decoded FROM (SELECT l_orderkey, pos // 4 AS nib, sum(CASE WHEN b THEN CAST(power(2, 3 - pos % 4) AS INT) ELSE 0 END)::INT AS v FROM ({_FLAGS}) GROUP BY 1, 2) JOIN (SELECT l_orderkey, string_agg(CASE WHEN b THEN '1' ELSE '0' END, '' ORDER BY pos) AS bits FROM ({_FLAGS}) GROUP BY 1) USING (l_orderkey) GROUP BY 1")
def bits_returnflag(spark, sf_dir):
    t, flag = _flags(spark, sf_dir), F.col("l_returnflag") == "R"
    found = codecs.bits_text(t, flag).withColumnRenamed("text", "bits").join(codecs.hex_text(t, flag).withColumnRenamed("text", "hex"), "l_orderkey")
    back = codecs.hex_decoded(F.col("hex"), F.length("bits"))
    return found.withColumn("decoded", F.array_join(F.transform(back, lambda b: F.when(b, "1").otherwise("0")), ""))


@query("SELECT round(count(*) / (4 * t + 5 * (count(*) - t) + 2 * (count(*) - 1)), 6)::DOUBLE AS binary_ratio, round(ceil(count(*) / 4) / (4 * t + 5 * (count(*) - t) + 2 * (count(*) - 1)), 6)::DOUBLE AS hex_ratio, count(*) >= 20 AS use FROM labels, (SELECT count(*) FILTER (toxic = 1) AS t FROM labels) GROUP BY t")
def bits_ratio_labels(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("b"))
    out = codecs.bits_ratio(df, "b").withColumnRenamed("ratio", "binary_ratio").join(codecs.bits_ratio(df, "b", True).withColumnRenamed("ratio", "hex_ratio"))
    return _rounded(out, "binary_ratio", "hex_ratio").withColumn("use", F.lit(codecs.should_pack_bits(df, "b")))


@query("SELECT l_partkey, CASE WHEN l_partkey < 128 THEN l_partkey::VARCHAR WHEN l_partkey < 16384 THEN (l_partkey % 128 + 128) || ',' || (l_partkey // 128) ELSE (l_partkey % 128 + 128) || ',' || ((l_partkey // 128) % 128 + 128) || ',' || (l_partkey // 16384) END AS bytes, CASE WHEN l_partkey < 128 THEN 1 WHEN l_partkey < 16384 THEN 2 ELSE 3 END AS length, l_partkey AS decoded FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def varint_partkey(spark, sf_dir):
    b = codecs.varint_bytes(F.col("l_partkey"))
    df = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    return df.select("l_partkey", F.array_join(b.cast("array<string>"), ",").alias("bytes"), codecs.varint_length(F.col("l_partkey")).alias("length"), codecs.varint_value(b).alias("decoded"))


@query("SELECT count(*) AS n, round(avg(abs(l_partkey)), 6) AS mean_size, round(1 - sum(CASE WHEN l_partkey < 128 THEN 1 WHEN l_partkey < 16384 THEN 2 WHEN l_partkey < 2097152 THEN 3 ELSE 4 END) / (4 * count(*)), 6)::DOUBLE AS savings, count(*) >= 10 AND avg(abs(l_partkey)) < 10000 AS use FROM lineitem")
def varint_advice_partkey(spark, sf_dir):
    return _rounded(codecs.varint_advice(table(spark, sf_dir, "lineitem"), "l_partkey"), "mean_size", "savings")


@query("SELECT v AS text, CASE WHEN regexp_matches(v, '^\".*\"$') THEN 'quoted' WHEN v IN ('true', 'false') THEN 'bool' WHEN v = 'null' THEN 'null' WHEN regexp_matches(v, '^-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$') THEN 'number' ELSE 'str' END AS kind FROM (SELECT DISTINCT unnest(['true', 'null', '\"x\"', r_name, r_regionkey::VARCHAR, '-1.5', '1e3', '1.2.3']) AS v FROM region)")
def literal_kinds(spark, sf_dir):
    fixed = F.array(*[F.lit(x) for x in ("true", "null", '"x"')], F.col("r_name"), F.col("r_regionkey").cast("string"), *[F.lit(x) for x in ("-1.5", "1e3", "1.2.3")])
    return table(spark, sf_dir, "region").select(F.explode(fixed).alias("text")).distinct().select("text", codecs.literal_kind(F.col("text")).alias("kind"))


# -- the advisor ---------------------------------------------------------------------------------------------------------------------


def _advisor_sql(t: str, key: str, strings: list[str], ints: list[str]) -> str:
    parts = []
    for c in strings + ints:
        v = f"{c}::VARCHAR"
        if c in strings:
            dict_ok, delta_ok, bit_ok = "n >= 10 AND k / n < 0.2", "false", "false"
        else:
            dict_ok, delta_ok, bit_ok = "false", "n >= 10 AND greatest(up, down) > 0.8 * (n - 1)", "n >= 10 AND low >= 0 AND high <= 65535"
        low, high, up, down, step = ("0", "0", "0", "0", "0") if c in strings else (f"min({c})", f"max({c})", f"count(*) FILTER ({c} > p)", f"count(*) FILTER ({c} < p)", f"sum(CASE WHEN p IS NULL THEN len({v}) ELSE len(({c} - p)::VARCHAR) + 1 END)")
        facts = f"SELECT count(*) AS n, sum(CASE WHEN p IS NULL OR {c} <> p THEN 1 ELSE 0 END) AS runs, (SELECT count(DISTINCT {c}) FROM {t}) AS k, (SELECT sum(len(x)) FROM (SELECT DISTINCT {v} AS x FROM {t})) AS e, sum(len({v})) AS chars, {step} AS steps, {up} AS up, {down} AS down, {low} AS low, {high} AS high FROM (SELECT {c}, lag({c}) OVER (ORDER BY {key}) AS p FROM {t})"
        parts.append(f"SELECT '{c}' AS field, CASE WHEN 1 - runs / n >= 0.3 THEN {{'a': 'rle', 'r': 1 - runs / n}} WHEN {dict_ok} AND 1 - (e + 2 * n) / chars >= 0.2 THEN {{'a': 'dictionary', 'r': 1 - (e + 2 * n) / chars}} WHEN {delta_ok} AND 1 - steps / chars >= 0.2 THEN {{'a': 'delta', 'r': 1 - steps / chars}} WHEN {bit_ok} AND 1 - ceil(log2(high + 1)) / 32 >= 0.2 THEN {{'a': 'bitpack', 'r': 1 - ceil(log2(high + 1)) / 32}} ELSE {{'a': 'none', 'r': 0.0}} END AS x FROM ({facts})")
    return f"SELECT field, x.a AS algorithm, round(x.r::DOUBLE, 6) AS ratio FROM ({_union(parts)})"


@query(_advisor_sql("orders", "o_orderkey", ["o_orderstatus", "o_orderpriority"], ["o_orderkey", "o_custkey"]))
def advisor_orders(spark, sf_dir):
    return _rounded(advisor.advise(_orders(spark, sf_dir), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]), "ratio")


@query(_advisor_sql("part", "p_partkey", ["p_name", "p_brand", "p_type"], ["p_partkey", "p_size"]))
def advisor_part_by_ranges(spark, sf_dir):
    t = ordered(table(spark, sf_dir, "part"), ["p_partkey"], small=0, parts=4)
    return _rounded(advisor.advise(t, ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]), "ratio")


@query(_advisor_sql("events", "event_id", ["event_type", "props"], ["event_id", "user_id"]))
def advisor_events(spark, sf_dir):
    return _rounded(advisor.advise(ordered(table(spark, sf_dir, "events"), ["event_id"]), ["event_id", "user_id", "event_type", "props"]), "ratio")


# -- texts and typed strings -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\s\\[\\]{}():,|\"]+'), lambda x: x <> '')) + ceil(len(regexp_extract_all(text, '[\\[\\]{}():,|\"]')) * 0.5)::BIGINT AS tokens, ceil(length(text) / 4)::BIGINT AS quarter_tokens FROM documents")
def token_estimate_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"), text.quarter_tokens(F.col("text")).alias("quarter_tokens"))


@query("SELECT page_id, 2 * len(regexp_extract_all(html, '</?[A-Za-z0-9_:-]+')) + 2 * len(regexp_extract_all(html, '[A-Za-z0-9_:-]+=')) + len(regexp_extract_all(html, '\"[^\"]*\"')) + len(list_filter(regexp_split_to_array(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS tokens FROM pages")
def xml_token_estimate_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.xml_tokens(F.col("html")).alias("tokens"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS text, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS attribute, true AS roundtrip FROM pages")
def entities_pages(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.entities_encoded(h)).alias("text"), F.md5(text.entities_encoded(h, True)).alias("attribute"), (text.entities_decoded(text.entities_encoded(h, True)) == h).alias("roundtrip"))


_UUIDS = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12) WHEN 1 THEN upper(substr(md5(c_name), 1, 22)) ELSE c_name END AS v FROM customer"


@query(f"SELECT c_custkey, regexp_full_match(lower(v), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') AS is_uuid, regexp_full_match(v, '[0-9A-Za-z]{{1,24}}') AS is_short FROM ({_UUIDS})")
def uuid_flags(spark, sf_dir):
    m = F.md5("c_name")
    part = lambda a, n: F.substring(m, a, n)
    whole = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    v = F.when(F.col("c_custkey") % 3 == 0, whole).when(F.col("c_custkey") % 3 == 1, F.upper(part(1, 22))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", typed.is_uuid(v).alias("is_uuid"), typed.is_short_uuid(v).alias("is_short"))


@query("SELECT c_custkey, true AS same FROM customer")
def short_uuid_roundtrip(spark, sf_dir):
    m = F.md5("c_name")
    part = lambda a, n: F.substring(m, a, n)
    df = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)).alias("u"))
    return df.select("c_custkey", "u", typed.short_uuid(F.col("u")).alias("s")).select("c_custkey", (typed.long_uuid(F.col("s")) == F.col("u")).alias("same"))


_DATES = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-') || '31' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE lpad((o_orderkey % 30)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 70)::VARCHAR, 2, '0') || ':00' END AS v FROM orders"


@query(f"SELECT o_orderkey, v, regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime(v, '%Y-%m-%d') IS NOT NULL AS is_date, regexp_full_match(v, '([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') AS is_time, v LIKE '%Z' AS is_timestamp FROM ({_DATES})")
def temporal_flags(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    v = F.when(k % 5 == 0, typed.format_date(d)).when(k % 5 == 1, F.concat(F.date_format(d, "yyyy-MM-"), F.lit("31"))).when(k % 5 == 2, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 5 == 3, F.date_format(d, "yyyy/MM/dd")).otherwise(F.concat(two(k % 30), F.lit(":"), two(k % 70), F.lit(":00")))
    df = table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))
    return df.select("o_orderkey", "v", typed.is_date(F.col("v")).alias("is_date"), typed.is_time(F.col("v")).alias("is_time"), typed.is_timestamp(F.col("v")).alias("is_timestamp"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, date_trunc('millisecond', ts) AS parsed FROM events")
def temporal_format_events(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", typed.format_date(ts).alias("day"), typed.format_timestamp(ts).alias("iso"), typed.parsed_timestamp(typed.format_timestamp(ts)).cast("timestamp_ntz").alias("parsed"))


@query("SELECT event_id, hour(ts) * 3600000 + minute(ts) * 60000 + second(ts) * 1000 + millisecond(ts) % 1000 AS ms FROM events")
def parsed_times_events(spark, sf_dir):
    t = typed.parsed_time(F.date_format("ts", "HH:mm:ss.SSS"))
    return table(spark, sf_dir, "events").select("event_id", (t["hours"] * 3600000 + t["minutes"] * 60000 + t["seconds"] * 1000 + t["milliseconds"]).cast("long").alias("ms"))


@query("SELECT p_partkey, p_type IN ('ECONOMY', 'STANDARD') AS member, p_size::VARCHAR IN ('1', '2', '3') AS number_member FROM part")
def enum_flags(spark, sf_dir):
    a, b = (typed.enum_members(F.lit(x)) for x in ("enum( ECONOMY, STANDARD )", "enum(1,2,3)"))
    return table(spark, sf_dir, "part").select("p_partkey", typed.in_enum(F.col("p_type"), a).alias("member"), typed.in_enum(F.col("p_size"), b).alias("number_member"))


@query("SELECT n_nationkey, true AS is_enum, false AS is_bad_enum, 'region' AS target, false AS is_bad_ref, 'ref(' || n_name || ')' AS type, n_name AS target_of, n_regionkey AS value FROM nation")
def type_definitions(spark, sf_dir):
    ref = typed.reference(F.col("n_name"), F.col("n_regionkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", typed.is_enum_type(F.concat(F.lit("enum(a, "), "n_name", F.lit(")"))).alias("is_enum"), typed.is_enum_type(F.concat(F.lit("enum("), "n_name", F.lit(",)"))).alias("is_bad_enum"), typed.reference_target(F.lit("ref( region )")).alias("target"), typed.is_reference_type(F.lit("ref()")).alias("is_bad_ref"), typed.reference_type(F.col("n_name")).alias("type"), ref["target_table"].alias("target_of"), ref["value"].alias("value"))


# -- validation ------------------------------------------------------------------------------------------------------------------------

ORDER_SCHEMA = Schema("order", (Field("o_orderkey", "u16"), Field("o_custkey", "u8"), Field("o_orderstatus", "enum(O, F)"), Field("o_totalprice", "f64"), Field("o_orderpriority", "str"), Field("note", "str", optional=True)))
_BAD = "SELECT pos, '[' || pos || '].{f}' AS path, '{t}' AS expected, {v}::VARCHAR AS actual FROM o WHERE NOT ({ok})"


@query("WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) " + _union([_BAD.format(f="o_orderkey", t="u16", v="o_orderkey", ok="o_orderkey BETWEEN 0 AND 65535"), _BAD.format(f="o_custkey", t="u8", v="o_custkey", ok="o_custkey BETWEEN 0 AND 255"), _BAD.format(f="o_orderstatus", t="enum(O, F)", v="o_orderstatus", ok="o_orderstatus IN ('O', 'F')")]))
def validate_orders(spark, sf_dir):
    return violations(table(spark, sf_dir, "orders"), ORDER_SCHEMA, ["o_orderkey"]).drop("message")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O')")
def dangling_lineitem_orders(spark, sf_dir):
    open_orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return dangling_references(table(spark, sf_dir, "lineitem"), "l_orderkey", open_orders, "o_orderkey").select("l_orderkey", "l_partkey", "l_suppkey")
