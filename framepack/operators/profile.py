"""Profiles of tables: statistics, distinct counts, distributions, sparsity, logical types. One aggregation for all columns of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framepack.functions.text import INTEGERS, NUMBERS, value_text
from framepack.ordered import Ordered

STATS = "field string, sum double, avg double, min double, max double, count long, median double, stddev double, distinct long"


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMBERS)


def field_stats(df: DataFrame, name: str) -> DataFrame:
    """One row: sum, avg, min, max, count, median and population stddev of a column's numbers; all null but for the field if it has none."""
    x = _q(name).cast("double") if is_number(df, name) else F.lit(None).cast("double")
    row = df.agg(F.sum(x).alias("sum"), F.avg(x).alias("avg"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"), F.median(x).alias("median"), F.stddev_pop(x).alias("stddev"))
    return row.select(F.lit(name).alias("field"), "sum", "avg", "min", "max", F.when(F.col("n") > 0, F.col("n")).alias("count"), "median", "stddev", F.lit(None).cast("long").alias("distinct"))


def distinct_count(df: DataFrame, name: str) -> DataFrame:
    """One row: the number of distinct values, null counted as one."""
    return df.agg((F.count_distinct(_q(name)) + F.max(F.when(_q(name).isNull(), 1).otherwise(0))).alias("n")).select(F.lit(name).alias("field"), F.coalesce("n", F.lit(0)).cast("long").alias("distinct"))


def distinct_counts(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(field, distinct) of the columns, null counted as a value: values are grouped as text per column, once for all columns, which keeps
    partial sums small and spares one expansion per distinct count."""
    names = list(names or df.columns)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), _q(n).cast("string").alias("v")) for i, n in enumerate(names)])))
    found = long.groupBy("i", "v").agg(F.lit(1).alias("one")).groupBy("i").agg(F.count(F.lit(1)).alias("distinct"))
    fields = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, field string")
    return fields.join(F.broadcast(found), "i", "left").select("field", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def summary_stats(df: DataFrame, fields: Sequence[str] | None = None, exact_median: bool = True) -> DataFrame:
    """One row per column: statistics where all values are numbers, else the distinct count and the row count. Empty tables have no rows."""
    names = [n for n in fields or df.columns if n in df.columns]
    numeric = [n for n in names if is_number(df, n)]
    measures = []
    for i, n in enumerate(names):
        x = _q(n).cast("double")
        measures.append(F.count(_q(n)).alias(f"n{i}"))
        if n in numeric:
            middle = F.median(x) if exact_median else F.percentile_approx(x, 0.5, 10_000)
            measures += [F.sum(x).alias(f"s{i}"), F.avg(x).alias(f"a{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"), middle.alias(f"m{i}"), F.stddev_pop(x).alias(f"d{i}")]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *measures)
    none = F.lit(None).cast("double")

    def row(i: int, n: str) -> Column:
        whole = (F.col(f"n{i}") == F.col("rows")) if n in numeric else F.lit(False)
        get = lambda k: F.when(whole, F.col(f"{k}{i}")) if n in numeric else none
        return F.struct(F.lit(n).alias("field"), get("s").alias("sum"), get("a").alias("avg"), get("l").alias("min"), get("h").alias("max"), F.col("rows").alias("count"), get("m").alias("median"), get("d").alias("stddev"), (~whole).alias("categorical"))

    stats = one.where("rows > 0").select(F.inline(F.array(*[row(i, n) for i, n in enumerate(names)]))) if names else None
    if stats is None:
        return df.sparkSession.createDataFrame([], STATS)
    # Distinct values are counted where they are reported: columns that are no numbers, or have nulls.
    full = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(_q(n)).alias(f"n{i}") for i, n in enumerate(numeric)]).first() if numeric else None
    asked = [n for n in names if n not in numeric or full[f"n{numeric.index(n)}"] < full["rows"]]
    counts = distinct_counts(df, asked) if asked else df.sparkSession.createDataFrame([], "field string, distinct long")
    return stats.join(F.broadcast(counts), "field", "left").select("field", "sum", "avg", "min", "max", "count", "median", "stddev", F.when(F.col("categorical"), F.col("distinct")).alias("distinct"))


def format_stats(stats: DataFrame) -> DataFrame:
    """One row `text`: the block of computed values; a column's count is hidden if it has a distinct count."""
    num = lambda c: value_text(F.col(c), T.DoubleType())
    lines = F.concat_ws(
        "\n",
        F.when(F.col("sum").isNotNull(), F.concat(F.lit("  "), "field", F.lit("_sum: "), num("sum"))),
        F.when(F.col("avg").isNotNull(), F.concat(F.lit("  "), "field", F.lit("_avg: "), F.format_string("%.2f", F.col("avg")))),
        F.when(F.col("min").isNotNull(), F.concat(F.lit("  "), "field", F.lit("_min: "), num("min"))),
        F.when(F.col("max").isNotNull(), F.concat(F.lit("  "), "field", F.lit("_max: "), num("max"))),
        F.when(F.col("distinct").isNull() & F.col("count").isNotNull(), F.concat(F.lit("  "), "field", F.lit("_count: "), F.col("count").cast("string"))),
        F.when(F.col("distinct").isNotNull(), F.concat(F.lit("  "), "field", F.lit("_distinct: "), F.col("distinct").cast("string"))),
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", lines.alias("l")))), lambda x: x["l"]), "\n")
    return stats.agg(F.concat(F.lit("@computed: {\n"), listed, F.lit("\n}")).alias("text"))


def distribution(df: DataFrame, name: str) -> DataFrame:
    """(value, count) of a column's values as text, null as 'null'."""
    return df.groupBy(value_text(_q(name), df.schema[name].dataType).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def format_distribution(df: DataFrame, name: str, order_by: Sequence[str]) -> DataFrame:
    """One row `text`: the block of a column's values by count, ties by first appearance in the given order."""
    seen = df.groupBy(value_text(_q(name), df.schema[name].dataType).alias("value")).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*order_by)).alias("first"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "first", "value"))), lambda x: F.concat(F.lit("    "), x["value"], F.lit(": "), (-x["n"]).cast("string"), F.lit(",")))
    return seen.agg(F.concat(F.lit("@distribution: {\n  " + name + ": {\n"), F.array_join(lines, "\n"), F.lit("\n  }\n}")).alias("text"))


def sparsity(df: DataFrame) -> DataFrame:
    """One row: rows, null cells and their ratio to all cells; null without cells."""
    k = len(df.columns)
    nulls = sum((F.when(_q(n).isNull(), 1).otherwise(0) for n in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(nulls), F.lit(0)).cast("long").alias("nulls")).select("rows", "nulls", F.expr(f"nulls / nullif(rows * {k}, 0)").alias("ratio"))


# -- logical types ----------------------------------------------------------------------------------------------------------------

#: Integer types by width, unsigned and signed, with the bounds that inference uses.
UNSIGNED = (("u8", 255), ("u16", 65535), ("u32", 4294967295), ("u64", 2**63 - 1))
SIGNED = (("i8", -128, 127), ("i16", -32768, 32767), ("i32", -(2**31), 2**31 - 1), ("i64", -(2**63), 2**63 - 1))
BITS = {**{n: 8 << i for i, (n, _) in enumerate(UNSIGNED)}, **{n: 8 << i for i, (n, _, _) in enumerate(SIGNED)}}
FLOATS = ("f32", "f64")


def integer_type(low: Column, high: Column) -> Column:
    """The narrowest integer type of values from low to high: unsigned if none is negative."""
    out = F.when(low.isNull(), F.lit("str"))
    for name, top in UNSIGNED:
        out = out.when((low >= 0) & (high <= F.lit(top)), F.lit(name))
    for name, bottom, top in SIGNED:
        out = out.when((low >= F.lit(bottom)) & (high <= F.lit(top)), F.lit(name))
    return out.otherwise(F.lit("i64"))


def value_type(c: Column, kind: T.DataType) -> Column:
    """The logical type of one value; integral doubles are integers."""
    if isinstance(kind, T.BooleanType):
        known = F.lit("bool")
    elif isinstance(kind, INTEGERS):
        known = integer_type(c.cast("long"), c.cast("long"))
    elif isinstance(kind, NUMBERS):
        d = c.cast("double")
        known = F.when(F.isnan(d) | (F.abs(d) == float("inf")) | (d != F.floor(d)), F.lit("f32")).otherwise(integer_type(d, d))
    elif isinstance(kind, T.ArrayType):
        known = F.lit("array")
    elif isinstance(kind, (T.StructType, T.MapType, T.VariantType)):
        known = F.lit("object")
    else:
        known = F.lit("str")
    return F.when(c.isNull(), F.lit("null")).otherwise(known)


def widen(a: str, b: str) -> str:
    """The type that holds a value of either type, a seen first."""
    if a == b:
        return a
    numeric = [t in BITS or t in FLOATS for t in (a, b)]
    if numeric[0] != numeric[1]:
        return "str"
    if not all(numeric):
        return a
    if a in FLOATS or b in FLOATS:
        return "f64"
    if a[0] == b[0]:
        return max(a, b, key=BITS.get)
    most = max(BITS[a], BITS[b])
    return "i16" if most <= 8 else "i32" if most <= 16 else "i64"


def infer_types(df: DataFrame) -> DataFrame:
    """(field, type): the narrowest type of each column's values whatever their order; 'str' for columns of nulls. One aggregation."""
    measures, rows = [], []
    for i, n in enumerate(df.columns):
        kind = df.schema[n].dataType
        if isinstance(kind, NUMBERS):
            d = _q(n) if isinstance(kind, INTEGERS) else _q(n).cast("double")
            odd = F.isnan(d.cast("double")) | (F.abs(d.cast("double")) == float("inf")) | (d != F.floor(d))
            measures += [F.min(d).alias(f"l{i}"), F.max(d).alias(f"h{i}"), F.max(F.when(odd, 1).otherwise(0)).alias(f"f{i}"), F.max(F.when(~odd, 1).otherwise(0)).alias(f"w{i}")]
            ints = integer_type(F.col(f"l{i}"), F.col(f"h{i}"))
            kinds = F.when(F.col(f"l{i}").isNull(), F.lit("str")).when(F.col(f"f{i}") == 1, F.when(F.col(f"w{i}") == 1, F.lit("f64")).otherwise(F.lit("f32"))).otherwise(ints)
        else:
            measures.append(F.count(_q(n)).alias(f"n{i}"))
            fixed = "bool" if isinstance(kind, T.BooleanType) else "array" if isinstance(kind, T.ArrayType) else "object" if isinstance(kind, (T.StructType, T.MapType)) else "str"
            kinds = F.when(F.col(f"n{i}") > 0, F.lit(fixed)).otherwise(F.lit("str"))
        rows.append(F.struct(F.lit(n).alias("field"), kinds.alias("type")))
    return df.agg(F.count(F.lit(1)).alias("rows"), *measures).select(F.inline(F.array(*rows)))


_STATES = ["", "null", "bool", "str", "array", "object", *BITS, *FLOATS]


def infer_type_in_order(table: Ordered, name: str) -> DataFrame:
    """(group columns, type): the types of a column's values widened one by one in order, which may end wider than infer_types.

    Types form a finite automaton. Equal neighbours do not all collapse (a negative value followed by unsigned ones widens each time), so
    runs are kept; each group's types are folded in order.
    """
    kind = table.df.schema[name].dataType
    typed = table.df.withColumn("__t", value_type(_q(name), kind)).where(F.col("__t") != "null")
    index = {t: i for i, t in enumerate(_STATES)}
    table_map = F.array(*[F.array(*[F.lit(index[b if a in ("", "null") else widen(a, b)]) for b in _STATES]) for a in _STATES])
    number = F.create_map(*[x for t, i in index.items() for x in (F.lit(t), F.lit(i))])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", number[F.col("__t")].alias("t")))), lambda x: x["t"])
    keys = list(table.by)
    folded = typed.groupBy(*keys).agg(listed.alias("ts")).withColumn("map", table_map)
    state = F.aggregate("ts", F.lit(0), lambda a, t: F.get(F.get(F.col("map"), a), t))
    out = folded.select(*keys, F.get(F.array(*[F.lit(t or "str") for t in _STATES]), state).alias("type"))
    return out


def uniformity(df: DataFrame, json_col: str) -> DataFrame:
    """One row about JSON texts: rows, whether all are objects, whether all have the same set of keys, and the keys of the first set."""
    keys = F.array_sort(F.json_object_keys(_q(json_col)))
    sets = df.groupBy(keys.alias("keys")).agg(F.count(F.lit(1)).alias("n"))
    return sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.min(F.col("keys").isNotNull()), F.lit(False)).alias("all_objects"), ((F.count(F.lit(1)) == 1) & F.coalesce(F.min(F.col("keys").isNotNull()), F.lit(False))).alias("uniform"), F.array_join(F.min("keys"), ",").alias("keys"))
