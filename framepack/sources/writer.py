"""Tables as text. Headers come from one profile job; rows are a projection, one line each, and never pass the driver.

encoded_lines() gives a DataFrame (ord, line), which write_text() stores as text files in order. encoded_documents() cuts a table of any size
into documents that a task holds, a row each. encode() joins the lines on the driver and is for documents that fit there; encode_value()
writes plain Python values.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framepack.functions.text import INTEGERS, NUMBERS, estimated_tokens, value_text
from framepack.operators import advisor, codecs, modes, profile
from framepack.operators.profile import _q
from framepack.ordered import Ordered, _written, ordered
from framepack.sources.grammar import key_text, number, scalar_text

BARE = "^[A-Za-z_][A-Za-z0-9_.\\-]*\\z"  # $ would also match before a line break
#: Rows, and bytes of values, of one of several documents; a row of more bytes is one of its own.
DOCUMENT_ROWS, DOCUMENT_BYTES = 10_000, 1 << 20
#: Depth up to which nested values are written.
DEPTH = 100


def quoted(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, name in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def cell(c: Column, kind: T.DataType, null: str = "null") -> Column:
    """A value as a cell: strings quoted unless they are plain words, lists in brackets."""
    if isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: cell(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, (*INTEGERS, T.BooleanType, T.DecimalType)):
        text = c.cast("string")
    elif isinstance(kind, NUMBERS):
        text = value_text(c, kind)
        text = F.when(c == float("-inf"), F.lit('"-Infinity"')).otherwise(text)
    else:
        s = value_text(c, kind)
        text = F.when(s.rlike(BARE) & ~s.isin("true", "false", "null"), s).otherwise(quoted(s))
    return F.when(c.isNull(), F.lit(null)).otherwise(text)


def _types(df: DataFrame) -> dict[str, str]:
    return {r["field"]: r["type"] for r in profile.infer_types(df).collect()}  # a row per column


def _head(spark, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(i - len(lines), x) for i, x in enumerate(lines)], "ord long, line string")


def _rows(table: Ordered, fields: list[str], delimiter: str, null: str = "null", hidden: frozenset[str] = frozenset()) -> DataFrame:
    kinds = {f: table.df.schema[f].dataType for f in fields}
    cells = [F.lit("~") if f in hidden else cell(_q(f), kinds[f], null) for f in fields]
    return table.df.select(*table.by, F.col("pos").alias("ord"), F.concat(F.lit("  "), F.concat_ws(delimiter, *cells)).alias("line"))


def _directives(table: Ordered, advice: dict[str, str]) -> tuple[list[DataFrame], dict[str, str]]:
    """A table (group columns, line) for each directive of the columns that a codec takes, and the tags that stay. A column whose codec cannot
    hold its values stays in the rows."""
    out, tags = [], {}
    for f, codec in advice.items():
        kind = table.df.schema[f].dataType
        plain = Ordered(table.df.withColumn("__c", cell(_q(f), kind)), table.by, table.cut)

        def add(texts: DataFrame, before: str, *after: Column) -> None:
            out.append(texts.select(*table.by, F.concat(F.lit(before), "text", *after).alias("line")))

        if codec == "rle":
            runs = codecs.rle_runs(plain, "__c")
            item = F.when(F.col("length") > 1, F.concat("value", F.lit("*"), F.col("length").cast("string"))).otherwise(F.col("value"))
            add(codecs._joined(runs, table.by, "run", item, "|"), f"@rle:{key_text(f)} ")
        elif codec == "dictionary":
            add(codecs._joined(codecs.dictionary(plain, "__c"), table.by, "idx", F.col("value"), ", "), f"@dict:{key_text(f)} [", F.lit("]"))
            add(codecs._joined(codecs.dictionary_indices(plain, "__c"), table.by, "pos", F.col("idx").cast("string"), ","), f"@idx:{key_text(f)} ")
        elif codec == "delta" and isinstance(kind, INTEGERS):
            add(codecs.delta_text(table, f, "|"), f"@delta:{key_text(f)} ")
        elif codec == "bits":
            counts = table.df.groupBy(*table.by).agg(F.count(F.lit(1)).alias("n"))
            texts = codecs.hex_text(table, _q(f))
            texts = texts.join(counts, list(table.by)) if table.by else texts.crossJoin(counts)
            add(texts, f'@bits:{key_text(f)} "', F.lit('" '), F.col("n").cast("string"))
        else:
            continue
        tags[f] = codec
    return out, tags


def _advice(table: Ordered, fields: list[str], n: int) -> dict[str, str]:
    """The codec of every column that has one."""
    if n < advisor.ROWS:
        return {}
    advice = {r["field"]: r["algorithm"] for r in advisor.advise(table, fields).collect() if r["algorithm"] in ("rle", "dictionary", "delta")}
    flags = [f for f in fields if f not in advice and isinstance(table.df.schema[f].dataType, T.BooleanType)]
    full = table.df.agg(F.count(F.lit(1)).alias("n"), *[F.count(_q(f)).alias(f"c{i}") for i, f in enumerate(flags)]).first()
    return advice | {f: "bits" for i, f in enumerate(flags) if full[f"c{i}"] == full["n"]}


def encoded_lines(df: DataFrame, order_by: Sequence[str], name: str | None = None, mode: str | None = None, delimiter: str = "|", compression: bool = False, hidden: Sequence[str] = ()) -> DataFrame:
    """(ord, line) of a table's document in the given or chosen layout; ord sorts the lines. Hidden columns order rows but are not written."""
    if delimiter not in ("|", ",", "\t"):
        raise ValueError(f"unknown delimiter {delimiter!r}")
    spark, fields = df.sparkSession, [c for c in df.columns if c not in hidden]
    mode = modes.select_mode(df.select(*[_q(f) for f in fields]), mode)
    if mode in ("nested", "json"):
        table = ordered(df, order_by)
        return table.df.select(F.col("pos").alias("ord"), F.to_json(F.struct(*[_q(f) for f in fields]), {"ignoreNullFields": "false"}).alias("line"))
    table = ordered(df, order_by)
    n, title = df.count(), (key_text(name) if name else "") + "::"
    if n == 0 and mode != "compact":
        return _head(spark, [f"{title}[0]@{mode}:"])
    if mode == "columnar":
        types = _types(df)
        kinds = {f: df.schema[f].dataType for f in fields}
        long = table.df.select("pos", F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), cell(_q(f), kinds[f]).alias("v")) for i, f in enumerate(fields)])))
        joined = long.groupBy("ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]), ", ").alias("vs"))
        lead = F.get(F.array(*[F.lit(f"  {key_text(f)}:{types[f]}: [") for f in fields]), F.col("ord").cast("int"))
        return _head(spark, [f"{title}[{n}]@columnar {{"]).union(joined.select("ord", F.concat(lead, "vs", F.lit("]")).alias("line"))).union(spark.createDataFrame([(len(fields), "}")], "ord long, line string"))
    if mode == "stream":
        head = f"{title}[{n}]@stream " + "|".join(key_text(f) for f in fields)
        return _head(spark, [head]).union(_rows(table, fields, "|"))
    if mode == "sparse":
        full = df.agg(*[F.count(_q(f)).alias(str(i)) for i, f in enumerate(fields)]).first()
        head = f"{title}[{n}]@sparse " + "|".join(key_text(f) + "?" * (full[i] < n) for i, f in enumerate(fields))
        return _head(spark, [head]).union(_rows(table, fields, "|", ""))
    types = _types(df)
    directives, tags = _directives(table, _advice(table, fields, n) if compression else {})
    lines = spark.createDataFrame([(-1 - len(directives), f"{title}[{n}] " + _typed_head(fields, types, tags, delimiter))], "ord long, line string")
    for i, d in enumerate(directives):
        lines = lines.union(d.select(F.lit(i - len(directives)).cast("long").alias("ord"), "line"))
    return lines if len(tags) == len(fields) else lines.union(_rows(table, fields, delimiter, hidden=frozenset(tags)))


def _typed_head(fields: list[str], types: dict[str, str], tags: dict[str, str], delimiter: str) -> str:
    return delimiter.join(f"{key_text(f)}:{types[f]}" + (f"@{tags[f]}" if f in tags else "") for f in fields)


def _blocks(df: DataFrame, order_by: Sequence[str], rows: int, size: int) -> DataFrame:
    """df with pos, its order, and block: consecutive rows, at most `rows` and of `size` bytes and a row more."""
    bytes_of = [F.coalesce(F.octet_length(_q(c).cast("string")), F.lit(4)).cast("long") for c in df.columns]
    table = ordered(df, order_by, small=rows)
    table = table.with_df(table.df.withColumn("__cost", F.greatest(F.lit(-(-size // rows)).cast("long"), sum(bytes_of[1:], bytes_of[0]))))
    out = table.running(F.col("__cost"), "__end").df
    return out.withColumn("block", F.call_function("div", F.col("__end") - F.col("__cost"), F.lit(size).cast("long"))).select(*[_q(c) for c in df.columns], "pos", "block")


def encoded_documents(df: DataFrame, order_by: Sequence[str], name: str | None = None, mode: str | None = None, delimiter: str = "|", compression: bool = False, hidden: Sequence[str] = (), rows: int = DOCUMENT_ROWS, size: int = DOCUMENT_BYTES) -> DataFrame:
    """(block, text): the table as documents that each stand alone and hold consecutive rows, at most `rows` and about `size` bytes of values;
    block sorts them, a table without rows has none. Layout, types and codecs are those of the whole table."""
    if delimiter not in ("|", ",", "\t"):
        raise ValueError(f"unknown delimiter {delimiter!r}")
    fields = [c for c in df.columns if c not in hidden]
    kinds = {f: df.schema[f].dataType for f in fields}
    mode = modes.select_mode(df.select(*[_q(f) for f in fields]), mode)
    title, table = (key_text(name) if name else "") + "::", _blocks(df, order_by, rows, size)

    def grouped(lines: DataFrame, order: str, *columns: str) -> DataFrame:
        return lines.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("r"))

    def joined(column: str, separator: str) -> Column:
        return F.array_join(F.transform("r", lambda x: x[column]), separator)

    n = F.size("r").cast("string")
    if mode in ("nested", "json"):
        lines = table.select("block", "pos", F.to_json(F.struct(*[_q(f) for f in fields]), {"ignoreNullFields": "false"}).alias("line"))
        return grouped(lines, "pos", "line").select("block", joined("line", "\n").alias("text"))
    if mode == "columnar":
        types, at = _types(df), [f"c{i}" for i in range(len(fields))]
        cells = grouped(table.select("block", "pos", *[cell(_q(f), kinds[f]).alias(c) for f, c in zip(fields, at)]), "pos", *at)
        lines = [F.concat(F.lit(f"  {key_text(f)}:{types[f]}: ["), joined(c, ", "), F.lit("]")) for f, c in zip(fields, at)]
        return cells.select("block", F.concat_ws("\n", F.concat(F.lit(f"{title}["), n, F.lit("]@columnar {")), *lines, F.lit("}")).alias("text"))
    if mode == "compact" and compression:
        # Several jobs read the blocks; pos counts within each.
        own = F.row_number().over(Window.partitionBy("block").orderBy("pos")).cast("long") - 1
        blocks = Ordered(_written(table.withColumn("pos", own)), ("block",))
        directives, tags = _directives(blocks, _advice(blocks, fields, blocks.df.count()))
        head = F.concat(F.lit(f"{title}["), F.count(F.lit(1)).cast("string"), F.lit("] " + _typed_head(fields, _types(df), tags, delimiter)))
        lines = blocks.df.groupBy("block").agg(head.alias("line")).select("block", F.lit(-1 - len(directives)).cast("long").alias("ord"), "line")
        for i, d in enumerate(directives):
            lines = lines.union(d.select("block", F.lit(i - len(directives)).cast("long").alias("ord"), "line"))
        if len(tags) < len(fields):
            lines = lines.union(_rows(blocks, fields, delimiter, hidden=frozenset(tags)).select("block", "ord", "line"))
        return grouped(lines, "ord", "line").select("block", joined("line", "\n").alias("text"))
    if mode == "sparse":
        full = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(_q(f)).alias(str(i)) for i, f in enumerate(fields)]).first()
        head = "@sparse " + "|".join(key_text(f) + "?" * (full[str(i)] < full["n"]) for i, f in enumerate(fields))
    elif mode == "stream":
        head = "@stream " + "|".join(key_text(f) for f in fields)
    else:
        head = " " + _typed_head(fields, _types(df), {}, delimiter)
    lines = _rows(Ordered(table, ("block",)), fields, delimiter if mode == "compact" else "|", "" if mode == "sparse" else "null")
    return grouped(lines, "ord", "line").select("block", F.concat(F.lit(f"{title}["), n, F.lit(f"]{head}\n"), joined("line", "\n")).alias("text"))


def write_text(lines: DataFrame, path: str) -> None:
    """Stores the lines as text files whose names keep their order."""
    lines.orderBy("ord").select(F.col("line").alias("value")).write.text(path)


def encode(df: DataFrame, order_by: Sequence[str], name: str | None = None, stats: bool = False, **options: Any) -> str:
    """The document as one string, on the driver: for tables that fit there. stats adds estimates of its tokens as comments."""
    lines = encoded_lines(df, order_by, name, **options)
    text = "\n".join(r["line"] for r in lines.orderBy("ord").select("line").collect())
    if not stats:
        return text
    s = token_stats(df, text, order_by, name)
    return text + "\n".join(
        [
            "\n# Token statistics:",
            f"#   encoded tokens: {s['tokens']}",
            f"#   JSON (pretty) tokens: {s['json_tokens']}",
            f"#   JSON (compact) tokens: {s['json_compact_tokens']}",
            f"#   reduction against JSON: {s['reduction_vs_json']:.1%}",
            f"#   reduction against compact JSON: {s['reduction_vs_json_compact']:.1%}",
        ]
    )


def token_stats(df: DataFrame, text: str, order_by: Sequence[str], name: str | None = None) -> dict:
    """Estimated tokens of a document and of the same table as JSON."""
    import json

    rows = [json.loads(r["j"]) for r in ordered(df, order_by).df.orderBy("pos").select(F.to_json(F.struct(*[_q(f) for f in df.columns]), {"ignoreNullFields": "false"}).alias("j")).collect()]
    value = {name: rows} if name else rows
    texts = [text, json.dumps(value, indent=2, ensure_ascii=False), json.dumps(value, separators=(",", ":"), ensure_ascii=False)]
    counts = [r["n"] for r in df.sparkSession.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", estimated_tokens(F.col("t")).alias("n")).orderBy("i").collect()]
    part = lambda n: 1 - counts[0] / n if n else 0.0
    return {"tokens": counts[0], "json_tokens": counts[1], "json_compact_tokens": counts[2], "reduction_vs_json": part(counts[1]), "reduction_vs_json_compact": part(counts[2])}


# -- plain values ----------------------------------------------------------------------------------------------------------------------


def _type_name(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        for name, top in profile.UNSIGNED:
            if 0 <= v <= top:
                return name
        return next((n for n, low, high in profile.SIGNED if low <= v <= high), "i64")
    return "f32" if isinstance(v, float) else "str"


def _uniform(v: Any) -> bool:
    return isinstance(v, list) and bool(v) and all(isinstance(x, dict) and x for x in v) and len({frozenset(x) for x in v}) == 1 and all(not isinstance(y, (dict, list)) or isinstance(y, list) and not any(isinstance(z, (dict, list)) for z in y) for x in v for y in x.values())


def _column_type(values: list) -> str:
    kinds = [_type_name(v) if not isinstance(v, list) else "array" for v in values if v is not None]
    out = kinds[0] if kinds else "str"
    for k in kinds[1:]:
        out = profile.widen(out, k)
    return out


def encode_value(value: Any, indent: int = 2, name: str | None = None) -> str:
    """Any JSON-like value: uniform lists of objects as rows, other lists inline, objects nested. Cycles and depths over 100 are errors."""
    if isinstance(value, dict) and len(value) == 1 and isinstance(next(iter(value.values())), list) and name is None:
        name, value = next(iter(value.items()))
        return _table_text(value, name) if _uniform(value) else f"{key_text(name)}::" + _inline(value)
    if isinstance(value, list):
        return _table_text(value, name) if _uniform(value) else _inline(value)
    if isinstance(value, dict):
        return _nested(value, indent, 0, ())
    return scalar_text(value)


def _inline(values: list) -> str:
    return f"[{len(values)}]: " + ", ".join(scalar_text(v) for v in values) if values else "[0]:"


def _table_text(rows: list[dict], name: str | None, pad: str = "") -> str:
    fields = list(rows[0])
    kinds = {f: _column_type([r[f] for r in rows]) for f in fields}
    cells = lambda r: "|".join(number(float(r[f])) if kinds[f] in ("f32", "f64") and r[f] is not None else scalar_text(r[f]) for f in fields)
    return (key_text(name) if name else "") + f"::[{len(rows)}] " + "|".join(f"{key_text(f)}:{kinds[f]}" for f in fields) + "".join(f"\n{pad}  {cells(r)}" for r in rows)


def _nested(value: dict, indent: int, depth: int, above: tuple) -> str:
    if id(value) in above:
        raise ValueError("the value contains itself")
    if depth > DEPTH:
        raise ValueError(f"the value is nested deeper than {DEPTH}")
    pad, lines = " " * (indent * (depth + 1)), []
    for k, v in value.items():
        key = key_text(str(k))
        if isinstance(v, dict):
            lines.append(f"{pad}{key}: " + _nested(v, indent, depth + 1, (*above, id(value))))
        elif _uniform(v):
            lines.append(pad + _table_text(v, str(k), pad))
        elif isinstance(v, list):
            lines.append(f"{pad}{key}: {_inline(v)}" if v else f"{pad}{key}: []")
        else:
            lines.append(f"{pad}{key}:{_type_name(v)}: {scalar_text(v)}")
    return "{\n" + "".join(x + "\n" for x in lines) + " " * (indent * depth) + "}"


def csv_lines(df: DataFrame) -> DataFrame:
    """(line) of every row as CSV: null as 'null', texts with a comma or quote quoted."""
    def one(c: str) -> Column:
        s = value_text(_q(c), df.schema[c].dataType)
        return F.when(s.rlike('[,"]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return df.select(F.concat_ws(",", *[one(c) for c in df.columns]).alias("line"))
