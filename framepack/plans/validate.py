"""Rows against a schema: one projection that collects all errors of a row, at most one per field."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framepack.functions import typed
from framepack.functions.text import NUMBERS
from framepack.ordered import ordered
from framepack.plans.registry import Schema

#: Integer ranges; 64-bit ones end where doubles hold every integer (fixed values).
RANGES = {"u8": (0, 255), "u16": (0, 65535), "u32": (0, 4294967295), "u64": (0, 2**53 - 1), "i8": (-128, 127), "i16": (-32768, 32767), "i32": (-(2**31), 2**31 - 1), "i64": (-(2**53) + 1, 2**53 - 1)}
ERROR = "struct<path:string,message:string,expected:string,actual:string>"


def _type_of(kind: T.DataType) -> str:
    if isinstance(kind, NUMBERS):
        return "number"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "string" if isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)) else "object"


def fits(c: Column, kind: T.DataType, type_: str) -> Column:
    """Whether a value that is not null is of a logical type. Unknown types hold everything."""
    known = _type_of(kind)
    if type_ in RANGES:
        low, high = RANGES[type_]
        return (c.cast("double") == F.floor(c.cast("double"))) & c.between(low, high) if known == "number" else F.lit(False)
    if type_ in ("f32", "f64"):
        return F.lit(known == "number")
    if type_ == "str":
        return F.lit(known == "string")
    if type_ == "bool":
        return F.lit(known == "boolean")
    if type_ == "null":
        return F.lit(False)
    checks = {"date": typed.is_date, "time": typed.is_time, "iso8601": typed.is_timestamp, "uuid": typed.is_uuid}
    if type_ in checks:
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(type_ == ("date" if isinstance(kind, T.DateType) else "iso8601"))
        return checks[type_](c) if known == "string" else F.lit(False)
    if m := re.fullmatch(r"enum\((.+)\)", type_):
        return c.cast("string").isin([x.strip() for x in m[1].split(",")])
    return F.lit(True)


def row_errors(df: DataFrame, schema: Schema) -> Column:
    """array<struct<path, message, expected, actual>> of a row; columns that the schema does not name are ignored."""
    found = []
    for f in schema.fields:
        error = lambda message, actual: F.struct(F.lit(f.name).alias("path"), message.alias("message"), F.lit(f.type).alias("expected"), actual.alias("actual"))  # noqa: B023, E731
        missing = error(F.lit(f"required field '{f.name}' is missing"), F.lit("null"))
        if f.name not in df.columns:
            found.append(F.lit(None).cast(ERROR) if f.optional else missing)
            continue
        c, kind = F.col(f"`{f.name}`"), df.schema[f.name].dataType
        wrong = error(F.lit(f"field '{f.name}' is no {f.type}"), c.cast("string") if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(c))
        found.append(F.when(c.isNull(), F.lit(None).cast(ERROR) if f.optional or f.type == "null" else missing).when(~F.coalesce(fits(c, kind, f.type), F.lit(False)), wrong))
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def validated(df: DataFrame, schema: Schema) -> DataFrame:
    """df with columns `valid` and `errors`."""
    return df.withColumn("errors", row_errors(df, schema)).withColumn("valid", F.size("errors") == 0)


def violations(df: DataFrame, schema: Schema, order_by: Sequence[str]) -> DataFrame:
    """(pos, path, message, expected, actual) of all errors, paths as [pos].field, positions from 0 in the given order."""
    table = ordered(df, order_by)
    found = table.df.select("pos", F.explode(row_errors(table.df, schema)).alias("e"))
    return found.select("pos", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]."), F.col("e.path")).alias("path"), "e.message", "e.expected", "e.actual")


def dangling_references(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows of df whose reference is not null and names no row of the target."""
    keys = target.select(F.col(key).alias("__key"))
    return df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__key"), "left_anti")
