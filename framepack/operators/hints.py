"""Usage hints of a table: keys, search, time, aggregate, join and index columns. Names decide on the driver; data is read once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framepack.functions.text import NUMBERS
from framepack.operators.profile import _q

#: Names and parts of names that hint at a column's use (fixed values).
KEY_NAMES = ("id", "_id", "uuid", "key", "pk")
SEARCH_PARTS = ("name", "title", "description", "text", "email", "search")
TIME_NAMES = ("timestamp", "created", "updated", "date", "time", "ts", "createdAt", "updatedAt")
TIME_PARTS = ("date", "time")
AGGREGATE_PARTS = ("count", "total", "sum", "amount", "price", "revenue", "quantity", "views", "clicks")
AGGREGATE_NAMES = ("qty", "value")
JOIN_PARTS = ("ref", "fk")
ORDER = ("primary", "search", "timeseries", "aggregate", "join", "index")


def timeseries_field(columns: list[str]) -> str | None:
    for name in TIME_NAMES:
        if hit := next((c for c in columns if c.lower() == name.lower()), None):
            return hit
    return next((c for c in columns if any(p in c.lower() for p in TIME_PARTS)), None)


def join_fields(columns: list[str]) -> list[str]:
    return [c for c in columns if c.lower().endswith("id") or any(p in c.lower() for p in JOIN_PARTS)]


def _searchable(df: DataFrame) -> list[str]:
    return [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType) and any(p in c.lower() for p in SEARCH_PARTS)]


def _summable(df: DataFrame) -> list[str]:
    return [c for c in df.columns if isinstance(df.schema[c].dataType, NUMBERS) and (c in AGGREGATE_NAMES or any(p in c.lower() for p in AGGREGATE_PARTS))]


def _facts(df: DataFrame, unique: bool) -> dict:
    """Row count, nulls and, if asked for, distinct values per column. Likely keys are tried first and others only if they fail, as each
    exact distinct count shuffles a column."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    facts = {"rows": row["rows"], "full": {c for i, c in enumerate(df.columns) if row[f"n{i}"] == row["rows"]}, "key": None}
    if unique and row["rows"]:
        nulls = {c: row["rows"] - row[f"n{i}"] for i, c in enumerate(df.columns)}
        for c in [k for k in KEY_NAMES if k in df.columns] + [c for c in df.columns if c not in KEY_NAMES] + [c for c in df.columns if c in KEY_NAMES]:
            # Two nulls are equal values; one is a value like any other.
            if nulls[c] <= 1 and df.groupBy(_q(c)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
                facts["key"] = c
                break
    return facts


def detect_primary_key(df: DataFrame) -> str | None:
    """The first usual key name whose column is unique, else the first unique column; null counts as a value."""
    return _facts(df, True)["key"]


def detect_search_fields(df: DataFrame) -> list[str]:
    full = _facts(df, False)
    return [c for c in _searchable(df) if c in full["full"] and full["rows"]]


def detect_aggregate_fields(df: DataFrame) -> list[str]:
    full = _facts(df, False)
    return [c for c in _summable(df) if c in full["full"] and full["rows"]]


def detect_timeseries_field(df: DataFrame) -> str | None:
    return timeseries_field(df.columns)


def detect_join_fields(df: DataFrame) -> list[str]:
    return join_fields(df.columns)


def detect_index_fields(df: DataFrame) -> list[str]:
    return _index(_facts(df, True)["key"], df.columns)


def _index(key: str | None, columns: list[str]) -> list[str]:
    return list(dict.fromkeys([x for x in (key, timeseries_field(columns)) if x] + join_fields(columns)))


def query_hints(df: DataFrame) -> DataFrame:
    """(ord, type, fields): the hints that have fields, in a fixed order; none for an empty table."""
    facts = _facts(df, True)
    found = {}
    if facts["rows"]:
        found = {
            "primary": [facts["key"]] if facts["key"] else [],
            "search": [c for c in _searchable(df) if c in facts["full"]],
            "timeseries": [t] if (t := timeseries_field(df.columns)) else [],
            "aggregate": [c for c in _summable(df) if c in facts["full"]],
            "join": join_fields(df.columns),
            "index": _index(facts["key"], df.columns),
        }
    rows = [(i, k, found[k]) for i, k in enumerate(ORDER) if found.get(k)]
    return df.sparkSession.createDataFrame(rows, "ord int, type string, fields array<string>")


def format_hints(hints: DataFrame) -> DataFrame:
    """One row `text`: !type:field,field for each hint, in order."""
    line = F.concat(F.lit("!"), "type", F.lit(":"), F.array_join("fields", ","))
    return hints.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), " ").alias("text"))
