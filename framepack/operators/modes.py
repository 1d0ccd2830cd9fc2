"""Choice of a text layout from a table's profile: one aggregation, then a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepack.operators.profile import _q, is_number

#: Least rows for a layout, and the shares of nulls and of numeric columns above which it pays (fixed values).
SPARSE_ROWS, STREAM_ROWS, COLUMNAR_ROWS, SHARE = 20, 50, 100, 0.5
TIME_NAMES = ("ts", "timestamp", "created", "updated")
MODES = ("compact", "columnar", "stream", "sparse", "nested", "json")
PROFILE = "mode string, reason string, length long, is_uniform boolean, is_numeric_heavy boolean, has_time_field boolean, sparsity_ratio double"


def _facts(df: DataFrame) -> dict:
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    n, k = row["rows"], len(df.columns)
    full = [row[f"n{i}"] == n for i in range(k)]
    numeric = sum(is_number(df, c) and full[i] for i, c in enumerate(df.columns))
    cells = n * k
    return {"rows": n, "numeric": numeric / k if k else 0.0, "nulls": (cells - sum(row[f"n{i}"] for i in range(k))) / cells if cells else None}


def _temporal(columns: list[str]) -> bool:
    return any("time" in c.lower() or "date" in c.lower() or c in TIME_NAMES for c in columns)


def should_use_sparse(df: DataFrame) -> bool:
    f = _facts(df)
    return f["rows"] >= SPARSE_ROWS and (f["nulls"] or 0) > SHARE


def should_use_stream(df: DataFrame) -> bool:
    return df.count() >= STREAM_ROWS and _temporal(df.columns)


def should_use_columnar(df: DataFrame) -> bool:
    f = _facts(df)
    return f["rows"] >= COLUMNAR_ROWS and f["numeric"] > SHARE


def _chosen(f: dict, columns: list[str], mode: str | None) -> str:
    if mode:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        return mode
    if not f["rows"]:
        return "compact"
    if f["rows"] >= SPARSE_ROWS and (f["nulls"] or 0) > SHARE:
        return "sparse"
    if f["rows"] >= STREAM_ROWS and _temporal(columns):
        return "stream"
    if f["rows"] >= COLUMNAR_ROWS and f["numeric"] > SHARE:
        return "columnar"
    return "compact"


def select_mode(df: DataFrame, mode: str | None = None) -> str:
    """The layout for a table: the given one, or the first that fits of sparse, stream and columnar, else compact."""
    return mode if mode in MODES else _chosen(_facts(df), df.columns, mode)


def mode_recommendation(df: DataFrame) -> DataFrame:
    """One row: the layout, why, and what was seen."""
    f = _facts(df)
    mode, n, share = _chosen(f, df.columns, None), f["rows"], f["nulls"] or 0.0
    heavy = f["numeric"] > SHARE
    reasons = {
        "columnar": f"{n} rows, mostly numeric columns: values of a column stand together",
        "stream": f"{n} rows with a temporal column: rows in sequence",
        "sparse": f"{share:.0%} of the cells are null: nulls are left out",
        "compact": f"{n} uniform rows: a row a line",
    }
    timed = any("time" in c.lower() or "date" in c.lower() for c in df.columns)
    return df.sparkSession.createDataFrame([(mode, reasons[mode], n, n > 0, bool(n) and heavy, bool(n) and timed, share)], PROFILE)
