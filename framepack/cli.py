"""python -m framepack encode|decode|stats|compare|validate FILE [options]. Files are JSON values or documents."""

from __future__ import annotations

import argparse
import json
import math
import sys
from typing import Any

from framepack.errors import FramepackError
from framepack.sources.datasource import rows_of
from framepack.sources.grammar import decode
from framepack.sources.writer import csv_lines, encode, encode_value


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def _load(path: str) -> Any:
    text = sys.stdin.read() if path == "-" else open(path, encoding="utf-8").read()
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return decode(text)


def _frame(value: Any):
    """A table's rows as a DataFrame with their position, or None if the value is no flat table."""
    from framepack.sources.datasource import _cast, schema_of
    from pyspark.sql import types as T

    try:
        rows = rows_of(value)
    except FramepackError:
        return None
    if not rows or any(isinstance(v, dict) or isinstance(v, list) and any(isinstance(x, (dict, list)) for x in v) for r in rows for v in r.values()):
        return None
    schema = schema_of(rows)
    data = [(*[_cast(r.get(f.name), f.dataType) for f in schema], i) for i, r in enumerate(rows)]
    return _session().createDataFrame(data, T.StructType([*schema, T.StructField("__pos", T.LongType())]))


def _write(text: str, path: str | None) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)


def _tokens(text: str) -> int:
    return math.ceil(len(text) / 4)


def _document(value: Any, args: argparse.Namespace) -> str:
    name = next(iter(value)) if isinstance(value, dict) and len(value) == 1 else None
    df = _frame(value) if args.mode not in ("nested", "json") else None
    if args.mode == "json":
        return json.dumps(value, ensure_ascii=False)
    if df is None:
        return encode_value(value)
    return encode(df, ["__pos"], name, mode=args.mode, delimiter={"tab": "\t"}.get(args.delimiter, args.delimiter), compression=args.compression, hidden=("__pos",))


def run_encode(args: argparse.Namespace) -> None:
    value = _load(args.input)
    text = _document(value, args)
    _write(text, args.output)
    if args.stats:
        plain = json.dumps(value, indent=2, ensure_ascii=False)
        print(f"JSON: {len(plain)} characters, {_tokens(plain)} tokens; encoded: {len(text)} characters, {_tokens(text)} tokens; {1 - len(text) / max(1, len(plain)):.1%} less", file=sys.stderr)


def run_decode(args: argparse.Namespace) -> None:
    _write(json.dumps(_load(args.input), ensure_ascii=False, indent=None if args.compact else 2), args.output)


def run_stats(args: argparse.Namespace) -> None:
    from framepack.operators import advisor, hints, modes, profile
    from framepack.ordered import ordered

    df = _frame(_load(args.input))
    if df is None:
        print("no table")
        return
    data = df.drop("__pos")
    modes.mode_recommendation(data).show(truncate=False)
    print(hints.format_hints(hints.query_hints(data)).first()["text"])
    advisor.advise(ordered(df, ["__pos"]), data.columns).show(truncate=False)
    profile.summary_stats(data).show(truncate=False)


def run_compare(args: argparse.Namespace) -> None:
    value = _load(args.input)
    texts = {"json": json.dumps(value, indent=2, ensure_ascii=False), "json compact": json.dumps(value, separators=(",", ":"), ensure_ascii=False)}
    df = _frame(value)
    if df is not None:
        data = df.drop("__pos")
        texts["csv"] = ",".join(data.columns) + "\n" + "\n".join(r["line"] for r in csv_lines(data).collect())
    texts["encoded"] = _document(value, args)
    first = len(texts["json"])
    print("format | characters | tokens | reduction")
    for name, text in texts.items():
        print(f"{name} | {len(text)} | {_tokens(text)} | {1 - len(text) / max(1, first):.1%}")
    print("\n".join(x[:70] for x in texts["encoded"].split("\n")[:10]))


def run_validate(args: argparse.Namespace) -> None:
    value = _load(args.input)
    if args.schema:
        from framepack.plans.registry import Field, Schema
        from framepack.plans.validate import violations

        with open(args.schema, encoding="utf-8") as f:
            spec = json.load(f)
        schema = Schema(spec["name"], tuple(Field(x["name"], x["type"], x.get("optional", False)) for x in spec["fields"]))
        df = _frame(value)
        found = violations(df, schema, ["__pos"]).orderBy("pos").collect() if df is not None else []
        for r in found:
            print(f"{r['path']}: {r['message']} ({r['actual']})")
        if found or df is None:
            sys.exit(1)
    print("valid")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="framepack", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name, run in (("encode", run_encode), ("decode", run_decode), ("stats", run_stats), ("compare", run_compare), ("validate", run_validate)):
        p = verbs.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("input", help="a file, or - for standard input")
        p.add_argument("-o", "--output")
        p.add_argument("--mode", choices=["compact", "columnar", "stream", "sparse", "nested", "json"])
        p.add_argument("-d", "--delimiter", default="|")
        p.add_argument("-c", "--compression", action="store_true")
        p.add_argument("-s", "--stats", action="store_true")
        p.add_argument("--compact", action="store_true")
        p.add_argument("--schema")
    args = parser.parse_args(argv)
    try:
        args.run(args)
    except FramepackError as e:
        sys.exit(f"error: {e}")


if __name__ == "__main__":
    main()
