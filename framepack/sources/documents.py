"""Documents in a text column: decoding, encoding and tokens, Arrow batches at a time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framepack.sources.grammar import decode, tokenize
from framepack.sources.writer import encode_value


def decoded_json(text: Column) -> Column:
    """The value of each document as JSON text; a document that does not parse is an error, null stays null."""
    return F.pandas_udf(_decoded, "string")(text)


def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: json.dumps(decode(t), ensure_ascii=False), na_action="ignore")


def encoded(json_text: Column) -> Column:
    """The document of each JSON value; null stays null."""
    return F.pandas_udf(_encoded, "string")(json_text)


def _encoded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: encode_value(json.loads(t)), na_action="ignore")


def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tok_idx, type, value, line, column) of every document's tokens."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, k, *t) for i, text in zip(part["id"], part["text"]) if text is not None for k, t in enumerate(tokenize(text))]
            yield pd.DataFrame(rows, columns=["id", "tok_idx", "type", "value", "line", "column"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, tok_idx int, type string, value string, line int, column int")
    return out.withColumnRenamed("id", id_col)


def rows_from_columns(df: DataFrame, *arrays: str) -> DataFrame:
    """A row per position of the array columns; shorter ones are padded with null."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.inline_outer(F.arrays_zip(*arrays)))
