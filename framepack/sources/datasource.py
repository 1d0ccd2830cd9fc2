"""The data source 'framepack': spark.read.format("framepack").load(path) and df.write.format("framepack").save(path).

A document is a file; each file is read by one task, and a task writes a file for every ROWS rows, so neither holds more than one document.
Every write has names of its own: appends add to what is there, and an overwrite deletes the older files once the new ones are complete. The
schema comes from the first document, or is given. Paths of the format are folders or files that all machines mount; save() and load() go
through Spark's own readers and writers instead, to any store that Spark reaches.
"""

from __future__ import annotations

import decimal
import itertools
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from framepack.errors import ParseError
from framepack.sources.grammar import decode
from framepack.sources.writer import encode_value

#: Rows in a document.
ROWS = 100_000
#: Spark's type for each logical one.
SPARK_TYPES = {"u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "f32": T.DoubleType(), "f64": T.DoubleType(), "bool": T.BooleanType()}


def rows_of(value) -> list[dict]:
    """The rows of a document: those of its table, or the object alone."""
    if isinstance(value, dict) and len(value) == 1 and isinstance(next(iter(value.values())), list):
        value = next(iter(value.values()))
    rows = value if isinstance(value, list) else [value]
    if not all(isinstance(r, dict) for r in rows):
        raise ParseError("the document is no table")
    return rows


def schema_of(rows: list[dict]) -> T.StructType:
    """The widest type of each column over the rows, columns in order of appearance."""

    def kind(v) -> T.DataType | None:
        if v is None:
            return None
        if isinstance(v, bool):
            return T.BooleanType()
        if isinstance(v, int):
            return T.LongType() if -(2**63) <= v < 2**63 else T.DecimalType(20, 0)
        if isinstance(v, float):
            return T.DoubleType()
        if isinstance(v, list):
            inner = [k for k in map(kind, v) if k is not None]
            return T.ArrayType(inner[0] if inner else T.StringType())
        return T.StringType()

    fields: dict[str, T.DataType | None] = {}
    for r in rows:
        for k, v in r.items():
            new, old = kind(v), fields.get(k)
            if old is None or new is None or old == new:
                fields[k] = new or old
            else:
                numbers = {type(old), type(new)}
                fields[k] = T.DoubleType() if numbers <= {T.LongType, T.DoubleType} else T.StringType()
    return T.StructType([T.StructField(k, v or T.StringType()) for k, v in fields.items()])


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith(("_", ".")))
    return [path]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.fields, self.files = schema.fields, _files(options["path"])

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in self.files]

    def read(self, partition: _File) -> Iterator[tuple]:
        for row in rows_of(decode(_read(partition.path))):
            yield tuple(_cast(row.get(f.name), f.dataType) for f in self.fields)


def _cast(v, kind: T.DataType):
    if v is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(v)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(str(v))
    if isinstance(kind, T.StringType) and not isinstance(v, str):
        return str(v)
    return v


class _Done(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.name, self.names, self.overwrite = options["path"].removeprefix("file://"), options.get("name", "rows"), names, overwrite
        self.rows, self.run = int(options.get("rows", ROWS)), uuid.uuid4().hex
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        paths = []
        rows = ({n: _plain(v) for n, v in zip(self.names, r)} for r in iterator)
        while part := list(itertools.islice(rows, self.rows)):
            # Hidden until the commit, and another file for another attempt.
            paths.append(os.path.join(self.path, f".part-{context.partitionId():05d}-{len(paths):05d}-{self.run}-{context.taskAttemptId()}"))
            with open(paths[-1], "w", encoding="utf-8") as f:
                f.write(encode_value({self.name: part}))
        return _Done(paths)

    def commit(self, messages) -> None:
        old = _files(self.path) if self.overwrite else []
        for path in (p for m in messages if m for p in m.paths):
            part = os.path.basename(path)[1:].rpartition("-")[0]
            os.replace(path, os.path.join(self.path, f"{part}.fp"))
        for path in old:
            os.remove(path)
        self._sweep()
        with open(os.path.join(self.path, "_SUCCESS"), "w"):
            pass

    def abort(self, messages) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Deletes what attempts of this write have left; other writes' files are not touched. An attempt that is still being stopped may leave
        a hidden file after that, which no reader looks at."""
        for f in os.listdir(self.path):
            if f.startswith(".part-") and f"-{self.run}-" in f:
                os.remove(os.path.join(self.path, f))


def _plain(v):
    import datetime

    if isinstance(v, decimal.Decimal):
        if v == v.to_integral_value():
            return int(v)
        return float(v) if decimal.Decimal(repr(float(v))) == v else str(v)  # digits that a double has not stay, as text
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def save(df: DataFrame, path: str, name: str = "rows", mode: str = "errorifexists", rows: int = ROWS) -> None:
    """Writes df as documents of at most `rows` rows, a text file each, with Spark's text writer."""
    names = df.columns

    def run(batches):
        every = ({n: _plain(v) for n, v in zip(names, r.values())} for batch in batches for r in batch.to_pylist())
        while part := list(itertools.islice(every, rows)):
            yield pa.RecordBatch.from_arrays([pa.array([encode_value({name: part})], pa.string())], ["value"])

    df.mapInArrow(run, "value string").write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of the documents under a path that Spark reads; the schema is that of some document if none is given."""
    texts = spark.read.text(path, wholetext=True)
    if schema is None:
        one = texts.where("value <> ''").first()
        schema = schema_of(rows_of(decode(one["value"]))) if one else T.StructType()
    return decoded_rows(texts, schema)


def decoded_rows(texts: DataFrame, schema: T.StructType | str, key: str | None = None) -> DataFrame:
    """The rows of the documents in a column of texts; a task holds one document's rows at a time. Python is handed many texts at once, up to
    what an Arrow batch takes; with a key, a column that tells the documents apart, one at a time."""
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    names = [f.name for f in fields]

    def columns(found: list[dict]) -> list[pa.Array]:
        return [pa.array([_cast(r.get(f.name), f.dataType) for r in found], type=to_arrow_type(f.dataType)) for f in fields]

    def run(batches):
        for batch in batches:
            for text in batch.column(0):
                if text := text.as_py():
                    yield pa.RecordBatch.from_arrays(columns(rows_of(decode(text))), names)

    def run_one(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(columns([r for text in table.column(1) if (t := text.as_py()) for r in rows_of(decode(t))]), names)

    if key is None:
        return texts.mapInArrow(run, T.StructType(fields))
    column = next(c for c in texts.columns if c != key)
    return texts.select(key, column).groupBy(key).applyInArrow(run_one, T.StructType(fields))


class FramepackSource(DataSource):
    """Options: path; when writing also name, the table's name, and rows, those of a document at most."""

    @classmethod
    def name(cls) -> str:
        return "framepack"

    def schema(self) -> T.StructType:
        return schema_of(rows_of(decode(_read(_files(self.options["path"])[0]))))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FramepackSource)
