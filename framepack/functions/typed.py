"""Typed strings: UUIDs and their short form, dates, times, timestamps, enumerations and references."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID)


def is_short_uuid(c: Column) -> Column:
    return c.rlike("^[0-9A-Za-z]{1,24}$")


def _to_short(value: str) -> str:
    n, out = uuid.UUID(value).int, ""
    while n:
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out or "0"


def _from_short(value: str) -> str:
    n = 0
    for ch in value:
        if (d := DIGITS.find(ch)) < 0:
            raise ValueError(f"not a short UUID: {value!r}")
        n = n * 62 + d
    if n >> 128:
        raise ValueError(f"short UUID exceeds 128 bits: {value!r}")
    return str(uuid.UUID(int=n))


def short_uuid(c: Column) -> Column:
    """Base 62 of a UUID; an invalid one is an error, null stays null. 128 bits exceed every built-in number."""
    return F.pandas_udf(_all_short, "string")(c)


def long_uuid(c: Column) -> Column:
    """The UUID of a short one; an invalid one is an error, null stays null."""
    return F.pandas_udf(_all_long, "string")(c)


def _all_short(c: pd.Series) -> pd.Series:
    return c.map(_to_short, na_action="ignore")


def _all_long(c: pd.Series) -> pd.Series:
    return c.map(_from_short, na_action="ignore")


def random_uuid() -> Column:
    return F.expr("uuid()")


def parsed_date(c: Column) -> Column:
    """The date of strict YYYY-MM-DD text; null if there is none."""
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def is_date(c: Column) -> Column:
    return F.when(c.isNotNull(), parsed_date(c).isNotNull())


TIME = "^([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\\.([0-9]{1,3}))?$"


def parsed_time(c: Column) -> Column:
    """struct(hours, minutes, seconds, milliseconds) of HH:MM:SS(.mmm) text; null if it is none."""
    h, m, s = (F.regexp_extract(c, TIME, i).cast("int") for i in (1, 2, 3))
    ms = F.rpad(F.regexp_extract(c, TIME, 4), 3, "0").cast("int")
    return F.when(c.rlike(TIME), F.when((h < 24) & (m < 60) & (s < 60), F.struct(h.alias("hours"), m.alias("minutes"), s.alias("seconds"), ms.alias("milliseconds"))))


def is_time(c: Column) -> Column:
    return F.when(c.isNotNull(), parsed_time(c).isNotNull())


ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]{1,3})?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def parsed_timestamp(c: Column) -> Column:
    """The instant of ISO 8601 text, in UTC if it names no offset; null if it is none."""
    return F.when(c.rlike(ISO), F.try_to_timestamp(F.when(c.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$"), c).otherwise(F.concat(c, F.lit("Z")))))


def is_timestamp(c: Column) -> Column:
    return F.when(c.isNotNull(), parsed_timestamp(c).isNotNull())


def format_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def format_timestamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def enum_members(definition: Column) -> Column:
    """The trimmed members of enum(a, b); null unless it is one without empty members."""
    inside = F.regexp_extract(definition, "^enum\\((.*)\\)$", 1)
    members = F.transform(F.split(inside, ","), lambda m: F.trim(m))
    return F.when(definition.rlike("^enum\\(.+\\)$") & ~F.exists(members, lambda m: m == ""), members)


def is_enum_type(definition: Column) -> Column:
    return F.when(definition.isNotNull(), enum_members(definition).isNotNull())


def in_enum(value: Column, members: Column) -> Column:
    return F.array_contains(members, value.cast("string"))


def reference_target(definition: Column) -> Column:
    """The trimmed table of ref(table); null if it is none."""
    target = F.trim(F.regexp_extract(definition, "^ref\\((.*)\\)$", 1))
    return F.when(definition.rlike("^ref\\(.*\\)$") & (target != ""), target)


def is_reference_type(definition: Column) -> Column:
    return F.when(definition.isNotNull(), reference_target(definition).isNotNull())


def reference_type(table: Column) -> Column:
    return F.concat(F.lit("ref("), table, F.lit(")"))


def reference(table: Column, value: Column) -> Column:
    return F.struct(table.alias("target_table"), value.alias("value"))


class EnumRegistry:
    """Named enumerations on the driver."""

    def __init__(self) -> None:
        self._enums: dict[str, list[str]] = {}

    def register(self, name: str, values: list[str]) -> None:
        self._enums[name] = list(values)

    def get(self, name: str) -> list[str] | None:
        return self._enums.get(name)

    def has(self, name: str) -> bool:
        return name in self._enums

    def names(self) -> list[str]:
        return list(self._enums)

    def clear(self) -> None:
        self._enums.clear()

    def validate(self, name: str, value: Column) -> Column:
        """Whether a value is a member; false for an unknown enumeration."""
        return value.cast("string").isin(self._enums[name]) if name in self._enums else F.lit(False)


global_enums = EnumRegistry()
