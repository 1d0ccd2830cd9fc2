"""Values as text, and token estimates. Expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (*INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)


def number_text(x: Column) -> Column:
    """A double in the shortest usual notation: integral values without a point, an exponent only from 1e21 on or below 1e-6."""
    s = F.abs(x).cast("string")
    mantissa, power = F.substring_index(s, "E", 1), F.when(F.instr(s, "E") > 0, F.substring_index(s, "E", -1)).otherwise(F.lit("0")).cast("int")
    whole, part = F.substring_index(mantissa, ".", 1), F.when(F.instr(mantissa, ".") > 0, F.substring_index(mantissa, ".", -1)).otherwise(F.lit(""))
    joined = F.concat(whole, part)
    lead = F.length(joined) - F.length(F.regexp_replace(joined, "^0+", ""))
    digits = F.regexp_replace(F.regexp_replace(joined, "^0+", ""), "0+$", "")
    point = F.length(whole) + power - lead  # digits before the point
    n = F.length(digits)
    plain = (
        F.when((n <= point) & (point <= 21), F.rpad(digits, point, "0"))
        .when((point > 0) & (point <= 21), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .otherwise(F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit("")), F.lit("e"), F.when(point > 0, F.lit("+")).otherwise(F.lit("")), (point - 1).cast("string")))
    )
    # Plain longs first: the common case needs no surgery.
    whole_number = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return (
        F.when(x.isNull(), F.lit(None))
        .when(F.isnan(x), F.lit("NaN"))
        .when(F.abs(x) == float("inf"), F.when(x > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity")))
        .when(whole_number, x.cast("long").cast("string"))
        .otherwise(F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), plain))
    )


def value_text(c: Column, kind: T.DataType) -> Column:
    """A value as text, null as 'null'."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        text = number_text(c.cast("double"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


PUNCTUATION = "[\\[\\]{}():,|\"]"
SEPARATORS = "[\\s\\[\\]{}():,|\"]+"


def estimated_tokens(text: Column) -> Column:
    """Words between separators, and half the punctuation marks, rounded up."""
    words = F.size(F.filter(F.split(text, SEPARATORS), lambda w: w != ""))
    return (words + F.ceil(F.regexp_count(text, F.lit(PUNCTUATION)) * F.lit(0.5))).cast("long")


def quarter_tokens(text: Column) -> Column:
    """A token for every four characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def xml_tokens(text: Column) -> Column:
    """Tags and attributes twice, quoted values, and the words outside tags."""
    tags = F.regexp_count(text, F.lit("</?[A-Za-z0-9_:-]+"))
    attributes = F.regexp_count(text, F.lit("[A-Za-z0-9_:-]+="))
    quoted = F.regexp_count(text, F.lit('"[^"]*"'))
    words = F.size(F.filter(F.split(F.regexp_replace(text, "<[^>]+>", " "), "\\s+"), lambda w: w != ""))
    return (2 * tags + 2 * attributes + quoted + words).cast("long")


def entities_encoded(text: Column, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;")) if attribute else out


def entities_decoded(text: Column) -> Column:
    """The five named entities; & last, so that nothing is decoded twice."""
    out = text
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out
