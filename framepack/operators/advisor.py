"""Which codec a column deserves: one pass over the ordered table for all columns, then a rule per column.

Ratios are savings: the share of the plain size that the codec removes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framepack.functions.text import NUMBERS, value_text
from framepack.operators.profile import _q, distinct_counts
from framepack.ordered import Ordered

#: Least rows, and the savings from which a codec is recommended, in the order they are tried (fixed values).
ROWS, RLE, DICTIONARY, DELTA, BITPACK = 10, 0.3, 0.2, 0.2, 0.2
SCHEMA = "field string, algorithm string, ratio double"


def column_facts(table: Ordered, names: list[str] | None = None) -> DataFrame:
    """One row per column: n, runs, distinct, the kinds of its values, and sizes for every codec."""
    df = table.df
    names = names or [c for c in df.columns if c not in ("pos", "part", *table.by)]
    kinds = {n: df.schema[n].dataType for n in names}
    seen = table.previous(F.struct(*[_q(n).alias(n) for n in names]), "__p").df
    measures = []
    for i, n in enumerate(names):
        c, p, first = _q(n), F.col("__p").getField(n), F.col("pos") == 0
        number = isinstance(kinds[n], NUMBERS)
        d = c.cast("double")
        text = value_text(c, kinds[n])
        step = F.when(first, F.length(text)).otherwise(F.length(value_text(c - p, kinds[n])) + 1) if number else F.lit(0)
        measures += [
            F.count(c).alias(f"full{i}"),
            F.sum(F.when(first | ~c.eqNullSafe(p), 1).otherwise(0)).alias(f"runs{i}"),
            F.sum(F.when(c > p, 1).otherwise(0)).alias(f"up{i}") if number else F.lit(0).alias(f"up{i}"),
            F.sum(F.when(c < p, 1).otherwise(0)).alias(f"down{i}") if number else F.lit(0).alias(f"down{i}"),
            F.coalesce(F.sum(F.when(F.isnan(d) | (F.abs(d) == float("inf")), 1).otherwise(0)), F.lit(0)).alias(f"odd{i}") if number else F.lit(0).alias(f"odd{i}"),
            F.sum(F.when(d != F.floor(d), 1).otherwise(0)).alias(f"frac{i}") if number else F.lit(0).alias(f"frac{i}"),
            F.min(d).alias(f"low{i}") if number else F.lit(None).cast("double").alias(f"low{i}"),
            F.max(d).alias(f"high{i}") if number else F.lit(None).cast("double").alias(f"high{i}"),
            F.sum(F.when(c.isNull(), 0).otherwise(F.length(text))).alias(f"chars{i}"),
            F.sum(step).alias(f"steps{i}"),
        ]
    one = seen.agg(F.count(F.lit(1)).alias("n"), *measures)
    rows = [
        F.struct(
            F.lit(n).alias("field"), F.lit(i).alias("ord"), F.lit("number" if isinstance(kinds[n], NUMBERS) else "string" if isinstance(kinds[n], T.StringType) else "other").alias("kind"), F.col("n"),
            *[F.col(f"{k}{i}").cast("long").alias(k) for k in ("full", "runs", "up", "down", "odd", "frac")], *[F.col(f"{k}{i}").alias(k) for k in ("low", "high")], *[F.col(f"{k}{i}").cast("long").alias(k) for k in ("chars", "steps")],
        )
        for i, n in enumerate(names)
    ]
    facts = one.select(F.inline(F.array(*rows)))
    strings = [n for n in names if isinstance(kinds[n], T.StringType)]
    if not strings:
        return facts.select("*", F.lit(None).cast("long").alias("distinct"), F.lit(None).cast("long").alias("dict_chars"))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("field"), _q(n).alias("v")) for n in strings])))
    sizes = long.groupBy("field", "v").agg(F.lit(1).alias("one")).groupBy("field").agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum(F.length("v")), F.lit(0)).cast("long").alias("dict_chars"))
    return facts.join(F.broadcast(sizes), "field", "left")


def _ratios() -> dict[str, Column]:
    n, enough = F.col("n"), F.col("n") >= ROWS
    whole = F.col("full") == n
    number = (F.col("kind") == "number") & whole & (F.col("odd") == 0)
    trend = F.greatest(F.col("up"), F.col("down")) > 0.8 * (n - 1)
    return {
        "rle": F.when(n > 0, 1 - F.col("runs") / n).otherwise(F.lit(0.0)),
        "dictionary": F.when(enough & (F.col("kind") == "string") & (F.col("distinct") / n < 0.2), F.when(F.col("chars") > 0, 1 - (F.col("dict_chars") + 2 * n) / F.col("chars")).otherwise(F.lit(0.0))),
        "delta": F.when(enough & number & trend, 1 - F.col("steps") / F.expr("nullif(chars, 0)")),
        "bitpack": F.when(enough & number & (F.col("frac") == 0) & (F.col("low") >= 0) & (F.col("high") <= 65535), 1 - F.ceil(F.log2(F.col("high") + 1)) / 32),
    }


def advise(table: Ordered, names: list[str] | None = None) -> DataFrame:
    """(field, algorithm, ratio) of every column, 'none' and 0 where no codec pays: the first that saves enough of run lengths, dictionary,
    delta and bit packing."""
    r = _ratios()
    rule = F.when(r["rle"] >= RLE, F.struct(F.lit("rle").alias("a"), r["rle"].alias("r")))
    for name, least in (("dictionary", DICTIONARY), ("delta", DELTA), ("bitpack", BITPACK)):
        rule = rule.when(F.coalesce(r[name] >= least, F.lit(False)), F.struct(F.lit(name).alias("a"), r[name].alias("r")))
    rule = rule.otherwise(F.struct(F.lit("none").alias("a"), F.lit(0.0).alias("r")))
    return column_facts(table, names).select("ord", "field", rule.alias("x")).select("field", F.col("x.a").alias("algorithm"), F.col("x.r").alias("ratio"))


def ratios(table: Ordered, names: list[str] | None = None) -> DataFrame:
    """(field, rle, dictionary, delta, bitpack): each codec's savings, null where it does not apply."""
    r = _ratios()
    return column_facts(table, names).select("field", *[v.alias(k) for k, v in r.items()])
