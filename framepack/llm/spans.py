"""Positions of pattern matches as arrays of spans, from built-in functions.

The pieces between a text's matches and the matches themselves add up to the positions: code points, end exclusive. Kinds are numbers, by
which spans with equal starts are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framepack.llm.common import bind

SPAN = "struct<start:int,kind:int,end:int,value:string>"


def matches(text: Column, pattern: str, kind: int, test=None) -> Column:
    """array<struct<start, kind, end, value>> of the leftmost non-overlapping matches that pass `test`. The pattern must not match ''."""

    def located(found: Column) -> Column:
        # Each gap with the match after it; the lengths before a pair are summed run by run, and runs by running totals, so that the work on a
        # text grows with the number of its matches to the power of 4/3.
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m")))
        return bind(pairs, lambda p: bind(_starts(p), lambda at: F.zip_with(p, at, lambda x, s: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + x["n"]).alias("end"), x["m"].alias("value")))))

    def tested(found: Column) -> Column:
        return located(found) if test is None else F.filter(located(found), lambda s: test(s["value"]))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none()).otherwise(tested(found)))


#: Up to so many values, running sums are made in one go; beyond, in runs of so many, and in runs of runs.
RUN = 64


def _starts(pairs: Column) -> Column:
    """The position of each match: all lengths before it, and the gap's own."""
    return bind(before(F.transform(pairs, lambda x: x["g"] + x["n"]), lambda a, x: a + x), lambda at: F.zip_with(pairs, at, lambda x, s: s + x["g"]))


def before(values: Column, of, levels: int = 2) -> Column:
    """For each of an array of integers from 0 on, what `of` (an associative function with 0 as its neutral) makes of all before it."""

    def running(xs: Column) -> Column:
        return F.slice(F.aggregate(xs, F.array(F.lit(0)), lambda out, x: F.array_append(out, of(F.element_at(out, -1), x))), 1, F.size(xs))

    def in_runs(xs: Column) -> Column:
        totals = lambda rs: F.transform(rs, lambda r: F.aggregate(r, F.lit(0), of))
        return bind(_runs(xs), lambda rs: bind(before(totals(rs), of, levels - 1), lambda at: F.flatten(F.zip_with(rs, at, lambda r, s: F.transform(running(r), lambda x: of(s, x))))))

    if levels == 0:
        return running(values)
    return bind(values, lambda xs: F.when(F.size(xs) <= RUN, running(xs)).otherwise(in_runs(xs)))


def _runs(xs: Column) -> Column:
    """An array cut into arrays of RUN elements; it must not be empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda k: F.slice(xs, k * RUN + 1, F.lit(RUN)))


def none() -> Column:
    return F.expr(f"CAST(array() AS array<{SPAN}>)")


def listed(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of all spans by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column, labels: list[str]) -> Column:
    """The text with every span replaced by its kind's label; of overlapping spans the first stands for all.

    What lies between the spans of a run is cut from the run's part of the text, so that no span costs a walk through the whole text."""
    names = F.array(*[F.lit(x) for x in labels])

    def piece(t: Column, base: Column, s: Column) -> Column:
        return F.when(s["start"] < s["at"], F.lit("")).otherwise(F.concat(F.substring(t, s["at"] - base + 1, s["start"] - s["at"]), F.get(names, s["kind"])))

    def cut(run: Column) -> Column:
        base, end = run[0]["at"], F.element_at(run, -1)["start"]
        return bind(F.substring(text, base + 1, F.greatest(F.lit(0), end - base)), lambda t: F.array_join(F.transform(run, lambda s: piece(t, base, s)), ""))

    def joined(placed: Column) -> Column:
        last = F.array_max(F.transform(placed, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(_runs(placed), cut), ""), F.substring(text, last + 1, F.length(text)))

    def place(found: Column) -> Column:
        # `at` is where the spans before end.
        ends = before(F.transform(found, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        return F.zip_with(found, ends, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    return F.when(F.size(spans) == 0, text).otherwise(bind(F.sort_array(spans), lambda found: bind(place(found), joined)))
