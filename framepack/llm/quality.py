"""Quality rules: a table of thresholds compiled into one projection of text statistics. Built-in expressions only.

Words are runs without ASCII white space; lines are what `\\n` separates. A null text has no words. Ratios without a denominator are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framepack.llm.common import bind, text_or_empty

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the be to of and that have with a in is it for on are as was by this from or an at "
    "le la les de des et un une du que qui est dans en pour pas par sur au elle "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "el los las y del se por con no una su para es lo como"
).split()

#: (measure, least, most): a document whose measure lies outside is rejected. None: no bound.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("repeat_word_ratio", None, 0.5),
    ("mean_word_length", 2, 16),
    ("symbol_ratio", None, 0.1),
    ("bang_ratio", None, 0.5),
    ("letter_word_ratio", 0.5, None),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are compared by 64-bit hashes of their words; only a text in which a
    hash repeats is sorted."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = bind(ordered, lambda s: F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda p: p.isNotNull()))
        return bind(F.sort_array(twice), covered)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h))))


def measures(text: Column | str) -> Column:
    """A struct of all counts and ratios of a text."""

    def of(text: Column, words: Column, lines: Column) -> Column:
        n = F.size(words)
        n_lines = F.size(lines)
        chars = F.length(F.array_join(words, ""))
        symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
        repeats = _repeat_words(words)
        dup = n_lines - F.size(F.array_distinct(lines))
        per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        count = lambda items, pattern: F.size(F.filter(items, lambda x: x.rlike(pattern)))
        stops = sorted(set(STOP_WORDS))
        base = F.struct(n.alias("n"), chars.alias("chars"), symbols.alias("symbols"), dup.alias("dup"), repeats.alias("repeats"))
        return bind(
            base,
            lambda b: F.struct(
                b["n"].cast("long").alias("n_words"),
                b["chars"].cast("long").alias("word_chars"),
                b["symbols"].cast("long").alias("n_symbols"),
                b["dup"].cast("long").alias("n_dup_lines"),
                b["repeats"].cast("long").alias("n_repeat_words"),
                per(b["repeats"], b["n"]).alias("repeat_word_ratio"),
                per(b["chars"], b["n"]).alias("mean_word_length"),
                per(b["symbols"], b["n"]).alias("symbol_ratio"),
                per(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), b["n"]).alias("bang_ratio"),
                per(F.size(F.filter(words, lambda w: w.rlike("\\p{L}"))), b["n"]).alias("letter_word_ratio"),
                per(F.size(F.filter(words, lambda w: F.lower(w).isin(stops))), b["n"]).alias("stop_word_ratio"),
                per(b["dup"], n_lines).alias("dup_line_ratio"),
                per(count(lines, "^[\\x20\\t]*[-*•]"), n_lines).alias("bullet_line_ratio"),
                per(count(lines, "(\\.\\.\\.|…)[\\x20\\t\\r]*$"), n_lines).alias("ellipsis_line_ratio"),
            ),
        )

    return bind(
        text_or_empty(text),
        lambda t: bind(
            F.struct(F.filter(F.split(t, SPACE), lambda w: w != "").alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("l")),
            lambda s: of(t, s["w"], s["l"]),
        ),
    )


def verdict(m: Column, rules: Sequence[tuple[str, float | None, float | None]] = RULES) -> Column:
    """Whether the measures m lie within all bounds."""
    tests = [m[name] >= F.lit(least) for name, least, _ in rules if least is not None] + [m[name] <= F.lit(most) for name, _, most in rules if most is not None]
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def score(df: DataFrame, text_col: str = "text", into: str = "quality", rules: Sequence[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """df with a column `into`: struct of the measures, base_failed and kept. It replaces a column of that name; rows and others stay."""
    return df.withColumn(into, bind(measures(text_col), lambda m: F.struct(*[m[n].alias(n) for n in FIELDS], base_failed(m).alias("base_failed"), (~base_failed(m) & verdict(m, rules)).alias("kept"))))


FIELDS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words repeat_word_ratio mean_word_length symbol_ratio bang_ratio letter_word_ratio "
    "stop_word_ratio dup_line_ratio bullet_line_ratio ellipsis_line_ratio"
).split()
