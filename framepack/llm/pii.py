"""Personal data: patterns find protected entities, and information theory finds the terms that give them away. Built-in expressions only.

Over the corpus, a term t reveals an entity e by their pointwise mutual information, log p(t, e) / p(t) p(e), against the information of the
entity itself, -log p(e). The ratio is 1 if t only occurs with e. Capitalised or digit-bearing terms whose ratio with an entity reaches the
threshold, in enough documents, are removed or generalised wherever they stand. Probabilities are shares of documents.

Distinct texts are counted, so copies of a document prove nothing. Null texts are empty. Rows with equal texts get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framepack.llm import spans
from framepack.llm.common import bind, materialise, text_or_empty

KINDS = ["email", "ip", "card", "phone", "term"]
#: Base kinds with their patterns (fixed values). Possessive quantifiers and what may stand before a match keep the search linear in the text
#: and change no match: a match can only begin where its run of characters begins, or where the last match ended.
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
#: A term needs this many distinct texts with both it and an entity, and this ratio. It is a whole word of 3 characters or more.
SUPPORT, RATIO = 3, 0.9
TERM = "(?<![\\p{L}0-9_-])[\\p{Lu}0-9][\\p{L}0-9_-]{2,}+"


def _ip_ok(v: Column) -> Column:
    return v.rlike("^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\\.|$)){4}$") | v.rlike("^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\\.|$)){4}$")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _card_ok(v: Column) -> Column:
    return bind(_digits(v), lambda d: F.when(F.length(d).between(14, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False)))


def entities(text: Column | str) -> Column:
    """The base spans of a text: struct(start, kind, end, value), kind an index into KINDS."""
    return bind(
        text_or_empty(text),
        lambda t: F.concat(
            spans.matches(t, EMAIL, 0),
            spans.matches(t, IP, 1, _ip_ok),
            spans.matches(t, CARD, 2, _card_ok),
            spans.matches(t, PHONE, 3, lambda v: F.length(_digits(v)).between(10, 15)),
        ),
    )


def _name(s: Column) -> Column:
    """What identifies an entity: its kind and its value, digits alone where only they count."""
    return F.concat_ws(":", s["kind"].cast("string"), F.when(s["kind"] == 0, F.lower(s["value"])).when(s["kind"] == 1, s["value"]).otherwise(_digits(s["value"])))


def terms(text: Column, found: Column) -> Column:
    """The terms of a text as spans. A term inside an entity is part of it already."""
    return F.filter(spans.matches(text, TERM, 4), lambda t: ~F.exists(found, lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))


def disclosures(named: DataFrame, words: DataFrame, near: DataFrame, n_texts: int) -> DataFrame:
    """(entity, value, ratio) of the terms that disclose an entity, from named(key, entity, n_entity), a row per entity of a text, words(key,
    value), a row or more per term of a text, and near(key, value), a row per term of a text in named that stands outside its entities."""
    pairs = named.join(near, "key").groupBy("entity", "value").agg(F.first("n_entity").alias("n_entity"), F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= SUPPORT)
    pairs = materialise(pairs, "pairs")
    # How many texts hold a term is counted over the corpus: all its terms, joined with those that are asked for.
    per_term = words.join(pairs.select("value").distinct(), "value", "left_semi").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_term"))
    n = F.lit(float(max(n_texts, 1)))
    ratio = F.log(n * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))) / F.log(n / F.col("n_entity"))
    return pairs.join(per_term, "value").where(F.col("n_entity") < n).select("entity", "value", ratio.alias("ratio")).where(F.col("ratio") >= RATIO)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, base_spans) of every row; sanitised() applies them to a text. Other columns are ignored."""
    text = F.col(text_col)
    small = materialise(df.select(F.col(id_col).alias("id"), entities(text_col).alias("found"), F.sha2(text, 256).alias("key")), "entities")
    lists = small.where(F.size("found") > 0).groupBy("key").agg(F.first("found").alias("found"))
    names = materialise(lists.select("key", F.explode(F.array_distinct(F.transform("found", _name))).alias("entity")), "names")
    # An entity in fewer texts than SUPPORT has no term with that many.
    often = names.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= SUPPORT)
    named = materialise(names.join(often, "entity"), "named")
    texts = df.select(text.alias("text"), F.sha2(text, 256).alias("key")).where("text is not null")
    asked = lists.join(named.select("key").distinct(), "key", "left_semi")
    near = texts.join(asked, "key").select("key", F.explode(F.array_distinct(F.transform(terms(F.col("text"), F.col("found")), lambda t: t["value"]))).alias("value")).distinct()
    words = texts.select("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("value"))
    told = materialise(disclosures(named, words, near, small.where("key is not null").select("key").distinct().count()).select("value").distinct(), "told")
    # A disclosing term is reported wherever it stands, in texts without entities too.
    hold = words.join(told, "value", "left_semi").groupBy("key").agg(F.collect_set("value").alias("told"))
    at = texts.join(hold, "key").select("key", F.filter(spans.matches(F.col("text"), TERM, 4), lambda t: F.array_contains("told", t["value"])).alias("terms"))
    at = at.groupBy("key").agg(F.first("terms").alias("terms"))
    # Null texts have no key and nothing to join; together they would be one group.
    some = small.where("key is not null").join(at, "key", "left").select("id", "found", "terms")
    out = some.unionByName(small.where("key is null").select("id", "found", spans.none().alias("terms")))
    free = F.filter(F.coalesce("terms", spans.none()), lambda t: ~F.exists("found", lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    every = F.array_sort(F.concat("found", free))
    return out.select(F.col("id").alias(id_col), every.alias("spans"), F.col("found").alias("base_spans"))


def sanitised(text: Column, found: Column) -> Column:
    """The text with entities and disclosing terms generalised to their kind."""
    return spans.masked(text, found, [f"<{k.upper()}>" for k in KINDS])
