"""Licence scan with a positional index of rare words. Built-in expressions only.

Templates are licence passages, each with phrases of which one must stand in its place. A first pass counts in how many files each template
word occurs. A template is indexed by its rarest words (highest inverse document frequency): as many that a place without any two of them
cannot reach the share of weight that is asked for. Each posting says where in which template a word stands. A file's words that have postings
are looked up, and each posting proposes where its template would begin; where two agree, the postings intersect by relative position and the
words at those places are compared. A template is reported where the weight of matching words is high enough and a mandatory phrase stands in
its place, so every such place is found, whatever words are rare. Templates that are nothing but a mandatory phrase must match as a whole.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. A null text has none. Rows with equal texts get equal results;
of templates with one label any counts, and ties of weight go to the word that stands first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framepack.llm.common import bind, text_or_empty

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Word sequences of which one must stand at its place in the template; none: the whole template.
    mandatory: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


#: Base phrases and further licence passages (fixed values).
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("gpl", "either version 2 of the license or at your option any later version", ("any later version",)),
    Template("agpl", "gnu affero general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("apache", "licensed under the apache license version 2 0 the license", ("apache license version 2",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("bsd", "bsd license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by", "creative commons attribution"),
    Template("cc0", "cc0 1 0 universal"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software you can redistribute it", "published by the free software foundation")),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("distributed in the hope that it will be useful", "implied warranty of merchantability")),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("distributed on an as is basis", "warranties or conditions of any kind")),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code", "this list of conditions")),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products", "nor the names of its contributors")),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("copies or substantial portions of the software", "this permission notice shall be included")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("source code form is subject", "mozilla public license v 2 0")),
)
#: The share of a template's weight that must match, and postings that must agree.
SHARE, AGREE = 0.8, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), lambda w: w != "")


def anchors(template: Template, idf: dict[str, float]) -> list[int]:
    """The places in a template whose words index it, rarest first: without all but one of them too little weight is left. A template that
    must match as a whole needs no more than AGREE."""
    order = sorted(range(len(template.words)), key=lambda i: (-idf[template.words[i]], i))
    weight = [idf[template.words[i]] for i in order]
    n = AGREE
    while template.mandatory and n < len(order) and sum(weight[:n]) - weight[0] <= (1 - SHARE) * sum(weight) + 1e-6:
        n += 1
    return order[:n]


def document_frequencies(df: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(word, df) over all rows, for the words of the templates: one row for each of a fixed list, whatever the input's size."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), words_of(text_or_empty(text_col)))
    return df.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def scan(df: DataFrame, text_col: str = "text", into: str = "license", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """df with a column `into`: struct(n_words, n_base, first_word, last_word, base_labels, labels, score), which replaces one of that name.

    n_base counts the places of base templates, first_word and last_word are the least and greatest of them, labels are arrays, and score is
    the largest share of a template's weight that matched. All rows and other columns stay.
    """
    total = df.count()
    seen = {r["word"]: r["df"] for r in document_frequencies(df, text_col, templates).collect()}  # at most the templates' words
    idf = {w: math.log((1 + total) / (1 + seen.get(w, 0))) + 1 for t in templates for w in t.words}
    postings: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(templates):
        for at in anchors(t, idf):
            postings.setdefault(t.words[at], []).append((n, at))
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    rare = array(sorted(postings))
    index = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(q).alias("q")) for n, q in postings[w]]))])

    def phrases(t: Template) -> Column:
        found = [(p.split(), next(i for i in range(len(t.words)) if t.words[i : i + len(p.split())] == p.split())) for p in t.mandatory] or [(t.words, 0)]
        return F.array(*[F.struct(F.lit(at).alias("at"), F.lit(at + len(p) - 1).alias("last")) for p, at in found])

    def shares(t: Template) -> list[float]:
        weight = sum(idf[w] for w in t.words)
        return [idf[w] / weight for w in t.words]

    table = F.array(*[F.struct(array(t.words).alias("words"), array(shares(t)).alias("share"), phrases(t).alias("phrases"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base")) for t in templates])

    def proposals(words: Column) -> Column:
        """array<struct<n, at>>, sorted, of where postings of template n would have it begin."""
        at = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(rare, w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
        each = F.flatten(F.transform(at, lambda x: F.transform(F.element_at(index, x["w"]), lambda p: F.struct(p["n"].alias("n"), (x["i"] - p["q"]).alias("at")))))
        return F.when(F.arrays_overlap(words, rare), F.sort_array(each)).otherwise(F.expr("CAST(array() AS array<struct<n:int,at:int>>)"))

    def agreed(sorted_: Column) -> Column:
        """What AGREE postings propose: equal neighbours, AGREE - 1 apart, and none of them twice."""
        return F.filter(F.transform(sorted_, lambda x, i: F.when((F.get(sorted_, i + AGREE - 1) == x) & ~F.coalesce((i > 0) & (F.get(sorted_, i - 1) == x), F.lit(False)), x)), lambda x: x.isNotNull())

    def place(words: Column, x: Column) -> Column:
        """struct<n, at, score> of a proposal, null unless the template stands there."""

        def of(t: Column) -> Column:
            got = F.transform(t["words"], lambda w, j: (x["at"] + j >= 0) & F.coalesce(F.get(words, x["at"] + j) == w, F.lit(False)))

            def judged(got: Column) -> Column:
                whole = F.exists(t["phrases"], lambda p: F.forall(F.slice(got, p["at"] + 1, p["last"] - p["at"] + 1), lambda ok: ok))
                score = F.least(F.lit(1.0), F.round(F.aggregate(F.zip_with(got, t["share"], lambda ok, s: F.when(ok, s).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, s: a + s), 9))
                return F.when(whole, F.struct(x["n"].alias("n"), x["at"].alias("at"), score.alias("score")))

            return bind(got, judged)

        return bind(F.get(table, x["n"]), of)

    def result(words: Column, places: Column) -> Column:
        base = F.filter(places, lambda p: F.get(table, p["n"])["base"])
        named = lambda ps: F.array_sort(F.array_distinct(F.transform(ps, lambda p: F.get(table, p["n"])["label"])))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.size(base).cast("long").alias("n_base"),
            F.array_min(F.transform(base, lambda p: p["at"])).cast("long").alias("first_word"),
            F.array_max(F.transform(base, lambda p: p["at"])).cast("long").alias("last_word"),
            named(base).alias("base_labels"),
            named(places).alias("labels"),
            F.coalesce(F.array_max(F.transform(places, lambda p: p["score"])), F.lit(0.0)).alias("score"),
        )

    def of(words: Column) -> Column:
        found = lambda xs: F.filter(F.transform(xs, lambda x: place(words, x)), lambda p: p.isNotNull() & (p["score"] >= SHARE))
        return bind(bind(proposals(words), agreed), lambda xs: bind(found(xs), lambda places: result(words, places)))

    return df.withColumn(into, bind(words_of(text_or_empty(text_col)), of))
