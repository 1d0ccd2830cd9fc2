"""What every operator does with nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from framepack.llm import bpe, embeddings, licenses, packing, pii, quality, secrets, simhash, spans, substrings, tokencount
from framepack.llm.queries import vocabulary

LONG = "wordy " * 60_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids array<int>, key string, n_tokens string, spans int, fp string, found int, license string, quality string, class string"
NONE = (None,) * 12


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *NONE) for i, t in rows], SCHEMA)


ROWS = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "a b c"), (5, "a b c"), (None, "a b c"), (6, "x" * 200_000), (7, "mail a@b.co or +1 (234) 567-8901 token=abcdef1"), (8, "\U0001f389 é <|endoftext|> end")]

OPERATORS = {
    "licenses": lambda d: licenses.scan(d).select("doc_id", "license.*"),
    "bpe": lambda d: bpe.digests(d, vocabulary()),
    "encode": lambda d: bpe.encode(d, vocabulary()),
    "pii": pii.scan,
    "token counts": lambda d: tokencount.count_tokens(d, vocabulary(), 50256),
    "secrets": lambda d: secrets.scan(d, repo_col="source", owner_col="lang"),
    "quality": lambda d: quality.score(d).select("doc_id", "quality.*"),
    "packing": lambda d: packing.pack(d, vocabulary()),
    "simhash": simhash.near_duplicates,
    "substrings": substrings.repeats,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(spark, name):
    got = OPERATORS[name](docs(spark, ROWS)).collect()
    if name == "substrings":
        assert got == []
    elif name == "packing":
        assert {r["doc_id"] for r in got} == {i for i, _ in ROWS}
    else:
        assert sorted((r["doc_id"] for r in got), key=str) == sorted((i for i, _ in ROWS), key=str)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](docs(spark, [])).count() == 0


def test_values_of_odd_rows(spark):
    d = docs(spark, ROWS)
    got = {r["doc_id"]: r for r in bpe.digests(d, vocabulary()).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and got[1]["ids_sha256"] == got[2]["decoded_sha256"] == empty
    assert got[8]["decoded_sha256"] == hashlib.sha256(ROWS[9][1].encode()).hexdigest()
    prints = {r["doc_id"]: r for r in simhash.near_duplicates(d).collect()}
    assert prints[1]["fp"] == prints[2]["fp"] == prints[3]["fp"] == 0 and prints[3]["component_id"] == 1
    assert prints[None]["component_id"] == 5
    q = {r["doc_id"]: r for r in quality.score(d).select("doc_id", "quality.*").collect()}
    assert (q[1]["n_words"], q[1]["base_failed"], q[1]["kept"]) == (0, True, False)
    assert (q[4]["n_words"], q[4]["n_repeat_words"], q[4]["base_failed"]) == (60_000, 60_000, True)
    p = {r["doc_id"]: r["s"] for r in pii.scan(d).select("doc_id", spans.listed(F.col("base_spans"), pii.KINDS).alias("s")).collect()}
    assert p[7] == "email:5:11,phone:15:32" and p[1] == ""


def test_deduplicated_keeps_one_of_each(spark):
    words = " ".join(f"w{i}" for i in range(80))
    d = docs(spark, [(3, words), (1, words), (1, words), (None, words), (None, "else entirely here now"), (9, "quite another text it is")])
    got = simhash.deduplicated(d)
    assert got.columns == d.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted([1, None, 9], key=str)


def test_embedding_edges(spark):
    rows = [(1, [1.0, 0.0], 1, "x"), (2, [2.0, 0.0], 1, "x"), (3, [1.0, 0.0], None, "x"), (4, None, 1, "x"), (5, [0.0, 0.0], 1, "x"), (6, [float("nan"), 1.0], 1, "x"), (7, [None, 1.0], 1, "x"), (8, [1.0, 0.0], 2, "x"), (9, [1.0, 0.0, 0.0], 1, "x"), (10, [], 1, "x"), (11, [1.0, 0.0], 1, "x"), (11, [1.0, 0.0], 1, "x")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, class string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(d).collect())
    assert got == [(1, 3, 1), (2, 3, 1), *[(i, 0, i) for i in range(3, 11)], (11, 3, 1), (11, 3, 1)]
    assert embeddings.near_duplicates(d.where("vec_id < 0")).count() == 0


def test_redaction_masks_live_secrets_alone(spark):
    live, example = "token=deadbeefdeadbeef01", "password=changeme123"
    rows = [(1, f"a {live} b", "s1"), (2, f"x {example} y", "s1"), (3, f"z {example}", "s2"), (4, "nothing", "s3"), (5, None, "s1")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in secrets.redacted(d, repo_col="source", owner_col="source").collect()}
    assert got == {1: "a <SECRET> b", 2: f"x {example} y", 3: f"z {example}", 4: "nothing", 5: None}
