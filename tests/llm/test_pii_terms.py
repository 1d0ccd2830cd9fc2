"""Disclosing terms are found and reported wherever they stand."""

from pyspark.sql import functions as F

from framepack.llm import pii, spans


def test_terms_anywhere(spark):
    """A term far from the entity counts and is reported, also in a text without the entity; copies of a text prove nothing."""
    far = "and then some words that keep it away from all of it for a while"
    rows = [(i, f"note {i} by Zebulon {far} zeb@example.org {far} Zebulon {i}") for i in range(12)]
    rows += [(20, f"only {far} Zebulon here"), (21, None)]
    rows += [(30 + i, "Copied with cop@example.org thrice") for i in range(5)]
    rows += [(100 + i, f"text {i} on Monday with details") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.scan(d).select("doc_id", spans.listed(F.col("spans"), pii.KINDS).alias("s")).collect()}
    for i, text in rows[:13]:
        at = [k for k in range(len(text)) if text.startswith("Zebulon", k)]
        assert [x for x in got[i].split(",") if x[:4] == "term"] == [f"term:{a}:{a + 7}" for a in at]
    assert got[21] == "" and all("term" not in got[i] for i, _ in rows[14:])
