"""The pipeline against a plain version: what goes, what stays, and that every token lies in one piece."""

import numpy as np
import zlib

import corpus_pipeline
from framepack.llm import quality, substrings
from framepack.llm.queries import vocabulary


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5
    good = stages[0](spark, docs, sf_dir)
    verdict = {r["doc_id"]: r["kept"] for r in quality.score(docs).select("doc_id", "quality.kept").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == {i for i, k in verdict.items() if k}
    one = stages[1](spark, good, sf_dir)
    from tests.llm.test_against_brute_force import components, linked, shingled
    import xxhash

    rows = good.orderBy("doc_id").collect()
    fps = []
    for r in rows:
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingled(r["text"])]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = components(len(rows), linked(np.array(fps, dtype=np.uint64)))
    assert {r["doc_id"] for r in one.collect()} == {rows[i]["doc_id"] for i in set(root)}
    cut = stages[2](spark, one, sf_dir)
    spans = {}
    for r in substrings.repeats(one).collect():
        spans.setdefault(r["doc_id"], set()).add((r["start"], r["end"]))
    want = {r["doc_id"]: substrings.without(r["text"], sorted(spans.get(r["doc_id"], ()))) for r in one.collect()}
    got = cut.collect()
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in got} == {i: t for i, t in want.items() if t.split()}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    masked = stages[3](spark, cut, sf_dir)
    assert masked.columns == docs.columns and masked.count() == len(got)


def test_run(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, sf_dir)
    t = Tokenizer.from_file(vocabulary())
    want = {r["doc_id"]: np.array([*t.encode(r["text"], add_special_tokens=False).ids, 0], dtype="<u4") for r in docs.collect()}
    pieces = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(pieces["doc_id"]) == set(want)
    for i, own in pieces.sort_values("start").groupby("doc_id"):
        assert own["length"].sum() == len(want[i])
        assert [zlib.crc32(want[i][s : s + n].tobytes()) for s, n in zip(own["start"], own["length"])] == own["ids_crc32"].tolist()
