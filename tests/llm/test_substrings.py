"""Repeated passages that hide behind other places or other documents."""

import random

import numpy as np
import pyarrow as pa
import pytest

from framepack.llm import substrings


def words(rng, n):
    return [f"w{rng.randrange(1 << 40)}" for _ in range(n)]


def hashes(w):
    return substrings.shingle_hashes(*substrings.word_hashes([" ".join(w)]))[0]


def covered(x, y):
    return {k for a, b, *_ in substrings.passages(hashes(x), hashes(y)) for k in range(a, b)}


def test_quoted_opening():
    """An exact repeat whose opening, or another part, stands elsewhere in the other text as well."""
    rng = random.Random(3)
    for n in (50, 51, 60, 75, 90, 200):
        for a, b in ((0, 30), (0, n - 1), (10, 40), (n - 30, n)):
            p = words(rng, n)
            y = words(rng, 20) + p[a:b] + words(rng, 40) + p + words(rng, 20)
            assert covered(words(rng, 33) + p + words(rng, 12), y) >= set(range(33, 33 + n)), (n, a, b)
    line = words(rng, 10)
    x = line * 4 + words(rng, 30) + line
    assert covered(words(rng, 5) + x, line * 30 + words(rng, 50) + x) >= set(range(5, 85))


def test_edited_side_by_side():
    """Edited passages that lie side by side in one text and far apart, and in another order, in the other."""
    rng = random.Random(4)
    p, q = words(rng, 80), words(rng, 80)
    e, f = list(p), list(q)
    e[40], f[35] = "edited", "edited"
    y = words(rng, 30) + f + words(rng, 300) + e + words(rng, 9)
    got = covered(p + q, y)
    assert len(got) >= 155


def test_diagonals_in_parts(monkeypatch):
    """Few hits at a time give the same bands' hits as all at once."""
    rng = random.Random(5)
    pool = words(rng, 6)
    x, y = (np.array([hash(rng.choice(pool)) & 0xFFFF for _ in range(n)], dtype=np.uint64) for n in (150, 330))
    order = np.argsort(y, kind="stable")
    pairs = lambda: {(int(a), int(b)) for i, j in substrings._diagonals(x, y, order) for a, b in zip(i, j)}
    whole = pairs()
    monkeypatch.setattr(substrings, "_HITS", 500)
    assert pairs() == whole == {(i, j) for i in range(150) for j in range(330) if x[i] == y[j] and (i, j) in whole}
    assert len(whole) > 0.99 * sum(int((y == v).sum()) for v in x)


def test_lesser_fragments(spark):
    """Lesser documents with fragments of a passage, in any number, do not keep those that share the whole of it apart."""
    rng = random.Random(6)
    rows, want = [], set()
    for k in range(25):
        p, base = words(rng, 50 + 2 * k), 100 * k
        for i in range(k % 20 + 1):
            a = rng.randrange(len(p) - 48)
            rows.append((base + i, " ".join(words(rng, 15) + p[a : a + rng.randint(30, 49)] + words(rng, 15))))
        rows += [(base + 50 + i, " ".join(words(rng, 20 + i) + p + words(rng, 20))) for i in range(3)]
        want |= {(base + 50 + i, w) for i in (1, 2) for w in range(20 + i, 20 + i + len(p))}
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], w) for r in got for w in range(r["start"], r["end"])} >= want
    text = {i: hashes(t.split()) for i, t in rows}
    assert all(r["first_id"] < r["doc_id"] and substrings.passages(text[r["doc_id"]], text[r["first_id"]]) for r in got)


def test_lesser_fragments_edited(spark):
    """Edited passages are found behind more lesser fragments than the first round looks at."""
    rng = random.Random(7)
    rows, near = [], set()
    for k in range(20):
        p, base = words(rng, 120), 100 * k
        q = list(p)
        q[40], q[80] = "edited", "edited"
        rows += [(base + i, " ".join(words(rng, 15) + p[at : at + 45] + words(rng, 15))) for i, at in enumerate([0, 38, 75] * 7)]
        rows += [(base + 50, " ".join(words(rng, 20) + p)), (base + 51, " ".join(words(rng, 30) + q))]
        near.add((base + 51, base + 50))
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({(r["doc_id"], r["first_id"]) for r in got} & near) >= 0.9 * len(near)


def found(spark, rows):
    """Passages by document (id, text)."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    text = {r["h"]: r["text"] for r in d.selectExpr("xxhash64(text) h", "text").collect() if r["text"]}
    out = {}
    for r in substrings._passages(d, "doc_id", "text", 50, 0.8).collect():
        out.setdefault((r["id"], text[r["h"]]), []).append((r["start"], r["end"], (r["first_id"], text[r["first_h"]]), r["first_start"], r["first_end"], r["similarity"]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    """Every run of 50 words that a lesser document has is covered, and what is reported is similar: against all pairs of documents. Fragments,
    edited passages, copies, repeated lines, one id with several texts, and a line that a third of the documents have."""
    rng = random.Random(seed)
    pool = [words(rng, rng.choice([50, 51, 60, 90, 150])) for _ in range(12)]
    line, rows = words(rng, 30), []
    for i in range(150):
        w = words(rng, rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(pool))
            a = rng.choice([0, 0, rng.randrange(len(p) - 44)])
            p = p[a : a + rng.choice([30, 45, 49, 50, 200, 200])]
            for _ in range(rng.choice([0, 0, 1, 2])):
                p[rng.randrange(len(p))] = f"e{rng.randrange(1 << 30)}"
            w += p + words(rng, rng.randint(0, 20))
        if i % 3 == 0:
            w += line
        if i % 17 == 0:
            w += words(rng, 7) * 12
        rows.append((i if i % 10 else 5, " ".join(w)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, rows[40][1]), (502, rows[40][1]), (7, None), (None, rows[2][1])]
    docs = sorted({(i, t) for i, t in rows if i is not None and t}, key=lambda d: (d[0], d[1]))
    order = {r["text"]: r["h"] for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("xxhash64(text) h", "text").collect()}
    docs.sort(key=lambda d: (d[0], order[d[1]]))
    got, seen = found(spark, rows), set()
    for i, t in docs:
        w = t.split()
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        covered = [(a, b) for a, b, *_ in got.get((i, t), [])]
        for k, run in enumerate(runs):
            if run in seen:
                assert {p for a, b in covered for p in range(a, b)} >= set(range(k, k + 50)), (i, k)
        seen.update(runs)
    for (i, t), spans in got.items():
        for a, b, (j, u), c, e, s in spans:
            assert (j, order[u]) < (i, order[t]) and 50 <= b - a
            x, y = (set(hashes(v)) for v in (t.split()[a:b], u.split()[c:e]))
            assert len(x & y) / len(x | y) >= 0.8 <= s
    assert sum(len(v) for v in got.values()) > 70


def test_edited_in_a_hot_group(spark):
    """Near copies of one text, edited at many places: whoever has a similar run of 50 words in a lesser text is named, against all pairs."""
    rng = random.Random(9)
    base, rows = words(rng, 110), []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(2, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1 << 30)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"] for r in substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    h = {i: hashes(t.split()) for i, t in rows}
    want = {i for i in h if any(substrings.passages(h[i], h[j]) for j in range(i))}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_deduplicated_by_text(spark):
    """Rows of one id are cut by their own passages; null ids and texts, empty tables, and columns named like the operator's own stay."""
    rng = random.Random(10)
    p, q = words(rng, 60), words(rng, 55)
    long = " ".join(words(rng, 40) + p + words(rng, 40))
    rows = [(1, " ".join(p + q), 1, "a"), (2, long, 2, "b"), (2, "a short row", 3, "c"), (2, " ".join(q + ["tail"]), 4, "d"), (None, long, 5, "e"), (3, None, 6, "f"), (4, long, 7, "g"), (5, "", 8, "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans long, key string")
    got = {r["spans"]: r for r in substrings.deduplicated(d).collect()}
    assert substrings.deduplicated(d).columns == d.columns
    cut = " ".join(long.split()[:40] + long.split()[100:])
    assert {k: r["text"] for k, r in got.items()} == {1: rows[0][1], 2: cut, 3: "a short row", 4: "tail", 5: long, 6: None, 7: "", 8: ""}
    assert [got[k]["key"] for k in range(1, 9)] == list("abcdefgh")
    assert substrings.deduplicated(d.where("doc_id > 99")).count() == 0


def test_few_matches_on_a_diagonal_are_no_passage(monkeypatch):
    """Stretches with too few matches for a passage are told by their number, before anything is sorted."""
    import numpy as np

    from framepack.llm import substrings

    rng = np.random.default_rng(3)
    x, y = (rng.integers(0, 1 << 60, 300).astype(np.uint64) for _ in range(2))
    y[::8] = x[::8]
    sorts, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **b: sorts.append(len(a[0])) or plain(*a, **b))
    assert substrings.passages(x, y) == []
    assert sum(n < 100 for n in sorts) <= 1


def test_counts_tell_what_is_not_similar(monkeypatch):
    """Stretches that have too little in common by their counts of shingles are not compared as sets."""
    rng = random.Random(11)
    y = words(rng, 600)
    x = [f"e{k}" if k % 12 == 0 else w for k, w in enumerate(y)]
    made = []
    monkeypatch.setattr(substrings, "set", lambda *a: made.append(a) or set(*a), raising=False)
    assert substrings.passages(hashes(x), hashes(y)) == []
    assert not [a for a in made if a and len(a[0]) > 40]


def test_groups_are_judged_together(monkeypatch):
    """Pairs of several groups are looked at in one go, with the same outcome as group by group; the counts of different values are exact."""
    rng = np.random.default_rng(12)
    rows = []
    for key in range(30):
        base = rng.integers(0, 1 << 30, 82)
        for i in range(20):
            around = np.where(rng.random(82) < 0.04, rng.integers(0, 1 << 30, 82), base)[: rng.integers(46, 83)]
            rows.append((key, i, around.astype(np.int32)))
    zero, n = np.zeros(len(rows), np.int32), len(rows)
    table = pa.table({"key": [r[0] for r in rows], "bi": zero, "bj": zero, "b": zero, "id": [r[1] for r in rows], "h": [r[1] for r in rows], "wanted": [True] * n, "need": np.full(n, 5, np.int32), "around": pa.array([r[2] for r in rows], pa.list_(pa.int32()))})
    cumsums, plain = [], np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda *a, **b: cumsums.append(np.ndim(a[0])) or plain(*a, **b))
    got = substrings._most_alike(table, np.arange(0, n + 1, 20), 2, 46, 0.8)
    assert cumsums.count(2) < 30
    monkeypatch.setattr(substrings, "_PAIRS", 1)
    assert all(np.array_equal(a, b) for a, b in zip(got, substrings._most_alike(table, np.arange(0, n + 1, 20), 2, 46, 0.8))) and len(got[0]) > 300
    s, counts = rng.integers(0, 40, 500).astype(np.uint32), np.array([200, 0, 300])
    lo, hi = np.array([0, 150, 200, 400]), np.array([60, 200, 290, 500])
    assert substrings._different(s, counts, lo, hi).tolist() == [len(np.unique(s[a:b])) for a, b in zip(lo, hi)]


def test_keys_are_those_of_the_windows():
    """The first pass over all texts has the signatures of the second, also of short, empty and null texts."""
    rng = random.Random(13)
    texts = [" ".join(words(rng, n)) for n in (0, 4, 49, 50, 51, 300)] + [None, " ".join(words(rng, 7) * 20), "ä " * 70]
    text, key, f, *_ = substrings.signatures(texts)
    own, windows, long, whole = substrings.keys(texts)
    assert np.array_equal(text[f >= 0], own) and np.array_equal(key[f >= 0], windows)
    assert np.array_equal(text[f < 0], long) and np.array_equal(key[f < 0], whole) and len(long) == 5


def test_stuttering_is_told_by_different_shingles(monkeypatch):
    """Runs of text said over and over are told apart by their different shingles; no band of diagonals comes twice."""
    rng = random.Random(14)
    line = words(rng, 30)
    y = words(rng, 40) + line * 8 + words(rng, 40)
    x = words(rng, 20) + [w for k in range(8) for w in [*line[:26], f"e{k}", *line[27:]]] + words(rng, 20)
    s = np.array([hash(w) & 0xFFFF for w in x], dtype=np.uint64)
    order = np.argsort(s, kind="stable")
    assert substrings._differ(order, s[order], np.ones(len(s), bool), 46).tolist() == [len(set(s[k : k + 46].tolist())) for k in range(len(s) - 45)]
    made = []
    monkeypatch.setattr(substrings, "set", lambda *a: made.append(a) or set(*a), raising=False)
    got = substrings.passages(hashes(x), hashes(y))
    assert sum(bool(a) and len(a[0]) == 46 for a in made) < 150 and not got
    p = hashes(words(rng, 200))
    bands = [tuple(zip(i.tolist(), j.tolist())) for i, j in substrings._diagonals(p, p, np.argsort(p, kind="stable"))]
    assert len(bands) == len(set(bands)) == 1
