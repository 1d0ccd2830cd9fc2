"""Operators against plain versions of themselves, and against the libraries they must agree with."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framepack.llm import bpe, buckets, common, embeddings, licenses, packing, pii, secrets, simhash, spans, substrings, tokencount
from framepack.llm import queries as llm
from tests.oracle import same


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    same(llm.queries()[name](spark, sf_dir), llm.oracle_sql()[name], sf_dir)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(llm.vocabulary())
    return {i: t.encode(x, add_special_tokens=False).ids for i, x in texts.items()}


HARD = ["", " ", "a  b \n c\t d", "<|endoftext|>", "x<|endoftext|> y", "a" * 900, "don't we'll I'M 12345 ½ ٣٤ \x1c \x85 a　b 日本語テキスト \U0001f389 <|endoftext", "\n\n\n", " \n x", "é" * 700, "a  b "]


def test_codec_agrees_with_the_library():
    from tokenizers import Tokenizer

    c, t = bpe.codec(llm.vocabulary()), Tokenizer.from_file(llm.vocabulary())
    ids, n = c.encode(HARD)
    at = np.cumsum(n)
    for text, end, k in zip(HARD, at, n):
        assert ids[end - k : end].tolist() == t.encode(text, add_special_tokens=False).ids
        assert c.decode(ids[end - k : end]).decode() == text
    whole, n = c.encode_words(c.token_bytes[:50256])
    assert (n == 1).all()  # every token is its own encoding, so pairs decide


def test_bpe_and_packing_and_counts(spark, sf_dir, texts, encoded):
    for r in llm.op2_bpe(spark, sf_dir).collect():
        ids = encoded[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    pieces = llm.op9_packing(spark, sf_dir).toPandas()
    for i, own in pieces.sort_values("start").groupby("doc_id"):
        ids = np.array([*encoded[i], 0], dtype="<u4")
        assert own["start"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"])] == own["ids_crc32"].tolist()
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        total = own["length"].sum()
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and total <= 1024 and total & (total - 1) == 0
    assert {r["doc_id"]: r["n_tokens"] for r in llm.op4_token_counts(spark, sf_dir).collect()} == {i: len(x) for i, x in encoded.items()}


def test_encode_decode_round_trip(spark, texts):
    d = spark.createDataFrame(list(texts.items())[:50], "doc_id long, text string")
    back = bpe.decode(bpe.encode(d, llm.vocabulary()), llm.vocabulary())
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(list(texts.items())[:50])


def test_differencing():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 40))]
        found = packing.partition(sizes, 128)
        assert sorted(i for w in found for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 128 for w in found)
        cut = packing.windows(np.array(sizes) * 7, 64)
        seen = sorted((i, s + k) for w in cut for i, s, n in w for k in range(n))
        assert seen == [(i, k) for i, s in enumerate(sizes) for k in range(7 * s)]
        lengths = [sum(n for _, _, n in w) for w in cut]
        assert all(x == 64 or x & (x - 1) == 0 for x in lengths) and sum(x < 64 for x in lengths) <= 6
    near = [sum(w) for w in (lambda s: [[s[i] for i in p] for p in packing.difference(s, 4)])(list(range(1, 41)))]
    assert max(near) - min(near) <= 2


def test_flat_token_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    want = []
    for f in range(2):
        ids = rng.integers(0, 6, 300_000).astype("<u2")
        ids.tofile(tmp_path / f"{f}.bin")
        lengths = np.diff(np.concatenate([[-1], np.flatnonzero(ids == 5)])) - 1
        tail = len(ids) - 1 - np.flatnonzero(ids == 5)[-1]
        want += lengths.tolist() + [int(tail)] * int(tail > 0)
    got = tokencount.scan(tokencount.read_files(spark, str(tmp_path)), 5)
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(want)
    one = np.zeros(200_000, dtype="<u2")
    one[[150_000, 199_999]] = 7
    one.tofile(tmp_path / "c.bin")
    got = tokencount.scan(tokencount.read_files(spark, str(tmp_path / "c.bin")), 7)
    assert sorted((r["ordinal"], r["n_tokens"]) for r in got.collect()) == [(0, 150_000), (1, 49_998)]


def shingled(text, k=4):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def linked(fp, bits=4):
    return [(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= bits) if i < j]


def test_simhash(spark, sf_dir, texts):
    got = llm.op10_simhash(spark, sf_dir).orderBy("doc_id").collect()
    fps = []
    for r in got:
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingled(texts[r["doc_id"]])]
        fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert r["fingerprint"] == f"{fp:016x}"
        fps.append(fp)
    ids = [r["doc_id"] for r in got]
    root = components(len(fps), linked(np.array(fps, dtype=np.uint64)))
    assert [r["component_id"] for r in got] == [ids[i] for i in root]


@pytest.mark.parametrize("block", [6, 40, 1024])
def test_simhash_groups_of_near_copies(spark, block):
    rng = random.Random(block)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(70):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = np.array(sorted(fps), dtype=np.uint64)
    d = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fps.view(np.int64))], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.cluster(d, block=block).collect()}
    root = components(len(fps), linked(fps))
    assert [got[i] for i in range(len(fps))] == root


@pytest.mark.parametrize("block", [8, 1024])
def test_embeddings(spark, block):
    rng = np.random.default_rng(block)
    base = rng.normal(size=(60, 48))
    v = np.concatenate([base, base[:20] + rng.normal(size=(20, 48)) * 0.25, np.repeat(base[:2], 40, axis=0) + rng.normal(size=(80, 48)) * 0.02, base[5:7]]).astype(np.float32)
    label = [i % 2 for i in range(len(v))]
    d = spark.createDataFrame([(i, x.tolist(), k) for i, (x, k) in enumerate(zip(v, label))], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(d, block=block).collect()}
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == label)
    np.fill_diagonal(near, False)
    exact = near.sum() / 2
    found = sum(r["n_links"] for r in got.values()) / 2
    assert exact >= found >= 0.97 * exact
    if found == exact:
        root = components(len(v), list(zip(*map(list, np.nonzero(near)))))
        assert [got[i]["component_id"] for i in range(len(v))] == root


def test_compact_windows():
    rng = np.random.default_rng(0)
    text = np.repeat([0, 1, 2, 3], [150, 30, 220, 5])
    for spread in (1 << 60, 30):
        h = rng.integers(0, spread, len(text), dtype=np.uint64)
        want = []
        for c in range(len(h)):
            l = r = c
            while l and text[l - 1] == text[c] and h[l - 1] >= h[c]:
                l -= 1
            while r + 1 < len(h) and text[r + 1] == text[c] and h[r + 1] >= h[c]:
                r += 1
            if r - l + 1 >= 20:
                want.append((l, c, r))
        assert sorted(zip(*(x.tolist() for x in substrings.windows(h, text, 20)))) == sorted(want)


def passage(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_repeated_passages(spark):
    rng = random.Random(1)
    rows, want, near = [(i, " ".join(passage(rng, rng.randint(10, 300)))) for i in range(60)], set(), set()
    for k in range(40):
        p = passage(rng, rng.choice([51, 60, 200]))
        q = list(p)
        for _ in range(max(1, len(q) // 80) if k % 2 else 0):
            q[rng.randrange(len(q))] = "edited"
        a, b = 100 + 2 * k, 101 + 2 * k
        rows += [(a, " ".join(passage(rng, rng.randint(0, 90)) + p + passage(rng, 30))), (b, "\n".join(passage(rng, rng.randint(0, 90)) + q + passage(rng, 50)))]
        (near if k % 2 else want).add((b, a))
    shared = passage(rng, 70)
    rows += [(300 + i, " ".join(passage(rng, 40) + shared + passage(rng, i))) for i in range(12)]
    want |= {(301 + i, 300) for i in range(11)}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.repeats(d).collect()
    found = {(r["doc_id"], r["first_id"]) for r in got}
    assert found - near == want and len(found & near) >= 0.9 * len(near)  # min-hashes find edited passages with high probability
    assert all(r["similarity"] >= 0.8 and r["end"] - r["start"] >= 50 for r in got)
    kept = {r["doc_id"]: r["text"].split() for r in substrings.deduplicated(d).collect()}
    assert len(kept) == len(rows) and kept[305] == rows[-7][1].split()[:40] + rows[-7][1].split()[110:] and kept[300] == rows[-12][1].split()


def test_personal_data_base(spark, sf_dir, texts):
    def luhn(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            s += x - 9 * (x > 9)
        return s % 10 == 0

    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
    }
    hard = {-1: "a@b.c_d@e.f x.@y.z 1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.255 4111 1111 1111 1111 +1 (234) 567-8901 +12(((", -2: "4111-1111-1111-1112 4111111111111111 +1+2345678901 é\U0001f389 q@é.b q@a-.b", -3: "0000 0000 0000 00"}
    d = spark.createDataFrame([*texts.items(), *hard.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.scan(d).select("doc_id", spans.listed(F.col("base_spans"), pii.KINDS).alias("s")).collect()}
    for i, text in (texts | hard).items():
        want = sorted((m.start(), k, name, m.end()) for k, (name, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m[0]))
        assert got[i] == ",".join(f"{n}:{a}:{b}" for a, _, n, b in want), text[:80]


def test_disclosing_terms(spark):
    """A name that only occurs beside one address discloses it; words that are common elsewhere do not."""
    rows = [(i, f"note {i} Contact Zebulon at zeb@example.org please Monday {i}") for i in range(4)]
    rows += [(10 + i, f"text {i} on Monday with Contact details {i}") for i in range(40)]
    got = {r["doc_id"]: r["s"] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", spans.listed(F.col("spans"), pii.KINDS).alias("s")).collect()}
    for i, text in rows[:4]:
        a, b = text.index("Zebulon"), text.index("zeb@")
        assert got[i] == f"term:{a}:{a + 7},email:{b}:{b + 15}"
    assert all(got[i] == "" for i, _ in rows[4:])


def test_licence_positions(spark):
    text = "Licensed under GNU general public license; the MIT License. apache, license CC BY-NC (cc-by) mitlicense"
    d = spark.createDataFrame([(1, text), (2, "the gnu lesser general public license and Mozilla Public License")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(d).select("doc_id", "license.*").collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (17, 5, 2, 14)
    assert got[1]["base_labels"] == ["apache", "cc-by", "gpl", "mit"] and got[1]["labels"] == ["apache", "cc-by", "cc-by-nc", "gpl", "mit"]
    assert got[2]["base_labels"] == [] and got[2]["labels"] == ["lgpl", "mpl"]


@pytest.mark.parametrize("n", [2, 30, 300])
def test_components(spark, n):
    rng = random.Random(n)
    pairs = [(i, i + 1) for i in range(0, n - 1) if i % 37] + [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 10)]
    names = list(range(1000, 1000 + n))
    rng.shuffle(names)
    d = spark.createDataFrame([(names[a], names[b]) for a, b in pairs], "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected(d).collect()}
    root = components(n, pairs)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, 1 << 60), names[i])
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {names[i]: least[root[i]] for i in touched}


def test_spanning():
    m = np.zeros((6, 6), dtype=bool)
    for a, b in ((0, 1), (1, 2), (4, 5)):
        m[a, b] = m[b, a] = True
    a, b = buckets.spanning(m)
    assert len(a) == 3 and components(6, zip(a.tolist(), b.tolist())) == [0, 0, 0, 3, 4, 4]


def test_license_places(spark):
    """Every place that the definition has is found, whichever words of a template were replaced, also among 400 other rows that make other
    words rare; K (Kelvin sign) is no k."""
    rng = random.Random(8)
    rows, plain = [], licenses.words_of
    for n, t in enumerate(licenses.TEMPLATES):
        for k in range(8):
            w = list(t.words)
            for _ in range(0 if k == 0 else rng.randint(0, max(1, len(w) // 4))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            rows.append(" ".join(["some", "words"] * rng.randint(0, 3) + w + ["tail"] * rng.randint(0, 2)).upper() if k % 2 else ", ".join(w))
    rows += [" ".join(rng.choice("the of and to in software license is copy public".split()) for _ in range(60)) for _ in range(400)] + ["MIT LICENSE " * 300, "mit license a\u212A", None, ""]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(d).select("doc_id", "license.*").collect()}
    words = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in rows]
    df = {w: sum(w in set(x) for x in words) for t in licenses.TEMPLATES for w in t.words}
    idf = {w: np.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}
    for i, w in enumerate(words):
        labels, base, score = set(), [], 0.0
        for t in licenses.TEMPLATES:
            tw, total = t.words, sum(idf[x] for x in t.words)
            ranges = [next((a, a + len(p.split())) for a in range(len(tw)) if tw[a : a + len(p.split())] == p.split()) for p in t.mandatory] or [(0, len(tw))]
            for o in range(-len(tw), len(w)):
                same = [0 <= o + j < len(w) and w[o + j] == x for j, x in enumerate(tw)]
                share = sum(idf[x] for x, s in zip(tw, same) if s) / total
                if any(all(same[a:b]) for a, b in ranges) and share >= licenses.SHARE - 1e-9:
                    labels.add(t.label)
                    score = max(score, share)
                    base += [o] * t.base
        r = got[i]
        assert (r["n_words"], r["labels"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), sorted(labels), len(base), min(base, default=None), max(base, default=None)), rows[i]
        assert abs(r["score"] - score) < 1e-6


def test_embeddings_of_any_magnitude(spark):
    rows = [(1, [1e200, 1e200, 0.0]), (2, [1e200, 1.01e200, 0.0]), (3, [1e-200, 1e-200, 0.0]), (4, [1e-200, 1.01e-200, 0.0]), (5, [0.0, 0.0, 1e-310]), (6, [0.0, 0.0, -1.0])]
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(d).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


@pytest.mark.parametrize("dimension", [3, 32, 64, 200])
@pytest.mark.parametrize("n", [1000, 10**7])
def test_embedding_tables_find_pairs_at_the_threshold(dimension, n):
    rng = np.random.default_rng(dimension)
    tables, joined = embeddings.plan(dimension, n, 0.93)
    x, o = rng.normal(size=(2, 600, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o -= (o * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    a, b = (embeddings.bucket_codes(z, tables, joined).reshape(600, -1) for z in (x, y))
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() >= 0.98


def test_many_spans_in_one_text(spark):
    """40,000 matches in one text: positions, masks and redaction, in seconds."""
    text = " zz ".join(f"{i:024x}" for i in range(40_000)) + " \U0001f389 end"
    d = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    want = [m.span() for m in re.finditer("[0-9a-f]{24,}", text)]
    got = secrets.scan(d, repo_col="source", owner_col="source").first()
    assert [(s["start"], s["end"]) for s in got["base_spans"]] == want and got["n_live"] == len(want)
    masked = secrets.redacted(d, repo_col="source", owner_col="source").first()["text"]
    assert masked == re.sub("[0-9a-f]{24,}", "<SECRET>", text)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200, 4097])
def test_running_sums(spark, n):
    from pyspark.sql.functions import col

    xs = [(7 * i) % 11 for i in range(n)]
    d = spark.createDataFrame([(xs,)], "x array<int>")
    if n:
        assert d.select(spans.before(col("x"), lambda a, x: a + x)).first()[0] == [sum(xs[:i]) for i in range(n)]


def test_whole_words_are_terms(spark):
    """Names of three letters and words of a hundred are terms as a whole, and nothing that begins within a word is."""
    long = "Z" * 100
    rows = [(i, f"note {i} Ann {long} xAnnx met ann@example.org on the day {i}") for i in range(6)] + [(100 + i, f"plain text {i} of nobody") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.scan(d).select("doc_id", spans.listed(F.col("spans"), pii.KINDS).alias("s")).collect()}
    for i, text in rows[:6]:
        a, b = text.index("Ann "), text.index(long)
        assert [x for x in got[i].split(",") if x.startswith("term")] == [f"term:{a}:{a + 3}", f"term:{b}:{b + 100}"]


def test_surplus_windows_are_dissolved():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 3000, 400)
    found = packing.windows(sizes, 256)
    held = np.zeros(len(sizes), dtype=int)
    for w in found:
        total = sum(n for _, _, n in w)
        assert total <= 256 and total & (total - 1) == 0
        for i, _, n in w:
            held[i] += n
    assert (held == sizes).all() and sum(sum(n for _, _, n in w) < 256 for w in found) <= 8
