"""Byte-level BPE encoding and decoding by speculation and verification.

A text is cut before every space that a non-space follows (byte-level pre-tokens always begin there), and each distinct piece is encoded
once per worker. New pieces are cut into pre-tokens; a trie proposes the longest matching token again and again, for all pre-tokens in
step. A proposal is the true encoding exactly if every adjacent pair of tokens is: the pairs of all pre-tokens are tested in one vectorised
pass that undoes the merges on both sides of the border. Pre-tokens with a failing pair are merged exactly, in order of rank.

Special tokens in a text are recognised as in the vocabulary file unless `specials` is false. Null texts are empty and have no ids.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The characters with the Unicode property White_Space, for use inside a character class.
SPACES = " \t-\r\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The pre-token pattern of byte-level BPE vocabularies (a fixed value), with white space as the Unicode property.
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
SPACED = re.compile(f" [{SPACES}]")
BEFORE_WORD = re.compile(f" (?=[^{SPACES}])")
#: Pre-tokens longer than this go straight to exact merging, which takes n log n steps.
LONG = 256
#: Words up to this many bytes are merged together.
SHORT = 48
NEVER = 1 << 60
#: Distinct pieces that a worker remembers.
REMEMBERED = 150_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself if printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The rows `pick` of a ragged array, one after another."""
    n = lengths[pick]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return flat[:0]
    return flat[np.repeat(starts[pick] - (ends - n), n) + np.arange(total)]


class _Table:
    """A map from int64 to int64 for whole arrays: open addressing, at most a quarter full, so few slots are tried."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.mask, self.missing = (1 << self.bits) - 1, missing
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, missing, dtype=np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], self.missing)
        more = np.flatnonzero((found != keys) & (found != -1))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            found = self.keys[slot[more]]
            hit = found == keys[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (found != -1)]
        return out


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, specials: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if specials}
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for t in spec.get("added_tokens", []):
            self.token_bytes[t["id"]] = t["content"].encode()
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, l, r = vocab[a + b], vocab[a], vocab[b]
            self.merge[l, r] = (rank, i)
            self.left[i], self.right[i] = l, r
        # The order of merging: single bytes first, then by rank.
        self.order = np.full(size, -1, dtype=np.int64)
        for rank, i in self.merge.values():
            self.order[i] = rank
        ranks = np.array([v[0] for v in self.merge.values()], dtype=np.int64)
        self.pairs = _Table(np.array([l << 32 | r for l, r in self.merge], dtype=np.int64), ranks, NEVER)
        self.rank_id = np.array([v[1] for v in self.merge.values()], dtype=np.int32)
        self.byte_id = [vocab[{b: c for c, b in letters.items()}[i]] for i in range(256)]
        self.byte_ids = np.array(self.byte_id, dtype=np.int32)
        self._trie({i for i in vocab.values()})
        lengths = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self.text_flat, self.text_len = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8), lengths
        self.text_at = np.cumsum(lengths) - lengths
        digits = [b"%d," % i for i in range(size)]
        self.digit_len = np.array([len(d) for d in digits], dtype=np.int64)
        self.digit_flat, self.digit_at = np.frombuffer(b"".join(digits), dtype=np.uint8), np.cumsum(self.digit_len) - self.digit_len
        self._forget()

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a and b; NEVER if they do not merge."""
        return self.pairs.get(a.astype(np.int64) << 32 | b)

    def _trie(self, ids: set[int]) -> None:
        node: dict[bytes, int] = {b"": 0}
        for i in sorted(ids):
            t = self.token_bytes[i]
            for k in range(1, len(t) + 1):
                node.setdefault(t[:k], len(node))
        # Steps from node to node by a byte, in an open-addressing table like that of the pairs.
        self.step = _Table(np.array([node[t[:-1]] << 8 | t[-1] for t in node if t], dtype=np.int64), np.array([n for t, n in node.items() if t], dtype=np.int64), 0)
        self.node_token = np.full(len(node), -1, dtype=np.int32)
        for i in ids:
            self.node_token[node[self.token_bytes[i]]] = i

    # -- exact merging -----------------------------------------------------------------------------------------------------------

    def merged(self, word: bytes) -> list[int]:
        """The definition: the adjacent pair of least rank, leftmost first, is merged until none is left; a heap finds it."""
        ids = [self.byte_id[b] for b in word]
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merge.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [i for i in ids if i >= 0]

    def merged_many(self, flat: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merged() of many short words of a flat array at once: each round merges the least pair of every word that still has one. Ids of
        all words one after another, and the number of ids of each."""
        n, width = len(start), int(lengths.max()) + 1
        column = np.arange(width)
        inside = column < lengths[:, None]
        ids = self.byte_ids[flat[np.where(inside, start[:, None] + column, 0)]]
        rank = np.full((n, width), NEVER, dtype=np.int64)
        pairs = inside[:, :-1] & inside[:, 1:]
        rank[:, :-1][pairs] = self.rank_of(ids[:, :-1][pairs], ids[:, 1:][pairs])
        after = np.tile(np.arange(1, width + 1, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int16), (n, 1))
        live = np.arange(n)
        while len(live):
            i = rank[live].argmin(axis=1)
            best = rank[live, i]
            some = best < NEVER
            if not some.all():
                live, i, best = live[some], i[some], best[some]
            j = after[live, i]
            k = after[live, j]
            new = self.rank_id[best]
            ids[live, i], inside[live, j] = new, False
            rank[live, j], rank[live, i] = NEVER, NEVER
            after[live, i] = k
            on = k < lengths[live]
            w, x, y = live[on], i[on], k[on]
            before[w, y] = x
            rank[w, x] = self.rank_of(new[on], ids[w, y])
            h = before[live, i]
            on = h >= 0
            w, x, y = live[on], h[on], i[on]
            rank[w, x] = self.rank_of(ids[w, x], new[on])
        return ids[inside], inside.sum(axis=1)

    # -- speculation and verification --------------------------------------------------------------------------------------------

    def proposed(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words in step: ids, and each id's word. The words follow one another in flat, which has a byte
        more; words over LONG bytes are left out."""
        end = np.cumsum(lengths)
        cur = end - lengths
        lengths = np.where(lengths > LONG, 0, lengths)
        who = np.flatnonzero(lengths)
        cur, stop = cur[who], end[who]
        node, best, best_at = np.zeros(len(who), np.int64), np.zeros(len(who), np.int32), cur.copy()
        out_id, out_word = [], []
        while len(who):
            nxt = self.step.get(node.astype(np.int64) << 8 | flat[cur])  # 0, the root, is nobody's child and means: no way on
            nxt[cur >= stop] = 0
            on = nxt > 0
            node = nxt
            cur = cur + on
            token = self.node_token[node]
            hit = on & (token >= 0)
            best[hit], best_at[hit] = token[hit], cur[hit]
            if not on.all():
                done = ~on
                out_id.append(best[done])
                out_word.append(who[done])
                cur[done] = best_at[done]
                going = ~(done & (best_at >= stop))
                if not going.all():
                    who, cur, stop, node, best, best_at = (x[going] for x in (who, cur, stop, node, best, best_at))
        if not out_id:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ids, word = np.concatenate(out_id), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and b, side by side, stay as they are: undoing their merges from the latest on, no pair across the border may ever
        have been merged before the merge that is being undone."""
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        # A pair across the border that merges with a rank under `limit` would have come first; a tie goes to the left side.
        limit = np.full(len(a), NEVER, dtype=np.int64)
        while len(live):
            bad = self.rank_of(a, b) < limit
            ok[live[bad]] = False
            ra, rb = self.order[a], self.order[b]
            undo_a = ra > rb  # equal ranks: the left one was merged first, so the right one is undone first
            over = (ra < 0) & (rb < 0)
            limit = np.where(undo_a, ra, rb + 1)
            na, nb = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            keep = ~(bad | over)
            live, a, b, limit = live[keep], na[keep], nb[keep], limit[keep]
        return ok

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
        start = np.cumsum(lengths) - lengths
        ids, word = self.proposed(flat, lengths)
        redo = lengths > LONG
        if len(ids) > 1:
            inner = np.flatnonzero(word[1:] == word[:-1])
            key, back = np.unique(ids[inner].astype(np.int64) << 32 | ids[inner + 1], return_inverse=True)
            fits = self.compatible(key >> 32, key & 0xFFFFFFFF)[back]
            redo[word[inner[~fits]]] = True
        if not redo.any():
            return ids, np.bincount(word, minlength=len(words))
        keep = ~redo[word]
        all_ids, all_words = [ids[keep]], [word[keep]]
        for least, most in ((0, 8), (8, 12), (12, 18), (18, SHORT)):
            some = np.flatnonzero(redo & (lengths > least) & (lengths <= most))
            if len(some):
                found, n = self.merged_many(flat, start[some], lengths[some])
                all_ids.append(found)
                all_words.append(np.repeat(some, n))
        for i in np.flatnonzero(redo & (lengths > SHORT)).tolist():
            found = self.merged(words[i])
            all_ids.append(np.array(found, dtype=np.int32))
            all_words.append(np.full(len(found), i))
        ids, word = np.concatenate(all_ids), np.concatenate(all_words)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))

    # -- texts -------------------------------------------------------------------------------------------------------------------

    def _forget(self) -> None:
        self.known = len(self.special)
        self.rest, self.first = _Pieces(self, " "), _Pieces(self, "")
        self.pending: list[str] = []
        self.flat = np.fromiter(self.special.values(), np.int32, len(self.special))
        self.lens = np.ones(len(self.special), dtype=np.int64)
        self.special_piece = {s: i for i, s in enumerate(self.special)}
        self.words: dict[str, int] = {}
        self.word_flat, self.word_lens = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _pieces(self, text: str) -> list[int]:
        parts = BEFORE_WORD.split(text) if SPACED.search(text) else text.split(" ")
        head = parts[0]
        out = list(map(self.rest.__getitem__, parts[1:]))
        return [self.first[head], *out] if head else out

    def _learn(self) -> None:
        """Encodes the pending pieces and appends them to what is remembered."""
        if not self.pending:
            return
        known, fresh, which = self.words, [], []
        counts = np.ones(len(self.pending), dtype=np.int64)
        for i, piece in enumerate(self.pending):
            if piece.isalpha() or piece[:1] == " " and piece[1:].isalpha():
                found = (piece,)
            elif piece[-1] in ".,;:!?" and (piece[:-1].isalpha() or piece[:1] == " " and piece[1:-1].isalpha()):
                found = (piece[:-1], piece[-1])
                counts[i] = 2
            else:
                found = PRETOKEN.findall(piece)
                counts[i] = len(found)
            for word in found:
                if (at := known.get(word)) is None:
                    known[word] = at = len(known)
                    fresh.append(word.encode())
                which.append(at)
        ids, n = self.encode_words(fresh)
        self.word_flat, self.word_lens = np.concatenate([self.word_flat, ids]), np.concatenate([self.word_lens, n])
        pick = np.array(which, dtype=np.int64)
        self.flat = np.concatenate([self.flat, ragged(self.word_flat, np.cumsum(self.word_lens) - self.word_lens, self.word_lens, pick)])
        self.lens = np.concatenate([self.lens, np.add.reduceat(self.word_lens[pick], np.cumsum(counts) - counts)])
        self.pending = []

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        if self.known > REMEMBERED:
            self._forget()
        pieces: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            before = len(pieces)
            if self.special_re is not None and self.special_re.search(text):
                at = 0
                for m in self.special_re.finditer(text):
                    if m.start() > at:
                        pieces += self._pieces(text[at : m.start()])
                    pieces.append(self.special_piece[m[0]])
                    at = m.end()
                if at < len(text):
                    pieces += self._pieces(text[at:])
            else:
                pieces += self._pieces(text)
            counts[i] = len(pieces) - before
        self._learn()
        pick = np.array(pieces, dtype=np.int64)
        ids = ragged(self.flat, np.cumsum(self.lens) - self.lens, self.lens, pick)
        ends = np.concatenate([[0], np.cumsum(self.lens[pick])])
        upto = np.cumsum(counts)
        return ids, ends[upto] - ends[upto - counts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, special tokens included."""
        return ragged(self.text_flat, self.text_at, self.text_len, ids).tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return ragged(self.digit_flat, self.digit_at, self.digit_len, ids).tobytes()[:-1]


class _Pieces(dict):
    def __init__(self, codec: Codec, prefix: str):
        self.codec, self.prefix = codec, prefix

    def __missing__(self, piece: str) -> int:
        c = self.codec
        c.pending.append(self.prefix + piece)
        self[piece] = i = c.known
        c.known += 1
        return i


@lru_cache(maxsize=2)
def codec(path: str, specials: bool = True) -> Codec:
    """One codec for each worker and vocabulary file. What it holds lives as long as the worker, so the garbage collector leaves it out."""
    gc.collect()
    gc.freeze()
    return Codec(path, specials)


def slices(batch: pa.RecordBatch, text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with bounded text: at most `most` bytes, or one row."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", specials: bool = True) -> DataFrame:
    """(id, ids array<int>) of every row; a null text has an empty array. Other columns are ignored."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path, specials)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, n = c.encode(part.column(1).to_pylist())
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], ["id", "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from arrays of ids; bytes that are no UTF-8 become U+FFFD; null ids give null."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [None if x is None else c.decode(np.asarray(x, dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids again, and returns (id, n_tokens, ids_sha256, decoded_sha256) for each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batches):
        c = codec(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, n = c.encode(part.column(1).to_pylist())
                ends = np.cumsum(n)
                ids_sha, text_sha = [], []
                for e, k in zip(ends, n):
                    own = ids[e - k : e]
                    ids_sha.append(sha(c.decimal(own)))
                    data = c.decode(own)
                    try:
                        data.decode()
                    except UnicodeDecodeError:
                        data = data.decode("utf-8", "replace").encode()
                    text_sha.append(sha(data))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
