"""DuckDB SQL for the queries that SQL can express. Tables of words, rules and templates come from the operators' own constants."""

from __future__ import annotations

from framepack.llm import licenses, quality, secrets


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _quality() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
    per = lambda a, b: f"(CASE WHEN {b} > 0 THEN {a} / {b}::DOUBLE ELSE 0 END)"
    measures = {
        "n_words": "n_words",
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
        "mean_word_length": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "bang_ratio": per("len(regexp_extract_all(t, '!'))", "n_words"),
        "letter_word_ratio": per("len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}')))", "n_words"),
        "stop_word_ratio": per(f"len(list_filter(w, lambda x: lower(x) IN ({stops})))", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "len(l)"),
        "bullet_line_ratio": per("len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t]*[-*•]')))", "len(l)"),
        "ellipsis_line_ratio": per("len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t\\r]*$')))", "len(l)"),
    }
    tests = [f"{measures[n]} >= {a}" for n, a, _ in quality.RULES if a is not None] + [f"{measures[n]} <= {b}" for n, _, b in quality.RULES if b is not None]
    return f"""
WITH d AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g JOIN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY 1),
m AS (SELECT d.*, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept FROM b"""


def _licenses() -> str:
    phrases, words = [], []
    for n, t in enumerate(licenses.TEMPLATES):
        for p in t.mandatory or (t.text,):
            ws = p.split()
            at = next(i for i in range(len(t.words)) if t.words[i : i + len(ws)] == ws)
            phrases.append(f"({n}, {at}, {_list(ws)}, {len(ws)}, '{ws[0]}')")
        words += [f"({n}, {j}, '{w}')" for j, w in enumerate(t.words)]
    names = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()})" for n, t in enumerate(licenses.TEMPLATES))
    vocabulary = _list(sorted({w for t in licenses.TEMPLATES for w in t.words}))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
f AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(list_filter(w, lambda x: list_contains({vocabulary}, x)))) AS word FROM d) GROUP BY 1),
tw AS (SELECT t.*, ln((1 + (SELECT count(*) FROM documents)) / (1 + coalesce(df, 0))::DOUBLE) + 1 AS idf FROM (VALUES {", ".join(words)}) AS t(n, j, word) LEFT JOIN f USING (word)),
p AS (SELECT * FROM (VALUES {", ".join(phrases)}) AS p(n, off, ws, size, head)),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT DISTINCT doc_id, n, i - 1 - off AS o FROM pos JOIN p ON w[i] = head AND w[i:i + size - 1] = ws),
s AS (SELECT doc_id, h.n, o, round(sum(CASE WHEN o + j >= 0 AND w[o + j + 1] = word THEN idf ELSE 0 END) / sum(idf), 9) AS score FROM h JOIN d USING (doc_id) JOIN tw ON h.n = tw.n GROUP BY 1, 2, 3),
a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(o) FILTER (base) AS first_word, max(o) FILTER (base) AS last_word, array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score FROM s JOIN (VALUES {names}) AS l(n, label, base) USING (n) WHERE score >= {licenses.SHARE} GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN a USING (doc_id)"""


_ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _secrets() -> str:
    # The same kinds without possessive quantifiers; lengths are tested afterwards.
    kinds = [(_ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 1)) >= 6"), ("AKIA[A-Z0-9]+", "length(m) >= 20"), ("[0-9a-f]+", "length(m) >= 24"), ("gh[pousr]_[A-Za-z0-9]{36,}", "true"), ("xox[abprs]-[A-Za-z0-9-]{10,}", "true"), ("eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", "true"), ("-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", "true")]
    parts = []
    for i, (pattern, test) in enumerate(kinds):
        parts.append(f"SELECT doc_id, repo, owner, {i} AS kind, s AS start, s + length(m) AS stop, {f'''regexp_extract(m, '{_ASSIGN}', 1)''' if i == 0 else 'm'} AS secret FROM (SELECT doc_id, repo, owner, k, m, sum(g) OVER (PARTITION BY doc_id ORDER BY k) + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (SELECT doc_id, repo, owner, unnest(range(1, len(ms) + 1)) AS k, unnest(ms) AS m, unnest(list_transform(gs[1:len(ms)], lambda x: length(x))) AS g FROM (SELECT doc_id, repo, owner, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM d))) WHERE {test}")
    listed = "string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    names = ", ".join(f"({i}, '{k}')" for i, k in enumerate(secrets.KINDS))
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(secrets.KINDS[: secrets.N_BASE]))
    zero = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secrets.KINDS[: secrets.N_BASE])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source || '/' || lang AS repo, source AS owner FROM documents),
c AS ({" UNION ALL ".join(parts)}),
o AS (SELECT secret, count(DISTINCT owner) <= {secrets.MOST_OWNERS} AND count(DISTINCT repo) <= {secrets.MOST_REPOS} AS live FROM c GROUP BY 1),
j AS (SELECT * FROM c JOIN o USING (secret) JOIN (VALUES {names}) AS k(kind, name) USING (kind)),
a AS (SELECT doc_id, {counts}, {listed.replace("string_agg(", "string_agg(")} FILTER (kind < {secrets.N_BASE}) AS base, {listed} FILTER (kind < {secrets.N_BASE} OR live) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM j GROUP BY 1)
SELECT d.doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


_EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = c.a"""

ORACLES: dict[str, str] = {"op1_licenses": _licenses(), "op5_embeddings": _EMBEDDINGS, "op7_secrets": _secrets(), "op8_quality": _quality()}
