"""Secret scan with corpus-wide ownership: patterns find candidates, and who else holds a candidate tells what it is.

Every candidate's hash is counted over distinct repositories and owners. What many owners hold has been copied from documentation: an
example. What one owner holds, in few repositories, may be live. Patterns of the base list always count as found; candidates of further
patterns are reported only if they look live.

Null texts have no candidates. Null repositories and owners count as one of their own. Rows are told apart by nothing but their text and
id, so repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framepack.llm import spans
from framepack.llm.common import bind, fresh, materialise, text_or_empty

#: Base kinds first. (kind, pattern, test of the match); fixed values.
ASSIGN = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*+[:=]\\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
KINDS = ["assign", "access", "hex", "github", "slack", "jwt", "private_key"]
N_BASE = 3
#: A candidate held by more owners or repositories than this is an example.
MOST_OWNERS, MOST_REPOS = 1, 3


def _patterns() -> list[tuple[str, object]]:
    return [
        (ASSIGN, lambda v: F.length(F.regexp_extract(v, ASSIGN, 1)) >= 6),
        ("AKIA[A-Z0-9]{16,}+", None),
        ("[0-9a-f]{24,}+", None),
        ("gh[pousr]_[A-Za-z0-9]{36,}+", None),
        ("xox[abprs]-[A-Za-z0-9-]{10,}+", None),
        ("eyJ[A-Za-z0-9_-]{8,}+\\.eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+", None),
        ("-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", None),
    ]


def candidates(text: Column | str) -> Column:
    """All candidates of a text as spans; the kind is the index in KINDS."""
    return bind(text_or_empty(text), lambda t: F.concat(*[spans.matches(t, p, i, test) for i, (p, test) in enumerate(_patterns())]))


def secret_value(value: Column, kind: Column) -> Column:
    """What is secret in a match: an assignment's right side, else all of it."""
    return F.when(kind == 0, F.regexp_extract(value, ASSIGN, 1)).otherwise(value)


def ownership(found: DataFrame, spans_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """(secret, n_rows, n_repos, n_owners) of every candidate; pre-aggregated by repository and owner before distinct ones are counted."""
    each = found.select(F.explode(spans_col).alias("s"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"))
    each = each.select(F.sha2(secret_value(F.col("s.value"), F.col("s.kind")), 256).alias("secret"), "repo", "owner")
    pairs = each.groupBy("secret", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    distinct = lambda c: F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")))
    return pairs.groupBy("secret").agg(F.sum("n").alias("n_rows"), distinct("repo").alias("n_repos"), distinct("owner").alias("n_owners"))


def _row(df: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """(id, found, key) and what owns the row; the key names the list of candidates, null if there are none."""
    row = df.select(F.col(id_col).alias("id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), candidates(text_col).alias("found"))
    return materialise(row.withColumn("key", _key("found")), "candidates")


def _key(found: str) -> Column:
    return F.when(F.size(found) > 0, F.sha2(F.to_json(found), 256))


def _judged(row: DataFrame) -> DataFrame:
    """(key, live, n_example): of each distinct list of candidates those that look live, and the number of the others. Rows with equal lists
    share the verdict, so a list is judged once, however many copies there are."""
    held = ownership(row.where("key is not null"), "found", "repo", "owner").select("secret", ((F.col("n_owners") <= MOST_OWNERS) & (F.col("n_repos") <= MOST_REPOS)).alias("is_live"))
    lists = row.where("key is not null").groupBy("key").agg(F.first("found").alias("found"))
    each = lists.select("key", F.explode("found").alias("s")).withColumn("secret", F.sha2(secret_value(F.col("s.value"), F.col("s.kind")), 256))
    judged = each.join(held, "secret").groupBy("key").agg(F.collect_list(F.when(F.col("is_live"), F.col("s"))).alias("live"), F.count(F.when(~F.col("is_live"), 1)).alias("n_example"))
    return materialise(judged, "judged")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "repo", owner_col: str = "owner") -> DataFrame:
    """(id, spans, base_spans, live_spans, n_live, n_example) of every row: base_spans are the base kinds' matches, spans adds live-looking
    candidates of the others, live_spans are all that look live. Other columns are ignored."""
    row = _row(df, id_col, text_col, repo_col, owner_col)
    some = row.where("key is not null").join(_judged(row), "key").select("id", "found", "live", "n_example")
    none = row.where("key is null").select("id", "found", spans.none().alias("live"), F.lit(0).cast("long").alias("n_example"))
    base = F.filter("found", lambda s: s["kind"] < N_BASE)
    return some.union(none).select(
        F.col("id").alias(id_col),
        F.array_sort(F.concat(base, F.filter("live", lambda s: s["kind"] >= N_BASE))).alias("spans"),
        base.alias("base_spans"),
        F.array_sort("live").alias("live_spans"),
        F.size("live").cast("long").alias("n_live"),
        "n_example",
    )


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "repo", owner_col: str = "owner", mask: str = "<SECRET>") -> DataFrame:
    """df with every live-looking candidate in the text replaced by the mask; examples, all rows and other columns stay.

    Texts are scanned once: their candidates are written, with what owns them and a hash of the text, and come back to the texts that have some."""
    found = df.select(F.xxhash64(text_col).alias("text"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), candidates(text_col).alias("found")).where(F.size("found") > 0)
    found = materialise(found.withColumn("key", _key("found")), "candidates")
    judged = _judged(found).where(F.size("live") > 0).select("key", "live")
    key, live = fresh(df, "key"), fresh(df, "live")
    texts = found.groupBy("text").agg(F.min("key").alias("key")).join(judged, "key").select(F.col("text").alias(key), F.col("live").alias(live))
    texts = materialise(texts, "live")
    out = df.where(F.col(text_col).isNotNull()).join(texts, F.xxhash64(text_col) == F.col(key), "left")
    text = F.when(F.col(live).isNull(), F.col(text_col)).otherwise(spans.masked(F.col(text_col), F.col(live), [mask] * len(KINDS)))
    return out.withColumn(text_col, text).select(*df.columns).union(df.where(F.col(text_col).isNull()))
