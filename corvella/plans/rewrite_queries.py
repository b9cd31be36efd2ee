"""Cleaning of rewritten texts, over documents dressed as a model returns them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.functions import rewrites as R

from .registry import query

FRONTS = ("<rewritten_comment>", "Here is the rewritten comment:\n", "false\n\n1\n\n", '>"', "", "Sure, here is it:\n", "**Proposed Rule**\n2018-08-23T04:00Z\n")
BACKS = ("</rewritten_comment>", "\n<<COMMENT 2>>\nmore", "\nNote: I kept the tone.", "\nSincerely,\n[Your Name]\nAnytown, CA 12345", "\nfalse\n3", "", "\nI hope this helps you. Kind regards,", "\nThe original comment was longer")


def _pick(column: str, texts: tuple[str, ...]) -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    return f"CASE {column} % {len(texts)} " + " ".join(f"WHEN {i} THEN {quoted(t)}" for i, t in enumerate(texts)) + " END"


def _dressed(documents: DataFrame) -> DataFrame:
    raw = F.concat(F.expr(_pick("doc_id", FRONTS)), F.coalesce("text", F.lit("")), F.expr(_pick("doc_id", BACKS)))
    return documents.select("doc_id", raw.alias("raw"), (F.length("text") * (F.col("doc_id") % 10) / 9).cast("int").alias("n"))


_RAW = f"SELECT doc_id, {_pick('doc_id', FRONTS)} || coalesce(text, '') || {_pick('doc_id', BACKS)} AS raw, floor(length(text) * (doc_id % 10) / 9)::INT AS n FROM documents"


def _replaced(text: str, patterns: list[str]) -> str:
    for pattern in patterns:
        text = f"regexp_replace({text}, '" + pattern.replace("'", "''") + "', '', 'g')"
    return text


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_CLEANED = rf"""
WITH d AS ({_RAW}), s AS (SELECT doc_id, n, {_replaced("coalesce(raw, '')", R.rewrite_steps())} AS t FROM d),
h AS (SELECT *, floor(n * 3.0)::INT AS most, left(t, floor(n * 3.0)::INT) AS head FROM s),
a AS (SELECT *, length(head) - strpos(reverse(head), chr(10) || chr(10)) - 1 AS para, length(head) - strpos(reverse(head), ' .') - 1 AS sent FROM h),
c AS (SELECT doc_id, CASE WHEN coalesce(n, 0) <= 0 OR length(t) <= most THEN t ELSE {_STRIP.format("CASE WHEN contains(head, chr(10) || chr(10)) AND para > most * 0.5 THEN left(head, para) WHEN contains(head, '. ') AND sent > most * 0.3 THEN left(head, sent + 1) ELSE head END")} END AS t FROM a)"""


@query("documents", oracle=_CLEANED + "SELECT doc_id, CASE WHEN length(t) >= 20 THEN length(t) ELSE 0 END AS n, md5(CASE WHEN length(t) >= 20 THEN t ELSE '' END) AS h FROM c")
def ai_rewrite_clean(documents):
    """Wrappers, prefixes, talk and placeholders go; the rest is cut to three times the original."""
    cleaned = _dressed(documents).select("doc_id", R.clean_rewrite(F.col("raw"), F.col("n")).alias("t"))
    return cleaned.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("h"))


@query("documents", oracle=_CLEANED.replace("floor(length(text) * (doc_id % 10) / 9)::INT AS n", "length(substr(text, 1 + length(text) // 2)) AS n") + "SELECT doc_id, md5(t) AS h FROM c WHERE length(t) >= 20")
def ai_corpus_clean(documents):
    """The rows of a corpus that are worth keeping."""
    frame = _dressed(documents).join(documents.select("doc_id", F.expr("substr(text, 1 + length(text) div 2)").alias("original")), "doc_id")
    return R.clean_corpus(frame, "raw", "original").select("doc_id", F.md5("raw").alias("h"))


def _notice_sql() -> str:
    text = _replaced("raw", [R.STRIP, *R.VARIANT, *R.PREAMBLES])
    tail = _replaced("tail", list(R.POSTAMBLES))
    return rf"""WITH d AS ({_RAW}), s AS (SELECT doc_id, {text} AS t FROM d),
p AS (SELECT doc_id, CASE WHEN length(t) > 500 THEN left(t, length(t) - 500) ELSE '' END AS body, CASE WHEN length(t) > 500 THEN right(t, 500) ELSE t END AS tail FROM s),
q AS (SELECT doc_id, {_STRIP.format("regexp_replace(regexp_replace(body || " + tail + ", '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')").replace("{{3,}}", "{3,}")} AS t FROM p)
SELECT doc_id, md5(t) AS h FROM q WHERE length(t) >= 50"""


@query("documents", oracle=_notice_sql())
def ai_notice_clean(documents):
    """The shorter variant, for rules and notices; texts of fewer than 50 characters go."""
    cleaned = _dressed(documents).select("doc_id", R.clean_notice(F.col("raw")).alias("t"))
    return cleaned.where(F.length("t") >= R.SHORTEST_VARIANT).select("doc_id", F.md5("t").alias("h"))


@query("documents", oracle="SELECT doc_id, md5(left(coalesce(text, ''), 4000 - 10 * (doc_id % 50)::INT)) AS h FROM documents")
def truncate_to_budget(documents):
    """Texts cut to a budget of characters that depends on the row."""
    budget = (4000 - 10 * (F.col("doc_id") % 50)).cast("int")
    return documents.select("doc_id", F.md5(F.substring(F.coalesce("text", F.lit("")), F.lit(1), budget)).alias("h"))


@query("documents", oracle=r"""
WITH p AS (SELECT doc_id, string_split(regexp_replace('1. ' || replace(coalesce(text, ''), chr(10), chr(10) || chr(10) || (CASE WHEN doc_id % 3 = 0 THEN '2' ELSE 'x' END) || '. '), '^\s+|\s+$', '', 'g'), chr(10) || chr(10)) AS ps FROM documents)
SELECT doc_id, len(list_filter(range(1, len(ps) + 1), lambda i: NOT starts_with(regexp_replace(ps[i], '^\s+', ''), i || '.'))) = 0 AS numbered,
len(ps) = 2 AND len(list_filter(range(1, len(ps) + 1), lambda i: NOT starts_with(regexp_replace(ps[i], '^\s+', ''), i || '.'))) = 0 AS two FROM p""")
def numbered_list_check(documents):
    """Whether blocks are numbered from one, and whether there are two."""
    filler = F.concat(F.lit("\n\n"), F.when(F.col("doc_id") % 3 == 0, "2").otherwise("x"), F.lit(". "))
    text = F.regexp_replace(F.concat(F.lit("1. "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), filler)), R.STRIP, "")
    right = F.transform("ps", lambda p, i: F.startswith(F.regexp_replace(p, r"^\s+", ""), F.concat((i + 1).cast("string"), F.lit("."))))
    parts = documents.select("doc_id", F.split(text, "\n\n").alias("ps"))
    return parts.select("doc_id", F.forall(right, lambda x: x).alias("numbered"), (F.forall(right, lambda x: x) & (F.size("ps") == 2)).alias("two"))


@query("documents", oracle=r"""
WITH w AS (SELECT doc_id, unnest(range(0, length(text), 5000)) AS start, text, CASE WHEN doc_id % 2 = 0 THEN '[.!?]' ELSE chr(10) END AS p FROM documents WHERE text <> ''),
s AS (SELECT doc_id, start, string_split_regex(substr(text, start + 1, 10000), p) AS parts FROM w)
SELECT doc_id, start::BIGINT AS start, len(parts) AS n, md5(array_to_string(parts, '|')) AS h FROM s""")
def regex_windows(documents):
    """Overlapping windows of a text, each split by the row's own pattern."""
    pattern = F.when(F.col("doc_id") % 2 == 0, "[.!?]").otherwise("\n")
    starts = documents.where("text <> ''").select("doc_id", "text", pattern.alias("p"), F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(5000))).alias("start"))
    parts = F.split(F.substring(F.col("text"), F.col("start") + 1, F.lit(10000)), F.col("p"))
    return starts.select("doc_id", F.col("start").cast("long").alias("start"), F.size(parts).cast("long").alias("n"), F.md5(F.array_join(parts, "|")).alias("h"))


@query("documents", oracle=r"""
WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a, string_split(replace(coalesce(text, ''), 'e', 'E'), chr(10)) AS b FROM documents),
i AS (SELECT doc_id, a, b, unnest(range(1, len(a) + 1)) AS k FROM p)
SELECT doc_id, count(*) FILTER (a[k] = b[k]) AS same, count(*) FILTER (a[k] <> b[k]) AS changed FROM i GROUP BY doc_id""")
def text_diff(documents):
    """Lines of two versions side by side: equal and replaced."""
    a, b = F.split(F.coalesce("text", F.lit("")), "\n"), F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("e"), F.lit("E")), "\n")
    alike = F.zip_with(a, b, lambda x, y: x == y)
    return documents.select("doc_id", F.size(F.filter(alike, lambda x: x)).cast("long").alias("same"), F.size(F.filter(alike, lambda x: ~x)).cast("long").alias("changed"))
