"""The comment cascade over documents dressed as multi-part comments, and its signals one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.operators import campaign as C

from .registry import query

LETTERS = (
    "On behalf of our members, I am submitting 27,590 comments demonstrating opposition; split across 9 attachments.",
    "Attached please find 1,200 individual public comments. Individual comments may differ, the majority read as follows:",
    "On behalf of the town we write.",
    "",
    "References cited in the comment. Submission ID: abc_123456",
    "Rev. Ann Lee, Salem",
)
TITLES = ("Mass Comment Campaign sponsored by us", "Comment", "Form Letter", None, "write-in campaign")
NOTES = ("See attached", "Submission 2 of 5, part 1 of 3", "Please find attached our views", "")
GARBLED = "» = 4 LF ~ x | , a a : ab a ae ar. - he i + po 4 ~~ || <> {} ^"


def _s(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _choose(column: str, texts: tuple[str | None, ...], step: str) -> str:
    return f"CASE {column} % {len(texts)} " + " ".join(f"WHEN {i} THEN {_s(t)}" for i, t in enumerate(texts)) + f" ELSE {step} END"


def _dressed(documents: DataFrame) -> DataFrame:
    """Comments of three parts: a note and the first line, a letter and the lines as pages, and at times noise."""
    one = lambda texts: F.expr(_choose("doc_id", texts, "''").replace("\\", "\\\\"))
    text = F.coalesce("text", F.lit(""))
    raw = F.concat(
        F.lit("<<PART 1>>\nfalse\n"), (F.col("doc_id") % 40).cast("string"), F.lit("\n"), one(NOTES), F.lit("\n"), F.substring_index(text, "\n", 1),
        F.lit("\n<<PART 2>>\n<<PAGE 1>>\n"), one(LETTERS), F.lit("\n"), F.regexp_replace(text, "\n", "\n<<PAGE 2>>\n"),
        F.lit("\n<<PART 3>>\n<<PAGE 1>>\n"), F.when(F.col("doc_id") % 7 == 0, GARBLED).otherwise(""),
    )
    return documents.select("doc_id", raw.alias("raw"), F.expr(_choose("doc_id", TITLES, "NULL")).alias("title"))


def _any_label(text: str, patterns: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, {_s(p)}) THEN {_s(label)} END" for label, p in patterns.items()) + "], lambda x: x IS NOT NULL)"



def _alpha(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{C.ALPHA_WORD}'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{C.BLANK}+|{C.BLANK}+$', '', 'g')"


def _tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def _garbage(x: str) -> str:
    noise = f"(length({x}) - length(regexp_replace({x}, {_s(C.NOISE)}, '', 'g'))) / length({x})"
    w = _tokens(x)
    return (
        rf"(length({x}) >= 20 AND (length(regexp_replace({x}, '[^\p{{L}}]', '', 'g')) = 0 OR {noise} > 0.15 OR ({noise} > 0.1 AND len(list_filter({w}, lambda y: length(y) <= 2)) / greatest(len({w}), 1) > 0.4) "
        f"OR (list_sum(list_transform({w}, lambda y: length(y))) / greatest(len({w}), 1) < 2.5 AND len({w}) > 5)))"
    )


def _screen(x: str) -> str:
    return "(" + " + ".join(f"regexp_matches(lower({x}), {_s(p)})::INT" for p in C.SCREENSHOT) + ") >= 2"


_PARSED = rf"""
WITH raws AS (SELECT doc_id, '<<PART 1>>' || chr(10) || 'false' || chr(10) || (doc_id % 40) || chr(10) || {_choose("doc_id", NOTES, "''")} || chr(10) || string_split(coalesce(text, ''), chr(10))[1]
  || chr(10) || '<<PART 2>>' || chr(10) || '<<PAGE 1>>' || chr(10) || {_choose("doc_id", LETTERS, "''")} || chr(10) || replace(coalesce(text, ''), chr(10), chr(10) || '<<PAGE 2>>' || chr(10))
  || chr(10) || '<<PART 3>>' || chr(10) || '<<PAGE 1>>' || chr(10) || CASE WHEN doc_id % 7 = 0 THEN {_s(GARBLED)} ELSE '' END AS raw, {_choose("doc_id", TITLES, "NULL")} AS title FROM documents),
cut AS (SELECT *, regexp_extract_all(raw, '<<PART\s+(\d+)>>', 1) AS ns, string_split_regex(raw, '<<PART\s+\d+>>') AS ts FROM raws),
numbered AS (SELECT doc_id, title, list_sort(list_transform(range(1, len(ns) + 1), lambda i: {{'n': ns[i]::BIGINT, 't': ts[i + 1]}})) AS ps FROM cut),
parsed AS (SELECT doc_id, title, len(ps) AS n_parts, {_strip("list_filter(ps, lambda x: x.n = 1)[1].t")} AS part1,
  list_transform(list_filter(ps, lambda x: x.n <> 1), lambda x: {_strip("x.t")}) AS parts,
  flatten(list_transform(list_filter(ps, lambda x: x.n <> 1), lambda x: list_filter(list_transform(string_split_regex(x.t, '<<PAGE\s+\d+>>'), lambda p: {_strip("p")}), lambda p: p <> ''))) AS pages FROM numbered),
lined AS (SELECT *, list_filter(list_transform(string_split(part1, chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') AS ls,
  {_strip(f"array_to_string(list_filter(string_split(part1, chr(10)), lambda x: NOT regexp_matches(x, {_s(C.SKIPPED_LINES)})), chr(10))")} AS body FROM parsed),
scanned AS (SELECT *, CASE WHEN regexp_matches(ls[2], '^[+-]?\d+$') THEN TRY_CAST(ls[2] AS BIGINT) END AS meta, coalesce(parts[1], '') AS cover,
  lower(CASE WHEN coalesce(parts[1], '') <> '' THEN body || chr(10) || left(parts[1], 2000) ELSE body END) AS seen FROM lined)"""
_PAGES = rf"""
normal AS (SELECT doc_id, list_filter(list_transform(pages, lambda p: lower(array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda x: {_strip("x")}),
  lambda x: length(x) >= 40 AND NOT (regexp_matches(x, {_s(C.ADDRESS_LINE)}) AND length(x) < 60) AND NOT regexp_matches(x, {_s(C.CITY_LINE)})), ' '))), lambda p: {_alpha("p")} >= 25) AS ps FROM scanned),
sets AS (SELECT doc_id, list_transform(ps, lambda p: list_distinct({_tokens("p")})) AS s FROM normal),
repeated AS (SELECT doc_id, CASE WHEN len(s) >= 3 THEN len(list_filter(s[2:], lambda p: len(list_intersect(s[1], p)) / len(list_distinct(list_concat(s[1], p))) > 0.7)) / (len(s) - 1) END AS repetition FROM sets)"""
_SIGNED = rf"""
page_lines AS (SELECT doc_id, p, list_filter(list_transform(string_split(p, chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') AS ls FROM (SELECT doc_id, unnest(pages) AS p FROM scanned)),
page_counts AS (SELECT *, len(list_filter(ls, lambda x: length(x) BETWEEN 6 AND 90 AND regexp_matches(x, {_s(C.SIGNATORY)}))) AS k FROM page_lines),
page_kinds AS (SELECT doc_id, p, len(ls) > 0 AND (regexp_matches(lower(array_to_string(ls, ' ')), {_s(C.SIGNATORY_HEADER)}) OR k >= 8 OR (len(ls) >= 12 AND k / len(ls) >= 0.45)) AS sig FROM page_counts),
signed AS (SELECT doc_id, count(*) FILTER (sig) AS signatory, count(*) FILTER (NOT sig AND {_alpha("p")} >= 80) AS prose,
  count(*) FILTER (contains(lower(p), 'docusign envelope id') AND {_alpha("p")} <= 20) AS docusign FROM page_kinds GROUP BY doc_id)"""
_PARENT = "coalesce(" + ", ".join(f"nullif(regexp_extract(seen, {_s(p)}, 1), '')" for p in C.PARENTS) + ")"
_COUNT = "coalesce(" + ", ".join(f"TRY_CAST(replace(regexp_extract(lower(left(cover, 3000)), {_s(p)}, 1), ',', '') AS BIGINT)" for p in C.COUNTS) + ")"
_SIGNALS = rf"""
signals AS (SELECT *, len(pages) AS n_pages, {_any_label("seen", C.REFERENCES)} || CASE WHEN {_PARENT} IS NOT NULL THEN ['references parent submission ID'] ELSE [] END || {_any_label("lower(body)", C.PART_LABELS)} AS indicators,
  {_PARENT} AS parent_id, len({_tokens("body")}) AS words, {_alpha("body")} + coalesce(list_sum(list_transform(pages, lambda p: {_alpha("p")})), 0) AS alpha,
  len(list_filter(parts, lambda p: {_alpha("p")} > 10)) > 0 AS meaningful, {_any_label("lower(left(cover, 3000))", C.PHRASES)} AS found, {_COUNT} AS named,
  len(list_filter(parts, lambda p: {_garbage("p")})) > 0 AS garbage, len(list_filter(parts, lambda p: {_screen("p")})) > 0 AS screenshot, lower({_strip("coalesce(title, '')")}) AS low_title FROM scanned),
facts AS (SELECT s.*, r.repetition, coalesce(g.signatory, 0) AS signatory, coalesce(g.prose, 0) AS prose, coalesce(g.docusign, 0) AS docusign, len(indicators) > 0 AS refers, len(parts) > 0 AND len(indicators) = 0 AS reads,
  coalesce(meta > 10, false) AS big, len(found) >= 2 OR len(list_filter(found, lambda x: x <> 'on behalf of')) > 0 AS strong,
  n_pages >= 3 AND coalesce(r.repetition > 0.6, false) AS alike, n_pages >= 3 AND coalesce(r.repetition < 0.1, false) AS apart, alpha < 120 AND n_pages <= 2 AS low, regexp_matches(low_title, {_s(C.MASS_TITLES)}) AS mass
  FROM signals s JOIN repeated r USING (doc_id) LEFT JOIN signed g USING (doc_id)),
covers AS (SELECT *, 3 * (reads AND strong)::INT + 3 * (reads AND named IS NOT NULL)::INT AS cs FROM facts),
pagesig AS (SELECT *, alike AND words >= 80 AND cs = 0 AS appendix, cs + 2 * (alike AND NOT (words >= 80 AND cs = 0))::INT AS camp FROM covers),
sums AS (SELECT *, 2 * (words > 20)::INT + 2 * (words > 20 AND NOT meaningful)::INT + (n_pages <= 2)::INT + appendix::INT + apart::INT + 2 * (n_pages >= 2 AND docusign / n_pages >= 0.75)::INT
  + 2 * (signatory >= 1 AND prose >= 1 AND camp = 0)::INT + garbage::INT + 2 * (regexp_matches(part1, {_s(C.SEE_ATTACHED)}) AND len(parts) > 0 AND camp = 0 AND NOT refers AND meaningful AND NOT (alike AND words < 80))::INT AS single,
  big::INT + (reads AND NOT strong AND len(found) > 0)::INT + (reads AND named IS NOT NULL AND big)::INT + (mass AND NOT low)::INT + regexp_matches(low_title, {_s(C.WEAK_TITLES)})::INT AS hints, camp + 3 * (mass AND low)::INT AS with_title FROM pagesig),
done AS (SELECT *, with_title + (with_title > 0 AND hints > 0)::INT AS campaign FROM sums)"""
_WITH = ",".join((_PARSED, _PAGES, _SIGNED, _SIGNALS))


@query("documents", oracle=_WITH + """
SELECT doc_id, CASE WHEN refers THEN 'references_other_submission' WHEN campaign >= 3 THEN 'definitely_campaign' WHEN campaign >= 2 AND hints >= 2 AND single = 0 THEN 'definitely_campaign'
  WHEN single >= 2 AND campaign <= 1 THEN 'definitely_single' ELSE 'uncertain' END AS classification, coalesce(CASE WHEN reads THEN named END, CASE WHEN big THEN meta END) AS campaign_count,
  single, campaign, hints, n_parts, n_pages FROM done""")
def campaign_classifier(documents):
    """Class, count and sums of signals of every comment."""
    found = C.classify(_dressed(documents), text_col="raw", title_col="title")
    return found.select("doc_id", "classification", "campaign_count", "single", "campaign", "hints", F.col("n_parts").cast("long").alias("n_parts"), F.col("n_pages").cast("long").alias("n_pages"))


@query("documents", oracle=_WITH + """
SELECT doc_id, array_to_string(CASE WHEN reads THEN found ELSE [] END, ';') AS phrases FROM done""")
def campaign_phrases(documents):
    return C.classify(_dressed(documents), text_col="raw", title_col="title").select("doc_id", F.array_join("phrases", ";").alias("phrases"))


@query("documents", oracle=_WITH + """
SELECT doc_id, array_to_string(indicators, ';') AS indicators, parent_id FROM done""")
def references_other_submission(documents):
    return C.classify(_dressed(documents), text_col="raw", title_col="title").select("doc_id", F.array_join("indicators", ";").alias("indicators"), "parent_id")


@query("documents", oracle=_WITH + """
SELECT doc_id, CASE WHEN n_pages >= 3 THEN repetition END AS repetition FROM done""")
def page_repetition(documents):
    """Share of pages that say what the first says."""
    return C.classify(_dressed(documents), text_col="raw", title_col="title").select("doc_id", "repetition")


@query("documents", oracle=_WITH + rf"""
SELECT doc_id, {_COUNT} AS named, garbage, screenshot, signatory, prose, docusign FROM done""")
def comment_page_signals(documents):
    """Counts that letters name; garbage, screenshots, signature pages and packets."""
    parsed = _dressed(documents).withColumn("ps", C.numbered_parts(F.col("raw")))
    others = F.filter("ps", lambda x: x["n"] != 1)
    rows = parsed.select("doc_id", F.transform(others, lambda x: C.strip(x["t"])).alias("parts"), F.flatten(F.transform(others, lambda x: C.pages_of(x["t"]))).alias("pages"))
    cover = F.substring(F.coalesce(F.get("parts", F.lit(0)), F.lit("")), 1, 3000)
    many = lambda test: F.size(F.filter("pages", test)).cast("long")
    return rows.select(
        "doc_id",
        C.explicit_count(cover).alias("named"),
        F.exists("parts", C.is_ocr_garbage).alias("garbage"),
        F.exists("parts", C.is_screenshot).alias("screenshot"),
        many(C.is_signatory_page).alias("signatory"),
        many(lambda p: ~C.is_signatory_page(p) & (C.alpha_words(p) >= 80)).alias("prose"),
        many(lambda p: F.lower(p).contains("docusign envelope id") & (C.alpha_words(p) <= 20)).alias("docusign"),
    )
