"""Text queries: scalars, pages, claims, near-duplicate clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.functions import text as T
from corvella.operators import dedup as D

from .registry import query

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_TRIMMED = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: length(s) > 0)"
_KEPT = rf"list_filter(list_transform({_TRIMMED}, lambda s: list_filter(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+'), lambda w: NOT regexp_full_match(w, '[0-9]+'))), lambda ws: len(ws) >= 11)"


@query("documents", oracle=f"SELECT doc_id, len({_WORDS}) AS n_words, len(list_distinct({_WORDS})) AS n_distinct FROM documents")
def word_tokenize(documents):
    w = T.words(F.col("text"))
    return documents.select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query("documents", oracle=r"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')) AS n FROM documents")
def embedding_tokenize(documents):
    return documents.select("doc_id", F.size(T.embedding_words(F.col("text"))).cast("long").alias("n"))


@query("documents", oracle=f"SELECT doc_id, len({_KEPT}) AS n_sentences, coalesce(list_sum(list_transform({_KEPT}, lambda ws: len(ws)))::BIGINT, 0) AS n_words FROM documents")
def sentence_tokenize(documents):
    """Sentences of more than ten words and what they hold."""
    kept = T.sentence_words(F.col("text"))
    return documents.select("doc_id", F.size(kept).cast("long").alias("n_sentences"), F.aggregate(kept, F.lit(0).cast("long"), lambda s, w: s + F.size(w)).alias("n_words"))


@query("documents", oracle=r"""
SELECT doc_id, len(list_filter(list_transform(""" + _TRIMMED.replace("coalesce(text, '')", "coalesce(text, '')") + r""", lambda s: regexp_extract_all(lower(s), '[a-z]+')), lambda ws: len(ws) >= 3)) AS n FROM documents""")
def sentence_tokenize_older(documents):
    """The older variant: ASCII words, sentences of three and more."""
    return documents.select("doc_id", F.size(T.sentence_words(F.col("text"), pattern="[a-z]+", at_least=3)).cast("long").alias("n"))


@query("documents", oracle=f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN len(list_distinct(list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:], ' '))))
ELSE len(list_distinct(CASE WHEN len(w) < 5 THEN list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:], ' ')) ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) END AS n FROM t""")
def shingle_sets(documents):
    """The size of each text's set of five-word shingles."""
    return documents.select("doc_id", F.size(T.shingles(T.words(F.col("text")), 5)).cast("long").alias("n"))


@query("documents", oracle=r"""
SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+|www\.\S+', ' ', 'gi'),
 '\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b', ' ', 'gi'), '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS h FROM documents""")
def comment_noise_removal(documents):
    """URLs and addresses deleted, spaces collapsed."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?i)https?://\S+|www\.\S+", " "), r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", " ")
    return documents.select("doc_id", F.md5(F.lower(F.trim(F.regexp_replace(out, r"\s+", " ")))).alias("h"))


def _preprocessed() -> str:
    text = "regexp_replace(coalesce(text, ''), '-\\n', '', 'g')"
    for pattern in T.COMMENT_NOISE:
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return f"lower(trim(regexp_replace({text}, '\\s+', ' ', 'g')))"


@query("documents", oracle=f"SELECT doc_id, md5({_preprocessed()}) AS h FROM documents")
def comment_preprocess(documents):
    """All deletions in their order."""
    return documents.select("doc_id", F.md5(T.preprocess_comment(F.col("text"))).alias("h"))


@query("benchmark", oracle=r"""
WITH p AS (SELECT item_id, '<<PAGE 1>>' || left(text, 40) || '<<PAGE 2>>' || '   ' || '<<PAGE 7>>' || substr(text, 41) AS t FROM benchmark),
s AS (SELECT item_id, unnest(regexp_extract_all(t, '<<PAGE ([0-9]+)>>', 1)) AS page, unnest(string_split_regex(t, '<<PAGE [0-9]+>>')[2:]) AS body FROM p)
SELECT item_id, CAST(page AS INTEGER) AS page, md5(trim(body)) AS h, CASE WHEN length(trim(body)) < 25 THEN 'blank' ELSE 'ok' END AS kind FROM s""")
def page_split_classify(benchmark):
    """Texts split at page markers, each page judged."""
    marked = F.concat(F.lit("<<PAGE 1>>"), F.substring("text", 1, 40), F.lit("<<PAGE 2>>   <<PAGE 7>>"), F.expr("substring(text, 41)"))
    split = benchmark.select("item_id", F.explode(T.pages(marked)).alias("p")).select("item_id", "p.page", "p.text")
    return split.select("item_id", "page", F.md5("text").alias("h"), T.page_class(F.col("text")).alias("kind"))


@query("documents", oracle=r"""
WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents)
SELECT doc_id, count(*) AS n_pages, count(*) FILTER (length(trim(t)) < 25) AS blank, median(length(t)) AS median_chars FROM p GROUP BY 1""")
def page_quality(documents):
    """Pages, blank ones and their median length, a line standing for a page."""
    split = documents.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("t"))
    blank = T.page_class(F.col("t")) == "blank"
    return split.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.when(blank, 1).otherwise(0)).cast("long").alias("blank"), F.median(F.length("t")).alias("median_chars"))


@query("events", oracle="""
SELECT event_id, year(ts) || 'Q' || quarter(ts) AS q, year(ts) || 'H' || CASE WHEN month(ts) <= 6 THEN 1 ELSE 2 END AS h, ts < TIMESTAMP '2024-01-15' AS pre FROM events""")
def quarter_half_labels(events):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events.select("event_id", T.quarter_label(F.col("ts")).alias("q"), T.half_label(F.col("ts")).alias("h"), T.before(text, "2024-01-15").alias("pre"))


@query("part", oracle=r"""
SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' #' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
lower(regexp_replace(p_brand || '.PDF.txt', '(\.(txt|html?|pdf))+$', '', 'i')) AS prefix FROM part""")
def slug_and_prefix(part):
    return part.select("p_partkey", T.slug(F.concat("p_name", F.lit(" #"), "p_brand")).alias("slug"), T.prefix_key(F.concat("p_brand", F.lit(".PDF.txt"))).alias("prefix"))


@query("orders", oracle=r"""
WITH t AS (SELECT o_orderkey, 'EPA-' || o_custkey || '-' || year(o_orderdate) || '-' || o_orderkey AS id FROM orders)
SELECT o_orderkey, id, regexp_replace(id, '-[^-]*$', '') AS docket, split_part(id, '-', 1) AS agency FROM t""")
def docket_from_id(orders):
    """Docket and agency of a document id."""
    uid = F.concat_ws("-", F.lit("EPA"), F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string"), F.col("o_orderkey").cast("string"))
    return orders.select("o_orderkey", uid.alias("id")).select("o_orderkey", "id", F.regexp_replace("id", "-[^-]*$", "").alias("docket"), F.split_part("id", F.lit("-"), F.lit(1)).alias("agency"))


@query("documents", oracle="SELECT doc_id, sha256(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || CAST(doc_id AS VARCHAR)) AS uid, source, lang, n_chars FROM documents")
def normalize_document(documents):
    """Records under a hash of their identifying fields."""
    return documents.select("doc_id", T.text_key(F.col("source"), F.col("lang"), F.col("doc_id")).alias("uid"), "source", "lang", "n_chars")


@query("documents", oracle="SELECT sha256(text) AS blob, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def blob_store(documents):
    """Each distinct text once, under its hash."""
    return documents.where("text is not null").groupBy(F.sha2("text", 256).alias("blob")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("conversations", oracle="""
SELECT conv_id, string_agg('<<COMMENT ' || k || '>>' || chr(10) || t, chr(10) || chr(10) ORDER BY k) AS canonical
FROM (SELECT conv_id, trim(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations WHERE trim(coalesce(text, '')) <> '') GROUP BY 1""")
def canonical_text_build(conversations):
    """A conversation's parts in order, each under its marker."""
    kept = conversations.where("trim(coalesce(text, '')) <> ''")
    parts = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("p"))
    return parts.select("conv_id", T.canonical_text(F.transform("p", lambda x: x["text"])).alias("canonical"))


@query("conversations", oracle="""
SELECT conv_id || '#L' || lpad(CAST(k AS VARCHAR), 3, '0') AS letter_id, sha256('conv|' || conv_id || '|' || k) AS uid, length(text) AS n
FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations WHERE text IS NOT NULL AND text <> '')""")
def bundle_fan_out(conversations):
    """A bundle's letters as documents of their own."""
    from pyspark.sql import Window

    kept = conversations.where("text is not null and text <> ''").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    return kept.select(F.format_string("%s#L%03d", F.col("conv_id").cast("string"), F.col("k")).alias("letter_id"), T.text_key(F.lit("conv"), F.col("conv_id"), F.col("k")).alias("uid"), F.length("text").cast("long").alias("n"))


@query("documents", oracle="""
WITH f AS (SELECT doc_id, text, strpos(lower(text), 'the') AS p FROM documents)
SELECT doc_id, CASE WHEN greatest(p - 100, 1) > 1 THEN '...' ELSE '' END || substr(text, greatest(p - 100, 1), least(p + 102, length(text)) - greatest(p - 100, 1) + 1)
|| CASE WHEN least(p + 102, length(text)) < length(text) THEN '...' ELSE '' END AS snippet FROM f WHERE p > 0""")
def snippet_search(documents):
    """What stands around the first place of a word."""
    return documents.select("doc_id", T.snippet(F.col("text"), "the").alias("snippet")).where("snippet is not null")


@query("conversations", oracle=r"""
SELECT opening, count(*) AS n FROM (SELECT array_to_string(string_split_regex(lower(trim(text)), '\s+')[1:3], ' ') AS opening FROM conversations WHERE role = 'user')
GROUP BY 1 ORDER BY n DESC, opening LIMIT 25""")
def prompt_openings(conversations):
    """The most frequent first three words of prompts."""
    opening = F.array_join(F.slice(F.split(F.lower(F.trim("text")), r"\s+"), 1, 3), " ")
    return conversations.where("role = 'user'").groupBy(opening.alias("opening")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "opening").limit(25)


@query("documents", oracle=r"""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), '!!') THEN 'shouting' WHEN regexp_matches(text, ' \| ') THEN 'table' WHEN regexp_matches(text, '%%%|###') THEN 'symbols' ELSE 'Other' END AS topic FROM documents""")
def topic_classify(documents):
    """The first of an ordered list of patterns that hits."""
    t = F.col("text")
    return documents.select("doc_id", F.when(F.lower(t).rlike("!!"), "shouting").when(t.rlike(r" \| "), "table").when(t.rlike("%%%|###"), "symbols").otherwise("Other").alias("topic"))


@query("documents", oracle="SELECT doc_id, n_chars >= 100 AS for_estimate, n_chars >= 50 AS for_inference, n_chars >= 200 AS for_scoring FROM documents WHERE length(text) >= 50")
def length_filters(documents):
    n = F.col("n_chars")
    return documents.where(F.length("text") >= 50).select("doc_id", (n >= 100).alias("for_estimate"), (n >= 50).alias("for_inference"), (n >= 200).alias("for_scoring"))


@query("events", oracle="""
SELECT event_id, json_extract_string(props, '$.page') AS page, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE json_valid(props)""")
def robust_json(events):
    """Fields of a JSON column; what is no JSON is left out."""
    return events.where(F.try_parse_json("props").isNotNull()).select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("pages", oracle=r"""
SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""")
def html_links_and_title(pages):
    """Links, title and host of raw pages."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.size(links).cast("long").alias("n_links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("pages", oracle=r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*(<[^/][^<]*|</p[^<]*)*</(script|style)>', ' ', 'g'), '<[^>]*>', chr(10), 'g'), '[ \t\n]+', ' ', 'g'))) AS h FROM pages""")
def html_to_text(pages):
    """Tags stripped by patterns."""
    bare = F.regexp_replace(F.regexp_replace("html", r"<(script|style)[^>]*>[^<]*(<[^/][^<]*|</p[^<]*)*</(script|style)>", " "), "<[^>]*>", "\n")
    return pages.select("page_id", F.md5(F.trim(F.regexp_replace(bare, "[ \t\n]+", " "))).alias("h"))


_SETS = f"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:], ' ')) ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM t WHERE len(w) >= 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT c.a, c.b, k / (x.n + y.n - k) AS j FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE k / (x.n + y.n - k) >= 0.8),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r),
cl AS (SELECT id, min(r) AS cluster FROM reach GROUP BY 1),
rep AS (SELECT cluster, arg_min(id, (-d.n_chars, id)) AS representative, count(*) AS members FROM cl JOIN documents d ON d.doc_id = cl.id GROUP BY 1)
"""


def _shingles(documents):
    """Of every text with a word; one of fewer than five words meets its copies only."""
    return D.shingle_table(documents, min_tokens=1, clean=False)


def _classes(documents):
    return D.set_classes(D.shingle_sets(documents, min_tokens=1, clean=False))


def _clusters(documents):
    clusters = D.clusters(_classes(documents), documents.select(F.col("doc_id").alias("id")).distinct())
    return clusters, D.representatives(clusters, documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("length")))


@query("documents", oracle=_SETS + "SELECT g AS shingle, count(*) AS df FROM s GROUP BY 1")
def shingle_document_frequency(documents):
    return D.document_frequency(_shingles(documents))


@query("documents", oracle=_SETS + "SELECT a, b, round(j, 9) AS jaccard FROM p")
def near_duplicate_pairs(documents):
    """Verified pairs of near duplicates by prefix filtering."""
    return D.all_pairs(_classes(documents)).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query("documents", oracle=_SETS + "SELECT id, cluster FROM cl")
def near_duplicate_clusters(documents):
    """Components of verified pairs over all documents, named by their least id; a text without a word is one of its own."""
    return _clusters(documents)[0].select("id", "cluster")


@query("documents", oracle=_SETS + "SELECT cluster, representative, members FROM rep")
def cluster_representatives(documents):
    return _clusters(documents)[1]


@query("documents", oracle=_SETS + """
SELECT CAST(sum(members) AS BIGINT) AS documents, count(*) FILTER (members > 1) AS clusters, count(*) FILTER (members = 1) AS singletons, max(members) AS largest,
round(1 - count(*) / sum(members), 9) AS reduction FROM rep""")
def dedup_cluster_summary(documents):
    """Totals of the clusters and the reduction."""
    return D.summary(_clusters(documents)[1])


@query("documents")
def minhash_lsh_pairs(documents):
    """Candidate pairs by banded signatures; approximate, so a test measures recall against the verified pairs."""
    return D.lsh_pairs(D.minhash(_shingles(documents)))


@query("documents", oracle=_SETS + "SELECT cluster, id, id = representative AS is_representative FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id = representative DESC, md5(CAST(id AS VARCHAR))) AS k FROM cl JOIN rep USING (cluster)) WHERE k <= 3")
def cluster_member_samples(documents):
    clusters, reps = _clusters(documents)
    return D.sample_members(clusters, reps)
