"""Training sets, caches, checks of metrics and linear fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvella.functions import text as T
from corvella.operators import training as R

from .registry import query

_PAIRS = """pairs AS (SELECT l_orderkey % 50 AS docket, l_orderkey * 10 + l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' ELSE 'maybe' END AS label,
CAST(l_quantity AS BIGINT) AS words, l_extendedprice AS score FROM lineitem)"""


def _pairs(lineitem):
    label = F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "N", "no").otherwise("maybe")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return lineitem.select((F.col("l_orderkey") % 50).alias("docket"), key.alias("id"), label.alias("label"), F.col("l_quantity").cast("long").alias("words"), F.col("l_extendedprice").alias("score"))


@query("part", oracle="SELECT p_partkey, trim(concat_ws(' ', coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END, ''), coalesce(CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_type END, ''))) AS text FROM part")
def response_text(part):
    return part.select("p_partkey", R.response_text(F.when(F.col("p_size") % 3 != 0, F.col("p_name")), F.when(F.col("p_size") % 2 != 0, F.col("p_type"))).alias("text"))


@query("documents", oracle="SELECT doc_id, md5(coalesce(text, '')) AS code FROM documents")
def distinct_query_encode(documents):
    """Each distinct text is encoded once and the codes go back to all rows."""
    coded = R.encode_distinct(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", F.md5("text"), "code")
    return coded.select("doc_id", "code")


@query("lineitem", oracle=f"""
WITH {_PAIRS}, p AS (SELECT id, label AS p FROM pairs WHERE label IN ('yes', 'no')), q AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'no' ELSE label END AS q FROM pairs WHERE id % 3 = 0)
SELECT count(*) AS n_pairs, round(avg(CASE WHEN p = q THEN 1.0 ELSE 0.0 END), 4) AS agreement, round(avg(CASE WHEN p = 'yes' THEN 1.0 ELSE 0.0 END), 4) AS primary_yes_rate,
round(avg(CASE WHEN q = 'yes' THEN 1.0 ELSE 0.0 END), 4) AS qa_yes_rate FROM p JOIN q USING (id) WHERE q IN ('yes', 'no')""")
def qa_agreement(lineitem):
    pairs = _pairs(lineitem)
    second = pairs.where("id % 3 = 0").withColumn("label", F.when(F.col("id") % 7 == 0, "no").otherwise(F.col("label")))
    return R.agreement(pairs, second, ("id",))


@query("lineitem", oracle=f"""
WITH {_PAIRS}, n AS (SELECT docket, id AS neg, words AS m, score AS s FROM pairs WHERE label = 'no'), w AS (SELECT DISTINCT docket, words AS l FROM pairs WHERE label = 'yes'),
m AS (SELECT w.docket, l, neg, m, s, m BETWEEN l * 0.5 AND l * 1.5 AS near FROM w JOIN n USING (docket)), f AS (SELECT *, count(*) FILTER (near) OVER (PARTITION BY docket, l) >= 2 AS enough,
row_number() OVER (PARTITION BY docket, l ORDER BY abs(m - l), neg) AS r FROM m), c AS (SELECT *, row_number() OVER (PARTITION BY docket, l ORDER BY s DESC, neg) AS k FROM f WHERE CASE WHEN enough THEN near ELSE r <= 10 END),
t AS (SELECT docket, l, string_agg(neg::VARCHAR, ',' ORDER BY k) AS negatives FROM c WHERE k <= 2 GROUP BY 1, 2 HAVING count(*) > 1)
SELECT p.docket, p.id, t.negatives FROM pairs p JOIN t ON p.docket = t.docket AND p.words = t.l WHERE p.label = 'yes'""")
def hard_negative_triplets(lineitem):
    """Of each positive the two best-scored negatives of like length."""
    found = R.hard_negatives(_pairs(lineitem), "docket", id_col="id", label="label", length="words", score="score")
    return found.select("docket", "id", F.array_join(F.transform("negatives", lambda x: x.cast("string")), ",").alias("negatives"))


@query("labels", oracle="SELECT CASE WHEN sum(quality) = 0 THEN 1.0 ELSE (count(*) - sum(quality)) / sum(quality) END AS weight FROM labels")
def class_weight(labels):
    return R.positive_weight(labels, F.col("quality") == 1)


@query("labels", oracle="""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN k <= round(n * 0.1) THEN 'test' WHEN k <= round(n * 0.1) + round(n * 0.15) THEN 'val' ELSE 'train' END AS fold FROM r""")
def stratified_split(labels):
    """Exact shares of each label."""
    return R.stratified_split(labels.select("doc_id", "quality"), "quality", "doc_id")


@query("lineitem", "part", oracle="""
WITH c AS (SELECT l_orderkey AS query, l_linenumber * 100000 + l_partkey AS rank, l_partkey AS item FROM lineitem),
k AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY rank) AS k, item FROM c WHERE item IN (SELECT p_partkey FROM part WHERE p_size > 10))
SELECT query, k AS rank, item FROM k WHERE k <= 3""")
def paper_cache(lineitem, part):
    """Cached ranks of what still exists, without gaps."""
    cache = lineitem.select(F.col("l_orderkey").alias("query"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("rank"), F.col("l_partkey").alias("item"))
    return R.cached_ranks(cache, part.where("p_size > 10").select(F.col("p_partkey").alias("item")), 3).withColumn("rank", F.col("rank").cast("long"))


@query("embeddings", oracle="""
WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2),
v AS (SELECT label, list(m ORDER BY i) AS centre FROM c GROUP BY 1)
SELECT a.label AS a, b.label AS b, round(1 - list_cosine_similarity(a.centre, b.centre), 9) AS distance FROM v a JOIN v b ON a.label < b.label ORDER BY distance DESC, a, b LIMIT 8""")
def contrast_pairs(embeddings):
    """The cluster centres that are farthest apart."""
    spread = embeddings.where("embedding is not null").select("label", F.posexplode("embedding").alias("i", "x"))
    means = spread.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("centre"))
    return R.contrast_pairs(centres)


@query("lineitem", oracle="""
WITH o AS (SELECT l_orderkey, avg(l_quantity) AS o FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < o THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM lineitem JOIN o USING (l_orderkey) WHERE l_linenumber <> 1""")
def binary_drop(lineitem):
    """One where a worsened row scores below its original."""
    rows = lineitem.withColumn("kind", F.when(F.col("l_linenumber") == 1, "Original").otherwise("worse_obvious"))
    return R.binary_drop(rows, "l_orderkey", "kind", "l_quantity", "l_linenumber")


@query("lineitem", oracle="""
WITH b AS (SELECT l_linenumber AS metric, max(l_extendedprice) AS best FROM lineitem GROUP BY 1), r AS (SELECT metric, row_number() OVER (ORDER BY best DESC, metric) AS rank FROM b) SELECT metric, rank, 1 / rank AS rel FROM r""")
def ranking_ground_truth(lineitem):
    found = R.rank_relevance(lineitem.select(F.col("l_linenumber").alias("metric"), "l_extendedprice"), "metric", "l_extendedprice")
    return found.select("metric", F.col("rank").cast("long").alias("rank"), "rel")


@query("events", oracle="""
WITH q AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM events GROUP BY 1),
k AS (SELECT event_type, count(*) AS kept FROM events JOIN q USING (event_type) WHERE value BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25) GROUP BY 1)
SELECT event_type, n, round(mean, 6) AS mean, round(std, 6) AS std, round(1.96 * std / sqrt(n), 6) AS half, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, kept FROM q LEFT JOIN k USING (event_type)""")
def runtime_statistics(events):
    """Mean, interval, quartiles and what lies within the fences, by kind."""
    found = R.run_statistics(events, "event_type", "value")
    return found.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "half", "p25", "p50", "p75")), "kept")


@query("lineitem", oracle="""
WITH r AS (SELECT l_returnflag AS target, l_linenumber AS metric, corr(l_quantity, l_extendedprice) AS val, corr(l_discount, l_tax) AS test FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(round(val, 9)) DESC, metric) AS k FROM r)
SELECT target, k, metric, round(test, 6) AS test FROM k WHERE k <= 5""")
def top_metrics_by_validation(lineitem):
    """Of each target the five metrics of greatest validation correlation, with that on the test rows."""
    found = lineitem.groupBy(F.col("l_returnflag").alias("target"), F.col("l_linenumber").alias("metric")).agg(F.corr("l_quantity", "l_extendedprice").alias("val"), F.corr("l_discount", "l_tax").alias("test"))
    k = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.abs(F.round("val", 9))), "metric"))
    return found.withColumn("k", k).where("k <= 5").select("target", F.col("k").cast("long").alias("k"), "metric", F.round("test", 6).alias("test"))


@query("lineitem", oracle="""
WITH c AS (SELECT l_returnflag AS dataset, l_linenumber AS metric, l_linestatus AS category, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) SELECT dataset, category, count(DISTINCT metric) AS metrics, sum(n)::BIGINT AS uses FROM c GROUP BY 1, 2""")
def metric_tally(lineitem):
    """Counts by dataset, metric and category, then without the metric."""
    counts = lineitem.groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linenumber").alias("metric"), F.col("l_linestatus").alias("category")).agg(F.count("*").alias("n"))
    return counts.groupBy("dataset", "category").agg(F.count("metric").alias("metrics"), F.sum("n").alias("uses"))


@query("lineitem", oracle="SELECT l_orderkey, l_linenumber, l_extendedprice - l_quantity * 1000 AS gap FROM lineitem")
def pairwise_metric(lineitem):
    """The score of one output less that of the other."""
    return lineitem.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - F.col("l_quantity") * 1000).alias("gap"))


@query("documents", oracle="""
WITH s AS (SELECT doc_id, text FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50), a AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0)
SELECT (SELECT count(*) FROM s) AS sampled, (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT doc_id, text FROM documents)) AS foreign_rows, (SELECT count(*) FROM (SELECT * FROM s INTERSECT SELECT * FROM a)) AS overlap""")
def subset_consistency(documents):
    """A seeded subset, what of it is foreign to the whole, and its overlap with another."""
    rows = documents.select("doc_id", "text")
    some = rows.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(50)
    one = lambda d, name: d.agg(F.count("*").alias(name))
    return one(some, "sampled").crossJoin(one(some.exceptAll(rows), "foreign_rows")).crossJoin(one(some.intersect(rows.where("doc_id % 2 = 0")), "overlap"))


@query("lineitem", oracle="""
SELECT 'intercept' AS name, round(regr_intercept(l_extendedprice, l_quantity), 2) AS coefficient FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 2) FROM lineitem""")
def linear_regression(lineitem):
    return R.linear_fit(lineitem, ("l_quantity",), "l_extendedprice", digits=2)


@query("lineitem", oracle="""
WITH c AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy, count(*) AS n FROM lineitem),
b AS (SELECT (xy - n * mx * my) / (xx - n * mx * mx + 100.0) AS slope, mx, my FROM c)
SELECT 'intercept' AS name, round(my - slope * mx, 2) AS coefficient FROM b UNION ALL SELECT 'l_quantity', round(slope, 2) FROM b""")
def ridge_regression(lineitem):
    """With a penalty of 100 on the slope."""
    return R.linear_fit(lineitem, ("l_quantity",), "l_extendedprice", ridge=100.0, digits=2)


@query("orders", oracle="""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, (CASE WHEN o_orderstatus IN ('F', 'P') THEN 2 ELSE 0 END) + (CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(o_orderpriority), 'high') THEN 1 ELSE 0 END) AS score FROM orders),
b AS (SELECT *, max(score) OVER (PARTITION BY o_custkey) AS best FROM s)
SELECT o_custkey, o_orderkey, score FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN best > 0 THEN -score ELSE 0 END, CASE WHEN best > 0 THEN NULL ELSE o_orderdate END, o_orderkey) = 1""")
def call_document_selection(orders):
    """The best-scored document of each collection; where none scores, the earliest."""
    score = F.when(F.col("o_orderstatus").isin("F", "P"), 2).otherwise(0) + F.when(F.col("o_orderpriority") == "1-URGENT", 3).otherwise(0) + F.when(F.lower("o_orderpriority").contains("high"), 1).otherwise(0)
    scored = orders.select("o_custkey", "o_orderkey", "o_orderdate", score.alias("score"))
    best = F.min_by(F.struct("o_orderkey", "score"), F.struct(-F.col("score"), F.col("o_orderkey")))
    earliest = F.min_by(F.struct("o_orderkey", "score"), F.struct("o_orderdate", "o_orderkey"))
    chosen = scored.groupBy("o_custkey").agg(F.when(F.max("score") > 0, best).otherwise(earliest).alias("c"))
    return chosen.select("o_custkey", "c.o_orderkey", "c.score")


@query("lineitem", "orders", oracle="""
WITH a AS (SELECT l_orderkey, count(*) AS attachments_count, string_agg('https://files/' || l_partkey || '.pdf', ';' ORDER BY l_linenumber, l_partkey) AS attachments_urls FROM lineitem GROUP BY 1)
SELECT o_orderkey, left(repeat(o_orderpriority, 3), 20) AS comment, coalesce(attachments_count, 0) AS attachments_count, coalesce(attachments_urls, '') AS attachments_urls FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""")
def attachment_flatten(lineitem, orders):
    """Comments cut to a length, with the number and the list of their attachments."""
    url = F.struct("l_linenumber", "l_partkey", F.concat(F.lit("https://files/"), F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("u"))
    files = lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(url)), lambda x: x["u"]), ";").alias("urls"))
    joined = orders.join(files, orders["o_orderkey"] == files["l_orderkey"], "left")
    return joined.select("o_orderkey", F.substring(F.repeat("o_orderpriority", F.lit(3)), 1, 20).alias("comment"), F.coalesce("n", F.lit(0)).alias("attachments_count"), F.coalesce("urls", F.lit("")).alias("attachments_urls"))


@query("events", oracle="""
WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"Document ID": "A-' || event_id || '"}' WHEN 1 THEN '{"DocumentId": "", "doc_id": " B' || event_id || ' "}' WHEN 2 THEN '{"document_id": " "}' WHEN 3 THEN 'no json' END AS j FROM events)
SELECT event_id, coalesce(nullif(trim(CASE WHEN json_valid(j) THEN j ->> '$."Document ID"' END), ''), nullif(trim(CASE WHEN json_valid(j) THEN j ->> '$.doc_id' END), ''), 'dir-' || event_id) AS doc_id FROM p""")
def metadata_doc_id(events):
    """The first spelling of the id that holds a value, else the folder's name."""
    e, k = F.col("event_id").cast("string"), F.col("event_id") % 5
    j = F.when(k == 0, F.concat(F.lit('{"Document ID": "A-'), e, F.lit('"}'))).when(k == 1, F.concat(F.lit('{"DocumentId": "", "doc_id": " B'), e, F.lit(' "}'))).when(k == 2, '{"document_id": " "}').when(k == 3, "no json")
    found = [F.nullif(F.trim(F.get_json_object(j, f"$['{name}']")), F.lit("")) for name in ("Document ID", "DocumentId", "document_id", "doc_id", "DocumentID")]
    return events.select("event_id", F.coalesce(*found, F.concat(F.lit("dir-"), e)).alias("doc_id"))


@query("orders", oracle="""
SELECT 'connector_rule_history' AS scrape_mode, 'orders' AS source, o_orderkey::VARCHAR AS fr_document_number, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, o_orderkey::VARCHAR) AS title, o_orderstatus AS type,
strftime(o_orderdate, '%Y-%m-%d') AS publication_date, o_custkey::VARCHAR AS docket_id, false AS comment_active, 'FALSE' AS is_rfi_rfc, '1' AS history_rank, 'seed' AS history_relationship FROM orders""")
def document_to_rule_row(orders):
    """A rule's row with defaults where the document says nothing."""
    key = F.col("o_orderkey").cast("string")
    return orders.select(
        F.lit("connector_rule_history").alias("scrape_mode"), F.lit("orders").alias("source"), key.alias("fr_document_number"), F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")), key).alias("title"),
        F.col("o_orderstatus").alias("type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"), F.col("o_custkey").cast("string").alias("docket_id"), F.lit(False).alias("comment_active"),
        F.lit("FALSE").alias("is_rfi_rfc"), F.lit("1").alias("history_rank"), F.lit("seed").alias("history_relationship"),
    )


@query("lineitem", oracle="""
WITH g AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS a, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS b FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, a, CASE WHEN len(b) > 1 THEN b[1:len(b) - 1] ELSE b END AS b FROM g), u AS (SELECT l_orderkey, unnest(range(1, len(a) + 1)) AS i, a, b FROM s)
SELECT l_orderkey, i, a[i] AS part, b[i] AS quantity FROM u""")
def aligned_explode(lineitem):
    """Lists of one row that belong together, one element of each in a row; a shorter list ends in nulls."""
    pair = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    lists = lineitem.groupBy("l_orderkey").agg(pair.alias("p")).select("l_orderkey", F.transform("p", lambda x: x["l_partkey"]).alias("a"), F.transform("p", lambda x: x["l_quantity"]).alias("b"))
    short = lists.withColumn("b", F.when(F.size("b") > 1, F.slice("b", F.lit(1), F.size("b") - 1)).otherwise(F.col("b")))
    return short.select("l_orderkey", F.posexplode(F.arrays_zip("a", "b")).alias("i", "z")).select("l_orderkey", (F.col("i") + 1).cast("long").alias("i"), F.col("z.a").alias("part"), F.col("z.b").alias("quantity"))


@query("orders", oracle=r"""
WITH f AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'SR-NYSE-' || o_custkey WHEN 1 THEN ' s7-' || lpad((o_custkey % 100)::VARCHAR, 2, '0') || '-11' WHEN 2 THEN 'S7-2024-' || lpad((o_custkey % 100)::VARCHAR, 2, '0') ELSE 'other' END AS n,
CASE WHEN o_orderkey % 8 = 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 8 = 6 THEN 'bad' END AS d FROM orders), u AS (SELECT o_orderkey, upper(trim(n)) AS n, d FROM f),
x AS (SELECT *, regexp_extract(n, '^S7-(\d{2,4})-(\d{2})', 1) AS a, regexp_extract(n, '^S7-(\d{2,4})-(\d{2})', 2) AS b FROM u)
SELECT o_orderkey, CASE WHEN starts_with(n, 'SR-') THEN 'SRO_INDEX_SEARCH' WHEN length(a) = 4 THEN 'NEW_STYLE_AGENCY' WHEN a <> '' THEN 'OLD_STYLE_AGENCY' ELSE 'UNKNOWN_FORMAT' END AS method,
CASE WHEN a <> '' THEN 'https://www.sec.gov/comments/' || lower(n) || '/s7' || a || b || '.htm' END AS primary_url,
CASE WHEN length(a) = 4 AND d IS NOT NULL THEN CASE WHEN TRY_CAST(d AS DATE) IS NULL THEN 'Error: Invalid Date Format provided' ELSE 'https://www.sec.gov/rules-regulations/' || strftime(TRY_CAST(d AS DATE), '%Y/%m') || '/' || lower(n) END END AS fallback_url FROM x""")
def filing_urls(orders):
    """Where the comments on a filing are, by the shape of its number."""
    two, k = F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("SR-NYSE-"), F.col("o_custkey").cast("string"))).when(k == 1, F.concat(F.lit(" s7-"), two, F.lit("-11"))).when(k == 2, F.concat(F.lit("S7-2024-"), two)).otherwise("other")
    posted = F.when(F.col("o_orderkey") % 8 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 8 == 6, "bad")
    rows = orders.select("o_orderkey", F.upper(F.trim(raw)).alias("n"), posted.alias("d"))
    shape = r"^S7-(\d{2,4})-(\d{2})"
    a, b, day = F.regexp_extract("n", shape, 1), F.regexp_extract("n", shape, 2), F.col("d").try_cast("date")
    landing = F.concat(F.lit("https://www.sec.gov/rules-regulations/"), F.date_format(day, "yyyy/MM"), F.lit("/"), F.lower("n"))
    return rows.select(
        "o_orderkey",
        F.when(F.col("n").startswith("SR-"), "SRO_INDEX_SEARCH").when(F.length(a) == 4, "NEW_STYLE_AGENCY").when(a != "", "OLD_STYLE_AGENCY").otherwise("UNKNOWN_FORMAT").alias("method"),
        F.when(a != "", F.concat(F.lit("https://www.sec.gov/comments/"), F.lower("n"), F.lit("/s7"), a, b, F.lit(".htm"))).alias("primary_url"),
        F.when((F.length(a) == 4) & F.col("d").isNotNull(), F.coalesce(landing, F.lit("Error: Invalid Date Format provided"))).alias("fallback_url"),
    )


@query("part", oracle=r"""
SELECT p_partkey, left(array_to_string(list_filter([trim(p_name), trim(CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '  ' END), trim(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END), CASE WHEN p_size < 20 THEN p_size || ' ' || p_brand END], lambda x: x IS NOT NULL AND x <> ''), chr(10) || chr(10)), 60) AS text FROM part""")
def regulation_text(part):
    """Title, agency and abstract, then the leaves of a structure, under each other and cut to a length."""
    leaves = F.array_join(F.array(F.col("p_size").cast("string"), F.col("p_brand")), " ")
    parts = F.array(F.trim("p_name"), F.trim(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("  ")), F.trim(F.when(F.col("p_size") % 3 != 0, F.col("p_type"))), F.when(F.col("p_size") < 20, leaves))
    return part.select("p_partkey", F.substring(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n\n"), 1, 60).alias("text"))


@query("conversations", oracle="""
WITH t AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'You said:' ELSE 'Assistant:' END || chr(10) || replace(replace(coalesce(text, ''), 'You said:', ''), 'Assistant:', ''), chr(10) ORDER BY turn, role, text) AS log FROM conversations GROUP BY 1),
l AS (SELECT conv_id, unnest(string_split(log, chr(10))) AS line, unnest(range(len(string_split(log, chr(10))))) AS i FROM t), m AS (SELECT *, line IN ('You said:', 'Assistant:') AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY conv_id ORDER BY i) AS msg FROM m)
SELECT conv_id, msg::BIGINT AS msg, max(CASE WHEN head THEN CASE WHEN line = 'You said:' THEN 'user' ELSE 'assistant' END END) AS role, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), '')) AS h FROM s GROUP BY 1, 2""")
def chat_log_parse(conversations):
    """Messages of chat logs in which a line names the speaker and the lines below are theirs."""
    said = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("You said:"), F.lit("")), F.lit("Assistant:"), F.lit(""))
    turn = F.struct("turn", "role", "text", F.concat(F.when(F.col("role") == "user", "You said:").otherwise("Assistant:"), F.lit("\n"), said).alias("s"))
    logs = conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["s"]), "\n").alias("log"))
    lines = logs.select("conv_id", F.posexplode(F.split("log", "\n")).alias("i", "line")).withColumn("head", F.col("line").isin("You said:", "Assistant:"))
    numbered = lines.withColumn("msg", F.sum(F.col("head").cast("int")).over(Window.partitionBy("conv_id").orderBy("i")))
    role = F.max(F.when(F.col("head"), F.when(F.col("line") == "You said:", "user").otherwise("assistant")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("i", "line")))), lambda x: x["line"]), "\n")
    return numbered.groupBy("conv_id", "msg").agg(role.alias("role"), F.md5(body).alias("h"))


@query("nation", "customer", oracle="""
WITH u AS (SELECT c_nationkey, string_agg(c_name, ', ' ORDER BY c_custkey) FILTER (c_custkey <= 50) AS note FROM customer GROUP BY 1), t AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'seen  ' END AS notes FROM nation)
SELECT n_nationkey, n_name, CASE WHEN note IS NULL THEN notes WHEN coalesce(notes, '') <> '' THEN rtrim(notes) || chr(10) || chr(10) || '---' || chr(10) || 'GUIDANCE:' || chr(10) || note ELSE 'GUIDANCE:' || chr(10) || note END AS notes
FROM t LEFT JOIN u ON c_nationkey = n_nationkey""")
def tracker_update(nation, customer):
    """Notes appended to the rows of a tracker under a rule and a heading; other rows stay."""
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("c_custkey") <= 50, F.struct("c_custkey", "c_name")))), lambda x: x["c_name"])
    updates = customer.groupBy("c_nationkey").agg(F.nullif(F.array_join(named, ", "), F.lit("")).alias("note"))
    old, head = F.when(F.col("n_nationkey") % 2 == 0, "seen  "), F.lit("GUIDANCE:\n")
    merged = F.when(F.col("note").isNull(), old).when(F.coalesce(old, F.lit("")) != "", F.concat(F.rtrim(old), F.lit("\n\n---\n"), head, "note")).otherwise(F.concat(head, "note"))
    return nation.join(updates, nation["n_nationkey"] == updates["c_nationkey"], "left").select("n_nationkey", "n_name", merged.alias("notes"))


@query("events", oracle=r"""
SELECT event_id, TRY_CAST(regexp_replace(trim(strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'), 'Z$', '') AS TIMESTAMP) AS posted, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN 'spring' END AS day,
TRY_CAST(regexp_extract('in ' || strftime(ts, '%Y') || ', of 12345', '(?:^|[^0-9A-Za-z_])([0-9]{4})(?:[^0-9A-Za-z_]|$)', 1) AS INT) AS year, lower(trim(CASE event_id % 4 WHEN 0 THEN ' TRUE' WHEN 1 THEN 'y' WHEN 2 THEN '0' ELSE '' END)) IN ('true', '1', 'yes', 'y') AS flag,
regexp_extract(lower(trim(CASE event_id % 4 WHEN 0 THEN 'Yes, it is' WHEN 1 THEN 'no.' WHEN 2 THEN 'nothing' ELSE '{"error": 1}' END)), '^(yes|no)(?:[^a-z0-9_]|$)', 1) AS label, ts < TIMESTAMP '2024-01-15' AS early FROM events""")
def cell_parsers(events):
    """Posted times, days, years, flags and labels out of text cells."""
    k3, k4 = F.col("event_id") % 3, F.col("event_id") % 4
    posted = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    day = F.when(k3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k3 == 1, "spring")
    return events.select(
        "event_id",
        T.parse_posted(posted).cast("timestamp_ntz").alias("posted"),
        T.sanitize_date(day).alias("day"),
        T.first_year(F.concat(F.lit("in "), F.date_format("ts", "yyyy"), F.lit(", of 12345"))).alias("year"),
        T.parse_bool(F.when(k4 == 0, " TRUE").when(k4 == 1, "y").when(k4 == 2, "0").otherwise("")).alias("flag"),
        T.normalize_label(F.when(k4 == 0, "Yes, it is").when(k4 == 1, "no.").when(k4 == 2, "nothing").otherwise('{"error": 1}')).alias("label"),
        T.before(posted, "2024-01-15").alias("early"),
    )


@query("part", oracle=r"""
SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type || ', ,' || p_brand || ',', ','), lambda x: trim(x)), lambda x: x <> ''), ';') AS files,
array_to_string([p_brand, p_size::VARCHAR, p_partkey::VARCHAR], '__') AS key, regexp_extract(lower(p_brand) || '_2020_2021', '^([a-z]+)_(\d{4}_\d{4})$', 1) AS agency, p_size IN (1, 2, 3) OR contains(lower(p_name), 'red') AS agency_ok,
list_max(list_transform(regexp_extract_all('<<PAGE 2>> a <<PAGE ' || p_size || '>>', '<<PAGE (\d+)>>', 1), lambda x: x::INT)) AS max_page FROM part""")
def key_parsers(part):
    """Lists of files, composite keys, folder names, agencies and page markers."""
    name = F.concat(F.lower("p_brand"), F.lit("_2020_2021"))
    marked = F.concat(F.lit("<<PAGE 2>> a <<PAGE "), F.col("p_size").cast("string"), F.lit(">>"))
    return part.select(
        "p_partkey",
        F.array_join(T.split_list(F.concat("p_type", F.lit(", ,"), "p_brand", F.lit(","))), ";").alias("files"),
        F.concat_ws("__", "p_brand", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("key"),
        F.regexp_extract(name, r"^([a-z]+)_(\d{4}_\d{4})$", 1).alias("agency"),
        (F.col("p_size").isin(1, 2, 3) | F.lower("p_name").contains("red")).alias("agency_ok"),
        F.array_max(F.transform(F.regexp_extract_all(marked, F.lit(r"<<PAGE (\d+)>>"), F.lit(1)), lambda x: x.cast("int"))).alias("max_page"),
    )


@query("documents", oracle=r"""
WITH r AS (SELECT doc_id, regexp_replace(trim(coalesce(string_split(text, chr(10))[1], '')), '\s+', ' ', 'g') AS title, coalesce(nullif(source, 'web'), 'Unknown agency') AS agency, string_split_regex(coalesce(string_split(text, chr(10))[1], ''), '[;:•-]') AS parts, lang FROM documents)
SELECT doc_id, title, agency, array_to_string(list_filter(list_transform(parts, lambda x: trim(x)), lambda x: x <> '')[1:6], '|') AS topics FROM r WHERE title <> ''""")
def row_parse(documents):
    """Rows as a front end shows them: a title of single blanks, a default agency, topics; rows without a title go."""
    first = F.coalesce(F.substring_index("text", "\n", 1), F.lit(""))
    rows = documents.select("doc_id", F.regexp_replace(F.trim(first), r"\s+", " ").alias("title"), F.coalesce(F.nullif("source", F.lit("web")), F.lit("Unknown agency")).alias("agency"), first.alias("line"))
    parts = F.filter(F.transform(F.split("line", "[;:•-]"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.where("title <> ''").select("doc_id", "title", "agency", F.array_join(F.slice(parts, 1, 6), "|").alias("topics"))


@query("events", oracle="""
SELECT user_id, event_type AS kind, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def manifest_first_rows(events):
    """The first row of each kind and document, in order of arrival."""
    return events.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.min("event_id").alias("event_id"))


@query("events", oracle="""
WITH d AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS extracted FROM events) SELECT 'done' AS wanted, event_id FROM d WHERE extracted UNION ALL SELECT 'open', event_id FROM d WHERE NOT extracted UNION ALL SELECT 'all', event_id FROM d""")
def filtered_iteration(events):
    """Downloads that are extracted, that are not, or all; a missing state is in the last only."""
    rows = events.select("event_id", F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False).alias("extracted"))
    wanted = F.array_compact(F.array(F.when(F.col("extracted"), "done"), F.when(~F.col("extracted"), "open"), F.lit("all")))
    return rows.select(F.explode(wanted).alias("wanted"), "event_id")
