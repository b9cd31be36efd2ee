"""Detectors, cleaners, facets, sampling and report queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvella.functions import rules as U
from corvella.functions import text as T
from corvella.operators import evaluation as E

from .registry import query


@query("benchmark", oracle=r"""
WITH b AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Request for Information: ' WHEN 1 THEN 'requests for comments; ' WHEN 2 THEN 'IETF RFC 1234 ' ELSE '' END || text AS title, CASE WHEN item_id % 3 = 0 THEN 'RFC' END AS note FROM benchmark),
u AS (SELECT item_id, CASE WHEN regexp_matches(title, '(?i)\bIETF\b|\bRFC\s*\d{3,5}\b|\brequest\s+for\s+correction\b') THEN '' ELSE title END AS title, coalesce(note, '') AS note FROM b),
h AS (SELECT item_id, regexp_matches(title, '(?i)\brequests?\s+for\s+information\b|\bRFI\b') AS ti, regexp_matches(title, '(?i)\brequests?\s+for\s+comments?\b|\bRFC\b') AS tc, note = 'RFC' AS nc FROM u)
SELECT item_id, CASE WHEN ti AND (tc OR nc) THEN 'RFI;RFC' WHEN ti THEN 'RFI' WHEN tc OR nc THEN 'RFC' ELSE 'NONE' END AS label,
concat_ws(';', CASE WHEN nc THEN 'note' END, CASE WHEN ti OR tc THEN 'title' END) AS matched FROM h""")
def rfi_rfc_detector(benchmark):
    k = F.col("item_id") % 4
    title = F.concat(F.when(k == 0, "Request for Information: ").when(k == 1, "requests for comments; ").when(k == 2, "IETF RFC 1234 ").otherwise(""), "text")
    found = U.request_label({"title": title, "note": F.when(F.col("item_id") % 3 == 0, "RFC")})
    return benchmark.select("item_id", found.alias("f")).select("item_id", "f.label", "f.matched")


def _snippet(text: str) -> str:
    cuts = []
    for pattern in U.CITATIONS:
        hit = f"regexp_extract({text}, '{pattern}', 0)"
        at = f"strpos({text}, {hit})"
        cut = f"trim(regexp_replace(substr({text}, greatest({at} - 120, 1), {at} + length({hit}) + 160 - greatest({at} - 120, 1)), '\\s+', ' ', 'g'))"
        cuts.append(f"CASE WHEN {hit} <> '' THEN CASE WHEN length({cut}) > 280 THEN left({cut}, 277) || '...' ELSE {cut} END END")
    return f"coalesce({', '.join(cuts)})"


@query("benchmark", oracle=f"SELECT item_id, coalesce({_snippet('t')}, {_snippet('text')}) AS snippet FROM (SELECT item_id, text, text || ' We respond: responses to comments are ' || text AS t FROM benchmark)")
def comment_citation_snippet(benchmark):
    """What stands around a sign that a text answers comments."""
    return benchmark.select("item_id", U.citation_snippet(F.concat("text", F.lit(" We respond: responses to comments are "), "text")).alias("snippet"))


@query("orders", oracle="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'F' THEN 'closed' WHEN TIMESTAMP '1996-01-01' < o_orderdate THEN 'scheduled'
WHEN TIMESTAMP '1996-01-01' > o_orderdate + INTERVAL 60 DAY THEN 'closed' ELSE 'open' END AS status FROM orders""")
def comment_status(orders):
    """Open, closed, scheduled or unknown as of a fixed time."""
    now = F.lit("1996-01-01").cast("timestamp_ntz")
    flag = F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False)
    return orders.select("o_orderkey", U.comment_status(now, F.col("o_orderdate"), F.expr("o_orderdate + interval 60 days"), flag).alias("status"))


@query("orders", oracle="""
SELECT o_orderkey, o_orderdate > TIMESTAMP '1996-01-01' AS active FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '1996-06-01'""")
def closing_range_and_active(orders):
    bounds = F.lit("1995-06-01").cast("timestamp_ntz"), F.lit("1996-06-01").cast("timestamp_ntz")
    kept = orders.where(U.in_closing_range(F.col("o_orderdate"), *bounds))
    return kept.select("o_orderkey", U.is_active(F.lit("1996-01-01").cast("timestamp_ntz"), F.col("o_orderdate"), F.lit(False)).alias("active"))


@query("part", oracle="""
SELECT p_partkey FROM part WHERE contains(lower(p_name), '1') OR contains(lower(p_type), 'brass') OR contains(lower(p_brand), '#3')""")
def substring_query_match(part):
    """A needle in any of several fields."""
    return part.where(F.lower("p_name").contains("1") | F.lower("p_type").contains("brass") | F.lower("p_brand").contains("#3")).select("p_partkey")


@query("part", oracle=r"""
WITH p AS (SELECT p_partkey, regexp_replace(p_name, '[^A-Z]', '', 'g') AS caps, list_filter(string_split_regex(trim(p_name), '\s+'), lambda w: w <> '') AS ws FROM part)
SELECT p_partkey, CASE WHEN length(caps) >= 2 THEN left(caps, 6) WHEN len(ws) = 1 THEN upper(left(ws[1], 4)) ELSE array_to_string(list_transform(ws[1:5], lambda w: upper(left(w, 1))), '') END AS acronym FROM p""")
def agency_acronym(part):
    return part.select("p_partkey", T.acronym(F.col("p_name")).alias("acronym"))


@query("events", oracle="SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS at FROM events")
def glued_chat_dates(events):
    """Timestamps written without a space before the time."""
    text = F.date_format(F.col("ts").cast("timestamp"), "M/d/yyyyh:mm a")
    return events.select("event_id", F.date_format(U.glued_chat_date(text), "yyyy-MM-dd HH:mm").alias("at"))


@query("conversations", oracle=r"""
SELECT conv_id, turn, md5(array_to_string(list_filter(string_split('12/34' || chr(10) || 'ok' || chr(10) || 'x1' || chr(10) || text, chr(10)),
lambda s: NOT regexp_matches(trim(s), '(?i)^[€©®]+|^[|\[\]{}]+$|^chat\.openai\.com|^G Gmail|^Microsoft Office|^\+ ?(New ?chat|New Tab)|^Default \(GPT|^Regenerate response|^Free Research Preview|^ChatGPT (May|June|July|Aug|Sep|Oct|Nov|Dec|Jan|Feb|Mar|Apr)|^Send a message|^\d+/\d+$')
AND (length(trim(s)) > 2 OR lower(trim(s)) IN ('i', 'a', 'ok', 'no'))), chr(10))) AS h FROM conversations WHERE text IS NOT NULL""")
def ocr_line_clean(conversations):
    text = F.concat(F.lit("12/34\nok\nx1\n"), "text")
    return conversations.where("text is not null").select("conv_id", "turn", F.md5(U.clean_ocr(text)).alias("h"))


@query("orders", oracle=r"""
SELECT o_orderkey, 'SR-NYSE-' || year(o_orderdate) || '-' || o_custkey || ';S7-' || o_custkey AS ids FROM orders""")
def filing_number_extract(orders):
    """File numbers in running text, dashes mended, each once."""
    y, c = F.year("o_orderdate").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit("see sr–nyse-"), y, F.lit(" - "), c, F.lit(", again SR-NYSE-"), y, F.lit("-"), c, F.lit(" and S7-"), c, F.lit("."))
    return orders.select("o_orderkey", F.array_join(U.filing_numbers(text), ";").alias("ids"))


@query("documents", oracle=r"""
SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_claims, true AS ok FROM documents""")
def claims_parse(documents):
    """Lists of strings within prose."""
    raw = F.concat(F.lit("Here it is: "), F.to_json(F.split(F.coalesce("text", F.lit("")), "\n")), F.lit(" - done"))
    return documents.select("doc_id", U.parse_claims(raw).alias("c")).select("doc_id", F.size("c.claims").cast("long").alias("n_claims"), "c.ok")


@query("events", oracle="SELECT event_id, len(json_keys(props)) AS n FROM events")
def nested_leaf_text(events):
    """Leaf values of a JSON column."""
    return events.select("event_id", F.size(U.leaf_texts(F.col("props"))).cast("long").alias("n"))


@query("conversations", oracle="""
WITH f AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS b FROM conversations),
c AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY conv_id ORDER BY turn, b) = 1 AND b = 0 THEN 1 ELSE 0 END AS fresh FROM f),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn, b ROWS UNBOUNDED PRECEDING) AS chunk FROM c)
SELECT conv_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS n, min(turn) AS first_turn FROM k GROUP BY 1, 2""")
def boundary_chunks(conversations):
    """Chunks that close when a run of boundaries ends."""
    w = Window.partitionBy("conv_id").orderBy("turn", "b")
    flagged = conversations.select("conv_id", "turn", F.when(F.col("role") == "user", 1).otherwise(0).alias("b"))
    fresh = flagged.withColumn("fresh", F.when((F.lag("b").over(w) == 1) & (F.col("b") == 0), 1).otherwise(0))
    chunk = F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return fresh.withColumn("chunk", chunk).groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query("documents", oracle=r"""
SELECT doc_id, k AS sent, md5(s) AS h FROM (SELECT doc_id, unnest(range(len(p))) AS k, trim(regexp_replace(unnest(p), '[ \t]+', ' ', 'g')) AS s
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)) WHERE s <> ''""")
def argument_explode(documents):
    """Parts with their place, numbered before empty ones are dropped."""
    parts = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("sent", "s"))
    clean = parts.withColumn("s", F.trim(F.regexp_replace("s", "[ \t]+", " "))).where("s <> ''")
    return clean.select("doc_id", F.col("sent").cast("long").alias("sent"), F.md5("s").alias("h"))


@query("documents", oracle="""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM r WHERE k <= greatest(1, CAST(floor(200 * n / (SELECT count(*) FROM documents)) AS BIGINT))""")
def proportional_sample(documents):
    """A seeded sample with each source's share of the whole, one row at least."""
    counts = documents.groupBy("source").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    quota = counts.crossJoin(F.broadcast(total)).select("source", F.greatest(F.lit(1), F.floor(200 * F.col("n") / F.col("total"))).alias("quota"))
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    return documents.select("source", "doc_id", k.alias("k")).where("k <= 200").join(F.broadcast(quota), "source").where("k <= quota").select("source", "doc_id")


@query("part", oracle="""
SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY 2
UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2""")
def facet_metadata(part):
    """Values of several facets in one pass."""
    pair = lambda n, c: F.struct(F.lit(n).alias("facet"), F.col(c).cast("string").alias("value"))
    return part.select(F.explode(F.array(pair("brand", "p_brand"), pair("type", "p_type"), pair("size", "p_size"))).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@query("nation", "region", oracle="""
SELECT a.n_nationkey AS id, b.n_nationkey AS related FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
QUALIFY row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_nationkey) <= 3""")
def related_rules(nation, region):
    """The three first others that share a topic."""
    a, b = nation.alias("a"), nation.alias("b")
    met = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("id"), F.col("b.n_nationkey").alias("related"))
    return met.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("related"))).where("k <= 3").drop("k")


@query("orders", oracle="""
SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderdate NULLS LAST, o_orderkey) <= 3""")
def recommendation_order(orders):
    """Active first, then score, then date, missing dates last."""
    w = Window.partitionBy("o_custkey").orderBy(F.when(F.col("o_orderstatus") == "O", 0).otherwise(1), F.desc("o_totalprice"), F.asc_nulls_last("o_orderdate"), "o_orderkey")
    return orders.withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_custkey", "o_orderkey")


@query("orders", oracle="""
WITH rel AS (SELECT o_custkey % 20 AS q, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders QUALIFY k <= 5),
pred AS (SELECT o_custkey % 20 AS q, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderdate, o_orderkey) AS rank FROM orders)
SELECT q, count(*) FILTER (rank <= 100) / count(*) AS recall FROM rel JOIN pred USING (q, item) GROUP BY 1""")
def recall_at_k(orders):
    q = orders.select((F.col("o_custkey") % 20).alias("q"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("rel"), "o_orderdate")
    pred = q.select("q", "item", F.row_number().over(Window.partitionBy("q").orderBy("o_orderdate", "item")).alias("rank"))
    return E.recall(q.select("q", "item", "rel"), pred, 100)


@query("lineitem", oracle="""
SELECT l_returnflag, avg(l_quantity) FILTER (l_linenumber = 1) AS s1, avg(l_quantity) FILTER (l_linenumber = 2) AS s2, avg(l_quantity) FILTER (l_linenumber = 3) AS s3,
format('{:.3f} ± {:.3f}', avg(l_quantity), 1.96 * stddev_samp(l_quantity) / sqrt(count(*))) AS shown FROM lineitem GROUP BY 1""")
def seed_results_pivot(lineitem):
    """Values by seed side by side, with mean and interval as text."""
    wide = lineitem.groupBy("l_returnflag").pivot("l_linenumber", [1, 2, 3]).agg(F.avg("l_quantity"))
    shown = F.format_string("%.3f ± %.3f", F.avg("l_quantity"), 1.96 * F.stddev_samp("l_quantity") / F.sqrt(F.count("*")))
    text = lineitem.groupBy("l_returnflag").agg(shown.alias("shown"))
    return wide.join(text, "l_returnflag").select("l_returnflag", *(F.col(str(k)).alias(f"s{k}") for k in (1, 2, 3)), "shown")


@query("lineitem", oracle="""
WITH o AS (SELECT l_orderkey, l_quantity AS q FROM lineitem WHERE l_linenumber = 1), p AS (SELECT l_orderkey, l_quantity AS q, l_returnflag FROM lineitem WHERE l_linenumber <> 1)
SELECT l_returnflag, round(avg(o.q - p.q), 9) AS sensitivity, round(1 - avg(abs(o.q - p.q)) / 50, 9) AS stability, round(avg(CASE WHEN p.q < o.q THEN 1.0 ELSE 0.0 END), 9) AS dropped
FROM o JOIN p USING (l_orderkey) GROUP BY 1""")
def sensitivity_and_stability(lineitem):
    """Perturbed rows against their originals."""
    o = lineitem.where("l_linenumber = 1").select("l_orderkey", F.col("l_quantity").alias("o"))
    p = lineitem.where("l_linenumber <> 1").select("l_orderkey", F.col("l_quantity").alias("p"), "l_returnflag")
    gap = F.col("o") - F.col("p")
    return o.join(p, "l_orderkey").groupBy("l_returnflag").agg(F.round(F.avg(gap), 9).alias("sensitivity"), F.round(1 - F.avg(F.abs(gap)) / 50, 9).alias("stability"), F.round(F.avg(F.when(gap > 0, 1.0).otherwise(0.0)), 9).alias("dropped"))
