"""Answers of services, made from tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.sources import responses as S

from .registry import query


def _pages(rows, item, per: int = 25):
    """Bodies of ``per`` items or so."""
    return rows.groupBy((F.col("k") % (F.lit(2000) / per).cast("int")).alias("page")).agg(F.collect_list(item).alias("items"))


@query("orders", oracle="""
SELECT 'C-' || o_orderkey AS doc_id, 'Comment ' || o_orderkey AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'Org ' || o_custkey ELSE 'Person ' || o_custkey END AS submitter, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS submitted_at,
'<p>' || o_orderpriority || '</p>' AS text, 'https://f/' || o_orderkey || '.pdf' || CASE WHEN o_orderkey % 3 = 0 THEN ';https://a/' || o_orderkey || '.pdf' ELSE '' END AS urls FROM orders""")
def connector_regulations_comments(orders):
    """Pages of comments with what they include."""
    key = F.col("o_orderkey").cast("string")
    has = F.col("o_orderkey") % 3 == 0
    attributes = F.struct(
        F.concat(F.lit("<p>"), "o_orderpriority", F.lit("</p>")).alias("comment"), F.concat(F.lit("Person "), F.col("o_custkey").cast("string")).alias("submitterName"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Org "), F.col("o_custkey").cast("string"))).alias("organization"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("postedDate"),
        F.concat(F.lit("Comment "), key).alias("title"), F.array(F.struct(F.lit("pdf").alias("format"), F.concat(F.lit("https://f/"), key, F.lit(".pdf")).alias("fileUrl"))).alias("fileFormats"),
    )
    related = F.struct(F.struct(F.when(has, F.array(F.struct(F.concat(F.lit("A-"), key).alias("id")))).alias("data")).alias("attachments"))
    data = F.struct(F.concat(F.lit("C-"), key).alias("id"), attributes.alias("attributes"), related.alias("relationships"))
    included = F.when(has, F.struct(F.concat(F.lit("A-"), key).alias("id"), F.lit("attachments").alias("type"), F.struct(F.concat(F.lit("https://a/"), key, F.lit(".pdf")).alias("download")).alias("links")))
    pages = orders.withColumn("k", F.col("o_orderkey")).groupBy(F.floor(F.col("k") / 25).alias("page")).agg(F.collect_list(data).alias("data"), F.collect_list(included).alias("included"))
    return S.comments_page(pages.select(F.to_json(F.struct("data", "included")).alias("body")), "body")


@query("part", oracle="""
SELECT 'c-' || p_partkey AS doc_id, p_name AS title, p_brand AS org, '2024-04-01T10:00:00Z' AS submitted_at, 'consultation' AS kind, 'https://www.gov.uk/government/consultations/c-' || p_partkey AS url FROM part""")
def connector_consultation_search(part):
    item = F.struct(F.col("p_name").alias("title"), F.concat(F.lit("/government/consultations/c-"), F.col("p_partkey").cast("string")).alias("link"), F.lit("2024-04-01T10:00:00Z").alias("public_timestamp"), F.lit("consultation").alias("content_store_document_type"), F.array(F.struct(F.col("p_brand").alias("title"))).alias("organisations"))
    pages = _pages(part.withColumn("k", F.col("p_partkey")), item)
    return S.search_page(pages.select(F.to_json(F.struct(F.col("items").alias("results"))).alias("body")), "body")


@query("part", oracle="""
SELECT p_partkey::VARCHAR AS doc_id, p_name AS title, '2025-10-30T16:42:19' AS submitted_at, 'https://rules.utah.gov/' || p_partkey || '/' AS url, CASE WHEN p_partkey % 2 = 0 THEN 'https://rules.utah.gov/wp-content/uploads/b' || p_partkey || '.pdf' END AS file FROM part""")
def connector_bulletin_posts(part):
    key = F.col("p_partkey").cast("string")
    link = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<p>At <a href=\"https://rules.utah.gov/wp-content/uploads/b"), key, F.lit(".pdf\" rel=\"x\">here</a></p>"))).otherwise("<p>soon</p>")
    item = F.struct(F.col("p_partkey").alias("id"), F.lit("2025-10-30T16:42:19").alias("date"), F.concat(F.lit("https://rules.utah.gov/"), key, F.lit("/")).alias("link"), F.struct(F.col("p_name").alias("rendered")).alias("title"), F.struct(link.alias("rendered")).alias("content"))
    return S.posts_page(_pages(part.withColumn("k", F.col("p_partkey")), item).select(F.to_json("items").alias("body")), "body")


@query("orders", oracle="""
SELECT coalesce(CASE WHEN o_orderkey % 4 > 0 THEN 'AO ' || o_orderkey END, 'T' || o_orderkey) AS doc_id, 'T' || o_orderkey AS title, 'FILINGS' AS kind, year(o_orderdate)::INT AS year, 'http://records/' || o_orderkey AS url FROM orders""")
def connector_admin_orders(orders):
    key = F.col("o_orderkey").cast("string")
    item = F.struct(F.lit("FILINGS").alias("document_type"), F.concat(F.lit("T"), key).alias("title"), F.struct(F.concat(F.lit("http://records/"), key).alias("url")).alias("link_to_document"), F.date_format("o_orderdate", "yyyy").alias("year"), F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("AO "), key)).alias("administrative_order_number"))
    return S.filings_page(_pages(orders.withColumn("k", F.col("o_orderkey")), item).select(F.to_json("items").alias("body")), "body")


@query("orders", oracle="""
SELECT 'PR' || o_orderkey AS collection_id, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, 'PR' || o_orderkey) AS title, 'Department ' || (o_custkey % 9) AS org, strftime(o_orderdate, '%Y-%m-%d') AS due,
'https://eregulations.ct.gov/eRegsPortal/Search/RMRView/PR' || o_orderkey AS url FROM orders WHERE o_orderkey % 5 > 0""")
def connector_comment_periods(orders):
    """Open periods, whose dates are milliseconds in a wrapper; those without a number are left out."""
    key = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("PR"), F.col("o_orderkey").cast("string"))).otherwise("")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string")
    item = F.struct(key.alias("TrackingNumber"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("ShortName"), F.concat(F.lit("Department "), (F.col("o_custkey") % 9).cast("string")).alias("AgencyName"), F.concat(F.lit("/Date("), ms, F.lit(")/")).alias("CommentPeriodEndDate"), F.lit("Proposed").alias("Status"))
    return S.periods_page(_pages(orders.withColumn("k", F.col("o_orderkey")), item).select(F.to_json("items").alias("body")), "body")


@query("supplier", oracle="""
SELECT s_nationkey AS issue, 'http://law/wsr/2025/01/' || s_suppkey || '.htm' AS url, s_name AS title FROM supplier WHERE s_suppkey % 2 = 0""")
def connector_register_links(supplier):
    """The links of an issue's page, written as old pages write them."""
    key = F.col("s_suppkey").cast("string")
    kind = F.when(F.col("s_suppkey") % 2 == 0, ".htm").otherwise(".pdf")
    row = F.concat(F.lit("<td><a href = http://law/wsr/2025/01/"), key, kind, F.lit(" class='x'> <b>"), "s_name", F.lit("</b>\n</a></td>"))
    issue = supplier.groupBy(F.col("s_nationkey").alias("issue")).agg(F.array_join(F.collect_list(row), "").alias("t"))
    return S.linked_page(issue.select("issue", F.concat(F.lit("<HTML><table><tr>"), "t", F.lit("</tr></table>")).alias("body")), "body", r"\.htm$", "issue")
