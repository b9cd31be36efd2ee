"""What services answer, as rows: a column of bodies goes in, documents come out, one parser a kind of service.

Bodies that cannot be read give no rows. A page is one row, so a crawl is parsed where its pages lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that services answer with.
COMMENTS = (
    "data array<struct<id: string, attributes: struct<comment: string, submitterName: string, organization: string, postedDate: string, title: string, fileFormats: array<struct<format: string, fileUrl: string>>>,"
    " relationships: struct<attachments: struct<data: array<struct<id: string>>>>>>, included array<struct<id: string, type: string, links: struct<download: string>>>"
)
SEARCH = "results array<struct<title: string, link: string, public_timestamp: string, content_store_document_type: string, organisations: array<struct<title: string>>>>"
POSTS = "array<struct<id: long, date: string, link: string, title: struct<rendered: string>, content: struct<rendered: string>>>"
FILINGS = "array<struct<document_type: string, title: string, link_to_document: struct<url: string>, year: string, administrative_order_number: string>>"
PERIODS = "array<struct<TrackingNumber: string, ShortName: string, AgencyName: string, CommentPeriodEndDate: string, Status: string>>"
POST_FILE = r"""https://[^"'\s<>]+/wp-content/uploads/[^"'\s<>]+\.pdf"""
ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)["']?[^>]*>(.*?)</a>"""


def milliseconds_date(text: Column) -> Column:
    """The day of ``/Date(1765083600000)/`` in UTC."""
    ms = F.regexp_extract(text, r"/Date\((-?[0-9]+)", 1).try_cast("long")
    return F.date_format(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), "yyyy-MM-dd")


def comments_page(bodies: DataFrame, body: str) -> DataFrame:
    """(doc_id, title, submitter, submitted_at, text, urls) of pages of comments; the files of a comment are its own formats and
    its attachments, which stand beside the comments in a list of what is included."""
    page = bodies.select(F.from_json(body, COMMENTS).alias("p"))
    rows = page.select(F.explode("p.data").alias("d"), F.col("p.included").alias("inc"))
    wanted = F.transform(F.coalesce("d.relationships.attachments.data", F.array()), lambda x: x["id"])
    attached = F.transform(F.filter(F.coalesce("inc", F.array()), lambda x: F.array_contains(wanted, x["id"])), lambda x: x["links"]["download"])
    own = F.transform(F.coalesce("d.attributes.fileFormats", F.array()), lambda x: x["fileUrl"])
    a = "d.attributes."
    who = F.coalesce(f"{a}organization", f"{a}submitterName")
    return rows.select(F.col("d.id").alias("doc_id"), F.col(f"{a}title").alias("title"), who.alias("submitter"), F.col(f"{a}postedDate").alias("submitted_at"), F.col(f"{a}comment").alias("text"), F.array_join(F.concat(own, attached), ";").alias("urls"))


def search_page(bodies: DataFrame, body: str, base: str = "https://www.gov.uk") -> DataFrame:
    """(doc_id, title, org, submitted_at, kind, url) of a search; the id is the last part of the link."""
    rows = bodies.select(F.explode(F.from_json(body, SEARCH)["results"]).alias("r"))
    return rows.select(F.substring_index("r.link", "/", -1).alias("doc_id"), "r.title", F.get("r.organisations", F.lit(0))["title"].alias("org"), F.col("r.public_timestamp").alias("submitted_at"), F.col("r.content_store_document_type").alias("kind"), F.concat(F.lit(base), "r.link").alias("url"))


def posts_page(bodies: DataFrame, body: str) -> DataFrame:
    """(doc_id, title, submitted_at, url, file) of posts; the file is the first one that a post links to."""
    rows = bodies.select(F.explode(F.from_json(body, POSTS)).alias("p"))
    file = F.nullif(F.regexp_extract("p.content.rendered", POST_FILE, 0), F.lit(""))
    return rows.select(F.col("p.id").cast("string").alias("doc_id"), F.col("p.title.rendered").alias("title"), F.col("p.date").alias("submitted_at"), F.col("p.link").alias("url"), file.alias("file"))


def filings_page(bodies: DataFrame, body: str) -> DataFrame:
    """(doc_id, title, kind, year, url) of filings; the id is the order's number, else its title."""
    rows = bodies.select(F.explode(F.from_json(body, FILINGS)).alias("f"))
    return rows.select(F.coalesce("f.administrative_order_number", "f.title").alias("doc_id"), "f.title", F.col("f.document_type").alias("kind"), F.col("f.year").try_cast("int").alias("year"), F.col("f.link_to_document.url").alias("url"))


def periods_page(bodies: DataFrame, body: str, base: str = "https://eregulations.ct.gov/eRegsPortal/Search/RMRView/") -> DataFrame:
    """(collection_id, title, org, due, url) of open comment periods; one without a number is no collection."""
    rows = bodies.select(F.explode(F.from_json(body, PERIODS)).alias("p")).where("p.TrackingNumber <> ''")
    key = F.col("p.TrackingNumber")
    return rows.select(key.alias("collection_id"), F.coalesce("p.ShortName", key).alias("title"), F.col("p.AgencyName").alias("org"), milliseconds_date(F.col("p.CommentPeriodEndDate")).alias("due"), F.concat(F.lit(base), key).alias("url"))


def linked_page(bodies: DataFrame, body: str, like: str, *keep: str) -> DataFrame:
    """(keep, url, title) of the links of a listing whose target matches ``like``, each target once a page, in no order."""
    urls, titles = (F.regexp_extract_all(body, F.lit(ANCHOR), F.lit(k)) for k in (1, 2))
    found = bodies.select(*keep, F.explode(F.arrays_zip(urls.alias("url"), titles.alias("title"))).alias("a")).select(*keep, "a.url", F.trim(F.regexp_replace(F.regexp_replace("a.title", "<[^>]*>", " "), r"\s+", " ")).alias("title"))
    return found.where(F.col("url").rlike(like)).groupBy(*keep, "url").agg(F.min("title").alias("title"))
