"""Fits, samples, merges and upserts that reports are made of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvella.operators import training as R
from corvella.operators import usage as U

from .analysis_queries import _USAGE, _usage
from .registry import query

_X = ("l_quantity", "l_discount", "l_tax")


def _rated(lineitem):
    """A target that one of the metrics tells most of."""
    return lineitem.withColumn("target", F.col("l_quantity") * 1000 + F.col("l_extendedprice") / 100)


@query("lineitem", oracle="""
WITH y AS (SELECT l_quantity, l_quantity * 1000 + l_extendedprice / 100 AS y FROM lineitem), c AS (SELECT count(*) AS n, regr_sxx(l_quantity, l_quantity) AS qq, regr_sxy(y, l_quantity) AS qy FROM y)
SELECT 'l_quantity' AS name, round(qy / sqrt(qq * n), 2) AS coefficient FROM c""")
def budget_regression(lineitem):
    """The one metric that tells most, fitted anew on its own scale."""
    return R.budget_fit(_rated(lineitem), _X, "target", 1, digits=2)


@query("lineitem", oracle="""
WITH c AS (SELECT regr_sxy(l_extendedprice, l_quantity) AS a, regr_sxy(l_extendedprice, l_discount) AS b, regr_sxx(l_quantity, l_quantity) AS qq, regr_sxx(l_discount, l_discount) AS dd, regr_sxy(l_discount, l_quantity) AS qd FROM lineitem),
w AS (SELECT *, a / sqrt(a * a + b * b) AS wa, b / sqrt(a * a + b * b) AS wb FROM c), s AS (SELECT *, (a * wa + b * wb) / (wa * wa * qq + 2 * wa * wb * qd + wb * wb * dd) AS q FROM w)
SELECT 'l_quantity' AS name, round(wa * q, 3) AS coefficient FROM s UNION ALL SELECT 'l_discount', round(wb * q, 3) FROM s""")
def partial_least_squares(lineitem):
    return R.partial_least_squares(lineitem, ("l_quantity", "l_discount"), "l_extendedprice", digits=3)


@query("lineitem")
def forest_regression(lineitem):
    """Errors of the library's trees, which have no twin."""
    rows = lineitem.select(*_X, "l_extendedprice")
    error = lambda d, name: d.agg(F.lit(name).alias("model"), F.round(F.sqrt(F.avg((F.col("prediction") - F.col("l_extendedprice")) ** 2)), 3).alias("rmse"))
    return error(R.forest(rows, _X, "l_extendedprice"), "forest").unionByName(error(R.forest(rows, _X, "l_extendedprice", boosted=True), "boosted"))


@query("lineitem", oracle="""
WITH y AS (SELECT *, l_quantity * 1000 + l_extendedprice / 100 AS y FROM lineitem), t AS (SELECT * FROM y WHERE l_orderkey % 5 > 0),
c AS (SELECT unnest([{'m': 'l_quantity', 'r': corr(l_quantity, y)}, {'m': 'l_discount', 'r': corr(l_discount, y)}, {'m': 'l_tax', 'r': corr(l_tax, y)}]) AS s FROM t),
b AS (SELECT s.m AS m FROM c ORDER BY abs(round(s.r, 9)) DESC, m LIMIT 1), f AS (SELECT regr_slope(y, l_quantity) AS k, regr_intercept(y, l_quantity) AS i FROM t)
SELECT (SELECT m FROM b) AS chosen, count(*) AS held_out, round(corr(l_quantity, y), 6) AS correlation, round(avg(abs(y - k * l_quantity - i)), 2) AS error FROM y, f WHERE l_orderkey % 5 = 0""")
def metric_pipeline(lineitem):
    """Metrics are chosen on training rows, fitted there and reported on the held-out ones."""
    rows = _rated(lineitem)
    train, test = rows.where("l_orderkey % 5 > 0"), rows.where("l_orderkey % 5 = 0")
    chosen = R.best_metrics(train, _X, "target", 1)[0]
    fit = {r["name"]: r["coefficient"] for r in R.linear_fit(train, (chosen,), "target", digits=9).collect()}
    miss = F.abs(F.col("target") - fit[chosen] * F.col(chosen) - fit["intercept"])
    return test.agg(F.lit(chosen).alias("chosen"), F.count("*").alias("held_out"), F.round(F.corr(chosen, "target"), 6).alias("correlation"), F.round(F.avg(miss), 2).alias("error"))


@query("orders", oracle="""
SELECT o_custkey AS doc_id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS payload, max(o_orderdate) AS refreshed, count(*) AS writes FROM orders GROUP BY 1""")
def download_record_upsert(orders):
    """The last write of each key wins."""
    order = F.struct("o_orderdate", "o_orderkey")
    return orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.max_by("o_orderpriority", order).alias("payload"), F.max("o_orderdate").alias("refreshed"), F.count("*").alias("writes"))


@query("part", oracle=r"""
WITH f AS (SELECT p_partkey, 'docs/' || (p_partkey % 40) || CASE WHEN p_partkey % 3 = 0 THEN '_' || (p_partkey % 9) ELSE '' END || '.csv' AS path FROM part) SELECT p_partkey, path FROM f WHERE NOT regexp_matches(path, '_\d+\.csv$')""")
def numbered_duplicates(part):
    """Files but their numbered copies."""
    path = F.concat(F.lit("docs/"), (F.col("p_partkey") % 40).cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_"), (F.col("p_partkey") % 9).cast("string"))).otherwise(""), F.lit(".csv"))
    return part.select("p_partkey", path.alias("path")).where(~F.col("path").rlike(r"_\d+\.csv$"))


@query("orders", oracle="""
WITH p AS (SELECT o_orderkey AS id, o_custkey % 60 AS g, (o_totalprice % 1000) / 1000 AS s FROM orders), b AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM p WHERE s BETWEEN 0.1 AND 0.9),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5(CAST(id AS VARCHAR)), id) AS k FROM b WHERE n >= 4) SELECT g, id FROM k WHERE k <= 30 ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 1000""")
def band_sample(orders):
    """Pairs of middling scores, from groups of four or more, thirty of a group and a thousand in all."""
    rows = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 60).alias("g"), ((F.col("o_totalprice") % 1000) / 1000).alias("s")).where("s between 0.1 and 0.9")
    large = rows.groupBy("g").agg(F.count("*").alias("n")).where("n >= 4").select("g")
    h = F.md5(F.col("id").cast("string"))
    k = F.row_number().over(Window.partitionBy("g").orderBy(h, "id"))
    return rows.join(large, "g").withColumn("k", k).where("k <= 30").orderBy(h, "id").limit(1000).select("g", "id")


@query("lineitem", "part", oracle="""
SELECT l_orderkey, l_linenumber, p_name AS rule, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, 'Low') AS priority FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25""")
def recommendation_lookup(lineitem, part):
    """Entries with their rules; entries of missing rules go, a missing priority is low."""
    rules = part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("rule"))
    return lineitem.join(rules, "l_partkey").select("l_orderkey", "l_linenumber", "rule", F.coalesce(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")), F.lit("Low")).alias("priority"))


@query("orders", oracle="""
WITH r AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'public_inspection' ELSE 'published' END AS source, CASE WHEN o_orderkey % 4 > 0 THEN 'D' || (o_custkey % 500) END AS number, 'u' || (o_custkey % 700) AS url, o_orderkey AS ordinal FROM orders),
k AS (SELECT *, coalesce(number, url) AS key FROM r), f AS (SELECT *, first_value(source) OVER (PARTITION BY key ORDER BY ordinal) AS kept, row_number() OVER (PARTITION BY key ORDER BY ordinal) AS n, row_number() OVER (PARTITION BY key ORDER BY source = 'published' DESC, ordinal) AS p FROM k)
SELECT key, source, ordinal FROM f WHERE CASE WHEN kept = 'published' THEN n = 1 ELSE p = 1 END""")
def published_replaces_inspection(orders):
    """One row a document: the first, unless that is a preview and a published one follows."""
    source = F.when(F.col("o_orderkey") % 3 == 0, "public_inspection").otherwise("published")
    key = F.coalesce(F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("D"), (F.col("o_custkey") % 500).cast("string"))), F.concat(F.lit("u"), (F.col("o_custkey") % 700).cast("string")))
    rows = orders.select(key.alias("key"), source.alias("source"), F.col("o_orderkey").alias("ordinal"))
    row = F.struct("ordinal", "source")
    best = rows.groupBy("key").agg(F.min(row).alias("first"), F.min(F.when(F.col("source") == "published", row)).alias("published"))
    return best.select("key", F.when(F.col("first.source") == "published", F.col("first")).otherwise(F.coalesce("published", "first")).alias("r")).select("key", "r.source", "r.ordinal")


@query("lineitem", "orders", oracle="""
SELECT o.o_orderkey, o.o_custkey, sum(l_quantity) AS quantity FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_suppkey % 10 = o.o_custkey % 10 GROUP BY 1, 2""")
def multi_key_merge(lineitem, orders):
    left = orders.select("o_orderkey", "o_custkey", (F.col("o_custkey") % 10).alias("part"))
    right = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 10).alias("part"), "l_quantity")
    return left.join(right, ["o_orderkey", "part"]).groupBy("o_orderkey", "o_custkey").agg(F.sum("l_quantity").alias("quantity"))


@query("events", oracle="""
WITH e AS (SELECT event_id, user_id % 20 AS agency, ts < TIMESTAMP '2024-01-10' AS pre FROM events),
a AS (SELECT event_id, agency, 'pre' AS era FROM e WHERE pre ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 100),
b AS (SELECT event_id, agency, 'post' AS era FROM e WHERE NOT pre QUALIFY row_number() OVER (PARTITION BY agency ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) <= 10) SELECT * FROM a UNION ALL SELECT * FROM b""")
def era_sampling(events):
    """A uniform sample before the cut, ten of each agency after it."""
    rows = events.select("event_id", (F.col("user_id") % 20).alias("agency"), (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).alias("pre"))
    h = F.md5(F.col("event_id").cast("string"))
    pre = rows.where("pre").orderBy(h, "event_id").limit(100).select("event_id", "agency", F.lit("pre").alias("era"))
    post = rows.where("not pre").withColumn("k", F.row_number().over(Window.partitionBy("agency").orderBy(h, "event_id"))).where("k <= 10")
    return pre.unionByName(post.select("event_id", "agency", F.lit("post").alias("era")))


@query("documents", "labels", oracle=_USAGE + """, z AS (SELECT source, CASE WHEN id % 4 < 2 THEN 'H1' ELSE 'H2' END AS half, log_q - log_p AS d FROM lp), g AS (SELECT range / 100.0 AS alpha FROM range(1, 100)),
m AS (SELECT source, half, alpha, round(avg(ln(greatest(1e-300, (1 - alpha) + alpha * exp(greatest(-700, least(700, d)))))), 9) AS ll, count(*) AS n FROM z, g GROUP BY 1, 2, 3)
SELECT source, half, arg_max(alpha, (ll, -alpha))::DOUBLE AS alpha, max(n) AS n FROM m GROUP BY 1, 2 HAVING max(n) >= 50""")
def stratified_mixture(documents, labels):
    """The share of each source and half; strata of fewer than fifty sentences are left out."""
    lp = _usage(documents, labels)[2].withColumn("half", F.when(F.col("id") % 4 < 2, "H1").otherwise("H2"))
    return U.grid_alpha(lp, ("source", "half")).where("n >= 50")


@query("nation", oracle="""
WITH p AS (SELECT a.n_regionkey AS r, sign(a.n_nationkey - b.n_nationkey) * sign(length(a.n_name) - length(b.n_name)) AS s, length(a.n_name) <> length(b.n_name) AS u FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)
SELECT r AS region, round(sum(s) / sqrt(count(*) * count(*) FILTER (u)), 9) AS tau FROM p GROUP BY 1""")
def kendall_by_group(nation):
    """Tau-b within groups of a few rows."""
    a, b = nation.alias("a"), nation.alias("b")
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    gap = F.length("a.n_name") - F.length("b.n_name")
    sums = pairs.groupBy(F.col("a.n_regionkey").alias("region")).agg(F.sum(F.signum(F.col("a.n_nationkey") - F.col("b.n_nationkey")) * F.signum(gap)).alias("s"), F.count("*").alias("x"), F.sum((gap != 0).cast("int")).alias("y"))
    return sums.select("region", F.round(F.col("s") / F.sqrt(F.col("x") * F.col("y")), 9).alias("tau"))


@query("pages", oracle=r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(p|li|h1|h2|h3|td)\b', 1)) AS tag FROM pages) SELECT page_id, lower(tag) AS tag, count(*) AS n FROM l GROUP BY 1, 2""")
def html_element_scrape(pages):
    """How many blocks of each kind a page has."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<(p|li|h1|h2|h3|td)\b"), F.lit(1))
    return pages.select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


@query("events", oracle="""
SELECT event_type AS metric, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS peak, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS half FROM events GROUP BY 1""")
def resource_statistics(events):
    """Mean, upper percentile, peak and interval of each metric's costs."""
    return events.groupBy(F.col("event_type").alias("metric")).agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.max("value"), 6).alias("peak"), F.round(1.96 * F.stddev_samp("value") / F.sqrt(F.count("value")), 6).alias("half"),
    )
