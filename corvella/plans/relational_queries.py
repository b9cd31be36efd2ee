"""Relational queries: joins, aggregations, windows, orders, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvella.operators import relational as R

from .registry import query



@query("customer", "nation", oracle="""
SELECT c_custkey, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0""")
def inner_equi_join(customer, nation):
    """Inner join on a key; the small side is broadcast by its size."""
    return customer.where("c_acctbal > 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_acctbal")


@query("documents", "labels", oracle="""
SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'single-' || CAST(d.doc_id AS VARCHAR)) AS cluster_uid
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def left_join_singleton_default(documents, labels):
    """Unmapped documents become their own cluster."""
    joined = documents.select("doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.concat(F.lit("single-"), F.col("doc_id").cast("string"))).alias("cluster_uid"))


@query("customer", "orders", oracle="""
SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def left_join_zero_fill(customer, orders):
    """Expected against actual counts, missing ones as zero."""
    counts = orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return customer.select("c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["n_orders"]).select("c_custkey", "n_orders")


@query("orders", "customer", oracle="""
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')""")
def semi_join_prefilter(orders, customer):
    return orders.join(customer.where("c_mktsegment = 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("o_orderkey")


@query("lineitem", "orders", oracle="""
SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS
(SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> l.l_linestatus)""")
def anti_join_composite(lineitem, orders):
    """Rows whose composite key has no disagreeing partner."""
    return lineitem.join(orders, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_orderstatus") != F.col("l_linestatus")), "left_anti").select("l_orderkey", "l_linenumber")


@query("documents", "labels", oracle="SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_by_anti_join(documents, labels):
    """What has no output yet."""
    return documents.join(labels, "doc_id", "left_anti").select("doc_id")


@query("nation", oracle="""
SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key FROM nation a JOIN nation b
ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def self_join_unordered_pairs(nation):
    """Unordered pairs within a blocking key."""
    a, b = nation.alias("a"), nation.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_nationkey").alias("left_key"), F.col("b.n_nationkey").alias("right_key"))


@query("nation", "region", "supplier", oracle="""
SELECT s_suppkey, n_name, r_name, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN r_name IS NULL THEN 'unknown' ELSE 'ok' END AS status
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def coverage_join(nation, region, supplier):
    """Two left joins and a status."""
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    status = F.when(F.col("s_acctbal") < 0, "debt").when(F.col("r_name").isNull(), "unknown").otherwise("ok")
    return joined.select("s_suppkey", "n_name", "r_name", status.alias("status"))


@query("events", oracle="""
WITH per_day AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT a.user_id, CAST(a.day AS VARCHAR) AS day, a.n AS n, b.n AS before_n FROM per_day a JOIN per_day b ON a.user_id = b.user_id AND b.day = a.day - INTERVAL 1 DAY""")
def double_lookup_join(events):
    """One table joined to itself under two names."""
    per_day = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    before = per_day.select("user_id", F.date_add("day", 1).alias("day"), F.col("n").alias("before_n"))
    return per_day.join(before, ["user_id", "day"]).select("user_id", F.col("day").cast("string").alias("day"), "n", "before_n")


@query("documents", "labels", oracle="""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'extra' ELSE 'missing' END AS side
FROM (SELECT doc_id FROM documents WHERE lang = 'en') d FULL JOIN (SELECT doc_id FROM labels) l ON d.doc_id = l.doc_id
WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def matched_corpus_check(documents, labels):
    """Ids that one of two corpora lacks."""
    d = documents.where("lang = 'en'").select("doc_id", F.lit(True).alias("in_d"))
    joined = d.join(labels.select("doc_id", F.lit(True).alias("in_l")), "doc_id", "full")
    return joined.where("in_d is null or in_l is null").select("doc_id", F.when(F.col("in_d").isNull(), "extra").otherwise("missing").alias("side"))


@query("lineitem", oracle="""
SELECT l_returnflag, l_linestatus, CASE WHEN sum(l_quantity) = 0 THEN 0 ELSE sum(l_discount * l_quantity) / sum(l_quantity) END AS mean_discount
FROM lineitem GROUP BY 1, 2""")
def weighted_mean_by_group(lineitem):
    return R.weighted_mean(lineitem, ["l_returnflag", "l_linestatus"], "l_discount", "l_quantity", "mean_discount")


@query("events", oracle="""
SELECT event_type, count(value) AS n, sum(value) AS total, avg(value) AS mean, median(value) AS median, max(value) AS largest,
quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1""")
def era_summary(events):
    """Count, sum, mean, median, maximum and p90 of each group."""
    return R.summary(events, ["event_type"], "value")


@query("documents", oracle="""
SELECT source, count(*) AS n, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS english, min(n_chars) AS shortest, max(n_chars) AS longest
FROM documents GROUP BY source HAVING count(*) > 10""")
def source_summary_having(documents):
    """Conditional sums with a filter on groups."""
    grouped = documents.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.when(F.col("lang") == "en", 1).otherwise(0)).alias("english"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))
    return grouped.where("n > 10")


@query("documents", oracle="""
SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es
FROM documents GROUP BY source""")
def pivot_crosstab(documents):
    """Counts of two columns with explicit pivot values."""
    return R.crosstab(documents, "source", "lang", ["en", "fr", "de", "es"])


@query("orders", oracle="""
SELECT c AS o_custkey, count(DISTINCT y) AS n_years, string_agg(y, ';' ORDER BY y) AS years
FROM (SELECT DISTINCT o_custkey AS c, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders) GROUP BY 1""")
def distinct_join_per_group(orders):
    """Distinct values of each group, counted and joined in order."""
    y = F.year("o_orderdate").cast("string")
    return orders.groupBy("o_custkey").agg(F.count_distinct(y).alias("n_years"), F.array_join(F.array_sort(F.collect_set(y)), ";").alias("years"))


@query("events", oracle="""
SELECT event_id, user_id, event_type, value FROM events e WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 12)""")
def group_filter(events):
    """Rows of groups of a size."""
    sized = events.select("event_id", "user_id", "event_type", "value").withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    return sized.where("n >= 12").drop("n")


@query("events", oracle="""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY 1""")
def top3_label_histogram(events):
    """The three most frequent labels of each group."""
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).where("k <= 3")
    entry = F.struct("k", F.concat_ws(":", "event_type", F.col("n").cast("string")).alias("t"))
    return top.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), ",").alias("top"))


@query("documents", oracle="""
SELECT lang, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.99) AS p99 FROM documents GROUP BY 1""")
def descriptive_percentiles(documents):
    p = F.percentile("n_chars", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return documents.groupBy("lang").agg(p.alias("p")).select("lang", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"))


@query("lineitem", oracle="""
SELECT round(corr(l_quantity, l_extendedprice), 9) AS qp, round(corr(l_quantity, l_discount), 9) AS qd, round(corr(l_extendedprice, l_tax), 9) AS pt FROM lineitem""")
def correlation_matrix(lineitem):
    """Pearson correlations of columns."""
    pairs = (("l_quantity", "l_extendedprice", "qp"), ("l_quantity", "l_discount", "qd"), ("l_extendedprice", "l_tax", "pt"))
    return lineitem.agg(*(F.round(F.corr(a, b), 9).alias(n) for a, b, n in pairs))


@query("events", oracle="""
WITH e AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events)
SELECT CASE WHEN value <= a THEN 1 WHEN value <= b THEN 2 WHEN value <= c THEN 3 ELSE 4 END AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1""")
def quantile_bins(events):
    """Counts between quantile edges, each bin with its right edge."""
    edges = events.agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    v = events.where("value is not null").crossJoin(F.broadcast(edges))  # the edges are one row
    b = F.when(F.col("value") <= F.col("e")[0], 1).when(F.col("value") <= F.col("e")[1], 2).when(F.col("value") <= F.col("e")[2], 3).otherwise(4)
    return v.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query("lineitem", oracle="""
WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, count(*) AS n, max(l_extendedprice) AS largest FROM lineitem l JOIN b USING (l_returnflag)
WHERE l_extendedprice BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1) GROUP BY 1""")
def iqr_outlier_filter(lineitem):
    kept = R.within_iqr(lineitem, ["l_returnflag"], "l_extendedprice", 0.5)
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("largest"))


@query("labels", oracle="""
SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM labels)
WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""")
def class_balance(labels):
    """Each class cut to the smallest one, in the order of a hash."""
    return R.balance(labels.select("doc_id", "quality"), "quality", "doc_id")


@query("lineitem", oracle="""
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def ext_rollup(lineitem):
    """Extension: totals of a hierarchy."""
    return lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query("orders", oracle="""
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def ext_cube(orders):
    """Extension: totals of all combinations."""
    return orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("events")
def ext_approx_distinct(events):
    """Extension: approximate distinct users a type."""
    return events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("documents", oracle="""
SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1""")
def longest_per_group(documents):
    """The longest text of each group, ties to the smaller id."""
    return R.keep_first(documents, ["source"], [F.desc("n_chars"), F.col("doc_id")]).select("source", "doc_id", "n_chars")


@query("conversations", oracle="SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY role) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations")
def dense_rank_and_cumulative_count(conversations):
    """The rank of a role and the running number of a turn."""
    w = Window.partitionBy("conv_id")
    return conversations.select("conv_id", "turn", F.dense_rank().over(w.orderBy("role")).cast("long").alias("r"), (F.row_number().over(w.orderBy("turn")) - 1).cast("long").alias("k"))


@query("orders", oracle="""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 5""")
def top_n_per_group(orders):
    return R.top_n(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "o_totalprice")


@query("events", oracle="""
SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1""")
def first_occurrence_dedup(events):
    """The first row of each key by its ordinal."""
    return R.keep_first(events, ["user_id", "event_type"], [F.col("event_id")]).select("event_id", "user_id", "event_type")


@query("orders", oracle="""
SELECT o_custkey, o_orderkey, row_number() OVER w AS history_rank, first_value(o_orderkey) OVER w AS parent,
CASE WHEN row_number() OVER w = 1 THEN 'seed' ELSE 'follow_up' END AS relationship
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def docket_history(orders):
    """Rank of each version, the first as its parent and what it is to it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("history_rank"), F.first("o_orderkey").over(w).alias("parent"), F.when(F.row_number().over(w) == 1, "seed").otherwise("follow_up").alias("relationship"))


@query("documents", oracle="""
SELECT source, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY source""")
def group_share(documents):
    """Each group's share of all rows; the total is taken over the few groups."""
    counts = documents.groupBy("source").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("source", "n", (F.col("n") / F.col("total")).alias("share"))


@query("orders", oracle="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY (o_orderstatus = 'O') DESC, o_totalprice DESC, o_orderdate, o_orderkey LIMIT 50""")
def multi_key_sort_top(orders):
    """Open first, then score, then date; the limit is taken in each partition first."""
    return orders.orderBy(F.desc(F.col("o_orderstatus") == "O"), F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("part", oracle="""
SELECT p_partkey, p_name, CAST(greatest(1, ceil((SELECT count(*) FROM part) / 20.0)) AS BIGINT) AS total_pages FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40""")
def pagination(part):
    return R.page(part, [F.desc("p_retailprice"), F.col("p_partkey")], 3, 20).select("p_partkey", "p_name", "total_pages")


@query("customer", oracle="SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 25")
def abs_value_sort(customer):
    return customer.orderBy(F.desc_nulls_last(F.abs("c_acctbal")), "c_custkey").limit(25).select("c_custkey", "c_acctbal")


@query("customer", "supplier", oracle="""
SELECT 'customer' AS kind, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, NULL FROM supplier""")
def union_all_missing_columns(customer, supplier):
    a = customer.select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return R.union_all([a, supplier.select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))])


@query("customer", "supplier", oracle="SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def ext_intersect(customer, supplier):
    """Extension: values of both columns."""
    return customer.select(F.col("c_nationkey").alias("k")).intersect(supplier.select("s_nationkey"))


@query("nation", "supplier", oracle="SELECT n_nationkey AS k FROM nation EXCEPT ALL SELECT s_nationkey FROM supplier")
def ext_except_all(nation, supplier):
    """Extension: a bag less another."""
    return nation.select(F.col("n_nationkey").alias("k")).exceptAll(supplier.select("s_nationkey"))


@query("orders", oracle="""
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def document_upsert_latest(orders):
    """The latest record of each key, as an upsert leaves it."""
    return R.keep_first(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("customer", oracle="""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer
UNION ALL SELECT -1, 0.0, 'NEW'""")
def harvest_cache_upsert(customer):
    """An upsert that keeps old metadata where the new is null."""
    old = customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    new = customer.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("c_mktsegment"))
    extra = customer.sparkSession.sql("SELECT CAST(-1 AS BIGINT) AS c_custkey, CAST(0.0 AS DOUBLE) AS c_acctbal, 'NEW' AS c_mktsegment")
    return R.upsert(old, new.unionByName(extra), ["c_custkey"], keep_old_if_null=["c_mktsegment"])


@query("events", oracle="""
SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1 UNION ALL SELECT 'click', 1""")
def append_replace_sink(events):
    """Old groups that were not computed again, and the new ones."""
    old = events.groupBy("event_type").agg(F.count("*").alias("n"))
    new = events.sparkSession.sql("SELECT 'click' AS event_type, CAST(1 AS BIGINT) AS n")
    return R.append_replace(old, new, "event_type")


@query("orders", oracle="""
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13, 21) AND o_totalprice >= 1000""")
def parameterized_in_scan(orders):
    """A scan by parameters; both predicates reach the files."""
    return orders.where(F.col("o_custkey").isin(1, 2, 3, 5, 8, 13, 21) & (F.col("o_totalprice") >= 1000)).select("o_orderkey", "o_orderstatus")


@query("lineitem", oracle="""
SELECT CAST(year(l_shipdate) AS INTEGER) AS y, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1""")
def publication_window(lineitem):
    """A date window pushed into the scan."""
    kept = lineitem.where("l_shipdate >= timestamp_ntz'1995-01-01' and l_shipdate < timestamp_ntz'1997-01-01'")
    return kept.groupBy(F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("events", oracle="""
SELECT a.event_id, (SELECT max(b.value) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts <= a.ts
 AND b.ts = (SELECT max(c.ts) FROM events c WHERE c.user_id = a.user_id AND c.event_type = 'purchase' AND c.ts <= a.ts)) AS last_value
FROM events a WHERE a.event_type = 'click'""")
def ext_as_of_join(events):
    """Extension: each click with its user's last purchase so far."""
    buys = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return R.as_of(clicks, buys, ["user_id"], "ts", ["last_value"]).select("event_id", "last_value")


@query("orders", "part", oracle="""
SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice BETWEEN p_retailprice * 50 AND p_retailprice * 50 + 300""")
def ext_range_join(orders, part):
    """Extension: prices within ranges, by cells."""
    ranges = part.select("p_partkey", (F.col("p_retailprice") * 50).alias("low"), (F.col("p_retailprice") * 50 + 300).alias("high"))
    return R.range_join(orders.select("o_orderkey", "o_totalprice"), ranges, "o_totalprice", "low", "high", 500.0).select("o_orderkey", "p_partkey")


@query("events", oracle="""
SELECT event_type, CAST(hour(ts) AS INTEGER) AS h, dayname(ts) AS weekday, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def hour_weekday_counts(events):
    return events.groupBy("event_type", F.hour("ts").alias("h"), F.date_format(F.col("ts").cast("timestamp"), "EEEE").alias("weekday")).agg(F.count("*").alias("n"))


@query("events", oracle="""
SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, 1.96 * stddev_samp(value) / sqrt(count(value)) AS half_width FROM events GROUP BY 1""")
def mean_with_ci(events):
    """Mean with the half width of its 95 per cent interval."""
    sd = F.stddev_samp("value")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), sd.alias("sd"), (1.96 * sd / F.sqrt(F.count("value"))).alias("half_width"))


@query("nation", "region", "customer", oracle="""
SELECT r_name, n_name, sum(c_acctbal) AS balance, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY GROUPING SETS ((r_name, n_name), (r_name))""")
def hierarchical_totals(nation, region, customer):
    """Totals of topics and of their parents."""
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupingSets([["r_name", "n_name"], ["r_name"]], "r_name", "n_name").agg(F.sum("c_acctbal").alias("balance"), F.count("*").alias("n"))
