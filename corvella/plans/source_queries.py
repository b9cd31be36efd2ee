"""Files written to the shared folder and read back, beside SQL over the tables that they came from."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.session import scratch_path
from corvella.sources import files as S

from .registry import query


@query("orders", oracle="""
SELECT o_orderkey::VARCHAR AS doc_id, o_orderpriority AS title, 'agency=' || o_orderstatus AS agency, 'period=' || year(o_orderdate) AS period FROM orders WHERE year(o_orderdate) IN (1995, 1996)""")
def csv_tree_scan(orders):
    """A tree of CSV files by agency and period, read with one schema, of two years only."""
    path = scratch_path(orders.sparkSession, "csv-tree")
    rows = orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("agency"), F.year("o_orderdate").alias("period"))
    rows.write.partitionBy("agency", "period").option("header", True).csv(path)
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("title", T.StringType())])
    return S.read_csv_tree(orders.sparkSession, path, "part-*", schema, (1995, 1996)).select("doc_id", "title", "agency", "period")


@query("orders", oracle="SELECT o_orderstatus AS agency, count(DISTINCT year(o_orderdate)) AS folders FROM orders GROUP BY 1")
def csv_discovery(orders):
    """The folders that a search of a tree finds files in."""
    path = scratch_path(orders.sparkSession, "csv-found")
    rows = orders.select("o_orderkey", F.col("o_orderstatus").alias("agency"), F.year("o_orderdate").alias("period"))
    rows.write.partitionBy("agency", "period").csv(path)
    found = S.discover_csv(orders.sparkSession, path)
    return found.select(F.regexp_extract("path", "agency=([^/]+)", 1).alias("agency"), F.regexp_extract("path", "period=([^/]+)", 1).alias("period")).groupBy("agency").agg(F.count_distinct("period").alias("folders"))


@query("events", oracle="""
SELECT coalesce(CASE WHEN event_id % 3 > 0 THEN event_type END, 'response') AS kind, user_id::VARCHAR AS doc_id, min(event_id) AS ordinal FROM events GROUP BY 1, 2""")
def manifest_round_trip(events):
    """A manifest of JSON lines, written, read and cut to the first line of each kind and document."""
    path = scratch_path(events.sparkSession, "manifest")
    rows = events.select(F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("kind"), F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").alias("ordinal"))
    S.write_manifest(rows, path)
    first = S.manifest_dedup(S.read_manifest(events.sparkSession, path, rows.schema), "ordinal")
    return first.select(F.coalesce("kind", F.lit("response")).alias("kind"), "doc_id", "ordinal")


@query("benchmark", oracle="SELECT item_id, CASE WHEN item_id % 5 = 0 THEN '[missing text]' ELSE text || chr(10) END AS text FROM benchmark")
def blob_hydrate(benchmark):
    """Texts from their files; those without one get a sentinel."""
    spark = benchmark.sparkSession
    path = scratch_path(spark, "blobs")
    benchmark.where("item_id % 5 > 0").write.partitionBy("item_id").text(path)
    blobs = S.read_blobs(spark, path).where("path like '%.txt'").withColumn("path", F.regexp_extract("path", "item_id=([0-9]+)", 1))
    return S.hydrate(benchmark.select("item_id", F.col("item_id").cast("string").alias("file")), blobs, "file").select("item_id", "text")


@query("lineitem", oracle="SELECT 'l_returnflag=' || l_returnflag AS folder, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def row_router(lineitem):
    """Rows dealt into folders by a derived key."""
    path = scratch_path(lineitem.sparkSession, "routed")
    S.route(lineitem.select("l_returnflag", "l_quantity"), path, ["l_returnflag"])
    back = lineitem.sparkSession.read.option("recursiveFileLookup", True).parquet(path)
    return back.groupBy(F.regexp_extract(F.input_file_name(), "/(l_returnflag=[^/]+)/", 1).alias("folder")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("part", oracle="""
SELECT p_partkey::VARCHAR AS p_partkey, p_name || '; ' || p_brand AS names, CASE WHEN p_size > 25 THEN 'TRUE' ELSE 'FALSE' END AS large, '{"type":"' || p_type || '","size":' || p_size || '}' AS more FROM part""")
def rule_sink_round_trip(part):
    """Lists, booleans and structures as a rule table's cells."""
    path = scratch_path(part.sparkSession, "rules")
    S.rule_sink(part.select("p_partkey", F.array("p_name", "p_brand").alias("names"), (F.col("p_size") > 25).alias("large"), F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("size")).alias("more")), path)
    return part.sparkSession.read.option("header", True).option("escape", '\\').csv(path)


@query("lineitem", oracle="SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def projected_read(lineitem):
    """Two columns of a wide table: the scan reads no others."""
    return lineitem.groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("documents", oracle="SELECT doc_id, source FROM documents WHERE text IS NOT NULL AND source <> '' ORDER BY source, doc_id LIMIT 200")
def ordered_text_scan(documents):
    """The first two hundred documents that have a text, by source and id."""
    return documents.where("text is not null and source <> ''").select("doc_id", "source").orderBy("source", "doc_id").limit(200)
