import gzip
import os

from pyspark.sql import functions as F

from corvella.operators import relational as R
from corvella.sources import connectors, files
from corvella.streaming import windows


def test_csv_tree_prefers_gzip(spark, tmp_path):
    head = "Document ID,Agency ID,Docket ID,Document Type,Posted Date,Title,canonical_text\n"
    for agency, plain, packed in (("epa", "old", "new"), ("fda", "only", None)):
        folder = tmp_path / agency / f"{agency}_2021_2022"
        os.makedirs(folder)
        (folder / "rule_all_text.csv").write_text(head + f"1,{agency},D,Rule,2021-01-01,T,{plain}\n")
        if packed:
            with gzip.open(folder / "rule_all_text.csv.gz", "wt") as file:
                file.write(head + f'1,{agency},D,Rule,2021-01-01,T,"{packed}, with\nbreak"\n')
    got = {(r["agency"], r["canonical_text"]) for r in files.read_csv_tree(spark, str(tmp_path), "rule_all_text").collect()}
    assert got == {("epa", "new, with\nbreak"), ("fda", "only")}
    assert files.read_csv_tree(spark, str(tmp_path), "rule_all_text", years=[1999]).count() == 0
    (tmp_path / "epa" / "raw.csv").write_text("x")
    (tmp_path / "epa" / "raw_1.csv").write_text("x")
    assert [r["path"].split("/")[-1] for r in files.discover_csv(spark, str(tmp_path)).collect()] == ["raw.csv"]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"n": 1, "kind": null, "doc_id": "a"}\nbroken\n{"n": 2, "kind": "response", "doc_id": "a"}\n{"n": 3, "kind": "call", "doc_id": "a"}\n')
    schema = files.T.StructType().add("n", "long").add("kind", "string").add("doc_id", "string")
    got = files.manifest_dedup(files.read_manifest(spark, str(tmp_path / "m.jsonl"), schema), "n")
    assert sorted(r["n"] for r in got.collect()) == [1, 3]


def test_blobs_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("text")
    path = f"file:{tmp_path}/in/a.txt"
    docs = spark.createDataFrame([(1, path), (2, "file:/none")], "id long, path string")
    got = {r["id"]: r["text"] for r in files.hydrate(docs, files.read_blobs(spark, str(tmp_path / "in")), "path").collect()}
    assert got == {1: "text", 2: "[missing text]"}
    out = str(tmp_path / "out")
    files.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v long, k string"), out, "k")
    files.replace_partitions(spark.createDataFrame([(9, "b")], "v long, k string"), out, "k")
    assert {(r["v"], r["k"]) for r in spark.read.parquet(out).collect()} == {(1, "a"), (9, "b")}
    rules = spark.range(1).select(F.lit(True).alias("active"), F.array(F.lit("x"), F.lit("y")).alias("topics"), F.create_map(F.lit("k"), F.lit("v")).alias("extra"))
    files.rule_sink(rules, str(tmp_path / "rules"))
    assert tuple(spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "rules")).first()) == ("TRUE", "x; y", '{"k":"v"}')
    files.route(spark.range(4).selectExpr("id", "id % 2 AS k"), str(tmp_path / "routed"), ["k"])


def test_connector(spark):
    kind = connectors.connector("nist_airmf", lambda collection, k: [{"doc_id": f"{collection}-{k}-{j}", "title": "t"} for j in range(2)], lambda collection: 3)
    got = connectors.read(spark, kind, "c1")
    assert got.count() == 6 and got.select("doc_id").distinct().count() == 6


def test_upsert_keeps_old_where_null(spark):
    old = spark.createDataFrame([(1, "a", "m"), (2, "b", "n")], "k long, v string, meta string")
    new = spark.createDataFrame([(2, "c", None), (3, None, "z")], "k long, v string, meta string")
    got = {tuple(r) for r in R.upsert(old, new, ["k"], keep_old_if_null=["meta"]).collect()}
    assert got == {(1, "a", "m"), (2, "c", "n"), (3, None, "z")}


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), events.schema)
    running = windows.tumbling(stream, "ts", watermark=True, late="60 days").writeStream.outputMode("complete").format("memory").queryName("daily").start()
    running.processAllAvailable()
    running.stop()
    key = lambda r: (str(r["start"]), r["event_type"], r["n"], round(r["total"], 6))
    assert sorted(map(key, spark.table("daily").collect())) == sorted(map(key, windows.tumbling(events, "ts").collect()))


def test_stream_upsert_sink(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("event_id", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), events.schema)
    for _ in range(2):
        running = windows.upsert_sink(stream, str(tmp_path / "out"), "event_type", str(tmp_path / "cp")).start()
        running.processAllAvailable()
        running.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_sqlite_scan(spark, tmp_path):
    import sqlite3

    from corvella.sources.files import read_sqlite

    path = str(tmp_path / "d.sqlite")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE documents (doc_id INTEGER, source TEXT, text_path TEXT)")
        c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, "ab"[i % 2], f"p{i}" if i % 3 else None) for i in range(50)])
    sql = "SELECT doc_id, source, text_path FROM documents WHERE text_path IS NOT NULL AND source = ? ORDER BY doc_id"
    for parts in (1, 3):
        got = read_sqlite(spark, path, sql, "doc_id long, source string, text_path string", ["b"], parts, "doc_id").orderBy("doc_id").collect()
        assert [(r["doc_id"], r["source"], r["text_path"]) for r in got] == [(i, "b", f"p{i}") for i in range(50) if i % 3 and i % 2]
