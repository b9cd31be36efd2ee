"""Each stage on what the one before has kept, against brute force; edge cases through all of them."""

import corpus_pipeline
from test_operators import brute_classes, brute_lines, brute_repeats


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, data).cache()
    assert good.columns == docs.columns and 0.6 * docs.count() < good.count() < docs.count()
    lines = stages["lines"](spark, good, data).cache()
    assert dict(brute_lines([(r["doc_id"], r["text"]) for r in good.collect()])) == {r["doc_id"]: r["text"] for r in lines.collect()}
    alone = stages["near_duplicates"](spark, lines, data).cache()
    classes = brute_classes([(r["doc_id"], r["text"]) for r in lines.collect()])
    assert {r["doc_id"] for r in alone.collect()} == {k for k, (root, _) in classes.items() if k == root}
    cut = stages["passages"](spark, alone, data).cache()
    want = brute_repeats([(r["doc_id"], r["text"]) for r in alone.collect()])
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {k: v[3].decode("utf-8", "ignore") for k, v in want.items()}
    assert cut.where("n_chars <> length(text)").count() == 0
    packed = stages["packed"](spark, cut, data)
    assert packed.select("doc_id").distinct().count() == cut.count()


def test_edges(spark, data):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text without id", "en", "s", 1), (4, "a" * 200, "en", "s", 200), (4, "a" * 200, "en", "s", 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, data)
        frame.collect()


def test_clashing_columns_stay(spark, data):
    """Columns named like those of the operators keep their values through every stage that returns documents."""
    rows = [(k, f"line {k} of its own here\nthe same line stands in all of them\n" + f"passage {k // 2} " * 9, "en", "s", 1, -7, -8, -9, "x") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, n_lines int, N_Bytes long, n_dropped long, kept_bytes string")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        got = stage(spark, docs, data)
        assert got.schema == docs.schema, name
        assert {(r["n_lines"], r["N_Bytes"], r["n_dropped"], r["kept_bytes"]) for r in got.collect()} == {(-7, -8, -9, "x")}, name
        assert got.where("n_chars <> length(text)").count() == (0 if name != "near_duplicates" else got.count())
    bare = docs.select("doc_id", "text")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, bare, data).columns == ["doc_id", "text"]
