"""Metrics, rewrites, training sets and sweeps on values worked out by hand."""

import math

import duckdb
import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from corvella.functions import metrics as X
from corvella.functions import rewrites as R
from corvella.operators import clusters as K
from corvella.operators import overlap as V
from corvella.operators import training as G
from corvella.operators import usage as U
from corvella.plans import catalog


def test_metrics_by_hand():
    assert X.ter("a b c", "a x c d") == pytest.approx(100 * 2 / 4) and X.ter("", "") == 0
    assert X.nist("a b", "a b") == pytest.approx((1 + 1) / 2 + 0.0) and X.nist("", "a") == 0
    assert X.ibleu("x y z w", "a b c d", "a b c d") == pytest.approx(0.9 * 100 - 0.1 * X.bleu("a b c d", "x y z w"))
    assert X.rouge_lsum("a b. c d.", "c d. a b.") == pytest.approx(1.0) and X.rouge("a b. c d.", "c d. a b.")[2] == pytest.approx(0.5)
    assert X.update_rouge("One old line.\nTwo.", "One old line.\nNew words here.", "Two.\nNew words here.") == pytest.approx(1.0)
    assert X.char_cut("abcdef", "abcxef") == pytest.approx(1 - 6 / 12) and X.char_cut("", "") == 0
    assert X.pseudo_parent("red fox", "the red fox", "the red fox") == pytest.approx(1.0)
    assert X.kendall([1, 2, 3, 4], [1, 3, 2, 4]) == pytest.approx(4 / 6) and math.isnan(X.kendall([1, 1], [1, 2]))
    assert X.diff_html("a b c", "a x c") == "a <del>b</del> <ins>x</ins> c"


def test_self_bleu_reads_all_sentences():
    text = "\n".join([f"w{i} v{i} u{i} t{i}" for i in range(3)] + ["w0 v0 u0 t0"])
    assert X.self_bleu(text) > X.self_bleu(text, 3)


def test_rewrites_by_hand(spark):
    rows = [
        ("<rewritten_comment>The dam would harm the river and us.</rewritten_comment>", None, "The dam would harm the river and us."),
        ("Here is the rewritten comment:\nThe dam would harm the river.\nNote: I kept the tone.", None, "The dam would harm the river."),
        ("false\n\n1\n\nThe dam would harm the river.\n<<COMMENT 2>>\nAnother one", None, "The dam would harm the river."),
        ("The dam would harm the river.\n[Your Name]\nAnytown, CA 12345", None, "The dam would harm the river."),
        ("too short", None, ""),
        (None, None, ""),
        ("One sentence that is long enough. And a second one that goes on and on for long", 15, "One sentence that is long enough."),
        ("A first paragraph here\n\nand a second one", 10, "A first paragraph here"),
    ]
    frame = spark.createDataFrame([(a, b) for a, b, _ in rows], "t string, n int").select(R.clean_rewrite(F.col("t"), F.col("n")).alias("c"))
    assert [r["c"] for r in frame.collect()] == [want for _, _, want in rows]


def test_stratified_split_is_exact(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 10 == 1, None).otherwise("b").alias("label"))
    got = G.stratified_split(rows, "label", "id").groupBy("label", "fold").count().collect()
    assert {(r["label"], r["fold"]): r["count"] for r in got} == {("a", "test"): 10, ("a", "val"): 15, ("a", "train"): 75, (None, "test"): 10, (None, "val"): 15, (None, "train"): 75, ("b", "test"): 80, ("b", "val"): 120, ("b", "train"): 600}


def test_cached_ranks_have_one_order(spark):
    rows = [("q", 7, 9), ("q", 7, 3), ("q", 7, 6), ("q", 2, 4), ("q", 1, 5), ("r", 8, 6), ("r", 8, 2)]
    items = spark.createDataFrame([(i,) for i in (2, 3, 4, 6, 9)], "item long")
    for given in (rows, rows[::-1]):
        cache = spark.createDataFrame(given, "query string, rank long, item long").coalesce(1)
        got = sorted(tuple(r) for r in G.cached_ranks(cache, F.broadcast(items), 3).collect())
        assert got == [("q", 1, 4), ("q", 2, 3), ("q", 3, 6), ("r", 1, 2), ("r", 2, 6)]


def test_paper_cache_without_a_rank_is_its_sql(spark, tmp_path):
    lines = [(1, None, 10), (1, 3, 11), (1, 2, 12), (1, 5, 13), (2, None, 10), (2, 1, 14), (None, 4, 11), (None, None, 12), (3, 1, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(10, 50), (11, 20), (12, 11), (13, 30), (14, 10), (None, 40)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    connection = duckdb.connect()
    for table in ("lineitem", "part"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    same(catalog.QUERIES["paper_cache"](spark, str(tmp_path)), connection.execute(catalog.ORACLE_SQL["paper_cache"]))


def test_hard_negatives_fall_back_to_nearest_lengths(spark):
    rows = [("g", 1, "yes", 100, 0.0), ("g", 2, "no", 10, 0.9), ("g", 3, "no", 12, 0.5), ("g", 4, "no", 400, 0.7), ("h", 5, "yes", 10, 0.0), ("h", 6, "no", 11, 0.2)]
    frame = spark.createDataFrame(rows, "g string, id long, label string, n long, s double")
    got = G.hard_negatives(frame, "g", id_col="id", label="label", length="n", score="s").collect()
    assert [(r["g"], r["id"], r["negatives"]) for r in got] == [("g", 1, [2, 4])]


def test_linear_fit_solves_two_columns(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200), rng.normal(size=200)
    frame = spark.createDataFrame([(float(x), float(y), float(3 + 2 * x - y)) for x, y in zip(a, b, strict=True)], "a double, b double, y double")
    assert {r["name"]: r["coefficient"] for r in G.linear_fit(frame, ("a", "b"), "y").collect()} == pytest.approx({"intercept": 3, "a": 2, "b": -1}, abs=1e-5)


def test_lloyd_finds_blobs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(scale=0.1, size=3) + 5 * (i % 3)]) for i in range(90)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in K.lloyd(vectors, K.first_centres(vectors, 3), 2).collect()}
    assert all(got[i] == i % 3 for i in range(90))
    assert sum(r["n"] for r in K.shares(K.mixture(vectors, 3).select("id", F.col("component").alias("cluster"))).collect()) == 90


def test_binned_bootstrap_is_near_the_exact_fit(spark):
    ratio = np.random.default_rng(3).normal(0, 2, 400)
    got = U.mixture(spark.createDataFrame([("s", 0.0, float(x)) for x in ratio], "k string, log_p double, log_q double"), ("k",), bootstraps=200).first()
    assert got["alpha"] == pytest.approx(U.fit_alpha(ratio), abs=1e-3) and got["ci_lower"] < got["alpha"] < got["ci_upper"] and got["n_sentences"] == 400


def test_map_alpha_is_drawn_to_the_prior(spark):
    rows = [(1, 0.0, 5.0)] * 4 + [(2, 0.0, -5.0)] * 4 + [(3, 0.0, 1.0)]
    got = {r["id"]: r["alpha"] for r in U.map_alpha(spark.createDataFrame(rows, "id long, log_p double, log_q double"), 0.2, 20.0).collect()}
    assert set(got) == {1, 2} and 0.2 < got[1] < 0.9 and got[2] < 0.2


def test_overlaps_equal_the_metrics(spark):
    pairs = [(1, "the cat sat on the mat.", "the cat is on the mat"), (2, "a", "b"), (3, "", "x y"), (4, "one two, three!", "one two, three!"), (5, "w x y z q", "q z y x w"), (6, None, None)]
    frame = spark.createDataFrame(pairs, "id long, x string, y string")
    got = {r["id"]: r for r in V.scores(V.gram_overlaps(frame, "id", "x", "y")).collect()}
    for key, x, y in pairs[:5]:
        want = {"bleu": X.bleu(x, y), "gleu": X.gleu(x, y), "rouge1": X.rouge(x, y)[0], "rouge2": X.rouge(x, y)[1], "chrf": X.chrf(x, y)}
        assert {k: got[key][k] for k in want} == pytest.approx(want), key
    texts = ["The cat sat. It ran!", "", "naïve élan vital"]
    levels = [r["g"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(V.grade(F.col("t")).alias("g")).collect()]
    assert levels == pytest.approx([X.fkgl(t) for t in texts])
