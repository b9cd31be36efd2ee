
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.functions import metrics as X
from corvella.functions import text as T
from corvella.operators import dedup as D
from corvella.operators import usage as U


def one(spark, expression, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return frame.select(expression.alias("x")).first()["x"]


def test_preprocess(spark):
    text = "Dear Sir or Madam,\nPlease regu-\nlate. See attached file(s) at https://x.org/a or me@x.org\nSincerely,\nA. Person\nP.S. gone"
    assert one(spark, T.preprocess_comment(F.col("t")), t=text) == "please regulate. at or"


def test_pages(spark):
    got = one(spark, T.pages(F.col("t")), t="<<PAGE 1>>a<<PAGE 4>> b ")
    assert [(p["page"], p["text"]) for p in got] == [(1, "a"), (4, "b")]
    assert [(p["page"], p["text"]) for p in one(spark, T.pages(F.col("t")), t="no marks")] == [(1, "no marks")]


def test_shingles(spark):
    assert one(spark, T.shingles(F.split("t", " "), 5), t="a b c") == ["a b c", "b c", "c"]
    assert one(spark, T.shingles(F.split("t", " "), 2), t="a b a b") == ["a b", "b a"]


@pytest.mark.parametrize("name, short", [("Environmental Protection Agency", "EPA"), ("agency", "AGEN"), ("bureau of land", "BOL"), ("Food and Drug Administration Office EU BX", "FDAOEU")])
def test_acronym(spark, name, short):
    assert one(spark, T.acronym(F.col("a")), a=name) == short


def test_scalars(spark):
    assert one(spark, T.first_year(F.col("a")), a="in 12345 and 2021.") == 2021
    assert one(spark, T.normalize_label(F.col("a")), a=" Yes, it does") == "yes"
    assert one(spark, T.normalize_label(F.col("a")), a="nothing") == ""
    assert one(spark, T.before(F.col("a"), "2022-11-30"), a="2022-11-29T10:00:00Z") is True
    assert one(spark, T.before(F.col("a"), "2022-11-30"), a="not a date") is False
    assert one(spark, T.topics(F.col("a"), F.lit("Rule")), a="air; water - soil; air") == ["air", "water", "soil", "Rule"]
    assert one(spark, T.page_class(F.col("a")), a="short") == "blank"
    assert one(spark, T.page_class(F.col("a")), a="�" * 20 + "abcdefghij") == "gibberish"


def test_metrics():
    same = "the cat sat on the mat today"
    assert X.bleu(same, same) == pytest.approx(100)
    assert X.gleu(same, same) == X.rouge(same, same)[2] == 1
    assert X.chrf(same, same) == pytest.approx(100)
    assert X.bleu("", same) == X.gleu("", same) == X.chrf("", same) == 0
    assert X.levenshtein_ratio("abc", "abd") == pytest.approx(4 / 6)
    assert X.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert X.sari(same, same, same) == pytest.approx(100 / 3)
    assert X.self_bleu("One sentence only.") == 1


def test_fit_alpha_finds_the_share():
    rng = np.random.default_rng(0)
    ratio = np.where(rng.random(4000) < 0.3, 3.0, -3.0)
    assert U.fit_alpha(ratio) == pytest.approx(0.3, abs=0.05)
    assert U.fit_alpha(np.full(50, -2.0)) < 1e-5
    assert U.fit_alpha(np.full(50, 2.0)) > 1 - 1e-5


def test_kappa(spark):
    rng = np.random.default_rng(1)
    mu = rng.uniform(0.1, 0.5, 60)
    rows = [(int(rng.binomial(400, rng.beta(50 * m, 50 * (1 - m)))), 400, float(m)) for m in mu for _ in range(4)]
    kappa = U.best_kappa(spark.createDataFrame(rows, "count long, n long, mu double"), rounds=8)
    assert 15 < kappa < 200


def test_mixture_needs_sentences(spark):
    frame = spark.createDataFrame([("a", 1.0, 0.0)] * 9 + [("b", 1.0, 0.0)] * 10, "g string, log_p double, log_q double")
    got = {r["g"]: r["alpha"] for r in U.mixture(frame, ("g",), bootstraps=5).collect()}
    assert got["a"] is None and got["b"] < 1e-5


def test_dedup_chain_and_gate(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:97] + ["x", "y", "z"])), (3, " ".join(base)), (4, " ".join(f"v{i}" for i in range(100))), (5, " ".join(base[:79]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shingles = D.shingle_table(docs)
    assert {r["id"] for r in shingles.select("id").distinct().collect()} == {1, 2, 3, 4}
    clusters = D.components(D.jaccard_pairs(shingles), shingles.select("id").distinct())
    assert {(r["id"], r["cluster"]) for r in clusters.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    pairs = {(r["a"], r["b"]) for r in D.lsh_pairs(D.minhash(shingles)).collect()}
    assert (1, 3) in pairs


def test_common_shingles(spark):
    rows = [(i, s) for i in range(10) for s in ("all", f"own{i}")]
    kept = D.drop_common(spark.createDataFrame(rows, "id long, shingle string"))
    assert kept.where("shingle = 'all'").count() == 0 and kept.count() == 10


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    nodes = spark.range(42).select("id")
    got = {r["id"]: r["cluster"] for r in D.components(pairs, nodes).collect()}
    assert got == {**{i: 0 for i in range(41)}, 41: 41}
