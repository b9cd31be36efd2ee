"""Queries that once left rows out, against the other engine's query with that cut taken out of it here.

The registered SQL of some of them still has the cut; it is lifted in this file only.
"""

import duckdb
import numpy as np
import pytest
from compare import same

from corvella.operators import dedup as D
from corvella.operators import usage as U
from corvella.plans import catalog

#: Texts of all lengths: copies of one, three, seven and no words, a null, and near copies of 30 words.
WORDS = [f"w{i}" for i in range(30)]
TEXTS = ["yes", "yes", "no", "I object strongly", "I  object strongly", "object strongly", "one two three four five six seven", "one two three four five six seven", "", " ", None, " ".join(WORDS), " ".join(WORDS + ["x"]), " ".join(WORDS[:12])]


def lifted(name, *cuts):
    sql = catalog.ORACLE_SQL[name]
    for cut, whole in cuts:
        assert cut in sql or whole in sql
        sql = sql.replace(cut, whole)
    return sql


ALL_TEXTS = (
    ("list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))", "list_distinct(CASE WHEN len(w) < 5 THEN list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:], ' ')) ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)"),
    ("WHERE len(w) >= 20)", "WHERE len(w) >= 1)"),
    ("AS r FROM n UNION", "AS r FROM documents UNION"),
)


@pytest.fixture(scope="module")
def short(spark, tmp_path_factory):
    """A folder and a connection with documents of all lengths."""
    folder = tmp_path_factory.mktemp("short")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return str(folder), connection


def test_short_texts_have_clusters(spark, short):
    got = {r["id"]: r["cluster"] for r in catalog.QUERIES["near_duplicate_clusters"](spark, short[0]).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 11, 12: 11, 13: 13}
    assert catalog.QUERIES["dedup_cluster_summary"](spark, short[0]).first()["documents"] == len(TEXTS)


@pytest.mark.parametrize("name", ["near_duplicate_pairs", "near_duplicate_clusters", "cluster_representatives", "dedup_cluster_summary", "cluster_member_samples"])
def test_near_duplicates_of_all_texts(spark, short, name):
    same(catalog.QUERIES[name](spark, short[0]), short[1].execute(lifted(name, *ALL_TEXTS)))


def test_tf_idf_of_production_features(spark, duck, data):
    got = catalog.QUERIES["tf_idf_weights"](spark, data)
    same(got, duck.execute(lifted("tf_idf_weights", ("LIMIT 200", "LIMIT 4096"))))
    assert got.select("term").distinct().count() == 4096


def test_recall_of_banded_pairs(spark):
    rows = []
    for i in range(100):
        # 104 words, 100 shingles; the other text is shorter and ends with a word of its own: 83 to 85 of 101 are common
        base = [f"a{i}x{j}" for j in range(104)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[: 104 - 15 - i % 3] + ["changed"]))]
    shingles = D.shingle_table(spark.createDataFrame(rows, "doc_id long, text string"), min_tokens=1, clean=False)
    true = {(r["a"], r["b"]) for r in D.jaccard_pairs(shingles).where("jaccard < 0.86").collect()}
    assert len(true) == 100
    signatures = D.minhash(shingles)
    found = {(r["a"], r["b"]) for r in D.lsh_pairs(signatures).collect()}
    assert len(true & found) / len(true) >= 0.9
    reference = {(r["a"], r["b"]) for r in D.lsh_pairs(signatures, D.REFERENCE_BANDS, D.REFERENCE_ROWS).collect()}
    assert len(true & reference) / len(true) < 0.9


def test_shrinkage_covers_the_vocabulary(spark, duck, data):
    counts = spark.createDataFrame([("a", "x", 3, 10), ("a", "y", 1, 10), ("b", "y", 2, 4)], "source string, word string, count long, n long")
    pool = spark.createDataFrame([("x", 0.2), ("y", 0.1), ("z", 0.3)], "word string, mu double")
    got = {(r["source"], r["word"]): r["p"] for r in U.shrink(counts, pool, 10.0, "source").collect()}
    assert got == pytest.approx({("a", "x"): 5 / 20, ("a", "y"): 2 / 20, ("a", "z"): 3 / 20, ("b", "x"): 2 / 14, ("b", "y"): 3 / 14, ("b", "z"): 3 / 14})
    whole = ("(700 * mu + c) / (700 + a.n), 1e-10), 9) AS p FROM cw JOIN pool USING (word) JOIN a USING (source)", "(700 * mu + coalesce(c, 0)) / (700 + a.n), 1e-10), 9) AS p FROM a CROSS JOIN pool LEFT JOIN cw USING (source, word)")
    same(catalog.QUERIES["empirical_bayes_shrinkage"](spark, data), duck.execute(lifted("empirical_bayes_shrinkage", whole)))


def test_bootstrap_draws_as_often_as_the_reference(spark, data, monkeypatch):
    ratio = np.random.default_rng(3).normal(0, 2, 40)
    weights = np.random.default_rng(4).multinomial(40, np.full(40, 1 / 40))
    assert U.fit_alpha(ratio, weights=weights) == pytest.approx(U.fit_alpha(np.repeat(ratio, weights)), abs=1e-9)
    frame = spark.createDataFrame([("s", 0.0, float(x)) for x in ratio], "source string, log_p double, log_q double")
    got, thousand = (U.mixture(frame, ("source",), **kind).first() for kind in ({}, {"bootstraps": 1000}))
    assert got == thousand
    drawn = []
    monkeypatch.setattr(U, "mixture", lambda log_probs, keys, bootstraps=U.BOOTSTRAPS, seed=42: drawn.append(bootstraps))
    catalog.QUERIES["mixture_fraction_bootstrap"](spark, data)
    assert drawn == [1000]


def test_rare_words_and_shingles_are_counted(spark, short, duck, data):
    same(catalog.QUERIES["word_presence_by_source"](spark, data), duck.execute(lifted("word_presence_by_source", (" HAVING count(*) >= 20", ""))))
    same(catalog.QUERIES["shingle_document_frequency"](spark, short[0]), short[1].execute(lifted("shingle_document_frequency", (" HAVING count(*) >= 3", ""), *ALL_TEXTS)))
