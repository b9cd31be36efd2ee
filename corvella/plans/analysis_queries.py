"""Retrieval, matching, AI-usage, metric and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.functions import metrics as X
from corvella.functions import text as T
from corvella.operators import evaluation as E
from corvella.operators import matching as M
from corvella.operators import usage as U

from .registry import query

_W = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


@query("documents", "benchmark", oracle=f"""
WITH d AS (SELECT doc_id AS id, unnest({_W}) AS term FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM d GROUP BY 1, 2),
dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY 1), a AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, unnest(list_distinct({_W})) AS term FROM benchmark),
s AS (SELECT q.item_id AS query_id, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.id = tf.id, a GROUP BY 1, 2)
SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""")
def bm25_top_k(documents, benchmark):
    """The best documents for each benchmark passage."""
    return M.bm25(documents, benchmark, doc_id="doc_id", query_id="item_id").select("query_id", "id", F.round("score", 6).alias("score"))


@query("embeddings", oracle="""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score
FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""")
def cosine_top_k(embeddings):
    """The ten most alike vectors of a stated query set."""
    return M.cosine_top_k(embeddings, embeddings.where("vec_id % 50 = 0"), 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query("embeddings", oracle="""
WITH s AS (SELECT q.label, q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score
FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT label, query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3""")
def dense_top_k_within_key(embeddings):
    """Retrieval restricted to a key."""
    q = embeddings.where("vec_id % 50 = 0").select("label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    c = embeddings.select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("cv"))
    scored = M.within_key_top_k(q, c, "label", F.round(T.cosine(F.col("qv"), F.col("cv")), 9), 3)
    return scored.select("label", "query_id", "id", F.round("score", 6).alias("score"))


@query("embeddings", oracle="""
WITH d AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM d GROUP BY 1, 2)
SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 9) AS distance FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""")
def centroid_distances(embeddings):
    """Distances of the labels' mean vectors; their number is that of labels, not rows."""
    c = embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    a, b = c.alias("a"), c.alias("b")
    gap = F.col("a.m") - F.col("b.m")
    return a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.label") < F.col("b.label"))).groupBy(F.col("a.label").alias("a"), F.col("b.label").alias("b")).agg(F.round(F.sqrt(F.sum(gap * gap)), 9).alias("distance"))


@query("embeddings", oracle="""
WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM d GROUP BY 1, 2),
s AS (SELECT d.label, d.vec_id, round(sqrt(sum((x - m) * (x - m))), 9) AS distance FROM d JOIN c USING (label, i) GROUP BY 1, 2)
SELECT label, vec_id, distance FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) = 1""")
def nearest_to_centroid(embeddings):
    """The vector closest to the mean of its label."""
    d = embeddings.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    c = d.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    s = d.join(c, ["label", "i"]).groupBy("label", "vec_id").agg(F.round(F.sqrt(F.sum((F.col("x").cast("double") - F.col("m")) * (F.col("x").cast("double") - F.col("m")))), 9).alias("distance"))
    return s.groupBy("label").agg(F.min_by(F.struct("vec_id", "distance"), F.struct("distance", "vec_id")).alias("s")).select("label", "s.vec_id", "s.distance")


_SCORED = "SELECT doc_id, quality, round(1.0 / (1 + abs(hash_n - 500) / 500.0), 9) AS score FROM (SELECT doc_id, quality, (doc_id * 37) % 1000 AS hash_n FROM labels)"


def _scored(labels):
    n = (F.col("doc_id") * 37) % 1000
    return labels.select("doc_id", "quality", F.round(1.0 / (1 + F.abs(n - 500) / 500.0), 9).alias("score"))


@query("labels", oracle=f"""
WITH s AS ({_SCORED}), g AS (SELECT range / 100.0 AS threshold FROM range(101)),
t AS (SELECT threshold, count(*) FILTER (score >= threshold AND quality = 1) AS tp, count(*) FILTER (score >= threshold AND quality <> 1) AS fp, count(*) FILTER (score < threshold AND quality = 1) AS fn FROM s, g GROUP BY 1)
SELECT threshold::DOUBLE AS threshold, tp, fp, fn, round(2 * tp / greatest(2 * tp + fp + fn, 1), 9) AS f1 FROM t""")
def threshold_search(labels):
    """F1 on a grid of thresholds."""
    return M.threshold_grid(_scored(labels), "score", "quality")


@query("labels", oracle=f"""
WITH s AS ({_SCORED}), b AS (SELECT *, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin FROM s)
SELECT bin, doc_id FROM b QUALIFY row_number() OVER (PARTITION BY bin ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 5""")
def stratified_pair_sample(labels):
    """Five rows of each bin of scores."""
    return M.binned_sample(_scored(labels), "score", 50, order="doc_id").select("bin", "doc_id")


_PAIRS = "SELECT o_custkey % 50 AS response_key, o_orderkey AS id, o_totalprice AS score, CASE WHEN o_totalprice >= 150000 THEN 'yes' ELSE 'no' END AS final_label FROM orders"


def _pairs(orders):
    return orders.select((F.col("o_custkey") % 50).alias("response_key"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.when(F.col("o_totalprice") >= 150000, "yes").otherwise("no").alias("final_label"))


@query("orders", oracle=f"""
SELECT response_key, string_agg(DISTINCT CAST(id AS VARCHAR), ';' ORDER BY CAST(id AS VARCHAR)) AS matched_ids, count(DISTINCT id) AS match_count FROM ({_PAIRS}) WHERE final_label = 'yes' GROUP BY 1""")
def response_matches(orders):
    return M.response_matches(_pairs(orders))


@query("orders", oracle=f"""
SELECT id, CASE WHEN bool_or(final_label = 'yes') THEN 'yes' ELSE 'no' END AS matched,
coalesce(string_agg(DISTINCT CASE WHEN final_label = 'yes' THEN CAST(response_key AS VARCHAR) END, ';' ORDER BY CASE WHEN final_label = 'yes' THEN CAST(response_key AS VARCHAR) END), '') AS matched_keys,
count(*) FILTER (final_label = 'yes') AS n_yes, max(score) AS best_score FROM ({_PAIRS}) GROUP BY 1""")
def comment_labels(orders):
    return M.comment_labels(_pairs(orders))


@query("documents", oracle=f"""
WITH tf AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_W}) AS term FROM documents) GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1 ORDER BY cf DESC, term LIMIT 4096),
r AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n)
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 9) AS weight FROM r""")
def tf_idf_weights(documents):
    """Smooth, unit-length weights of the 4,096 most frequent terms, as many as the reference has."""
    return M.tf_idf(documents, "doc_id", "text").select("id", "term", F.round("weight", 9).alias("weight"))


@query("benchmark")
def hashing_embedding(benchmark):
    """Unit-length counts in hash buckets; the hash has no twin in the other engine."""
    return M.hashing_embedding(benchmark, "item_id", "text", 256)


@query("part", oracle="""
SELECT p_partkey, CAST((CASE WHEN contains(lower(p_name), 'blue') THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(p_type), 'blue') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(p_brand), 'blue') THEN 1 ELSE 0 END)
+ (CASE WHEN contains(lower(p_name), 'brand') THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(p_type), 'brand') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(p_brand), 'brand') THEN 1 ELSE 0 END) AS INTEGER) AS score FROM part""")
def search_relevance(part):
    """Token hits over weighted fields."""
    return part.select("p_partkey", M.relevance("Blue Brand", [F.col("p_name"), F.col("p_type")], F.col("p_name"), F.col("p_brand")).alias("score"))


@query("labels", oracle=f"SELECT doc_id, CASE WHEN quality = 1 AND score >= 0.55 THEN 'High' WHEN score >= 0.4 THEN 'Medium' ELSE 'Low' END AS priority FROM ({_SCORED})")
def priority_label(labels):
    return _scored(labels).select("doc_id", M.priority(F.col("score"), F.col("quality") == 1).alias("priority"))


@query("events", oracle="""
WITH h AS (SELECT DISTINCT user_id, event_type FROM events), n AS (SELECT count(DISTINCT user_id) AS n FROM h), z AS (SELECT event_type, count(*) AS k FROM h GROUP BY 1)
SELECT x.event_type AS a, y.event_type AS b, count(*) AS weight, round(count(*) * any_value(n) / (any_value(za.k) * any_value(zb.k)), 9) AS lift
FROM h x JOIN h y ON x.user_id = y.user_id AND x.event_type < y.event_type JOIN z za ON za.event_type = x.event_type JOIN z zb ON zb.event_type = y.event_type, n GROUP BY 1, 2""")
def cooccurrence_lift(events):
    return M.cooccurrence(events, "user_id", "event_type")


_TRIMMED = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: length(s) > 0)"
_KEPT = rf"list_filter(list_transform({_TRIMMED}, lambda s: list_filter(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+'), lambda w: NOT regexp_full_match(w, '[0-9]+'))), lambda ws: len(ws) >= 11)"
_USAGE = f"""
WITH k AS (SELECT doc_id AS id, source, quality, {_KEPT} AS s FROM documents LEFT JOIN labels USING (doc_id)),
sent AS (SELECT id, source, quality, unnest(range(len(s))) AS sent, unnest(s) AS words FROM k),
w AS (SELECT id, source, quality, sent, unnest(list_distinct(words)) AS word FROM sent),
n AS (SELECT count(*) FILTER (quality = 1) AS nh, count(*) FILTER (quality = 0) AS na FROM sent),
c AS (SELECT word, count(*) FILTER (quality = 1) AS human_count, count(*) FILTER (quality = 0) AS ai_count FROM w GROUP BY 1),
dist AS (SELECT word, human_count, ai_count, ln(human_count / nh) AS log_p, ln(ai_count / na) AS log_q, ln(1 - human_count / nh) AS m_p, ln(1 - ai_count / na) AS m_q
 FROM c, n WHERE human_count >= 5 AND ai_count >= 3 AND human_count < nh AND ai_count < na),
base AS (SELECT sum(m_p) AS bp, sum(m_q) AS bq FROM dist),
lp AS (SELECT source, id, sent, any_value(bp) + sum(log_p - m_p) AS log_p, any_value(bq) + sum(log_q - m_q) AS log_q FROM w JOIN dist USING (word), base GROUP BY 1, 2, 3)
"""


def _usage(documents, labels):
    """Human (1) and other (0) sentences, their distribution and the log probabilities of all sentences."""
    joined = documents.join(labels.select("doc_id", "quality"), "doc_id", "left")
    sent = U.sentence_table(joined, keep=("source", "quality"))
    dist = U.labelled_distribution(sent, F.col("quality") == 1, F.col("quality") == 0)
    return sent, dist, U.sentence_log_probs(sent, dist, ("source",))


@query("documents", "labels", oracle=_USAGE + "SELECT source, word, count(*) AS count FROM w GROUP BY 1, 2")
def word_presence_by_source(documents, labels):
    """In how many sentences of each source a word stands."""
    return U.presence_counts(_usage(documents, labels)[0], ("source",))


@query("documents", "labels", oracle=_USAGE + "SELECT word, human_count, ai_count, round(log_p, 9) AS log_p, round(log_q, 9) AS log_q, round(log_p - m_p - log_q + m_q, 7) AS lor FROM dist")
def word_distribution(documents, labels):
    dist = _usage(documents, labels)[1]
    return dist.select("word", "human_count", "ai_count", F.round("log_p", 9).alias("log_p"), F.round("log_q", 9).alias("log_q"), F.round("log_odds_ratio", 7).alias("lor"))


@query("documents", "labels", oracle=_USAGE + """SELECT word FROM dist WHERE human_count >= 8 AND ai_count >= 4 AND length(word) >= 2 AND abs(round(log_p - m_p - log_q + m_q, 7)) >= 0.15 ORDER BY ai_count DESC, word LIMIT 100""")
def vocabulary_postfilter(documents, labels):
    """The vocabulary by counts, length and log-odds."""
    dist = _usage(documents, labels)[1].withColumn("log_odds_ratio", F.round("log_odds_ratio", 7))
    return U.postprocess(dist, 8, 4, 2, 0.15, 100).select("word")


@query("documents", "labels", oracle=_USAGE + "SELECT id, sent, round(log_p, 6) AS log_p, round(log_q, 6) AS log_q FROM lp")
def sentence_log_probabilities(documents, labels):
    lp = _usage(documents, labels)[2]
    return lp.select("id", F.col("sent").cast("long").alias("sent"), F.round("log_p", 6).alias("log_p"), F.round("log_q", 6).alias("log_q"))


@query("documents", "labels", oracle=_USAGE + "SELECT id, count(*) AS n_sentences, round(avg(1 / (1 + exp(-(ln(0.2) - ln(0.8) + log_q - log_p)))), 6) AS score FROM lp GROUP BY 1")
def document_scores(documents, labels):
    """The mean posterior of a document's sentences at a fixed share."""
    p = U.posterior(F.col("log_p"), F.col("log_q"), F.lit(0.2))
    return _usage(documents, labels)[2].groupBy("id").agg(F.count("*").alias("n_sentences"), F.round(F.avg(p), 6).alias("score"))


@query("documents", "labels", oracle=_USAGE + """, g AS (SELECT range / 100.0 AS alpha FROM range(1, 100)),
m AS (SELECT source, alpha, round(avg(ln(greatest(1e-300, (1 - alpha) + alpha * exp(greatest(-700, least(700, log_q - log_p)))))), 9) AS ll, count(*) AS n FROM lp, g GROUP BY 1, 2)
SELECT source, arg_max(alpha, (ll, -alpha))::DOUBLE AS alpha, max(n) AS n FROM m GROUP BY 1""")
def grid_mixture_fraction(documents, labels):
    """The share of each source on a grid."""
    return U.grid_alpha(_usage(documents, labels)[2], ("source",))


@query("documents", "labels")
def mixture_fraction_bootstrap(documents, labels):
    """The fitted share of each source with an interval of 1,000 bootstrap resamples."""
    return U.mixture(_usage(documents, labels)[2], ("source",))


@query("documents", "labels", oracle=_USAGE + """, pool AS (SELECT word, human_count / nh AS mu FROM dist, n), a AS (SELECT source, count(*) AS n FROM sent GROUP BY 1),
cw AS (SELECT source, word, count(*) AS c FROM w GROUP BY 1, 2)
SELECT source, word, round(greatest((700 * mu + coalesce(c, 0)) / (700 + a.n), 1e-10), 9) AS p FROM a CROSS JOIN pool LEFT JOIN cw USING (source, word)""")
def empirical_bayes_shrinkage(documents, labels):
    """Rates of the whole vocabulary in each source, drawn to the pool."""
    sent, dist, _ = _usage(documents, labels)
    pool = dist.select("word", F.exp("log_p").alias("mu"))
    counts = U.presence_counts(sent, ("source",)).join(sent.groupBy("source").agg(F.count("*").alias("n")), "source")
    return U.shrink(counts, pool, 700.0, "source").select("source", "word", F.round("p", 9).alias("p"))


_TWO = r"SELECT a.item_id, trim(regexp_replace(a.text, '[^\x20-\x7e]', '', 'g')) AS x, trim(regexp_replace(b.text, '[^\x20-\x7e]', '', 'g')) AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"


def _two(benchmark):
    """Neighbouring passages; without other than ASCII, which the other engine measures in bytes."""
    plain = F.trim(F.regexp_replace("text", r"[^\x20-\x7e]", ""))
    b = benchmark.select((F.col("item_id") - 1).alias("item_id"), plain.alias("y"))
    return benchmark.select("item_id", plain.alias("x")).join(b, "item_id")


@query("benchmark", oracle=f"""
SELECT item_id, levenshtein(x, y) AS lev, 1 - len(list_intersect(list_distinct(string_split_regex(x, '\\s+')), list_distinct(string_split_regex(y, '\\s+')))) /
len(list_distinct(list_concat(string_split_regex(x, '\\s+'), string_split_regex(y, '\\s+')))) AS jac FROM ({_TWO})""")
def string_distances(benchmark):
    """Levenshtein and token Jaccard distances of neighbours."""
    return _two(benchmark).select("item_id", F.levenshtein("x", "y").cast("long").alias("lev"), X.jaccard_distance(F.col("x"), F.col("y")).alias("jac"))


@query("benchmark", oracle=f"""
SELECT item_id, hamming(rpad(x, n, chr(1)), rpad(y, n, chr(1))) AS d FROM (SELECT *, CAST(greatest(length(x), length(y)) AS INTEGER) AS n FROM ({_TWO}))""")
def hamming_distance(benchmark):
    """Differing places, the shorter text padded."""
    return _two(benchmark).select("item_id", X.hamming(F.col("x"), F.col("y")).cast("long").alias("d"))


@query("benchmark", oracle=f"SELECT item_id, round(jaro_similarity(x, y), 6) AS jaro, round(jaro_winkler_similarity(x, y), 6) AS jw FROM ({_TWO})")
def jaro_similarities(benchmark):
    j, w = X.scorer(X.jaro), X.scorer(X.jaro_winkler)
    return _two(benchmark).select("item_id", F.round(j("x", "y"), 6).alias("jaro"), F.round(w("x", "y"), 6).alias("jw"))


@query("documents", oracle=f"""
WITH t AS (SELECT doc_id, {_W} AS w FROM documents), g AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g, w FROM t)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) / len(w) END AS d1, CASE WHEN len(w) < 2 THEN 0 ELSE len(list_distinct(g)) / len(g) END AS d2 FROM g""")
def distinct_n_grams(documents):
    return documents.select("doc_id", X.distinct_n(F.col("text"), 1).alias("d1"), X.distinct_n(F.col("text"), 2).alias("d2"))


@query("benchmark")
def overlap_metrics(benchmark):
    """BLEU, GLEU, chrF, ROUGE, SARI and ratio of neighbours; tests hold hand-made values."""
    two = _two(benchmark)
    f = {"bleu": X.bleu, "gleu": X.gleu, "chrf": X.chrf, "lev_ratio": X.levenshtein_ratio, "rouge1": lambda a, b: X.rouge(a, b)[0], "rouge2": lambda a, b: X.rouge(a, b)[1], "rouge_l": lambda a, b: X.rouge(a, b)[2]}
    return two.select("item_id", *(X.scorer(g)("x", "y").alias(n) for n, g in f.items()), X.scorer(lambda a, b: X.sari(a, b, b))("x", "y").alias("sari"))


@query("documents")
def readability(documents):
    """Grade level and self-BLEU."""
    return documents.select("doc_id", X.scorer1(X.fkgl)("text").alias("fkgl"), X.scorer1(X.self_bleu)("text").alias("self_bleu"))


_H = "(('0x' || left(md5('42:' || {k}), 8))::BIGINT / 4294967296.0)"


@query("documents", oracle=f"SELECT doc_id, CASE WHEN h < 0.5 THEN 'train' WHEN h < 0.7 THEN 'val' ELSE 'test' END AS part FROM (SELECT doc_id, {_H.format(k='doc_id')} AS h FROM documents)")
def split_by_key(documents):
    """Train, validation and test by a hash of the key."""
    return E.split(documents, "doc_id").select("doc_id", "part")


@query("documents", oracle=f"SELECT doc_id, CAST(CASE WHEN h < 0.3 THEN -1 ELSE least(floor((h - 0.3) / 0.7 * 5), 4) END AS INTEGER) AS fold FROM (SELECT doc_id, {_H.format(k='doc_id')} AS h FROM documents)")
def k_fold_split(documents):
    return E.k_folds(documents, "doc_id").select("doc_id", "fold")


@query("lineitem", oracle="""
WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS ra,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS rb FROM lineitem)
SELECT l_returnflag, round(corr(ra, rb), 9) AS rho, count(*) AS n FROM r GROUP BY 1""")
def spearman_by_group(lineitem):
    return E.spearman(lineitem, "l_quantity", "l_extendedprice", ("l_returnflag",)).select("l_returnflag", F.round("rho", 9).alias("rho"), "n")


@query("events", oracle="SELECT event_type, avg(CASE WHEN round_even(value, 0) = round_even(value * 1.01, 0) THEN 1.0 ELSE 0.0 END) AS accuracy FROM events GROUP BY 1")
def rounded_accuracy(events):
    return E.accuracy(events.withColumn("m", F.col("value") * 1.01), "value", "m", ("event_type",))


@query("events", oracle="""
WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) END, 9) AS scaled FROM events JOIN b USING (event_type)""")
def min_max_scale(events):
    from corvella.operators import relational as R

    return R.min_max(events, ["event_type"], "value", "scaled").select("event_id", F.round("scaled", 9).alias("scaled"))


@query("orders", oracle="""
WITH rel AS (SELECT o_custkey % 20 AS q, o_orderkey AS item, 1.0 / row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_totalprice DESC, o_orderkey) AS rel FROM orders),
pred AS (SELECT o_custkey % 20 AS q, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderdate, o_orderkey) AS rank FROM orders),
ideal AS (SELECT q, sum(CASE WHEN k <= 10 THEN rel / log2(k + 1) ELSE 0 END) AS ideal FROM (SELECT q, rel, row_number() OVER (PARTITION BY q ORDER BY rel DESC, item) AS k FROM rel) GROUP BY 1),
got AS (SELECT q, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS got FROM rel JOIN pred USING (q, item) GROUP BY 1)
SELECT q, round(got / ideal, 9) AS ndcg FROM ideal JOIN got USING (q)""")
def ndcg_at_k(orders):
    from pyspark.sql import Window

    q = orders.select((F.col("o_custkey") % 20).alias("q"), F.col("o_orderkey").alias("item"), "o_totalprice", "o_orderdate")
    rel = q.select("q", "item", (1 / F.row_number().over(Window.partitionBy("q").orderBy(F.desc("o_totalprice"), "item"))).alias("rel"))
    pred = q.select("q", "item", F.row_number().over(Window.partitionBy("q").orderBy("o_orderdate", "item")).alias("rank"))
    return E.ndcg(rel, pred, 10).select("q", F.round("ndcg", 9).alias("ndcg"))


@query("lineitem", oracle="""
WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_discount) AS m2, stddev_pop(l_discount) AS s2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS l_quantity, round((l_discount - m2) / s2, 6) AS l_discount FROM lineitem, s""")
def standardize_features(lineitem):
    z = E.standardize(lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"])
    return z.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_discount", 6).alias("l_discount"))


@query("events", oracle="""
WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1),
t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean, sum((n - 1) * v) AS w, sum(n * m * m) AS sq FROM g)
SELECT round(((sq - n * mean * mean) / (k - 1)) / (w / (n - k)), 6) AS f FROM t""")
def anova_f_statistic(events):
    return E.anova_f(events, "event_type", "value").select(F.round("f", 6).alias("f"))
