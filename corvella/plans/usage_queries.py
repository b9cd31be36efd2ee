"""AI-usage checks, cluster sweeps, corpus metrics and callables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvella.functions import metrics as X
from corvella.functions import text as T
from corvella.operators import clusters as K
from corvella.operators import dedup as D
from corvella.operators import overlap as V
from corvella.operators import usage as U

from .analysis_queries import _TWO, _USAGE, _two, _usage
from .registry import query
from .text_queries import _SETS, _classes, _clusters

_DRIFT = _USAGE.replace("quality = 1", "quality = 1 AND id % 2 = 0").replace("quality = 0", "quality = 1 AND id % 2 = 1")
_GRID = """g AS (SELECT range / 100.0 AS alpha FROM range(1, 100))"""


@query("documents", "labels", oracle=_DRIFT + f""", {_GRID}, m AS (SELECT source, alpha, round(avg(ln(greatest(1e-300, (1 - alpha) + alpha * exp(greatest(-700, least(700, log_q - log_p)))))), 9) AS ll, count(*) AS n FROM lp, g GROUP BY 1, 2)
SELECT source, arg_max(alpha, (ll, -alpha))::DOUBLE AS alpha, max(n) AS n FROM m GROUP BY 1""")
def temporal_drift_check(documents, labels):
    """The share that human text of a later time seems to have against human text of an earlier one."""
    sent = U.sentence_table(documents.join(labels.select("doc_id", "quality"), "doc_id", "left"), keep=("source", "quality"))
    good = F.col("quality") == 1
    dist = U.labelled_distribution(sent, good & (F.col("id") % 2 == 0), good & (F.col("id") % 2 == 1))
    return U.grid_alpha(U.sentence_log_probs(sent, dist, ("source",)), ("source",))


@query("documents", "labels", oracle=_USAGE + f""", kap AS (SELECT unnest([100.0, 10000.0])::DOUBLE AS kappa), a AS (SELECT source, count(*) AS n FROM sent GROUP BY 1), cw AS (SELECT source, word, count(*) AS c FROM w GROUP BY 1, 2),
sh AS (SELECT kappa, a.source, d.word, least(greatest((kappa * human_count / nh + coalesce(c, 0)) / (kappa + a.n), 1e-10), 1 - 1e-10) AS p, log_q AS lq, m_q AS mq FROM dist d CROSS JOIN n CROSS JOIN a CROSS JOIN kap LEFT JOIN cw ON cw.source = a.source AND cw.word = d.word),
b AS (SELECT kappa, source, sum(mq) - sum(ln(1 - p)) AS b FROM sh GROUP BY 1, 2), d2 AS (SELECT kappa, source, word, lq - mq - ln(p) + ln(1 - p) AS d FROM sh),
r AS (SELECT kappa, source, id, sent, sum(d) AS d FROM w JOIN d2 USING (source, word) GROUP BY 1, 2, 3, 4), {_GRID},
m AS (SELECT kappa, source, alpha, round(avg(ln(greatest(1e-300, (1 - alpha) + alpha * exp(greatest(-700, least(700, b + d)))))), 9) AS ll, count(*) AS n FROM r JOIN b USING (kappa, source), g GROUP BY 1, 2, 3)
SELECT kappa, source, arg_max(alpha, (ll, -alpha))::DOUBLE AS alpha, max(n) AS n FROM m GROUP BY 1, 2""")
def kappa_sweep(documents, labels):
    """What share each source seems to have with its own shrunk rates, by the strength of the shrinkage."""
    sent, dist, _ = _usage(documents, labels)
    counts = U.presence_counts(sent, ("source",)).join(sent.groupBy("source").agg(F.count("*").alias("n")), "source")
    return U.kappa_sweep(sent, counts, dist, (100.0, 10000.0), "source")


@query("documents", "labels", oracle=_USAGE + """, d0 AS (SELECT DISTINCT id, source, sent, word FROM w) SELECT id, sent, round(sum(coalesce(log_p, -13.8)), 6) AS log_p, round(sum(coalesce(log_q, -13.8)), 6) AS log_q FROM d0 LEFT JOIN dist USING (word) GROUP BY 1, 2""")
def present_only_log_probabilities(documents, labels):
    """The older likelihood: words that are there, unknown ones at a floor."""
    sent, dist, _ = _usage(documents, labels)
    found = U.present_only_log_probs(sent, dist)
    return found.select("id", F.col("sent").cast("long").alias("sent"), F.round("log_p", 6).alias("log_p"), F.round("log_q", 6).alias("log_q"))


@query("documents", "labels", oracle=_USAGE + f""", {_GRID}, m AS (SELECT id, alpha, sum(ln(greatest(1e-300, (1 - alpha) + alpha * exp(greatest(-700, least(700, log_q - log_p)))))) AS ll, count(*) AS n FROM lp, g GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT id, max(n) AS n, arg_max(alpha, (round(ll + (20 * 0.2 - 1) * ln(alpha) + (20 * 0.8 - 1) * ln(1 - alpha), 7), -alpha))::DOUBLE AS alpha FROM m GROUP BY 1""")
def document_alpha_map(documents, labels):
    """The most likely share of each document under a prior."""
    return U.map_alpha(_usage(documents, labels)[2], 0.2, 20.0)


@query("documents", "labels", oracle=_USAGE + """, a AS (SELECT source, count(*) AS n FROM sent GROUP BY 1), cw AS (SELECT source, word, count(*) AS c FROM w GROUP BY 1, 2),
x AS (SELECT c, a.n AS n, human_count / nh AS mu FROM cw JOIN dist USING (word) JOIN a USING (source), n), kap AS (SELECT unnest([10.0, 100.0, 1000.0, 10000.0])::DOUBLE AS kappa)
SELECT kappa, round(sum((lgamma(kappa * mu + c) + lgamma(kappa * (1 - mu) + n - c) - lgamma(kappa + n)) - (lgamma(kappa * mu) + lgamma(kappa * (1 - mu)) - lgamma(kappa))), 2) AS ll FROM x, kap GROUP BY 1""")
def kappa_likelihood(documents, labels):
    """The marginal likelihood of the sources' counts at strengths of the prior; its peak is the best strength."""
    sent, dist, _ = _usage(documents, labels)
    counts = U.presence_counts(sent, ("source",)).join(sent.groupBy("source").agg(F.count("*").alias("n")), "source")
    rated = counts.join(dist.select("word", F.exp("log_p").alias("mu")), "word")
    rows = None
    for kappa in (10.0, 100.0, 1000.0, 10000.0):
        one = U.beta_binomial(rated, kappa).select(F.lit(kappa).alias("kappa"), F.round("ll", 2).alias("ll"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("lineitem", oracle="""
WITH s AS (SELECT l_returnflag AS kind, l_discount AS alpha, l_quantity AS n, l_shipdate < TIMESTAMP '1995-06-01' AS pre FROM lineitem),
k AS (SELECT kind, sum(alpha * n) FILTER (pre) / sum(n) FILTER (pre) AS a, sum(alpha * n) FILTER (NOT pre) / sum(n) FILTER (NOT pre) AS b, stddev_samp(alpha) FILTER (pre) AS d FROM s GROUP BY 1) SELECT round(coalesce(avg(b - 3 * a - d), -1), 9) AS score FROM k""")
def sweep_objective(lineitem):
    """What a sweep of settings maximizes."""
    return U.sweep_objective(lineitem, F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp_ntz"), "l_returnflag", "l_discount", "l_quantity").select(F.round("score", 9).alias("score"))


@query("documents", "labels", oracle=_USAGE + """, t AS (SELECT unnest([1, 2, 4]) AS min_length), l AS (SELECT unnest([0.0, 0.15, 0.5])::DOUBLE AS min_lor)
SELECT min_length, min_lor, count(word) AS words, round(coalesce(sum(abs(round(log_p - m_p - log_q + m_q, 7))), 0), 5) AS weight FROM t CROSS JOIN l LEFT JOIN dist ON length(word) >= min_length AND abs(round(log_p - m_p - log_q + m_q, 7)) >= min_lor GROUP BY 1, 2""")
def tuning_grid(documents, labels):
    """The vocabulary that each cell of a grid of settings leaves."""
    dist = _usage(documents, labels)[1].withColumn("lor", F.abs(F.round("log_odds_ratio", 7)))
    grid = dist.sparkSession.createDataFrame([(a, b) for a in (1, 2, 4) for b in (0.0, 0.15, 0.5)], "min_length int, min_lor double")
    held = grid.join(dist, (F.length("word") >= F.col("min_length")) & (F.col("lor") >= F.col("min_lor")), "left")
    return held.groupBy("min_length", "min_lor").agg(F.count("word").alias("words"), F.round(F.coalesce(F.sum("lor"), F.lit(0.0)), 5).alias("weight"))


@query("events", oracle="""
SELECT event_type, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'pre' ELSE 'post' END AS era, count(*) AS n, round(avg(value) , 6) AS mean_fraction, round(median(value), 6) AS median_fraction,
round(100 * avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS flagged, count(DISTINCT user_id) AS agencies FROM events GROUP BY 1, 2""")
def detector_summary(events):
    """Mean and median fractions, share flagged and distinct agencies by kind and era."""
    era = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), "pre").otherwise("post")
    return events.groupBy("event_type", era.alias("era")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_fraction"), F.round(F.median("value"), 6).alias("median_fraction"),
        F.round(100 * F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6).alias("flagged"), F.count_distinct("user_id").alias("agencies"),
    )


@query("documents", oracle=r"""
WITH w AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS k FROM documents) SELECT count(*) AS n_docs, sum(k)::BIGINT AS total_words, count(DISTINCT source) AS n_agencies, ceil(sum(k) / 1000)::BIGINT AS thousands FROM w""")
def sampling_summary(documents):
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    return documents.agg(F.count("*").alias("n_docs"), F.sum(words).alias("total_words"), F.count_distinct("source").alias("n_agencies"), F.ceil(F.sum(words) / 1000).alias("thousands"))


@query("documents", oracle=_SETS + ", lim AS (SELECT CASE WHEN count(*) < 2 THEN 9223372036854775807 ELSE greatest(1, floor(count(*) * 0.02)) END AS m FROM n), f AS (SELECT g, count(*) AS df FROM s GROUP BY 1) SELECT doc_id AS id, count(*) AS kept FROM s JOIN f USING (g), lim WHERE df <= m GROUP BY 1")
def common_shingle_filter(documents):
    """How many shingles of each document stand in a fiftieth of all documents at most."""
    shingles = D.shingle_table(documents, min_tokens=1, clean=False)
    return D.drop_common(shingles, 0.02).groupBy("id").agg(F.count("*").alias("kept"))


@query("documents", oracle=_SETS + """, gs AS (SELECT doc_id, list(g) AS gs FROM s GROUP BY 1),
v AS (SELECT cl.id, cl.cluster, a.gs AS mine, b.gs AS theirs FROM cl JOIN rep USING (cluster) LEFT JOIN gs a ON a.doc_id = cl.id LEFT JOIN gs b ON b.doc_id = rep.representative)
SELECT id, CASE WHEN mine IS NULL OR theirs IS NULL OR len(list_intersect(mine, theirs)) / (len(mine) + len(theirs) - len(list_intersect(mine, theirs))) >= 0.95 THEN cluster ELSE id END AS cluster FROM v""")
def cluster_validation(documents):
    """Members too unlike their representative leave their cluster."""
    clusters, reps = _clusters(documents)
    return D.validate(clusters, reps, D.shingle_table(documents, min_tokens=1, clean=False), 0.95)


@query("documents", oracle=_SETS + "SELECT x.source AS docket, count(*) AS pairs FROM p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE x.source = y.source GROUP BY 1")
def per_docket_pairs(documents):
    """Near-duplicate pairs within each docket."""
    of = documents.select("doc_id", "source")
    pairs = D.all_pairs(_classes(documents)).join(of.select(F.col("doc_id").alias("a"), F.col("source").alias("docket")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("source").alias("other")), "b")
    return pairs.where("docket = other").groupBy("docket").agg(F.count("*").alias("pairs"))


_LLOYD = """
v AS (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE embedding IS NOT NULL), c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, list_transform(v, lambda x: x::DOUBLE) AS c FROM (SELECT * FROM v ORDER BY id LIMIT {k})),
a0 AS (SELECT id, v, arg_min(cluster, (round(list_distance(v::DOUBLE[], c), 9), cluster)) AS cluster FROM v, c0 GROUP BY 1, 2),
e0 AS (SELECT cluster, unnest(v)::DOUBLE AS x, unnest(range(len(v))) AS i FROM a0), m0 AS (SELECT cluster, i, avg(x) AS m FROM e0 GROUP BY 1, 2), c1 AS (SELECT cluster, list(m ORDER BY i) AS c FROM m0 GROUP BY 1),
a1 AS (SELECT id, min((round(list_distance(v::DOUBLE[], c), 9), cluster)) AS best FROM v, c1 GROUP BY 1)"""


@query("embeddings", oracle="SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join("WITH " + _LLOYD.format(k=k) + f" SELECT {k} AS k, round(sum(best[1] * best[1]), 4) AS inertia FROM a1" for k in (2, 5)) + ")")
def k_means_sweep(embeddings):
    """The spread within clusters for several numbers of them, after one round from fixed centres."""
    vectors = embeddings.where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return K.k_sweep(vectors, (2, 5), rounds=1)


@query("embeddings")
def gaussian_mixture(embeddings):
    """Sizes of the components of a mixture over principal components; the library's fit has no twin."""
    vectors = embeddings.where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return K.mixture(vectors, 4, dimensions=4).groupBy("component").agg(F.count("*").alias("n"))


def _cider_sql() -> str:
    parts = []
    for n in (1, 2, 3, 4):
        parts.append(f"SELECT item_id, {n} AS n, 'h' AS side, unnest(list_transform(range(1, len(hw) - {n - 2}), lambda i: array_to_string(hw[i:i + {n - 1}], ' '))) AS g FROM t UNION ALL SELECT item_id, {n}, 'r', unnest(list_transform(range(1, len(rw) - {n - 2}), lambda i: array_to_string(rw[i:i + {n - 1}], ' '))) FROM t")
    return rf"""WITH t AS (SELECT item_id, list_filter(string_split_regex(lower(x), '\s+'), lambda w: w <> '') AS hw, list_filter(string_split_regex(lower(y), '\s+'), lambda w: w <> '') AS rw FROM ({_TWO})),
g AS ({" UNION ALL ".join(parts)}), c AS (SELECT item_id, n, side, g, count(*) AS tf FROM g GROUP BY 1, 2, 3, 4), df AS (SELECT n, g, count(*) AS df FROM c WHERE side = 'r' GROUP BY 1, 2), docs AS (SELECT count(*) AS total FROM t),
wt AS (SELECT item_id, c.n, side, c.g, tf * (ln(total) - ln(greatest(1, coalesce(df, 0)))) AS w FROM c LEFT JOIN df ON df.n = c.n AND df.g = c.g, docs), nm AS (SELECT item_id, n, side, sqrt(sum(w * w)) AS z FROM wt GROUP BY 1, 2, 3),
s AS (SELECT a.item_id, a.n, sum(least(a.w, b.w) * b.w) AS s FROM wt a JOIN wt b ON a.item_id = b.item_id AND a.n = b.n AND a.g = b.g AND a.side = 'h' AND b.side = 'r' GROUP BY 1, 2),
f AS (SELECT s.item_id, s.n, CASE WHEN x.z * y.z > 0 THEN s / (x.z * y.z) ELSE 0 END AS v FROM s JOIN nm x ON x.item_id = s.item_id AND x.n = s.n AND x.side = 'h' JOIN nm y ON y.item_id = s.item_id AND y.n = s.n AND y.side = 'r')
SELECT t.item_id, round(10 * exp(-((len(hw) - len(rw)) ** 2) / 72.0) * coalesce((SELECT sum(v) FROM f WHERE f.item_id = t.item_id), 0) / 4, 6) AS cider FROM t"""


@query("benchmark", oracle=_cider_sql())
def corpus_cider(benchmark):
    """tf-idf cosine of 1- to 4-grams with a penalty for length; frequencies are the corpus's, not an item's."""
    two = _two(benchmark)
    tokens = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    sides = two.select("item_id", F.explode(F.array(F.struct(F.lit("h").alias("side"), tokens(F.col("x")).alias("w")), F.struct(F.lit("r").alias("side"), tokens(F.col("y")).alias("w")))).alias("s")).select("item_id", "s.side", "s.w")
    runs = lambda n: F.transform(T.ngrams(F.col("w"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))
    grams = F.flatten(F.array(*map(runs, (1, 2, 3, 4))))
    counts = sides.select("item_id", "side", F.explode(grams).alias("g")).select("item_id", "side", "g.n", "g.g").groupBy("item_id", "n", "side", "g").agg(F.count("*").alias("tf"))
    df = counts.where("side = 'r'").groupBy("n", "g").agg(F.count("*").alias("df"))
    total = two.agg(F.count("*").alias("total"))
    weighed = counts.join(df, ["n", "g"], "left").crossJoin(F.broadcast(total)).withColumn("w", F.col("tf") * (F.log("total") - F.log(F.greatest(F.lit(1), F.coalesce("df", F.lit(0))))))
    norm = weighed.groupBy("item_id", "n").agg(F.sqrt(F.sum(F.when(F.col("side") == "h", F.col("w") * F.col("w")))).alias("zh"), F.sqrt(F.sum(F.when(F.col("side") == "r", F.col("w") * F.col("w")))).alias("zr"))
    pair = weighed.groupBy("item_id", "n", "g").agg(F.max(F.when(F.col("side") == "h", F.col("w"))).alias("h"), F.max(F.when(F.col("side") == "r", F.col("w"))).alias("r")).where("h is not null and r is not null")
    dots = pair.groupBy("item_id", "n").agg(F.sum(F.least("h", "r") * F.col("r")).alias("s")).join(norm, ["item_id", "n"])
    value = dots.groupBy("item_id").agg(F.sum(F.when(F.col("zh") * F.col("zr") > 0, F.col("s") / (F.col("zh") * F.col("zr"))).otherwise(0.0)).alias("v"))
    gap = F.size(tokens(F.col("x"))) - F.size(tokens(F.col("y")))
    return two.join(value, "item_id", "left").select("item_id", F.round(10 * F.exp(-(gap * gap) / 72.0) * F.coalesce("v", F.lit(0.0)) / 4, 6).alias("cider"))


@query("benchmark")
def further_overlap_metrics(benchmark):
    """NIST, TER, iBLEU, ROUGE-Lsum, CharCut, PseudoPARENT and UpdateROUGE of neighbours; tests hold hand-made values."""
    two = _two(benchmark)
    pairs = {"nist": X.nist, "ter": X.ter, "rouge_lsum": X.rouge_lsum, "char_cut": X.char_cut}
    triples = {"ibleu": X.ibleu, "pseudo_parent": X.pseudo_parent, "update_rouge": X.update_rouge}
    return two.select("item_id", *(X.scorer(f)("x", "y").alias(n) for n, f in pairs.items()), *(X.scorer3(f)("y", "x", "y").alias(n) for n, f in triples.items()))


@query("lineitem", oracle="SELECT l_returnflag, l_linestatus, max(l_quantity) - min(l_quantity) AS spread, median(l_quantity) AS middle FROM lineitem GROUP BY 1, 2")
def aggregate_callable(lineitem):
    """A Python aggregate, fed with counts of values and not with rows."""
    counted = lineitem.groupBy("l_returnflag", "l_linestatus", "l_quantity").agg(F.count("*").alias("n"))

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("l_quantity")
        values, ends = group["l_quantity"].to_numpy(), group["n"].cumsum().to_numpy()
        at = [values[int((ends > k).argmax())] for k in ((ends[-1] - 1) // 2, ends[-1] // 2)]
        return pd.DataFrame([[*key, values[-1] - values[0], (at[0] + at[1]) / 2]], columns=["l_returnflag", "l_linestatus", "spread", "middle"])

    return counted.groupBy("l_returnflag", "l_linestatus").applyInPandas(one, "l_returnflag string, l_linestatus string, spread double, middle double")


@query("events", oracle="SELECT user_id % 16 AS task, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def process_pool_task(events):
    """One task a share of the rows: partial results of each partition, then their sums."""

    def part(batches):
        for b in batches:
            got = b.groupby("task")["value"].agg(["count", "sum"]).reset_index()
            yield got.rename(columns={"count": "n", "sum": "total"})

    partial = events.select((F.col("user_id") % 16).alias("task"), "value").mapInPandas(part, "task long, n long, total double")
    return partial.groupBy("task").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("documents", oracle="SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS page, length(unnest(string_split(coalesce(text, ''), chr(10)))) AS n FROM documents")
def table_callable(documents):
    """A table function: one text, a row for each of its lines."""
    @F.udtf(returnType="page: long, n: long")
    class Lines:
        def eval(self, text: str):
            for k, line in enumerate((text or "").split("\n"), 1):
                yield k, len(line)

    spark = documents.sparkSession
    spark.udtf.register("corvella_lines", Lines)
    return spark.sql("SELECT d.doc_id, l.page, l.n FROM {documents} d, LATERAL corvella_lines(d.text) l", documents=documents)


@query("lineitem", oracle="""
WITH m AS (SELECT 'l_quantity' AS metric, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std FROM lineitem
UNION ALL SELECT 'l_discount', round(corr(l_discount, l_extendedprice), 6), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_tax', round(corr(l_tax, l_extendedprice), 6), round(avg(l_tax), 6), round(stddev_samp(l_tax), 6) FROM lineitem) SELECT *, row_number() OVER (ORDER BY abs(pearson) DESC, metric) AS rank FROM m""")
def report_card(lineitem):
    """Metrics beside the target: correlation, mean, deviation and rank."""
    names = ("l_quantity", "l_discount", "l_tax")
    row = lineitem.agg(*(f(c).alias(f"{k}_{c}") for c in names for k, f in (("pearson", lambda x: F.corr(x, "l_extendedprice")), ("mean", F.avg), ("std", F.stddev_samp))))
    card = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), *(F.round(f"{k}_{c}", 6).alias(k) for k in ("pearson", "mean", "std"))) for c in names))).alias("m")).select("m.*")
    return card.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("pearson")), "metric")).cast("long"))


def _overlap_sql() -> str:
    token = r"regexp_extract_all(lower({}), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"
    unit = {"token": token, "word": r"list_filter(" + token + r", lambda t: regexp_full_match(t, '[\p{L}\p{N}]+'))", "char": r"list_filter(string_split(regexp_replace({}, '\s+', '', 'g'), ''), lambda c: c <> '')"}
    sides = " UNION ALL ".join(f"SELECT item_id AS id, '{kind}' AS kind, {s} AS side, {unit[kind].replace('{}', c)} AS w FROM two" for kind in unit for s, c in ((0, "x"), (1, "y")))
    longest = "CASE kind WHEN 'token' THEN 4 WHEN 'word' THEN 2 ELSE 6 END"
    return f"""WITH two AS ({_TWO}), u AS ({sides}), o AS (SELECT *, unnest(range(1, {longest} + 1)) AS n FROM u),
g AS (SELECT id, kind, side, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM o),
c AS (SELECT id, kind, n, g, count(*) FILTER (side = 0) AS h, count(*) FILTER (side = 1) AS r FROM g GROUP BY 1, 2, 3, 4), s AS (SELECT id, kind, n, sum(least(h, r)) AS hit, sum(h) AS mine, sum(r) AS theirs FROM c GROUP BY 1, 2, 3),
z AS (SELECT *, sum(CASE WHEN hit = 0 AND mine > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id, kind ORDER BY n) AS zeros FROM s),
a AS (SELECT id, avg(ln(CASE WHEN hit > 0 THEN 100 * hit / mine ELSE 100 / (2.0 ** zeros * mine) END)) FILTER (kind = 'token' AND mine > 0) AS o, coalesce(max(mine) FILTER (kind = 'token' AND n = 1), 0) AS lh, coalesce(max(theirs) FILTER (kind = 'token' AND n = 1), 0) AS lr,
sum(hit) FILTER (kind = 'token') AS hit, greatest(sum(mine) FILTER (kind = 'token'), sum(theirs) FILTER (kind = 'token')) AS more, coalesce(max(2 * hit / (mine + theirs)) FILTER (kind = 'word' AND n = 1), 0) AS rouge1, coalesce(max(2 * hit / (mine + theirs)) FILTER (kind = 'word' AND n = 2), 0) AS rouge2,
avg(hit / mine) FILTER (kind = 'char' AND mine > 0 AND theirs > 0) AS p, avg(hit / theirs) FILTER (kind = 'char' AND mine > 0 AND theirs > 0) AS r FROM z GROUP BY 1)
SELECT id, round(CASE WHEN lh > 0 AND lr > 0 THEN least(1.0, exp(1 - lr / lh)) * exp(o) ELSE 0 END, 6) AS bleu, round(CASE WHEN more > 0 THEN hit / more ELSE 0 END, 6) AS gleu, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2,
round(CASE WHEN p + r > 0 THEN 500 * p * r / (4 * p + r) ELSE 0 END, 6) AS chrf FROM a"""


@query("benchmark", oracle=_overlap_sql())
def gram_overlap_metrics(benchmark):
    """BLEU, GLEU, ROUGE-1 and -2 and chrF of neighbours from counts of shared n-grams."""
    found = V.scores(V.gram_overlaps(_two(benchmark), "item_id", "x", "y"))
    return found.select("id", *(F.round(c, 6).alias(c) for c in ("bleu", "gleu", "rouge1", "rouge2", "chrf")))


@query("documents", oracle=r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\p{L}+') AS w, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[.!?]+'))) AS parts FROM documents)
SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE 0.39 * len(w) / parts + 11.8 * list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouyáéíóúàèùâêîôûäöü]+'))))) / len(w) - 15.59 END, 6) AS grade FROM w""")
def grade_level(documents):
    """Grade level by built-in expressions."""
    return documents.select("doc_id", F.round(V.grade(F.col("text")), 6).alias("grade"))
