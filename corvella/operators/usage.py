"""AI-usage estimation: word-presence distributions, sentence likelihoods, mixture fractions, shrinkage."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.functions import text as T

#: Sentences that a fit needs at least.
USABLE = 10
#: The log-likelihood of a word outside the vocabulary in the present-only variant.
OUTSIDE = -13.8
#: Bootstrap resamples, as many as the reference draws.
BOOTSTRAPS = 1000
#: Log ratios are binned to so many digits; beyond the reach they weigh as much as there.
RATIO_DIGITS, RATIO_REACH = 4, 50.0


def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, sent, words...) of the sentences of more than ten words, numbered from 0."""
    kept = docs.select(F.col(id_col).alias("id"), *keep, T.sentence_words(F.col(text_col)).alias("s"))
    return kept.select("id", *keep, F.posexplode("s").alias("sent", "words"))


def presence_counts(sentences: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, word, count): in how many sentences a word stands."""
    return sentences.select(*keys, F.explode(F.array_distinct("words")).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("count"))


def distribution(human: DataFrame, ai: DataFrame, min_human: int = 5, min_ai: int = 3, max_vocab: int | None = None) -> DataFrame:
    """(word, human_count, ai_count, log_p, log_q, log1m_p, log1m_q, log_odds_ratio) of words that both corpora hold
    often enough; words in every sentence of a corpus are left out."""
    n = human.agg(F.count("*").alias("nh")).crossJoin(ai.agg(F.count("*").alias("na")))  # two rows of one number
    h = presence_counts(human).withColumnRenamed("count", "human_count").where(F.col("human_count") >= min_human)
    a = presence_counts(ai).withColumnRenamed("count", "ai_count").where(F.col("ai_count") >= min_ai)
    both = h.join(a, "word").crossJoin(F.broadcast(n)).where("human_count < nh and ai_count < na")
    out = _log_rates(both)
    return out if max_vocab is None else out.orderBy(F.desc("ai_count"), "word").limit(max_vocab)


#: Stands in every sentence, so that its counts are the numbers of sentences; no word holds it.
EVERY = "\u0000"


def labelled_distribution(sentences: DataFrame, human: Column, ai: Column, min_human: int = 5, min_ai: int = 3) -> DataFrame:
    """``distribution`` of the sentences that are ``human`` and those that are ``ai``, in one reading of the table."""
    marked = sentences.select(human.cast("int").alias("h"), ai.cast("int").alias("a"), F.explode(F.array_append(F.array_distinct("words"), F.lit(EVERY))).alias("word"))
    counts = marked.groupBy("word").agg(F.coalesce(F.sum("h"), F.lit(0)).alias("human_count"), F.coalesce(F.sum("a"), F.lit(0)).alias("ai_count"))
    n = counts.where(F.col("word") == EVERY).select(F.col("human_count").alias("nh"), F.col("ai_count").alias("na"))
    kept = counts.where((F.col("word") != EVERY) & (F.col("human_count") >= min_human) & (F.col("ai_count") >= min_ai))
    return _log_rates(kept.crossJoin(F.broadcast(n)).where("human_count < nh and ai_count < na"))


def _log_rates(counted: DataFrame) -> DataFrame:
    p, q = F.col("human_count") / F.col("nh"), F.col("ai_count") / F.col("na")
    out = counted.select("word", "human_count", "ai_count", F.log(p).alias("log_p"), F.log(q).alias("log_q"), F.log1p(-p).alias("log1m_p"), F.log1p(-q).alias("log1m_q"))
    return out.withColumn("log_odds_ratio", F.col("log_p") - F.col("log1m_p") - F.col("log_q") + F.col("log1m_q"))


def postprocess(dist: DataFrame, min_human: int, min_ai: int, min_length: int, min_lor: float, max_vocab: int) -> DataFrame:
    kept = dist.where((F.col("human_count") >= min_human) & (F.col("ai_count") >= min_ai) & (F.length("word") >= min_length) & (F.abs("log_odds_ratio") >= min_lor))
    return kept.orderBy(F.desc("ai_count"), "word").limit(max_vocab)


def sentence_log_probs(sentences: DataFrame, dist: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, sent, log_p, log_q): the full Bernoulli likelihood as a baseline and the differences of the words that
    stand in the sentence; sentences without a word of the vocabulary are left out."""
    base = dist.agg(F.sum("log1m_p").alias("bp"), F.sum("log1m_q").alias("bq"))
    delta = dist.select("word", (F.col("log_p") - F.col("log1m_p")).alias("dp"), (F.col("log_q") - F.col("log1m_q")).alias("dq"))
    held = sentences.select("id", *keys, "sent", F.explode(F.array_distinct("words")).alias("word")).join(delta, "word")
    sums = held.groupBy("id", *keys, "sent").agg(F.sum("dp").alias("dp"), F.sum("dq").alias("dq"))
    return sums.crossJoin(F.broadcast(base)).select(*keys, "id", "sent", (F.col("bp") + F.col("dp")).alias("log_p"), (F.col("bq") + F.col("dq")).alias("log_q"))


def present_only_log_probs(sentences: DataFrame, dist: DataFrame) -> DataFrame:
    """The older variant: words that are there, unknown ones at a floor."""
    held = sentences.select("id", "sent", F.explode(F.array_distinct("words")).alias("word")).join(dist.select("word", "log_p", "log_q"), "word", "left")
    return held.groupBy("id", "sent").agg(F.sum(F.coalesce("log_p", F.lit(OUTSIDE))).alias("log_p"), F.sum(F.coalesce("log_q", F.lit(OUTSIDE))).alias("log_q"))


def posterior(log_p: Column, log_q: Column, alpha: Column) -> Column:
    """The chance that a sentence is of Q when a share alpha of all is."""
    odds = F.log(alpha) - F.log(1 - alpha) + log_q - log_p
    return F.when(alpha <= 0, 0.0).when(alpha >= 1, 1.0).otherwise(1 / (1 + F.exp(-odds)))


def fit_alpha(log_ratio: np.ndarray, low: float = 1e-6, high: float = 1 - 1e-6, prior: tuple[float, float] | None = None, weights: np.ndarray | None = None) -> float:
    """The alpha that maximizes mean log((1 - alpha) + alpha r), plus a Beta prior where one is given, by bisection on
    its falling derivative. With ``weights`` each ratio counts so many times."""
    r = np.exp(np.clip(log_ratio, -700, 700))
    weights = np.ones(len(r)) if weights is None else weights
    n, gain = float(weights.sum()), weights * (r - 1)

    def slope(a: float) -> float:
        got = float(np.sum(gain / np.maximum((1 - a) + a * r, 1e-300))) / n
        return got if prior is None else got + ((prior[0] - 1) / a - (prior[1] - 1) / (1 - a)) / n

    if slope(low) <= 0:
        return low
    if slope(high) >= 0:
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return (low + high) / 2


def mixture(log_probs: DataFrame, keys: tuple[str, ...], bootstraps: int = BOOTSTRAPS, seed: int = 42) -> DataFrame:
    """(keys, n_sentences, alpha, ci_lower, ci_upper) of each stratum; null below ``USABLE`` sentences.

    Sentences of one log ratio, to ``RATIO_DIGITS``, are counted before a stratum meets in one task: it sees at most a
    histogram of 2 * ``RATIO_REACH`` * 10**``RATIO_DIGITS`` bins, whatever its sentences. Resamples are multinomial weights
    of the bins, which is the same as drawing sentences.
    """

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ratio")
        ratio, count = group["ratio"].to_numpy(), group["n"].to_numpy()
        total = int(count.sum())
        if total < USABLE:
            fitted = [math.nan] * 3
        else:
            rng = np.random.default_rng(seed)
            draws = [fit_alpha(ratio, weights=rng.multinomial(total, count / total)) for _ in range(bootstraps)]
            fitted = [fit_alpha(ratio, weights=count.astype(float)), *np.percentile(draws, [2.5, 97.5])]
        return pd.DataFrame([[*key, total, *fitted]], columns=[*keys, "n_sentences", "alpha", "ci_lower", "ci_upper"])

    ratio = F.round(F.greatest(F.lit(-RATIO_REACH), F.least(F.lit(RATIO_REACH), F.col("log_q") - F.col("log_p"))), RATIO_DIGITS)
    ratios = log_probs.select(*keys, ratio.alias("ratio")).groupBy(*keys, "ratio").agg(F.count("*").alias("n"))
    kinds = ", ".join(f"{k} {log_probs.schema[k].dataType.simpleString()}" for k in keys)
    return ratios.groupBy(*keys).applyInPandas(one, f"{kinds}, n_sentences long, alpha double, ci_lower double, ci_upper double")


def grid_alpha(log_probs: DataFrame, keys: tuple[str, ...], steps: int = 99) -> DataFrame:
    """(keys, alpha, n): the best alpha of a grid of hundredths, in SQL alone."""
    grid = log_probs.sparkSession.range(1, steps + 1).select((F.col("id") / 100).alias("alpha"))
    r = F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("log_q") - F.col("log_p"))))
    rated = log_probs.select(*keys, r.alias("r")).crossJoin(F.broadcast(grid))
    means = rated.groupBy(*keys, "alpha").agg(F.round(F.avg(F.log(F.greatest(F.lit(1e-300), (1 - F.col("alpha")) + F.col("alpha") * F.col("r")))), 9).alias("ll"), F.count("*").alias("n"))
    return means.groupBy(*keys).agg(F.max_by("alpha", F.struct("ll", -F.col("alpha"))).alias("alpha"), F.max("n").alias("n"))


def map_alpha(log_probs: DataFrame, prior: float, strength: float, least: int = 3, steps: int = 99) -> DataFrame:
    """(id, n, alpha): the share of each document that is most likely under a Beta(strength * prior, strength * (1 - prior)),
    on a grid; documents of fewer than ``least`` usable sentences are left out."""
    grid = log_probs.sparkSession.range(1, steps + 1).select((F.col("id") / (steps + 1)).alias("alpha"))
    r = F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("log_q") - F.col("log_p"))))
    rated = log_probs.select("id", r.alias("r")).crossJoin(F.broadcast(grid))
    mixed = F.sum(F.log(F.greatest(F.lit(1e-300), (1 - F.col("alpha")) + F.col("alpha") * F.col("r"))))
    weight = (strength * prior - 1) * F.log("alpha") + (strength * (1 - prior) - 1) * F.log(1 - F.col("alpha"))
    scored = rated.groupBy("id", "alpha").agg(mixed.alias("ll"), F.count("*").alias("n")).where(F.col("n") >= least)
    return scored.groupBy("id").agg(F.max("n").alias("n"), F.max_by("alpha", F.struct(F.round(F.col("ll") + weight, 7), -F.col("alpha"))).alias("alpha"))


def kappa_sweep(sentences: DataFrame, counts: DataFrame, dist: DataFrame, kappas: tuple[float, ...], key: str) -> DataFrame:
    """(kappa, key, alpha, n): the share that each key seems to have when its own rates, shrunk with each kappa, stand for
    human text; of human text it should be none."""
    pool = dist.select("word", F.exp("log_p").alias("mu"))
    other = dist.select("word", F.col("log_q").alias("lq"), F.col("log1m_q").alias("mq"))
    rates = None
    for kappa in kappas:
        shrunk = shrink(counts, pool, kappa, key).withColumn("kappa", F.lit(float(kappa)))
        rates = shrunk if rates is None else rates.unionByName(shrunk)
    p = F.least(F.col("p"), F.lit(1 - 1e-10))
    rates = rates.select("kappa", key, "word", F.log(p).alias("lp"), F.log1p(-p).alias("mp")).join(F.broadcast(other), "word")
    base = rates.groupBy("kappa", key).agg((F.sum("mq") - F.sum("mp")).alias("b"))
    gain = rates.select("kappa", key, "word", (F.col("lq") - F.col("mq") - F.col("lp") + F.col("mp")).alias("d"))
    held = sentences.select("id", key, "sent", F.explode(F.array_distinct("words")).alias("word"))
    sums = held.join(gain, [key, "word"]).groupBy("kappa", key, "id", "sent").agg(F.sum("d").alias("d"))
    ratio = sums.join(F.broadcast(base), ["kappa", key]).select("kappa", key, F.lit(0.0).alias("log_p"), (F.col("b") + F.col("d")).alias("log_q"))
    return grid_alpha(ratio, ("kappa", key))


def sweep_objective(strata: DataFrame, early: Column, kind: str, alpha: str, n: str) -> DataFrame:
    """(score): the mean over kinds of the weighted share after the cut less three times that before and its deviation; -1
    where no kind has both."""
    weighed = lambda side: F.sum(F.when(side, F.col(alpha) * F.col(n))) / F.sum(F.when(side, F.col(n)))
    kinds = strata.groupBy(kind).agg(weighed(early).alias("pre"), weighed(~early).alias("post"), F.stddev_samp(F.when(early, F.col(alpha))).alias("std"))
    return kinds.agg(F.coalesce(F.avg(F.col("post") - 3 * F.col("pre") - F.col("std")), F.lit(-1.0)).alias("score"))


def shrink(counts: DataFrame, pool: DataFrame, kappa: float, key: str) -> DataFrame:
    """(key, word, p): (kappa mu + n_w) / (kappa + n), at least 1e-10, of every word of the pool for every key, also of
    those that the key never uses; ``counts`` has key, word, count, n."""
    whole = counts.select(key, "n").distinct().crossJoin(F.broadcast(pool))  # the pool is the fitted vocabulary
    used = counts.select(F.col(key).alias("k"), F.col("word").alias("w"), "count")
    joined = whole.join(used, F.col(key).eqNullSafe(F.col("k")) & (F.col("word") == F.col("w")), "left")
    p = (kappa * F.col("mu") + F.coalesce("count", F.lit(0))) / (kappa + F.col("n"))
    return joined.select(key, "word", F.greatest(p, F.lit(1e-10)).alias("p"))


def beta_binomial(counts: DataFrame, kappa: float) -> DataFrame:
    """The log marginal likelihood of counts (count, n, mu) under a Beta prior of strength kappa, in one row."""

    def rows(batches):
        ln = np.vectorize(math.lgamma)
        for b in batches:
            k, n, mu = (b[c].to_numpy(dtype=float) for c in ("count", "n", "mu"))
            beta = lambda x, y: ln(x) + ln(y) - ln(x + y)
            yield pd.DataFrame({"ll": [float((beta(kappa * mu + k, kappa * (1 - mu) + n - k) - beta(kappa * mu, kappa * (1 - mu))).sum())]})

    return counts.select("count", "n", "mu").mapInPandas(rows, "ll double").agg(F.sum("ll").alias("ll"))


def best_kappa(counts: DataFrame, low: float = 1.0, high: float = 1e6, rounds: int = 18) -> float:
    """The kappa of the greatest marginal likelihood by a golden-section search on its logarithm."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = math.log(low), math.log(high)
    at = lambda x: beta_binomial(counts, math.exp(x)).first()["ll"] or 0.0
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = at(c), at(d)
    for _ in range(rounds):
        if fc >= fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = at(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = at(d)
    return math.exp((a + b) / 2)
