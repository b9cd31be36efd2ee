"""n-gram overlap of text pairs as aggregations: what BLEU, GLEU, ROUGE-N and chrF need of each order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.functions import text as T

#: Tokens as the metrics take them: words and single signs; words alone; characters without white space.
TOKEN, WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]", r"[\p{L}\p{N}]+"
KINDS = {"token": 4, "word": 2, "char": 6}


def units(text: Column, kind: str) -> Column:
    low = F.coalesce(text, F.lit(""))
    if kind == "char":
        return F.filter(F.split(F.regexp_replace(low, r"\s+", ""), ""), lambda c: c != "")
    tokens = F.regexp_extract_all(F.lower(low), F.lit(TOKEN), F.lit(0))
    return tokens if kind == "token" else F.filter(tokens, lambda t: t.rlike(f"^{WORD}$"))


def gram_overlaps(pairs: DataFrame, id_col: str, output: str, reference: str) -> DataFrame:
    """(id, kind, n, hit, mine, theirs): shared n-grams, each as often as both have it, and those of either text."""

    def grams(column: str, side: int) -> Column:
        lists = []
        for kind, longest in KINDS.items():
            for n in range(1, longest + 1):
                lists.append(F.transform(T.ngrams(units(F.col(column), kind), n), _gram(side, kind, n)))
        return F.flatten(F.array(*lists))

    rows = pairs.select(F.col(id_col).alias("id"), F.explode(F.concat(grams(output, 0), grams(reference, 1))).alias("g")).select("id", "g.*")
    counted = rows.groupBy("id", "kind", "n", "g").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("h"), F.sum("side").alias("r"))
    return counted.groupBy("id", "kind", "n").agg(F.sum(F.least("h", "r")).alias("hit"), F.sum("h").alias("mine"), F.sum("r").alias("theirs"))


def _gram(side: int, kind: str, n: int):
    return lambda g: F.struct(F.lit(side).alias("side"), F.lit(kind).alias("kind"), F.lit(n).alias("n"), g.alias("g"))


def scores(overlaps: DataFrame) -> DataFrame:
    """(id, bleu, gleu, rouge1, rouge2, chrf) as ``functions.metrics`` defines them."""
    zero = F.sum(F.when((F.col("hit") == 0) & (F.col("mine") > 0), 1).otherwise(0)).over(Window.partitionBy("id", "kind").orderBy("n"))
    t = overlaps.withColumn("zeros", zero)
    token, word, char = (F.col("kind") == k for k in ("token", "word", "char"))
    used = token & (F.col("mine") > 0)
    order = F.when(used, F.log(F.when(F.col("hit") > 0, 100 * F.col("hit") / F.col("mine")).otherwise(100 / (F.pow(F.lit(2.0), F.col("zeros")) * F.col("mine")))))
    f = lambda n: F.max(F.when(word & (F.col("n") == n), 2 * F.col("hit") / (F.col("mine") + F.col("theirs"))))
    both = char & (F.col("mine") > 0) & (F.col("theirs") > 0)
    one = lambda c: F.coalesce(F.max(F.when(token & (F.col("n") == 1), F.col(c))), F.lit(0))
    sums = t.groupBy("id").agg(
        F.avg(order).alias("order"), one("mine").alias("lh"), one("theirs").alias("lr"),
        F.sum(F.when(token, F.col("hit"))).alias("hit"), F.greatest(F.sum(F.when(token, F.col("mine"))), F.sum(F.when(token, F.col("theirs")))).alias("more"),
        F.coalesce(f(1), F.lit(0.0)).alias("rouge1"), F.coalesce(f(2), F.lit(0.0)).alias("rouge2"),
        F.avg(F.when(both, F.col("hit") / F.col("mine"))).alias("p"), F.avg(F.when(both, F.col("hit") / F.col("theirs"))).alias("r"),
    )
    brief = F.least(F.lit(1.0), F.exp(1 - F.col("lr") / F.col("lh")))
    return sums.select(
        "id",
        F.when((F.col("lh") > 0) & (F.col("lr") > 0), brief * F.exp("order")).otherwise(0.0).alias("bleu"),
        F.when(F.col("more") > 0, F.col("hit") / F.col("more")).otherwise(0.0).alias("gleu"),
        "rouge1", "rouge2",
        F.when(F.col("p") + F.col("r") > 0, 500 * F.col("p") * F.col("r") / (4 * F.col("p") + F.col("r"))).otherwise(0.0).alias("chrf"),
    )


def grade(text: Column) -> Column:
    """Grade level of a text, with syllables counted as groups of vowels."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{L}+"), F.lit(0))
    parts = F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[.!?]+"), F.lit(0))))
    vowels = "[aeiouyáéíóúàèùâêîôûäöü]+"

    def level(w: Column) -> Column:
        beats = F.aggregate(w, F.lit(0), lambda a, x: a + F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.lower(x), F.lit(vowels), F.lit(0)))))
        return F.when(F.size(w) == 0, 0.0).otherwise(0.39 * F.size(w) / parts + 11.8 * beats / F.size(w) - 15.59)

    return T.let(words, level)
