"""Splits, correlations, accuracies and rankings of metrics against targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(key: Column, seed: int) -> Column:
    """A number in [0, 1) that hangs on the key and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 2**32


def split(df: DataFrame, key: str, train: float = 0.5, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``part``; all rows of a key go to one part, and no sort of the ids is needed."""
    x = hash_rank(F.col(key), seed)
    return df.withColumn("part", F.when(x < train, "train").when(x < train + val, "val").otherwise("test"))


def k_folds(df: DataFrame, key: str, k: int = 5, test: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds ``fold``: -1 for the shared test set, else 0 to k - 1."""
    x = hash_rank(F.col(key), seed)
    return df.withColumn("fold", F.when(x < test, -1).otherwise(F.least(F.floor((x - test) / (1 - test) * k), F.lit(k - 1))).cast("int"))


def average_rank(column: str, keys: tuple[str, ...]) -> Column:
    """Ranks of which equals share the mean."""
    w = Window.partitionBy(*keys).orderBy(column)
    same = Window.partitionBy(*keys, column)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2


def spearman(df: DataFrame, a: str, b: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, rho, n) over rows that have both; fewer than two rows give none."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.select(*keys, average_rank(a, keys).alias("ra"), average_rank(b, keys).alias("rb"))
    return ranked.groupBy(*keys).agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n")).where("n >= 2")


def accuracy(df: DataFrame, target: str, metric: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The share of rows whose values round, half to even, to the same integer."""
    return df.groupBy(*keys).agg(F.avg(F.when(F.bround(target) == F.bround(metric), 1.0).otherwise(0.0)).alias("accuracy"))


def ndcg(relevant: DataFrame, predicted: DataFrame, k: int) -> DataFrame:
    """(q, ndcg) for (q, item, rel) and (q, item, rank)."""
    gain = lambda rel, rank: F.sum(F.when(rank <= k, rel / F.log2(rank + 1)).otherwise(0.0))
    ideal = relevant.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rel"), "item"))).where(F.col("rank") <= k).groupBy("q").agg(gain(F.col("rel"), F.col("rank")).alias("ideal"))
    got = relevant.join(predicted, ["q", "item"]).groupBy("q").agg(gain(F.col("rel"), F.col("rank")).alias("got"))
    return ideal.join(got, "q", "left").select("q", F.when(F.col("ideal") == 0, 0.0).otherwise(F.coalesce("got", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def recall(relevant: DataFrame, predicted: DataFrame, k: int, best: int = 5) -> DataFrame:
    """(q, recall): how many of the ``best`` relevant items stand among the first k."""
    top = relevant.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rel"), "item"))).where(F.col("r") <= best)
    hit = F.sum(F.when(F.col("rank") <= k, 1).otherwise(0))
    return top.join(predicted, ["q", "item"], "left").groupBy("q").agg((hit / F.count("*")).alias("recall"))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population z-scores; nulls are 0, a constant column is 0."""
    stats = df.agg(*(x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))))
    z = [F.when(F.col(f"__s_{c}") == 0, 0.0).otherwise((F.coalesce(c, f"__m_{c}") - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).alias(c) for c in columns]
    return df.crossJoin(F.broadcast(stats)).select(*(c for c in df.columns if c not in columns), *z)


def anova_f(df: DataFrame, group: str, value: str) -> DataFrame:
    """The F statistic of a one-way analysis of variance from the groups' counts, means and variances."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"))
    between = F.col("sq") - F.col("n") * F.col("mean") * F.col("mean")
    return t.select(((between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"))
