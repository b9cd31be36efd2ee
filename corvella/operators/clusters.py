"""Cluster sweeps over vectors. The exact form is Lloyd's rounds in SQL; the library's models stand in for the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.functions import text as T
from corvella.session import materialize


def lloyd(vectors: DataFrame, centres: DataFrame, rounds: int, *, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """(id, cluster, distance) after ``rounds`` of moving centres to the means of their vectors.

    ``centres`` (cluster, c) are a few rows and are broadcast; ties go to the smaller cluster. Each round is one
    aggregation by cluster and place, so no cluster is gathered; the centres are written between rounds.
    """

    def nearest(now: DataFrame) -> DataFrame:
        gap = F.sqrt(F.aggregate(F.zip_with(vector_col, "c", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x))
        met = vectors.crossJoin(F.broadcast(now)).select(id_col, vector_col, F.struct(F.round(gap, 9).alias("d"), "cluster").alias("at"))
        return met.groupBy(id_col).agg(F.min("at").alias("at"), F.first(vector_col).alias(vector_col)).select(id_col, vector_col, F.col("at.cluster").alias("cluster"), F.col("at.d").alias("distance"))

    for _ in range(rounds):
        means = nearest(centres).select("cluster", F.posexplode(vector_col).alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        centres = materialize(means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("c")), "centres")
    return nearest(centres).select(id_col, "cluster", "distance")


def first_centres(vectors: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """The vectors of the ``k`` least ids as centres 0 to k - 1."""
    least = vectors.orderBy(id_col).limit(k)
    listed = least.agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(vector_col).alias("v")))).alias("all"))
    return listed.select(F.posexplode("all").alias("cluster", "x")).select("cluster", F.transform("x.v", lambda y: y.cast("double")).alias("c"))


def k_sweep(vectors: DataFrame, ks: tuple[int, ...], rounds: int = 3, *, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """(k, inertia, best): the sum of squared distances of each k; the best has the greatest bend of the curve."""
    runs = None
    for k in ks:
        one = lloyd(vectors, first_centres(vectors, k, id_col=id_col, vector_col=vector_col), rounds, id_col=id_col, vector_col=vector_col)
        row = one.agg(F.lit(k).alias("k"), F.round(F.sum(F.col("distance") * F.col("distance")), 4).alias("inertia"))
        runs = row if runs is None else runs.unionByName(row)
    return runs


def mixture(vectors: DataFrame, k: int, seed: int = 42, *, id_col: str = "id", vector_col: str = "v", dimensions: int | None = None) -> DataFrame:
    """(id, component, probability) of a Gaussian mixture, after a reduction by principal components where ``dimensions``
    says so. It stands in for a nonlinear reduction and a mixture of unknown size, and gives other results."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(id_col, array_to_vector(F.transform(vector_col, lambda x: x.cast("double"))).alias("features"))
    if dimensions:
        rows = PCA(k=dimensions, inputCol="features", outputCol="reduced").fit(rows).transform(rows).select(id_col, F.col("reduced").alias("features"))
    found = GaussianMixture(k=k, seed=seed, maxIter=20).fit(rows).transform(rows)
    return found.select(id_col, F.col("prediction").alias("component"), F.array_max(vector_to_array("probability")).alias("probability"))


def shares(assigned: DataFrame) -> DataFrame:
    """(cluster, n, share)."""
    n = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("cluster", "n", (F.col("n") / F.col("all")).alias("share"))


def unit(vectors: DataFrame, vector_col: str = "v") -> DataFrame:
    return vectors.withColumn(vector_col, T.l2_normalize(F.col(vector_col)))
