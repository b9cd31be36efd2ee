"""Training sets for matching: responses, agreement, hard negatives, weights, exact splits; and checks of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.functions import text as T
from corvella.operators.relational import placed_by_hash


def response_text(content: Column, summary: Column) -> Column:
    """Content and summary, trimmed, one blank between; empty where both are missing."""
    return F.trim(F.concat_ws(" ", F.coalesce(content, F.lit("")), F.coalesce(summary, F.lit(""))))


def encode_distinct(rows: DataFrame, text_col: str, encode: Column, name: str) -> DataFrame:
    """``encode``, an expression over ``text_col``, worked out once for each distinct text and brought back to all rows."""
    once = rows.select(text_col).distinct().withColumn(name, encode).withColumnRenamed(text_col, "__text")
    return rows.join(once, rows[text_col].eqNullSafe(once["__text"]), "left").drop("__text")


def agreement(primary: DataFrame, second: DataFrame, keys: tuple[str, ...], label: str = "label") -> DataFrame:
    """(n_pairs, agreement, primary_yes_rate, qa_yes_rate) of two labellings where both say yes or no."""
    valid = lambda d, name: d.where(F.col(label).isin("yes", "no")).select(*keys, F.col(label).alias(name))
    both = valid(primary, "p").join(valid(second, "q"), list(keys))
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return both.agg(F.count("*").alias("n_pairs"), rate(F.col("p") == F.col("q")).alias("agreement"), rate(F.col("p") == "yes").alias("primary_yes_rate"), rate(F.col("q") == "yes").alias("qa_yes_rate"))


def hard_negatives(pairs: DataFrame, group: str, *, id_col: str, label: str, length: str, score: str, tolerance: float = 0.5, n: int = 2) -> DataFrame:
    """(group, id, negatives): of each positive, the ``n`` best-scored negatives of its group whose length is within
    ``tolerance`` of its own, or, where fewer are, among the 3 n (10 at least) of nearest length. Positives that get one
    or none are left out.

    Positives of one length have the same negatives, so lengths meet, not pairs: a group is one row for each length of a
    positive times the distinct (length, score) it can use, and a length keeps only its ``n`` best.
    """
    most = max(3 * n, 10)
    no = pairs.where(F.col(label) == "no").select(F.col(group).alias("g"), F.col(id_col).alias("neg"), F.col(length).alias("m"), F.col(score).alias("s"))
    # of each (group, length) no choice can take more than the n best by score, or the first `most` by id where lengths tie
    best = no.withColumn("k", F.row_number().over(Window.partitionBy("g", "m").orderBy(F.desc("s"), "neg"))).withColumn("j", F.row_number().over(Window.partitionBy("g", "m").orderBy("neg")))
    best = best.where((F.col("k") <= n) | (F.col("j") <= most))
    sizes = no.groupBy("g", "m").agg(F.count("*").alias("here"))
    wanted = pairs.where(F.col(label) == "yes").select(F.col(group).alias("g"), F.col(length).alias("l")).distinct()
    near = F.col("m").between(F.col("l") * (1 - tolerance), F.col("l") * (1 + tolerance))
    counts = wanted.join(sizes, "g").where(near).groupBy("g", "l").agg(F.sum("here").alias("fit"))
    met = wanted.join(counts, ["g", "l"], "left").join(best, "g")
    enough = F.coalesce("fit", F.lit(0)) >= n
    inside = met.where(enough & near & (F.col("k") <= n))
    nearest = met.where(~enough & (F.col("j") <= most)).withColumn("r", F.row_number().over(Window.partitionBy("g", "l").orderBy(F.abs(F.col("m") - F.col("l")), "neg"))).where(F.col("r") <= most).drop("r")
    ranked = inside.unionByName(nearest).withColumn("r", F.row_number().over(Window.partitionBy("g", "l").orderBy(F.desc("s"), "neg"))).where(F.col("r") <= n)
    lists = ranked.groupBy("g", "l").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "neg"))), lambda x: x["neg"]).alias("negatives")).where(F.size("negatives") > 1)
    positives = pairs.where(F.col(label) == "yes").select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(length).alias("l"))
    return positives.join(lists, ["g", "l"]).select(F.col("g").alias(group), F.col("id").alias(id_col), "negatives")


def positive_weight(rows: DataFrame, positive: Column) -> DataFrame:
    """(weight): negatives for each positive; one where there is none."""
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(positive.cast("int")), F.lit(0)).alias("p"))
    return counts.select(F.when(F.col("p") == 0, 1.0).otherwise((F.col("n") - F.col("p")) / F.col("p")).alias("weight"))


def stratified_split(rows: DataFrame, label: str, id_col: str, test: float = 0.1, val: float = 0.15) -> DataFrame:
    """All columns and ``fold``: an exact share of every label goes to test and val, by a hash of the id."""
    cut = lambda share: F.round(F.col("__n") * share)
    fold = F.when(F.col("__place") <= cut(test), "test").when(F.col("__place") <= cut(test) + cut(val), "val").otherwise("train")
    return placed_by_hash(rows, label, id_col).select(*rows.columns, fold.alias("fold"))


def cached_ranks(cache: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """(query, rank, item): cached ranks of the items that still exist, numbered anew without gaps. Of equal ranks the smaller
    item goes first; items without a rank go last."""
    known = cache.join(items, "item", "left_semi")
    return known.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.asc_nulls_last("rank"), "item"))).where(F.col("k") <= top).select("query", F.col("k").alias("rank"), "item")


def contrast_pairs(centroids: DataFrame, top: int = 8) -> DataFrame:
    """(a, b, distance): the pairs of cluster centres farthest apart by cosine; as many rows as there are clusters meet."""
    a, b = centroids.alias("a"), centroids.alias("b")
    pairs = a.join(b, F.col("a.label") < F.col("b.label")).select(F.col("a.label").alias("a"), F.col("b.label").alias("b"), F.round(1 - T.cosine(F.col("a.centre"), F.col("b.centre")), 9).alias("distance"))
    return pairs.orderBy(F.desc("distance"), "a", "b").limit(top)


def binary_drop(rows: DataFrame, id_col: str, group: str, value: str, strategy: str) -> DataFrame:
    """(id, strategy, score): 1 where a worsened row scores below the mean of its originals."""
    original = rows.where(F.lower(group) == "original").groupBy(id_col).agg(F.avg(value).alias("__o"))
    worse = rows.where(F.lower(group) == "worse_obvious").where(F.col(value).isNotNull())
    return worse.join(original, id_col).where("__o is not null").select(id_col, strategy, F.when(F.col(value) < F.col("__o"), 1.0).otherwise(0.0).alias("score"))


def rank_relevance(scores: DataFrame, key: str, score: str) -> DataFrame:
    """(key, rank, rel): the best score of each key, ranked over all keys; relevance falls with the rank. Keys are metrics or
    classes: tens of rows."""
    best = scores.groupBy(key).agg(F.max(score).alias("best"))
    rank = F.row_number().over(Window.orderBy(F.desc("best"), key))
    return best.select(key, rank.alias("rank"), (1 / rank).alias("rel"))


def run_statistics(times: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, std, half, p25, p50, p75, kept): the 95 % half-width of the mean and what is left inside the fences."""
    quart = times.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    wide = quart.select(key, "n", "mean", "std", (1.96 * F.col("std") / F.sqrt("n")).alias("half"), *(F.col("q")[i].alias(c) for i, c in enumerate(("p25", "p50", "p75"))))
    spread = 1.5 * (F.col("p75") - F.col("p25"))
    kept = times.select(F.col(key), F.col(value).alias("__v")).join(F.broadcast(wide.select(key, "p25", "p75")), key).where(F.col("__v").between(F.col("p25") - spread, F.col("p75") + spread))
    return wide.join(kept.groupBy(key).agg(F.count("*").alias("kept")), key, "left")


def linear_fit(rows: DataFrame, x: tuple[str, ...], y: str, ridge: float = 0.0, digits: int = 6) -> DataFrame:
    """(name, coefficient) of a least-squares fit with an intercept, with a ridge penalty on the sums where one is given.

    The moments are one aggregation over the table; the small system of equations is solved on the driver.
    """
    import numpy as np

    names = ["intercept", *x]
    columns = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    sums = [F.sum(columns[i] * columns[j]).alias(f"m{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    targets = [F.sum(c * F.col(y).cast("double")).alias(f"t{i}") for i, c in enumerate(columns)]
    row = rows.dropna(subset=[*x, y]).agg(*sums, *targets).first()
    n = len(names)
    moments, right = np.zeros((n, n)), np.zeros(n)
    for i in range(n):
        right[i] = row[f"t{i}"] or 0.0
        for j in range(i, n):
            moments[i, j] = moments[j, i] = row[f"m{i}_{j}"] or 0.0
    penalty = np.diag([0.0, *[ridge] * len(x)])
    solved = np.linalg.lstsq(moments + penalty, right, rcond=None)[0]
    return rows.sparkSession.createDataFrame([(name, round(float(c), digits)) for name, c in zip(names, solved, strict=True)], "name string, coefficient double")


def moments(rows: DataFrame, x: tuple[str, ...], y: str) -> tuple[int, dict[str, float], dict[tuple[str, str], float]]:
    """Count, means and centred products of the columns, in one aggregation; rows with a null are left out."""
    names = (*x, y)
    products = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = rows.dropna(subset=list(names)).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in names), *(F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in products)).first()
    centred = {}
    for a, b in products:
        centred[a, b] = centred[b, a] = (row[f"c_{a}_{b}"] or 0.0) * row["n"]
    return row["n"], {c: row[f"m_{c}"] or 0.0 for c in names}, centred


def budget_fit(rows: DataFrame, x: tuple[str, ...], y: str, keep: int, digits: int = 6) -> DataFrame:
    """(name, coefficient): of a fit on standardized columns the ``keep`` greatest stay and are fitted anew, on a scale of
    their own."""
    import numpy as np

    n, _, centred = moments(rows, x, y)

    def fit(names: tuple[str, ...]) -> dict[str, float]:
        scale = {c: (centred[c, c] / n) ** 0.5 or 1.0 for c in names}
        left = np.array([[centred[a, b] / (scale[a] * scale[b]) for b in names] for a in names])
        right = np.array([centred[a, y] / scale[a] for a in names])
        return dict(zip(names, np.linalg.lstsq(left, right, rcond=None)[0].tolist(), strict=True))

    first = fit(x)
    chosen = tuple(sorted(sorted(x, key=lambda c: (-abs(first[c]), c))[:keep]))
    return rows.sparkSession.createDataFrame([(c, round(v, digits)) for c, v in fit(chosen).items()], "name string, coefficient double")


def partial_least_squares(rows: DataFrame, x: tuple[str, ...], y: str, components: int = 1, digits: int = 6) -> DataFrame:
    """(name, coefficient) of partial least squares on centred columns, from their moments alone."""
    import numpy as np

    _, _, centred = moments(rows, x, y)
    covariance = np.array([[centred[a, b] for b in x] for a in x])
    target = np.array([centred[a, y] for a in x])
    weights, loads, answers, left, right = [], [], [], covariance.copy(), target.copy()
    for _ in range(min(components, len(x))):
        if not np.linalg.norm(right):
            break
        w = right / np.linalg.norm(right)
        size = w @ left @ w
        load, answer = left @ w / size, right @ w / size
        weights.append(w)
        loads.append(load)
        answers.append(answer)
        left = left - size * np.outer(load, load)
        right = right - size * answer * load
    w, p = np.array(weights).T, np.array(loads).T
    found = w @ np.linalg.solve(p.T @ w, np.array(answers)) if weights else np.zeros(len(x))
    return rows.sparkSession.createDataFrame([(c, round(float(v), digits)) for c, v in zip(x, found, strict=True)], "name string, coefficient double")


def forest(rows: DataFrame, x: tuple[str, ...], y: str, boosted: bool = False, seed: int = 42) -> DataFrame:
    """All columns and ``prediction`` of the library's random forest or boosted trees."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    ready = VectorAssembler(inputCols=list(x), outputCol="__x", handleInvalid="skip").transform(rows.dropna(subset=[y]))
    kind = GBTRegressor(featuresCol="__x", labelCol=y, maxIter=10, seed=seed) if boosted else RandomForestRegressor(featuresCol="__x", labelCol=y, numTrees=20, seed=seed)
    return kind.fit(ready).transform(ready).drop("__x")


def best_metrics(rows: DataFrame, metrics: tuple[str, ...], target: str, keep: int) -> list[str]:
    """The metrics of greatest correlation with the target."""
    row = rows.agg(*(F.abs(F.corr(c, target)).alias(c) for c in metrics)).first()
    return sorted(metrics, key=lambda c: (-round(row[c] or 0.0, 9), c))[:keep]
