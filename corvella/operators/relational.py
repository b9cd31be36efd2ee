"""Relational shapes: joins with defaults, upserts, aggregations, pivots, windows and pages of results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return top_n(df, keys, order, 1)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """At most ``n`` rows a key; Spark limits each partition before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old_if_null: Sequence[str] = ()) -> DataFrame:
    """New rows replace old ones of their key; columns named last keep the old value where the new one is null."""
    values = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in values), F.lit(True).alias("__is_new"))
    both = old.withColumn("__is_old", F.lit(True)).join(fresh, list(keys), "full")
    pick = lambda c: F.coalesce(f"__new_{c}", c) if c in keep_old_if_null else F.when(F.col("__is_new"), F.col(f"__new_{c}")).otherwise(F.col(c))
    return both.select(*keys, *(pick(c).alias(c) for c in values))


def append_replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key was not computed again, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    total = F.sum(weight)
    return df.groupBy(*keys).agg(F.when(total == 0, 0.0).otherwise(F.sum(F.col(value) * F.col(weight)) / total).alias(name))


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, sum, mean, median, maximum and ninetieth percentile."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.median(value).alias("median"),
        F.max(value).alias("largest"),
        F.percentile(value, 0.9).alias("p90"),
    )


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Counts with one column a value; named values spare a pass over the data."""
    return df.groupBy(rows).pivot(columns, list(values)).count().na.fill(0)


def within_iqr(df: DataFrame, keys: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    """Rows between the quartiles widened by k times their distance."""
    bounds = df.groupBy(*keys).agg(F.percentile(value, 0.25).alias("__q1"), F.percentile(value, 0.75).alias("__q3"))
    spread = k * (F.col("__q3") - F.col("__q1"))
    return df.join(bounds, list(keys)).where(F.col(value).between(F.col("__q1") - spread, F.col("__q3") + spread)).drop("__q1", "__q3")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered result with the number of pages; offset and limit need no global window."""
    pages = df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("total_pages"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(pages))


def placed_by_hash(df: DataFrame, label: str, id_col: str) -> DataFrame:
    """All columns, ``__place`` (from 1) of each row within its label in the order of its id's hash, and ``__n`` of the label.

    Rows are counted in 2**16 ranges of the hash before any is ranked, so a label of a third of all rows is ranked in as
    many tasks as there are ranges.
    """
    hashed = df.withColumn("__h", F.md5(F.col(id_col).cast("string"))).withColumn("__r", F.substring("__h", 1, 4))
    sizes = hashed.groupBy(label, "__r").agg(F.count("*").alias("c"))
    w = Window.partitionBy(label).orderBy("__r")
    before = sizes.select(F.col(label).alias("__l"), F.col("__r").alias("__s"), (F.sum("c").over(w) - F.col("c")).alias("__before"), F.sum("c").over(Window.partitionBy(label)).alias("__n"))
    met = hashed.join(before, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__r") == F.col("__s")))
    place = F.col("__before") + F.row_number().over(Window.partitionBy(label, "__r").orderBy("__h", id_col))
    return met.select(*df.columns, place.alias("__place"), "__n")


def balance(df: DataFrame, label: str, id_col: str) -> DataFrame:
    """Each class cut to the size of the smallest, in the order of a hash of the id."""
    least = df.groupBy(label).count().agg(F.min("count").alias("__least"))
    return placed_by_hash(df, label, id_col).crossJoin(F.broadcast(least)).where("__place <= __least").select(*df.columns)


def min_max(df: DataFrame, keys: Sequence[str], value: str, name: str, constant: float = 0.0) -> DataFrame:
    """The bounds are aggregated and joined, so a key of very many rows is gathered nowhere."""
    bounds = df.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    met = df.alias("d").join(bounds.alias("b"), [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    scaled = F.when(F.col("__high") == F.col("__low"), constant).otherwise((F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low")))
    return met.select("d.*", scaled.alias(name))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Extension: each left row with the last right values at or before its time, by one window over the union."""
    a = left.select("*", *(F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values), F.lit(1).alias("__side"))
    b = right.select(*keys, time, *(F.col(v).alias(f"__{v}") for v in values), F.lit(0).alias("__side"))
    w = Window.partitionBy(*keys).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True)
    for v in values:
        both = both.withColumn(f"__{v}", F.last(f"__{v}", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*left.columns, *(F.col(f"__{v}").alias(v) for v in values))


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Extension: points within ranges, met by equal cells of ``width`` instead of a comparison of all pairs."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = ranges.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("__cell", cell(value)).join(spread, "__cell").where(F.col(value).between(F.col(low), F.col(high))).drop("__cell")
