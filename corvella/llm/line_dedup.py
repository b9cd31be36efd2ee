"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.session import remove, scratch_path, shuffle_partitions

#: What a key loses at both ends.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many of the most frequent keys are joined by broadcast; the bound holds at every size.
HOT_KEYS = 1000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """128 bits as two longs: one would collide within some billions of lines."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


class RunStore:
    """Sorted runs of (h1, h2, n, keeper), bucketed by hash so that merging with them moves only the new batch.

    Level 0 takes one run a batch; ``fanout`` runs of a level are compacted into one of the next, so each hash is
    rewritten a logarithmic number of times. Runs lie in the shared folder: losing executors loses none.
    """

    def __init__(self, spark, fanout: int = 3):
        self.spark, self.fanout, self.buckets = spark, fanout, shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, name)
        run = run.repartition(self.buckets, "h1", "h2")  # a task writes one bucket
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).saveAsTable(name)
        return name

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def merged(self, names: list[str]) -> DataFrame:
        """One row a hash over some runs. They are read as files: a union of bucketed tables may pass for one that has
        each hash in one partition, which it has not where the planner reads a table without its buckets."""
        rows = self.spark.read.schema("h1 long, h2 long, n long, keeper long").parquet(*(self.paths[n] for n in names))
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """``batch`` has one row a hash. Hashes that no run holds keep the batch's keeper; those that one holds only count."""
        run = batch
        for name in self.names():
            run = run.join(self.spark.table(name).select("h1", "h2", F.lit(True).alias("held")).hint("merge"), ["h1", "h2"], "left")
            run = run.withColumn("keeper", F.when(F.col("held").isNull(), F.col("keeper"))).drop("held")
        self._push(0, self._write(run))

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(self.merged(full)))
            self._drop(full)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Drop all runs, files included."""
        self._drop(self.names())
        self.levels = []


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 3, fanout: int = 3) -> DataFrame:
    """Drop lines whose key stands in ``min_docs`` documents or more, except in the largest id that holds it.

    Result: the columns of ``docs`` with the kept text in ``text_col``, and ``n_lines`` and ``n_dropped``.

    The ids, from the largest down, fall into ``batches`` ranges of about as many rows. Each batch's line hashes are
    merge-anti-joined with the sorted runs of the batches before: a hash that no run holds is new and names its
    keeper; the batch then becomes a run of its own. The compacted runs say which keys reach ``min_docs``. At most
    ``HOT_KEYS`` of the most frequent keys meet their lines by broadcast, all others by a shuffle that carries hashes.

    A line travels as its place and its hash; the places that a row loses come back to it as one list, and the time to
    take them out grows with the row's lines alone, however many it loses.

    A null or empty text is one empty line. Rows with one id are one document when documents are counted; each row
    loses its own lines, repeated rows alike. Rows with a null id lose nothing and count for nothing. Columns named like the
    added ones are replaced. An empty table gives no rows. The runs are deleted at the end; the hashes stay in the shared
    folder for as long as the result may be read.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / batches for i in range(1, batches)], 1000).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    batch = sum((F.when(F.col("id") <= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    hashes = F.transform(F.transform(F.split(text, "\n"), line_key), lambda k: F.when(F.length(k) >= min_chars, key_hash(k)))
    at = scratch_path(spark, "lines")
    mark = F.xxhash64(text)
    # hashed before they are exploded: an expression beside a generator is worked out for each of its rows
    hashed = docs.select(F.col(id_col).cast("long").alias("id"), mark.alias("mark"), hashes.alias("hs"))
    placed = hashed.select("id", "mark", F.posexplode("hs").alias("pos", "h")).where("id is not null and h is not null")
    placed.select("id", "mark", "pos", "h.h1", "h.h2", batch.alias("batch")).write.partitionBy("batch").parquet(at)
    lines = spark.read.schema("id long, mark long, pos int, h1 long, h2 long, batch int").parquet(at)
    store = RunStore(spark, fanout)
    for k in range(len(cuts) + 1):
        own = lines.where(F.col("batch") == k).groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
        store.add(own.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")))
    known = store.merged(store.names()).where(F.col("n") >= min_docs)
    common = scratch_path(spark, "common-lines")
    known.write.parquet(common)
    known = spark.read.schema(known.schema).parquet(common)
    store.close()
    hot = known.orderBy(F.desc("n"), "h1", "h2").limit(HOT_KEYS)
    cold = known.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    lines = lines.drop("batch")
    of_hot = lines.join(F.broadcast(hot), ["h1", "h2"]).where("id < keeper")
    rest = lines.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    of_cold = rest.join(cold, ["h1", "h2"]).where("id < keeper")
    drops = of_hot.unionByName(of_cold).groupBy("id", "mark").agg(F.collect_set("pos").alias("__drops")).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "__drops")
    rest = [c for c in docs.columns if c != text_col]
    # split before the join: what a lambda reads must be a column, or it is split again for each line
    split = docs.select(*rest, F.split(text, "\n").alias("__lines"), mark.alias("__own_mark"))
    joined = split.join(drops, (F.col(id_col).cast("long") == F.col("__id")) & (F.col("__own_mark") == F.col("__mark")), "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drops"))
    kept = F.when(F.col("__drops").isNull(), F.col("__lines")).otherwise(F.transform(stays, lambda place: F.col("__lines")[place]))
    shaped = {text_col: F.array_join(kept, "\n")}
    dropped = F.when(F.col("__drops").isNull(), 0).otherwise(F.size("__drops"))
    return joined.select(*[shaped.get(c, F.col(c)).alias(c) for c in docs.columns], F.size("__lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
