"""Exact top-k by inner product in three phases with a uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.session import materialize

#: Queries that one pass answers; their vectors and cutoffs are all that is broadcast.
QUERY_BLOCK = 4096
#: Score lists that a vector's components are split into.
LISTS = 2
#: Candidates scored at a time.
ROWS = 2048
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1


def quantized(column: pa.Array, width: int | None = None, scale: float = 1024.0) -> np.ndarray:
    """floor(scale * x) of every component as double; rows shorter than the widest end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = max(int(lengths.max(initial=0)), width or 0)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows: in doubles where these are exact, else in Python's integers; beyond a long
    they stand at its ends."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in a], dtype=object) @ np.array([[int(x) for x in row] for row in b], dtype=object).T
    return np.clip(whole, LEAST // LISTS, MOST // LISTS).astype(np.int64)


def _keep(held: list[np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Merge one query's new scores into its k best, ties to the smaller id."""
    scores, ids = np.concatenate([held[0], scores]), np.concatenate([held[1], ids])
    best = np.lexsort((ids, ~scores))[:k]
    held[0], held[1] = scores[best], ids[best]


def valid(column: str) -> Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & finite, F.lit(False))


def top_k(vectors: DataFrame, queries: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK, lists: int = LISTS) -> DataFrame:
    """The k highest integer inner products of every query row with all other rows: query_id, rank, id and score.

    ``queries`` marks the query rows by their id. Components are floor(1024 * x). A vector's components fall into
    ``lists`` ranges; each range of each split gives a list of partial scores.

    1. Every split takes each list's k best entries and sends their whole scores; the k-th best of all is a score
       that the answer reaches at least.
    2. That cutoff is broadcast. A whole score reaches it only if a partial score reaches its ``lists``-th part, so
       the entries at or above that part are sufficient.
    3. The other parts of those entries are added exactly, and each split keeps its k best by (score, smaller id).

    Queries go in blocks of ``block``, each a pass over the table, so what is broadcast has a bound; several blocks
    are written to the shared folder one by one. Splits send k rows a query at most, however many copies of a vector
    there are. Null vectors and vectors with null or non-finite components take no part; shorter vectors end in zeros;
    a row is no candidate for queries of its own id; repeated rows are candidates each; a repeated query id is one
    query, its least vector. Rows with a null id take no part. Fewer candidates than k are all returned. An empty
    table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null").where(valid("v"))
    asked = rows.where(queries)
    total = asked.count()
    blocks = max(1, -(-total // block))
    done = []
    for b in range(blocks):
        answer, sent = _answer(rows, asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), k, lists)
        if answer is not None and blocks > 1:
            answer = materialize(answer, "topk")
            for broadcast in sent:  # one block's vectors at a time
                broadcast.destroy()
        if answer is not None:
            done.append(answer)
    if not done:
        none = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0).cast("long").alias("score")).where("false")
        return none.withColumnRenamed("id", id_col)
    return reduce(DataFrame.unionByName, done).withColumnRenamed("id", id_col)


def _answer(rows: DataFrame, asked: DataFrame, k: int, lists: int) -> tuple[DataFrame | None, list]:
    """The answers to a block of queries, not yet worked out, and what has been broadcast for them."""
    got = sorted(((r["id"], r["v"]) for r in asked.collect()))
    if not got:
        return None, []
    names, seen = [], []
    for key, vector in got:
        if not names or names[-1] != key:
            names.append(key), seen.append(vector)
    context = rows.sparkSession.sparkContext
    matrix = quantized(pa.array(seen, pa.list_(pa.float64())))
    shared = context.broadcast((np.array(names, dtype=np.int64), matrix))

    def partials(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Ids of some candidates and, for each list, the partial scores (queries x candidates)."""
        _, q = shared.value
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            c = quantized(part.column(1), q.shape[1])
            full = q if c.shape[1] == q.shape[1] else np.hstack([q, np.zeros((len(q), c.shape[1] - q.shape[1]))])
            cuts = np.linspace(0, c.shape[1], lists + 1).astype(int)
            yield part.column(0).to_numpy(zero_copy_only=False), [products(full[:, a:b], c[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def emit(best: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        lengths = [len(b[0]) for b in best]
        if sum(lengths):
            ids = shared.value[0]
            yield pa.record_batch([pa.array(np.repeat(ids, lengths)), pa.array(np.concatenate([b[1] for b in best])), pa.array(np.concatenate([b[0] for b in best]))], names=["query_id", "id", "score"])

    def empty() -> list[list[np.ndarray]]:
        return [[np.empty(0, np.int64), np.empty(0, np.int64)] for _ in shared.value[0]]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = empty()
        for batch in batches:
            for ids, scores in partials(batch):
                whole = sum(scores)
                for j, name in enumerate(shared.value[0]):
                    other = np.flatnonzero(ids != name)
                    if not len(other):
                        continue
                    tops = [other[np.argpartition(-s[j][other], min(k, len(other)) - 1)[:k]] for s in scores]
                    chosen = np.unique(np.concatenate(tops))
                    _keep(best[j], whole[j][chosen], ids[chosen], k)
        yield from emit(best)

    schema = "query_id long, id long, score long"
    local = rows.mapInArrow(gather, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    kth = local.withColumn("rank", place).where(F.col("rank") == k).select("query_id", "score").collect()
    reached = {r["query_id"]: r["score"] for r in kth}
    cutoff = context.broadcast([reached.get(name) for name in names])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = empty()
        for batch in batches:
            for ids, scores in partials(batch):
                for j, name in enumerate(shared.value[0]):
                    least = cutoff.value[j]
                    if least is None:
                        near = np.flatnonzero(ids != name)
                    else:
                        enough = scores[0][j] * lists >= least
                        for s in scores[1:]:
                            enough |= s[j] * lists >= least
                        near = np.flatnonzero(enough & (ids != name))
                    if len(near):
                        whole = sum(s[j][near] for s in scores)
                        keep = slice(None) if least is None else whole >= least
                        _keep(best[j], whole[keep], ids[near][keep], k)
        yield from emit(best)

    found = rows.mapInArrow(resolve, schema)
    answer = found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
    return answer, [shared, cutoff]
