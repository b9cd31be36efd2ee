"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, verification on full n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.session import materialize

from ._text import ODD, list_array, mix, pieces, run_hashes, small_batches, tidied, utf8, words
from .components import connected_components
from .order_minhash import multipliers

#: Hash functions at most, and the share of pairs at the threshold that banding must find.
HASHES, RECALL = 128, 0.9999
#: Members of a candidate group that meet in one task, a block against itself or another, and their n-grams: 8 bytes each.
BLOCK, BLOCK_GRAMS = 192, 1 << 20


def banding(threshold: float, hashes: int = HASHES, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which pairs at the threshold collide with chance ``recall``."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit n-gram hashes of every document, one after the other, and their counts.

    Words are runs without ASCII white space. A document of fewer than n words has one n-gram, all of its words; one
    without words has none.
    """
    rows = len(offsets) - 1
    at, to = words_within(flat, offsets)
    owner = np.searchsorted(offsets, at, side="right") - 1
    hashes = run_hashes(flat, at, to)
    count = np.bincount(owner, minlength=rows)
    first = np.cumsum(count) - count
    reach = np.arange(len(hashes)) - first[owner]
    grams = np.zeros(len(hashes), dtype=np.uint64)
    padded = np.concatenate([hashes, np.zeros(n, dtype=np.uint64)])
    for j in range(n):
        inside = reach + j < count[owner]
        grams = mix(grams * np.uint64(0xF1357AEA2E62A9C5) + np.where(inside, padded[j : j + len(hashes)], ODD))
    kept = (reach + n <= count[owner]) | ((reach == 0) & (count[owner] < n))
    grams, owner = grams[kept], owner[kept]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[fresh], np.bincount(owner[fresh], minlength=rows)


def words_within(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that end at the ends of their documents."""
    at, to = words(flat)
    if not len(at):
        return at, to
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(flat))]
    hit = np.searchsorted(at, inner, side="right") - 1
    cut = inner[(hit >= 0) & (inner > at[hit]) & (inner < to[hit])]
    return np.sort(np.concatenate([at, np.unique(cut)])), np.sort(np.concatenate([to, np.unique(cut)]))


def band_hashes(grams: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents with n-grams, bands) 64-bit hashes of each band's minima."""
    filled = counts[counts > 0]
    starts = np.cumsum(filled) - filled
    low = (grams >> np.uint64(32)).astype(np.uint32)
    factors, masks = multipliers(bands * rows)
    out = np.empty((len(filled), bands), dtype=np.uint64)
    for band in range(bands):
        total = np.full(len(filled), band + 1, dtype=np.uint64) * ODD
        for row in range(rows):
            k = band * rows + row
            least = np.minimum.reduceat((low ^ masks[k]) * factors[k], starts)
            total = mix(total * np.uint64(0xF1357AEA2E62A9C5) + least)
        out[:, band] = total
    return out


def _set_key(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each n-gram set."""
    keys = []
    for salt in (1, 2):
        mixed = mix(grams ^ mix(np.array([salt], dtype=np.uint64)))
        total = np.concatenate(([np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)))
        ends = np.cumsum(counts)
        keys.append(mix(total[ends] - total[ends - counts] + counts.astype(np.uint64) * ODD).view(np.int64))
    return keys[0], keys[1]


def _links(sets: list[np.ndarray], bands: np.ndarray, weight: np.ndarray, split: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of the members of one or two blocks: how many documents each member links to, and a member
    that each hangs on (the least index it reaches in this task). With ``split`` only pairs across it count."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    vocabulary, spread = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    # only n-grams of two members or more can be shared
    common = np.bincount(spread, minlength=len(vocabulary)) > 1
    kept = common[spread]
    column = (np.cumsum(common) - 1)[spread[kept]]
    shared = np.zeros((n, n), dtype=np.float32)
    wide, rows = int(common.sum()), owner[kept]
    order = np.argsort(column, kind="stable")
    column, rows = column[order], rows[order]
    for first in range(0, wide, 8192):
        a, b = np.searchsorted(column, (first, first + 8192))
        grid = np.zeros((n, min(8192, wide - first)), dtype=np.float32)
        grid[rows[a:b], column[a:b] - first] = 1
        shared += grid @ grid.T
    union = sizes[:, None] + sizes[None, :] - shared
    linked = shared >= threshold * union - 1e-6
    collide = np.zeros((n, n), dtype=bool)
    for j in range(bands.shape[1]):
        collide |= bands[:, j][:, None] == bands[:, j][None, :]
    linked &= collide
    np.fill_diagonal(linked, False)
    if split:
        linked[:split, :split] = False
        linked[split:, split:] = False
    root = np.arange(n)
    while True:  # labels fall along links until they rest
        reached = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1, initial=n))
        reached = reached[reached]
        if (reached == root).all():
            return linked @ weight, root
        root = reached


def jaccard_join(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", hashes: int = HASHES, recall: float = RECALL) -> DataFrame:
    """Classes of documents whose word n-gram sets have a Jaccard index of ``threshold`` or more.

    Result, a row for each id: the id, class_id (the least id of its class), n_links (other documents it is linked
    to, copies included) and n_grams.

    1. Each text becomes its n-gram set's key and band hashes. Documents of one set are one representative, their
       least id, with a weight.
    2. Representatives are shuffled on their band hashes; each hangs on the least of its bucket. The components of
       these candidate links are candidate groups.
    3. A group's members fall into blocks of about ``BLOCK`` members and ``BLOCK_GRAMS`` n-grams; every pair of blocks is
       verified in a task of its own, on full sets, for the pairs that share a band. A task sends a row a member, not its pairs, so a group of m
       costs m rows for each of its m / BLOCK blocks.
    4. The components of the verified links are the classes.

    Null and empty texts, and texts of white space, are copies of each other. A text of fewer than n words is one
    n-gram. Rows of one id are one document, the text of the first set key; its other texts take no part, and neither do
    rows with a null id. Pairs at the threshold are found with chance ``recall`` or more. Very long texts make blocks of
    their own. Other columns, clashing names among them, are not read. An empty table gives no rows.
    """
    bands, rows = banding(threshold, hashes, recall)

    @tidied
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets):
                grams, counts = shingle_sets(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                h1, h2 = _set_key(grams, counts)
                signed = band_hashes(grams, counts, bands, rows).view(np.int64) if len(grams) else np.empty((0, bands), np.int64)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(h1), pa.array(h2), pa.array(counts.astype(np.int32)), list_array(signed.ravel(), np.where(counts > 0, bands, 0), pa.int64())],
                    names=["id", "mark", "h1", "h2", "n_grams", "bands"],
                )

    source = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("mark")).where("id is not null")
    drawn = materialize(source.mapInArrow(sketch, "id long, mark long, h1 long, h2 long, n_grams int, bands array<long>"), "sketches")
    # of the rows of one id, the text of the least set key (of equal sets, of the least mark) is the document
    member = drawn.groupBy("id").agg(F.min(F.struct("h1", "h2", "mark", "n_grams")).alias("s")).select("id", "s.*")
    of_set = member.groupBy("h1", "h2").agg(F.min(F.struct("id", "mark")).alias("s"), F.count("*").alias("copies")).select("h1", "h2", F.col("s.id").alias("rep"), F.col("s.mark").alias("rep_mark"), "copies")
    chosen = (drawn["id"] == of_set["rep"]) & (drawn["mark"] == of_set["rep_mark"])
    reps = drawn.drop("h1", "h2").join(of_set, chosen).select("rep", "rep_mark", "copies", "n_grams", "bands").dropDuplicates(["rep"])
    reps = materialize(reps, "representatives")

    hung = reps.select("rep", F.posexplode("bands").alias("band", "h"))
    # written, so that the join below shuffles both sides for itself and a bucket of very many can be split
    least = materialize(hung.groupBy("band", "h").agg(F.min("rep").alias("b"), F.count("*").alias("m")).where("m > 1").drop("m"), "buckets")
    candidates = hung.join(least, ["band", "h"]).select(F.col("rep").alias("a"), "b").where("a <> b").distinct()
    groups = connected_components(candidates)
    grouped = groups.join(reps, groups["node"] == reps["rep"]).drop("node")
    sizes = grouped.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    placed = grouped.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    text_of = source.join(placed, (source["id"] == placed["rep"]) & (source["mark"] == placed["rep_mark"])).select("rep", "root", "blocks", "block", "copies", "bands", "text")

    @tidied
    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(6))
            for a, b in pieces(offsets):
                grams, counts = shingle_sets(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                ends = np.cumsum(counts) * 8
                raw = grams.tobytes()
                part = batch.slice(a, b - a)
                yield pa.record_batch([*part.columns[:6], pa.array([raw[e - 8 * c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())], names=["rep", "root", "blocks", "block", "copies", "bands", "grams"])

    sets = text_of.mapInArrow(full_sets, "rep long, root long, blocks int, block int, copies long, bands array<long>, grams binary").dropDuplicates(["rep"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.select("*", other.alias("other")).select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def verify(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "rep"], kind="stable")
        reps_here = group["rep"].to_numpy()
        got = [np.frombuffer(g, dtype=np.uint64) for g in group["grams"]]
        split = int((group["block"] == key[1]).sum()) if key[1] != key[2] else 0
        links, root = _links(got, np.stack(group["bands"].to_numpy()), group["copies"].to_numpy(), split, threshold)
        return pd.DataFrame({"rep": reps_here, "links": links.astype(np.int64), "hang": reps_here[root]})

    checked = dealt.groupBy("root", "lo", "hi").applyInPandas(verify, "rep long, links long, hang long")
    checked = materialize(checked.where("links > 0"), "links")
    classes = connected_components(checked.select(F.col("rep").alias("a"), F.col("hang").alias("b")))
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    found = of_set.join(classes, of_set["rep"] == classes["node"], "left").join(links, "rep", "left")
    found = found.select("h1", "h2", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    # written, so that the copies of one set, however many, meet their class in a join that can be split
    return member.join(materialize(found, "classes"), ["h1", "h2"]).select(F.col("id").alias(id_col), "class_id", "n_links", "n_grams")
