"""Order MinHash fingerprints: likeness that follows edit distance, not only the set of k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.session import shuffle_partitions

from ._text import ODD, mix, small_batches, tidied

K, PARTS, PICKED = 8, 64, 2
#: Hashes that are ordered at a time.
TOGETHER = 200_000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def kmer_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash at each place of a k-mer; a shorter text is one k-mer."""
    if len(points) < k:
        points = np.concatenate([points, np.full(k - len(points), 0xFFFFFFFF, dtype=np.uint32)])
    # runs of powers of two, each of two runs of half its length, and k's own run of those
    have, width, total, done = mix(points.astype(np.uint64) + ODD), 1, None, 0
    while True:
        if k & width:
            if total is None:
                total, done = have, width
            else:
                n = len(points) - done - width + 1
                total, done = total[:n] * _power(width) + have[done : done + n], done + width
        if done == k:
            return mix(total)
        n = len(have) - width
        have, width = have[:n] * _power(width) + have[width : width + n], 2 * width


def _power(exponent: int) -> np.uint64:
    return np.uint64(pow(0xF1357AEA2E62A9C5, exponent, 1 << 64))


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Each k-mer's hash with how often the same k-mer stands before it: repeated k-mers become distinct elements."""
    n = len(hashes)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    keyed = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))
    group, at = keyed >> bits, (keyed & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    count = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    out = np.empty(n, dtype=np.uint64)
    out[at] = count
    again = out > 0
    result = hashes.copy()
    result[again] = mix(hashes[again] + out[again] * ODD)
    return result


def multipliers(parts: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * parts + 1, dtype=np.uint64) * ODD)
    return (seeds[:parts] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[parts:] >> np.uint64(32)).astype(np.uint32)


def signature(text: str, k: int = K, parts: int = PARTS, picked: int = PICKED) -> np.ndarray:
    """``parts`` hashes. For each part's order of the numbered k-mers the ``picked`` least are taken, put back into
    the order of the text and hashed as a tuple; a text with fewer gives all of its own. The empty text gives zeros."""
    if not text:
        return np.zeros(parts, dtype=np.uint32)
    plain = kmer_hashes(code_points(text), k)
    elements = (numbered(plain) >> np.uint64(32)).astype(np.uint32)
    picked = min(picked, len(elements))
    tuples = np.empty((parts, picked), dtype=np.int64)
    factors, masks = multipliers(parts)
    top = np.uint32(0xFFFFFFFF)
    together = max(1, TOGETHER // len(elements))  # parts side by side: a short text costs few calls
    for first in range(0, parts, together):
        order = (elements[None, :] ^ masks[first : first + together, None]) * factors[first : first + together, None]
        row = np.arange(len(order))
        for j in range(picked):
            least = order.argmin(axis=1)
            tuples[first : first + together, j] = least
            order[row, least] = top
    tuples.sort(axis=1)
    total = np.zeros(parts, dtype=np.uint64)
    for j in range(picked):
        total = mix(total * np.uint64(0xF1357AEA2E62A9C5) + plain[tuples[:, j]])
    return (total >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str | None) -> str:
    """The last quarter replaced by the first as many code points of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + (following or "")[:cut]


def with_following(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, guard, id, text) in ranges of ids: each range is followed by a copy of the next range's first row,
    marked ``guard``; the last range by the table's first row. Only the cuts between ranges reach the driver, one a
    partition. Null texts are empty and null ids come first; rows of one id stay in one range, so an id that holds a third of
    all rows makes a long range, which is read as a stream. An empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = shuffle_partitions(spark)
    cuts = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 20 * parts).alias("c")).first()["c"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    part: Column = F.coalesce(F.when(F.col("id").isNull(), 0).otherwise(_bucket(F.col("id"), cuts)), F.lit(0))
    starts = rows.select("id", part.alias("part")).groupBy("part").agg(F.min("id").alias("least"), F.max(F.col("id").isNull().cast("int")).alias("nulls")).orderBy("part").collect()
    if not starts:
        return rows.select(F.lit(0).alias("part"), F.lit(False).alias("guard"), "id", "text")
    sends, leasts = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for k, row in enumerate(starts):
        sends[row["part"]], leasts[row["part"]] = starts[k - 1]["part"], row["least"] or 0
    own = rows.withColumn("part", part)
    # null ids are all in the first part and lead it
    first = F.when(F.lit(bool(starts[0]["nulls"])) & (F.col("part") == 0), F.col("id").isNull()).otherwise(F.col("id") == F.lit(leasts)[F.col("part")])
    stay = F.struct(F.lit(False).alias("guard"), F.col("part").alias("p"))
    both = own.withColumn("to", F.when(first, F.array(stay, F.struct(F.lit(True).alias("guard"), F.lit(sends)[F.col("part")].alias("p")))).otherwise(F.array(stay)))
    spread = both.select(F.explode("to").alias("to"), "id", "text").select(F.col("to.p").alias("part"), F.col("to.guard").alias("guard"), "id", "text")
    return spread.repartition(parts, "part").sortWithinPartitions("part", "guard", "id", "text")


def _bucket(value: Column, cuts: list[int]) -> Column:
    """How many cuts are at most ``value``: a binary search in one array, whatever its length."""
    if not cuts:
        return F.lit(0)
    known = F.lit(cuts)

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        open_, above = at["low"] < at["high"], known[F.least(middle, F.lit(len(cuts) - 1))] <= value
        return F.struct(F.when(open_ & above, middle + 1).otherwise(at["low"]).alias("low"), F.when(open_ & ~above, middle).otherwise(at["high"]).alias("high"))

    begin = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), begin, halve, lambda at: at["low"])


def fingerprint_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, parts: int = PARTS, picked: int = PICKED) -> DataFrame:
    """Fingerprint every text, its edited text and compare both with the text and its follower.

    Result: the id, n_chars, edited (text), fingerprint and edited_fingerprint (hex, 8 digits a part), near_edited and
    near_next (share of equal parts). The follower is the row with the next id; the last row's is the first. Rows of
    one id follow each other by text; rows with a null id come first.

    Null texts are empty. Two empty texts are alike in full; an empty and another text not at all. A table of one row
    follows itself; an empty table gives no rows. Texts move once, to ranges of ids; a range is read as a stream, one
    text and its follower at a time.
    """
    names = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out, held = None, [[] for _ in names], 0

        def compare(row, following):
            text, mine, theirs = row[2], row[4], following[4]
            changed = edited(text, following[2])
            own = signature(changed, k, parts, picked) if changed != text else mine
            return row[1], len(text), changed, mine.astype(">u4").tobytes().hex(), own.astype(">u4").tobytes().hex(), likeness(mine, own), likeness(mine, theirs)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for part, guard, key, text in zip(*columns, strict=True):
                if before is not None and before[0] != part:
                    before = None
                if guard and before is None:
                    continue
                row = (part, key, text, guard, signature(text, k, parts, picked))
                if before is not None:
                    for column, value in zip(out, compare(before, row), strict=True):
                        column.append(value)
                    held += len(before[2])
                before = None if guard else row
                if held > 4 << 20:
                    yield pa.record_batch([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=names)
                    out, held = [[] for _ in names], 0
        if out[0]:
            yield pa.record_batch([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=names)

    small_batches(docs)
    schema = "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_following(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
