"""Repeated passages by merged Burrows-Wheeler transforms.

A passage is ``length`` bytes. Each window of that many bytes is assigned to the k-mer of least hash in it, so equal
windows have equal k-mers whatever stands around them; neighbouring windows of one k-mer make a *strand*. Strands
whose k-mer occurs in one document only cannot repeat and are left out. Of the others, each shard of the corpus builds
Burrows-Wheeler transforms, one for each range of k-mers; the transforms of a range, from all shards, are merged by interleave
refinement, which gives common prefixes and the intervals of repeated windows without sorting a suffix again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.session import materialize, shuffle_partitions, stable

from ._text import ODD, mix, pieces, small_batches, tidied, utf8

LENGTH, KMER = 50, 20
#: Bits of the filter of shared k-mers that is broadcast: ``KEY_BITS`` a k-mer, but so many at least and at most. It lets
#: k-mers of one document through as it fills, never the reverse, so its size bounds memory and not results.
KEY_BITS, LEAST_BITS, FILTER_BITS = 8, 1 << 27, 1 << 29
#: Bytes of text hashed at a time: places in it fit the low bits of a key.
STRETCH_BITS = 21
FACTOR = np.uint64(0xF1357AEA2E62A9C5)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))
_TABLE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * ODD)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n + 1, dtype=np.uint64)
    done = 1
    while done < n + 1:
        step = min(done, n + 1 - done)
        out[done : done + step] = out[:step] * np.uint64(pow(int(base), done, 1 << 64))
        done += step
    return out


def rolling(flat: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` bytes, composed of runs of powers of two."""
    have, total, at = _TABLE[flat], None, 0
    width, left = 1, size
    while True:
        if left & width:
            if total is None:
                total, at = have, width
            else:
                n = len(flat) - at - width + 1
                total = total[:n] * _power(width) + have[at : at + n]
                at += width
        left &= ~width
        if not left:
            return mix(total[: len(flat) - size + 1])
        n = len(have) - width
        have = have[:n] * _power(width) + have[width : width + n]
        width *= 2


def _power(exponent: int) -> np.uint64:
    return np.uint64(pow(int(FACTOR), exponent, 1 << 64))


class Strands:
    """The strands of some documents: start and windows of each, its k-mer's hash and document."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = KMER):
        self.flat, self.length = flat, length
        spans = [self._stretch(flat, a, b, offsets, length, k) for a, b in self._stretches(offsets, length)]
        kinds = (np.int64, np.uint64, np.int64, np.int64)
        starts, self.key, ends, place = (np.concatenate([s[j] for s in spans]) if spans else np.empty(0, t) for j, t in enumerate(kinds))
        # windows must not cross the end of their document: a strand is cut there
        owner = np.searchsorted(offsets, starts, side="right") - 1
        last = offsets[owner + 1] - length
        windows = np.minimum(ends, last + 1) - starts
        kept = windows > 0
        # least hashes are small ones: mixed again, they fill all ranges alike
        self.start, self.windows, self.key, self.owner = starts[kept], windows[kept], mix(self.key[kept] * ODD), owner[kept]
        self.lead = (place - starts)[kept]  # bytes before the k-mer

    def split(self, hot: np.ndarray) -> None:
        """Divide the strands of ``hot`` k-mers (sorted): windows whose k-mer is ``NEAR`` * j to ``NEAR`` * j + ``NEAR`` - 1
        bytes from their start all hold the ``length`` - ``NEAR`` + 1 bytes that begin ``NEAR`` * j before it, and get the
        hash of these and j as their key. Equal windows have equal keys still."""
        chosen = np.isin(self.key, hot)
        if not chosen.any():
            return
        start, windows, owner, lead = self.start[chosen], self.windows[chosen], self.owner[chosen], self.lead[chosen]
        parts = [(self.start[~chosen], self.windows[~chosen], self.key[~chosen], self.owner[~chosen], self.lead[~chosen])]
        for j in range(int(lead.max()) // NEAR + 1):
            high, low = np.minimum(lead, NEAR * j + NEAR - 1), np.maximum(lead - windows + 1, NEAR * j)
            some = np.flatnonzero(high >= low)
            at, key = (start + lead)[some] - NEAR * j, np.full(len(some), j + 1, dtype=np.uint64)
            for i in range(self.length - NEAR + 1):
                key = key * FACTOR + _TABLE[self.flat[at + i]]
            parts.append(((start + lead - high)[some], (high - low + 1)[some], mix(key * ODD), owner[some], high[some]))
        whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(whole[0], kind="stable")
        self.start, self.windows, self.key, self.owner, self.lead = (x[order] for x in whole)

    @staticmethod
    def _stretches(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
        """Ranges of window starts; a long text is hashed in overlapping stretches."""
        limit = (1 << STRETCH_BITS) - 4 * length
        first = 0
        while first < offsets[-1]:
            yield first, min(first + limit, int(offsets[-1]))
            first += limit

    @staticmethod
    def _stretch(flat: np.ndarray, a: int, b: int, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
        part = flat[a : b + length - 1]
        if len(part) < length:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        hashes = rolling(part, k)
        low = np.uint64((1 << STRETCH_BITS) - 1)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        need, width, done = length - k + 1, 1, None
        while width * 2 <= need:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < need:
            shift = need - width
            least = np.minimum(least[:-shift], least[shift:])
        place = (least & low).astype(np.int64)
        fresh = np.concatenate(([True], place[1:] != place[:-1]))
        fresh[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + len(place))] - a] = True  # a document's first window
        change = np.flatnonzero(fresh)
        return a + change, hashes[place[change]], a + np.append(change[1:], len(place)), a + place[change]


def strand_hashes(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A second hash of whole strands, from prefix sums; strands overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    if not len(start):
        return out
    block = 1 << STRETCH_BITS
    up, down = _powers(FACTOR, block + 4096), _powers(INVERSE, block + 4096)
    for first in range(0, len(flat), block):
        a, b = np.searchsorted(start, (first, first + block))
        if a == b:
            continue
        end = int((start[a:b] + size[a:b]).max())
        if end - first > len(up) - 1:
            up, down = _powers(FACTOR, end - first), _powers(INVERSE, end - first)
        part = flat[first:end]
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_TABLE[part] * up[: len(part)], dtype=np.uint64)))
        s, e = start[a:b] - first, start[a:b] + size[a:b] - first
        out[a:b] = mix((sums[e] - sums[s]) * down[s] + size[a:b].astype(np.uint64) * ODD)
    return out


def transforms(flat: np.ndarray, start: np.ndarray, size: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transforms of shards of strings, one after the other: the symbol before each suffix of a shard, in
    order of the suffixes. A symbol is a byte and one more; 0 ends a string, and ends sort as their strings do.

    ``shard`` numbers the shard of each string, in order, below 65,536. Suffixes are sorted by seven symbols (six from 256
    shards on), then by prefix doubling among those still alike. UTF-8 has neither 0xFE nor 0xFF; they count as one symbol.
    """
    total = size + 1
    begin = np.cumsum(total) - total
    text = np.zeros(int(total.sum()), dtype=np.uint8)
    text[_ragged(begin, size)] = np.minimum(flat[_ragged(start, size)], 254) + np.uint8(1)
    bits = len(text).bit_length()
    key = text.astype(np.uint64)
    for width in (1, 2, 4):
        beyond = np.zeros_like(key)
        beyond[:-width] = key[width:]
        beyond[key & np.uint64(255) == 0] = 0
        key = (key << np.uint64(8 * width)) | beyond
    seen = 7 if int(shard[-1]) < 256 else 6
    key = (key >> np.uint64(64 - 8 * seen)) | (np.repeat(shard.astype(np.uint64), total) << np.uint64(8 * seen))
    order = np.argsort(key)
    key = key[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1], [True]))
    rank = np.empty(len(text), dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh[:-1], np.arange(len(text)), 0))
    alike = np.flatnonzero(~(fresh[:-1] & fresh[1:]))
    string, last = np.repeat(np.arange(len(size)), total), np.repeat(begin + size, total)
    here = np.uint64((1 << bits) - 1)
    while len(alike):
        at = order[alike]
        further = at + seen
        ended = further > last[at]
        further[ended] = 0
        second = np.where(ended, string[at], rank[further])  # where a string has ended, all that are alike have
        if 3 * bits <= 64:  # a rank, what follows and the place itself in one key: sorting needs no second array
            key = ((rank[at] << (2 * bits)) | (second << bits) | at).view(np.uint64)
            key.sort()
            at = (key & here).astype(np.int64)
            key >>= np.uint64(bits)
        else:
            by = np.lexsort((second, rank[at]))
            at, key = at[by], (rank[at] << 32 | second)[by]
        fresh = np.concatenate(([True], key[1:] != key[:-1], [True]))
        order[alike] = at
        rank[at] = np.maximum.accumulate(np.where(fresh[:-1], alike, 0))
        alike = alike[~(fresh[:-1] & fresh[1:])]
        seen *= 2
    return text[order - 1]


class Merged:
    """Burrows-Wheeler transforms of shards of strings, merged.

    The merge starts with the shards' rows one shard after the other; a refinement deals the rows out by the symbols before
    them, in order, which sorts them by so many more symbols. No suffix is sorted or compared again. Only rows from which
    ``depth`` steps lead to the start of a window are dealt. Rows that stay in one block share a prefix as long as the
    refinements done, so the blocks after ``depth`` symbols are the intervals of strings with a common prefix of that length;
    ``common`` derives the prefixes themselves. Every string takes part, with the value that stands for its copies;
    nothing is decided but by the merged transform.
    """

    def __init__(self, strings: list[bytes], depth: int, shard_bytes: int = 1 << 16):
        size = np.array([len(s) for s in strings])
        shard = (np.cumsum(size + 1) - 1) // shard_bytes
        shard = np.cumsum(np.concatenate(([0], shard[1:] != shard[:-1])))
        flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self._merge(transforms(flat, np.cumsum(size) - size, size, shard), size, np.bincount(shard), depth)

    @classmethod
    def of_transforms(cls, bwt: np.ndarray, size: np.ndarray, strings: np.ndarray, depth: int) -> Merged:
        """From transforms one after the other, the sizes of all strings and the number of strings in each shard."""
        out = cls.__new__(cls)
        out._merge(bwt, size, strings, depth)
        return out

    def _merge(self, bwt: np.ndarray, size: np.ndarray, strings: np.ndarray, depth: int) -> None:
        shard_of = np.repeat(np.arange(len(strings), dtype=np.uint16 if len(strings) <= 1 << 16 else np.int64), strings)
        rows_of = np.bincount(shard_of, weights=size + 1, minlength=len(strings)).astype(np.int64)
        first_row = np.cumsum(rows_of) - rows_of
        bits = len(bwt).bit_length()
        key = (np.repeat(np.arange(len(strings), dtype=np.uint64), rows_of) << np.uint64(8 + bits)) | (bwt.astype(np.uint64) << np.uint64(bits)) | np.arange(len(bwt), dtype=np.uint64)
        key.sort()
        back = np.empty(len(bwt), dtype=np.int64)  # the row of the suffix that is one symbol longer
        back[(key & np.uint64((1 << bits) - 1)).astype(np.int64)] = np.arange(len(bwt))
        # walk from the ends: which string and place each row stands for
        self.owner, self.place = np.empty(len(bwt), dtype=np.int32), np.empty(len(bwt), dtype=np.int32)
        alive, left = np.arange(len(size)), size.astype(np.int32)
        at = first_row[shard_of] + alive - (np.cumsum(strings) - strings)[shard_of]
        while True:
            self.owner[at], self.place[at] = alive, left
            more = left > 0
            if not more.all():
                at, alive, left = at[more], alive[more], left[more]
            if not len(at):
                break
            at, left = back[at], left - 1
        # a key holds the symbols before a row, the last read one first, and the row's present position
        together = max(1, min(depth, (64 - bits) // 8))
        symbols, step, steps = bwt.astype(np.uint64), back, [back] if depth % together == 1 else []
        for j in range(1, together):
            symbols |= bwt[step].astype(np.uint64) << np.uint64(8 * j)
            step = back[step]
            if j + 1 == depth % together:
                steps.append(step)
        steps.append(step)
        rows = np.flatnonzero(self.place >= depth)  # from here the refinements lead to the starts of windows
        block, place = np.zeros(len(rows), dtype=np.int32), np.arange(len(rows), dtype=np.uint64)
        change = np.ones(len(rows), dtype=bool)
        done = 0
        while done < depth:
            taken = depth % together if not done and depth % together else together
            key = symbols[rows]
            if taken < together:
                key &= np.uint64((1 << 8 * taken) - 1)
            key = (key << np.uint64(bits)) | place
            key.sort()
            order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
            key >>= np.uint64(bits)
            block, rows = block[order], steps[0 if taken < together else -1][rows[order]]
            change[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            block = np.cumsum(change, dtype=np.int32)
            done += taken
        self.rows, self.starts, self.bwt, self.back, self.depth = rows, np.flatnonzero(change), bwt, back, depth

    def common(self) -> np.ndarray:
        """Of each window in order, how many symbols it shares with the one above, ``depth`` at most. Windows are read on from
        their rows: a suffix begins with the symbol before the suffix that is one shorter."""
        onward = np.empty_like(self.back)
        onward[self.back] = np.arange(len(self.back))
        at, shared = self.rows, np.zeros(len(self.rows), dtype=np.int64)
        alike = np.arange(1, len(at))
        for _ in range(self.depth):
            at = onward[at]
            symbol = self.bwt[at]
            alike = alike[symbol[alike] == symbol[alike - 1]]
            shared[alike] += 1
        return shared

    def least(self, value: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """For the ``windows`` places of each string where ``depth`` symbols begin, one after the other, the least ``value`` of
        a string that holds the same symbols there."""
        owner, place = self.owner[self.rows], self.place[self.rows]
        low = np.minimum.reduceat(value[owner], self.starts)
        out = np.empty(int(windows.sum()), dtype=value.dtype)
        out[(np.cumsum(windows) - windows)[owner] + place] = np.repeat(low, np.diff(np.append(self.starts, len(self.rows))))
        return out


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of ``size[0]`` places, then those of the next."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _buckets(keys: np.ndarray, parts: int) -> np.ndarray:
    """The bounds of ``parts`` equal ranges within sorted keys."""
    cuts = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, cuts), [len(keys)]))


class KeyFilter:
    """A Bloom filter over the upper 40 bits of keys, in one segment for each range of keys, as long as its keys need."""

    def __init__(self, segments: list[bytes]):
        self.size = np.array([8 * len(x) for x in segments], dtype=np.uint64)
        self.first = np.cumsum(self.size >> np.uint64(3)).astype(np.int64) - np.array([len(x) for x in segments])
        self.bits = np.frombuffer(b"".join(segments), dtype=np.uint8)

    @staticmethod
    def short(keys: np.ndarray) -> bytes:
        return keys.view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()

    @staticmethod
    def long(raw: bytes) -> np.ndarray:
        wide = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
        wide[:, 3:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
        return wide.view(np.uint64).ravel()

    @staticmethod
    def places(keys: np.ndarray, size: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
        mixed = mix(keys >> np.uint64(24))
        return mixed % size, (mixed >> np.uint64(33)) % size

    @staticmethod
    def segment(keys: np.ndarray, parts: int) -> bytes:
        """The segment of distinct ``keys``, where all keys have ``parts`` ranges."""
        bits = np.zeros(max(64, min(max(LEAST_BITS // parts, KEY_BITS * len(keys)), FILTER_BITS // parts) // 8 * 8), dtype=np.uint8)
        for place in KeyFilter.places(keys, np.uint64(len(bits))):
            bits[place] = 1
        return np.packbits(bits, bitorder="little").tobytes()

    def holds(self, part: np.ndarray, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for place in self.places(keys, self.size[part]):
            at = self.first[part] + (place >> np.uint64(3)).astype(np.int64)
            found &= (self.bits[at] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


#: Bytes of text whose strands are dealt out together: a shard of the corpus, whose transforms its task builds.
PIECE = 16 << 20
#: Bytes of strands of all shards that are merged at a time; it bounds a worker's memory.
BUCKET = 1 << 18
#: Neighbouring buckets travel together, ``TOGETHER`` at most, until a piece sends about so many bytes of strands at a time:
#: in a large corpus a piece has but a few strings for a bucket.
SENT, TOGETHER = 1 << 14, 64
#: A k-mer of so many strands in a piece is counted; those of ``HOT`` strands in all, the ``HOTTEST`` most frequent at most,
#: are told apart by longer strings, so that one phrase in many surroundings is not one bucket.
HEAVY, HOT, HOTTEST = 64, 4096, 4096
#: Windows of a hot k-mer that share a longer string: their k-mer stands within so many bytes of one place.
NEAR = 8
#: Ranges of k-mers for each shuffle partition in the search for shared ones.
RANGES = 4
DEALT_SCHEMA = "bucket int, piece long, first long, transform binary, sizes binary, least binary, counts binary, string binary, docs binary, starts binary, marks binary"
ANSWER_SCHEMA = "piece long, listed boolean, string binary, low binary, first binary, last binary, docs binary, starts binary, marks binary"


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x.tobytes())


def _spread(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=kind)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before, in columns that are sorted together."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _groups(group: np.ndarray, size: np.ndarray, most: int, limit: int = BUCKET) -> Iterator[tuple[int, int]]:
    """Ranges of strings, sorted by group, of whole groups: about ``limit`` bytes and ``most`` groups each."""
    edges = np.append(np.flatnonzero(_heads(group)), len(group)) if len(group) else np.zeros(1, np.int64)
    weight = np.concatenate(([0], np.cumsum(size + 1)))[edges]
    first = 0
    while first < len(edges) - 1:
        last = max(first + 1, int(np.searchsorted(weight, weight[first] + limit, side="right")) - 1)
        last = min(last, first + most, len(edges) - 1)
        yield int(edges[first]), int(edges[last])
        first = last


def _together(pieces: int, buckets: int, partitions: int) -> int:
    """How many buckets travel in one row: each shuffle partition has four rows of a piece at least."""
    return max(1, min(TOGETHER, pieces * SENT // BUCKET, buckets // (4 * partitions)))


def _runs_below(lows: np.ndarray, least: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of one string with one ``lows`` below the string's own: string, low, first and last window."""
    string = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    edge = np.flatnonzero(_heads(string, lows))
    string, low, first, last = string[edge], lows[edge], place[edge], place[np.append(edge[1:], len(lows)) - 1]
    below = low < least[string]
    return string[below], low[below], first[below], last[below]


def removed_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = KMER) -> DataFrame:
    """(id, mark, starts, ends): byte spans covered by repeated windows, as 64-bit integers; ``mark`` is the text's hash.

    Every row of ``docs`` with an id and a text of ``length`` bytes or more takes part, rows of one id without counting
    against each other. A row for each document that loses something; a repeated row may have several, each whole. Null and
    empty texts and null ids have none, an empty table gives no rows, and other columns are not read. ``docs`` that do not
    come straight from files are written to the shared folder first, so that a task that runs again cuts the same pieces.

    1. The k-mers of each piece of text meet by ranges of their hashes; those of two documents go into a filter, and those
       of very many strands into a list, by which these are divided further.
    2. A piece's strands that pass it, each distinct one once, are dealt into buckets by k-mer, and the piece's task builds
       the transform of each bucket's strings. Transforms travel, not texts, those of neighbouring buckets in one row; where
       the strings stand in the piece travels apart, by piece, so copies make a bucket no larger than one string a piece.
    3. A bucket's transforms are merged, one bucket after the other; the blocks at ``length`` give each window's least document.
    4. Answers return by piece, where they meet the places and become spans.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark) * RANGES
    docs = stable(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "texts")
    rows = small_batches(docs, PIECE >> 20).select("id", F.xxhash64("text").alias("mark"), "text").where(f"id is not null and octet_length(text) >= {length}")

    @tidied
    def key_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(2))
            for a, b in pieces(offsets, PIECE):
                found = Strands(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, k)
                order = np.argsort(found.key, kind="stable")
                keys, owner = found.key[order], found.owner[order]
                head = np.flatnonzero(_heads(keys)) if len(keys) else np.empty(0, np.int64)
                tail = np.append(head[1:], len(keys)) - 1
                several = owner[head] != owner[tail]
                keys, times = keys[head], tail - head + 1
                bounds = _buckets(keys, parts)
                heavy = [bounds[p] + np.flatnonzero(times[bounds[p] : bounds[p + 1]] >= HEAVY) for p in range(parts)]
                full = [p for p in range(parts) if bounds[p + 1] > bounds[p]]
                yield pa.record_batch(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([KeyFilter.short(keys[bounds[p] : bounds[p + 1]]) for p in full], pa.binary()),
                        pa.array([KeyFilter.short(keys[bounds[p] : bounds[p + 1]][several[bounds[p] : bounds[p + 1]]]) for p in full], pa.binary()),
                        pa.array([keys[heavy[p]].tobytes() for p in full], pa.binary()),
                        pa.array([times[heavy[p]].astype(np.int64).tobytes() for p in full], pa.binary()),
                    ],
                    names=["bucket", "keys", "several", "heavy", "times"],
                )

    def shared_keys(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(KeyFilter.long(b"".join(group["keys"])))
        again = keys[1:] == keys[:-1]
        several = KeyFilter.long(b"".join(group["several"]))
        bits = KeyFilter.segment(np.unique(np.concatenate([keys[1:][again], several])), parts)
        filled = float(np.bitwise_count(np.frombuffer(bits, dtype=np.uint8)).sum()) / (8 * len(bits))
        entries = len(several) + int((np.append(again, False) | np.concatenate(([False], again))).sum())
        heavy, which = np.unique(np.frombuffer(b"".join(group["heavy"]), dtype=np.uint64), return_inverse=True)
        times = np.bincount(which, np.frombuffer(b"".join(group["times"]), dtype=np.int64), len(heavy)).astype(np.int64)
        most = np.argsort(-times, kind="stable")[:HOTTEST]
        most = most[times[most] >= HOT]
        strings = min(entries, len(keys)) + max(0, len(keys) - entries) * filled**2
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "bits": [bits], "strings": [strings], "pieces": [len(group)], "hot": [heavy[most].tobytes()], "times": [times[most].tobytes()]})

    lists = rows.mapInArrow(key_lists, "bucket int, keys binary, several binary, heavy binary, times binary")
    segments, strings, many = [bytes(8)] * parts, 0.0, 1
    hot, times = np.empty(0, np.uint64), np.empty(0, np.int64)
    # written first: an iterator would find the shared k-mers of one partition after the other
    for row in materialize(lists.groupBy("bucket").applyInPandas(shared_keys, "bucket int, bits binary, strings double, pieces long, hot binary, times binary"), "filter").toLocalIterator():
        segments[row["bucket"]] = bytes(row["bits"])
        strings, many = strings + row["strings"], max(many, row["pieces"])
        if row["hot"]:
            hot, times = np.append(hot, np.frombuffer(row["hot"], np.uint64)), np.append(times, np.frombuffer(row["times"], np.int64))
            most = np.argsort(-times, kind="stable")[:HOTTEST]
            hot, times = hot[most], times[most]
    known, hot_keys = spark.sparkContext.broadcast(KeyFilter(segments)), spark.sparkContext.broadcast(np.sort(hot))
    buckets = max(1, min(shuffle_partitions(spark), int(strings) // 64), int(strings * 1.3 * (length + 15)) // BUCKET)
    together = _together(many, buckets, shuffle_partitions(spark))

    @tidied
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in DEALT_SCHEMA.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 8]
        number = (TaskContext.get().partitionId() << 32) - 1  # the same piece has the same number when a task runs again
        cuts = np.array([(p << 64) // parts for p in range(1, parts)], dtype=np.uint64)
        for batch in batches:
            all_flat, all_offsets = utf8(batch.column(2))
            ids, marks = (batch.column(j).to_numpy(zero_copy_only=False) for j in (0, 1))
            for a, b in pieces(all_offsets, PIECE):
                number += 1
                flat, offsets = all_flat[all_offsets[a] : all_offsets[b]], all_offsets[a : b + 1] - all_offsets[a]
                found = Strands(flat, offsets, length, k)
                kept = known.value.holds(np.searchsorted(cuts, found.key, side="right"), found.key)
                for name in ("start", "windows", "key", "owner", "lead"):
                    setattr(found, name, getattr(found, name)[kept])
                found.split(hot_keys.value)
                key, start, owner, size = found.key, found.start, found.owner, found.windows + (length - 1)
                del found, kept
                if not len(key):
                    continue
                sums = strand_hashes(flat, start, size)
                order = np.lexsort((sums, key))  # strands are in order of their places, and stay so within a string
                fresh = _heads(key[order], sums[order])
                string = np.empty(len(order), dtype=np.int64)
                string[order] = np.cumsum(fresh) - 1
                head = order[fresh]
                least = np.minimum.reduceat(ids[a + owner[order]], np.flatnonzero(fresh))
                begin, size, bucket = start[head], size[head], ((key[head] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                del order, fresh, key, sums, head
                here, at = np.unique(owner, return_index=True)
                out: list[list] = [
                    [-1], [number], [0], [b""], [_squeeze(size.astype(np.uint8))], [_squeeze(ids[a + here].astype(np.int64))], [b""],
                    [_squeeze(string.astype(np.int32))], [_squeeze(np.diff(np.append(at, len(owner))).astype(np.int32))],
                    [_squeeze(np.diff(start, prepend=0).astype(np.int32))], [_squeeze(np.stack([marks[a + here].astype(np.int64), offsets[here]]))],
                ]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
                for x, y in _groups(bucket // together, size, 65536 // together):
                    shard = np.cumsum(_heads(bucket[x:y])) - 1
                    bwt = transforms(flat, begin[x:y], size[x:y], shard)
                    edge = np.append(x + np.flatnonzero(_heads(bucket[x:y] // together)), y)
                    row = np.concatenate(([0], np.cumsum(size[x:y] + 1)))[edge - x]
                    spans = [(slice(p, q), bwt[r:s]) for p, q, r, s in zip(edge[:-1].tolist(), edge[1:].tolist(), row[:-1].tolist(), row[1:].tolist(), strict=True)]
                    n = len(spans)
                    columns = [
                        (bucket[edge[:-1]] // together).tolist(), [number] * n, edge[:-1].tolist(), [_squeeze(t) for _, t in spans],
                        [_squeeze(size[s].astype(np.uint8)) for s, _ in spans], [_squeeze(least[s].astype(np.int64)) for s, _ in spans],
                        [np.bincount(bucket[s] % together, minlength=together).astype(np.int32).tobytes() for s, _ in spans], *[[b""] * n] * 4,
                    ]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        names = [f.split()[0] for f in ANSWER_SCHEMA.split(", ")]
        if group["bucket"].iloc[0] < 0:  # places pass through
            kept = (group["piece"], [True] * len(group), group["string"], group["least"], group["sizes"], [b""] * len(group), group["docs"], group["starts"], group["marks"])
            return pd.DataFrame(dict(zip(names, kept, strict=True)))
        group = group.sort_values("piece", kind="stable")
        sizes = [_spread(r, np.uint8) for r in group["sizes"]]
        size = np.concatenate(sizes).astype(np.int64)
        least = np.concatenate([_spread(r, np.int64) for r in group["least"]])
        bwt = np.concatenate([_spread(r, np.uint8) for r in group["transform"]])
        counts = np.stack([np.frombuffer(r, dtype=np.int32) for r in group["counts"]]).astype(np.int64)
        begin = np.cumsum(counts).reshape(counts.shape) - counts  # strings of each piece and bucket, and rows of their transform
        row = np.concatenate(([0], np.cumsum(size + 1)))
        found = []
        for j in range(counts.shape[1]):
            some = np.flatnonzero(counts[:, j])
            if not len(some):
                continue
            count, first = counts[some, j], begin[some, j]
            own = _ragged(first, count)
            merged = Merged.of_transforms(bwt[_ragged(row[first], row[first + count] - row[first])], size[own], count, length)
            windows = size[own] - (length - 1)
            string, *run = _runs_below(merged.least(least[own], windows), least[own], windows)
            found.append((own[string], *run))
        string, low, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(string, kind="stable")
        string, low, first, last = string[order], low[order], first[order], last[order]
        before = np.cumsum([0, *map(len, sizes)])[:-1]
        bounds = np.searchsorted(string, np.append(before, len(size)))
        answers = []
        for j, (piece, number) in enumerate(zip(group["piece"], group["first"], strict=True)):
            at = slice(bounds[j], bounds[j + 1])
            if bounds[j + 1] > bounds[j]:
                own = (string[at] - before[j] + number).astype(np.int32)
                answers.append((piece, False, _squeeze(own), _squeeze(low[at]), _squeeze(first[at].astype(np.uint8)), _squeeze(last[at].astype(np.uint8)), b"", b"", b""))
        return pd.DataFrame(answers, columns=names)

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        """Of one piece: each document's spans, joined where they touch."""
        places, answers = group[group["listed"]].iloc[0], group[~group["listed"]]
        string, docs_of, start = _spread(places["string"], np.int32), _spread(places["docs"], np.int32), np.cumsum(_spread(places["starts"], np.int32), dtype=np.int64)
        windows, ids = _spread(places["first"], np.uint8).astype(np.int64) - (length - 1), _spread(places["low"], np.int64)
        marks, offsets = _spread(places["marks"], np.int64).reshape(2, -1)
        doc = np.repeat(np.arange(len(ids)), docs_of)
        least = np.full(len(windows), np.iinfo(np.int64).max)
        np.minimum.at(least, string, ids[doc])
        # of every string: the runs that other pieces answered, and all of it against its own least document
        parts_of = [(np.arange(len(windows)), least, np.zeros(len(windows), np.int64), windows - 1)]
        if len(answers):
            parts_of.append(tuple(np.concatenate([_spread(r, kind) for r in answers[c]]).astype(np.int64) for c, kind in (("string", np.int32), ("low", np.int64), ("first", np.uint8), ("last", np.uint8))))
        of, low, first, last = (np.concatenate(x) for x in zip(*parts_of, strict=True))
        order = np.argsort(of, kind="stable")
        low, first, last = low[order], first[order], last[order]
        bounds = np.searchsorted(of[order], np.arange(len(windows) + 1))
        found = []
        for x in range(0, len(string), 1 << 18):
            here = string[x : x + (1 << 18)]
            many = bounds[here + 1] - bounds[here]
            run, at = _ragged(bounds[here], many), np.repeat(np.arange(x, x + len(here)), many)
            gone = low[run] < ids[doc[at]]
            run, at = run[gone], at[gone]
            found.append((doc[at], start[at] + first[run], start[at] + last[run] + length))
        owner, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(owner):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "mark": pd.Series(dtype="int64"), "starts": [], "ends": []})
        # offsets in the piece: the documents' spans do not touch, as a document is longer than its spans' overlap
        order = np.lexsort((begin, owner))
        owner, begin, end = owner[order], begin[order], end[order]
        far = int(end.max()) + 2
        reach = np.maximum.accumulate(owner * far + end)  # the furthest end so far of the same document
        head = np.flatnonzero(np.concatenate(([True], owner[1:] * far + begin[1:] > reach[:-1])))
        end = reach[np.append(head[1:], len(owner)) - 1] - owner[head] * far - offsets[owner[head]]
        begin, owner = begin[head] - offsets[owner[head]], owner[head]
        here = np.unique(owner)
        a, b = np.searchsorted(owner, here), np.searchsorted(owner, here, side="right")
        return pd.DataFrame({"id": ids[here], "mark": marks[here], "starts": [begin[x:y].tobytes() for x, y in zip(a, b, strict=True)], "ends": [end[x:y].tobytes() for x, y in zip(a, b, strict=True)]})

    # places need no company: spread them over groups of their own
    dealt = rows.mapInArrow(deal, DEALT_SCHEMA).withColumn("apart", F.when(F.col("bucket") < 0, F.col("piece")).otherwise(0))
    answers = dealt.groupBy("bucket", "apart").applyInPandas(merge, ANSWER_SCHEMA)
    return answers.groupBy("piece").applyInPandas(gather, "id long, mark long, starts binary, ends binary")


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts in a document of smaller id.

    Result: the columns of ``docs`` without ``text_col``, then kept_bytes (binary, what remains of the UTF-8 text),
    n_bytes, n_removed and n_spans (maximal removed runs). Matches are judged on the input and never cross documents. With ``as_text`` the kept bytes
    come back as ``text_col``, without the bytes of characters that a cut has broken.

    Null and empty texts stay empty. Texts shorter than ``length`` lose nothing. Rows of one id do not count against
    each other; equal texts of one id lose the same bytes. Rows with a null id lose nothing and count for nothing.
    Columns named like the added ones are replaced. An empty table gives no rows. k-mers and strands meet in ranges of
    hashes; a strand is sent once for each piece of text that holds it, however often it stands there.
    """
    from pyspark.sql import types as T

    rest = [c for c in docs.columns if c not in (text_col, "kept_bytes", "n_bytes", "n_removed", "n_spans")]
    spans = removed_spans(docs, id_col=id_col, text_col=text_col, length=length)
    spans = spans.groupBy("id", "mark").agg(F.collect_list(F.struct("starts", "ends")).alias("__spans")).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "__spans")
    texts = docs.select(*rest, F.col(text_col).cast("string").alias("__text"))
    name, kind = (text_col, pa.string()) if as_text else ("kept_bytes", pa.binary())
    joined = texts.join(spans, (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64("__text") == F.col("__mark")), "left").select(*rest, "__text", "__spans")

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], np.zeros((batch.num_rows, 3), dtype=np.int64)
            for j, (text, found) in enumerate(zip(batch.column(len(rest)), batch.column(len(rest) + 1), strict=True)):
                raw = (text.as_py() or "").encode()
                counts[j, 0] = len(raw)
                if not found.is_valid:
                    kept.append(raw)
                    continue
                got = found.as_py()
                starts = np.concatenate([np.frombuffer(x["starts"], dtype=np.int64) for x in got])
                ends = np.concatenate([np.frombuffer(x["ends"], dtype=np.int64) for x in got])
                depth = np.zeros(len(raw) + 1, dtype=np.int32)
                np.add.at(depth, starts, 1)
                np.add.at(depth, ends, -1)
                gone = np.cumsum(depth[:-1]) > 0
                kept.append(np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes())
                counts[j, 1] = gone.sum()
                counts[j, 2] = (gone & ~np.concatenate(([False], gone[:-1]))).sum()
            shown = [x.decode("utf-8", "ignore") for x in kept] if as_text else kept
            yield pa.record_batch([*batch.columns[: len(rest)], pa.array(shown, kind), *[pa.array(counts[:, c]) for c in range(3)]], names=[*rest, name, "n_bytes", "n_removed", "n_spans"])

    fields = [f for f in joined.schema.fields if f.name in rest]
    added = [T.StructField(name, T.StringType() if as_text else T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]]
    return joined.mapInArrow(cut, T.StructType([*fields, *added]))
