"""Byte-level BPE: DuckDB recursive queries contract words to tokens, ordered aggregation turns tokens into bytes."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import list_array, small_batches

#: Words and space-separated pieces that a worker remembers before it starts anew.
CACHE = 500_000
#: Words that one recursive query contracts.
WORDS = 40_000

#: Words of more bytes than this take all places of a pair in one step, where that is the same.
LONG = 256

#: A step: a word's tokens become rows of (word, position, token and its right neighbour), these join the merge table,
#: and the lowest-ranked pair, the leftmost of equals, becomes one token. A word without a pair that merges makes no
#: more rows; its last step is its result.
LEFTMOST = """
WITH RECURSIVE state(word, step, toks) AS (
    SELECT word, 0, toks FROM start
  UNION ALL
    SELECT s.word, s.step + 1, list_concat(s.toks[:b.here - 1], [b.made], s.toks[b.here + 2:])
    FROM state s JOIN (
        SELECT p.word, (min(m.merged::BIGINT << 32 | p.pos) & 4294967295)::INT AS here, min(m.merged) AS made
        FROM (SELECT word, unnest(range(1, len(toks))) AS pos, unnest(toks[:-2]) AS tok, unnest(toks[2:]) AS nxt FROM state) p
        JOIN merges m ON m.l = p.tok AND m.r = p.nxt
        GROUP BY p.word
    ) b ON b.word = s.word
)
SELECT word, arg_max(toks, step) AS toks FROM state GROUP BY word ORDER BY word
"""

#: The same for long words: where no merge can follow of lower rank than the pair's own ("calm"), all its places
#: merge in one step, from the left without overlap, as they would one after the other.
EVERY_PLACE = """
WITH RECURSIVE state(word, pos, tok, step) AS (
    SELECT word, unnest(range(len(toks))), unnest(toks), 0 FROM start
  UNION ALL
    SELECT word, pos, CASE WHEN hit THEN merged ELSE tok END, step + 1
    FROM (
        SELECT *, coalesce(lag(hit) OVER (PARTITION BY word ORDER BY pos), false) AS eaten
        FROM (
            SELECT *, best AND (CASE WHEN calm THEN (nth - anchor) % 2 = 0 ELSE pos = first_best END) AS hit
            FROM (
                SELECT *, max(CASE WHEN best AND NOT before THEN nth END) OVER (PARTITION BY word ORDER BY pos) AS anchor,
                       min(CASE WHEN best THEN pos END) OVER (PARTITION BY word) AS first_best
                FROM (
                    SELECT *, coalesce(lag(best) OVER w, false) AS before, row_number() OVER w AS nth
                    FROM (
                        SELECT *, coalesce(merged = min(merged) OVER (PARTITION BY word), false) AS best
                        FROM (
                            SELECT s.word, s.pos, s.tok, s.step, m.merged, coalesce(m.calm, true) AS calm
                            FROM (SELECT word, pos, tok, step, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt FROM state) s
                            LEFT JOIN merges m ON m.l = s.tok AND m.r = s.nxt
                        )
                    ) WINDOW w AS (PARTITION BY word ORDER BY pos)
                ) QUALIFY first_best IS NOT NULL
            )
        )
    )
    WHERE NOT eaten
)
SELECT word, list(tok ORDER BY pos) AS toks FROM (FROM state QUALIFY step = max(step) OVER (PARTITION BY word)) GROUP BY word ORDER BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each way to make a token of two tokens: left id, right id, made id, and whether the made id is calm."""
    rows = [
        (a, b, rank)
        for token, rank in ranks.items()
        for cut in range(1, len(token))
        if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None
    ]
    left, right, made = np.array(rows, dtype=np.int32).reshape(-1, 3).T
    restless = np.union1d(left[left > made], right[right > made])
    return left, right, made, ~np.isin(made, restless)


class DuckBpe:
    """Contracts and decodes words in an in-process DuckDB of bounded memory."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = read_ranks(path)
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": "350MB", "temp_directory": ""})
        left, right, made, calm = merge_table(self.ranks)
        self._table("merges", pa.table({"l": left, "r": right, "merged": made, "calm": calm}))
        self._table("vocab", pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "spelled": pa.array([t.hex() for t in self.ranks])}))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.sql.register("incoming", rows)
        self.sql.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.sql.unregister("incoming")

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as 32-bit integers. A word that is a token is that token."""
        found: list[bytes] = [b""] * len(words)
        short, long = [], []
        for k, word in enumerate(words):
            if (rank := self.ranks.get(word)) is not None:
                found[k] = rank.to_bytes(4, "little")
            else:
                (short if len(word) <= LONG else long).append(k)
        for chosen, contract in ((short, LEFTMOST), (long, EVERY_PLACE)):
            for first in range(0, len(chosen), WORDS):
                part = chosen[first : first + WORDS]
                for k, ids in zip(part, self._contract([words[k] for k in part], contract), strict=True):
                    found[k] = ids
        return found

    def _contract(self, words: list[bytes], contract: str) -> list[bytes]:
        lengths = [len(w) for w in words]
        toks = list_array(self.single[np.frombuffer(b"".join(words), dtype=np.uint8)], lengths, pa.int32())
        self._table("start", pa.table({"word": np.arange(len(words), dtype=np.int32), "toks": toks}))
        got = self.sql.sql(contract).to_arrow_table()["toks"].combine_chunks()
        tok, ends = got.flatten().to_numpy().astype("<i4").tobytes(), np.cumsum(got.value_lengths().to_numpy()).tolist()
        return [tok[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The bytes of each row of 32-bit ids, spelled by aggregates in the ids' order, some rows in one string."""
        flat = np.frombuffer(b"".join(rows), dtype="<i4")
        lengths = np.array([len(r) // 4 for r in rows], dtype=np.int64)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self._table("ids", pa.table({"row": np.repeat(np.arange(len(rows), dtype=np.int32), lengths), "pos": pos.astype(np.int32), "tok": flat}))
        self.sql.execute("CREATE OR REPLACE TEMP TABLE spelt AS SELECT i.row, i.pos, v.spelled FROM ids i JOIN vocab v USING (tok)")
        text = self.sql.sql("SELECT string_agg(spelled, '' ORDER BY row, pos) AS t FROM spelt GROUP BY row // 64 ORDER BY row // 64").fetchall()
        size = dict(self.sql.sql("SELECT row, sum(length(spelled)) // 2 FROM spelt GROUP BY row").fetchall())
        flat, at, found = bytes.fromhex("".join(t for (t,) in text)), 0, []
        for k in range(len(rows)):
            end = at + int(size.get(k, 0))
            found.append(flat[at:end])
            at = end
        return found


class _Pool:
    """Many short arrays in one that grows."""

    def __init__(self, kind):
        self.flat, self.used, self.starts, self.sizes = np.empty(1 << 16, dtype=kind), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, rows: list[bytes]) -> None:
        sizes = np.array([len(r) for r in rows], dtype=np.int64) // self.flat.itemsize
        fresh = np.frombuffer(b"".join(rows), dtype=self.flat.dtype)
        if self.used + len(fresh) > len(self.flat):
            wider = np.empty(2 * (self.used + len(fresh)), dtype=self.flat.dtype)
            wider[: self.used] = self.flat[: self.used]
            self.flat = wider
        self.flat[self.used : self.used + len(fresh)] = fresh
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(fresh)

    def take(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.sizes[rows]
        return self.flat[np.arange(int(sizes.sum())) + np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes)]


class _Places(dict):
    """Where a piece stands in the pools; a new one is listed and gets the next place, one that cannot be remembered -1."""

    def __init__(self, coder: TextCoder, lead: str):
        self.coder, self.lead = coder, lead
        self[""] = -1

    def __missing__(self, piece: str) -> int:
        if not piece.isprintable() and any(c.isspace() for c in piece):
            place = -1
        else:
            place = self.coder.known + len(self.coder.fresh)
            self.coder.fresh.append(self.lead + piece)
        self[piece] = place
        return place


class TextCoder:
    """Encodes and decodes whole texts; each distinct word goes through DuckDB once while the worker remembers it.

    A text whose white space is single spaces and single line breaks splits into pieces that hold whole matches of
    the pattern, so pieces are remembered as well; other texts are matched whole.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        self.duck, self.match = DuckBpe(path), regex.compile(pattern).findall
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self._start()

    def _start(self) -> None:
        self.ids, self.raw, self.known, self.fresh = _Pool("<i4"), _Pool(np.uint8), 0, ["\n"]
        self.bare, self.led = _Places(self, ""), _Places(self, " ")

    def learn(self, words) -> None:
        new = [w for w in words if w not in self.words]
        raw = [w.encode() for w in new]
        ids = self.duck.encode(raw)
        self.words.update(zip(new, zip(ids, self.duck.decode(ids), strict=True), strict=True))

    def _whole(self, words: list[str]) -> tuple[bytes, bytes]:
        parts = [self.words[w] for w in words]
        return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def _settle(self) -> None:
        """Fill the pools with the pieces that were new."""
        cut = list(map(self.match, self.fresh))
        self.learn({w for words in cut for w in words})
        got = list(map(self._whole, cut))
        self.ids.extend([ids for ids, _ in got])
        self.raw.extend([raw for _, raw in got])
        self.known, self.fresh = self.known + len(got), []

    def code(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts and how many each has, the decoded bytes of all and how many each has."""
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.led) + len(self.bare) > 2 * CACHE:
            self._start()
        places: list[int] = []
        ends = []
        bare, led = self.bare, self.led.__getitem__
        for text in texts:
            lines = text.split("\n")
            for line in lines:
                pieces = line.split(" ")
                places.append(bare[pieces[0]])
                if len(pieces) > 1:
                    places.extend(map(led, pieces[1:]))
                places.append(0)  # the line break
            places.pop()
            ends.append(len(places))
        self._settle()
        at, ends_of = np.array(places, dtype=np.int64), np.array(ends, dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(ends_of, prepend=0))
        good = np.ones(len(texts), dtype=bool)
        good[owner[at < 0]] = False
        kept = good[owner]
        at, owner = at[kept], owner[kept]
        flat = [self.ids.take(at), self.raw.take(at)]
        counts = [np.bincount(owner, pool.sizes[at], len(texts)).astype(np.int64) for pool in (self.ids, self.raw)]
        if not good.all():
            rest = np.flatnonzero(~good).tolist()
            cut = [self.match(texts[k]) for k in rest]
            self.learn({w for words in cut for w in words})
            whole = dict(zip(rest, map(self._whole, cut), strict=True))
            for side in (0, 1):
                edge = np.concatenate(([0], np.cumsum(counts[side])))
                kind = flat[side].dtype
                parts = [np.frombuffer(whole[k][side], dtype=kind) if k in whole else flat[side][edge[k] : edge[k + 1]] for k in range(len(texts))]
                flat[side], counts[side] = np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)
        return flat[0], counts[0], flat[1], counts[1]


#: The coder of a worker, kept for its next tasks.
_CODERS: dict[tuple[str, str], TextCoder] = {}


def coder_of(path: str, pattern: str) -> TextCoder:
    if (path, pattern) not in _CODERS:
        _CODERS.clear()
        _CODERS[path, pattern] = TextCoder(path, pattern)
    return _CODERS[path, pattern]


def encode_decode(docs: DataFrame, ranks: str, *, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's byte-level BPE ids and the bytes that they decode to.

    Result: the id column, ``ids`` (array of int) and ``decoded`` (binary), a row for each row of ``docs``.

    A partition keeps one DuckDB with the merge table. Words, the matches of ``pattern``, become rows of (word,
    position, token), and a recursive query contracts each word's leftmost lowest-ranked pair until none is left; an
    aggregate ordered by position spells the ids. No special tokens are made. Null and empty texts give no ids and no
    bytes; repeated rows and ids are coded each; other columns, clashing names (``ids``, ``decoded``) among them, are
    ignored; a very long text is coded whole, in its worker's memory; an empty table gives no rows. There is no shuffle.
    A worker keeps its words for its next tasks, ``CACHE`` at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks, pattern)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size < 2 << 20):
                    size += len(texts[last])
                    last += 1
                ids, n_ids, raw, n_raw = coder.code(texts[first:last])
                edges = np.concatenate(([0], np.cumsum(n_raw))).astype(np.int64)
                decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(edges), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.record_batch([keys.slice(first, last - first), list_array(ids, n_ids, pa.int32()), decoded], names=["id", "ids", "decoded"])
                first = last

    chosen = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)
