"""Packing by power-of-two decomposition: pieces of binary length, each a sequence of its own."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.session import stable

from ._text import small_batches, tidied

#: Python's str.split() breaks at these, the tokenizer's white space does not hold them.
NOT_BREAKS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Runs, and parts of them, that are remembered; a table that is full starts anew.
CACHE = 600_000
#: Below this, no character composes with another, and lower case does not depend on the neighbours.
PLAIN = "\u0250"
#: Fixed value: the pattern by which the tokenizer splits what is left between white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """For each plain character in lower case the letters that stand for its UTF-8 bytes in the vocabulary: printable
    bytes stand for themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    letters = [chr(b) if b in printable else chr(next(rest)) for b in range(256)]
    return {ord(low): "".join(letters[b] for b in low.encode()) for c in range(ord(PLAIN)) for low in chr(c).lower()}


class _Runs(dict):
    """Runs and their ids; what is not there is learned."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, run: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        found = self[run] = self.learn(run)
        return found


class Encoder:
    """Encodes texts as ``tokenizers`` does, one run without white space at a time, and remembers the runs.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its runs in order. Texts with
    special-token strings or separators on which the two notions of white space differ go through the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known, self.parts = _Runs(self._learn), _Runs(self._spell)
        self.split, self.letters, self.tokenize = regex.compile(SPLIT).findall, byte_letters(), self.whole.model.tokenize

    def _slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _spell(self, part: str) -> bytes:
        """A part in lower case; plain letters and signs of ASCII stand for themselves."""
        ids = [t.id for t in self.tokenize(part if part.isascii() else part.translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, run: str) -> bytes:
        if run.isascii() and run.isprintable():
            low = run.lower()
            if low.isalpha():
                return self.parts[low]
            word, sign = low[:-1], low[-1]
            if word.isalpha() and not sign.isalnum():
                return self.parts[word] + self.parts[sign]
            return b"".join(map(self.parts.__getitem__, self.split(low)))
        if max(run) < PLAIN and "\u0130" not in run and run.isprintable():
            return b"".join(map(self.parts.__getitem__, self.split(run.lower())))
        normal = self.whole.normalizer.normalize_str(run)
        ids = [t.id for part, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal) for t in self.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(c in text for c in NOT_BREAKS) or any(s in text for s in self.special):
            return self._slow(text)
        return b"".join(map(self.known.__getitem__, text.split()))


def binary_lengths(total: int, longest: int) -> list[int]:
    """``total`` as as many ``longest`` as fit and then falling powers of two."""
    parts = [longest] * (total // longest)
    rest = total % longest
    return parts + [1 << bit for bit in range(longest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pack_power_of_two(docs: DataFrame, tokenizer: str, *, end_id: int = 2, longest: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document's ids into pieces of power-of-two length; pieces of one length form a bucket.

    Result: the id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset. A document
    is the text's ids and then ``end_id``; each piece is the only one in its sequence, so sequences hold no padding
    and cross no documents. The bucket is ``length``: batches of one length come from it without padding.

    Null or empty texts give one piece, the end id alone, null ids too. Repeated rows are packed once per row. Other columns,
    clashing names among them, are ignored. A very long text is encoded whole, in its worker's memory. An empty table
    gives no rows. There is no shuffle: a lost task encodes its own split again. ``docs`` that do not come straight from
    files are written first, so that a task that runs again numbers the same sequences.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    @tidied
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[list] = [[], [], [], [], []]
            held = 0
            for key, text in zip(ids, texts, strict=True):
                got = encoder.encode(text.as_py() or "") + end
                start, total = 0, len(got) // 4
                for length in binary_lengths(total, longest):
                    for column, value in zip(out, (key, start, length, got[4 * start : 4 * (start + length)], total), strict=True):
                        column.append(value)
                    start += length
                held += len(got)
                if held > 16 << 20:
                    yield pa.record_batch([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=names)
                    out, held = [[], [], [], [], []], 0
            if out[0]:
                yield pa.record_batch([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    names = ["id", "start", "length", "ids", "doc_tokens"]
    chosen = stable(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "texts")  # sequence_id counts rows
    chosen = small_batches(chosen)
    cut = chosen.mapInArrow(pack, "id long, start long, length long, ids binary, doc_tokens long")
    return cut.select(F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, ``length=4096`` to ``length=1``: a training job reads a folder in batches that need no
    padding. Each task adds a file to every folder, so the pieces are not shuffled and a common length is not one
    task's work. An empty table writes no folder."""
    pieces.write.partitionBy("length").parquet(path)


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")
