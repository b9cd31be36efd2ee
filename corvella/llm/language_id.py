"""Language ID: first the family, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import held_out, pieces, small_batches, tidied, utf8

BUCKETS = 1 << 12
#: Rows a language that training reads at most, and rows in all; every language is learned, from an equal share of the
#: latter where there are many. The driver holds ``TOTAL`` vectors of ``BUCKETS`` floats: 200 MB.
SAMPLE, TOTAL = 800, 12_000

#: Families of ISO 639-1 codes. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk",
    "semitic": "ar he mt am",
    "indic": "hi ur bn pa mr gu ne",
    "iranian": "fa ps ku tg",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def _letters() -> np.ndarray:
    """Byte classes: letters in lower case, bytes above ASCII as they are, all else a blank."""
    table = np.full(256, 32, dtype=np.uint8)
    table[128:] = np.arange(128, 256)
    table[97:123] = table[65:91] = np.arange(97, 123)
    return table


def grams(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit-length vectors of hashed byte 1- to 3-grams over the whole texts."""
    rows = len(offsets) - 1
    counts = np.zeros(rows * BUCKETS, dtype=np.float32)
    owner = np.repeat(np.arange(rows, dtype=np.int64) * BUCKETS, np.diff(offsets))
    low = _letters()[flat].astype(np.uint32)
    # the lead byte C3 covers the accented Latin capitals and small letters, 0x20 apart
    capital = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)) + 1
    low[capital] += 0x20
    gram = np.zeros(len(low), dtype=np.uint32)
    for size in (1, 2, 3):
        if len(low) < size:
            break
        gram = gram[: len(low) - size + 1] * np.uint32(257) + low[size - 1 :] + np.uint32(size)
        place = owner[: len(gram)]
        same = place == owner[size - 1 :]
        blank = low[: len(gram)] == 32
        for j in range(1, size):
            blank &= low[j : len(gram) + j] == 32
        chosen = same & ~blank
        slot = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
        counts += np.bincount(place[chosen] + slot[chosen], minlength=rows * BUCKETS)
    matrix = np.sqrt(counts.reshape(rows, BUCKETS)).astype(np.float32)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1, norm)


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Squared-hinge linear support vector machines, one for each column of y in {-1, 1}, by accelerated full gradients;
    the two classes of a machine weigh alike. Weights (features, machines) and biases."""
    right = y > 0
    weight = np.where(right, 0.5 / np.maximum(1, right.sum(axis=0)), 0.5 / np.maximum(1, (~right).sum(axis=0)))
    w = ahead = np.zeros((x.shape[1] + 1, y.shape[1]))  # the bias is last
    rate, momentum = 1 / (2 * 2.0 + penalty), 1.0
    for _ in range(steps):
        # products in the type of x, so that no wider copy of it is made
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1].astype(x.dtype) + ahead[-1]))
        pull = weight * y * slack
        fresh = ahead - rate * (penalty * ahead - 2 * np.vstack([x.T @ pull.astype(x.dtype), pull.sum(axis=0)]))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        w, ahead, momentum = fresh, fresh + (momentum - 1) / following * (fresh - w), following
    return w[:-1].astype(np.float32), w[-1].astype(np.float32)


class Hierarchy:
    """One-versus-rest machines choose the family, one-versus-one machines the language within it."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs)
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(family_of(lang), []).append(lang)
        of = np.array([family_of(lang) for lang in langs])
        self.names = sorted(self.families)
        self.top = linear_svm(x, np.where(of[:, None] == np.array(self.names), 1.0, -1.0)) if len(self.names) > 1 else None
        self.pairs = {}
        for langs_in in self.families.values():
            for a, b in combinations(langs_in, 2):
                chosen = (names == a) | (names == b)
                w, bias = linear_svm(x[chosen], np.where(names[chosen] == a, 1.0, -1.0)[:, None])
                self.pairs[a, b] = w[:, 0], bias[0]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and the product of the logistic margins of the choices that led to it."""
        sure = np.ones(len(x), dtype=np.float64)
        if self.top:
            margins = x @ self.top[0] + self.top[1]
            family = margins.argmax(axis=1)
            sure = 1 / (1 + np.exp(-2 * margins.max(axis=1)))
        else:
            family = np.zeros(len(x), dtype=int)
        langs = [""] * len(x)
        for f, name in enumerate(self.names):
            rows, known = np.flatnonzero(family == f), self.families[name]
            if not len(rows):
                continue
            votes, sums = np.zeros((len(rows), len(known))), np.zeros((len(rows), len(known)))
            for (i, a), (j, b) in combinations(enumerate(known), 2):
                w, bias = self.pairs[a, b]
                margin = x[rows] @ w + bias
                votes[:, i] += margin > 0
                votes[:, j] += margin <= 0
                sums[:, i] += margin
                sums[:, j] -= margin
            best = (votes + np.tanh(sums) / 4).argmax(axis=1)
            if len(known) > 1:
                sure[rows] *= 1 / (1 + np.exp(-2 * sums[np.arange(len(rows)), best] / (len(known) - 1)))
            for row, b in zip(rows.tolist(), best.tolist(), strict=True):
                langs[row] = known[b]
        return langs, sure


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, total: int = TOTAL) -> Hierarchy | None:
    """Fit on at most ``sample`` rows of every language and ``total`` in all (two of each at least), those least by a hash
    of id and text; executors turn them into vectors before the driver sees them.

    None where no row has a language, an empty table included. Null texts and texts without a letter teach nothing; rows of
    one id are rows of their own. Very long texts are read whole. Other columns are not read.
    """

    def packed(row: np.ndarray) -> bytes:
        slots = np.flatnonzero(row)
        return row[slots].tobytes() + slots.astype(np.uint16).tobytes()

    @tidied
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            for first, last in pieces(offsets):
                got = grams(flat[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                yield pa.record_batch([batch.column(0).slice(first, last - first), pa.array([packed(row) for row in got], pa.binary())], names=["lang", "vector"])

    rows = small_batches(labelled).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(3)).alias("o")).where("lang is not null and text rlike '\\\\p{L}'")
    # about twice the sample by a threshold on the hash, then the least: no sort of all rows
    by_lang = rows.groupBy("lang").agg(F.count("*").alias("n"))
    quota = F.least(F.lit(sample), F.greatest(F.lit(2), F.floor(F.lit(total) / F.count("*").over(Window.partitionBy())))).alias("quota")  # a row a language
    share = F.least(F.lit(1.0), 2.0 * F.col("quota") / F.col("n"))
    counts = by_lang.select("lang", "n", quota).select("lang", "quota", (F.floor(share * 1_000_000) + 1).alias("below"))
    near = rows.join(F.broadcast(counts), "lang").where(F.pmod("o", F.lit(1_000_000)) < F.col("below"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("o", "text"))
    chosen = near.withColumn("place", place).where(F.col("place") <= F.col("quota"))
    got = sorted(chosen.select("lang", "text").mapInArrow(vectors, "lang string, vector binary").collect())
    if not got:
        return None
    x = np.zeros((len(got), BUCKETS), dtype=np.float32)
    for at, row in enumerate(got):
        n = len(row["vector"]) // 6
        x[at, np.frombuffer(row["vector"], np.uint16, n, 4 * n)] = np.frombuffer(row["vector"], np.float32, n)
    return Hierarchy(x, [row["lang"] for row in got])


def identify(docs: DataFrame, model: Hierarchy | None, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The columns id, lang_pred and score for every whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Repeated rows are predicted
    each; other columns, clashing names among them, are ignored; an empty table gives no rows.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            lettered = np.array(batch.column(2).to_pylist(), dtype=bool)
            for first, last in pieces(offsets):
                for a in range(first, last, 512):
                    b = min(last, a + 512)
                    if model is None:
                        langs, sure = ["und"] * (b - a), np.zeros(b - a)
                    else:
                        langs, sure = model.predict(grams(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                    known = lettered[a:b]
                    yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([x if k else "und" for x, k in zip(langs, known, strict=True)]), pa.array(np.where(known, sure, 0.0), pa.float64())], names=["id", "lang_pred", "score"])

    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), has_letter.alias("lettered"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def learn_and_identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``identify`` with a model of the rows outside the held-out fold; adds ``held_out``."""
    model = train(docs.where(~held_out(id_col)), text_col=text_col, lang_col=lang_col, id_col=id_col)
    return identify(docs, model, text_col=text_col, id_col=id_col).withColumn("held_out", held_out(id_col))
