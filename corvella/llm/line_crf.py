"""Quality by a linear-chain conditional random field over a document's lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import held_out, list_array, pieces, run_hashes, small_batches, tidied, utf8, words

#: Labelled documents a class that training reads at most, and lines of each: of a longer one a run of so many.
SAMPLE, LINES = 1500, 400
#: A line whose own features contradict its document's label with this chance is labelled by itself in the second fit.
SURE = 0.8
#: Documents of more lines are read in runs of so many side by side, not line after line.
RUN = 1024
THRESHOLD = 0.7
CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "high": range(128, 256),
    "stop": tuple(map(ord, ".,;:?'\"()-")),
    "bang": tuple(map(ord, "!")),
    "bar": tuple(map(ord, "|\t")),
    "mark": tuple(map(ord, "#$%&*@^~=+_<>{}[]\\/`")),
}
OWN = len(CLASSES) + 6


def line_bounds(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines and the document of each; an empty document has one empty line."""
    breaks = np.flatnonzero(flat == 10)
    owner_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    owners_start = np.concatenate([np.arange(len(offsets) - 1), owner_of_break])
    owners_end = np.concatenate([owner_of_break, np.arange(len(offsets) - 1)])
    a, b = np.lexsort((starts, owners_start)), np.lexsort((ends, owners_end))
    return starts[a], ends[b], owners_start[a]


def line_features(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, documents, byte lengths) of every line: the line's own, its neighbours' and a constant."""
    starts, ends, owners = line_bounds(flat, offsets)
    sizes, lines = ends - starts, len(starts)
    lengths = np.maximum(sizes, 1).astype(np.float64)
    own = np.zeros((lines, OWN), dtype=np.float64)
    for k, members in enumerate(CLASSES.values()):
        table = np.zeros(256, dtype=bool)
        table[list(members)] = True
        at = np.flatnonzero(table[flat])
        own[:, k] = (np.searchsorted(at, ends) - np.searchsorted(at, starts)) / lengths
    # words: count, mean length, repeats of the word before and of any word of the line
    at, to = words(flat)
    line = np.searchsorted(starts, at, side="right") - 1
    line = np.clip(line, 0, None)
    # an empty line shares its start with the next line's, which searchsorted already prefers
    hashes = run_hashes(flat, at, to)
    count = np.bincount(line, minlength=lines).astype(np.float64)
    follows = np.zeros(len(at), dtype=bool)
    follows[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((hashes, line))
    again = np.zeros(len(at), dtype=bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (line[order][1:] == line[order][:-1])
    some = np.maximum(count, 1)
    k = len(CLASSES)
    own[:, k] = np.bincount(line[follows], minlength=lines) / some
    own[:, k + 1] = np.bincount(line[order][again], minlength=lines) / some
    own[:, k + 2] = np.minimum(sizes / some / 20, 2)
    own[:, k + 3] = np.log1p(count) / 8
    own[:, k + 4] = sizes == 0
    # lines that stand earlier in the document
    filled = np.flatnonzero(sizes > 0)
    line_hash = run_hashes(flat, starts[filled], ends[filled])
    order = np.lexsort((filled, line_hash, owners[filled]))
    same = (line_hash[order][1:] == line_hash[order][:-1]) & (owners[filled][order][1:] == owners[filled][order][:-1])
    own[filled[order[1:][same]], k + 5] = 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    if lines > 1:
        joined = (owners[1:] == owners[:-1])[:, None]
        before[1:] = own[:-1] * joined
        after[:-1] = own[1:] * joined
    return np.hstack([own, before, after, np.ones((lines, 1))]), owners, sizes


def _grid(owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling number of lines: first line and number of each, and the order."""
    first = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
    count = np.diff(np.append(first, len(owners)))
    order = np.argsort(-count, kind="stable")
    return first[order], count[order], order


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _plain(scores: np.ndarray, moves: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward sums, all documents side by side, one step a line number."""
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
    alpha[first] = scores[first]
    steps = int(count[0])
    live = np.searchsorted(-count, -np.arange(1, steps + 1), side="right")
    for t in range(1, steps):
        at = first[: live[t]] + t
        alpha[at] = scores[at] + _lse(alpha[at - 1][:, :, None] + moves, 1)
    for t in range(steps - 2, -1, -1):
        at = first[: live[t + 1]] + t
        beta[at] = _lse(moves + (scores[at + 1] + beta[at + 1])[:, None, :], 2)
    return alpha, beta


def _in_runs(scores: np.ndarray, moves: np.ndarray, owners: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The same sums, with documents cut into runs of lines: each run is summed from both states before it and to both at
    its end, all runs side by side; then the runs of a document are joined in turn."""
    far = -1e300
    opens = np.concatenate(([True], owners[1:] != owners[:-1]))
    place = np.arange(len(owners)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
    begin = np.flatnonzero(place % run == 0)
    size = np.diff(np.append(begin, len(owners)))
    order = np.argsort(-size, kind="stable")
    head, length, last = begin[order], size[order], begin + size - 1
    live = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
    ahead, behind = np.empty((len(scores), 2, 2)), np.empty((len(scores), 2, 2))
    ahead[begin] = scores[begin][:, None, :] + np.where(opens[begin][:, None, None], 0.0, moves)
    for t in range(1, int(length[0])):
        at = head[: live[t]] + t
        ahead[at] = scores[at][:, None, :] + _lse(ahead[at - 1][:, :, :, None] + moves, 2)
    behind[last] = np.where(np.eye(2, dtype=bool), 0.0, far)
    for t in range(int(length[0]) - 2, -1, -1):
        at = head[: live[t + 1]] + t
        behind[at] = _lse(moves[:, :, None] + (scores[at + 1][:, :, None] + behind[at + 1])[:, None], 2)
    start, end = np.zeros((len(begin), 2)), np.zeros((len(begin), 2))
    joins = np.concatenate(([False], owners[begin][1:] == owners[begin][:-1]))
    for k in range(len(begin)):
        start[k] = _lse(start[k - 1][:, None] + ahead[last[k - 1]], 0) if joins[k] else (0.0, far)
    for k in range(len(begin) - 2, -1, -1):
        if joins[k + 1]:
            onward = _lse(behind[begin[k + 1]] + end[k + 1], 1)
            end[k] = _lse(moves + scores[begin[k + 1]] + onward, 1)
    of = np.repeat(np.arange(len(begin)), size)
    return _lse(start[of][:, :, None] + ahead, 1), _lse(behind + end[of][:, None, :], 2)


def forward_backward(scores: np.ndarray, moves: np.ndarray, owners: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of each line (n, 2), expected moves (2, 2), weighted by line, and the log partition of each document,
    all documents side by side, one step a line number."""
    first, count, _ = _grid(owners)
    alpha, beta = _plain(scores, moves, first, count) if count[0] <= RUN else _in_runs(scores, moves, owners)
    whole = np.empty(len(owners))
    ends = _lse(alpha[first + count - 1], 1)
    whole[np.concatenate([np.arange(a, a + c) for a, c in zip(first, count, strict=True)])] = np.repeat(ends, count)
    marginal = np.exp(alpha + beta - whole[:, None])
    at = np.flatnonzero(np.concatenate(([False], owners[1:] == owners[:-1])))
    pair = np.exp(alpha[at - 1][:, :, None] + moves + (scores[at] + beta[at])[:, None, :] - whole[at][:, None, None]) if len(at) else np.zeros((1, 2, 2))
    pair = pair.sum(axis=0) if weight is None or not len(at) else np.tensordot(weight[at], pair, 1)
    return marginal / marginal.sum(axis=1, keepdims=True), pair, ends


class LineCrf:
    """States 0 (bad) and 1 (good) of lines."""

    def __init__(self, features: int):
        self.weights, self.moves = np.zeros((features, 2)), np.zeros((2, 2))

    def fit(self, x: np.ndarray, owners: np.ndarray, labels: np.ndarray, steps: int = 150, penalty: float = 1e-4, rate: float = 0.1) -> LineCrf:
        """Adam on the penalized conditional likelihood; both classes of documents weigh alike, and within a class each
        line. ``labels`` has one entry a line. Features are brought to one scale for the search."""
        scale = np.maximum(x.std(axis=0), 1e-2)
        scale[-1] = 1
        z = x / scale
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
        target = np.stack([labels == 0, labels == 1], axis=1).astype(np.float64)
        at = np.flatnonzero(np.concatenate(([False], owners[1:] == owners[:-1])))
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[at - 1], labels[at]), weight[at])
        theta = np.zeros(z.shape[1] * 2 + 4)
        m = v = np.zeros_like(theta)
        for step in range(1, steps + 1):
            w, moves = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
            marginal, pair, _ = forward_backward(z @ w, moves, owners, weight)
            grad = np.concatenate([(z.T @ ((marginal - target) * weight[:, None])).ravel(), (pair - seen).ravel()]) + penalty * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta - rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.moves = theta[:-4].reshape(-1, 2) / scale[:, None], theta[-4:].reshape(2, 2)
        return self

    def hidden(self, x: np.ndarray, owners: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Labels of lines from their documents' labels: a line that by its own features is otherwise, and surely so, is
        otherwise, as long as half of the document's bytes keep its label. So the chain sees moves between the states."""
        z = x @ self.weights
        good = 1 / (1 + np.exp(z[:, 0] - z[:, 1]))
        own = np.where(good > SURE, 1, np.where(good < 1 - SURE, 0, labels))
        weight = sizes + 1.0
        kept = np.bincount(owners, (own == labels) * weight) / np.bincount(owners, weight)
        return np.where(kept[owners] < 0.5, labels, own)

    def documents(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean over bytes of the lines' chances to be good."""
        x, owners, sizes = line_features(flat, offsets)
        good = forward_backward(x @ self.weights, self.moves, owners)[0][:, 1]
        weight = sizes + 1.0
        rows = len(offsets) - 1
        return np.clip(np.bincount(owners, good * weight, rows) / np.bincount(owners, weight, rows), 0, 1)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> LineCrf:
    """Fit on at most ``sample`` labelled documents a class outside the held-out fold, those least by a hash of the id, and
    ``LINES`` lines of each; executors turn them into line features, and only these reach the driver: 400 MB at most.

    The first fit takes each line to be what its document is; the second lets lines differ that the first is sure of.
    Without labels of both classes (an empty table, null labels) every score is 0.5. Documents of one id all count, with the
    least of its labels; null and empty texts are one empty line. Other columns are not read.
    """

    @tidied
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets):
                x, owners, sizes = line_features(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts = np.bincount(owners, minlength=b - a)
                if (counts > LINES).any():
                    # of a long document a run of lines, at a place that its length and bytes say
                    place = np.arange(len(owners)) - (np.cumsum(counts) - counts)[owners]
                    spare = np.maximum(counts - LINES, 0)
                    begin = (np.bincount(owners, sizes, b - a).astype(np.int64) * 2654435761) % (spare + 1)
                    chosen = (place >= begin[owners]) & (place < begin[owners] + LINES)
                    x, sizes, counts = x[chosen], sizes[chosen], np.minimum(counts, LINES)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), list_array(x.astype(np.float32).ravel(), counts * x.shape[1], pa.float32()), list_array(sizes, counts, pa.int64())],
                    names=["label", "x", "sizes"],
                )

    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("label")).where("k is not null and label in (0, 1)").where(~held_out("k")).groupBy("k").agg(F.min("label").alias("label"))
    order = F.xxhash64(F.col("k").cast("string"), F.lit(5))
    picked = [known.where(F.col("label") == c).orderBy(order, "k").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    texts = small_batches(docs).select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(chosen, "k").select("label", "text")
    rows = texts.mapInArrow(featured, "label int, x array<float>, sizes array<long>").collect()
    width = 3 * OWN + 1
    model = LineCrf(width)
    if not rows or len({r["label"] for r in rows}) < 2:
        return model
    rows.sort(key=lambda r: (r["label"], len(r["x"]), r["x"]))  # the same model whatever the order of arrival
    x = np.concatenate([np.array(r["x"], dtype=np.float64) for r in rows]).reshape(-1, width)
    lines = [len(r["x"]) // width for r in rows]
    owners, labels_of = np.repeat(np.arange(len(rows)), lines), np.repeat([r["label"] for r in rows], lines)
    model.fit(x, owners, labels_of)
    return model.fit(x, owners, model.hidden(x, owners, np.array([n for r in rows for n in r["sizes"]]), labels_of))


def score(docs: DataFrame, model: LineCrf, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the quality of every whole text in ``score_col``, replaced where it is there.

    Null and empty texts are one empty line and are scored as such. Repeated rows are scored each. A text of very many lines
    is read in runs side by side. An empty table gives no rows. Nothing is shuffled.
    """
    from pyspark.sql import types as T

    kept = [c for c in docs.columns if c != score_col]
    at = kept.index(text_col)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(at))
            good = [model.documents(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets)]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(good) if good else np.empty(0))], names=[*kept, score_col])

    rows = small_batches(docs).select(*kept)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(score_col, T.DoubleType())]))
