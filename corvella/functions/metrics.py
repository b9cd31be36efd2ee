"""Text metrics as vectorized functions of (output, reference) or of an output alone."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def jaccard_distance(a: Column, b: Column) -> Column:
    split = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    return T.let(split(a), lambda x: T.let(split(b), lambda y: 1 - T.jaccard(x, y)))


def hamming(a: Column, b: Column) -> Column:
    """Places that differ, the shorter text padded."""
    chars = lambda c: F.split(c, "")
    return F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def distinct_n(text: Column, n: int) -> Column:
    """Distinct n-grams over all; no n-gram gives 0."""
    grams = T.ngrams(T.words(text), n)
    return T.let(grams, lambda g: F.when(F.size(g) == 0, 0.0).otherwise(F.size(F.array_distinct(g)) / F.size(g)))


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*(tokens[i:] for i in range(n)), strict=False))


def _tokens(text: str | None) -> list[str]:
    return re.findall(r"\w+|[^\w\s]", (text or "").lower())


def bleu(output: str, reference: str, longest: int = 4) -> float:
    """Sentence BLEU in per cent; zero precisions are halved in turn, as exponential smoothing does."""
    hyp, ref = _tokens(output), _tokens(reference)
    if not hyp or not ref:
        return 0.0
    total, smooth, orders = 0.0, 1.0, 0
    for n in range(1, longest + 1):
        h, r = _grams(hyp, n), _grams(ref, n)
        count = sum(h.values())
        if not count:
            break
        orders += 1
        hit = sum((h & r).values())
        if not hit:
            smooth *= 2
        total += math.log(100 * hit / count if hit else 100 / (smooth * count))
    return min(1.0, math.exp(1 - len(ref) / len(hyp))) * math.exp(total / orders)


def gleu(output: str, reference: str) -> float:
    """Matches of 1- to 4-grams over the greater total."""
    hyp, ref = _tokens(output), _tokens(reference)
    hit = mine = theirs = 0
    for n in range(1, 5):
        h, r = _grams(hyp, n), _grams(ref, n)
        hit, mine, theirs = hit + sum((h & r).values()), mine + sum(h.values()), theirs + sum(r.values())
    return hit / max(mine, theirs) if max(mine, theirs) else 0.0


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge(output: str, reference: str) -> tuple[float, float, float]:
    """F scores of ROUGE-1, -2 and -L; words are not stemmed."""
    hyp, ref = [t for t in _tokens(output) if t.isalnum()], [t for t in _tokens(reference) if t.isalnum()]
    f = lambda hit, a, b: 2 * hit / (a + b) if hit else 0.0
    one = [f(sum((_grams(hyp, n) & _grams(ref, n)).values()), max(0, len(hyp) - n + 1), max(0, len(ref) - n + 1)) for n in (1, 2)]
    return one[0], one[1], f(_lcs(hyp, ref), len(hyp), len(ref))


def chrf(output: str, reference: str, longest: int = 6, beta: float = 2.0) -> float:
    """Character F score in per cent over 1- to 6-grams without white space."""
    hyp, ref = "".join((output or "").split()), "".join((reference or "").split())
    precisions, recalls = [], []
    for n in range(1, longest + 1):
        h, r = _grams(list(hyp), n), _grams(list(ref), n)
        if not h or not r:
            continue
        hit = sum((h & r).values())
        precisions.append(hit / sum(h.values()))
        recalls.append(hit / sum(r.values()))
    if not precisions:
        return 0.0
    p, r = sum(precisions) / len(precisions), sum(recalls) / len(recalls)
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


def levenshtein_ratio(a: str, b: str) -> float:
    """1 - insertions and deletions over both lengths."""
    a, b = a or "", b or ""
    return 2 * _lcs(list(a), list(b)) / (len(a) + len(b)) if a or b else 1.0


def jaro(a: str, b: str) -> float:
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (b[j] for j in range(len(b)) if used[j]), strict=True)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro with a bonus for up to four equal first letters, where it is above 0.7."""
    base, same = jaro(a, b), 0
    if base <= 0.7:
        return base
    for x, y in zip((a or "")[:4], (b or "")[:4], strict=False):
        if x != y:
            break
        same += 1
    return base + same * weight * (1 - base)


def sari(source: str, output: str, reference: str) -> float:
    """Keep and add F scores and delete precision over 1- to 4-grams, averaged, in per cent."""
    s, o, r = (_tokens(x) for x in (source, output, reference))
    total = 0.0
    for n in range(1, 5):
        gs, go, gr = _grams(s, n), _grams(o, n), _grams(r, n)
        keep, keep_ref = gs & go, gs & gr
        hit = sum((keep & keep_ref).values())
        p, q = (hit / sum(keep.values()) if keep else 0.0), (hit / sum(keep_ref.values()) if keep_ref else 0.0)
        kept = 2 * p * q / (p + q) if p + q else 0.0
        gone, gone_ref = gs - go, gs - gr
        deleted = sum((gone & gone_ref).values()) / sum(gone.values()) if gone else 0.0
        new, new_ref = set(go) - set(gs), set(gr) - set(gs)
        p, q = (len(new & new_ref) / len(new) if new else 0.0), (len(new & new_ref) / len(new_ref) if new_ref else 0.0)
        added = 2 * p * q / (p + q) if p + q else 0.0
        total += (kept + deleted + added) / 3
    return 100 * total / 4


def _stemless(text: str | None) -> list[str]:
    return [t for t in _tokens(text) if t.isalnum()]


def _sentences(text: str | None) -> list[str]:
    return [p for p in re.split(r"(?<=[.!?])\s+|\n", text or "") if p.strip()]


def ibleu(source: str, output: str, reference: str, share: float = 0.9) -> float:
    """BLEU against the reference less BLEU against the source."""
    return share * bleu(output, reference) - (1 - share) * bleu(output, source)


def rouge_lsum(output: str, reference: str) -> float:
    """F score of the union of each reference sentence's longest common subsequences with the output's sentences."""
    mine, theirs = [_stemless(p) for p in _sentences(output)], [_stemless(p) for p in _sentences(reference)]
    left, right = Counter(t for p in mine for t in p), Counter(t for p in theirs for t in p)
    hit = 0
    for want in theirs:
        places: set[int] = set()
        for have in mine:
            places |= _lcs_places(want, have)
        for k in sorted(places):
            token = want[k]
            if left[token] > 0 and right[token] > 0:
                left[token] -= 1
                right[token] -= 1
                hit += 1
    a, b = sum(map(len, mine)), sum(map(len, theirs))
    return 2 * hit / (a + b) if hit else 0.0


def _lcs_places(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of one longest common subsequence with ``b``."""
    grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
    i, j, found = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.add(i - 1)
            i, j = i - 1, j - 1
        elif grid[i - 1][j] >= grid[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return found


def update_rouge(source: str, output: str, reference: str) -> float:
    """ROUGE-1 of the sentences that the source lacks; two texts without any are alike."""
    known = set(_sentences(source))
    fresh = [" ".join(p for p in _sentences(t) if p not in known) for t in (output, reference)]
    if not fresh[0] and not fresh[1]:
        return 1.0
    return rouge(fresh[0], fresh[1])[0]


def ter(output: str, reference: str) -> float:
    """Word edits over the words of the reference, in per cent; moves of blocks count as their edits."""
    hyp, ref = (output or "").split(), (reference or "").split()
    row = list(range(len(ref) + 1))
    for i, x in enumerate(hyp, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(ref, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 100 * row[-1] / len(ref) if ref else (0.0 if not hyp else 100.0)


def nist(output: str, reference: str, longest: int = 5) -> float:
    """Matched n-grams weighed by what they tell in the reference, with the penalty for length."""
    hyp, ref = _tokens(output), _tokens(reference)
    if not hyp or not ref:
        return 0.0
    counts = {n: _grams(ref, n) for n in range(1, longest + 1)}

    def told(gram: tuple[str, ...]) -> float:
        above = len(ref) if len(gram) == 1 else counts[len(gram) - 1][gram[:-1]]
        return math.log2(above / counts[len(gram)][gram])

    score = 0.0
    for n in range(1, longest + 1):
        h = _grams(hyp, n)
        if total := sum(h.values()):
            score += sum(told(g) * c for g, c in (h & counts[n]).items()) / total
    ratio = min(1.0, len(hyp) / len(ref))
    return score * math.exp(math.log(0.5) / math.log(1.5) ** 2 * math.log(ratio) ** 2)


def pseudo_parent(source: str, output: str, reference: str, share: float = 0.5) -> float:
    """F of n-gram precision, where the reference or the source holds them, and recall of both."""
    src, hyp, ref = set(_stemless(source)), _stemless(output), _stemless(reference)
    precisions, recalls = [], []
    for n in range(1, 5):
        h, r = _grams(hyp, n), _grams(ref, n)
        if not h or not r:
            continue
        good = sum(c if g in r else c * sum(t in src for t in g) / n for g, c in h.items())
        precisions.append(good / sum(h.values()))
        recalls.append(sum((h & r).values()) / sum(r.values()))
    if not precisions:
        return 0.0
    mean = lambda xs: math.exp(sum(math.log(max(x, 1e-9)) for x in xs) / len(xs))
    covered = len(src & set(hyp)) / len(src) if src else 1.0
    p, r = mean(precisions), mean(recalls) ** (1 - share) * max(covered, 1e-9) ** share
    return 2 * p * r / (p + r)


def char_cut(output: str, reference: str, shortest: int = 3) -> float:
    """The share of characters outside common blocks of ``shortest`` or more, of both texts."""
    from difflib import SequenceMatcher

    a, b = output or "", reference or ""
    if not a and not b:
        return 0.0
    common = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= shortest)
    return 1 - 2 * common / (len(a) + len(b))


def kendall(a: list[float], b: list[float]) -> float:
    """Tau-b of two lists."""
    pairs = [((a[i] > a[j]) - (a[i] < a[j]), (b[i] > b[j]) - (b[i] < b[j])) for i in range(len(a)) for j in range(i)]
    x, y = sum(p != 0 for p, _ in pairs), sum(q != 0 for _, q in pairs)
    return sum(p * q for p, q in pairs) / math.sqrt(x * y) if x and y else math.nan


def diff_html(a: str, b: str) -> str:
    """Two texts word by word: what goes is struck out, what comes is inserted."""
    from difflib import SequenceMatcher
    from html import escape

    x, y, out = (a or "").split(), (b or "").split(), []
    for kind, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if kind == "equal":
            out.append(escape(" ".join(x[i:j])))
        else:
            out += [f"<del>{escape(' '.join(x[i:j]))}</del>"] * (j > i) + [f"<ins>{escape(' '.join(y[k:m]))}</ins>"] * (m > k)
    return " ".join(out)


def fkgl(text: str) -> float:
    """Grade level with syllables counted as groups of vowels."""
    words = re.findall(r"[^\W\d_]+", text or "")
    parts = max(1, len(re.findall(r"[.!?]+", text or "")))
    if not words:
        return 0.0
    beats = sum(max(1, len(re.findall(r"[aeiouyáéíóúàèùâêîôûäöü]+", w.lower()))) for w in words)
    return 0.39 * len(words) / parts + 11.8 * beats / len(words) - 15.59


def self_bleu(text: str, most: int | None = None) -> float:
    """The mean BLEU-3 of each sentence against the n-grams of all others; one sentence gives 1. All sentences count unless
    ``most`` says how many of the first do (the reference reads 500).

    The others' counts are the sums less the sentence's own, so the work follows the length of the text.
    """
    parts = [t for p in re.split(r"(?<=[.!?])\s+|\n", text or "") if (t := _tokens(p))][:most]
    if len(parts) < 2:
        return 1.0
    sums = {n: Counter() for n in (1, 2, 3)}
    own = [{n: _grams(t, n) for n in (1, 2, 3)} for t in parts]
    for grams in own:
        for n, counts in grams.items():
            sums[n].update(counts)
    length, score = sum(map(len, parts)), 0.0
    for tokens, grams in zip(parts, own, strict=True):
        total, smooth, orders = 0.0, 1.0, 0
        for n in (1, 2, 3):
            count = sum(grams[n].values())
            if not count:
                break
            orders += 1
            hit = sum(min(c, sums[n][g] - c) for g, c in grams[n].items())
            if not hit:
                smooth *= 2
            total += math.log(hit / count if hit else 1 / (smooth * count))
        score += min(1.0, math.exp(1 - (length - len(tokens)) / len(tokens))) * math.exp(total / orders)
    return score / len(parts)


def scorer(function, kind: str = "double"):
    """A pandas UDF of a Python metric."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(x, y) for x, y in zip(a, b, strict=True)])

    return run


def scorer3(function, kind: str = "double"):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([function(x, y, z) for x, y, z in zip(a, b, c, strict=True)])

    return run


def scorer1(function, kind: str = "double"):
    @F.pandas_udf(kind)
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([function(x) for x in a])

    return run
