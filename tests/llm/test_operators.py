"""The training-data operators against brute force, the libraries they stand for, and hand-made edge cases."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corvella.llm import bpe, bwt_dedup, catalog, components, exact_topk, html_blocks, jaccard_join, language_id, line_crf, line_dedup, order_minhash, packing
from corvella.llm._text import held_out

ODD_TEXTS = [None, "", " ", "\n", "a", "Line one is long enough to count\n\tLINE ONE IS LONG ENOUGH TO COUNT \n", "日本語 🙂 é́", "x" * 5000, "word " * 3000, "  two  spaces\r\n", "same text, twice over, five words and more", "same text, twice over, five words and more", "İstanbul ΣΑΣ"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i * 10, t, "en" if i % 2 else None, "s", 1, 7) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id at all here", "fr", None, None, 7), (30, "the id of another row", None, "s", 1, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines long").repartition(3)


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.where("false")


def documents(spark, data):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_oracles(spark, duck, data):
    from compare import same

    for name, sql in catalog.ORACLE_SQL.items():
        same(catalog.QUERIES[name](spark, data), duck.execute(sql))


# 1


def test_fingerprints_follow_brute_force(spark, data):
    texts = documents(spark, data)
    got = {r["doc_id"]: r for r in catalog.op1_order_minhash(spark, data).collect()}
    assert len(got) == len(texts)
    for k, (key, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        changed = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        row, own, other = got[key], order_minhash.signature(text), order_minhash.signature(changed)
        assert row["n_chars"] == len(text) and row["edited_sha256"] == sha(changed)
        assert row["fingerprint"] == own.astype(">u4").tobytes().hex() and row["edited_fingerprint"] == other.astype(">u4").tobytes().hex()
        assert row["near_edited"] == pytest.approx(np.mean(own == other)) and row["near_next"] == pytest.approx(np.mean(own == order_minhash.signature(following)))


def test_fingerprint_picks_least_numbered_kmers():
    text, k = "abcabcabcabd" * 5, 3
    points = order_minhash.code_points(text)
    plain = order_minhash.kmer_hashes(points, k)
    seen, elements = Counter(), []
    for i in range(len(text) - k + 1):
        gram = text[i : i + k]
        elements.append((gram, seen[gram]))
        seen[gram] += 1
    numbered = order_minhash.numbered(plain)
    assert len(set(elements)) == len(set(numbered.tolist()))
    assert [n == p for n, p in zip(numbered.tolist(), plain.tolist(), strict=True)] == [c == 0 for _, c in elements]


def test_fingerprint_is_sensitive_to_order():
    rng = np.random.default_rng(3)
    parts = ["".join(rng.choice(list("abcdefghij "), 40)) for _ in range(30)]
    text, moved = "".join(parts), "".join(parts[::-1])
    a, b = order_minhash.signature(text), order_minhash.signature(moved)
    assert order_minhash.likeness(a, a) == 1 and order_minhash.likeness(a, b) < 0.6
    assert order_minhash.likeness(order_minhash.signature(""), a) == 0


def test_fingerprint_edges(spark, odd, none):
    rows = order_minhash.fingerprint_pairs(odd).collect()
    assert len(rows) == odd.count()
    same = [r["fingerprint"] for r in rows if r["doc_id"] in (100, 110)]
    assert same[0] == same[1]
    assert order_minhash.fingerprint_pairs(none).count() == 0
    alone = order_minhash.fingerprint_pairs(odd.where("doc_id = 100")).first()
    assert alone["near_next"] == 1


# 2


def brute_lines(rows, min_docs=3):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(blank).translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(doc)
    common = {k: max(d) for k, d in held.items() if len(d) >= min_docs}
    return [(doc, "\n".join(x for x in (text or "").split("\n") if doc is None or doc >= common.get(key(x), -(10**9)))) for doc, text in rows]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (3, 2), (5, 3)])
def test_line_dedup(spark, batches, fanout):
    rng = np.random.default_rng(batches)
    pool = [f"shared line number {i} of the pool" for i in range(12)] + ["short", "", "  Shared LINE number 3 of the pool\t"]
    rows = [(int(i), "\n".join(rng.choice(pool, int(rng.integers(1, 6))))) for i in rng.permutation(40)] + [(None, pool[0]), (7, None), (100, "")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches, fanout=fanout)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(brute_lines(rows), key=key)


def test_lines_of_a_long_document(spark):
    """Thousands of lines, all of which go: the work must not be lines times dropped lines."""
    text = "\n".join(f"line {i} of a long document that has copies" for i in range(60_000))
    got = line_dedup.dedup_lines(spark.createDataFrame([(k, text) for k in range(4)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] == text) for r in got) == [(k, 60_000, 0 if k == 3 else 60_000, k == 3) for k in range(4)]


def test_runs_are_deleted(spark):
    docs = spark.createDataFrame([(k, "a line that stands in each of them") for k in range(9)], "doc_id long, text string")
    line_dedup.dedup_lines(docs).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_dedup_edges(odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.count() == odd.count() and got.columns.count("n_lines") == 1
    assert line_dedup.dedup_lines(none).count() == 0


# 3


def test_topk_edges(spark, none):
    rows = [(100, [1.0, 2.0]), (200, [1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, []), (None, [1.0, 1.0]), (8, [-1.0, -2.0]), (1, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = exact_topk.top_k(frame, F.col("id") % 100 == 0, k=4).orderBy("query_id", "rank").collect()
    one = 1024 * 1024
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(100, 1, 1, 5 * one), (100, 2, 1, 5 * one), (100, 3, 2, 5 * one), (100, 4, 200, one), (200, 1, 1, one), (200, 2, 1, one), (200, 3, 2, one), (200, 4, 100, one)]
    assert exact_topk.top_k(frame.where("false"), F.col("id") % 100 == 0).count() == 0
    assert exact_topk.top_k(frame.where("vec_id = 100"), F.col("id") % 100 == 0).count() == 0


def test_topk_in_blocks(spark, data):
    frame = spark.read.parquet(f"{data}/embeddings.parquet")
    whole = exact_topk.top_k(frame, F.col("id") % 20 == 0, k=5)
    blocks = exact_topk.top_k(frame, F.col("id") % 20 == 0, k=5, block=4, lists=3)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, blocks.collect()))


# 4


def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    scores, moves, owners = rng.normal(size=(9, 2)), rng.normal(size=(2, 2)), np.array([0, 0, 0, 0, 1, 2, 2, 3, 3])
    got, pair, whole = line_crf.forward_backward(scores, moves, owners)
    total = np.zeros((2, 2))
    for doc in range(4):
        at = np.flatnonzero(owners == doc)
        weights = {}
        for code in range(2 ** len(at)):
            path = [code >> j & 1 for j in range(len(at))]
            weights[tuple(path)] = np.exp(sum(scores[a, p] for a, p in zip(at, path, strict=True)) + sum(moves[p, q] for p, q in zip(path, path[1:], strict=False)))
        z = sum(weights.values())
        for j, a in enumerate(at):
            assert got[a, 1] == pytest.approx(sum(w for p, w in weights.items() if p[j]) / z)
        for path, w in weights.items():
            for p, q in zip(path, path[1:], strict=False):
                total[p, q] += w / z
    assert pair == pytest.approx(total)


def test_runs_of_lines_are_joined():
    rng = np.random.default_rng(1)
    owners = np.repeat(np.arange(6), [1, 40, 7, 8, 9, 100])
    scores, moves = rng.normal(size=(len(owners), 2)), rng.normal(size=(2, 2))
    first, count, _ = line_crf._grid(owners)
    for plain, joined in zip(line_crf._plain(scores, moves, first, count), line_crf._in_runs(scores, moves, owners, 8), strict=True):
        assert joined == pytest.approx(plain)


def test_lines_may_differ_from_their_document():
    x = np.array([[1.0, 1], [1, 1], [-9, 1], [-9, 1], [1, 1]])
    model = line_crf.LineCrf(2)
    model.weights = np.array([[0.0, 3.0], [0, 0]])
    labels, owners = np.array([1, 1, 1, 1, 1]), np.array([0, 0, 0, 1, 1])
    assert model.hidden(x, owners, np.array([50, 50, 20, 70, 20]), labels).tolist() == [1, 1, 0, 1, 1]


def test_many_lines_are_scored_soon(spark):
    import time

    frame = spark.createDataFrame([(1, "a b\n" * 400_000)], "doc_id long, text string")
    model, began = line_crf.LineCrf(3 * line_crf.OWN + 1), time.time()
    assert line_crf.score(frame, model).first()["score"] == pytest.approx(0.5) and time.time() - began < 25


def test_line_features_of_edges():
    texts = ["", "one line", "\n\n", "b !! c\nb !! c\n"]
    raw = [t.encode() for t in texts]
    x, owners, sizes = line_crf.line_features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.bincount(owners).tolist() == [1, 1, 3, 3]
    assert sizes.tolist() == [0, 8, 0, 0, 0, 6, 6, 0]
    bang = list(line_crf.CLASSES).index("bang")
    assert x[:, bang].tolist() == pytest.approx([0, 0, 0, 0, 0, 2 / 6, 2 / 6, 0])
    assert x[6, line_crf.OWN - 1] == 1 and x[5, line_crf.OWN - 1] == 0


def test_quality_on_held_out(spark, data, odd, none):
    big = data.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = catalog.op4_line_crf(spark, big).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    model = line_crf.LineCrf(3 * line_crf.OWN + 1)
    assert {r["score"] for r in line_crf.score(odd, model).collect()} == {0.5}
    assert line_crf.score(none, model).count() == 0
    assert (line_crf.train(none, labels).weights == 0).all()


# 5


def brute_classes(rows, n=5, threshold=0.8):
    sets = {}
    for key, text in rows:
        w = (text or "").encode().split()
        sets[key] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    keys, links, root = sorted(sets), Counter(), {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x & y) >= threshold * len(x | y) - 1e-9):
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {k: (find(k), links[k]) for k in keys}


def test_jaccard_join_follows_brute_force(spark, data, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = documents(spark, data)[:80]
    for i in range(40):  # near copies of each other, some below the threshold
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            words[at] = f"x{i}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000 + i, "copy " * 30) for i in range(15)] + [(30_000, None), (30_001, ""), (30_002, "a b"), (30_003, "a  b"), (30_004, "b a")]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute_classes(rows)


def test_jaccard_join_edges(odd, none):
    got = {r["doc_id"]: r["class_id"] for r in jaccard_join.jaccard_join(odd).collect()}
    assert got[110] == 100 and None not in got and got[10] == 0
    assert jaccard_join.jaccard_join(none).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_ids_are_the_first_set_key(spark, parts):
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more")]
    answers = set()
    for order in (rows, rows[::-1], [rows[k] for k in (2, 1, 3, 0)]):
        got = jaccard_join.jaccard_join(spark.createDataFrame(order, "doc_id long, text string").repartition(parts)).collect()
        answers.add(tuple(sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got)))
    assert len(answers) == 1
    linked = {doc: links for doc, _, links in answers.pop()}
    assert linked[1] == 1 and linked[2] + linked[3] == 1


def test_jaccard_join_on_a_table(spark, data):
    """All pairs of a larger table: the same classes and links, so a recall of 1 there."""
    big = data.replace("sf0.001", "sf0.01")
    sets, links, root = {}, Counter(), {}
    for key, text in documents(spark, big):
        w = text.encode().split()
        sets[key] = frozenset(hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([hash(tuple(w))] if w else [])
        root[key] = key

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    order = sorted(sets, key=lambda k: len(sets[k]))
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = sets[a], sets[b]
            if len(x) < 0.8 * len(y):
                break
            if x == y or len(x & y) >= 0.8 * (len(x) + len(y)) / 1.8 - 1e-9:
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in catalog.op5_ngram_jaccard(spark, big).collect()}
    assert sum(links.values()) > 50
    assert got == {k: (find(k), links[k]) for k in sets}


def test_banding_reaches_recall():
    bands, rows = jaccard_join.banding(0.8)
    assert bands * rows <= jaccard_join.HASHES and 1 - (1 - 0.8**rows) ** bands >= jaccard_join.RECALL


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(300, 200)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}, 300: 200, 200: 200}


# 6


def test_bpe_equals_tiktoken(spark, data, odd, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for frame in (spark.read.parquet(f"{data}/documents.parquet"), odd):
        texts = Counter((r["doc_id"], r["text"] or "") for r in frame.collect())
        rows = bpe.encode_decode(frame, path).collect()
        got = Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in rows)
        assert got == texts
        assert all(r["ids"] == reference.encode_ordinary(bytes(r["decoded"]).decode()) for r in rows)
    assert bpe.encode_decode(none, path).count() == 0


def test_long_words():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    reference = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeation"), 700)), "a" * 901, "ab" * 333]
    got = bpe.DuckBpe(path).encode([w.encode() for w in words])
    assert [np.frombuffer(g, "<i4").tolist() for g in got] == [reference.encode_ordinary(w) for w in words]


# 7


def test_svm_is_at_its_optimum():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 6))
    y = np.where(x @ rng.normal(size=(6, 2)) + 0.3 * rng.normal(size=(120, 2)) > 0, 1.0, -1.0)
    penalty = 1e-2
    w, bias = language_id.linear_svm(x, y, penalty, 4000)

    def loss(w, bias):
        right = y > 0
        weight = np.where(right, 0.5 / right.sum(axis=0), 0.5 / (~right).sum(axis=0))
        return (weight * np.maximum(0, 1 - y * (x @ w + bias)) ** 2).sum(axis=0) + penalty / 2 * ((w**2).sum(axis=0) + bias**2)

    best = loss(w.astype(float), bias.astype(float))
    for _ in range(200):
        assert (loss(w + rng.normal(scale=0.02, size=w.shape), bias + rng.normal(scale=0.02, size=2)) > best - 1e-6).all()
    alone = [language_id.linear_svm(x, y[:, [k]], penalty, 4000) for k in (0, 1)]
    assert np.abs(np.hstack([a for a, _ in alone]) - w).max() < 1e-4


def test_many_languages_share_the_rows(spark):
    rows = [(j * 100 + i, f"{chr(97 + j)}{chr(98 + j)} " * 30, f"x{j}") for j in range(10) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, total=50)
    assert sorted(lang for family in model.families.values() for lang in family) == [f"x{j}" for j in range(10)]


def test_language_on_held_out(spark, data, odd, none):
    big = data.replace("sf0.001", "sf0.01")
    got = catalog.op7_language_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    edge = language_id.learn_and_identify(odd).collect()
    assert len(edge) == odd.count()
    assert {r["lang_pred"] for r in edge if r["doc_id"] in (0, 10, 20)} == {"und"}
    assert language_id.learn_and_identify(none).count() == 0


# 8


def test_packing(spark, data, odd, none):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(packing.default_tokenizer())
    for frame in (spark.read.parquet(f"{data}/documents.parquet"), odd.where("doc_id <> 30 and doc_id is not null")):
        texts = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
        pieces = packing.pack_power_of_two(frame, packing.default_tokenizer(), longest=256).collect()
        assert len({r["sequence_id"] for r in pieces}) == len(pieces) and all(r["offset"] == 0 for r in pieces)
        joined = {}
        for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
            ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
            assert len(ids) == r["length"] and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 256
            assert r["start"] == len(joined.setdefault(r["doc_id"], []))
            joined[r["doc_id"]] += ids
        assert joined == {k: [*reference.encode(t, add_special_tokens=False).ids, 2] for k, t in texts.items()}
    assert packing.pack_power_of_two(none, packing.default_tokenizer()).count() == 0


def test_buckets_hold_one_length(spark, data, none, tmp_path):
    pieces = packing.pack_power_of_two(spark.read.parquet(f"{data}/documents.parquet").limit(40), packing.default_tokenizer(), longest=64)
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert {f.name for f in (tmp_path / "buckets").iterdir() if f.is_dir()} <= {f"length={1 << k}" for k in range(7)}
    assert sorted(map(tuple, back.select(pieces.columns).collect())) == sorted(map(tuple, pieces.collect()))
    packing.write_buckets(packing.pack_power_of_two(none, packing.default_tokenizer()), str(tmp_path / "empty"))


def test_special_strings_are_the_librarys():
    from tokenizers import Tokenizer

    reference, encoder = Tokenizer.from_file(packing.default_tokenizer()), packing.Encoder(packing.default_tokenizer())
    for text in ("a <|endoftext|> b", "x\x1cy", "ǅ Ⱥ ﬁ", "don't 'S 12a3", "Å Å é́"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


# 9


def brute_repeats(rows, length=50):
    first = {}
    rows = sorted(((k, (t or "").encode()) for k, t in rows), key=lambda r: r[0])
    for key, raw in rows:
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], key)
    out = {}
    for key, raw in rows:
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < key:
                gone[i : i + length] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        out[key] = (len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return out


def test_merged_transforms_equal_brute_force():
    rng = np.random.default_rng(5)
    for trial in range(12):
        length = int(rng.integers(2, 9))
        strings = [bytes(rng.choice(list(b"aaabbc"), int(rng.integers(length, 40))).astype(np.uint8)) for _ in range(int(rng.integers(1, 30)))]
        value = rng.integers(0, 1000, len(strings))
        least = {}
        for s, v in zip(strings, value.tolist(), strict=True):
            for i in range(len(s) - length + 1):
                least[s[i : i + length]] = min(least.get(s[i : i + length], 10**9), v)
        windows = np.array([len(s) - length + 1 for s in strings])
        for shard in (30, 100, 1 << 16):
            got = bwt_dedup.Merged(strings, length, shard).least(value, windows)
            assert got.tolist() == [least[s[i : i + length]] for s in strings for i in range(len(s) - length + 1)], trial


def test_repeats_follow_brute_force(spark, data):
    rng = np.random.default_rng(6)
    passage = "".join(rng.choice(list("abcdefgh "), 200))
    rows = documents(spark, data) + [(9000 + i, passage[i * 3 : 100 + i * 3] + f" unlike {i} " + passage[150:]) for i in range(20)]
    rows += [(9100, None), (9101, ""), (9102, "x" * 49), (9103, "x" * 120), (9104, "x" * 50), (9105, "é" * 60), (9106, "ab" * 200), (9107, "q" + "ab" * 150)]
    got = bwt_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in got} == brute_repeats(rows)


def test_repeats_on_a_table(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in catalog.op9_suffix_dedup(spark, big).collect()}
    assert got == {k: (n, gone, spans, sha(kept)) for k, (n, gone, spans, kept) in brute_repeats(documents(spark, big)).items()}


def test_common_prefixes_of_merged_windows():
    rng = np.random.default_rng(12)
    strings = [bytes(rng.choice(list(b"aab"), int(rng.integers(6, 30))).astype(np.uint8)) for _ in range(40)]
    merged = bwt_dedup.Merged(strings, 6, 60)
    windows = [strings[merged.owner[r]][merged.place[r] :][:6] for r in merged.rows]
    assert windows == sorted(windows) and len(windows) == sum(len(s) - 5 for s in strings)
    shared = [next((k for k in range(6) if a[k] != b[k]), 6) for a, b in zip(windows, windows[1:], strict=False)]
    assert merged.common().tolist() == [0, *shared]
    assert merged.starts.tolist() == [0, *(i + 1 for i, c in enumerate(shared) if c < 6)]


def test_hot_phrases_are_divided(spark, monkeypatch):
    """One phrase in hundreds of surroundings, some of them shared: the same result by way of longer strings."""
    monkeypatch.setattr(bwt_dedup, "HEAVY", 2)
    monkeypatch.setattr(bwt_dedup, "HOT", 20)
    rng = np.random.default_rng(11)
    letters = list("abcdefgh ")
    word = lambda n: "".join(rng.choice(letters, n))
    phrase, around = "all rights are reserved to us", [(word(30), word(30)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [word(int(rng.integers(3, 40))) + phrase + word(int(rng.integers(3, 40))) for _ in range(3)]
        left, right = around[int(rng.integers(12))]
        parts.append(left[int(rng.integers(20)) :] + phrase + right[: int(rng.integers(10, 30))])
        rows.append((i, "|".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = bwt_dedup.drop_repeats(docs).collect()
    want = brute_repeats(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in got} == want
    assert sum(v[1] for v in want.values()) > 1000


def test_divided_strands_hold_the_same_windows():
    rng = np.random.default_rng(13)
    raw = [bytes(rng.choice(list(b"abc "), 400).astype(np.uint8)) for _ in range(5)]
    flat, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole, cut = bwt_dedup.Strands(flat, offsets), bwt_dedup.Strands(flat, offsets)
    cut.split(np.unique(cut.key)[::2])
    spread = lambda s: sorted((int(a) + i, int(o)) for a, w, o in zip(s.start, s.windows, s.owner, strict=True) for i in range(w))
    assert spread(whole) == spread(cut) and len(cut.start) > len(whole.start) and (cut.windows >= 1).all()


def test_long_shards_are_sorted_alike():
    """More symbols than fit thrice into one key."""
    rng = np.random.default_rng(14)
    pool = ["".join(rng.choice(list("abcd"), 25)).encode() for _ in range(3000)]
    strings = [pool[i] + pool[j] for i, j in rng.integers(0, 3000, (42_000, 2))]
    value = rng.integers(0, 10**6, len(strings))
    merged = bwt_dedup.Merged(strings, 40, 1 << 30)
    assert 3 * len(merged.bwt).bit_length() > 64
    least = {}
    for s, v in zip(strings, value.tolist(), strict=True):
        for i in range(11):
            least[s[i : i + 40]] = min(least.get(s[i : i + 40], 10**9), v)
    assert merged.least(value, np.full(len(strings), 11)).tolist() == [least[s[i : i + 40]] for s in strings for i in range(11)]


def test_transforms_are_inverted_by_walking():
    rng = np.random.default_rng(8)
    strings = [bytes(rng.choice(list(b"abca "), int(rng.integers(3, 40))).astype(np.uint8)) for _ in range(50)]
    size = np.array([len(s) for s in strings])
    shard = np.repeat(np.arange(5), 10)
    bwt = bwt_dedup.transforms(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size, shard)
    at = 0
    for k in range(5):
        own = strings[10 * k : 10 * k + 10]
        suffixes = sorted((s[i:], j, s[i - 1] + 1 if i else 0) for j, s in enumerate(own) for i in range(len(s) + 1))
        rows = bwt[at : at + len(suffixes)]
        assert rows.tolist() == [before for _, _, before in suffixes]
        at += len(suffixes)
    assert at == len(bwt)


def test_many_shards_are_sorted_alike():
    """A piece of a large corpus has a few strings for each of very many buckets."""
    rng = np.random.default_rng(15)
    strings = [bytes(rng.choice(list(b"ab"), int(rng.integers(3, 40))).astype(np.uint8)) for _ in range(1800)]
    size, shard = np.array([len(s) for s in strings]), np.repeat(np.arange(600), 3)
    bwt = bwt_dedup.transforms(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size, shard)
    want = []
    for k in range(600):
        suffixes = sorted((s[i:], j, s[i - 1] + 1 if i else 0) for j, s in enumerate(strings[3 * k : 3 * k + 3]) for i in range(len(s) + 1))
        want += [before for _, _, before in suffixes]
    assert bwt.tolist() == want


def test_key_filter_grows_with_its_keys(monkeypatch):
    monkeypatch.setattr(bwt_dedup, "LEAST_BITS", 1 << 12)
    rng = np.random.default_rng(16)
    keys, others = (np.unique(rng.integers(0, 1 << 63, 200_000).astype(np.uint64) << np.uint64(1)) for _ in range(2))
    cuts = np.array([1 << 62, 2 << 62, 3 << 62], dtype=np.uint64)
    held = [bwt_dedup.KeyFilter.long(bwt_dedup.KeyFilter.short(k)) for k in np.split(keys, np.searchsorted(keys, cuts))]
    sieve = bwt_dedup.KeyFilter([bwt_dedup.KeyFilter.segment(k, 4) for k in held])
    assert sieve.holds(np.searchsorted(cuts, keys, side="right"), keys).all()
    assert sieve.holds(np.searchsorted(cuts, others, side="right"), others).mean() < 0.06
    monkeypatch.setattr(bwt_dedup, "FILTER_BITS", 1 << 16)
    sieve = bwt_dedup.KeyFilter([bwt_dedup.KeyFilter.segment(k, 4) for k in held])
    assert len(sieve.bits) == 1 << 13 and sieve.holds(np.searchsorted(cuts, keys, side="right"), keys).all()


def test_rows_of_a_large_corpus_stay_long():
    """6 GB in 940 pieces: with a row for each of 56,400 buckets a piece would send 53 million rows."""
    assert bwt_dedup._together(80, 4175, 51) == 5
    assert 940 * 56_400 / bwt_dedup._together(940, 56_400, 600) < 3_000_000
    assert bwt_dedup._together(1, 1, 200) == 1


def test_neighbouring_buckets_travel_together(spark, data, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "SENT", 1 << 20)
    monkeypatch.setattr(bwt_dedup, "BUCKET", 1 << 10)
    seen = []
    together = bwt_dedup._together
    monkeypatch.setattr(bwt_dedup, "_together", lambda *x: seen.append(together(*x)) or seen[-1])
    rows = documents(spark, data)
    got = bwt_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in got} == brute_repeats(rows)
    assert seen[0] > 2


def test_repeats_edges(odd, none):
    got = bwt_dedup.drop_repeats(odd).collect()
    assert len(got) == odd.count()
    assert bwt_dedup.drop_repeats(none).count() == 0
    assert bwt_dedup.drop_repeats(odd, as_text=True).where("text is null").count() == 0


# 10


@pytest.fixture(scope="module")
def reader():
    return html_blocks.train()


def test_blocks_of_unseen_layouts(reader):
    right = total = 0
    for x, y in html_blocks.training_pages(60, seed=123):
        a, mask, _ = html_blocks.padded([(x, y)])
        right += int(((reader.chances(a, mask)[:, 0] >= 0.5) == (y > 0.5)).sum())
        total += len(y)
    assert right / total > 0.985


def test_pages(spark, data, reader):
    rows = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html_blocks.extract(spark.read.parquet(f"{data}/pages.parquet"), reader).collect()}
    for r in rows:
        article = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        assert got[r["page_id"]] == "\n".join(leaf.text for leaf in html_blocks.leaves(article))


#: Pages with their main text, written by hand.
HAND_PAGES = [
    ("<html><head><title>T</title></head><body><nav class='menu'><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav><article><h1>On  rivers</h1><p>Water runs\n down &amp; on, year after year, to the sea.</p><p>It carries <b>sand</b> and stones<br>with it.</p></article><footer><p>Copyright 2020. All rights reserved.</p></footer></body></html>",
     "On rivers\nWater runs down & on, year after year, to the sea.\nIt carries sand and stones with it."),
    ("<body><div id='cookie-notice'><p>We use cookies to improve your experience.</p><button>Accept</button></div><header><a href='/'>Daily Paper</a></header><main><h2>Wool</h2><p>Sheep are shorn in spring, when the days grow warm.</p><script>track('x<p>y</p>')</script><ul><li>Wash it</li><li>Card it</li></ul></main><aside class='sidebar'><h3>Popular</h3><a href='/1'>Ten cats</a></aside></body>",
     "Wool\nSheep are shorn in spring, when the days grow warm.\nWash it\nCard it"),
    ("<body><article class='post'><p>Bread needs flour, water, salt and time &#8212; mostly time.</p></article><section class='comments'><div class='comment'><p>Great post, thanks!</p></div></section><form action='/s'><label>Email</label><input><button>Subscribe</button></form></body>",
     "Bread needs flour, water, salt and time — mostly time."),
]


def test_hand_written_pages(reader):
    assert html_blocks.main_texts([page for page, _ in HAND_PAGES], reader) == [text for _, text in HAND_PAGES]


def test_long_and_endless_pages(reader):
    import time

    began = time.time()
    for broken in ('<a "', "<a '\"", "<svg \"", "<!<", "<script ", "<div>"):
        html_blocks.leaves(broken * (1_000_000 // len(broken)))
    assert time.time() - began < 30
    page = "<article><h1>Title of it</h1>" + "".join(f"<p>This is line {i} of a very long article, one of many.</p>" for i in range(100_000)) + "</article>"
    got = html_blocks.main_texts(["<p>short</p>", page], reader)
    assert got[1].count("\n") > 99_000
    blocks = html_blocks.leaves(page)[:3000]
    x, mask, _ = html_blocks.padded([(html_blocks.features(blocks), np.zeros(len(blocks), np.float32))])
    assert np.abs(reader.chances(x, mask)[:, 0] - reader.long_page(blocks, 700)).max() < 1e-4


def test_leaves_of_broken_markup():
    page = "<!-- <p>no</p> --><p>a <b>b<br>c<p>d &amp; e<script>var x='</p>';</script><ul><li>one<li>two</ul>1 < 2<style>p{}</style>"
    assert [leaf.text for leaf in html_blocks.leaves(page)] == ["a b c", "d & e", "one", "two", "1 < 2"]
    assert html_blocks.leaves("") == [] and html_blocks.leaves("<p") [0].text == "<p"


def test_gradient_is_the_slope():
    model, (x, y) = html_blocks.BiLstm(), html_blocks.training_pages(1, seed=1)[0]
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    a, mask, target = html_blocks.padded([(x[:6], y[:6]), (x[:4], y[:4])])
    loss = lambda: -(mask * (target * np.log(c := model.chances(a, mask)) + (1 - target) * np.log(1 - c))).sum() / mask.sum()
    grad = model.gradient(a, mask, target)
    for name, at in (("fx", (3, 5)), ("bh", (2, 40)), ("o", 7), ("fb", 30)):
        before, step = model.p[name][at], 1e-2
        model.p[name][at] = before + step
        up = loss()
        model.p[name][at] = before - step
        down = loss()
        model.p[name][at] = before
        assert grad[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-5)


def test_page_edges(spark, reader):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain"), (4, "u", "<p>" * 300)]
    got = html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), reader)
    assert got.count() == 4 and got.where("text is null").count() == 0
    assert html_blocks.extract(spark.createDataFrame([], "page_id long, url string, html string"), reader).count() == 0


def test_held_out_is_zlibs(spark):
    got = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_icons_do_not_end_the_page():
    texts = lambda page: [leaf.text for leaf in html_blocks.leaves(page)]
    for icon in ('<svg-icon name="x"></svg-icon>', "<template-card></template-card>", '<svg class="i" viewBox="0 0 9 9"/>', "<svg/>", '<SVG data-x="a>b" />'):
        assert texts(f"<p>head</p>{icon}<p>body</p>") == ["head", "body"]
        assert texts(f"<p>head</p>{icon}<p>body</p><svg><text>no</text></svg><p>end</p>") == ["head", "body", "end"]
    assert texts("<p>a</p><svg viewBox='0'><path d='x'/><title>no</title></svg><p>b</p><script src=x/>no</script><p>c</p>") == ["a", "b", "c"]
    assert texts('<p>a</p><svg data-x="a/>b"><title>no</title></svg><p>b</p>') == ["a", "b"]


def test_every_language_is_learned(spark):
    tags = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(68)] + ["pt-BR", "pt-PT"]
    rows = [(5 * i + j, f"{tag} {tag[::-1]} " * 20 + f"w{j}", tag) for i, tag in enumerate(tags) for j in range(5 if i else 1)]
    docs = spark.createDataFrame([*rows, (999, "no language", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert sorted(lang for family in model.families.values() for lang in family) == sorted(tags)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.98


def test_likeness_falls_with_edits():
    """The more of a text is edited, in place or by moving it, the less like it is to itself."""
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("abcdefghijklmnop "), 6000))
    before, own = 1.01, order_minhash.signature(text)
    for share in (0.0, 0.002, 0.01, 0.05, 0.2):
        changed = list(text)
        for at in rng.choice(len(text), int(share * len(text)), replace=False):
            changed[at] = "XYZ"[int(rng.integers(3))]
        like = order_minhash.likeness(own, order_minhash.signature("".join(changed)))
        assert like < before
        before = like
    assert before < 0.2
