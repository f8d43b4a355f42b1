"""Ranked search, token alignment and language-model scores against brute force, with their edge cases."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcast.llm import gru, language_model, ranked_search, token_alignment

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# 11. alignment


@pytest.fixture(scope="module")
def tokenizers():
    with open(token_alignment.vocabulary_file(), encoding="utf-8") as f, open(token_alignment.model_file(), "rb") as g:
        return token_alignment.Tokenizers(f.read(), g.read())


def python_alignment(rows):
    """The rows of align() and of groups() for (doc_id, text), by sets of ends."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    of_a, of_b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of_a.encode_special_tokens = True
    letters, token = token_alignment.byte_letters(), {k: t for t, k in of_a.get_vocab().items()}
    bytes_a = lambda k: bytes(letters[c] for c in token[k])
    bytes_b = lambda k: bytes([int(of_b.id_to_piece(k)[1:-1], 16)]) if of_b.is_byte(k) else of_b.id_to_piece(k).replace("▁", " ").encode()
    found, counts = [], Counter()
    for doc, text in rows:
        a, b = (of_a.encode(" " + text, add_special_tokens=False).ids, of_b.encode(text)) if text else ([], [])
        x, y = [bytes_a(k) for k in a], [bytes_b(k) for k in b]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            found.append((doc, 0, 0, [], "", [], []))
            continue
        ends_a, ends_b = list(itertools.accumulate(map(len, x))), list(itertools.accumulate(map(len, y)))
        common = sorted(set(ends_a) & set(ends_b))
        ia, jb = [ends_a.index(e) + 1 for e in common], [ends_b.index(e) + 1 for e in common]
        cut = [(a[i:k], b[j:m]) for i, k, j, m in zip([0, *ia], ia, [0, *jb], jb)]
        links = [(p[-1], q[-1]) for p, q in cut]
        counts.update(links)
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in cut)
        found.append((doc, len(a), len(b), links, hashlib.sha256(written.encode()).hexdigest(), ia, jb))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(d, na, nb, len(p), len(p), sum(counts[x] == most[x[1]] for x in p), sum(counts[x] for x in p), h) for d, na, nb, p, h, _, _ in found], [(d, ia, jb) for d, *_, ia, jb in found]


ODD_TEXTS = [
    (None, "▁x"), (None, "one two"), (10**9, ""), (10**9 + 1, None), (10**9 + 2, "<|endoftext|> and <s> </s> <unk>"), (10**9 + 3, "a " * 3000), (10**9 + 4, "日本語 \U0001f600 \x00 é é"),
    (10**9 + 5, " "), (10**9 + 6, "  x\n\n\t y  "), (10**9 + 7, "same text"), (10**9 + 7, "same text"), (10**9 + 8, "x" * 5000), (10**9 + 9, " 　 z ﻿"),
]


def test_alignment_by_brute_force(spark, docs):
    odd = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string").withColumns({"links": F.lit("x"), "n_a": F.lit("x")})
    rows = docs.select("doc_id", "text", F.lit("y").alias("links"), F.lit("y").alias("n_a")).unionByName(odd)
    want, groups = python_alignment([(r.doc_id, r.text) for r in rows.collect()])
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted((tuple(r) for r in token_alignment.align(rows.repartition(5)).collect()), key=key) == sorted(want, key=key)
    got = [(r.doc_id, r.a_ends, r.b_ends) for r in token_alignment.groups(odd).collect()]
    assert sorted(got, key=key) == sorted(groups[-len(ODD_TEXTS) :], key=key)
    assert token_alignment.align(rows.limit(0)).count() == 0


def test_runs_are_skipped_to_all_common_ends():
    rng = np.random.default_rng(3)
    for dense, size in itertools.product((0.1, 0.5, 0.9, 0.99), (1, 7, 1024)):
        ends = np.flatnonzero(rng.random(4000) < 0.8)
        ea, eb = (np.append(ends[rng.random(len(ends)) < dense], 4000) for _ in range(2))
        ia, jb = token_alignment.common_ends(ea, eb, size)
        both = np.intersect1d(ea, eb)
        assert (ea[ia] == both).all() and (eb[jb] == both).all()
    ia, jb = token_alignment.common_ends(np.arange(1, 9), np.array([8]))
    assert (ia.tolist(), jb.tolist()) == ([7], [0])
    assert len(token_alignment.common_ends(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0


def test_possible_pairs_are_bounded_by_the_vocabularies(tokenizers):
    a, b = [b"a", b"ba", b"", b"c"], [b"a", b"cba", b"cc"]
    assert [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in token_alignment.possible_pairs(a, b)] == [(0, 0), (0, 1), (1, 0), (1, 1), (3, 2)]
    assert len(tokenizers.pairs) <= sum(map(len, tokenizers.of_a.entries)) + sum(map(len, tokenizers.of_b.entries))


# 12. language model


def python_base(rows):
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None]
    fold = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 10
    c = Counter()
    for d, t in rows:
        if fold(d):
            c.update(words(t))
    n, v = sum(c.values()), len(c)
    return [(d, fold(d) == 0, len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for d, t in rows]


ODD_WORDS = [(None, "the the ÄB"), (10**9, ""), (10**9 + 1, None), (10**9 + 2, " \n ÄB äb "), (10**9 + 3, "a " * 4000), (10**9 + 7, "same text"), (10**9 + 7, "same text"), (10**9 + 8, "x" * 5000)]


def test_scores_of_documents(spark, docs):
    odd = spark.createDataFrame(ODD_WORDS, "doc_id long, text string").withColumns({"fold": F.lit("x"), "words": F.lit("x"), "score": F.lit("x")})
    rows = docs.select("doc_id", "text", *(F.lit("y").alias(c) for c in ("fold", "words", "score"))).unionByName(odd)
    got = language_model.score(rows.repartition(3), rounds=2, trainer_words=30_000).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2:4], round(r[5], 3))
    want = sorted(python_base([(r.doc_id, r.text) for r in rows.collect()]), key=key)
    for g, w in zip(sorted((tuple(r)[:6] for r in got), key=key), want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
    held = [r for r in got if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_documents_outside_the_ones_of_every_round_are_learnt_from(spark, monkeypatch):
    """Without any that are in every round, each training document is in one of them."""
    df = spark.range(60).selectExpr("id doc_id", "concat('a b c d ', id % 7) text")
    ready, counts = language_model.numbered(df)
    seen = []
    mean = language_model._mean
    monkeypatch.setattr(language_model, "_mean", lambda rows: (seen.append(sum(n for n, _ in rows)), mean(rows))[1])
    got = language_model.fit(ready, counts, rounds=3, least=0, share=0.0)
    assert len(seen) == 3 and all(seen) and sum(seen) == counts.n
    assert not np.array_equal(gru.pack(got), gru.pack(gru.start(counts.start)))


def test_scores_without_training_documents(spark):
    held_out = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    df = spark.createDataFrame([(held_out, "a b"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score(df).collect()}
    assert got[held_out].held_out and not got[None].held_out and {r.train_tokens for r in got.values()} == {0}
    assert got[held_out].base_score == 0 and got[held_out].n_known == 0 and got[held_out].n_tokens == 3
    assert language_model.score(df.limit(0)).count() == 0


def small_model(seed=5):
    rng = np.random.default_rng(seed)
    p = gru.start(rng.integers(1, 50, 300).astype(float))
    for k in ("wc", "ww"):
        p[k] += rng.normal(0, 0.3, p[k].shape).astype(np.float32)
    return p, rng


def test_probabilities_of_all_words_add_up_to_one():
    p, rng = small_model()
    h = rng.normal(0, 1, (1, gru.HIDDEN)).astype(np.float32)
    log, _ = gru.predicted(p, np.repeat(h, gru.SIZE**2, axis=0), np.arange(gru.SIZE**2))
    assert np.exp(log.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    start = gru.start(np.arange(1, 301.0))
    log, _ = gru.predicted(start, np.repeat(h, 300, axis=0), np.arange(300))
    assert np.allclose(np.exp(log), np.arange(1, 301) / np.arange(1, 301).sum(), rtol=1e-3)


def test_a_score_depends_on_the_whole_document_and_on_nothing_else():
    p, rng = small_model()
    docs = [np.append(rng.integers(1, 300, n), gru.END) for n in (0, 1, 31, 32, 33, 1500, 5)] * 50
    together = gru.log_likelihoods(p, docs)
    for k in range(7):
        h, log = np.zeros((1, gru.HIDDEN), np.float32), 0.0
        for x, y in zip([gru.END, *docs[k][:-1].tolist()], docs[k].tolist()):
            hs, h = gru.states(p, h, np.array([[x]]), np.array([[False]]))
            log += float(gru.predicted(p, hs[0], np.array([y]))[0][0])
        assert together[k] == pytest.approx(log, rel=1e-4) and np.allclose(together[k::7], together[k], rtol=1e-4)


def test_gradients_by_differences():
    p, rng = small_model()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    lanes = gru.Lanes([np.append(rng.integers(1, 300, n), gru.END) for n in (9, 4, 12)], 2)
    at, real = next(lanes.windows(8))
    h = rng.normal(0, 1, (at.shape[1], gru.HIDDEN))
    arguments = h, lanes.inputs[at], lanes.first[at], lanes.targets[at], real
    loss = lambda p: -gru.gradients(p, *arguments)[2] / real.sum()
    found = gru.gradients(p, *arguments)[0]
    rows, values = found["x"]
    found["x"] = np.zeros(gru.SHAPES["x"])
    found["x"][rows] = values
    for k, g in found.items():
        for place in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(6)] + [np.unravel_index(int(np.abs(g).argmax()), g.shape)]:
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][place] += 1e-3
            down[k][place] -= 1e-3
            assert (loss(up) - loss(down)) / 2e-3 == pytest.approx(float(g[place]), abs=2e-4), k


# 13. ranked search


def python_search(docs, items, top=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    words = [(d, Counter(terms(t))) for d, t in docs]
    able = [w for _, w in words if w]
    n_docs, n_terms = len(able), sum(sum(w.values()) for w in able)
    df = Counter(t for w in able for t in w)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in asked.items():
        scores = []
        for d, w in words:
            m = 50 + (50 * sum(w.values()) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w[t]) // (1000 * w[t] + 20 * m)) for t in own if w[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(i, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return out


def test_search_by_brute_force(spark):
    rng = np.random.default_rng(9)
    letters = [f"w{k}" for k in range(40)] + ["É\U0001f600", "ABC"]
    texts = [" ".join(rng.choice(letters, int(rng.integers(0, 30)) + 1)) for _ in range(300)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (None, texts[8]), (None, None), (500, ""), (501, "..."), (502, "w1 " * 20000), *((600 + k, "w3 w4") for k in range(70))]
    items = [(k, " ".join(rng.choice(letters, 6))) for k in range(12)] + [(1, "w2 abc"), (None, "w5 W5"), (20, None), (21, ""), (22, "nothing of it"), (23, "w3 w4")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    clash = {c: F.lit("x") for c in ("term", "chunk", "rank", "score")}
    got = ranked_search.search(d.withColumns(clash).repartition(7), i.withColumns(clash))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(python_search(docs, items), key=key)
    assert sorted(map(tuple, ranked_search.search(d, i, top=3).collect()), key=key) == sorted(python_search(docs, items, 3), key=key)
    assert ranked_search.search(d.limit(0), i).count() == 0 and ranked_search.search(d, i.limit(0)).count() == 0


def test_search_in_blocks_of_items_and_small_chunks(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = sorted(map(tuple, ranked_search.search(docs, bench).collect()))
    monkeypatch.setattr(ranked_search, "BLOCK_PAIRS", 100)
    monkeypatch.setattr("quillcast.llm.chunks.CHUNK_ROWS", 16)
    assert sorted(map(tuple, ranked_search.search(docs, bench).collect())) == want


def test_best_positions_stop_before_the_lists_end():
    rng = np.random.default_rng(2)
    lists = [ranked_search.ImpactList(np.sort(rng.choice(20000, n, replace=False)), rng.zipf(1.5, n).clip(1, 10**6).astype(np.int64)) for n in (9000, 15000, 400)]
    docs, scores, read = ranked_search.best_positions(lists, 20000, 10)
    every = np.zeros(20000, np.int64)
    for x in lists:
        every[x.docs] += x.impact
    assert read < 24400 and sorted(scores)[-10:] == sorted(every)[-10:] and (every[docs] == scores).all()
    same = [ranked_search.ImpactList(np.arange(1000), np.full(1000, 5))]
    assert len(ranked_search.best_positions(same, 1000, 10)[0]) == 1000  # ties with the last are all met


def test_a_trainer_of_more_words_takes_wider_windows_not_more(monkeypatch):
    rng = np.random.default_rng(2)
    seen, plain = [], gru.gradients
    monkeypatch.setattr(gru, "gradients", lambda *a: seen.append(a[2].shape) or plain(*a))
    for words in (40_000, 800_000):
        docs = [np.append(rng.integers(1, 300, 399), gru.END) for _ in range(words // 400)]
        _, _, n = gru.train(gru.start(np.arange(1.0, 301.0)), docs)
        assert n == words and len(seen) < 1.2 * gru.WINDOWS and sum(a * b for a, b in seen) >= words
        assert seen[0][1] >= gru.TRAIN_LANES
        seen.clear()


def test_outputs_out_of_the_range_of_floats_are_shifted():
    c = np.array([[200.0, 100.0], [-200.0, -300.0], [0.0, 1.0]], np.float32)
    log, _ = gru._softmax(c.copy(), np.arange(3), np.array([0, 0, 1]))
    assert np.allclose(log, [0, 0, 1 - np.log(1 + np.e)], atol=1e-6)


def test_distinct_hashes_sort_only_different_ones(monkeypatch):
    words = np.random.default_rng(3).integers(0, 2**64, 500, np.uint64)
    for x in (words[np.random.default_rng(4).integers(0, 500, 20_000)], words[:1], words[:0]):
        want, sorted_ = np.unique(x, return_inverse=True), []
        sort = np.argsort
        with monkeypatch.context() as m:
            m.setattr(np, "argsort", lambda v, *a, **k: sorted_.append(len(v)) or sort(v, *a, **k))
            different, own = language_model._distinct(x)
        assert sorted_ == [len(want[0])] and different.dtype == np.uint64
        assert np.array_equal(different, want[0]) and np.array_equal(own, want[1])
