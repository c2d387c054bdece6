"""Language model scores against plain counting, and the model as a distribution."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapeline.llm import lm_scores
from tapeline.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, base string"


def plain(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score) of rows with different ids, by plain counting."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    words = {i: [*WORD.findall(lower(t)), None] for i, t in rows}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in words.items()}


def compare(got, want):
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-11)


def test_base_scores_by_plain_counting(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    got = lm_scores.score_texts(docs).collect()
    compare(got, want)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)
    monkeypatch.setattr(lm_scores, "HEAD", 40)  # nearly all words are joined
    compare(lm_scores.score_texts(docs).collect(), want)


def test_model_beats_single_words_on_held_out_texts(spark):
    got = lm_scores.score_texts(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").collect()
    assert sum(r.score for r in got) > 0.85 * sum(r.base_score for r in got)


def test_probabilities_of_all_words_sum_to_one(spark):
    texts = [f"{a} b{i % 7} c{i % 31} d{i}{a}" for i in range(300) for a in ("the", "la")]
    rows = spark.createDataFrame([(5 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts, book, weights = lm_scores.train(rows)
    all_counts = {r.word: r.c for r in counts.collect()}
    mass, types = book.rare
    rare = [c for w, c in all_counts.items() if c < book.least and w != int(lm_scores.END)]
    assert (sum(rare), len(rare)) == (mass, types)
    share = np.bincount(book.classes, weights=10.0**book.shares, minlength=lm_scores.CLASSES)
    share[lm_scores.RARE] = sum((c - book.discount) / mass for c in rare) + book.discount * types / mass
    seen, starts = lm_scores.tokens([b"the b1 c1", b"unknown words here", b""])
    p, _ = lm_scores.softmax(lm_scores.logits(weights, book.prior(), lm_scores.features(seen, starts)))
    assert np.allclose(share[share > 0], 1) and np.allclose(p @ share, 1, atol=1e-5)


def test_context_is_learned(spark):
    """After ``a`` comes ``x``, after ``b`` comes ``y``; two words on, the skip feature tells."""
    rows = spark.createDataFrame([(i, "a x q " * 20 if i % 2 else "b y r " * 20) for i in range(400)], "doc_id long, text string")
    _, book, weights = lm_scores.train(rows)
    got = lm_scores.score_batch([b"a x q a x q", b"a y q b x r"], book, weights)[3]
    assert got[0] > got[1] + 2


def test_slices_do_not_change_scores(monkeypatch):
    words = lm_scores.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 10, 3, 2, np.ones(lm_scores.CLASSES), 0.5, (10, 3))
    weights = np.random.default_rng(1).standard_normal((lm_scores.FEATURES, lm_scores.CLASSES)).astype(np.float32)
    texts = [b"one two", b"", b"word " * 3000, b"last"]
    whole = lm_scores.score_batch(texts, words, weights)[3]
    monkeypatch.setattr(lm_scores, "SLICE", 7)
    assert np.allclose(lm_scores.score_batch(texts, words, weights)[3], whole, rtol=1e-6)
    assert np.allclose([lm_scores.score_batch([t], words, weights)[3][0] for t in texts], whole, rtol=1e-6)


def test_special_rows(spark):
    rows = [(None, "a b", "x", "y"), (1, None, None, None), (2, "", "x", "y"), (3, "A a\x1fb", "x", "y"), (3, "A a\x1fb", "x", "y"), (4, "w " * 200_000, "x", "y"), (6, "É é É", "x", "y")]
    got = lm_scores.score_texts(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id", "n_tokens").collect()
    assert len(got) == len(rows) and not got[0].held_out and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
    assert [r.n_tokens for r in got if r.doc_id in (3, 4, 6)] == [3, 3, 200_001, 4] and len({r.train_tokens for r in got}) == 1
    assert len({(r.base_score, r.score) for r in got if r.doc_id == 3}) == 1 and all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert lm_scores.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    alone = lm_scores.score_texts(spark.createDataFrame([(i, "some words", "", "") for i in held], SCHEMA)).collect()
    assert {(r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in alone} == {(True, 0, 0, 0.0, 0.0)}
