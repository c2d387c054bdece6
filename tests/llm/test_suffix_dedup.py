import hashlib
import random
from collections import Counter

import pytest

from tapeline.llm import suffix_dedup as s


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n, letters):
    rng = random.Random(seed)
    piece = lambda a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    passages = [piece(15, 90) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages)[rng.randint(0, 8) :] if rng.random() < 0.4 else piece(3, 60) for _ in range(rng.randint(0, 7))]
        rows.append((i, "".join(parts)))
    rows += [(n + i, rows[i][1]) for i in range(5)]
    return rows + [(900, None), (901, ""), (902, "ab" * 60), (903, "ab" * 60), (904, "x" * 90), (None, "y" * 200), (905, "y" * 20)]


@pytest.mark.parametrize(("seed", "letters", "most"), [(1, "abcdefghijklmnopqrstuvwxyz é", 3), (2, "abc", 3), (3, "ab", 3), (1, "abcdefghijklmnopqrstuvwxyz é", 4096), (2, "abc", 4096), (3, "ab", 9)])
def test_equals_brute_force(spark, seed, letters, most, monkeypatch):
    monkeypatch.setattr(s, "RUN_SUFFIXES", 50)
    monkeypatch.setattr(s, "GROUP_STRINGS", most)
    monkeypatch.setattr(s, "TOGETHER_STRINGS", 40)
    monkeypatch.setattr(s, "GROUP_WINDOWS", 5 * most)
    rows = corpus(seed, 60, letters)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long").repartition(3)
    got = s.summary(s.remove_repeats(df, length=20, gram=6))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 20)


def test_production_length(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(60), text(45), text(38)]
    rows = [(i, text(rng.randint(5, 90)) + rng.choice(["", *shared]) + text(20) + rng.choice(["", *shared])) for i in range(40)]
    got = s.summary(s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 200)


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(3)
    runs = [{bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))): [(rng.randint(-9, 9), rng.randint(0, 9)) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 30))} for _ in range(7)]
    got, before = list(s.merged([s.front_coded(r) for r in runs])), b""
    assert [x for _, x, _ in got] == sorted(x for r in runs for x in r)
    for lcp, x, _ in got:
        assert lcp == next((i for i, (a, b) in enumerate(zip(before, x, strict=False)) if a != b), min(len(before), len(x)))
        before = x


def test_empty_table(spark):
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
