"""The audit of filters against plain Python."""

import re
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeline.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, lang string, part string, fails int", "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(doc_id, text, ids):
    words, text = WORD.findall(text or ""), text or ""
    least = min((i for i in ids if i is not None), default=None)
    tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), doc_id is not None and doc_id > least)
    return {f for f, bad in zip("ABCDE", tests, strict=True) if bad}


def plain(docs, labels):
    ids = {}
    for i, text, *_ in docs:
        ids.setdefault(text or "", []).append(i)
    rows = {}
    for i, text, lang, *_ in docs:
        good, bad = (any(x[k] == 1 for x in labels if x[0] == i and i is not None) for k in (1, 2))
        rows.setdefault(lang or "", []).append((failing(i, text, ids[text or ""]), good, bad))
    out = {}
    for part, found in rows.items():
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, own in enumerate(order):
                before = set(order[:k])
                gone = [r for r in found if own in r[0] and not r[0] & before]
                removed[own] += len(gone)
                out[part, "".join(order), k + 1] = [sum(not r[0] & (before | {own}) for r in found), len(gone), sum(own in r[0] and bool(r[0] & before) for r in found), sum(r[0] == {own} for r in found), sum(r[1] for r in gone), sum(r[2] for r in gone), own]
        for key in out:
            if key[0] == part:
                out[key][6] = removed[out[key][6]]
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got}


def test_audit_by_plain_python(spark):
    rng, docs = np.random.default_rng(3), []
    for i in range(400):
        n = int(rng.integers(0, 420))
        text = " ".join(("W" if rng.random() < rng.choice([0, 0.3]) else "w") + str(int(rng.integers(0, rng.choice([20, 4000])))) for _ in range(n)) + rng.choice(["", "#", " é", "\x1f|"])
        docs.append((i, text, ["en", "fr", "", None][i % 4], "x", 1))
    docs += [(i + 1000, docs[i % 9][1], "en", None, None) for i in range(200)]  # a group of copies
    docs += [(None, docs[0][1], "en", None, None), (0, docs[0][1], "fr", None, None), (0, docs[0][1], "en", None, None), (7, None, None, None, None), (9, "", "", None, None), (12, "a" * 2_000_000 + " # ", "long", "", 0)]
    labels = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(0, 1200, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (8, None, None)]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "a", None, "", 1)], []) == plain([(1, "a", None)], [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAZ#|é€😀 \t\n\x0b\x1f\x85\xa0"), max_size=60), min_size=1, max_size=6))
def test_transducer(texts):
    words, distinct, points, capitals, symbols = filter_audit.measures([t.encode() for t in texts])
    for i, t in enumerate(texts):
        found = WORD.findall(t)
        assert (words[i], distinct[i], points[i], capitals[i], symbols[i]) == (len(found), len(set(found)), len(t), len(re.findall("[A-Z]", t)), len(re.findall("[#$%&*|]", t)))


def test_colliding_hashes_are_verified():
    """With one hash for all words the table still tells them apart, by their bytes."""
    data = np.frombuffer(b"aa bb aa cc bb dd aa", np.uint8)
    begins = np.arange(0, 20, 3)
    owner = np.array([0, 0, 0, 0, 1, 1, 1])
    new = filter_audit.distinct_spans(data, begins, begins + 2, owner, np.zeros(7, np.uint64))
    assert np.bincount(owner[new]).tolist() == [3, 3]
