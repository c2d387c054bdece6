import random

import numpy as np
import pytest

import corpus_pipeline
from tapeline.llm import ngram_join


def brute(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()})
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 120))) for _ in range(n // 8)]
    rows = []
    for i in range(n):
        t = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = rng.choice(words)
        t = " ".join(t)
        if rng.random() < 0.3:
            t += rng.choice([" ", "\n", "\t "]) + passage
        rows.append((i, t.upper() if rng.random() < 0.1 else t))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "Short text"), (n + 4, "short  TEXT"), (n + 5, "text short"), (n + 5, "short text")]


@pytest.mark.parametrize(("seed", "limit"), [(1, ngram_join.REGION_SHINGLES), (2, 600), (3, 2500)])
def test_classes_equal_all_pairs(spark, seed, limit):
    rows = corpus(seed, 240)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string").repartition(3)
    got = ngram_join.join_classes(df, region_shingles=limit)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty_table(spark):
    assert ngram_join.join_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def edited_sets(rng, n, families, length=100):
    """Chains of edits: every set replaces some shingles of an earlier one."""
    sets = [{rng.getrandbits(60) for _ in range(length)} for _ in range(families)]
    while len(sets) < n:
        x = sorted(rng.choice(sets))
        rng.shuffle(x)
        sets.append(set(x[rng.randint(0, 14) :]) | {rng.getrandbits(60) for _ in range(rng.randint(0, 14))})
    rng.shuffle(sets)
    return sets


def linked(x, y):
    return 4 * len(x & y) >= 3 * len(x | y)


@pytest.mark.parametrize("seed", range(12))
def test_screen_keeps_every_link_across_labels(seed):
    rng = random.Random(seed)
    sets = edited_sets(rng, 60, 4)
    # heads are cut in one order of all shingles
    heads = [np.array(sorted(x)[: ngram_join.head_length(len(x))], np.int64) for x in sets]
    labels = np.array([rng.choice([0, 0, 0, 0, 1, 2, 3 + i]) for i in range(len(sets))])
    flagged = ngram_join.screen_region(heads, np.array([len(x) for x in sets]), labels)
    wanted = {k for i in range(len(sets)) for j in range(i) if labels[i] != labels[j] and linked(sets[i], sets[j]) for k in (i, j)}
    assert wanted and wanted <= set(np.flatnonzero(flagged).tolist())


def test_screen_flags_majority_near_flagged_only():
    # x and y are near, z of the largest label is near y only
    x, y, z = set(range(0, 100)), set(range(14, 114)), set(range(28, 128))
    sets = [x, y, z, set(range(1000, 1100))]
    assert linked(x, y) and linked(y, z) and not linked(x, z)
    heads = [np.array(sorted(s)[: ngram_join.head_length(100)], np.int64) for s in sets]
    assert ngram_join.screen_region(heads, np.array([100] * 4), np.array([1, 2, 3, 3])).tolist() == [True, True, True, False]


def parts(n, pairs):
    """The least member of each member's component."""
    known = ngram_join.Links(n)
    for i, j in pairs:
        known.join(i, j)
    least = {}
    for i in range(n):
        least.setdefault(known.find(i), i)
    return [least[known.find(i)] for i in range(n)]


@pytest.mark.parametrize("seed", range(12))
def test_region_with_settled_members_equals_all_pairs(seed):
    rng = random.Random(seed)
    sets = edited_sets(rng, 40, 3)
    groups = [-1 if rng.random() >= (0.5, 0.9, 1.0)[seed % 3] else i for i in range(40)]
    ball = [i for i, g in enumerate(groups) if g == -1]
    known = [(ball[0], i) for i in ball]  # by way of the sub-pivot
    found = ngram_join.join_region([np.array(sorted(x), np.uint64) for x in sets], groups)
    assert all(linked(sets[i], sets[j]) for i, j in found)
    wanted = [(i, j) for i in range(40) for j in range(i) if linked(sets[i], sets[j])]
    assert parts(40, found + known) == parts(40, wanted + known)


def test_region_compares_who_hangs_on_the_ball():
    # v settled, u and w around it: w-u and u-v are links, w-v is none
    v, u, w = set(range(0, 100)), set(range(12, 112)), set(range(24, 124))
    assert linked(v, u) and linked(u, w) and not linked(v, w)
    found = ngram_join.join_region([np.array(sorted(x), np.uint64) for x in (w, u, v)], [0, 1, 2])
    assert parts(3, found) == [0, 0, 0]


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(5, a), (6, a + " end"), (5, b + " end"), (2, b), (None, c), (None, c + " end"), (None, c), (7, d), (7, d), (8, None), (9, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string").repartition(3)
    got = ngram_join.one_of_each(df)
    kept = got.collect()
    assert got.columns == df.columns and all((r.doc_id, r.text) in rows for r in kept)
    assert sorted(str(r.doc_id) for r in kept) == ["2", "5", "7", "8", "9", "None"]
    assert {(5, a), (2, b), (7, d)} <= {(r.doc_id, r.text) for r in kept}
    assert sorted(map(tuple, corpus_pipeline.one_of_each_group(spark, df, "").select("doc_id").collect()), key=str) == sorted([(r.doc_id,) for r in kept], key=str)
