"""What the indexes of the nearest and of the decontamination operator look at, and what they find."""

import random
import resource

import numpy as np
import pytest

from tapeline.llm import ann, decontam
from tapeline.session import table


def searched(x, k=21, queries=150):
    """Recall of the 20 nearest and share of all pairs verified, with cells one after the other as the operator visits them."""
    n, confidence = len(x), ann.nearest.__defaults__[2]
    top = np.sqrt((x**2).sum(1).max())
    planes = np.random.default_rng(7).standard_normal((x.shape[1] + 1, ann.M))
    points = np.hstack([x, np.sqrt(np.maximum(top**2 - (x**2).sum(1), 0))[:, None]]) @ planes
    asked = np.arange(0, n, 20)[:queries]
    own, norms, kth = x[asked] @ planes[:-1], (x[asked] ** 2).sum(1) + top**2, np.full(len(asked), -np.inf)
    cell = ann.cells_of(points, ann.kd_splits(points, -(-n // ann.CELL_ROWS)))
    rows = [np.flatnonzero(cell == c) for c in np.unique(cell)]
    bound = ann.box_distances(own, np.array([points[r].min(0) for r in rows]), np.array([points[r].max(0) for r in rows]))
    order, found, verified = np.argsort(bound, axis=1), [[] for _ in asked], 0
    for step in range(len(rows)):
        for c in range(len(rows)):
            some = np.flatnonzero(order[:, step] == c)
            some = some[ann.may_hold(bound[some, c], norms[some], kth[some], confidence)]
            if len(some):
                got, pairs = ann.search(x[rows[c]], points[rows[c]], x[asked[some]], own[some], kth[some], norms[some], k, confidence)
                verified += pairs
                for q, near in zip(some, got, strict=True):
                    ids = rows[c][near]
                    found[q] = sorted([*found[q], *zip(-(x[ids] @ x[asked[q]]), ids, strict=True)])[:k]
                    kth[q] = -found[q][-1][0] if len(found[q]) >= k else -np.inf
    hits = 0
    for q, i in enumerate(asked):
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & {j for _, j in found[q] if j != i})
    return hits / 20 / len(asked), verified / (n * len(asked))


def test_stopping_test_stops(spark):
    """Vectors like the given ones, of 64 dimensions of their own, and vectors near a surface of six."""
    rng = np.random.default_rng(2)
    given = table(spark, "/root/testdata/sf0.1", "embeddings").toPandas()
    x = np.vstack(given.embedding).astype(float)
    centres = np.array([x[given.label == c].mean(0) for c in sorted(set(given.label))])
    spread = np.array([x[given.label == c].std(0) for c in sorted(set(given.label))])
    which = rng.integers(0, len(centres), 50_000)
    recall, share = searched(centres[which] + spread[which] * rng.standard_normal((50_000, x.shape[1])))
    assert recall >= 0.9 and share < 0.55
    surface = np.tanh(rng.standard_normal((20_000, 6)) @ rng.standard_normal((6, 64)) / 3)
    recall, share = searched(surface)
    assert recall >= 0.9 and share < 0.1


def test_cells_beyond_the_sample_are_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 40)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 32)  # four cells for 600 rows
    x = np.random.default_rng(3).standard_normal((600, 12))
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    hits = 0
    for i in range(0, 600, 20):
        scores = x @ x[i]
        scores[i] = -np.inf
        mine = {r.rank: r for r in got if r.query_id == i}
        assert sorted(mine) == list(range(1, 21)) and all(abs(r.score - scores[r.vec_id]) < 1e-9 for r in mine.values())
        hits += len(set(np.argsort(-scores)[:20].tolist()) & {r.vec_id for r in mine.values()})
    assert hits >= 0.9 * 20 * 30


def test_chi_square_quantile():
    for share in (0.1, 0.5, 0.95):
        assert ann.chi_square_cdf(np.array([ann.chi_square_quantile(share)]))[0] == pytest.approx(share, abs=1e-9)


def test_blocks_name_all_items_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 12), replace=False)) for _ in range(4000)], np.uint64)
    asked = prints[rng.integers(0, 300, 4000)] ^ flips
    blocks = [decontam.Block(prints, sum(decontam.BITS[:b]), n, decontam.RADIUS // len(decontam.BITS)) for b, n in enumerate(decontam.BITS)]
    got = set()
    for block in blocks:
        values = block.values(asked)
        some = block.passes(values)
        for place, item in block.pairs(values[some]):
            got |= set(zip(some[place].tolist(), item.tolist(), strict=True))
    want = set(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(asked[:, None] ^ prints[None, :]) <= decontam.RADIUS)), strict=True))
    assert want <= got and len(want) > 2000 and len(got - want) < 0.02 * len(asked) * len(prints)


def test_pieces_of_pairs(monkeypatch):
    monkeypatch.setattr(decontam, "PAIRS", 5)
    block = decontam.Block(np.array([7, 7, 7, 9], np.uint64), 0, 4, 0)
    values = np.array([7, 1, 9, 7, 7], np.uint32)
    pieces = list(block.pairs(values))
    assert sorted((p, i) for place, item in pieces for p, i in zip(place.tolist(), item.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (2, 3), (3, 0), (3, 1), (3, 2), (4, 0), (4, 1), (4, 2)]
    assert max(len(p) for p, _ in pieces) <= 5


def test_many_items_of_one_length(spark):
    """20 000 items of 20 words: below a hundredth of all pairs is compared, in bounded memory, and every copy is found."""
    rnd = random.Random(5)
    texts = [r.text.split() for r in table(spark, "/root/testdata/sf0.1", "documents").select("text").collect() if r.text and len(r.text.split()) > 200]
    items, at = [], {}
    for k in range(20_000):
        i = rnd.randrange(len(texts))
        start = rnd.randrange(len(texts[i]) - 20)
        items.append((k, " ".join(texts[i][start : start + 20])))
        at[k] = i
    indexes = decontam.Items(items).indexes
    some = sorted(range(12), key=lambda i: len(texts[i]))[:6]
    found = decontam.find([" ".join(texts[i]).encode() for i in some], indexes)
    for place, i in enumerate(some):
        assert {k for k, home in at.items() if home == i} <= {k for p, k in found if p == place}
    assert sum(x.compared for x in indexes) < 0.01 * sum(x.windows * len(x.items) for x in indexes)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 2 << 20
