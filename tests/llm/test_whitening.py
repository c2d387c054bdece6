"""Whitening against the eigenvectors of another method."""

import math

import numpy as np
import pytest

from tapeline.llm import whitening
from tapeline.session import table

SCHEMA = "vec_id long, embedding array<float>, n long, component string"
RNG = np.random.default_rng(5)
MATRICES = {
    "many rows": RNG.standard_normal((40, 300)), "few rows": RNG.standard_normal((40, 9)), "copies": np.repeat(RNG.standard_normal((6, 30)), 4, axis=0), "steep": np.diag(10.0 ** -np.arange(0, 12, 0.75)),
    "one value": np.eye(9), "pairs": np.diag([3.0, 3, 1, 1, 1, 0, 0]), "nought": np.zeros((5, 5)), "single": np.ones((1, 4)), "near pairs": np.diag([1, 1 + 1e-9, 2, 2 + 1e-13, 5]),
}


@pytest.mark.parametrize("name", MATRICES)
def test_components_of_covariances(name):
    a = MATRICES[name] @ MATRICES[name].T / MATRICES[name].shape[1]
    values, vectors = whitening.components_of(a)
    top = max(np.abs(a).max(), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * top, rtol=0)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13 and np.abs(a @ vectors - vectors * values).max() < 1e-13 * top


def test_polar_factor():
    a = MATRICES["many rows"][:, :40] + MATRICES["many rows"][:, :40].T
    values, vectors = np.linalg.eigh(a)
    assert np.allclose(whitening.polar_factor(a), vectors * np.sign(values) @ vectors.T, atol=1e-10)


def brute(rows, k=16):
    """vec_id -> whitened rows and deviations, by whole numbers and another eigensolver."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    about = np.array([[c - s / n for c, s in zip(v, sums, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(about.T @ about / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    trace = (about**2).sum() / n
    return n, {i: (np.array([c - s / n for c, s in zip(v, sums, strict=True)]) @ vectors / np.sqrt(values), sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in x.items()}, values / trace


def test_whole_table_by_another_method(spark):
    table_rows = table(spark, "/root/testdata/sf0.001", "embeddings")
    n, want, explained = brute([(r.vec_id, r.embedding) for r in table_rows.collect()])
    got = whitening.whiten(table_rows).collect()
    assert len(got) == 16 * len(want) and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    signs = {}
    for r in got:
        value = want[r.vec_id][0][r.component - 1]
        sign = signs.setdefault(r.component, math.copysign(1, r.whitened * value)) if abs(value) > 0.1 else signs.get(r.component)
        assert (r.n, r.deviation) == (n, want[r.vec_id][1]) and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert sign is None or r.whitened == pytest.approx(sign * value, abs=1e-7)


def test_special_rows(spark):
    vectors = RNG.standard_normal((30, 4)).tolist()
    rows = [(i, v, 1, "x") for i, v in enumerate(vectors)]
    odd = [(50, None, 1, ""), (51, [1.0, None, 2.0, 3.0], 1, ""), (52, [float("nan"), 0.0, 0.0, 0.0], 1, ""), (53, [float("inf"), 0.0, 0.0, 0.0], 1, ""), (54, [1e30, 0.0, 0.0, 0.0], 1, ""), (55, [], 1, ""), (56, [1.0, 2.0], 1, "")]
    again = [(None, vectors[0], 1, ""), (3, vectors[3], 1, ""), (99, vectors[4], 1, "")]
    got = whitening.whiten(spark.createDataFrame(rows + odd + again, SCHEMA)).collect()
    assert len(got) == 4 * 33 and {r.n for r in got} == {len({tuple(math.floor(64 * float(np.float32(c))) for c in v) for v in vectors})}
    assert sum(r.vec_id == 3 for r in got) == 8 and sum(r.vec_id is None for r in got) == 4 and max(r.identity_error for r in got) < 1e-9
    same = {r.component: r.whitened for r in got if r.vec_id == 4}
    assert all(same[r.component] == r.whitened for r in got if r.vec_id == 99)
    for few in ([], [(1, [1.0, 2.0], 1, "")], [(1, [1.0, 2.0], 1, ""), (2, [1.0, 2.0], 1, "")], [(None, None, 1, "")]):
        assert whitening.whiten(spark.createDataFrame(few, SCHEMA)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 1, "") for i in range(9)], SCHEMA)).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1) and flat[0].identity_error < 1e-9


def test_deviations_are_exact_or_null():
    x = np.array([[1_000_000, 1_000_064], [2**55, 5]], np.int64)
    sums = np.array([3 * 999_999, 3_000_000], np.int64)
    assert whitening.deviations(x[:1], 3, sums) == [9 + (3 * 64) ** 2] and whitening.deviations(x, 3, sums) == [9 + (3 * 64) ** 2, None]
    big = np.array([[1_000_000 + 10**6]], np.int64)
    assert whitening.deviations(big, 2000, np.array([0], np.int64)) == [(2000 * 2_000_000) ** 2] if (2000 * 2_000_000) ** 2 < 2**63 else [None]
