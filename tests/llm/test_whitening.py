"""Whitening against numpy in double precision."""

import numpy as np
import pytest

from fieldmark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n int, v string, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ (np.diag(rng.uniform(0.2, 3, d)) + rng.normal(size=(d, d)) / 20)).astype(np.float32)


def brute(a, k=32):
    x = np.floor(64 * np.asarray(a, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return y @ u / np.sqrt(e), e / np.trace(v), ((n * x - s) ** 2).sum(1)


def test_against_numpy(spark):
    a = vectors(300, 40)
    bad = [(900, None), (901, []), (902, [1.0] * 39), (903, [None] + [0.1] * 39), (904, [float("nan")] + [0.1] * 39),
           (905, [float("inf")] + [0.1] * 39), (906, [0.1] * 39 + [float("-inf")]), (907, [3e38] + [0.1] * 39)]
    rows = [(i, v.tolist()) for i, v in enumerate(a)] + bad + [(5, a[5].tolist()), (None, a[6].tolist())]
    got = W.whiten(frame(spark, rows)).toPandas()
    fit = np.vstack([a, a[5], a[6]])
    white, explained, deviation = brute(fit)
    assert len(got) == len(fit) * 32 and set(got.n) == {len(fit)} and set(got.component) == set(range(1, 33))
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert (got.groupby(got.vec_id.fillna(-1)).size().loc[[-1, 5, 6]] == [32, 64, 32]).all()
    one = got[got.vec_id.notna()].drop_duplicates(["vec_id", "component"])
    wide = one.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((wide * white[:300]).sum(0))
    assert np.abs(wide * signs - white[:300]).max() < 1e-8
    assert np.allclose(one.sort_values(["vec_id", "component"]).explained[:32], explained, rtol=1e-12)
    assert one[one.component == 1].sort_values("vec_id").deviation.tolist() == deviation[:300].tolist()


def random_basis(d, seed=3):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]


SPECTRA = {
    "spread": np.linspace(50, 150, 48),
    "equal": np.full(48, 7.0),
    "clusters": np.r_[np.full(20, 70.0), np.full(10, 70 * (1 + 1e-12)), np.full(6, 3.0), np.linspace(1, 2, 12)],
    "near": 70 + 1e-6 * np.arange(48),
    "one large": np.r_[1e8, np.linspace(1, 2, 47)],
    "rank": np.r_[np.zeros(30), np.linspace(1, 9, 18)],
    "tiny": 1e-30 * np.linspace(1, 9, 48),
    "huge": 1e60 * np.linspace(1, 9, 48),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenvectors(name):
    q, w = random_basis(48), SPECTRA[name]
    v = (q * w) @ q.T
    v = (v + v.T) / 2
    values, x = W.eigenvectors(v)
    size = np.abs(w).max()
    assert np.abs(values - np.sort(w)[::-1]).max() < 1e-13 * size
    assert np.abs(v @ x - x * values).max() < 1e-14 * size
    assert np.abs(x.T @ x - np.eye(48)).max() < 1e-14


def test_float32_start_is_corrected():
    """The start is only good to single precision; the refinement is what reaches double."""
    q = random_basis(48)
    v = (q * SPECTRA["spread"]) @ q.T
    v = (v + v.T) / 2
    start = np.linalg.eigh(v.astype(np.float32))[1].astype(np.float64)
    assert np.abs(start.T @ start - np.eye(48)).max() > 1e-8
    _, x = W.eigenvectors(v)
    assert np.abs(np.abs(x) - np.abs(np.linalg.eigh(v)[1][:, ::-1])).max() < 1e-12


def test_degenerate_tables(spark):
    got = W.whiten(frame(spark, [])).collect()
    assert got == [] and W.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    one = W.whiten(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [
        (1, 1, 0, None, None), (2, 1, 0, None, None)]
    same = W.whiten(frame(spark, [(1, [0.5]), (2, [0.5])])).collect()
    assert all(r.whitened is None and r.deviation == 0 for r in same) and len(same) == 2
    # two vectors: one component has variance
    two = sorted(W.whiten(frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])])).collect(), key=lambda r: (r.component, r.vec_id))
    assert [abs(r.whitened) for r in two[:2]] == pytest.approx([1, 1]) and two[0].explained == pytest.approx(1)
    assert two[2].whitened is None and two[0].identity_error < 1e-12
    # the commonest length counts, of equals the longest
    mixed = W.whiten(frame(spark, [(1, [0.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.5])])).collect()
    assert {r.vec_id for r in mixed} == {3, 4}


def test_exact_beyond_64_bits(spark):
    big = 2.0 ** 40
    rows = W.whiten(spark.createDataFrame([(1, [big, 1.0]), (2, [-big, 2.0]), (3, [0.0, 4.0])], "vec_id long, embedding array<double>"))
    got = {(r.vec_id, r.component): r for r in rows.collect()}
    assert got[1, 1].deviation is None and got[3, 1].deviation == (3 * 256 - 64 * 7) ** 2
    assert abs(got[1, 1].whitened) == pytest.approx(np.sqrt(1.5), rel=1e-12) and got[1, 1].identity_error < 1e-4
