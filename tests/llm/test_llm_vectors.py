"""Near-duplicate vectors against all pairs: recall, no false link, hubs, blocks, odd vectors."""

import numpy as np
import pytest

from brickyard.llm import vectors


def _brute(ids, x):
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    link = x @ x.T / norm[:, None] / norm >= 0.9
    np.fill_diagonal(link, False)
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == label).all():
            return link.sum(axis=1), label
        label = low


def _rows(spark, ids, x, kind="float"):
    frame = spark.createDataFrame([(int(i), [float(v) for v in e]) for i, e in zip(ids, x)],
                                  f"vec_id bigint, embedding array<{kind}>").selectExpr(
        "*", "'l' AS label", "1 AS rep", "2 AS k1", "3 AS m", "4 AS list")
    got = {r.vec_id: r for r in vectors.near_vectors(frame).collect()}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    return (np.array([got[i].n_links for i in ids.tolist()]),
            np.array([got[i].component_id for i in ids.tolist()]))


def _clusters(seed, n, d, spread):
    """A third in one tight group, a third of loose partners near the threshold, a third alone."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, d))
    loose = base + spread * rng.normal(size=base.shape)
    tight = base[:1] + 0.05 * rng.normal(size=(n - 2 * len(base), d))
    x = np.concatenate([base, loose, tight]).astype(np.float32)
    x[-20:] = x[-1]  # equal vectors
    return rng.permutation(10 * n)[:n].astype(np.int64), x


@pytest.mark.parametrize("n, d, spread, blocks", [(1200, 64, 0.45, False), (900, 24, 0.4, True), (40, 5, 0.3, False)])
def test_recall_and_no_false_link(spark, monkeypatch, n, d, spread, blocks):
    if blocks:  # several blocks and parts of every list, no hubs
        for name, value in (("BLOCK", 20), ("ASKING", 30), ("PAIRS", 500), ("HUB_LEAST", 10**9)):
            monkeypatch.setattr(vectors, name, value)
    ids, x = _clusters(n, n, d, spread)
    want, label = _brute(ids, x)
    got, component = _rows(spark, ids, x)
    assert (got <= want).all() and got.sum() >= 0.97 * want.sum()
    loose = slice(0, 2 * (n // 3))
    if n > 100:  # pairs near the threshold, without the tight group
        far = want[loose] < n // 4
        assert got[loose][far].sum() >= 0.9 * want[loose][far].sum()
        assert want[loose][far].sum() > n // 10
    if (got == want).all():
        assert (component == label).all()


def test_a_group_at_a_hub_is_counted_not_compared(spark, monkeypatch):
    rng, made = np.random.default_rng(0), []
    centre = rng.normal(size=32)
    x = centre + 0.02 * rng.normal(size=(600, 32))
    monkeypatch.setattr(vectors._Cell, "ask", lambda self, rows: made.append(rows) or iter(()))
    got, component = _rows(spark, np.arange(600) + 5, x)
    assert (got == 599).all() and (component == 5).all()


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (10, [1e300, 2e300]), (11, [-1.0, -2.0]),
            (11, [3.0, -1.0]), (12, [3.0, -1.0]), (2, [2.0, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, vectors.near_vectors(frame).collect()), key=str)
    linked = {1: (3, 1), 2: (3, 1), 10: (3, 1)}
    want = [(i, *linked.get(i, (0, i)), linked.get(i, (0, i))[1] == i) for i in (1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10)]
    want += [(None, 0, None, True), (11, 0, 11, True), (11, 1, 11, True), (12, 1, 11, False)]
    assert got == sorted(want, key=str)
    none = frame.filter("vec_id < 0")
    assert vectors.near_vectors(none).count() == 0
    assert [tuple(r) for r in vectors.near_vectors(frame.filter("vec_id = 3")).collect()] == [(3, 0, 3, True)]


def test_given_vectors_reach_the_recall(spark):
    from conftest import SF
    frame = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = frame["vec_id"].to_numpy(np.int64), np.stack(frame["embedding"].to_numpy())
    x = np.concatenate([x, x + 0.02 * np.random.default_rng(1).normal(size=x.shape).astype(np.float32)])
    ids = np.concatenate([ids, ids + 10_000])
    want, _ = _brute(ids, x)
    got, _ = _rows(spark, ids, x)
    assert (got <= want).all() and got.sum() >= 0.98 * want.sum() > 0
