"""Batched searches as products of matrices: the same rows as pair by pair, without joining pairs."""

import numpy as np
import pytest

from textvec.operators import block_scan, search

INF, NAN = float("inf"), float("nan")


def _joined(plan) -> int:
    """Rows that the joins of a plan that has run put out."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _joined(plan.finalPhysicalPlan())
    if name.endswith("QueryStage"):
        return _joined(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return own + sum(_joined(plan.children().apply(i)) for i in range(plan.children().size()))


def test_pairs_are_not_joined(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 6)).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, vec array<float>")
    asked = rows.where("row_id % 4 = 0").withColumnRenamed("row_id", "query_id")
    found = search.top_k_batched(rows, asked, 7)
    got = found.collect()
    assert _joined(found._jdf.queryExecution().executedPlan()) <= 40  # not 400 x 100
    square, dots = np.zeros(400), np.zeros((100, 400))
    for x in v.T:
        square, dots = square + x * x, dots + np.outer(x[::4], x)
    score = dots / np.sqrt(np.outer(square[::4], square))  # to the last bit: this decides ties
    order = np.lexsort((np.broadcast_to(np.arange(400), score.shape), -score))[:, :7]
    want = {(4 * q, rank + 1, int(r), float(score[q, r])) for q in range(100) for rank, r in enumerate(order[q])}
    assert set(map(tuple, got)) == want and len(got) == 700


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_odd_rows(spark, monkeypatch, metric):
    vectors = [[1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [0.0, 0.0], [-1.0, 0.5], [NAN, 1.0], [None, 1.0], None, [], [3.0], [INF, 1.0], [-INF, 1.0], [1e-170, 0.0], [1e160, -1e160], [1e-320, 1e-320], [0.1, 0.2], [3.0, 6.0]]
    data = [(i * 7 % 5 if i else None, x) for i, x in enumerate(vectors * 2)]
    rows = spark.createDataFrame(data, "row_id int, vec array<double>")
    asked = spark.createDataFrame([(f"q{i // 2}" if i else None, x) for i, x in enumerate(vectors)], "query_id string, vec array<double>")
    for k in (1, 4, 100):
        monkeypatch.setattr(block_scan, "MOST", 1000)
        got = search.top_k_batched(rows, asked, k, metric)
        monkeypatch.setattr(block_scan, "MOST", 0)
        want = search.top_k_batched(rows, asked, k, metric)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert "MapInArrow" in got._jdf.queryExecution().toString() and "MapInArrow" not in want._jdf.queryExecution().toString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("metric", ["dot", "cosine"])
@pytest.mark.parametrize("k", [1, 5, 300])
def test_best_against_all_pairs(metric, k):
    """Copies, ties and near ties over many matrices; bounds leave no row out."""
    rng = np.random.default_rng(k)
    base = rng.normal(size=(30, 8))
    rows = np.concatenate([base, base, base * 3, base + rng.normal(size=base.shape) * 1e-15, rng.normal(size=(200, 8)), np.zeros((5, 8)), base * 1e120])
    ids, asked = rng.permutation(len(rows)), np.concatenate([base[:9], base[:2] * 1e-110, rng.normal(size=(4, 8))])
    best, whole = block_scan.Best(asked, k, metric), block_scan.Side(rows, metric)
    for i in range(0, len(rows), 37):
        best.meet(ids[i : i + 37], np.ones(len(ids[i : i + 37]), bool), block_scan.Side(rows[i : i + 37], metric))
    for q, x in enumerate(asked):
        score = np.zeros(len(rows))
        for a, b in zip(x, rows.T):
            score += a * b
        if metric == "cosine":
            with np.errstate(all="ignore"):
                both = best.side.square[q] * whole.square
                score = np.where(whole.square > 0, score / np.sqrt(both), 0.0)
        order = np.lexsort((ids, -score))[:k]
        mine = best.query == q
        assert best.row[mine].tolist() == ids[order].tolist() and best.score[mine].tolist() == score[order].tolist()
