import itertools
import json
import math
import random

import numpy as np
import pytest

from textvec.errors import InvalidSource
from textvec.model import demo
from textvec.operators import evaluate
from textvec.operators.embed import Kernel
from textvec.operators.ranges import coalesce_ranges


def plain(order, relevant, k):
    first = next((i + 1 for i, x in enumerate(order) if x in relevant), None)
    dcg = sum(1 / math.log2(i + 2) for i, x in enumerate(order[:k]) if x in relevant)
    ideal = sum(1 / math.log2(i + 2) for i in range(min(len(relevant), len(order[:k]))))
    near = first is not None and first <= k
    return (1 / first if first else 0.0, 1 / first if near else 0.0, dcg / ideal if ideal else 0.0, len(relevant & set(order[:k])) / len(relevant) if relevant else 0.0, float(near))


def rows(df):
    return {r.query_id: tuple(r[m] for m in evaluate.METRICS) for r in df.collect()}


def test_metrics_by_brute_force(spark):
    rng = random.Random(3)
    orders = {q: rng.sample(range(9), rng.randint(1, 9)) for q in range(12)}
    relevant = {q: set(rng.sample(range(9), rng.randint(0, 4))) for q in range(13)}  # 12 has no ranking
    ranking = spark.createDataFrame([(q, x, i + 1) for q, o in orders.items() for i, x in enumerate(o)], "query_id int, row_id int, rank int")
    qrels = spark.createDataFrame([(q, x) for q, r in relevant.items() for x in r], "query_id int, doc_id int")
    queries = spark.createDataFrame([(q,) for q in relevant], "query_id int")
    for k in (1, 3, 20):
        got = rows(evaluate.query_metrics(ranking, qrels, k, queries))
        assert got.keys() == relevant.keys()
        for q, r in relevant.items():
            assert got[q] == pytest.approx(plain(orders.get(q, []), r, k))


@pytest.mark.parametrize("n,k", [(1, 3), (5, 2), (6, 9)])
def test_random_baseline_over_all_orders(spark, n, k):
    counts = range(1, n + 1)
    qrels = spark.createDataFrame([(r, x) for r in counts for x in range(r)], "query_id int, doc_id int")
    got = rows(evaluate.random_baseline(qrels, n, k))
    for r in counts:
        every = [plain(list(o), set(range(r)), k) for o in itertools.permutations(range(n))]
        assert got[r] == pytest.approx(tuple(np.mean(every, 0)))


def test_random_baseline_of_many_documents(spark):
    qrels = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "query_id int, doc_id int")
    got = rows(evaluate.random_baseline(qrels, 5000, 10))
    harmonic = sum(1 / i for i in range(1, 5001))
    assert got[0][0] == pytest.approx(harmonic / 5000, abs=1e-12) and got[1][0] == pytest.approx(2 * (harmonic - 1) / 4999, abs=1e-12)


def test_bootstrap_against_resampling(spark):
    rng = np.random.default_rng(5)
    values = rng.random(400)
    per = spark.createDataFrame([(i, *[float(v)] * 5) for i, v in enumerate(values)], ["query_id", *evaluate.METRICS])
    lo, hi = np.quantile([rng.choice(values, 400).mean() for _ in range(2000)], (0.025, 0.975))
    for row in evaluate.bootstrap(per, 1000).collect():
        assert row.ci_lo == pytest.approx(lo, abs=0.006) and row.ci_hi == pytest.approx(hi, abs=0.006)


def test_dataset(spark, tmp_path):
    data = {"documents": [{"id": 1, "text": "hello world"}, {"id": "b", "text": "vector search"}], "queries": [{"id": "q", "text": "search", "relevant": ["b"]}, {"text": "", "relevant": [1]}]}
    path = tmp_path / "set.json"
    path.write_text(json.dumps(data))
    documents, queries, qrels = evaluate.read_dataset(spark, str(path))
    assert {(r.query_id, r.doc_id) for r in qrels.collect()} == {("q", "b"), ("", "1")}
    got = rows(evaluate.evaluate_dataset(Kernel(spark, demo()), documents, queries, qrels, 1))
    assert got == {"q": (1, 1, 1, 1, 1), "": (0, 0, 0, 0, 0)}
    for broken in ({**data, "documents": []}, {**data, "queries": []}, {**data, "queries": [{"text": "x", "relevant": ["none"]}]}):
        path.write_text(json.dumps(broken))
        with pytest.raises(InvalidSource):
            evaluate.read_dataset(spark, str(path))


@pytest.mark.parametrize("block,steps", [(4, 2), (4, 0), (8, 1), (4096, 2)])
def test_ranges_by_brute_force(spark, block, steps):
    rng = random.Random(block)
    numbers = {x for _ in range(12) for a in [rng.randint(-200, 200)] for x in range(a, a + rng.randint(1, 60))}
    numbers -= set(rng.sample(sorted(numbers), 9))
    want = {(a, b) for a in numbers if a - 1 not in numbers for b in [next(x for x in itertools.count(a) if x + 1 not in numbers)]}
    df = spark.createDataFrame([(x,) for x in [*numbers, *list(numbers)[:20], None]], "n long")
    got = [(r.lo, r.hi) for r in coalesce_ranges(df, "n", block, steps).collect()]
    assert len(got) == len(want) and set(got) == want
