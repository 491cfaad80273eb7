"""Column normalization against plain Python, blocks of queries, evaluation and blobs."""

import unicodedata

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def test_normalize_column_every_code_point(spark):
    from textvec.functions.normalize import normalize, normalize_column

    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    rows = [(at, "".join(f"a{chr(c)}b|" for c in points[at : at + 500])) for at in range(0, len(points), 500)]
    df = spark.createDataFrame(rows, "at long, text string").repartition(4)
    bad = []
    for r in df.select("at", "text", normalize_column(df.text).alias("n")).collect():
        if r.n != normalize(r.text):
            bad += [hex(c) for c, x, y in zip(points[r["at"] : r["at"] + 500], r.n.split("b|"), normalize(r.text).split("b|")) if x != y]
    assert len(bad) < 40, bad  # what only the newer Unicode version knows as control or format characters
    for text in ("Привет, МИР Ёлка й", "Ἀθῆναι ΣΟΦΟΣ", "한국어 텍스트", "İstanbul ÇAĞ", "Ｆｕｌｌ Ŵidth", "ड़ ক্ষ ொ"):
        assert spark.createDataFrame([(text,)], "t string").select(normalize_column("t")).first()[0] == normalize(text), text


def test_query_metrics_without_judgements(spark):
    from textvec.operators import evaluate

    ranking = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 10)], "query_id long, rank int, row_id long")
    qrels = spark.createDataFrame([(1, 11), (3, 10)], "query_id long, doc_id long")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    found = {r.query_id: (r.rr, r.rr_at_k, round(r.ndcg_at_k, 6), r.recall_at_k, r.hit_at_k) for r in evaluate.query_metrics(ranking, qrels, 1, asked).collect()}
    assert found == {1: (0.5, 0.0, 0.0, 0.0, 0.0), 2: (0.0,) * 5, 3: (0.0,) * 5}
    means = {r.metric: r.value for r in evaluate.mean_metrics(evaluate.query_metrics(ranking, qrels, 2, asked)).collect()}
    assert means["rr"] == pytest.approx(0.5 / 3) and means["recall_at_k"] == pytest.approx(1 / 3)


def test_embed_blob(spark):
    from textvec.functions.codec import unpack
    from textvec.model import demo
    from textvec.operators.embed import Kernel

    kernel = Kernel(spark, demo())
    df = spark.createDataFrame([(1, "the quick fox"), (2, None), (3, "")], "i long, t string")
    for fmt in ("f32", "f16"):
        for r in df.select("i", kernel.embed("t").alias("v"), kernel.embed_blob("t", fmt).alias("b")).collect():
            assert (r.v is None) == (r.b is None) and (r.v is None or np.allclose(unpack(bytes(r.b), len(r.v), fmt)[0], r.v, atol=1e-3))


def test_search_blocks(spark, monkeypatch):
    from textvec.operators import search

    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(90)], "row_id long, vec array<double>")
    asked = rows.withColumnRenamed("row_id", "query_id")
    whole = sorted(map(tuple, search.top_k_batched(rows, asked, 3).collect()))
    monkeypatch.setattr(search, "BLOCK", 20)
    found = search.top_k_batched(rows, asked, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == whole and len(whole) == 270 and plan.count("BroadcastExchange") >= 5 and "SortMergeJoin" not in plan


def test_bootstrap_asks_all(spark):
    from textvec.plans import catalogue

    ranking, qrels = catalogue._relevance(spark, SF)
    assert qrels.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    few = catalogue.evaluate.query_metrics(ranking, qrels.where("query_id < 20"), 3)
    wide, narrow = ({r.metric: r.ci_hi - r.ci_lo for r in f.collect()} for f in (catalogue.bootstrap_ci(spark, SF), catalogue.evaluate.bootstrap(few, 200)))
    assert set(wide) == set(narrow) and wide["rr"] < narrow["rr"]
