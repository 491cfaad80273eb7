"""Records of parity, input checks, metrics, made-up inputs and statistics against plain counterparts."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textvec.errors import EmptyInput, EncodingError, InvalidOption, InvalidSource
from textvec.functions import hashing
from textvec.functions.encoding import text_column
from textvec.model import demo
from textvec.operators import parity, quality, search
from textvec.operators.embed import Kernel, Tokenizer, bytes_ids, capped, pool
from textvec.operators.ranges import unsorted_neighbours
from textvec.sources import container, workload

TEXTS = ["", "hello world", "Привет, мир!", "unknown ξψω words", "[MASK] search", "a" * 300, "hello " * 900, "文字 und naïve\ttext"]


def _library(model):
    """The same tokenizer, built by an independent library."""
    tok = pytest.importorskip("tokenizers")
    t = tok.Tokenizer(tok.models.WordPiece({x: i for i, x in enumerate(model.tokens)}, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer, t.pre_tokenizer = tok.normalizers.BertNormalizer(lowercase=True), tok.pre_tokenizers.BertPreTokenizer()
    t.add_special_tokens(list(model.meta.added_tokens))
    return t


@pytest.mark.parametrize("truncation", ["raw_ids", "usable_ids"])
def test_parity_with_the_tokenizers_library(spark, tmp_path, truncation):
    model = demo().with_meta(truncation=truncation)
    library, rows = _library(model), []
    for n, text in enumerate(TEXTS):
        raw = library.encode(text, add_special_tokens=False).ids
        kept = [i for i in raw[:512] if i != 1] if truncation == "raw_ids" else [i for i in raw if i != 1][:512]
        total = model.matrix[kept].astype(np.float64).sum(0)
        vector = (total / max(1e-30, np.linalg.norm(total))).tolist()
        rows.append({"label": str(n), "text": text, "hf_raw_token_ids": raw, "static_pooled_token_ids": kept, "model2vec_token_ids": kept, "model2vec_vector": vector})
    path = str(tmp_path / "records.json")
    payload = {"schema_version": 3, "reference": {"max_length": 512, "truncation": truncation, "unk_token_id": 1}, "rows": rows}
    json.dump(payload, open(path, "w"))
    kernel = Kernel(spark, model)
    compared = parity.compare(kernel, *parity.read_records(spark, path))
    assert compared.where("ok").count() == len(TEXTS), compared.where("not ok").collect()
    rows[1]["hf_raw_token_ids"] = [143, 5]
    rows[2]["model2vec_vector"] = [1.0] * 8
    rows[3]["static_pooled_token_ids"] = rows[3]["model2vec_token_ids"] = [7]
    json.dump(payload, open(path, "w"))
    compared = parity.compare(kernel, *parity.read_records(spark, path))
    found = {r.label: r for r in compared.where("not ok").collect()}
    assert set(found) == {"1", "2", "3"} and found["1"].raw_at == 1 and found["3"].pooled_at == 0
    s = parity.summary(compared).first()
    assert (s.rows, s.raw_failures, s.pooled_failures, s.invariant_failures, s.failures) == (8, 1, 1, 0, 3)
    payload["reference"]["max_length"] = 5
    json.dump(payload, open(path, "w"))
    with pytest.raises(InvalidSource):
        parity.compare(kernel, *parity.read_records(spark, path))
    payload["schema_version"] = 9
    json.dump(payload, open(path, "w"))
    with pytest.raises(InvalidSource):
        parity.read_records(spark, path)


def test_records_round_trip(spark, tmp_path):
    kernel, path = Kernel(spark, demo()), str(tmp_path / "r.json")
    cases = spark.createDataFrame(list(map(str, range(len(TEXTS)))), "string").withColumnRenamed("value", "label").withColumn("text", F.element_at(F.array(*map(F.lit, TEXTS)), F.col("label").cast("int") + 1))
    parity.write_records(kernel, cases, path)
    s = parity.summary(parity.compare(kernel, *parity.read_records(spark, path))).first()
    assert (s.rows, s.failures, s.vectors) == (len(TEXTS), 0, len(TEXTS)) and s.min_cosine > 1 - 1e-9


@pytest.mark.parametrize("usable", [False, True])
def test_bytes(spark, usable):
    model = demo().with_meta(max_tokens=20, truncation="usable_ids" if usable else "raw_ids")
    own = Tokenizer(model)
    long = "ξ hello wörld, text " * 2000
    want = capped(own.ids(long), 20, 1, usable)
    assert capped(bytes_ids(own, long.encode(), 20, usable), 20, 1, usable) == want
    spoilt = long.encode() + b"\xff"
    assert capped(bytes_ids(own, spoilt, 20, usable), 20, 1, usable) == want  # the end is not read
    with pytest.raises(EncodingError):
        bytes_ids(own, spoilt, 0, usable)
    with pytest.raises(EncodingError):
        bytes_ids(own, b"short \xff", 20, usable)
    kernel = Kernel(spark, model)
    rows = spark.createDataFrame([(bytearray(spoilt),), (None,), (bytearray(b""),)], "b binary")
    got = [r.s for r in rows.select(kernel.embed_bytes("b", validate="prefix").alias("s")).collect()]
    assert got[0].token_count == len(want[0]) and got[0].truncated and (got[1] is None or got[1].vec is None) and got[2].vec == [0.0] * 8
    with pytest.raises(Exception, match="no UTF-8"):
        rows.select(kernel.embed_bytes("b").alias("s")).collect()
    with pytest.raises(InvalidOption):
        kernel.embed_bytes("b", validate="some")


def test_text_column(spark):
    rows = spark.createDataFrame([(bytearray("aé".encode()),), (None,)], "b binary")
    assert [r[0] for r in rows.select(text_column("b")).collect()] == ["aé", None]
    assert spark.createDataFrame([(bytearray(b"ab"),)], "b binary").select(text_column("b", "US-ASCII")).first()[0] == "ab"
    for bad, label in ((b"\xc3\x28", "UTF-8"), ("é".encode(), "ascii")):
        with pytest.raises(Exception, match="UTF|ASCII"):
            spark.createDataFrame([(bytearray(bad),)], "b binary").select(text_column("b", label)).collect()
    with pytest.raises(EncodingError):
        text_column("b", "latin-1")


def test_metrics_and_norms(spark):
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(60, 5)), rng.normal(size=5)
    v[7] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, vec array<double>")
    for metric, score in (("euclidean", -np.sqrt(((v - q) ** 2).sum(1))), ("manhattan", -np.abs(v - q).sum(1))):
        found = search.top_k(rows, q.tolist(), 60, metric).orderBy("rank").collect()
        assert [r.row_id for r in found] == np.argsort(-score, kind="stable").tolist() and np.allclose([r.score for r in found], np.sort(score)[::-1])
    plain = search.top_k(rows, q.tolist(), 60).orderBy("rank").collect()
    stored = search.top_k(search.with_norms(rows), q.tolist(), 60, norm_col="norm").orderBy("rank").collect()
    assert [r.row_id for r in plain] == [r.row_id for r in stored] and np.allclose([r.score for r in plain], [r.score for r in stored])
    asked = spark.createDataFrame([(1, q.tolist())], "query_id long, vec array<double>")
    batch = search.top_k_batched(search.with_norms(rows), asked, 60, norm_col="norm").orderBy("rank").collect()
    assert [r.row_id for r in batch] == [r.row_id for r in plain]
    with pytest.raises(InvalidOption):
        search.top_k(rows, q.tolist(), 1, "hamming")


def test_order_and_hashes(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "a"), (4, None), (5, "z")], "i int, v string")
    assert sorted(r.position for r in unsorted_neighbours(rows, "i", "v").collect()) == [1, 2, 3, 4]
    words = ["", "a", "hello", "мир", "x" * 500]
    got = spark.createDataFrame(words, "string").select("value", hashing.fnv1a_column("value").alias("h")).collect()
    assert {r.value: r.h for r in got} == {w: hashing.fnv1a(w.encode()) for w in words} and hashing.fnv1a(b"a") == 0xE40C292C
    assert [hashing.next_power_of_two(n) for n in (1, 2, 3, 4, 5)] == [1, 2, 4, 4, 8]
    assert all(hashing.table_size(n) >= math.ceil(n / 0.7) + 1 for n in range(1, 500)) and hashing.table_size(0) == 1


@pytest.mark.parametrize("mode", workload.MODES)
def test_workload(spark, mode):
    rows = workload.texts(spark, mode, 20, 3000).collect()
    assert len({r.text for r in rows}) == 20 and all(2700 <= len(r.text.encode()) <= 3100 for r in rows)
    assert rows == workload.texts(spark, mode, 20, 3000).collect()


def test_id_sets(spark):
    rows = workload.id_sets(spark, 176, 50, 10).collect()
    assert len(rows) == 10 and all(len(r.ids) == 50 and 0 <= min(r.ids) and max(r.ids) < 176 for r in rows)
    assert rows != workload.id_sets(spark, 176, 50, 10, 2).collect()


def test_quality(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([1.0, 0.3],), ([0.1, -0.7],)], "vec array<double>")
    got = quality.half_float_quality(rows).first()
    x = np.array([[1.0, 0.3], [0.1, -0.7]])
    y = x.astype(np.float16).astype(float)
    assert got.rows == 3 and np.isclose(got.max_abs, np.abs(x - y).max()) and np.isclose(got.max_norm_delta, np.abs(np.linalg.norm(x, axis=1) - np.linalg.norm(y, axis=1)).max())
    docs = spark.createDataFrame([("en", "hello world"), ("el", "ξψω αβγ"), ("no", None), ("zz", "")], "lang string, text string")
    found = {r.lang: (r.unk_ratio, r.unsafe) for r in quality.language_safety(Kernel(spark, demo()), docs, ["lang"]).collect()}
    assert found == {"en": (0.0, False), "el": (1.0, True), "zz": (None, False)}
    model = demo().with_meta(max_tokens=3)
    assert quality.bytes_that_count(model, "hello world") is None
    assert quality.bytes_that_count(model, "hello world text search") == len("hello world text")
    stats = quality.timing_stats([3, 1, 2, 2], rows=10)
    assert stats == {"median": 2.0, "best": 1, "worst": 3, "spread_pct": 100.0, "rows_per_s": 5.0}


def test_raise_on_empty():
    model = demo().with_meta(empty_policy="raise")
    with pytest.raises(EmptyInput):
        pool(model, [1])
    with pytest.raises(InvalidOption):
        pool(demo(), [176])


@pytest.mark.parametrize("kind", ["F16", "BF16"])
def test_half_tensors(tmp_path, kind):
    x = np.array([[1.0, -2.5], [0.25, 96.0]], np.float32)
    raw = x.astype("<f2").tobytes() if kind == "F16" else (x.view("<u4") >> 16).astype("<u2").tobytes()
    head = json.dumps({"m": {"dtype": kind, "shape": [2, 2], "data_offsets": [0, 8]}}).encode()
    path = tmp_path / "x.safetensors"
    path.write_bytes(len(head).to_bytes(8, "little") + head + raw)
    assert (container.read_tensor(str(path), "m") == x).all()


def test_static_modules(tmp_path):
    from tests.test_engine import _source

    model, inner = demo(), tmp_path / "0_StaticEmbedding"
    inner.mkdir()
    _source(inner, model)
    (inner / "config.json").unlink()
    container.write_tensors(str(inner / "model.safetensors"), {"embedding.weight": model.matrix})
    modules = [{"idx": 0, "path": "0_StaticEmbedding", "type": "sentence_transformers.models.StaticEmbedding"}]
    (tmp_path / "modules.json").write_text(json.dumps(modules))
    found = container.convert(str(tmp_path), dimensions=4, revision="abc", trained_dims=[4, 8])
    assert found.meta.truncation == "usable_ids" and found.meta.unk_policy == "include" and not found.normalized and found.max_tokens is False
    p = found.provenance
    assert list(p) == sorted(p) and p["source_revision"] == "abc" and p["trained_dims"] == [8, 4] and (p["native_dim"], p["output_dim"]) == (8, 4) and len(p["source_files_sha256"]) == 3
    with pytest.raises(InvalidOption):
        container.convert(str(tmp_path), trained_dims=[9])
    a, b = str(tmp_path / "a.tvec"), str(tmp_path / "b.tvec")
    container.save(found, a), container.save(found, b)
    assert open(a, "rb").read() == open(b, "rb").read()
    again = container.load(a)
    assert again.path == a and again.mapped_bytes == again.matrix.nbytes and (again.matrix == found.matrix).all()
    with open(a, "ab") as f:
        f.write(b"tail")
    with pytest.raises(container.InvalidModel):
        container.load(a)
    modules[0]["path"] = "../elsewhere"
    (tmp_path / "modules.json").write_text(json.dumps(modules))
    with pytest.raises(InvalidSource):
        container.convert(str(tmp_path))
