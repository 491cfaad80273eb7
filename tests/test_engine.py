"""The engine against known values, an independent tokenizer, and its own second path."""

import json
import os

import numpy as np
import pytest

from textvec.errors import InvalidModel, InvalidOption, InvalidSource, ModelNotFound
from textvec.functions import codec
from textvec.functions.normalize import normalize, words
from textvec.model import demo
from textvec.operators import search
from textvec.operators.embed import Kernel, Tokenizer, capped, pool
from textvec.sources import container

SF = "/root/testdata/sf0.001"
CASES = [
    ("", [], [0] * 8), ("hello", [143], [-0.2577, -0.5139, -0.2022, 0.3791, 0.1712, 0.5535, -0.0475, 0.3833]), ("hello, world!", [143, 132, 144, 133], [0.2606, -0.4944, -0.0350, 0.1857, 0.4741, -0.1878, 0.3602, 0.5120]),
    ("caf\u00e9", [160], None), ("cafe\u0301", [160], None), ("привет мир", [162, 163], None), ("中文测试", [1, 1, 1, 1], [0] * 8), ("zero\u200bwidth", [30, 172, 87, 95, 81, 76, 92, 80], None), ("a" * 300, [1], [0] * 8),
    ("hello[MASK]world", [143, 4, 144], None), ("[mask]", [1, 17, 73, 91, 83, 1], None), ("hello\U0002b920world", [143, 1, 144], None), ("ß", [1], None), ("hello\x7fworld", [143, 95, 87, 90, 84, 76], None), ("hello\x85world", [143, 95, 87, 90, 84, 76], None), ("hello\u2028world", [143, 144], None), ("İ", [13], None), ("한", [1], None),
]


@pytest.mark.parametrize("text,ids,vector", CASES)
def test_golden_rows(text, ids, vector):
    model = demo()
    found = Tokenizer(model).ids(text)
    assert found == ids
    if vector is not None:
        assert np.allclose(pool(model, found)[0], vector, atol=6e-5)


def test_words_match_the_tokenizers_library(spark):
    tok = pytest.importorskip("tokenizers")
    norm, pre = tok.normalizers.BertNormalizer(lowercase=True), tok.pre_tokenizers.BertPreTokenizer()
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [chr(c).join(("a", "b")) for c in (*range(1, 0x250), 0x2028, 0x3000, 0x4E00, 0x9FFF, 0xFB01, 0x1F600, 0x20000) if c not in (0xAD,)]
    for text in texts:
        assert words(normalize(text)) == [w for w, _ in pre.pre_tokenize_str(norm.normalize_str(text))], repr(text)[:80]


def test_caps():
    k, u = 143, 1
    ids = [k, u, k, u, k, u, k, u, k]
    assert capped(ids, 4, 1, True) == (ids[:7], True)
    assert capped(ids, 4, 1, False) == (ids[:4], True)
    assert capped(ids, 5, 1, True) == (ids, False)
    assert capped([k, u, u], 1, 1, True) == ([k, u, u], False)
    assert capped([k] * 4, 4, 1, False) == ([k] * 4, False)


def test_half_floats():
    table = {0.0: 0, 1: 0x3C00, -2: 0xC000, 65504: 0x7BFF, 65520: 0x7C00, -1e30: 0xFC00, 2.0**-24: 1, 2.0**-14: 0x400, 2.0**-14 - 2.0**-24: 0x3FF, 1e-30: 0, 1 + 2.0**-11: 0x3C01, float("inf"): 0x7C00}
    assert codec.encode_f16(list(table)).tolist() == list(table.values())
    assert codec.encode_f16([-0.0])[0] == 0x8000
    every = np.arange(65536).astype("<u2")
    fine = every[~np.isnan(codec.decode_f16(every))]
    assert (codec.encode_f16(codec.decode_f16(fine)) == fine).all()
    assert np.isnan(codec.decode_f16(codec.encode_f16([float("nan")])))[0]
    with pytest.raises(InvalidOption):
        codec.unpack(b"123", 1)


def test_search_contract(spark):
    rows = spark.createDataFrame([(0, [2.0]), (1, [float("nan")]), (2, [5.0]), (3, [1.0])], "row_id long, vec array<double>")
    assert [r.row_id for r in search.top_k(rows, [1.0], 3, "dot").collect()] == [2, 0, 3]
    pair = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "row_id long, vec array<double>")
    assert [(r.row_id, r.score) for r in search.top_k(pair, [1.0, 0.0], 2).orderBy("rank").collect()] == [(1, 1.0), (0, 0.0)]
    ties = spark.createDataFrame([(2, [2.0, 2.0]), (0, [1.0, 1.0]), (1, [3.0, 3.0])], "row_id long, vec array<double>")
    assert [r.row_id for r in search.top_k(ties, [1.0, 1.0], 3).orderBy("rank").collect()] == [0, 1, 2]
    with pytest.raises(InvalidOption):
        search.top_k(pair, [0.0, 0.0], 1)
    with pytest.raises(InvalidOption):
        search.top_k(pair, [1.0, 0.0], 0)
    assert search.top_k(pair.limit(0), [0.0, 0.0], 1).collect() == []


def test_kernel_nulls_and_ids(spark):
    kernel = Kernel(spark, demo())
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "ξψω αβγ hello")], "k long, t string").select("k", kernel.embed_with_stats("t").alias("s")).orderBy("k").collect()
    assert rows[0].s is None or rows[0].s.vec is None
    assert rows[1].s.vec == [0.0] * 8 and rows[2].s[1:] == (3, 2, 1, False)
    ids = spark.createDataFrame([([143, 1],)], "i array<int>").select(kernel.embed_ids("i").alias("s")).first().s
    assert ids[1:] == (2, 1, 1, False)
    kernel.register()
    assert spark.sql("select tv_tokenize('hello') as t").first().t == [143]


def test_container(tmp_path):
    path = str(tmp_path / "m.tvec")
    model = demo()
    container.save(model, path)
    again = container.load(path, True)
    assert again.meta == model.meta and again.tokens == model.tokens and (again.matrix == model.matrix).all()
    data = bytearray(open(path, "rb").read())
    data[-100] ^= 1
    open(path, "wb").write(data)
    assert not container.verify(path)[0]
    with pytest.raises(InvalidModel):
        container.load(path, True)
    for n in (3, 40, 200, len(data) - 5000):
        open(path, "wb").write(data[:n])
        with pytest.raises(InvalidModel):
            container.load(path)
    with pytest.raises(ModelNotFound):
        container.load(str(tmp_path / "none"))
    for bad in ("", "../x", "/etc/x", "a//b", "a:b"):
        with pytest.raises(InvalidOption):
            container.model_path(bad)


def _source(folder, model, **config):
    spec = {
        "added_tokens": [{"id": i, "content": t, "special": True, "normalized": False, "lstrip": False, "rstrip": False, "single_word": False} for i, t in enumerate(model.meta.added_tokens)],
        "normalizer": {"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": True, "strip_accents": None, "lowercase": True}, "pre_tokenizer": {"type": "BertPreTokenizer"},
        "model": {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 100, "vocab": {t: i for i, t in enumerate(model.tokens)}},
    }
    (folder / "tokenizer.json").write_text(json.dumps(spec))
    (folder / "config.json").write_text(json.dumps({"model_type": "model2vec", "normalize": True} | config))
    return spec


def test_conversion(tmp_path):
    model = demo()
    spec = _source(tmp_path, model)
    weights, mapping = 0.5 + np.arange(176) % 5, np.arange(176) % 16
    container.write_tensors(str(tmp_path / "model.safetensors"), {"embeddings": model.matrix[:16], "weights": weights, "mapping": mapping.astype(np.int64)})
    found = container.convert(str(tmp_path))
    assert found.meta == model.meta and np.allclose(found.matrix, model.matrix[mapping] * weights[:, None])
    assert container.convert(str(tmp_path), dimensions=4).matrix.shape == (176, 4)
    container.write_tensors(str(tmp_path / "model.safetensors"), {"embeddings": model.matrix, "other": weights})
    with pytest.raises(InvalidSource):
        container.convert(str(tmp_path))
    spec["model"]["vocab"]["hole"] = 500
    (tmp_path / "tokenizer.json").write_text(json.dumps(spec))
    with pytest.raises(InvalidSource):
        container.convert(str(tmp_path))


def test_stream(spark, tmp_path):
    from textvec.streaming.embed import embed_stream, write_stream

    spark.createDataFrame([(1, "hello"), (2, "world")], "k long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, text string").parquet(str(tmp_path / "in"))
    write_stream(embed_stream(stream, Kernel(spark, demo())), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_command_line(tmp_path, capsys):
    from textvec.__main__ import main

    path = str(tmp_path / "m.tvec")
    container.save(demo(), path)
    assert main(["verify", path]) == 0 and main(["tokenize", path, "hello"]) == 0 and main(["embed", path, "hello"]) == 0 and main(["inspect", os.devnull]) == 1
    assert '"ids": [143]' in capsys.readouterr().out


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
