"""Model files: a checksummed container, safetensors, and conversion from source folders. Driver-side and fail-closed."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import unicodedata
from dataclasses import asdict, replace

import numpy as np

from textvec.errors import ConversionError, InvalidModel, InvalidOption, InvalidSource, ModelNotFound, UnsupportedModel
from textvec.model import SPECIAL, Meta, Model, body, demo

MAGIC, VERSION, ALIGN = b"TVEC", 1, 64
_HEAD = struct.Struct("<4sIQ32s")


def save(model: Model, path: str) -> None:
    """Write a container: head, JSON header, then tokens and matrix on 64-byte bounds. Equal models give equal files."""
    tokens, matrix = json.dumps(model.tokens, ensure_ascii=False).encode(), model.matrix.astype("<f4").tobytes()
    sections, at = {}, 0
    for name, data in (("tokens", tokens), ("matrix", matrix)):
        sections[name] = [at, len(data)]
        at += len(data) + -len(data) % ALIGN
    header = json.dumps({"meta": asdict(model.meta), "sections": sections, "provenance": model.provenance}, sort_keys=True).encode()
    head = _HEAD.size + len(header)
    rest = header + bytes(-head % ALIGN) + b"".join(d + bytes(-len(d) % ALIGN) for d in (tokens, matrix))
    plain = _HEAD.pack(MAGIC, VERSION, len(header), bytes(32))
    digest = hashlib.sha256(plain + rest).digest()
    with open(path + ".part", "wb") as f:
        f.write(_HEAD.pack(MAGIC, VERSION, len(header), digest) + rest)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".part", path)  # maps of an older file keep what they have


def _head(path: str) -> tuple[int, bytes]:
    if not os.path.isfile(path):
        raise ModelNotFound(path)
    with open(path, "rb") as f:
        raw = f.read(_HEAD.size)
    if len(raw) < _HEAD.size or raw[:4] != MAGIC:
        raise InvalidModel("not a model file")
    _, version, size, digest = _HEAD.unpack(raw)
    if version != VERSION:
        raise UnsupportedModel(f"version {version}")
    return size, digest


def verify(path: str) -> tuple[bool, str, str]:
    """Whether the checksum holds; the stored and the computed one. Reads a megabyte at a time."""
    size, stored = _head(path)
    digest = hashlib.sha256(_HEAD.pack(MAGIC, VERSION, size, bytes(32)))
    with open(path, "rb") as f:
        f.seek(_HEAD.size)
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.digest() == stored, stored.hex(), digest.hexdigest()


def load(path: str, verify_checksum: bool = False) -> Model:
    """The model of a container. Its matrix is mapped, not read: pages come when rows are asked for."""
    size, _ = _head(path)
    if verify_checksum and not verify(path)[0]:
        raise InvalidModel("checksum mismatch")
    whole = os.path.getsize(path)
    try:
        if _HEAD.size + size > whole:
            raise InvalidModel("header is cut off")
        with open(path, "rb") as f:
            f.seek(_HEAD.size)
            header = json.loads(f.read(size))
        meta = Meta(**{**header["meta"], "added_tokens": tuple(header["meta"]["added_tokens"])})
        base = -(-(_HEAD.size + size) // ALIGN) * ALIGN
        spans = sorted((at, n, name) for name, (at, n) in header["sections"].items())
        end = 0
        for at, n, name in spans:
            if at < end or at % ALIGN or n < 0 or base + at + n > whole:
                raise InvalidModel(f"section {name} is out of place")
            end = at + n
        if whole != base + end + -end % ALIGN:
            raise InvalidModel("the file does not end with its last section")
        (first, n), (second, m) = header["sections"]["tokens"], header["sections"]["matrix"]
        with open(path, "rb") as f:
            f.seek(base + first)
            tokens = tuple(json.loads(f.read(n)))
        if m != 4 * meta.vocab_size * meta.dim:
            raise InvalidModel("the matrix has another size than the metadata say")
        matrix = np.asarray(np.memmap(path, "<f4", "r", base + second, (meta.vocab_size, meta.dim)))
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise InvalidModel(f"damaged model file: {e}") from e
    return Model(meta, tokens, matrix, header.get("provenance", {}), path, m)


# ---- named models -----------------------------------------------------------------------------------------------


def cache_dir() -> str:
    base = os.environ.get("TEXTVEC_CACHE")
    return base or os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "textvec")


def model_path(model_id: str) -> str:
    """Where a named model lies; names cannot leave the cache."""
    parts = model_id.split("/")
    if not model_id or os.path.isabs(model_id) or any(p in ("", ".", "..") or ":" in p or "\0" in p or "\\" in p for p in parts):
        raise InvalidOption(f"no model id: {model_id!r}")
    return os.path.join(cache_dir(), "models", *parts) + ".tvec"


def load_model(model_id: str, verify_checksum: bool = False) -> Model:
    return load(model_path(model_id), verify_checksum)


def load_builtin(name: str = "demo") -> Model:
    if name != "demo":
        raise ModelNotFound(name)
    return demo()


# ---- safetensors ------------------------------------------------------------------------------------------------

_SIZES = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4}


def describe_tensors(path: str) -> dict[str, tuple[str, tuple[int, ...], int, int]]:
    """name -> (dtype, shape, offset in the file, bytes)."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        raw = f.read(8)
        n = int.from_bytes(raw, "little")
        if len(raw) < 8 or not 1 <= n <= min(100 << 20, size - 8):
            raise InvalidSource("bad tensor header length")
        try:
            header = json.loads(f.read(n))
        except ValueError as e:
            raise InvalidSource("tensor header is no JSON") from e
    if not isinstance(header, dict):
        raise InvalidSource("tensor header is no object")
    out = {}
    for name, t in header.items():
        if name == "__metadata__":
            continue
        try:
            (a, b), shape, kind = t["data_offsets"], tuple(t["shape"]), t["dtype"]
            good = kind in _SIZES and 0 <= a <= b <= size - 8 - n and all(isinstance(s, int) and s >= 0 for s in shape) and b - a == int(np.prod(shape, dtype=object)) * _SIZES[kind]
        except (TypeError, KeyError, ValueError) as e:
            raise InvalidSource(f"tensor {name} is malformed") from e
        if not good:
            raise InvalidSource(f"tensor {name} has a bad type, shape or span")
        out[name] = (kind, shape, 8 + n + a, b - a)
    return out


def read_tensor(path: str, name: str) -> np.ndarray:
    """A tensor; half floats of both kinds become 32-bit floats."""
    kinds = describe_tensors(path)
    if name not in kinds:
        raise InvalidSource(f"no tensor {name}")
    kind, shape, at, n = kinds[name]
    raw = np.fromfile(path, {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4"}[kind], n // _SIZES[kind], offset=at)
    if kind == "BF16":
        raw = (raw.astype("<u4") << 16).view("<f4")
    return (raw.astype("<f4") if kind == "F16" else raw).reshape(shape)


def write_tensors(path: str, tensors: dict[str, np.ndarray]) -> None:
    names = {"float64": "F64", "float32": "F32", "float16": "F16", "int64": "I64", "int32": "I32"}
    header, at = {}, 0
    for name, x in tensors.items():
        header[name] = {"dtype": names[x.dtype.name], "shape": list(x.shape), "data_offsets": [at, at + x.nbytes]}
        at += x.nbytes
    raw = json.dumps(header).encode()
    raw += b" " * (-len(raw) % 8)
    with open(path, "wb") as f:
        f.write(len(raw).to_bytes(8, "little") + raw + b"".join(np.ascontiguousarray(x).tobytes() for x in tensors.values()))


# ---- conversion -------------------------------------------------------------------------------------------------


def read_json(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            out = json.load(f)
    except (OSError, ValueError) as e:
        raise InvalidSource(f"{path}: {e}") from e
    if not isinstance(out, dict):
        raise InvalidSource(f"{path} is no object")
    return out


def detect(folder: str) -> str:
    """``model2vec`` or ``sentence_transformers_static``."""
    here = lambda name: os.path.isfile(os.path.join(folder, name))
    if here("config.json") and here("tokenizer.json") and here("model.safetensors"):
        config = read_json(os.path.join(folder, "config.json"))
        if config.get("model_type") == "model2vec" or "StaticModel" in (config.get("architectures") or []):
            return "model2vec"
    if here("modules.json"):
        return "sentence_transformers_static"
    raise InvalidSource(f"{folder} holds no known model")


def audit_tokenizer(spec: dict) -> tuple[tuple[str, ...], dict]:
    """The vocabulary in order of ids and what the tokenizer says of normalization; anything unknown is refused."""
    model, norm, pre = (spec.get(k) or {} for k in ("model", "normalizer", "pre_tokenizer"))
    want = [
        (model.get("type", "WordPiece"), "WordPiece"), (norm.get("type"), "BertNormalizer"), (pre.get("type"), "BertPreTokenizer"),
        (model.get("continuing_subword_prefix", "##"), "##"), (model.get("unk_token"), "[UNK]"), (norm.get("clean_text"), True),
    ]
    for got, needed in want:
        if got != needed:
            raise InvalidSource(f"tokenizer has {got!r} where {needed!r} is needed")
    vocab = model.get("vocab")
    if not isinstance(vocab, dict) or not all(isinstance(i, int) and not isinstance(i, bool) for i in vocab.values()) or sorted(vocab.values()) != list(range(len(vocab))):
        raise InvalidSource("token ids must be 0, 1, 2, ... without holes or repeats")
    for t in spec.get("added_tokens") or []:
        if t.get("content") not in SPECIAL or not t.get("special") or t.get("normalized") is not False or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or vocab.get(t["content"]) != t.get("id"):
            raise InvalidSource(f"added token {t.get('content')!r} is not supported")
    added = tuple(t["content"] for t in spec.get("added_tokens") or [])
    if len(set(added)) != len(added):
        raise InvalidSource("an added token is declared twice")
    if unknown := sorted(set(norm) - {"type", "clean_text", "handle_chinese_chars", "strip_accents", "lowercase"}):
        raise InvalidSource(f"normalizer has unknown settings {unknown}")
    lower = bool(norm.get("lowercase"))
    strip = norm.get("strip_accents")
    facts = {"lowercase": lower, "strip_accents": lower if strip is None else bool(strip), "handle_chinese_chars": bool(norm.get("handle_chinese_chars")), "max_input_chars_per_word": model.get("max_input_chars_per_word", 100), "added_tokens": added}
    return tuple(sorted(vocab, key=vocab.__getitem__)), facts


def convert(folder: str, dimensions: int | None = None, max_tokens: int | bool | None = None, truncation: str | None = None, model_id: str | None = None, revision: str | None = None, trained_dims: list[int] | None = None) -> Model:
    """A model from a source folder, with the defaults of its kind. ``revision`` and ``trained_dims``, the widths that the
    source was trained for, are recorded only."""
    kind, root = detect(folder), os.path.realpath(folder)
    if kind == "model2vec":
        at, config = root, read_json(os.path.join(root, "config.json"))
        limit = config.get("max_length", 512) or 0
        defaults = {"max_tokens": limit, "normalization": "l2" if config.get("normalize") else "none", "unk_policy": "drop", "truncation": "raw_ids"}
    else:
        try:
            with open(os.path.join(root, "modules.json"), encoding="utf-8") as f:
                modules = json.load(f)
            at = os.path.realpath(os.path.join(root, modules[0].get("path", "")))
        except (OSError, ValueError, LookupError, AttributeError, TypeError) as e:
            raise InvalidSource("modules.json cannot be read") from e
        if at != root and not at.startswith(root + os.sep):
            raise InvalidSource("a module lies outside the source")
        if not str(modules[0].get("type", "")).endswith("StaticEmbedding"):
            raise InvalidSource("the first module is no static embedding")
        defaults = {"max_tokens": 0, "normalization": "none", "unk_policy": "include", "truncation": "usable_ids"}
    tokens, facts = audit_tokenizer(read_json(os.path.join(at, "tokenizer.json")))
    weights_path = os.path.join(at, "model.safetensors")
    kinds = describe_tensors(weights_path) if os.path.isfile(weights_path) else {}
    tables = [n for n, (_, shape, _, _) in kinds.items() if len(shape) == 2]
    if len(tables) != 1 or set(kinds) - {*tables, "weights", "mapping"}:
        raise InvalidSource(f"tensors are {sorted(kinds)}; one matrix, weights and mapping are known")
    matrix = read_tensor(weights_path, tables[0]).astype("<f4")
    matrix = bake(matrix, len(tokens), read_tensor(weights_path, "weights") if "weights" in kinds else None, read_tensor(weights_path, "mapping") if "mapping" in kinds else None)
    if max_tokens is not None:
        if max_tokens is not False and max_tokens < 1:
            raise InvalidOption("max_tokens must be positive, or False for no limit")
        defaults["max_tokens"] = max_tokens or 0
    if truncation:
        defaults["truncation"] = truncation
    meta = Meta(matrix.shape[1], len(tokens), unk_id=tokens.index("[UNK]") if "[UNK]" in tokens else -1, max_token_chars=max(map(len, map(body, tokens)), default=0), **defaults, **facts)
    native = meta.dim
    if trained_dims is not None and not (trained_dims and all(isinstance(n, int) and 1 <= n <= native for n in trained_dims)):
        raise InvalidOption(f"trained dimensions must be in 1..{native}")
    model = Model(meta, tokens, matrix)
    model = model.sliced(dimensions) if dimensions else model
    return replace(model, provenance=_provenance(model, kind, root, at, kinds, native, model_id, revision, trained_dims))


def _provenance(model: Model, kind: str, root: str, at: str, kinds: dict, native: int, model_id: str | None, revision: str | None, trained_dims: list[int] | None) -> dict:
    """What a container records of its source. Keys that say nothing of a source are left out."""
    m = model.meta
    files = {os.path.relpath(p, root): file_digest(p) for p in sorted(os.path.join(f, n) for f in {root, at} for n in _READ) if os.path.isfile(p)}
    out = {
        "model_id": model_id or os.path.basename(root), "source_kind": kind, "source_revision": revision, "source_files_sha256": files,
        "native_dim": native, "output_dim": m.dim, "vocab_size": m.vocab_size, "max_tokens": m.max_tokens, "truncation": m.truncation, "unk_policy": m.unk_policy,
        "normalize": model.normalized, "container_version": VERSION, "unicode_version": unicodedata.unidata_version,
        "trained_dims": sorted(set(trained_dims), reverse=True) if trained_dims else None, "baked_weights": "weights" in kinds or None,
        "baked_clusters": next(s[0] for n, (_, s, _, _) in kinds.items() if len(s) == 2) if "mapping" in kinds else None,
    }
    return {k: out[k] for k in sorted(out) if out[k] is not None}


#: Files of a source folder that a conversion may read.
_READ = ("config.json", "modules.json", "tokenizer.json", "tokenizer_config.json", "model.safetensors")


def file_digest(path: str) -> str:
    """SHA-256 of a file, a megabyte at a time."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def bake(matrix: np.ndarray, rows: int, weights: np.ndarray | None, mapping: np.ndarray | None) -> np.ndarray:
    """A row per token: through ``mapping`` if there is one, scaled by ``weights`` in double precision."""
    if mapping is not None:
        if mapping.shape != (rows,) or mapping.min(initial=0) < 0 or mapping.max(initial=0) >= len(matrix):
            raise ConversionError("mapping does not fit the vocabulary and the matrix")
        matrix = matrix[mapping]
    if len(matrix) != rows:
        raise ConversionError("the matrix has not a row per token")
    if weights is not None:
        if weights.shape != (rows,):
            raise ConversionError("weights do not fit the vocabulary")
        matrix = (matrix.astype(np.float64) * weights.astype(np.float64)[:, None]).astype("<f4")
    return np.ascontiguousarray(matrix, "<f4")


def inspect(path: str) -> dict:
    m = load(path)
    return {"model_id": m.model_id, "dim": m.dim, "vocab_size": m.vocab_size, "max_tokens": m.max_tokens, "truncation": m.truncation, "normalized": m.normalized, "lowercase": m.lowercase, "unk_policy": m.meta.unk_policy, "unk_id": m.unk_id, "bytes": os.path.getsize(path), "provenance": m.provenance}
