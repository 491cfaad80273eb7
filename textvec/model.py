"""A static embedding model: metadata, vocabulary and matrix; and a small deterministic one for tests."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from textvec.errors import InvalidModel, InvalidOption

SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")


@dataclass(frozen=True)
class Meta:
    """Everything that can change a result."""

    dim: int
    vocab_size: int
    max_tokens: int = 512  # 0: unlimited
    truncation: str = "raw_ids"  # or usable_ids
    unk_policy: str = "drop"  # or include
    empty_policy: str = "zero"  # or raise
    normalization: str = "l2"  # or none
    lowercase: bool = True
    strip_accents: bool = True
    clean_text: bool = True
    handle_chinese_chars: bool = True
    max_input_chars_per_word: int = 100
    max_token_chars: int = 0
    unk_id: int = 1
    added_tokens: tuple[str, ...] = SPECIAL

    def __post_init__(self):
        for name, allowed in (("truncation", ("raw_ids", "usable_ids")), ("unk_policy", ("drop", "include")), ("empty_policy", ("zero", "raise")), ("normalization", ("l2", "none"))):
            if getattr(self, name) not in allowed:
                raise InvalidModel(f"{name} must be one of {allowed}, not {getattr(self, name)!r}")
        if self.dim < 1 or self.max_tokens < 0:
            raise InvalidModel("dim must be positive and max_tokens not negative")


@dataclass(frozen=True)
class Model:
    """Immutable; broadcast to executors as a whole, so its size is bounded by the model file."""

    meta: Meta
    tokens: tuple[str, ...]
    matrix: np.ndarray
    provenance: dict = field(default_factory=dict)
    path: str | None = None  # of the container that it was loaded from
    mapped_bytes: int = 0  # of the container that are mapped

    def __post_init__(self):
        validate(self)

    @property
    def dim(self) -> int:
        return self.meta.dim

    @property
    def vocab_size(self) -> int:
        return len(self.tokens)

    @property
    def max_tokens(self) -> int | bool:
        return self.meta.max_tokens or False

    @property
    def normalized(self) -> bool:
        return self.meta.normalization == "l2"

    @property
    def truncation(self) -> str:
        return self.meta.truncation

    @property
    def lowercase(self) -> bool:
        return self.meta.lowercase

    @property
    def unk_id(self) -> int:
        return self.meta.unk_id

    @property
    def model_id(self) -> str | None:
        return self.provenance.get("model_id")

    def with_meta(self, **changes) -> "Model":
        return replace(self, meta=replace(self.meta, **changes))

    def sliced(self, dim: int) -> "Model":
        """The first ``dim`` components of every row; normalization comes after."""
        if not 1 <= dim <= self.dim:
            raise InvalidOption(f"dimensions must be in 1..{self.dim}")
        return replace(self, meta=replace(self.meta, dim=dim), matrix=self.matrix[:, :dim].copy())

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, is_continuation(t), body(t), len(body(t))) for i, t in enumerate(self.tokens)]
        return spark.createDataFrame(rows, "token string, token_id int, is_continuation boolean, body string, n_chars int")

    def matrix_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(self.matrix)], "token_id int, vec array<float>")

    def meta_frame(self, spark: SparkSession) -> DataFrame:
        m = self.meta
        return spark.createDataFrame([(m.dim, m.vocab_size, m.max_tokens, m.truncation, m.unk_policy, m.normalization, m.lowercase, m.max_token_chars, m.unk_id)], "dim int, vocab_size int, max_tokens long, truncation string, unk_policy string, normalization string, lowercase boolean, max_token_chars int, unk_id int")


def is_continuation(token: str) -> bool:
    return token.startswith("##") and token != "##"


def body(token: str) -> str:
    return token[2:] if is_continuation(token) else token


def validate(model: Model) -> None:
    """Refuse vocabularies with doubles or without the unknown token, and matrices of another shape."""
    m = model.meta
    if len(set(model.tokens)) != len(model.tokens):
        raise InvalidModel("a token occurs twice")
    if m.vocab_size != len(model.tokens) or model.matrix.shape != (m.vocab_size, m.dim) or model.matrix.dtype != np.float32:
        raise InvalidModel("vocabulary, matrix and metadata differ in size or type")
    if not 0 <= m.unk_id < m.vocab_size or model.tokens[m.unk_id] != "[UNK]":
        raise InvalidModel("[UNK] is not where the metadata say")
    if missing := [t for t in m.added_tokens if t not in model.tokens]:
        raise InvalidModel(f"added tokens without an id: {missing}")


def demo() -> Model:
    """The built-in model: 176 tokens in eight dimensions, the same everywhere."""
    latin, cyrillic = [chr(c) for c in range(97, 123)], [chr(c) for c in range(0x430, 0x450)]
    # The vocabulary groups, in order; first occurrences count.
    words = "hello world ruby gem static embedding vector search text token the of and a for local fast model cafe naive".split()
    words += "привет мир поиск текст вектор модель локальный быстрый".split()
    groups = [*SPECIAL, *latin, *map(str, range(10)), *cyrillic, *("##" + c for c in latin), *("##" + c for c in cyrillic), *".,!?-:;'\"()/", *words, *("##" + x for x in "ing ed er s ик ов ый".split())]
    tokens = tuple(dict.fromkeys(groups))
    state, cells = 0x12345678, []
    for _ in range(len(tokens) * 8):
        state = (state * 1103515245 + 12345) & 0x7FFFFFFF
        cells.append((state % 20000 - 10000) / 10000)
    matrix = np.array(cells, np.float32).reshape(len(tokens), 8)
    return Model(Meta(8, len(tokens), max_token_chars=max(len(body(t)) for t in tokens)), tokens, matrix, {"model_id": "demo"})
