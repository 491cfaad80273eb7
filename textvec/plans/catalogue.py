"""Named queries over the standard tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textvec.functions import codec
from textvec.functions.hashing import fnv1a_column
from textvec.functions.normalize import clean_column, normalize_column, words_column
from textvec.model import SPECIAL, body, demo, is_continuation
from textvec.operators import evaluate, quality, search
from textvec.operators.embed import Kernel, embed_relational, spread
from textvec.operators.ranges import coalesce_ranges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(_read(spark, d, "documents"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), "label")


def _first(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in _vectors(spark, d).orderBy("row_id").first().vec]


def _r(name: str = "score", digits: int = 5):
    """Rounded without a negative zero."""
    return (F.round(name, digits) + 0.0).alias(name)


# ---- search -----------------------------------------------------------------------------------------------------

_DOT = "list_sum([p[1]::double * p[2]::double for p in list_zip({a}, {b})])"
_SQ = "list_sum([x::double * x::double for x in {a}])"
_PAIR = "with q as (select vec_id as query_id, embedding as e from embeddings where {where}), s as (select query_id, vec_id as row_id, label, {score} as score from q, embeddings) "
_D = _DOT.format(a="q.e", b="embedding")
_C = f"{_D} / sqrt({_SQ.format(a='q.e')}) / sqrt({_SQ.format(a='embedding')})"
_ONE = "vec_id = (select min(vec_id) from embeddings)"
_TOP = "select row_number() over (order by score desc, row_id)::int as rank, row_id, round(score, 5) + 0.0 as score from s {where} order by score desc, row_id limit 10"


@query(_PAIR.format(where=_ONE, score=_C) + _TOP.format(where=""))
def cosine_topk(spark, d):
    return search.top_k(_vectors(spark, d), _first(spark, d), 10, "cosine").select("rank", "row_id", _r())


@query(_PAIR.format(where=_ONE, score=_D) + _TOP.format(where=""))
def dot_topk(spark, d):
    return search.top_k(_vectors(spark, d), _first(spark, d), 10, "dot").select("rank", "row_id", _r())


@query(_PAIR.format(where=_ONE, score=_C) + _TOP.format(where="where label = 3"))
def cosine_topk_filtered(spark, d):
    return search.top_k(_vectors(spark, d).where("label = 3"), _first(spark, d), 10).select("rank", "row_id", _r())


_AWAY = "list_sum([{of} for p in list_zip(q.e, embedding)])"


@query(_PAIR.format(where=_ONE, score="-sqrt(" + _AWAY.format(of="pow(p[1]::double - p[2]::double, 2)") + ")") + _TOP.format(where=""))
def euclidean_topk(spark, d):
    return search.top_k(_vectors(spark, d), _first(spark, d), 10, "euclidean").select("rank", "row_id", _r())


@query(_PAIR.format(where=_ONE, score="-" + _AWAY.format(of="abs(p[1]::double - p[2]::double)")) + _TOP.format(where=""))
def manhattan_topk(spark, d):
    return search.top_k(_vectors(spark, d), _first(spark, d), 10, "manhattan").select("rank", "row_id", _r())


@query(_PAIR.format(where=_ONE, score=_C) + _TOP.format(where=""))
def stored_norm_topk(spark, d):
    return search.top_k(search.with_norms(_vectors(spark, d)), _first(spark, d), 10, norm_col="norm").select("rank", "row_id", _r())


_BATCH = ", r as (select *, row_number() over (partition by query_id order by score desc, row_id)::int as rank from s) select query_id, rank, row_id, round(score, 5) + 0.0 as score from r where rank <= {k}"


@query(_PAIR.format(where="vec_id % 100 = 0", score=_C) + _BATCH.format(k=5))
def cosine_topk_batched(spark, d):
    rows = _vectors(spark, d)
    found = search.top_k_batched(rows, rows.where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id"), 5)
    return found.select("query_id", "rank", "row_id", _r())


@query("with r as (select vec_id as row_id, label::double as score from embeddings) select row_number() over (order by score desc, row_id)::int as rank, row_id, score from r order by score desc, row_id limit 25")
def topk_tie_order(spark, d):
    rows = _vectors(spark, d).select("row_id", F.array(F.col("label").cast("float")).alias("vec"))
    return search.top_k(rows, [1.0], 25, "dot")


@query(
    f"with v as (select vec_id as row_id, vec_id % 3 as kind, embedding from embeddings), q as (select embedding as e from embeddings where {_ONE}), "
    f"s as (select row_id, case when kind = 1 then 0.0 else {_C} end as score from v, q where kind <> 2) "
    "select row_number() over (order by score desc, row_id)::int as rank, row_id, round(score, 5) + 0.0 as score from s order by score desc, row_id limit 300"
)
def topk_nan_zero_rows(spark, d):
    x = F.when(F.col("row_id") % 3 == 1, F.lit(0.0)).when(F.col("row_id") % 3 == 2, F.lit(float("nan")))
    rows = _vectors(spark, d).select("row_id", F.transform("vec", lambda v: F.coalesce(x, v.cast("double"))).alias("vec"))
    return search.top_k(rows, _first(spark, d), 300).select("rank", "row_id", _r())


@query(_PAIR.format(where=_ONE, score=_D) + "select row_number() over (order by score desc, row_id)::int as rank, row_id, round(score, 5) + 0.0 as score from s where label = 9 order by score desc, row_id")
def topk_k_exceeds_rows(spark, d):
    return search.top_k(_vectors(spark, d).where("label = 9"), _first(spark, d), 1_000_000, "dot").select("rank", "row_id", _r())


@query(f"select vec_id as row_id, round(sqrt({_SQ.format(a='embedding')}), 5) as norm from embeddings")
def vector_norms(spark, d):
    return _vectors(spark, d).select("row_id", F.round(search.norm(F.col("vec")), 5).alias("norm"))


@query(f"with v as (select vec_id as row_id, [x::double * label for x in embedding] as w from embeddings), n as (select *, sqrt({_SQ.format(a='w')}) as n from v) select row_id, round(case when n > 0 then w[1] / n else 0 end, 5) + 0.0 as first, round(case when n > 0 then n / n else 0 end, 5) as norm from n")
def l2_normalize(spark, d):
    unit = search.l2_normalize(F.transform("vec", lambda x: x.cast("double") * F.col("label")))
    return _vectors(spark, d).withColumn("u", unit).select("row_id", (F.round(F.col("u")[0], 5) + 0.0).alias("first"), F.round(search.norm(F.col("u")), 5).alias("norm"))


@query("with c as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) select label, (i - 1)::int as dim, round(avg(x::double), 5) + 0.0 as mean from c group by label, i")
def mean_pool_by_label(spark, d):
    cells = _vectors(spark, d).select("label", F.posexplode("vec").alias("dim", "x"))
    return cells.groupBy("label", "dim").agg((F.round(F.avg(F.col("x").cast("double")), 5) + 0.0).alias("mean"))


@query((_PAIR.format(where=_ONE, score=_C) + _TOP.format(where="")).replace("embedding as e", "embedding[:16] as e").replace("query_id, vec_id as row_id, label,", "query_id, vec_id as row_id, label,").replace("q, embeddings)", "q, (select vec_id, label, embedding[:16] as embedding from embeddings))"))
def mrl_slice_topk(spark, d):
    rows = _vectors(spark, d).withColumn("vec", F.slice("vec", 1, 16))
    return search.top_k(rows, _first(spark, d)[:16], 10).select("rank", "row_id", _r())


# ---- codec ------------------------------------------------------------------------------------------------------

_HALF = "case when abs({x}) < power(2, -25) then 0.0 else sign({x}) * floor(abs({x}) / power(2.0, greatest(floor(log2(abs({x}))), -14) - 10) + 0.5) * power(2.0, greatest(floor(log2(abs({x}))), -14) - 10) end"


@query(f"with c as (select vec_id as row_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) select row_id, (i - 1)::int as dim, round({_HALF.format(x='x')}, 9) + 0.0 as value from c")
def f16_roundtrip(spark, d):
    rows = _vectors(spark, d).select("row_id", codec.unpack_column(codec.pack_column("vec", "f16"), 64, "f16").alias("rows"))
    cells = rows.select("row_id", F.posexplode(F.col("rows")[0]).alias("dim", "x"))
    return cells.select("row_id", "dim", (F.round(F.col("x").cast("double"), 9) + 0.0).alias("value"))


@query(f"with c as (select vec_id, unnest(embedding)::double as x from embeddings), h as (select vec_id, x, {_HALF.format(x='x')} as y from c), p as (select vec_id, sum(x * y) / sqrt(sum(x * x)) / sqrt(sum(y * y)) as cos, max(abs(x - y)) as diff, abs(sqrt(sum(x * x)) - sqrt(sum(y * y))) as delta from h group by vec_id) select count(*) as rows, round(min(cos), 6) as min_cosine, round(avg(cos), 6) as mean_cosine, round(max(diff), 8) as max_abs, round(max(delta), 6) as max_norm_delta from p")
def f16_drift_stats(spark, d):
    q = quality.half_float_quality(_vectors(spark, d))
    return q.select("rows", F.round("min_cosine", 6).alias("min_cosine"), F.round("mean_cosine", 6).alias("mean_cosine"), F.round("max_abs", 8).alias("max_abs"), F.round("max_norm_delta", 6).alias("max_norm_delta"))


@query((_PAIR.format(where=_ONE, score=_D) + _TOP.format(where="")).replace("embedding as e", f"[{_HALF.format(x='x::double')} for x in embedding] as e").replace("q, embeddings)", f"q, (select vec_id, label, [{_HALF.format(x='x::double')} for x in embedding] as embedding from embeddings))"))
def f16_topk(spark, d):
    half = lambda v: F.transform(v, lambda x: codec.f16_column(x.cast("double")))
    query_ = [float(x) for x in codec.decode_f16(codec.encode_f16(_first(spark, d)))]
    return search.top_k(_vectors(spark, d).withColumn("vec", half("vec")), query_, 10, "dot").select("rank", "row_id", _r())


# ---- model ------------------------------------------------------------------------------------------------------


def _values(rows: list[tuple]) -> str:
    said = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)
    return ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)


_VOCAB = "vocab(token, token_id, inner_, body) as (values " + _values([(t, i, is_continuation(t), body(t)) for i, t in enumerate(demo().tokens)]) + ")"
_MATRIX = "cells as (with recursive g(n, s) as (select 0, (305419896::bigint * 1103515245 + 12345) & 2147483647 union all select n + 1, (s * 1103515245 + 12345) & 2147483647 from g where n < 176 * 8 - 1) select (n // 8)::int as token_id, (n % 8)::int as i, ((s % 20000 - 10000) / 10000.0)::float as x from g)"


@query(f"with {_VOCAB} select token, token_id::int as token_id, inner_ as is_continuation, body, length(body)::int as n_chars from vocab")
def vocab_table(spark, d):
    return demo().vocab_frame(spark)


@query(f"with {_VOCAB} select count(*) as rows, count(distinct token) as tokens, count(distinct token_id) as ids, min(token_id)::int as low, max(token_id)::int as high, max(length(body))::int as longest from vocab")
def vocab_validation(spark, d):
    v = demo().vocab_frame(spark)
    return v.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("token").alias("tokens"), F.countDistinct("token_id").alias("ids"), F.min("token_id").alias("low"), F.max("token_id").alias("high"), F.max("n_chars").alias("longest"))


@query(f"with {_MATRIX} select i as dim, round(sum(x::double), 4) + 0.0 as total from cells group by i")
def matrix_checksum_by_dim(spark, d):
    return demo().matrix_frame(spark).select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg((F.round(F.sum(F.col("x").cast("double")), 4) + 0.0).alias("total"))


@query(f"with {_MATRIX} select token_id, i as dim, round(x::double * (0.1::double + ((token_id * 37) % 29) / 7.0::double), 5) + 0.0 as value from cells")
def weighted_matrix(spark, d):
    w = F.lit(0.1) + ((F.col("token_id") * 37) % 29) / 7.0
    cells = demo().matrix_frame(spark).select("token_id", F.posexplode("vec").alias("dim", "x"))
    return cells.select("token_id", "dim", (F.round(F.col("x").cast("double") * w, 5) + 0.0).alias("value"))


@query(f"with {_VOCAB}, {_MATRIX} select vocab.token_id::int as token_id, i as dim, round(x::double * (0.5::double + vocab.token_id % 5), 5) + 0.0 as value from vocab join cells on cells.token_id = vocab.token_id % 16")
def mapped_matrix(spark, d):
    tokens = demo().vocab_frame(spark).select("token_id", (F.col("token_id") % 16).alias("cluster"))
    rows = tokens.join(demo().matrix_frame(spark).withColumnRenamed("token_id", "cluster"), "cluster").select("token_id", F.posexplode("vec").alias("dim", "x"))
    return rows.select("token_id", "dim", (F.round(F.col("x").cast("double") * (F.lit(0.5) + F.col("token_id") % 5), 5) + 0.0).alias("value"))


@query(f"with {_VOCAB} select token, list_reduce([2166136261::bigint] || [p::bigint for p in [('0x' || hex(encode(token))[2 * k + 1:2 * k + 2])::bigint for k in range(octet_length(encode(token)))]], lambda h, b: (xor(h, b) * 16777619) & 4294967295) as hash from vocab")
def fnv1a_hash(spark, d):
    return demo().vocab_frame(spark).select("token", fnv1a_column("token").alias("hash"))


# ---- tokenize ---------------------------------------------------------------------------------------------------

_NORMAL = "lower(strip_accents(text))"
_CLEAN = r"regexp_replace(regexp_replace({x}, '[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{FFFD}]', '', 'g'), '[\t\n\r\x{A0}]', ' ', 'g')"
_WORDS = r"[w for w in string_split(regexp_replace(" + _CLEAN.replace("{x}", _NORMAL) + r", '([!-/:-@\[-`{-~]|\p{P})', ' \1 ', 'g'), ' ') if w <> '']"


@query("select doc_id, length(" + _CLEAN.replace("{x}", "text") + ")::int as n from documents")
def clean_text(spark, d):
    return _texts(spark, d).select("doc_id", F.char_length(clean_column(F.col("text"))).alias("n"))


@query("select doc_id, md5(" + _CLEAN.replace("{x}", _NORMAL) + ") as digest from documents")
def normalize_text(spark, d):
    return _texts(spark, d).select("doc_id", F.md5(normalize_column(F.col("text"))).alias("digest"))


@query(f"with w as (select doc_id, {_WORDS} as w from documents) select doc_id, len(w)::int as words, len(list_distinct(w))::int as distinct_words from w")
def pre_tokenize_counts(spark, d):
    w = _texts(spark, d).select("doc_id", words_column(normalize_column(F.col("text"))).alias("w"))
    return w.select("doc_id", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("distinct_words"))


@query("select item_id, [5::int, 1, 2, 3, 4][1 + (item_id % 5)::int] as first from benchmark where item_id % 5 > 0")
def added_tokens(spark, d):
    """Texts that are one added token each."""
    names = F.array(*(F.lit(t) for t in ("", *SPECIAL[1:])))
    rows = _read(spark, d, "benchmark").where("item_id % 5 > 0").select("item_id", names[(F.col("item_id") % 5).cast("int")].alias("t"))
    return rows.select("item_id", Kernel(spark, demo()).tokenize("t")[0].alias("first"))


_PIECES = f"""{_VOCAB}, dw as (select doc_id, w as word, i from (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as i from (select doc_id, {_WORDS} as w from documents))),
words as (select distinct word from dw where length(word) <= 100),
walk as (with recursive g(word, here, ids) as (select word, 1, []::int[] from words union all
  select g.word, g.here + length(v.body), list_append(g.ids, v.token_id) from g, lateral (select body, token_id::int as token_id from vocab where inner_ = (g.here > 1) and body <> '' and starts_with(substr(g.word, g.here), body) order by length(body) desc limit 1) v)
  select word, ids from g where here > length(word)),
ids as (select doc_id, i, coalesce(walk.ids, [1::int]) as ids from dw left join walk using (word)),
toks as (select doc_id, row_number() over (partition by doc_id order by i, k) as pos, id from (select doc_id, i, unnest(ids) as id, generate_subscripts(ids, 1) as k from ids))"""


def _stats(spark: SparkSession, d: str, **meta) -> DataFrame:
    rows = _texts(spark, d).select("doc_id", Kernel(spark, demo().with_meta(**meta)).embed_with_stats("text").alias("s"))
    return rows.select("doc_id", "s.token_count", "s.unk_count", "s.pooled_count", "s.truncated")


_COUNTS = "count(t.pos) as token_count, count(t.pos) filter (where t.id = 1) as unk_count, count(t.pos) filter (where t.id <> 1) as pooled_count"


@query(f"with {_PIECES} select documents.doc_id, {_COUNTS}, false as truncated from documents left join toks t using (doc_id) group by documents.doc_id")
def token_stats_unlimited(spark, d):
    return _stats(spark, d, max_tokens=0)


@query(f"with {_PIECES}, n as (select doc_id, count(*) as n from toks group by doc_id) select documents.doc_id, {_COUNTS}, coalesce(any_value(n.n), 0) > 512 as truncated from documents left join (select * from toks where pos <= 512) t using (doc_id) left join n using (doc_id) group by documents.doc_id")
def token_stats_raw_ids(spark, d):
    return _stats(spark, d)


@query(f"""with {_PIECES}, u as (select *, count(*) filter (where id <> 1) over (partition by doc_id order by pos) as seen from toks), e as (select doc_id, max(seen) as total, min(pos) filter (where seen = 512) as cut from u group by doc_id)
select documents.doc_id, {_COUNTS}, coalesce(any_value(e.total), 0) > 512 as truncated from documents left join (select u.* from u join e using (doc_id) where e.total <= 512 or u.pos <= e.cut) t using (doc_id) left join e using (doc_id) group by documents.doc_id""")
def token_stats_usable_ids(spark, d):
    return _stats(spark, d, truncation="usable_ids")


@query(f"with {_PIECES} select doc_id, md5(string_agg(id::varchar, ',' order by pos)) as digest, count(*) as n from toks group by doc_id")
def tokenize_ids(spark, d):
    ids = _texts(spark, d).select("doc_id", Kernel(spark, demo().with_meta(max_tokens=0)).tokenize("text").alias("ids")).where(F.size("ids") > 0)
    return ids.select("doc_id", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"), F.size("ids").cast("long").alias("n"))


@query(f"with {_PIECES} select doc_id, md5(string_agg(id::varchar, ',' order by pos)) as digest, count(*) as n from toks where pos <= 64 group by doc_id")
def tokenize_capped(spark, d):
    ids = _texts(spark, d).select("doc_id", Kernel(spark, demo()).tokenize("text", 64).alias("ids")).where(F.size("ids") > 0)
    return ids.select("doc_id", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"), F.size("ids").cast("long").alias("n"))


@query(f"with {_PIECES} select id as token_id, count(*) as n from toks group by id")
def token_histogram(spark, d):
    ids = _texts(spark, d).select(F.explode(Kernel(spark, demo().with_meta(max_tokens=0)).tokenize("text")).alias("token_id"))
    return ids.groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_PIECES} select lang, round(count(*) filter (where id = 1) / count(*), 6) as unk_ratio from toks join documents using (doc_id) group by lang")
def unk_ratio_by_lang(spark, d):
    s = _texts(spark, d).select("lang", Kernel(spark, demo().with_meta(max_tokens=0)).embed_with_stats("text").alias("s"))
    return s.groupBy("lang").agg(F.round(F.sum("s.unk_count") / F.sum("s.token_count"), 6).alias("unk_ratio"))


@query(f"with {_PIECES}, n as (select doc_id, count(*) as n from toks group by doc_id), w as (select doc_id, len([x for x in string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') if x <> '']) as w from documents) select lang, round(sum(n.n) / sum(w.w), 6) as pieces from documents join n using (doc_id) join w using (doc_id) group by lang")
def pieces_per_word(spark, d):
    docs = _texts(spark, d).select("lang", Kernel(spark, demo().with_meta(max_tokens=0)).embed_with_stats("text").alias("s"), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("w"))
    return docs.groupBy("lang").agg(F.round(F.sum("s.token_count") / F.sum("w"), 6).alias("pieces"))


@query(
    f"with {_PIECES}, n as (select doc_id, count(*) as n, count(*) filter (where id = 1) as u from toks group by doc_id), w as (select doc_id, len([x for x in string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') if x <> '']) as w from documents), "
    "s as (select lang, sum(u) / sum(n.n) as unk_ratio, sum(n.n) / sum(w.w) as tokens_per_word from documents join n using (doc_id) join w using (doc_id) group by lang) select lang, round(unk_ratio, 6) as unk_ratio, round(tokens_per_word, 6) as tokens_per_word, unk_ratio > 0.3 or tokens_per_word > 2.5 as unsafe from s"
)
def language_safety(spark, d):
    found = quality.language_safety(Kernel(spark, demo()), _texts(spark, d), ["lang"])
    return found.select("lang", F.round("unk_ratio", 6).alias("unk_ratio"), F.round("tokens_per_word", 6).alias("tokens_per_word"), "unsafe")


# ---- embed ------------------------------------------------------------------------------------------------------


def _cells(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.select(key, F.posexplode("vec").alias("dim", "x")).select(key, "dim", (F.round(F.col("x").cast("double"), 3) + 0.0).alias("value"))


def _embed_sql(kept: str, scale: str) -> str:
    sums = f"sums as (select t.doc_id, c.i, sum(c.x::double) as s, count(*) as n from toks t join cells c on c.token_id = t.id where {kept} group by t.doc_id, c.i)"
    return f"with {_PIECES}, {_MATRIX}, {sums}, z as (select *, sqrt(sum(s * s) over (partition by doc_id)) as l2 from sums), g as (select doc_id, i::int as i from documents, range(8) r(i)) select g.doc_id, g.i as dim, round(coalesce({scale}, 0), 3) + 0.0 as value from g left join z using (doc_id, i)"


@query(_embed_sql("t.pos <= 512 and t.id <> 1", "s / nullif(l2, 0)"))
def embed_documents(spark, d):
    return _cells(_texts(spark, d).select("doc_id", Kernel(spark, demo()).embed("text", kind="double").alias("vec")))


@query(_embed_sql("true", "s / n"))
def embed_include_unk(spark, d):
    kernel = Kernel(spark, demo().with_meta(max_tokens=0, unk_policy="include", normalization="none"))
    return _cells(_texts(spark, d).select("doc_id", kernel.embed("text", kind="double").alias("vec")))


@query(_embed_sql("t.pos <= 512 and t.id <> 1", "s / n"))
def embed_no_l2(spark, d):
    return _cells(_texts(spark, d).select("doc_id", Kernel(spark, demo().with_meta(normalization="none")).embed("text", kind="double").alias("vec")))


@query(_embed_sql("t.pos <= 512 and t.id <> 1", "s / nullif(l2, 0)").replace("from g left join z", "from g join z"))
def embed_token_ids(spark, d):
    """From ids, by joins and aggregations alone."""
    model = demo()
    ids = _texts(spark, d).select("doc_id", F.posexplode(Kernel(spark, model.with_meta(max_tokens=0)).tokenize("text")).alias("pos", "token_id"))
    return _cells(embed_relational(ids, model.matrix_frame(spark), model))


@query("select item_id, i::int as dim, 0.0::double as value from benchmark, range(8) r(i)")
def embed_empty_zero(spark, d):
    rows = _read(spark, d, "benchmark").select("item_id", Kernel(spark, demo()).embed(F.lit("")).alias("vec"))
    return _cells(rows, "item_id")


# ---- evaluation -------------------------------------------------------------------------------------------------


def _relevance(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Full rankings of labels' centroids by all vectors that have an id, and each vector's own label as relevant."""
    v = _vectors(spark, d)
    cells = v.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    docs = cells.groupBy(F.col("label").alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c.x).alias("vec"))
    asked = v.where("row_id is not null")
    ranking = search.top_k_batched(docs, asked.withColumnRenamed("row_id", "query_id"), None)
    return ranking, asked.select(F.col("row_id").alias("query_id"), F.col("label").alias("doc_id"))


_RANKING = f"""c as (select label, i, avg(x::double) as x from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by label, i),
docs as (select label as row_id, list(x order by i) as v from c group by label), q as (select vec_id as query_id, embedding as e, label from embeddings),
sc as (select query_id, row_id, q.label, {_DOT.format(a='q.e', b='docs.v')} / sqrt({_SQ.format(a='q.e')}) / sqrt({_SQ.format(a='docs.v')}) as score from q, docs),
ranking as (select *, row_number() over (partition by query_id order by score desc, row_id)::int as rank from sc)"""


@query(f"with {_RANKING} select query_id, rank, row_id from ranking")
def retrieval_ranks(spark, d):
    return _relevance(spark, d)[0].select("query_id", "rank", "row_id")


_M = "m as (select query_id, 1.0::double / rank as rr, case when rank <= 3 then 1.0::double / rank else 0 end as rr_at_k, case when rank <= 3 then 1 / log2(rank + 1) else 0 end as ndcg_at_k, (rank <= 3)::int::double as recall_at_k, (rank <= 3)::int::double as hit_at_k from ranking where row_id = label)"


@query(f"with {_RANKING}, {_M} select metric, round(value, 6) as value from (select avg(rr) as rr, avg(rr_at_k) as rr_at_k, avg(ndcg_at_k) as ndcg_at_k, avg(recall_at_k) as recall_at_k, avg(hit_at_k) as hit_at_k from m) unpivot (value for metric in (rr, rr_at_k, ndcg_at_k, recall_at_k, hit_at_k))")
def retrieval_metrics(spark, d):
    ranking, qrels = _relevance(spark, d)
    return evaluate.mean_metrics(evaluate.query_metrics(ranking, qrels, 3)).select("metric", F.round("value", 6).alias("value"))


@query(
    "with n as (select count(distinct label) as n from embeddings), e as (select n, least(n, 3) as k, (select sum(1.0::double / i) from range(1, 100000) r(i) where i <= n) / n as rr, (select sum(1.0::double / i) from range(1, 4) r(i) where i <= n) / n as rr_at_k, "
    "(select sum(1 / log2(i + 1)) from range(1, 4) r(i) where i <= n) / n as ndcg_at_k from n) select vec_id as query_id, round(rr, 6) as rr, round(rr_at_k, 6) as rr_at_k, round(ndcg_at_k, 6) as ndcg_at_k, round(k / n, 6) as recall_at_k, round(k / n, 6) as hit_at_k from embeddings, e"
)
def random_baseline(spark, d):
    qrels = _relevance(spark, d)[1]
    docs = _vectors(spark, d).select("label").distinct().count()
    return evaluate.random_baseline(qrels, docs, 3).select("query_id", *(F.round(m, 6).alias(m) for m in evaluate.METRICS))


@query()
def bootstrap_ci(spark, d):
    """Over all vectors that have an id."""
    ranking, qrels = _relevance(spark, d)
    return evaluate.bootstrap(evaluate.query_metrics(ranking, qrels, 3), 200)


@query("select count(*) as unknown from labels where doc_id not in (select doc_id from documents)")
def unknown_references(spark, d):
    found = evaluate.unknown_references(_read(spark, d, "labels").select("doc_id"), _read(spark, d, "documents"))
    return found.agg(F.count(F.lit(1)).alias("unknown"))


@query(
    _PAIR.format(where="vec_id % 100 = 0", score=_C)
    + f", a as (select query_id, row_id, row_number() over (partition by query_id order by score desc, row_id) as rank from s), t as (select query_id, vec_id as row_id, {_D} - vec_id % 7 as score from q, embeddings), b as (select query_id, row_id, row_number() over (partition by query_id order by score desc, row_id) as rank from t), "
    "f as (select query_id, row_id, sum(1.0::double / (60 + rank)) as score from (select * from a where rank <= 50 union all select * from b where rank <= 50) group by query_id, row_id), r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, row_id)::int as rank from f) select query_id, rank, row_id, round(score, 6) as score from r where rank <= 10"
)
def hybrid_rrf(spark, d):
    rows = _vectors(spark, d)
    asked = rows.where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id")
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))  # a file of one row group is one task
    dense = search.top_k_batched(rows, asked, 50)
    other = search.top_k_batched(rows.withColumn("vec", F.concat("vec", F.array(-(F.col("row_id") % 7).cast("float")))), asked.withColumn("vec", F.concat("vec", F.array(F.lit(1.0).cast("float")))), 50, "dot")
    return search.reciprocal_rank_fusion([dense, other], 10).select("query_id", "rank", "row_id", F.round("score", 6).alias("score"))


@query("select 1.0::double as min_cosine, 0.0::double as max_abs, count(*) as rows from documents")
def parity_min_cosine_max_abs(spark, d):
    """The kernel against joins and aggregations; both zero counts as equal."""
    model = demo()
    kernel = Kernel(spark, model)
    docs = _read(spark, d, "documents")
    ids = docs.select("doc_id", F.posexplode(Kernel(spark, model.with_meta(max_tokens=0)).tokenize("text")).alias("pos", "token_id"))
    other = embed_relational(ids, model.matrix_frame(spark), model).withColumnRenamed("vec", "b")
    zero = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.lit(0.0))
    both = docs.select("doc_id", kernel.embed("text").alias("a")).join(other, "doc_id", "left").withColumn("b", F.coalesce("b", zero))
    both = both.withColumn("cos", F.when((search.square(F.col("a")) == 0) & (search.square(F.col("b")) == 0), 1.0).otherwise(search.cosine(F.col("a"), F.col("b"))))
    diff = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y)))
    return both.agg(F.round(F.min("cos"), 4).alias("min_cosine"), (F.round(F.max(diff), 4) + 0.0).alias("max_abs"), F.count(F.lit(1)).alias("rows"))


@query("select count(*) as rows, count(*) as valid, 0::bigint as spoilt_valid from documents where text is not null and length(text) > 0")
def utf8_validity(spark, d):
    raw = _read(spark, d, "documents").where("length(text) > 0").select(F.encode("text", "utf-8").alias("b"))
    good = F.is_valid_utf8(F.col("b").cast("string"))
    spoilt = F.is_valid_utf8(F.concat(F.col("b"), F.unhex(F.lit("C3"))).cast("string"))
    return raw.agg(F.count(F.lit(1)).alias("rows"), F.sum(good.cast("long")).alias("valid"), F.sum(spoilt.cast("long")).alias("spoilt_valid"))


@query("with s as (select item_id as i, item_id * 100 as a, item_id * 100 + length(text) as b from benchmark) select x.i as first, y.i as second from s x join s y on x.i < y.i and x.a < y.b and y.a < x.b")
def section_overlap(spark, d):
    """Pairs of sections that overlap; a section is compared with those that begin in its own and the next blocks."""
    s = _read(spark, d, "benchmark").select(F.col("item_id").alias("i"), (F.col("item_id") * 100).alias("a"), (F.col("item_id") * 100 + F.char_length("text")).alias("b"))
    wide = 4096
    x = s.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / wide), F.floor((F.col("b") - 1) / wide)))).where("a < b").alias("x")
    y = s.withColumn("block", F.floor(F.col("a") / wide)).where("a < b").alias("y")
    hit = x.join(y, "block").where("x.i <> y.i and y.a >= x.a and y.a < x.b")
    return hit.select(F.least("x.i", "y.i").alias("first"), F.greatest("x.i", "y.i").alias("second")).distinct()


@query("with p as (select distinct doc_id from labels), g as (select doc_id, doc_id - row_number() over (order by doc_id) as island from p) select min(doc_id) as lo, max(doc_id) as hi from g group by island")
def range_coalesce(spark, d):
    return coalesce_ranges(_read(spark, d, "labels"), "doc_id")
