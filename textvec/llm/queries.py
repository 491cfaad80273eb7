"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textvec.llm.jaccard_join import jaccard_join

    return jaccard_join(_read(spark, sf_dir, "documents"), 3, 90, 100)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textvec.llm.line_dedup import line_dedup

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("bigint").alias("kept_chars"))


def tokenizer_json(name: str) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textvec.llm.lexicon_codec import bpe_codec

    return bpe_codec(_read(spark, sf_dir, "documents"), tokenizer_json("byte_bpe_50k.json"), keep_ids=False)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textvec.llm.packing import packing

    return packing(_read(spark, sf_dir, "documents"), tokenizer_json("word_bpe_49k.json"), 2048, 1)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textvec.llm.block_topk import exact_topk

    rows = _read(spark, sf_dir, "embeddings")
    return exact_topk(rows, rows.where("vec_id % 100 = 0"), 10)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textvec.llm.language_id import language_id

    return language_id(_read(spark, sf_dir, "documents"))


def op10_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textvec.llm.graph_ann import nearest

    rows = _read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), 20)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textvec.llm.license_scan import license_scan

    return license_scan(_read(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textvec.llm.html_wrapper import html_extract

    return html_extract(_read(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load of all documents, delivered twice, of which the second changes nothing; then all documents are deleted and
    inserted again, in one batch that deletes and one that revises nothing into them."""
    import uuid

    from textvec.llm.shared import scratch, stash
    from textvec.llm.token_ledger import Ledger, count_tokens, negated

    ledger = Ledger(spark, f"{scratch(spark)}/ledger-{uuid.uuid4().hex}")
    load = stash(count_tokens(_read(spark, sf_dir, "documents"), {"word-bpe-49k": tokenizer_json("word_bpe_49k.json")}), "counts")
    for name, change in (("load", load), ("load", load), ("delete", negated(load)), ("restore", load)):
        ledger.commit(name, change)
    return ledger.totals()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_license_scan": op3_license_scan,
    "op4_html_extraction": op4_html_extraction,
    "op6_token_counts": op6_token_counts,
    "op2_exact_topk": op2_exact_topk,
    "op8_language_id": op8_language_id,
    "op10_graph_ann": op10_graph_ann,
    "op7_bpe_codec": op7_bpe_codec,
    "op9_packing": op9_packing,
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op5_line_dedup": op5_line_dedup,
}

SQL: dict[str, str] = {}

SQL["op5_line_dedup"] = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents
), k as (select doc_id, pos, line, lower(trim(line, ' ')) as key from l),
f as (
  select key, row_number() over (order by doc_id, pos) as rk, length(key) as n from (
    select key, doc_id, pos, row_number() over (partition by key order by doc_id, pos) as o from k where length(key) >= 20) where o = 1
), e as (select *, left(key, 16) as a, right(key, 16) as b from f where n >= 32),
c as (select x.rk as xr, y.rk as yr, x.key as xk, y.key as yk from e x join e y on x.a = y.a and x.rk < y.rk and abs(x.n - y.n) <= 1
  union select x.rk, y.rk, x.key, y.key from e x join e y on x.b = y.b and x.rk < y.rk and abs(x.n - y.n) <= 1),
near as (select distinct yk as key from c where levenshtein(xk, yk) <= 1),
firsts as (select key, min(doc_id * 1000000 + pos) as at from k where length(key) >= 20 and key not in (select key from near) group by key),
d as (
  select k.doc_id, k.pos, k.line, length(k.key) < 20 or firsts.at is not null as keep
  from k left join firsts on k.key = firsts.key and firsts.at = k.doc_id * 1000000 + k.pos
)
select documents.doc_id, coalesce(count(d.pos), 0) as n_lines, coalesce(sum(case when d.keep then 0 else 1 end) filter (where d.pos is not null), 0)::bigint as n_dropped,
  case when any_value(text) is null then null else coalesce(sum(length(line)) filter (where keep), 0) + greatest(coalesce(count(*) filter (where keep), 0) - 1, 0) end::bigint as kept_chars
from documents left join d using (doc_id) group by documents.doc_id
"""

SQL["op2_exact_topk"] = """
with v as (
  select vec_id, embedding, [floor(1024 * x::double)::bigint for x in embedding] as w from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x::double)]) = 0
), q as (select vec_id, arg_min(w, embedding) as w from v where vec_id % 100 = 0 group by vec_id),
s as (select q.vec_id as query_id, v.vec_id, coalesce(list_sum([a[1] * a[2] for a in [[p[1], p[2]] for p in list_zip(q.w, v.w)]])::bigint, 0) as score from q join v on q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def _license_sql() -> str:
    from textvec.llm.license_scan import FULL, TEMPLATES

    rows = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in (TEMPLATES | FULL).items())
    return f"""
with t(name, text) as (values {rows}),
u as (
  select 't' as kind, 0::bigint as doc_id, 0::bigint as line, name, text from t
  union all select 'd', doc_id, 0, '', text from documents
  union all select 'd', doc_id, l.line, '', l.unit from documents, lateral (select unnest(string_split(text, chr(10))) as unit, generate_subscripts(string_split(text, chr(10)), 1)::bigint as line) l where contains(text, chr(10))
), w as (select kind, doc_id, line, name, [x for x in string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' ') if x <> ''] as w from u where text is not null),
b as (select kind, doc_id, line, name, list_distinct([p[1] || ' ' || p[2] for p in list_zip(w[:-2], w[2:])]) as b from w where len(w) > 1),
d as (select doc_id, line, unnest(b) as g, len(b) as n from b where kind = 'd' and len(b) <= 400),
p as (select name, unnest(b) as g, len(b) as n from b where kind = 't'),
s as (select doc_id, line, p.name, 2.0::double * count(*) / (any_value(d.n) + any_value(p.n)) as dice from d join p using (g) group by doc_id, line, p.name),
r as (select *, row_number() over (partition by doc_id order by dice desc, line, name) as k from s where dice >= 0.8)
select documents.doc_id, r.name as license, coalesce(round(r.dice, 6), 0.0)::double as dice, coalesce(r.line, -1)::bigint as line
from documents left join (select * from r where k = 1) r using (doc_id)
"""


SQL["op3_license_scan"] = _license_sql()
