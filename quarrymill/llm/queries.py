"""The training-data queries of __spark_entry__: thin callers of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format, conversation_repair, fingerprints, jaccard_join, lm_scoring, mixing, quality, sentencepiece_codec, substring_dedup, token_counts,
    vector_topk, warc, whitening,
)
from .common import scratch_path, table
from .conversation_sql import SQL_OP11, SQL_OP12


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus's tokens as budget; no source more than 4 times."""
    return mixing.mix(table(spark, sf_dir, "documents"), max_repetition=4.0)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), size=3, threshold="0.9")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = scratch_path(spark, "token-cache")  # starts empty, so the whole cost is in the query
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), cache)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), columns)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_digests(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_control_turns(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_conversations(rows))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired_digests(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


SQL_OP1 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as ints from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.ints, c.ints) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.ints) = len(q.ints) where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""

SQL_OP10 = r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from t)),
m as (select k, min(doc_id) as d from w group by k),
s as (select distinct w.doc_id, w.i + j as i from w join m using (k), range(0, 13) g(j) where m.d < w.doc_id),
p as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as i from t),
k as (select p.doc_id, string_agg(p.x, ' ' order by p.i) as kept, count(*) as n from p anti join s on p.doc_id = s.doc_id and p.i = s.i group by p.doc_id)
select t.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from t left join k using (doc_id)
"""

SQL_OP3 = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (
  select distinct doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 2], ' ') end as k
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from t where len(ws) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from g a join g b on a.k = b.k and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as (select x, y, c from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
r as (select x as doc_id, x as y from l union select r.doc_id, l.y from r join l on l.x = r.y),
m as (select doc_id, min(y) as component_id from r group by doc_id),
k as (select x as doc_id, count(*) as n_links from l group by x)
select t.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(m.component_id, t.doc_id) as component_id, cast(coalesce(k.n_links, 0) as bigint) as n_links
from t left join n using (doc_id) left join m using (doc_id) left join k using (doc_id)
"""

SQL_OP7 = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (
  select page_id, octet_length(encode(h)) as payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j:
        (16 >> j) * cast(substr(cast(cast(unhex(sha1(h)) as bit) as varchar), cast(i * 5 + j + 1 as bigint), 1) as integer)))::bigint, 1)), 'string_agg', '') as payload_digest
  from p),
f as (select payload_digest, min(page_id) as first_page from d group by payload_digest)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when page_id = first_page or first_page is null then 'response' else 'revisit' end as record_type,
  case when page_id = first_page or first_page is null then null else first_page end as refers_to
from d join f using (payload_digest)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op4_token_counts": op4_token_counts,
        "op5_sentencepiece": op5_sentencepiece,
        "op7_warc": op7_warc,
        "op6_fingerprints": op6_fingerprints,
        "op8_quality": op8_quality,
        "op2_mixing": op2_mixing,
        "op3_jaccard_join": op3_jaccard_join,
        "op9_lm_scoring": op9_lm_scoring,
        "op1_vector_topk": op1_vector_topk,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_chat_format": op11_chat_format,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_vector_topk": SQL_OP1, "op3_jaccard_join": SQL_OP3, "op7_warc": SQL_OP7, "op10_substring_dedup": SQL_OP10, "op11_chat_format": SQL_OP11, "op12_conversation_repair": SQL_OP12}
