"""Named queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ghgspark.llm.bpe import encode_decode
from ghgspark.llm.common import read_table
from ghgspark.llm.fingerprints import edited_fingerprints
from ghgspark.llm.hardneg import mine
from ghgspark.llm.html import extract
from ghgspark.llm.lexical import search
from ghgspark.llm.licenses import scan_licenses
from ghgspark.llm.neardup import near_duplicates
from ghgspark.llm.packing import pack_documents
from ghgspark.llm.quality import held_out, score_quality, train
from ghgspark.llm.secrets import scan_secrets
from ghgspark.llm.sharding import shard_records
from ghgspark.llm.suffixes import remove_repeats
from ghgspark.llm.topk import top_k

SHARDS = 24


def tokenizer(name: str) -> str:
    """A vocabulary file, below TOKENIZERS_DIR if that is set; executors need it at the same place."""
    folder = os.environ.get("TOKENIZERS_DIR")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_i_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(read_table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op5_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, read_table(spark, sf_dir, "labels"))
    return score_quality(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(
        read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op8_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=2)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(documents, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


LLM_QUERIES = {
    f.__name__: f for f in (op1_best_fit_packing, op2_i_match, op3_license_scan, op4_rendezvous_shards, op5_passage_quality,
                              op6_byte_bpe, op7_secret_scan, op8_hyperminhash_dedup, op9_exact_top_k,
                              op10_suffix_dedup, op11_html_extraction, op12_hard_negatives, op13_lexical_search)
}
LLM_ORACLES = {
    "op12_hard_negatives": """
        with v as (
            select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
                   list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select a.vec_id as anchor_id, a.label as anchor_label, c.vec_id as id, c.label as label,
                   cast(list_inner_product(a.e, c.e) as bigint) as score
            from v a join v c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id and len(c.e) = len(a.e)),
        p as (
            select anchor_id, id as positive_id, score as positive_score
            from (select *, row_number() over (partition by anchor_id order by score desc, id) as r
                  from s where label = anchor_label)
            where r <= 5),
        n as (
            select p.anchor_id, p.positive_id, s.id as negative_id, p.positive_score, s.score as negative_score,
                   row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) as rank
            from p join s on s.anchor_id = p.anchor_id and s.label <> s.anchor_label
              and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score)
        select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
        from n where rank <= 10""",
    "op13_lexical_search": """
        with d as (
            select row_number() over () as r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as t
            from documents),
        c as (select count(*) filter (where len(t) > 0) as big_n, sum(len(t)) as big_l from d),
        p as (select r, doc_id, cast(len(t) as bigint) as n, unnest(t) as term from d where len(t) > 0),
        f as (select r, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*) as tf from p group by r, term),
        w as (
            select term, cast(floor(1000 * ln((2.0 * big_n + 2) / (2.0 * count(*) + 1))) as bigint) as w
            from f, c group by term, big_n),
        q as (
            select distinct item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
            from benchmark),
        s as (
            select q.item_id, f.r, f.doc_id,
                   sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * f.n * c.big_n) // c.big_l)))) as score
            from q join w on q.term = w.term join f on f.term = q.term, c
            where f.doc_id is not null
            group by q.item_id, f.r, f.doc_id),
        k as (
            select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
            from s where score > 0)
        select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from k where rank <= 10""",
    "op8_hyperminhash_dedup": """
        with recursive d as (
            select doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w
            from documents),
        e as (
            select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
                else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
            from d),
        sets as (select min(doc_id) as id, list_sort(s) as s from e where len(s) > 0 group by list_sort(s)),
        t as (select id, len(s) as n, unnest(s) as x from sets),
        p as (
            select a.id as u, b.id as v, any_value(a.n) as an, any_value(b.n) as bn, count(*) as c
            from t a join t b on a.x = b.x and a.id < b.id and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n
            group by a.id, b.id),
        l as (select u, v from p where 100 * c >= 80 * (an + bn - c)),
        around as (select u, v from l union all select v, u from l),
        r as (select id as u, id as v from sets union select r.u, around.v from r join around on r.v = around.u),
        m as (select u, min(v) as c from r group by u)
        select e.doc_id, cast(len(e.s) as bigint) as n_shingles, coalesce(m.c, e.doc_id) as component_id,
               coalesce(m.c, e.doc_id) = e.doc_id as kept
        from e left join sets on len(e.s) > 0 and list_sort(e.s) = sets.s left join m on m.u = sets.id""",
    "op10_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        c as (
            select doc_id, 1000 * c as base, substr(h, 2000 * c + 1, 2098) as h
            from (select doc_id, h, unnest(range(0, length(h) // 2000 + 1)) as c from d)),
        w as (
            select doc_id, base + p as p, substr(h, 2 * p + 1, 100) as s
            from (select doc_id, base, h, unnest(range(0, least(1000, greatest(length(h) // 2 - 49, 0)))) as p from c)),
        m as (select s, min(doc_id) as first from w group by s having min(doc_id) < max(doc_id)),
        r as (select distinct w.doc_id, w.p from w join m on w.s = m.s where w.doc_id > m.first),
        i as (
            select doc_id, p, sum(fresh) over (partition by doc_id order by p) as island
            from (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as fresh
                  from r)),
        s as (select doc_id, island, min(p) as a, max(p) + 50 as b from i group by doc_id, island),
        k as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from s),
        g as (
            select k.doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last,
                   string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as head
            from k join d on k.doc_id = d.doc_id group by k.doc_id)
        select d.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
               cast(coalesce(n_spans, 0) as bigint) as n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
        from d left join g on d.doc_id = g.doc_id""",
    "op9_exact_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as double)) as e
            from embeddings
            where vec_id is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
            from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
        r as (
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
                   vec_id, score
            from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
}
