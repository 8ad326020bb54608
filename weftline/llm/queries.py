"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, exact_dedup, langid, mixing, ngram_join, quality, secrets, sharding, suffix_dedup, topk
from weftline.llm.common import cut, id_remainder, spread, table

#: Where the tokenizer's file is, on the driver.
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))

#: A passage that op10 reports has more words.
PASSAGE_WORDS = 50

Query = Callable[[SparkSession, str], DataFrame]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for each vector whose id is divisible by 100; odd rows as exact_topk states."""
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of secrets in every text; odd rows as find_secrets states."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = secrets.train(secrets.labelled_samples(docs))
    return secrets.secret_report(secrets.find_secrets(docs, model))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set, and its component; odd rows as jaccard_components states."""
    return ngram_join.jaccard_components(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document.  A null id is held out; other odd rows as predict_languages states."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "text", "lang", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"))
    model = langid.fit_languages(docs.where("not held_out"))
    return langid.predict_languages(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document.  A null id is held out; other odd rows as score_quality states."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(True)).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where("quality is not null")
    net = quality.fit_quality(docs.where("not held_out").join(labels, "doc_id"))
    return quality.score_quality(docs, net).select("doc_id", "held_out", "score", "predicted")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law rows: equal texts are spread like any other rows, whatever their number; a null text has size 1.

    Sizes and checksums are computed once, into a table in the shared folder.
    """
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.crc32(F.lit("").cast("binary"))).alias("text_crc32"))
    out = sharding.shuffle_into_shards(cut(docs))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source to the same share of the bytes of all texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    return mixing.mix_sources(docs, size=F.col("size")).select("doc_id", "source", "copy", "n_copies", "shuffle_key")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document; odd rows as exact_dedup states."""
    return exact_dedup.exact_dedup(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded text of every document; odd rows as encode_documents states."""
    encoded = bpe.encode_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), TOKENIZER)
    return encoded.select("doc_id", *bpe.token_digest(encoded))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and the text that is left; odd rows as repeated_spans states.

    Beyond the columns of the digest: repeats, whether anything is removed;
    spans, the removed runs as start:end in bytes, joined by commas; text, what
    is left, where bytes of a character that was cut become U+FFFD.  And
    n_passages and passages: the runs of over PASSAGE_WORDS words that occur
    again, of whatever length in bytes.  Those under 400 bytes stay in the text.
    """
    found = suffix_dedup.repeated_spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), words=PASSAGE_WORDS + 1)
    listed, passages = (F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",") for c in ("spans", "passages"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select("doc_id", *suffix_dedup.removal_digest(), (F.size("spans") > 0).alias("repeats"), listed.alias("spans"), text.alias("text"), F.size("passages").cast("long").alias("n_passages"), passages.alias("passages"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_topk, op2_secrets, op3_ngram_join, op4_langid, op5_sharding, op6_quality, op7_mixing, op8_exact_dedup, op9_bpe, op10_suffix_dedup)}

SQL: dict[str, str] = {
    "op1_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as c from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, r.vec_id, list_inner_product(q.c, r.c)::bigint as score
            from v q join v r on q.vec_id <> r.vec_id where q.vec_id % 100 = 0
        )
        select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score
        from s qualify rank <= 10""",
    "op3_ngram_join": r"""
        with recursive words as materialized (
            select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
        ), shingle as (
            select distinct r, array_to_string(w[i : i + 4], ' ') as s from (select r, w, unnest(range(1, greatest(2, len(w) - 3))) as i from words where len(w) > 0)
        ), size as (select r, count(*) as n from shingle group by r),
        pair as (select x.r as a, y.r as b, count(*) as c from shingle x join shingle y on x.s = y.s and x.r < y.r group by all),
        link as (select a, b from pair join size x on x.r = a join size y on y.r = b where 100 * c >= 80 * (x.n + y.n - c)),
        edge as (select a, b from link union all select b, a from link),
        reach as (select a, b from edge union select reach.a, edge.b from reach join edge on reach.b = edge.a)
        select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, (select min(d.doc_id) from reach join words d on d.r = reach.b where reach.a = words.r)) as component_id
        from words left join size using (r)""",
    "op7_mixing": """
        with recursive per as (
            select source, sum(coalesce(strlen(text), 0))::double as has from documents group by source
        ), whole as (select sum(has) as a, count(*)::double as w from per),
        rate as (select source, case when has > 0 then (1.0::double * a * 1.0::double) / (w * has) else 0 end as r from per, whole),
        piece as (select source, greatest(1, ceil(r / 16)::bigint) as m, r / greatest(1, ceil(r / 16)::bigint) as mean from rate),
        steps as (
            select source, m, mean, 0 as k, exp(-mean) as p, exp(-mean) as c from piece
            union all
            select source, m, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from steps where k < 100
        ), pieces as (
            select d.doc_id, d.source, j, (('0x' || substr(md5('7:' || coalesce(d.doc_id::varchar, 'null') || ':' || j), 1, 13))::bigint)::double / 4503599627370496.0::double as u
            from documents d join piece p on d.source is not distinct from p.source, lateral (select unnest(range(1, m + 1)) as j)
        ), n as (
            select p.doc_id, p.source, (select count(*) from steps s where s.source is not distinct from p.source and s.c <= p.u) as k from pieces p
        ), counts as (select doc_id, source, sum(k)::bigint as n_copies from n group by all)
        select doc_id, source, copy::bigint as copy, n_copies, md5('7:order:' || coalesce(doc_id::varchar, 'null') || ':' || copy) as shuffle_key
        from counts, lateral (select unnest(range(0, n_copies)) as copy)""",
    "op8_exact_dedup": r"""
        with d as (
            select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents
        )
        select doc_id, first_value(doc_id) over (partition by t order by points desc, doc_id) as keep_id,
            count(*) over (partition by t) as group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
        from d""",
}
