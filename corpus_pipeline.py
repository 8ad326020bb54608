"""A pipeline over documents: language ID, exact dedup, near dedup, mixing and tokens, each stage written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, exact_dedup, langid, mixing, ngram_join
from weftline.llm.common import fresh, id_remainder, quoted, shared_dir, spread, table
from weftline.llm.queries import TOKENIZER

#: Below this probability no language is believed.
LEAST_SCORE = 0.4

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: What the contracts delete before comparing texts.
SPACE = " \t\n\x0b\f\r"


def _columns(docs: DataFrame) -> list[str]:
    return [quoted(c) for c in docs.columns]


def _id() -> Column:
    """doc_id as text, null too, so that rows join by a plain key."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows.  Null, empty and letterless texts go.

    The model learns from labelled rows of docs as op4 does; without any
    labels it knows no language, and then only texts without letters go.  Each
    row is judged by itself and its whole text, so repeated rows stay or go
    together; an empty table stays empty; other columns pass untouched,
    whatever they are called.
    """
    learn = docs.where(id_remainder("doc_id", 5) != 0)
    model = langid.fit_languages(learn)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    label, score = fresh(docs, "lang_pred", "score")
    judged = langid.predict_languages(docs, model, label, score)
    return judged.where((F.col(label) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*_columns(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest, then the one of smallest id, null ids last.

    All null, empty and blank texts are one group.  Of rows that repeat an id
    and such a text one stays: the longest, then the last in order of texts.
    Whole texts are compared; an empty table stays empty; other columns pass
    untouched, whatever they are called.  Rows travel by id and digest, so a
    text that countless rows share is no hot key.
    """
    one, sha, row = fresh(docs, "id", "sha", "row")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct(*_columns(docs)).alias(row), _id().alias(one), F.sha2(F.translate(text, SPACE, ""), 256).alias(sha), F.struct(F.length(text), text).alias("best"))
    each = keyed.groupBy(one, sha).agg(F.max_by(row, "best").alias(row))
    kept = exact_dedup.exact_dedup(docs).where("kept").select(_id().alias(one), F.col("text_sha256").alias(sha))
    return each.join(kept, [one, sha], "left_semi").select(f"{row}.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of Jaccard similarity 0.8, the one of smallest id; all whose set is empty.

    Null ids come last, ties by the text's digest.  Null and blank texts have
    empty sets and stay.  Rows equal in id and text stay or go together;
    drop_copies has left one of each.  Whole texts count; an empty table stays
    empty; other columns pass untouched, whatever they are called.
    """
    one, digest = fresh(docs, "id", "digest")
    kept = ngram_join.survivors(docs).select(_id().alias(one), F.col("digest").alias(digest))
    found = docs.withColumns({one: _id(), digest: ngram_join.text_digest()})
    return found.join(kept, [one, digest], "left_semi").select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source to the same share of the bytes, in shuffled order.

    A null source is a source of its own; a null or empty text has no bytes,
    and a source without bytes goes.  Rows with equal ids get equally many
    copies.  An empty table stays empty; other columns pass untouched, whatever
    they are called.
    """
    names = fresh(docs, "copy", "n_copies", "shuffle_key")
    mixed = mixing.mix_sources(docs, size=F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), names=tuple(names))
    return mixed.select(*_columns(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each copy.

    A null or empty text has no tokens; long ones are encoded whole; repeated
    rows come out each; an empty table gives an empty one.  Other columns play
    no part.
    """
    encoded = bpe.encode_documents(docs.select("doc_id", "text"), TOKENIZER)
    return encoded.select("doc_id", *bpe.token_digest(encoded))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("tokens", tokenize),
]

#: Classifier, near-duplicate components and tokens are beyond SQL; tests hold the pipeline against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each result written to the shared folder and read as the next one's docs."""
    docs = spread(table(spark, sf_dir, "documents"))
    for _, stage in STAGES:
        at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
