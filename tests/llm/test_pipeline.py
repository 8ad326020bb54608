"""The pipeline's stages, each on its own input, and queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_ten import DOCS, NAMES, ODD, brute_components, brute_copies, brute_exact  # same folder
from weftline.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    rows = {name: None for name, _ in corpus_pipeline.STAGES}
    given = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, SMALL)
        out = spark.createDataFrame(out.collect(), out.schema)
        rows[name] = (given, out)
        given = out
    kept = {r["doc_id"] for r in rows["language"][1].collect()}
    clean = {r["doc_id"] for r in docs.where("lang is not null").collect()}
    assert len(kept & clean) >= 0.98 * len(clean)
    before = [(r["doc_id"], r["text"]) for r in rows["exact dedup"][0].collect()]
    assert {r["doc_id"] for r in rows["exact dedup"][1].collect()} == {r[0] for r in brute_exact(before) if r[3]}
    before = [(r["doc_id"], r["text"]) for r in rows["near dedup"][0].collect()]
    assert {r["doc_id"] for r in rows["near dedup"][1].collect()} == {i for i, n, c in brute_components(before) if not n or c == i}
    before = rows["mixing"][0].collect()
    size = {}
    for r in before:
        size[r["source"]] = size.get(r["source"], 0) + len((r["text"] or "").encode())
    rate = {s: sum(size.values()) / (len(size) * size[s]) for s in size}
    want = sorted(i for r in before for i in [r["doc_id"]] * brute_copies(rate[r["source"]], 7, r["doc_id"]))
    assert sorted(r["doc_id"] for r in rows["mixing"][1].collect()) == want
    assert all(rows[n][1].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    assert sorted(r["doc_id"] for r in rows["tokens"][1].collect()) == want


def test_stages_on_odd_and_empty_tables(spark):
    for given in (spark.createDataFrame(ODD, DOCS).withColumn("extra", F.lit(1)).withColumn("kept", F.lit("x")), spark.createDataFrame([], DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SMALL)
            copies = name == "mixing" and not given.isEmpty()  # a source of a few bytes is repeated until it has its share
            assert copies or out.count() <= given.count()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        duck.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SMALL)
    want = duck.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    order = [got.columns.index(c) for c in names]
    assert sorted((tuple(r[i] for i in order) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_all_eleven_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [n for i in range(1, 11) for n in names if n.startswith(f"op{i}_")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert "pipeline" in names


def test_stages_leave_other_columns_alone(spark):
    given = spark.createDataFrame(ODD, DOCS).select("*", *(F.lit(f"mine-{x}").alias(x) for x in NAMES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, SMALL)
        assert out.columns == given.columns, name
        assert out.select(*NAMES).distinct().count() == (0 if out.isEmpty() else 1)
        assert out.isEmpty() or out.select(*NAMES).first() == given.select(*NAMES).first()
    assert corpus_pipeline.tokenize(spark, given, SMALL).count() == len(ODD)


def test_one_of_rows_that_repeat_id_and_text_stays(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "ab"), (None, "c"), (None, "c"), (None, "c d"), (2, None), (3, ""), (4, "cd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, corpus_pipeline.drop_copies(spark, df, "").collect()), key=repr)
    assert got == sorted([(1, "a  b"), (None, "c"), (2, None), (None, "c d")], key=repr)
