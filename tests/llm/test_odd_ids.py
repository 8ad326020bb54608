"""Near copies whose ids are null or repeat."""

import random

import corpus_pipeline
from test_ten import DOCS, brute_components, families, tuples  # same folder
from weftline.llm import ngram_join


def near(word, changed=()):
    return " ".join(f"x{i}" if i in changed else f"{word}{i}" for i in range(40))


def test_rows_with_null_ids_bridge(spark):
    rows = [(7, near("a", [0, 1, 2])), (None, near("a")), (3, near("a", [37, 38, 39])), (None, near("b")), (None, near("b", [0]))]
    rows += [(r.choice([None, i, i // 4]), t) for r in [random.Random(5)] for i, t in families(5, 10, 40)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert tuples(got) == brute_components(rows)


def test_one_row_of_each_component_stays(spark):
    texts = [
        (None, near("a")), (None, near("a", [0])), (None, near("b")),  # without ids
        (5, near("c")), (5, near("c", [0])), (6, near("c", [39])),  # one id twice
        (5, near("d")), (None, near("d", [0])), (None, ""), (None, None),
    ]
    names = [f.split()[0] for f in DOCS.split(",")]
    df = spark.createDataFrame([tuple({"doc_id": i, "text": t}.get(n) for n in names) for i, t in texts], DOCS)
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    families_of = [next((w for w in "abcd" if f"{w}20" in (t or "")), t) for _, t in out]
    assert sorted(families_of, key=repr) == sorted(["a", "b", "c", "d", "", None], key=repr)
    assert {i for (i, _), f in zip(out, families_of, strict=True) if f in ("c", "d")} == {5}
