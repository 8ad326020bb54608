"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, fan_out, fresh, quoted, without

#: Poisson means are split into equal parts of this size at most, whose counts add up.
PIECE = 16.0
#: Terms of the distribution that are summed: beyond them nothing is left in a double for means up to PIECE.
TERMS = 100
#: Copies of a row that one step makes.
RANGE = 1024
#: The table of rates is broadcast if it takes no more.
FEW_BYTES = 8 << 20


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) with 52 bits from the keys' hash; null is a key of its own."""
    text = F.concat_ws(":", *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_steps(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... for a Poisson variable of this mean (PIECE at most)."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("out"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.concat(a["out"], F.array(a["c"] + p)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["out"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, source_col: str = "source", size: Column | None = None) -> DataFrame:
    """source and rate: for each source the mean number of copies that brings its share of the size to its weight.

    weights: relative targets of sources, others get 0; None: every source of
    the table gets the same.  size: of a row, 1 by default.  The whole gets
    epochs times the size of the table.  A source without size gets rate 0.
    """
    sized = docs.select(F.col(quoted(source_col)).alias("source"), (F.lit(1).cast("long") if size is None else size).alias("size"))
    per = sized.groupBy("source").agg(F.sum("size").cast("double").alias("has"))
    weight = F.lit(1.0)
    if weights is not None:
        pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(pairs[F.col("source")], F.lit(0.0))
    per = cut(per.withColumn("weight", weight))
    whole, weighed = (float(x or 0) for x in per.agg(F.sum("has"), F.sum("weight")).first())  # two numbers
    rate = F.try_divide(F.col("weight") * F.lit(whole) * F.lit(float(epochs)), F.lit(weighed) * F.col("has"))
    return per.select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
    ordered: bool = True, most_rate: float = 1e6, names: tuple[str, str, str] = ("copy", "n_copies", "shuffle_key"),
) -> DataFrame:
    """docs repeated so that sources come to their target weights in expectation, globally shuffled.

    Each row is copied as often as a Poisson variable of its source's rate
    says, by inverting the distribution at a hash of seed and id: the same row
    gets the same copies wherever and whenever it is read.  Means over 16 are
    sums of smaller ones with hashes of their own.  Copies are exploded in
    ranges of RANGE, which other tasks take over where a rate is larger, and
    ordered by another hash (shuffle key, then id and copy), a
    range-partitioned sort.  Only per-source sums meet in one place; rates of
    few sources, counted, are broadcast, and rows do not move for them.

    A source that would need a rate over most_rate raises a ValueError: a few
    bytes cannot be brought to a share of terabytes, so give it a weight.

    A null source is a source of its own and null ids share one hash.  Rows
    with the same id get the same number of copies.  Texts play a part by their
    size alone.  An empty table stays empty.  The columns called names replace
    any of those; others may have any name.
    """
    columns = without(docs, *names)
    docs = docs.select(*map(quoted, columns))
    own, rate, pieces, steps, of = fresh(docs, "source", "rate", "pieces", "steps", "of")
    copy, total, key = map(quoted, names)
    rates = source_rates(docs, weights, epochs, source_col, size).select(F.col("source").alias(own), F.col("rate").alias(rate))
    n, chars, top = rates.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(own).cast("string"))), F.lit(0)), F.coalesce(F.max(rate), F.lit(0.0))).first()
    if top > most_rate:
        raise ValueError(f"a source needs {top:.3g} copies of each row, more than most_rate={most_rate:.3g}: give weights")
    rates = rates.withColumn(pieces, F.greatest(F.lit(1), F.ceil(F.col(rate) / PIECE)).cast("long"))
    rates = rates.withColumn(steps, poisson_steps(F.col(rate) / F.col(pieces)))
    if n * (TERMS + 8) * 8 + chars <= FEW_BYTES:
        rates = F.broadcast(rates)
    # Each hash is a lambda's variable, and so is the count: they are evaluated once a row.
    hashes = F.transform(F.sequence(F.lit(1).cast("long"), F.col(pieces)), lambda j: uniform(F.lit(seed), F.col(quoted(id_col)), j))
    count = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, u: a + F.size(F.filter(steps, lambda c: c <= u)))
    first = lambda n: F.sequence(F.lit(0).cast("long"), n - 1, F.lit(RANGE).cast("long"))
    ranges = F.element_at(F.transform(F.array(count), lambda n: F.when(n > 0, F.transform(first(n), lambda i: F.struct(i.alias("i"), n.alias("n"))))), 1)
    out = docs.join(rates, docs[quoted(source_col)].eqNullSafe(rates[own])).select(*map(quoted, columns), F.explode(ranges).alias(of))
    if top > RANGE:
        out = out.repartition(fan_out(docs.sparkSession), quoted(id_col), F.col(of)["i"])
    last = F.least(F.col(of)["n"], F.col(of)["i"] + RANGE) - 1
    out = out.select(*map(quoted, columns), F.col(of)["n"].alias(names[1]), F.explode(F.sequence(F.col(of)["i"], last)).alias(names[0]))
    text = F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("null")), F.col(copy).cast("string"))
    out = out.select(*map(quoted, columns), copy, total, F.md5(text).alias(names[2]))
    return out.orderBy(key, quoted(id_col), copy) if ordered else out
