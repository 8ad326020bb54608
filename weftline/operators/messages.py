"""Operators on message streams.

Rows have no order of their own, so those that need one take order_by, unique
within a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_key(df: DataFrame, key: str, column: str = "key") -> DataFrame:
    return df.where(F.col(column) == key)


def set_key(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("key", F.lit(key))


def fan_in(*streams: DataFrame) -> DataFrame:
    """All messages of all publishers; order holds within a publisher only."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def gate(messages: DataFrame, controls: DataFrame, order_by: str, keys: Sequence[str] = (), start_open: bool = False) -> DataFrame:
    """Messages that pass: those whose last control before them said open, or start_open without one.

    messages and controls (keys, order_by, open) share an order; at equal
    places the control comes first.
    """
    marked = messages.select("*", F.lit(None).cast("boolean").alias("_open"), F.lit(1).alias("_side"))
    turns = controls.select(*keys, order_by, F.col("open").alias("_open"), F.lit(0).alias("_side"))
    both = marked.unionByName(turns, allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy(order_by, "_side")
    now = F.coalesce(F.last("_open", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(start_open))
    return both.withColumn("_now", now).where((F.col("_side") == 1) & F.col("_now")).select(messages.columns)


def gate_first(messages: DataFrame, n: int, order_by: str, keys: Sequence[str] = ()) -> DataFrame:
    """A gate that starts open and reverts to closed after n messages, without controls."""
    return messages.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order_by))).where(F.col("_n") <= n).drop("_n")


class GateState:
    """open, and messages handled since it last changed.  Messages count while it is closed, too."""

    def __init__(self, start_open: bool, default_open: bool, default_after: int | None):
        self.open, self.default_open, self.default_after, self.handled = start_open, default_open, default_after, 0

    def turn(self, open_: bool) -> None:
        """A control equal to the state leaves the count alone."""
        if self.open != open_:
            self.open, self.handled = open_, 0

    def handle(self) -> bool:
        """Whether a message passes; afterwards the gate may fall back to its default."""
        self.handled += 1
        passes = self.open
        if self.default_after is not None and self.open != self.default_open and self.handled >= self.default_after:
            self.turn(self.default_open)
        return passes


def gate_reverting(messages: DataFrame, controls: DataFrame, order_by: str, keys: Sequence[str], start_open: bool = False, default_open: bool = False, default_after: int | None = None) -> DataFrame:
    """The gate in full: after default_after messages in the other state it reverts to default_open.

    A state that depends on its own past needs a fold: each key's rows pass
    in order through one task, which keeps one GateState and no rows.
    """
    columns = list(messages.columns)
    marked = messages.select(*columns, F.lit(None).cast("boolean").alias("_open"), F.lit(1).alias("_side"))
    turns = controls.select(*keys, order_by, F.col("open").alias("_open"), F.lit(0).alias("_side"))
    both = marked.unionByName(turns, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, order_by, "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, GateState(start_open, default_open, default_after)
        for b in batches:
            own = list(zip(*(b[k].to_pylist() for k in keys), strict=True))
            keep = []
            for i, (k, side, open_) in enumerate(zip(own, b["_side"].to_pylist(), b["_open"].to_pylist(), strict=True)):
                if k != key:
                    key, state = k, GateState(start_open, default_open, default_after)
                if side == 0:
                    state.turn(open_)
                elif state.handle():
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b[c].take(pa.array(keep, pa.int64())) for c in columns], names=columns)

    return both.mapInArrow(run, messages.schema)


def newest(df: DataFrame, n: int, order_by: str, keys: Sequence[str] = ()) -> DataFrame:
    """What a bounded queue that drops the oldest still holds."""
    if not keys:
        return df.orderBy(F.desc(order_by)).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order_by)))).where(F.col("_n") <= n).drop("_n")


def hold(df: DataFrame, value: str, order_by: str, keys: Sequence[str], initial: object = None) -> DataFrame:
    """df plus held: the last value up to the row that is not null."""
    by = Window.partitionBy(*keys).orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("held", F.coalesce(F.last(value, ignorenulls=True).over(by), F.lit(initial)))


def every_nth(df: DataFrame, n: int, order_by: str, keys: Sequence[str]) -> DataFrame:
    """The n-th, 2n-th ... message of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order_by))).where(F.col("_n") % n == 0).drop("_n")


def latest(df: DataFrame, value: str, order_by: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order_by).alias(value))


def until_total(df: DataFrame, total: int, order_by: str) -> DataFrame:
    """The messages up to the one that ends the run."""
    return df.orderBy(order_by).limit(total)


def after(events: DataFrame, cursor: int, seq: str = "seq", retained: int | None = None) -> DataFrame:
    """Events past a cursor, out of the newest `retained` if history is bounded."""
    if retained is not None:
        newest_seq = events.agg(F.max(seq)).first()[0]
        cursor = max(cursor, (newest_seq or 0) - retained)
    return events.where(F.col(seq) > cursor)


def modulus(df: DataFrame, value: str, n: int, name: str = "modulus") -> DataFrame:
    """df plus the remainder of a column, never negative."""
    return df.withColumn(name, F.pmod(F.col(value), F.lit(n)))


def relay(df: DataFrame) -> DataFrame:
    """Messages as they are; rows cannot change, so a copy of them is they themselves."""
    return df.select("*")


def over_length(counts: DataFrame, waiting: str, above: int) -> DataFrame:
    """Steps at which a queue held more than `above` messages."""
    return counts.where(F.col(waiting) > above)
