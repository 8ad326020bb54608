"""Settings and topology as append-only event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import topology


def current_settings(events: DataFrame) -> DataFrame:
    """address and its value by the last event (address, value, seq)."""
    return events.groupBy("address").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def effective_settings(events: DataFrame) -> DataFrame:
    """The value that holds for each address.

    events: address, seq, kind (initial, update, exit), value.  Updates of a
    running process hold beyond the session; its exit restores the initial
    value.  Updates that no process owns (kind rejected) change nothing.
    """
    known = events.where("kind <> 'rejected'")
    initial = known.where("kind = 'initial'").groupBy("address").agg(F.max_by("value", "seq").alias("initial"))
    last = known.groupBy("address").agg(F.max_by(F.struct("kind", "value"), "seq").alias("last"))
    return last.join(initial, "address", "left").select("address", F.when(F.col("last.kind") == "exit", F.col("initial")).otherwise(F.col("last.value")).alias("value"))


def accepted_updates(events: DataFrame) -> DataFrame:
    """Updates that arrive while a process owns the address: between its initial and its exit."""
    by = Window.partitionBy("address").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("kind") != "update", F.col("kind")), ignorenulls=True).over(by)
    return events.withColumn("_before", before).where("kind = 'update' and _before = 'initial'").drop("_before")


def settings_and_components(settings: DataFrame, components: DataFrame) -> DataFrame:
    """All addresses of either side."""
    return settings.join(components, "address", "full")


def component_tree(components: DataFrame) -> DataFrame:
    """address, its parent, depth and number of components below it."""
    rows = components.select("address", F.regexp_extract("address", "^(.*)/[^/]*$", 1).alias("parent"), (F.size(F.split("address", "/")) - 1).alias("depth"))
    parts = components.select(F.split("address", "/").alias("p"))
    up = parts.where(F.size("p") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda n: F.array_join(F.slice("p", 1, n), "/"))).alias("address"))
    return rows.join(up.groupBy("address").agg(F.count("*").alias("below")), "address", "left").withColumn("below", F.coalesce("below", F.lit(0)))


def trace_windows(samples: DataFrame, controls: DataFrame) -> DataFrame:
    """Samples taken while tracing was on: a control (at, ttl) covers its time to live, up to the next control."""
    both = samples.withColumn("_ttl", F.lit(None).cast("double")).withColumn("_at", F.lit(None).cast("double"))
    turns = controls.select(F.col("at").alias("timestamp"), F.col("ttl").alias("_ttl"), F.col("at").alias("_at"), "endpoint_id")
    by = Window.partitionBy("endpoint_id").orderBy("timestamp", F.col("_at").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = both.unionByName(turns, allowMissingColumns=True)
    until = F.last("_at", ignorenulls=True).over(by) + F.last("_ttl", ignorenulls=True).over(by)
    return held.withColumn("_until", until).where("_at is null and timestamp < _until").select(samples.columns)


def topology_at(events: DataFrame, seq: int | None = None) -> DataFrame:
    """Edges (src, dst, owner) that are held after the events up to seq: those whose last event is not a removal.

    events: seq, kind (connect, disconnect, exit), src, dst, owner.  An exit of
    an owner, without src and dst, ends all its holds before.
    """
    known = events if seq is None else events.where(F.col("seq") <= seq)
    exits = known.where("kind = 'exit'").groupBy(F.col("owner").alias("_owner")).agg(F.max("seq").alias("_exit"))
    last = known.where("kind <> 'exit'").groupBy("src", "dst", "owner").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))
    held = last.where("kind = 'connect'").join(exits, F.col("owner").eqNullSafe(F.col("_owner")), "left")
    return held.where("_exit is null or seq > _exit").select("src", "dst", "owner")


def topology_changes(events: DataFrame, after_seq: int = -1) -> DataFrame:
    """The events past a cursor that change what is connected: an edge's first hold, and the end of its last.

    Holds are counted along each edge's own events, with exits as ends of what
    their owner holds; a second hold of an edge changes nothing.
    """
    starts = events.where("kind = 'connect'").select("seq", "src", "dst", "owner")
    ends = events.where("kind = 'disconnect'").select("seq", "src", "dst", "owner")
    exits = events.where("kind = 'exit'").select(F.col("seq").alias("_exit"), F.col("owner").alias("_owner"))
    edges = starts.select("src", "dst", "owner").distinct()
    ended = edges.join(exits, F.col("owner").eqNullSafe(F.col("_owner"))).select(F.col("_exit").alias("seq"), "src", "dst", "owner")
    marks = starts.withColumn("holds", F.lit(1)).unionByName(ends.unionByName(ended).withColumn("holds", F.lit(0)))
    by_owner = Window.partitionBy("src", "dst", "owner").orderBy("seq")
    steps = marks.withColumn("step", F.col("holds") - F.coalesce(F.lag("holds").over(by_owner), F.lit(0))).where("step <> 0")
    by_edge = Window.partitionBy("src", "dst").orderBy("seq", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    counted = steps.withColumn("now", F.sum("step").over(by_edge))
    found = counted.where("(step = 1 and now = 1) or (step = -1 and now = 0)").where(F.col("seq") > after_seq)
    return found.select("seq", F.when(F.col("step") == 1, "added").otherwise("removed").alias("change"), "src", "dst")


class GraphSession:
    """An owner's connections, as events of a topology table: connect and disconnect append, snapshot reads, revert goes back."""

    def __init__(self, spark: SparkSession, owner: str, events: DataFrame | None = None) -> None:
        self.spark, self.owner = spark, owner
        self.events = events if events is not None else spark.createDataFrame([], "seq long, kind string, src string, dst string, owner string")

    def _add(self, kind: str, src: str | None, dst: str | None) -> int:
        seq = (self.events.agg(F.max("seq")).first()[0] or 0) + 1
        self.events = self.events.unionByName(self.spark.createDataFrame([(seq, kind, src, dst, self.owner)], "seq long, kind string, src string, dst string, owner string"))
        return seq

    def connect(self, src: str, dst: str) -> int:
        """The event's number.  Self-loops and cycles raise."""
        topology.add_edge(self.snapshot(), src, dst, self.owner)
        return self._add("connect", src, dst)

    def disconnect(self, src: str, dst: str) -> int:
        return self._add("disconnect", src, dst)

    def snapshot(self, seq: int | None = None) -> DataFrame:
        return topology_at(self.events, seq)

    def revert(self, seq: int) -> DataFrame:
        """Events that bring this owner's connections back to what they were after seq; others keep theirs."""
        mine = F.col("owner").eqNullSafe(F.lit(self.owner))
        then, now = (self.snapshot(s).where(mine).select("src", "dst") for s in (seq, None))
        for kind, rows in (("disconnect", now.exceptAll(then)), ("connect", then.exceptAll(now))):
            for r in rows.collect():  # one owner's own connections
                self._add(kind, r["src"], r["dst"])
        return self.snapshot()

    def close(self) -> int:
        return self._add("exit", None, None)
