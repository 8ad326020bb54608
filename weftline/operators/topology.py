"""Directed graphs of topics: edges (src, dst), owned ones with owner (null: persistent)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def inverted(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def topology(edges: DataFrame) -> DataFrame:
    """Edges that any owner holds, each once."""
    return edges.select("src", "dst").distinct()


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start and every node that it reaches, itself included; starts has a column node.

    One join for each further step.  Only newly reached nodes go on, so
    diamonds count once and cycles end; each step's result is written, so
    plans stay short.
    """
    edges = topology(edges)
    found = front = cut(starts.select(F.col("node").alias("start"), "node").distinct())
    while True:
        step = front.join(edges, front["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = cut(step.join(found, ["start", "node"], "left_anti"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def downstream(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return reach(edges, starts)


def upstream(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return reach(inverted(edges), starts)


def add_edge(edges: DataFrame, src: str, dst: str, owner: str | None = None) -> tuple[DataFrame, bool]:
    """Edges with one more, and whether the topology changed.  Self-loops and cycles raise."""
    spark = edges.sparkSession
    back = reach(edges, spark.createDataFrame([(dst,)], "node string"))
    if src == dst or not back.where(F.col("node") == src).isEmpty():
        raise ValueError(f"{src} -> {dst} closes a cycle")
    new = edges.where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()
    return edges.unionByName(spark.createDataFrame([(src, dst, owner)], "src string, dst string, owner string")).distinct(), new


def remove_edge(edges: DataFrame, src: str, dst: str, owner: str | None = None) -> DataFrame:
    """Without one owner's hold on an edge; it lives as long as another holds it.  Missing edges are no error."""
    return edges.where(~((F.col("src") == src) & (F.col("dst") == dst) & F.col("owner").eqNullSafe(F.lit(owner))))


def remove_owner(edges: DataFrame, owner: str) -> DataFrame:
    return edges.where(~F.col("owner").eqNullSafe(F.lit(owner)))


def live_edges(edges: DataFrame, sessions: DataFrame) -> DataFrame:
    """Edges that are persistent or held by a live session (column owner)."""
    held = edges.join(sessions.select("owner").distinct(), "owner", "left_semi").select("src", "dst")
    return edges.where("owner is null").select("src", "dst").unionByName(held).distinct()


def owners_per_edge(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("owners"))


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes without outgoing edges."""
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def roots(edges: DataFrame) -> DataFrame:
    return leaves(inverted(edges))


def proxies(edges: DataFrame) -> DataFrame:
    """Nodes that are both source and target."""
    return edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))


def pruned(all_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that some edge touches."""
    return all_nodes.join(nodes(edges), "node", "left_semi")


def contract_proxies(edges: DataFrame) -> DataFrame:
    """Edges from each true source to each true sink that it reaches: every node between is a proxy."""
    far = reach(edges, roots(edges))
    return far.join(leaves(edges), "node", "left_semi").select(F.col("start").alias("src"), F.col("node").alias("dst"))


def levels(edges: DataFrame) -> DataFrame:
    """node and level of all endpoints and their parents: the greatest height above an endpoint, which has 0."""
    parts = nodes(edges).select(F.split("node", "/").alias("p"))
    up = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.struct(F.array_join(F.slice("p", 1, n), "/").alias("node"), (F.size("p") - n).alias("level")))).alias("x"))
    return up.select("x.*").where("node <> ''").groupBy("node").agg(F.max("level").alias("level"))


def endpoints_inside(edges: DataFrame) -> DataFrame:
    """Endpoints that are also above others: their edges cannot be compacted."""
    found = levels(edges)
    return nodes(edges).join(found, "node").where("level > 0")


def compact(edges: DataFrame, steps: int) -> DataFrame:
    """Edges between parents, steps levels up, without self-loops.

    An endpoint moves to its parent where the parent is exactly one level
    higher; else it stays and its level l becomes 2l + 1.  Each step looks at
    the levels before it.  The result may have cycles.
    """
    if steps and not endpoints_inside(edges).isEmpty():
        raise ValueError("an endpoint is also above others")
    edges, level = topology(edges), levels(edges)
    for _ in range(steps):
        up = F.when(F.instr("node", "/") > 0, F.regexp_extract("node", "^(.*)/[^/]*$", 1)).otherwise("")
        own = nodes(edges).join(level, "node").withColumn("parent", up)
        own = own.join(level.select(F.col("node").alias("parent"), F.col("level").alias("above")), "parent", "left")
        moves = cut(own.select("node", F.when(F.col("above") == F.col("level") + 1, F.col("parent")).otherwise(F.col("node")).alias("to"), F.when(F.col("parent") == "", F.col("level")).when(F.col("above") == F.col("level") + 1, F.col("level")).otherwise(2 * F.col("level") + 1).alias("now")))
        left, right = moves.select(F.col("node").alias("src"), F.col("to").alias("a")), moves.select(F.col("node").alias("dst"), F.col("to").alias("b"))
        edges = cut(edges.join(left, "src").join(right, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        level = cut(level.join(moves.select("node", "now"), "node", "left").select("node", F.coalesce("now", "level").alias("level")))
    return edges


def route(edges: DataFrame, publishers: DataFrame, subscribers: DataFrame) -> DataFrame:
    """subscriber and publisher (endpoints with a topic): everyone upstream of the subscriber's topic, once each."""
    far = upstream(edges, subscribers.select(F.col("topic").alias("node")).distinct())
    subs = subscribers.select(F.col("endpoint").alias("subscriber"), F.col("topic").alias("start"))
    pubs = publishers.select(F.col("endpoint").alias("publisher"), F.col("topic").alias("node"))
    return far.join(subs, "start").join(pubs, "node").select("subscriber", "publisher").distinct()


def relay_rewrite(edges: DataFrame, relays: DataFrame) -> DataFrame:
    """Edges through relays (topic): into topic/in, from topic/out, and a relay edge between."""
    out = edges.join(relays.select(F.col("topic").alias("src"), F.lit(True).alias("_s")), "src", "left").join(relays.select(F.col("topic").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    ends = out.select(F.when(F.col("_s"), F.concat("src", F.lit("/out"))).otherwise(F.col("src")).alias("src"), F.when(F.col("_d"), F.concat("dst", F.lit("/in"))).otherwise(F.col("dst")).alias("dst"))
    used = nodes(edges).join(relays.select(F.col("topic").alias("node")), "node", "left_semi")
    return ends.unionByName(used.select(F.concat("node", F.lit("/in")).alias("src"), F.concat("node", F.lit("/out")).alias("dst"))).distinct()


def subscription_diff(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """What to register and what to unregister (column publisher)."""
    add = wanted.select("publisher").distinct().join(current, "publisher", "left_anti").withColumn("change", F.lit("register"))
    return add.unionByName(current.select("publisher").distinct().join(wanted, "publisher", "left_anti").withColumn("change", F.lit("unregister")))


def owning_process(processes: DataFrame, requested: DataFrame) -> DataFrame:
    """address and the first process (pid, units) that has it."""
    held = processes.select("pid", F.explode("units").alias("address"))
    return requested.select("address").distinct().join(held.groupBy("address").agg(F.min("pid").alias("pid")), "address")


def ownership_conflicts(claims: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested units (pid, address) that another process holds."""
    held = claims.select(F.col("pid").alias("holder"), "address")
    return requests.join(held, "address").where("pid <> holder").select("pid", "address", "holder").distinct()


def collisions(registered: DataFrame, session: DataFrame) -> DataFrame:
    """Addresses of a session that are registered by another one (columns session, address)."""
    other = registered.select(F.col("session").alias("other"), "address")
    return session.join(other, "address").where("session <> other").select("address").distinct()


def flat_edges(adjacency: DataFrame) -> DataFrame:
    """Edges of (node, targets) rows."""
    return adjacency.select(F.col("node").alias("src"), F.explode("targets").alias("dst"))


def adjacency(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """A row for each node with its sorted targets: node, part, targets.

    A node with over `most` targets has a row for each `most` of them, part 0
    the smallest, so that no row grows with the graph; a node without targets
    has part 0 with an empty list.
    """
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    placed = edges.select("src", "dst").distinct().withColumn("part", F.floor(place / most).cast("int"))
    out = placed.groupBy(F.col("src").alias("node"), "part").agg(F.sort_array(F.collect_list("dst")).alias("targets"))
    found = nodes(edges).join(out, "node", "left")
    return found.select("node", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))
