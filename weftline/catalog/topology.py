"""Graph operators: regions publish to their nations and those to their customers; paths are region/nation/customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import topology as g
from weftline.plans import control
from weftline.session import table


def edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    x = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), F.pmod(F.col("n_nationkey") + 1, F.lit(5)) + 20).alias("dst"))
    return n.unionByName(c).unionByName(x)


EDGES = """edges as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer
    union all select 'r' || n_regionkey, 'n' || ((n_nationkey + 1) % 5 + 20) from nation)"""
REACH = f"{EDGES}, nodes as (select src as node from edges union select dst from edges), reach(start, node) as (select node, node from nodes union select start, dst from reach join edges on src = node)"


def _owned(spark: SparkSession, d: str) -> DataFrame:
    owner = F.when(F.length("dst") % 2 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.ascii(F.substring("dst", -1, 1)) % 3))
    return edges(spark, d).withColumn("owner", owner)


OWNED = f"{EDGES}, owned as (select *, case when length(dst) % 2 = 0 then null else 's' || (ascii(dst[-1]) % 3) end as owner from edges)"


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's stream feeds that of its nation's first supplier."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    full = F.concat(F.lit("R"), "n_regionkey", F.lit("/N"), "n_nationkey", F.lit("/C"), "c_custkey")
    return c.select(F.concat(full, F.lit("/OUT")).alias("src"), F.concat(F.lit("R"), F.pmod(F.col("n_regionkey") + 1, F.lit(5)), F.lit("/HUB/IN")).alias("dst"))


PATHS = """paths as (select 'R' || n_regionkey || '/N' || n_nationkey || '/C' || c_custkey || '/OUT' as src, 'R' || ((n_regionkey + 1) % 5) || '/HUB/IN' as dst
    from customer join nation on c_nationkey = n_nationkey)"""


def topology(spark, d):
    return g.topology(edges(spark, d))


def graph_nodes(spark, d):
    return g.nodes(edges(spark, d))


def downstream(spark, d):
    e = edges(spark, d)
    return g.downstream(e, g.nodes(e))


def upstream(spark, d):
    e = edges(spark, d)
    return g.upstream(e, g.nodes(e))


def leaves(spark, d):
    return g.leaves(edges(spark, d))


def proxies(spark, d):
    return g.proxies(edges(spark, d))


def prune(spark, d):
    all_nodes = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return g.pruned(all_nodes, edges(spark, d))


def contract_proxies(spark, d):
    return g.contract_proxies(edges(spark, d))


def levels(spark, d):
    return g.levels(paths(spark, d))


def compact_graph(spark, d):
    return g.compact(paths(spark, d), 1)


def routing(spark, d):
    e = edges(spark, d)
    pubs = table(spark, d, "nation").select(F.concat(F.lit("pub"), "n_nationkey").alias("endpoint"), F.concat(F.lit("n"), "n_nationkey").alias("topic"))
    pubs = pubs.unionByName(table(spark, d, "region").select(F.concat(F.lit("pubr"), "r_regionkey").alias("endpoint"), F.concat(F.lit("r"), "r_regionkey").alias("topic")))
    subs = table(spark, d, "customer").select(F.concat(F.lit("sub"), "c_custkey").alias("endpoint"), F.concat(F.lit("c"), "c_custkey").alias("topic"))
    return g.route(e, pubs, subs)


def reach_counts(spark, d):
    e = edges(spark, d)
    return g.downstream(e, g.roots(e)).groupBy("start").agg(F.count("*").alias("n"))


def remove_owner(spark, d):
    return g.topology(g.remove_owner(_owned(spark, d), "s1"))


def remove_edge(spark, d):
    return g.remove_edge(g.remove_edge(edges(spark, d).withColumn("owner", F.lit("s0")), "r0", "n0", "s0"), "n5", "c1", "nobody").distinct()


def live_edges(spark, d):
    return g.live_edges(_owned(spark, d), spark.createDataFrame([("s0",), ("s2",)], "owner string"))


def owners_per_edge(spark, d):
    return g.owners_per_edge(edges(spark, d))


def relay_rewrite(spark, d):
    relays = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("topic"))
    return g.relay_rewrite(g.topology(edges(spark, d)), relays)


def _topology_events(spark, d):
    """Clicks connect a user with what it clicked on, views disconnect it, purchases end all that the user holds."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "connect").when(F.col("event_type") == "view", "disconnect").when(F.col("event_type") == "purchase", "exit")
    end = F.when(kind != "exit", F.concat(F.lit("t"), F.pmod(F.col("event_id") * 7, F.lit(50))))
    return e.select(F.col("event_id").alias("seq"), kind.alias("kind"), F.when(kind != "exit", F.lit("hub")).alias("src"), end.alias("dst"), F.concat(F.lit("u"), F.pmod("user_id", F.lit(9))).alias("owner")).where("kind is not null")


def topology_state(spark, d):
    return control.topology_at(_topology_events(spark, d))


def topology_changes(spark, d):
    return control.topology_changes(_topology_events(spark, d))


def subscription_diff(spark, d):
    n = table(spark, d, "nation")
    return g.subscription_diff(n.where("n_nationkey < 15").select(F.col("n_name").alias("publisher")), n.where("n_nationkey > 8").select(F.col("n_name").alias("publisher")))


def _processes(spark, d):
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("pid")).agg(F.collect_set("n_name").alias("units"))


def unit_process(spark, d):
    return g.owning_process(_processes(spark, d), table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("address")))


def ownership_conflict(spark, d):
    claims = _processes(spark, d).select("pid", F.explode("units").alias("address"))
    asked = table(spark, d, "nation").select(F.pmod("n_nationkey", F.lit(3)).alias("pid"), F.col("n_name").alias("address"))
    return g.ownership_conflicts(claims, asked)


def metadata_collisions(spark, d):
    n = table(spark, d, "nation")
    return g.collisions(n.select(F.lit("a").alias("session"), F.col("n_name").alias("address")), n.where("n_nationkey > 20").select(F.lit("b").alias("session"), F.col("n_name").alias("address")))


def adjacency(spark, d):
    return g.flat_edges(g.adjacency(edges(spark, d)))


_FNS = (topology, graph_nodes, downstream, upstream, leaves, proxies, prune, contract_proxies, levels, compact_graph, routing, reach_counts, remove_owner, remove_edge, live_edges, owners_per_edge, relay_rewrite, topology_state, topology_changes, subscription_diff, unit_process, ownership_conflict, metadata_collisions, adjacency)
QUERIES = {f.__name__: f for f in _FNS}
HOLDS = """ev as (select event_id as seq, case event_type when 'click' then 'connect' when 'view' then 'disconnect' else 'exit' end as kind, 't' || (event_id * 7 % 50) as dst, 'u' || (user_id % 9) as owner
        from events where event_type in ('click', 'view', 'purchase')),
    ed as (select distinct dst, owner from ev where kind = 'connect'),
    m as (select seq, dst, owner, kind = 'connect' as on_ from ev where kind <> 'exit' and (dst, owner) in (select dst, owner from ed) union all select x.seq, ed.dst, ed.owner, false from ev x join ed using (owner) where x.kind = 'exit')"""
SQL = {
    "topology": f"with {EDGES} select distinct * from edges",
    "graph_nodes": f"with {EDGES} select src as node from edges union select dst from edges",
    "downstream": f"with recursive {REACH} select start, node from reach",
    "upstream": f"with recursive {REACH} select node as start, start as node from reach",
    "leaves": f"with {EDGES} select distinct dst as node from edges where dst not in (select src from edges)",
    "proxies": f"with {EDGES} select src as node from edges intersect select dst from edges",
    "prune": f"with {EDGES} select 'c' || c_custkey as node from customer where 'c' || c_custkey in (select src from edges union select dst from edges)",
    "contract_proxies": f"with recursive {REACH} select start as src, node as dst from reach where start not in (select dst from edges) and node not in (select src from edges)",
    "levels": f"""with {PATHS}, n as (select src as node from paths union select dst from paths), p as (select string_split(node, '/') as p from n),
        u as (select array_to_string(p[1:k], '/') as node, len(p) - k as level from p, lateral (select unnest(range(1, len(p) + 1)) as k)) select node, max(level)::integer as level from u group by node""",
    # HUB stays one level below its region, whose other parts are deeper; OUT and IN both move to their parents
    "compact_graph": f"with {PATHS} select distinct regexp_extract(src, '^(.*)/[^/]*$', 1) as src, regexp_extract(dst, '^(.*)/[^/]*$', 1) as dst from paths",
    "routing": f"""with recursive {REACH}, pubs as (select 'pub' || n_nationkey as publisher, 'n' || n_nationkey as topic from nation union all select 'pubr' || r_regionkey, 'r' || r_regionkey from region),
        subs as (select 'sub' || c_custkey as subscriber, 'c' || c_custkey as topic from customer)
        select distinct subscriber, publisher from subs join reach on reach.node = subs.topic join pubs on pubs.topic = reach.start""",
    "reach_counts": f"with recursive {REACH} select start, count(*) as n from reach where start not in (select dst from edges) group by start",
    "remove_owner": f"with {OWNED} select distinct src, dst from owned where owner is distinct from 's1'",
    "remove_edge": f"with {EDGES} select distinct src, dst, 's0' as owner from edges where not (src = 'r0' and dst = 'n0')",
    "live_edges": f"with {OWNED} select distinct src, dst from owned where owner is null or owner in ('s0', 's2')",
    "owners_per_edge": f"with {EDGES} select src, dst, count(*) as owners from edges group by all",
    "relay_rewrite": f"""with {EDGES}, r as (select 'n' || n_nationkey as t from nation where n_nationkey % 3 = 0)
        select distinct case when src in (select t from r) then src || '/out' else src end as src, case when dst in (select t from r) then dst || '/in' else dst end as dst from edges
        union select t || '/in', t || '/out' from r where t in (select src from edges union select dst from edges)""",
    "topology_state": f"with {HOLDS} select 'hub' as src, dst, owner from m group by dst, owner having arg_max(on_, seq)",
    # an edge is held by the owners whose last mark so far is a connect; it changes where that number leaves or reaches 0
    "topology_changes": f"""with {HOLDS}, o as (select *, coalesce(lag(on_) over (partition by dst, owner order by seq), false) as was from m),
        n as (select seq, dst, sum(case when on_ and not was then 1 when was and not on_ then -1 else 0 end) as step from o group by seq, dst),
        t as (select *, sum(step) over (partition by dst order by seq) as now_ from n where step <> 0)
        select seq, case when step > 0 then 'added' else 'removed' end as change, 'hub' as src, dst from t where (now_ = 0) <> (now_ - step = 0)""",
    "subscription_diff": "select n_name as publisher, 'register' as change from nation where n_nationkey >= 15 union all select n_name, 'unregister' from nation where n_nationkey <= 8",
    "unit_process": "select n_name as address, min(n_regionkey) as pid from nation where n_nationkey % 2 = 0 group by 1",
    "ownership_conflict": "select (n_nationkey % 3)::integer as pid, n_name as address, n_regionkey as holder from nation where n_nationkey % 3 <> n_regionkey",
    "metadata_collisions": "select n_name as address from nation where n_nationkey > 20",
    "adjacency": f"with {EDGES} select distinct src, dst from edges",
}
