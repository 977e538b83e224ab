"""Graph operators: connectivity, edge splits, and least-cost routes by frontier relaxation.

Edges are undirected rows (a, b, ...); a route query is a number with start and goal nodes, and many queries run at
once. Small graphs are searched on copies; else each round relaxes all edges of the frontier in one join and keeps a node's best cost; rounds end when nothing
improves. Tables between rounds are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.operators.components import connected_components
from terrazzo.operators.spatial import nearest_points, per_place
from terrazzo.session import staged

#: Graphs of so many edges, some 5 MB, are searched on copies in the workers.
LOCAL_EDGES = 200_000


def node_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes; a node without edges is its own component."""
    c = connected_components(edges, "a", "b")
    return nodes.select("node").join(c, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(components: DataFrame, most: int = 1000) -> DataFrame:
    """The `most` largest components with their rank from 1, by size and then name."""
    s = components.groupBy("component").agg(F.count("*").alias("size"))
    top = s.orderBy(F.col("size").desc(), "component").limit(most)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("size").desc(), "component")))


def prune(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Nodes of the largest component and of components with a node of `keep`."""
    c = staged(node_components(nodes, edges), "prune")
    top = component_sizes(c, 1).select("component")
    return c.join(top.unionByName(c.join(keep.select("node"), "node", "left_semi").select("component")).distinct(), "component", "left_semi").select("node")


def check_connectivity(nodes: DataFrame, edges: DataFrame, rooms: DataFrame, buildings: DataFrame, barred: str = "emergency") -> tuple[DataFrame, DataFrame]:
    """(components, unreachable). nodes: node, access, outdoor; edges: a, b, access; rooms: room, node;
    buildings: building, node (a row an entrance).

    Barred nodes and edges are left out first. Components that hold a room or a building are listed with
    their counts; the main one has most outdoor nodes, then rooms, then nodes. Rooms without a node in it,
    and buildings without an entrance in it, are unreachable (kind, id).
    """
    open_nodes = nodes.where(F.coalesce(F.col("access") != barred, F.lit(True)))
    ids = open_nodes.select("node")
    e = edges.where(F.coalesce(F.col("access") != barred, F.lit(True))).select("a", "b")
    e = e.join(ids.withColumnRenamed("node", "a"), "a", "left_semi").join(ids.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
    comp = staged(node_components(open_nodes, e), "connectivity")
    by_node = comp.join(open_nodes.select("node", "outdoor"), "node").groupBy("component").agg(F.count("*").alias("size"), F.count_if("outdoor").alias("outdoor"))
    r = rooms.join(comp, "node", "left")
    b = buildings.join(comp, "node", "left")
    n_rooms = r.where("component is not null").groupBy("component").agg(F.count_distinct("room").alias("rooms"))
    n_buildings = b.where("component is not null").groupBy("component").agg(F.count_distinct("building").alias("buildings"))
    stats = by_node.join(n_rooms, "component", "left").join(n_buildings, "component", "left").fillna(0, ["rooms", "buildings"]).where("rooms > 0 or buildings > 0")
    stats = staged(stats, "connectivity-stats")
    main = stats.orderBy(F.col("outdoor").desc(), F.col("rooms").desc(), F.col("size").desc(), "component").limit(1).select(F.col("component").alias("main"))
    in_main = lambda d, key: d.join(F.broadcast(main), d["component"] == main["main"], "left_semi").select(key)
    lost = rooms.select("room").distinct().join(in_main(r, "room"), "room", "left_anti").select(F.lit("room").alias("kind"), F.col("room").alias("id"))
    cut = buildings.select("building").distinct().join(in_main(b, "building"), "building", "left_anti").select(F.lit("building").alias("kind"), F.col("building").alias("id"))
    return stats, lost.unionByName(cut)


def describe(unreachable: DataFrame, labels: DataFrame) -> DataFrame:
    """Findings as lines of text."""
    name = F.coalesce("label", F.col("id").cast("string"))
    return unreachable.join(labels, "id", "left").select("kind", "id", F.concat(F.lit("no way to "), F.col("kind"), F.lit(" "), name).alias("line"))


def split_edges(edges: DataFrame, cuts: DataFrame, near: float = 0.5) -> DataFrame:
    """Edges (edge, a, b, length) cut at cuts (edge, at, node), `at` from a; pieces are (edge, part, a, b, length).

    A cut within `near` of an end joins that end, so it makes no piece of its own.
    """
    c = cuts.join(edges.select("edge", "length"), "edge").where((F.col("at") > near) & (F.col("at") < F.col("length") - near)).select("edge", "at", "node")
    ends = edges.select("edge", F.lit(0.0).alias("at"), F.col("a").alias("node")).unionByName(edges.select("edge", F.col("length").alias("at"), F.col("b").alias("node")))
    w = W.partitionBy("edge").orderBy("at", "node")
    p = c.unionByName(ends).withColumn("b", F.lead("node").over(w)).withColumn("to", F.lead("at").over(w)).withColumn("part", F.row_number().over(w))
    return p.where("b is not null").select("edge", "part", F.col("node").alias("a"), "b", (F.col("to") - F.col("at")).alias("length"))


def route_edges(edges: DataFrame, alt_factor: float = 3.0, side_door_cost: float = 0.0, step_free: bool = False, allow_emergency: bool = False, avoid_nodes: DataFrame | None = None, avoid_edges: DataFrame | None = None) -> DataFrame:
    """Directed edges (src, dst, w) from (edge, a, b, length, access, accessible, door).

    Alternative edges cost `alt_factor` times their length (1 at least), doors a further sum; emergency edges,
    steps and avoided edges or nodes are left out as asked for. A missing `accessible` counts as true.
    """
    e = edges
    if not allow_emergency:
        e = e.where(F.coalesce(F.col("access") != "emergency", F.lit(True)))
    if step_free:
        e = e.where(F.coalesce("accessible", F.lit(True)))
    if avoid_edges is not None:
        e = e.join(avoid_edges.select("edge"), "edge", "left_anti")
    if avoid_nodes is not None:
        for end in ("a", "b"):
            e = e.join(avoid_nodes.select(F.col("node").alias(end)), end, "left_anti")
    w = F.col("length") * F.when(F.col("access") == "alt", max(1.0, alt_factor)).otherwise(1.0) + F.when(F.coalesce("door", F.lit(False)), max(0.0, side_door_cost)).otherwise(0.0)
    return e.select("a", "b", w.alias("w")).select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))).alias("e")).select("e.*")


def find_paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, max_rounds: int = 10_000, avoid: DataFrame | None = None) -> DataFrame:
    """For each query its best route (query, goal, cost, path) over directed edges (src, dst, w >= 0).

    starts and goals: query, node, offset. A start's offset is paid at its beginning, a goal's at its end.
    Equal costs go to the lower sequence of nodes. Queries without a route have no row. Once a query has reached a
    goal, places that cost more than its best one are not followed. A graph of at most LOCAL_EDGES edges between
    whole numbers is sent to the workers, which search it query by query; larger ones, and states of other types, are
    relaxed in joins, with the same result. avoid: edges (query, src, dst) closed to a query.
    """
    adj = staged(edges.groupBy("src", "dst").agg(F.min("w").alias("w")), "route-edges")
    if adj.schema["src"].dataType.typeName() in ("integer", "long") and adj.count() <= LOCAL_EDGES:
        return _paths_on_copies(adj, starts, goals, avoid)
    best = starts.groupBy("query", "node").agg(F.min("offset").cast("double").alias("cost")).withColumn("path", F.array("node"))
    best = staged(best, "route-best")
    shut = None if avoid is None else staged(avoid.select("query", "src", "dst").distinct(), "route-closed")
    ends = staged(goals.groupBy("query", "node").agg(F.min("offset").alias("off")), "route-ends")
    front = best
    for _ in range(max_rounds):
        step = front.join(adj, front["node"] == adj["src"]).where(~F.array_contains("path", F.col("dst")))
        step = step if avoid is None else step.join(shut, ["query", "src", "dst"], "left_anti")
        step = step.select("query", F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.array_append("path", F.col("dst")).alias("path"))
        step = step.groupBy("query", "node").agg(F.min(F.struct("cost", "path")).alias("n"))
        both = best.select("query", "node", F.struct("cost", "path").alias("o")).join(step, ["query", "node"], "full_outer")
        both = staged(both.select("query", "node", F.least("o", "n").alias("s"), (F.col("o").isNull() | (F.col("n") < F.col("o"))).alias("new")), "route-round")
        best = both.select("query", "node", "s.*")
        bound = best.join(ends, ["query", "node"]).groupBy("query").agg(F.min(F.col("cost") + F.col("off")).alias("bound"))
        front = both.where("new").select("query", "node", "s.*").join(bound, "query", "left").where("bound is null or cost <= bound").drop("bound")
        if front.isEmpty():
            break
    end = best.join(ends, ["query", "node"])
    end = end.groupBy("query").agg(F.min(F.struct((F.col("cost") + F.col("off")).alias("cost"), "path")).alias("r"))
    return end.select("query", F.try_element_at("r.path", F.lit(-1)).alias("goal"), "r.cost", "r.path")


def _paths_on_copies(adj: DataFrame, starts: DataFrame, goals: DataFrame, avoid: DataFrame | None) -> DataFrame:
    """find_paths by a search of least (cost, path) over a copy of the edges in each worker; a query's ends are one row."""
    spark = adj.sparkSession
    kind = adj.schema["src"].dataType.simpleString()
    edges = adj.toPandas()  # LOCAL_EDGES rows at most
    shared = spark.sparkContext.broadcast(tuple(edges[c].to_numpy() for c in ("src", "dst", "w")))
    ends = lambda df, name: df.groupBy("query").agg(F.collect_list("node").alias(name), F.collect_list(F.col("offset").cast("double")).alias(f"{name}_offset"))
    rows = ends(starts, "starts").join(ends(goals, "goals"), "query")
    shut = adj.limit(0).select(F.lit(0).alias("query"), "src", "dst") if avoid is None else avoid.select("query", "src", "dst")
    shut = shut.groupBy("query").agg(F.collect_list("src").alias("shut_src"), F.collect_list("dst").alias("shut_dst"))
    rows = rows.join(shut, "query", "left").select("query", "starts", "starts_offset", "goals", "goals_offset", "shut_src", "shut_dst")

    def run(batches):
        import heapq
        from collections import defaultdict

        near = defaultdict(list)
        for a, b, w in zip(*(x.tolist() for x in shared.value), strict=True):
            near[a].append((b, w))
        for batch in batches:
            out = []
            for r in batch.itertuples():
                closed = set() if r.shut_src is None else set(zip(r.shut_src, r.shut_dst, strict=True))
                goal: dict = {}
                for node, off in zip(r.goals, r.goals_offset, strict=True):
                    goal[node] = min(off, goal.get(node, off))
                heap = [(off, (node,)) for node, off in zip(r.starts, r.starts_offset, strict=True)]
                heapq.heapify(heap)
                done, best = set(), None
                while heap and (best is None or heap[0][0] <= best[0]):
                    cost, path = heapq.heappop(heap)
                    node = path[-1]
                    if node in done:
                        continue
                    done.add(node)
                    if node in goal and (best is None or (cost + goal[node], path) < best):
                        best = (cost + goal[node], path)
                    for to, w in near[node] if node in near else ():
                        if to not in done and (node, to) not in closed:
                            heapq.heappush(heap, (cost + w, (*path, to)))
                if best is not None:
                    out.append((r.query, int(best[1][-1]), best[0], [int(x) for x in best[1]]))
            yield pd.DataFrame(out, columns=["query", "goal", "cost", "path"])

    return rows.mapInPandas(run, f"query {starts.schema['query'].dataType.simpleString()}, goal {kind}, cost double, path array<{kind}>")


def line_graph(edges: DataFrame, nodes: DataFrame, turn_cost: float = 15.0, floor_cost: float = 120.0, junction_cost: float = 8.0, room_cost: float = 15.0, sharp: float = 45.0) -> DataFrame:
    """Edges between states src and dst, a state being a directed edge (u, v) as struct.

    edges: src, dst, w; nodes: node, x, y, floor, room (null outside), degree. Passing v from u to t costs w(v, t),
    a turn sharper than `sharp` degrees on one floor, a change of floor, a junction (degree of 3 or more), and a room.
    """
    e = edges.groupBy("src", "dst").agg(F.min("w").alias("w"))
    at = lambda p: nodes.select(*(F.col(c).alias(f"{p}_{c}") for c in ("node", "x", "y", "floor", "room", "degree")))
    e = e.join(at("u"), F.col("src") == F.col("u_node")).join(at("v"), F.col("dst") == F.col("v_node"))
    first = e.select(F.struct("src", "dst").alias("s1"), F.col("dst").alias("mid"), F.col("src").alias("back"), "u_x", "u_y", "u_floor", "v_x", "v_y", "v_floor", "v_room", "v_degree")
    then = e.select(F.struct("src", "dst").alias("s2"), F.col("src").alias("mid"), F.col("dst").alias("ahead"), "w", F.col("v_x").alias("t_x"), F.col("v_y").alias("t_y"), F.col("v_floor").alias("t_floor"))
    j = first.join(then, "mid").where(F.col("back") != F.col("ahead"))
    turn = turn_degrees(F.col("u_x"), F.col("u_y"), F.col("v_x"), F.col("v_y"), F.col("t_x"), F.col("t_y"))
    flat = (F.col("u_floor") == F.col("v_floor")) & (F.col("v_floor") == F.col("t_floor"))
    cost = (
        F.col("w")
        + F.when(flat & (turn > sharp), turn_cost).otherwise(0.0)
        + F.when(F.col("v_floor") != F.col("t_floor"), floor_cost).otherwise(0.0)
        + F.when(F.col("v_degree") >= 3, junction_cost).otherwise(0.0)
        + F.when(F.col("v_room").isNotNull(), room_cost).otherwise(0.0)
    )
    return j.select(F.col("s1").alias("src"), F.col("s2").alias("dst"), cost.alias("w"))


def turn_degrees(ux: Column, uy: Column, vx: Column, vy: Column, tx: Column, ty: Column) -> Column:
    """The change of direction at v, 0 to 180."""
    d = F.degrees(F.atan2(ty - vy, tx - vx) - F.atan2(vy - uy, vx - ux))
    return F.abs(F.pmod(d + 540, F.lit(360.0)) - 180)


def find_simple_routes(edges: DataFrame, nodes: DataFrame, starts: DataFrame, goals: DataFrame, **costs: float) -> DataFrame:
    """find_paths under costs that depend on the way taken; starts and goals must differ. Paths are of nodes."""
    states = line_graph(edges, nodes, **costs)
    e = edges.groupBy("src", "dst").agg(F.min("w").alias("w"))
    begin = starts.join(e, starts["node"] == e["src"]).select("query", F.struct("src", "dst").alias("node"), (F.col("offset") + F.col("w")).alias("offset"))
    finish = goals.join(e, goals["node"] == e["dst"]).select("query", F.struct("src", "dst").alias("node"), "offset")
    p = find_paths(states, begin, finish)
    path = F.concat(F.array(F.get("path", F.lit(0))["src"]), F.transform("path", lambda s: s["dst"]))
    return p.select("query", F.col("goal.dst").alias("goal"), "cost", path.alias("path"))


def confusion(paths: DataFrame, nodes: DataFrame, sharp: float = 45.0, least: float = 0.75) -> DataFrame:
    """Turns, floor changes, junctions and rooms on each query's path (array of nodes)."""
    step = paths.select("query", F.posexplode("path").alias("at", "node")).join(nodes, "node")
    w = W.partitionBy("query").orderBy("at")
    near = lambda c, k: F.lag(c, k).over(w)
    turn = turn_degrees(near("x", 2), near("y", 2), near("x", 1), near("y", 1), F.col("x"), F.col("y"))
    long = (F.hypot(near("x", 1) - near("x", 2), near("y", 1) - near("y", 2)) >= least) & (F.hypot(F.col("x") - near("x", 1), F.col("y") - near("y", 1)) >= least)
    flat = (near("floor", 2) == near("floor", 1)) & (near("floor", 1) == F.col("floor"))
    inner = near("at", 1).isNotNull() & F.lead("at").over(w).isNotNull()
    s = step.select("query", (flat & long & (turn > sharp)).alias("t"), (near("floor", 1) != F.col("floor")).alias("f"), (inner & (F.col("degree") >= 3)).alias("j"), (inner & F.col("room").isNotNull()).alias("r"))
    return s.groupBy("query").agg(F.count_if("t").alias("turns"), F.count_if("f").alias("floor_changes"), F.count_if("j").alias("junctions"), F.count_if("r").alias("rooms"))


def nearest_open(edges: DataFrame, nodes: DataFrame, of: DataFrame, barred: str = "emergency") -> DataFrame:
    """For each node of `of` the least-distant node that isn't barred, over all edges; ties to the smaller node.

    The way to the nearest open node leads over barred ones alone, so open nodes are not followed: what is walked is
    the barred part around each query, not the whole graph.
    """
    starts = of.select(F.col("node").alias("query"), "node", F.lit(0.0).alias("offset"))
    adj = staged(edges.groupBy("src", "dst").agg(F.min("w").alias("w")), "open-edges")
    free = staged(nodes.where(F.col("access") != barred).select("node"), "open-nodes")
    hit = find_all(adj, starts, free).join(free, "node", "left_semi")
    return hit.groupBy("query").agg(F.min(F.struct("cost", "node")).alias("r")).select(F.col("query").alias("node"), F.col("r.node").alias("open"), "r.cost")


def find_all(adj: DataFrame, starts: DataFrame, ends: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """Least costs (query, node, cost) from each query's start to every node it reaches; nodes of `ends` are not followed."""
    best = staged(starts.groupBy("query", "node").agg(F.min("offset").cast("double").alias("cost")), "all-best")
    front = best
    for _ in range(max_rounds):
        step = front.join(adj, front["node"] == adj["src"]).groupBy("query", "dst").agg(F.min(F.col("cost") + F.col("w")).alias("n")).withColumnRenamed("dst", "node")
        both = staged(best.join(step, ["query", "node"], "full_outer").select("query", "node", F.least("cost", "n").alias("c"), (F.col("cost").isNull() | (F.col("n") < F.col("cost"))).alias("new")), "all-round")
        best = both.select("query", "node", F.col("c").alias("cost"))
        front = both.where("new").select("query", "node", F.col("c").alias("cost"))
        front = front if ends is None else front.join(ends, "node", "left_anti")
        if front.isEmpty():
            break
    return best


def nearest_node(points: DataFrame, nodes: DataFrame, ident: str) -> DataFrame:
    """For each point (floor, x, y) the nearest node on its floor, ties to the smaller node (see nearest_points).

    Distances are between distinct places, so many points at one place are one search.
    """
    n = nodes.select("node", "floor", F.col("x").alias("nx"), F.col("y").alias("ny"))
    near = per_place(points.select(ident, "floor", "x", "y"), ["floor", "x", "y"], lambda at: nearest_points(at, n, "node", ["floor"]))
    return near.select(ident, "node", F.col("d").alias("dist"))


def plan_routes(edges: DataFrame, starts: DataFrame, goals: DataFrame, front_goals: DataFrame, **options) -> DataFrame:
    """The best route and that to the front doors, with why the first was taken: front, shorter, or only."""
    e = route_edges(edges, **options)
    best = find_paths(e, starts, goals).select("query", "goal", "cost", "path")
    front = find_paths(e, starts, front_goals).select("query", F.col("goal").alias("front"), F.col("cost").alias("front_cost"))
    why = F.when(F.col("front").isNull(), "only").when(F.col("goal") == F.col("front"), "front").otherwise("shorter")
    return best.join(front, "query", "left").withColumn("why", why)
