"""Property graphs: edges (src, dst, kind, weight) between named nodes."""

from __future__ import annotations

import itertools
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.sources.staging import drop, staged


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst, kind, direction: every edge and its reverse, so that undirected steps are equi-joins."""
    out = edges.select("src", "dst", "kind", F.lit("outgoing").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", F.lit("incoming").alias("direction")))


def neighbours(edges: DataFrame, nodes: DataFrame, start: object) -> DataFrame:
    """node, name, kind, direction of everything one edge away, either way."""
    near = both_ways(edges).filter(F.col("src") == F.lit(start)).select(F.col("dst").alias("node"), "kind", "direction")
    return near.join(nodes, "node").select("node", "name", "kind", "direction").orderBy("name", "node", "kind", "direction")


def search_entities(nodes: DataFrame, text: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Nodes whose name holds the text in any case, by name; at most 100."""
    hit = F.lower("name").contains(text.lower())
    return nodes.filter(hit if kind is None else hit & (F.col("type") == kind)).orderBy("name", "node").limit(min(limit, 100))


def relations_of(edges: DataFrame, nodes: DataFrame, start: object) -> DataFrame:
    """The edges at a node with both endpoints' names, by kind."""
    at = edges.filter((F.col("src") == F.lit(start)) | (F.col("dst") == F.lit(start)))
    name = lambda c: nodes.select(F.col("node").alias(c), F.col("name").alias(f"{c}_name"))
    return at.join(name("src"), "src").join(name("dst"), "dst").select("src", "src_name", "kind", "dst", "dst_name").orderBy("kind", "src", "dst")


def clamp_depth(depth: int) -> int:
    return max(1, min(10, depth))


def walks(edges: DataFrame, start: object, depth: int) -> DataFrame:
    """node, kind, via, depth: a row for each last step of an undirected walk of up to ``depth`` edges, self-loops left out, walks back included.

    The walks of one length are the distinct steps out of the nodes of the length before, so the
    rows of a level are bounded by twice the edges, however many walks there are.
    """
    steps = both_ways(edges).filter("src != dst").select("src", "dst", "kind").distinct()
    level = edges.sparkSession.range(1).select(F.lit(start).alias("node"))
    out = None
    for d in range(1, clamp_depth(depth) + 1):
        now = level.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "kind", F.col("src").alias("via"), F.lit(d).alias("depth")).distinct()
        out = now if out is None else out.unionByName(now)
        level = now.select("node").distinct()
    return out


def bfs_directed(edges: DataFrame, start: object, depth: int) -> DataFrame:
    """node, depth for every depth at which a walk along outgoing edges reaches the node; the start at 0."""
    level = edges.sparkSession.range(1).select(F.lit(start).alias("node"))
    steps, out = edges.select("src", "dst").distinct(), level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        level = level.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return out


def bfs_min_depth(edges: DataFrame, start: object, depth: int) -> DataFrame:
    """node, depth: fewest undirected edges from the start, which has 0."""
    return bfs_paths(edges, start, depth).select("node", "depth")


def bfs_paths(edges: DataFrame, start: object, depth: int) -> DataFrame:
    """node, depth, path: first visit of each node; of equally short paths the least one. Each level joins only the frontier and drops what was visited."""
    steps = both_ways(edges).select("src", "dst").distinct()
    seen = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("depth"), F.array(F.lit(start)).alias("path"))
    front = seen
    for d in range(1, depth + 1):
        reached = front.select(F.col("node").alias("src"), "path").join(steps, "src").groupBy("dst").agg(F.min("path").alias("path"))
        new = reached.join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        front = staged(new.select(F.col("dst").alias("node"), F.lit(d).alias("depth"), F.concat("path", F.array("dst")).alias("path")), "frontier")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def relations_among(edges: DataFrame, visited: DataFrame, relation_types: tuple[str, ...] | None = None) -> DataFrame:
    """The edges whose two ends a search has visited; of the named kinds only, if any: they don't change what is visited."""
    own = edges if relation_types is None else edges.filter(F.col("kind").isin(*relation_types))
    ends = visited.select("node").distinct()
    return own.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")


def shortest_path(edges: DataFrame, start: object, goal: object, max_depth: int = 10) -> list | None:
    """Nodes of a shortest undirected path, the least of equally short ones; None if there is none within max_depth edges."""
    hit = bfs_paths(edges, start, max_depth).filter(F.col("node") == F.lit(goal)).select("path").head()
    return None if hit is None else list(hit[0])


def dfs(edges: DataFrame, start: object, depth: int, bound: int = 1_000_000) -> list[tuple[object, int]]:
    """Pre-order (node, depth), smaller neighbours first, each node once.

    A depth-first order is sequential: the part of the graph within ``depth`` comes to the driver,
    which must not have more than ``bound`` edges.
    """
    near = bfs_min_depth(edges, start, depth).select("node")
    steps = both_ways(edges).select("src", "dst").distinct().join(near, F.col("src") == F.col("node"), "left_semi").limit(bound + 1).collect()
    if len(steps) > bound:
        raise ValueError(f"more than {bound} edges are within depth {depth}")
    out_of = defaultdict(list)
    for r in steps:
        out_of[r["src"]].append(r["dst"])
    seen, order, todo = set(), [], [(start, 0)]
    while todo:
        node, d = todo.pop()
        if node in seen:
            continue
        seen.add(node)
        order.append((node, d))
        if d < depth:
            todo += [(n, d + 1) for n in sorted(out_of[node], reverse=True) if n not in seen]
    return order


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """node, rank; ranks sum to 1, nodes without outgoing edges share theirs among all."""
    links = staged(edges.select("src", "dst").distinct(), "links")
    nodes = staged(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct(), "nodes")
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    plain, links = links, staged(links.join(degree, "src"), "links")
    drop(plain)
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(iterations):
        given = links.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        kept = F.broadcast(given.agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("kept")))
        new = nodes.join(given, F.col("node") == F.col("dst"), "left").crossJoin(kept)
        rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + (1 - F.col("kept")) / n)
        was, ranks = ranks, staged(new.select("node", rank.alias("rank")), "ranks")
        drop(was)
    if iterations:
        drop(nodes)
    drop(links)
    return ranks


def distances(edges: DataFrame, start: object, max_rounds: int | None = None, goal: object | None = None) -> DataFrame:
    """node, distance, via: least sum of (non-negative) weights along outgoing edges, and the node before (null at the start; of equal ones the least).

    Rounds of relaxation until nothing gets shorter: a path of n edges takes n rounds and one more; with ``max_rounds``, an error if something still gets shorter
    in the last. With a goal, what is farther than the goal by then is not followed.
    """
    kind = edges.schema["src"].dataType
    best = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0.0).alias("distance"), F.lit(None).cast(kind).alias("via"))
    moved = best
    for n in itertools.count(1):
        offers = moved.join(edges, F.col("node") == F.col("src")).select("dst", F.struct((F.col("distance") + F.col("weight")).alias("offer"), F.col("src").alias("by")).alias("o")).groupBy("dst").agg(F.min("o").alias("o"))
        better = offers.join(best, F.col("dst") == F.col("node"), "left").filter("distance is null or o.offer < distance")
        if goal is not None:
            limit = best.filter(F.col("node") == F.lit(goal)).agg(F.min("distance").alias("limit"))
            better = better.crossJoin(F.broadcast(limit)).filter("limit is null or o.offer < limit")
        was, moved = moved, staged(better.select(F.col("dst").alias("node"), F.col("o.offer").alias("distance"), F.col("o.by").alias("via")), "relaxed")
        drop(was)
        if moved.isEmpty():
            drop(moved)
            return best
        if n == max_rounds:
            raise ValueError(f"distances still get shorter after {max_rounds} rounds")
        was, best = best, staged(best.join(moved.select("node"), "node", "left_anti").unionByName(moved), "distances")
        drop(was)


def lightest_path(edges: DataFrame, start: object, goal: object) -> tuple[float, list] | None:
    """Distance and nodes of a path of least weight to one goal, or None: the distances' predecessors, followed back from the goal by a look-up a step."""
    best = distances(edges, start, goal=goal)
    at = best.filter(F.col("node") == F.lit(goal)).head()
    if at is None:
        return None
    far, path = at["distance"], [goal]
    while at["via"] is not None:
        path.append(at["via"])
        at = best.filter(F.col("node") == F.lit(at["via"])).head()
    return far, path[::-1]


def modularity(links: DataFrame, of: DataFrame) -> float:
    """Of links (u, v, w: each edge both ways, loops once with twice their weight) and communities (node, community)."""
    name = lambda c: of.select(F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    held = links.join(name("u"), "u").join(name("v"), "v").groupBy("cu").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    all_ = F.broadcast(held.agg(F.sum("total").alias("all")))
    return held.crossJoin(all_).agg(F.coalesce(F.sum(F.col("inside") / F.col("all") - F.pow(F.col("total") / F.col("all"), 2)), F.lit(0.0))).head()[0]


def _level(links: DataFrame, patience: int) -> tuple[DataFrame, float]:
    """Moves nodes to the neighbouring community that gains most, half of them a round, while modularity grows: the best (node, community) met, and its modularity."""
    strength = staged(links.groupBy("u").agg(F.sum("w").alias("k")).withColumnRenamed("u", "node"), "strength")
    total = strength.agg(F.sum("k")).head()[0]
    state = strength.select("node", "k", F.col("node").alias("community"))
    best, score, idle = state, modularity(links, state), 0
    for n in itertools.count():
        sums = state.groupBy("community").agg(F.sum("k").alias("held"))
        near = links.filter("u != v").join(state.select(F.col("node").alias("v"), "community"), "v").groupBy(F.col("u").alias("node"), "community").agg(F.sum("w").alias("w"))
        own = state.select("node", "community").withColumn("w", F.lit(0.0))
        options = near.unionByName(own).groupBy("node", "community").agg(F.sum("w").alias("w")).join(sums, "community")
        mine = state.select("node", "k", F.col("community").alias("now"))
        gain = F.col("w") - F.col("k") * (F.col("held") - F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0.0)) / total
        ranked = options.join(mine, "node").select("node", "k", "now", F.struct(F.round(gain, 9).alias("gain"), F.when(F.col("community") == F.col("now"), 1).otherwise(0).alias("stays"), F.col("community").alias("to")).alias("g"))
        chosen = ranked.groupBy("node", "k", "now").agg(F.max("g").alias("g"))
        turn = F.pmod(F.xxhash64("node", F.lit(n // 2)), F.lit(2)) == n % 2
        was, state = state, staged(chosen.select("node", "k", F.when(turn, F.col("g.to")).otherwise(F.col("now")).alias("community"), (F.col("g.to") != F.col("now")).alias("wants")), "communities")
        wanted = state.filter("wants").limit(1).count()
        now = modularity(links, state)
        if was is not best:
            drop(was)
        if now > score + 1e-9:
            drop(best)
            best, score, idle = state, now, 0
        else:
            idle += 1
        if not wanted or idle >= patience:
            return best, score


def communities(edges: DataFrame, patience: int = 4) -> DataFrame:
    """node, community: groups of an undirected weighted graph by modularity; a community is named by one of its nodes.

    Local moves in parallel rounds, then communities become the nodes of the next level, while modularity grows: it ends when no
    node wants to move, or after ``patience`` rounds without growth. Every round is joins and sums over the edges; nothing comes to the driver but a number.
    """
    ways = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").cast("double").alias("w"))
    ways = ways.filter("u != v").unionByName(ways.filter("u != v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).unionByName(ways.filter("u = v").withColumn("w", F.col("w") * 2))
    links = staged(ways.groupBy("u", "v").agg(F.sum("w").alias("w")), "links")
    member, score = None, None
    while True:
        level, now = _level(links, patience)
        if member is not None and now <= score + 1e-9:
            return member
        score, was = now, links
        member = staged(level.select("node", "community"), "members") if member is None else staged(member.select("node", F.col("community").alias("c")).join(level.select(F.col("node").alias("c"), "community"), "c").select("node", "community"), "members")
        name = lambda c, level=level: level.select(F.col("node").alias(c), F.col("community").alias(f"c{c}"))
        links = staged(links.join(name("u"), "u").join(name("v"), "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "links")
        drop(was, level)
