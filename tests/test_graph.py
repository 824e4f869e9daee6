import heapq
import random
import re
from collections import defaultdict

import pytest

from lexmere.operators import graph, trigrams


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("a", "b", "R", 1.0), ("b", "c", "R", 1.0), ("a", "c", "R", 5.0), ("c", "d", "S", 1.0), ("x", "y", "R", 1.0), ("d", "d", "S", 1.0)]
    return spark.createDataFrame(rows, "src string, dst string, kind string, weight double").cache()


def _pairs(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_breadth_first(edges):
    assert _pairs(graph.bfs_min_depth(edges, "a", 5), "node", "depth") == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert _pairs(graph.bfs_directed(edges, "a", 2), "node", "depth") == {("a", 0), ("b", 1), ("c", 1), ("c", 2), ("d", 2)}
    walks = _pairs(graph.walks(edges, "a", 2), "node", "depth")
    assert ("a", 2) in walks and {n for n, _ in walks} == {"a", "b", "c", "d"}
    assert {n for n, _ in _pairs(graph.bfs_min_depth(edges, "a", 2), "node", "depth")} <= {n for n, _ in walks} | {"a"}


def test_paths(edges):
    assert graph.shortest_path(edges, "a", "d") == ["a", "c", "d"]
    assert graph.shortest_path(edges, "a", "y") is None and graph.shortest_path(edges, "a", "a") == ["a"]
    assert graph.dfs(edges, "a", 3) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert _pairs(graph.distances(edges, "a"), "node", "distance") == {("a", 0.0), ("b", 1.0), ("c", 2.0), ("d", 3.0)}
    assert graph.lightest_path(edges, "a", "c") == (2.0, ["a", "b", "c"]) and graph.lightest_path(edges, "a", "y") is None and graph.lightest_path(edges, "a", "a") == (0.0, ["a"])


def test_lightest_paths_are_those_of_a_heap(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(25), rng.randrange(25), float(rng.randrange(10))) for _ in range(80)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    far, todo = {}, [(0.0, 0)]
    while todo:
        d, v = heapq.heappop(todo)
        if far.setdefault(v, d) == d:
            todo += [(d + w, b) for a, b, w in rows if a == v and b not in far]
            heapq.heapify(todo)
    assert {r["node"]: r["distance"] for r in graph.distances(edges, 0).collect()} == far
    for goal in sorted(far)[1::7]:
        length, path = graph.lightest_path(edges, 0, goal)
        least = {(a, b): min(w for x, y, w in rows if (x, y) == (a, b)) for a, b in zip(path, path[1:], strict=False)}
        assert length == far[goal] == sum(least.values()) and path[0] == 0 and path[-1] == goal


def test_distances_never_stop_short_in_silence(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(4)] + [(0, 4, 9.0)], "src long, dst long, weight double")
    far = {(i, float(i)) for i in range(5)}
    assert _pairs(graph.distances(chain, 0), "node", "distance") == _pairs(graph.distances(chain, 0, max_rounds=5), "node", "distance") == far
    with pytest.raises(ValueError, match="3 rounds"):
        graph.distances(chain, 0, max_rounds=3)


def test_pagerank_sums_to_one(edges):
    ranks = dict(_pairs(graph.pagerank(edges, 10), "node", "rank"))
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["d"] > ranks["a"]


def louvain(rows):
    """One node after the other, level by level."""
    near = defaultdict(lambda: defaultdict(float))
    for s, d, w in rows:
        near[s][d] += w
        if s != d:
            near[d][s] += w
    member = {v: v for v in near}
    graph = near
    while True:
        of = {v: v for v in graph}
        strength = {v: sum(graph[v].values()) + graph[v].get(v, 0.0) for v in graph}
        total = dict(strength)
        all_ = sum(strength.values()) or 1.0
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in sorted(graph, key=str):
                links = defaultdict(float)
                for u, w in graph[v].items():
                    if u != v:
                        links[of[u]] += w
                total[of[v]] -= strength[v]
                gain = lambda c, v=v, links=links: links.get(c, 0.0) - strength[v] * total.get(c, 0.0) / all_
                best = max([of[v], *sorted(links, key=str)], key=gain)
                if best != of[v] and gain(best) > gain(of[v]) + 1e-12:
                    of[v], moved, moved_any = best, True, True
                total[of[v]] = total.get(of[v], 0.0) + strength[v]
        if not moved_any:
            break
        member = {v: of[c] for v, c in member.items()}
        merged = defaultdict(lambda: defaultdict(float))
        for v, out in graph.items():
            for u, w in out.items():
                merged[of[v]][of[u]] += w if of[v] != of[u] else w / 2 if u != v else w
        graph = merged
    numbers = {c: i for i, c in enumerate(sorted(set(member.values()), key=str))}
    return {v: numbers[c] for v, c in member.items()}


def quality(rows, of):
    total = 2 * sum(w for *_, w in rows)
    held = defaultdict(float)
    for a, b, w in rows:
        held[of[a]] += w
        held[of[b]] += w
    return 2 * sum(w for a, b, w in rows if of[a] == of[b]) / total - sum((h / total) ** 2 for h in held.values())


def test_communities(spark):
    rng = random.Random(8)
    rows = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "pqrs" for i in range(7) for j in range(i) if rng.random() < 0.8] + [(f"{a}0", f"{b}{i}", 1.0) for a, b, i in (("p", "q", 0), ("q", "r", 3), ("r", "s", 5), ("s", "p", 2))] + [("p1", "p1", 1.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    found = {r["node"]: r["community"] for r in graph.communities(edges).collect()}
    assert found.keys() == {v for a, b, _ in rows for v in (a, b)}
    assert quality(rows, found) >= quality(rows, louvain(rows)) - 1e-9
    assert len({found[f"p{i}"] for i in range(7)}) == 1 and found["p1"] != found["q1"]
    assert graph.communities(edges.limit(0)).count() == 0


def test_entities(spark, edges):
    nodes = spark.createDataFrame([(n, n.upper() + "%", "T") for n in "abcd"], "node string, name string, type string")
    assert [r["node"] for r in graph.search_entities(nodes, "B%").collect()] == ["b"] and graph.search_entities(nodes, "b", "U").count() == 0
    assert _pairs(graph.neighbours(edges, nodes, "c"), "node", "direction") == {("b", "incoming"), ("a", "incoming"), ("d", "outgoing")}
    assert _pairs(graph.relations_of(edges, nodes, "c"), "src", "dst") == {("b", "c"), ("a", "c"), ("c", "d")}
    assert graph.clamp_depth(0) == 1 and graph.clamp_depth(99) == 10


def test_names_by_their_pieces(spark, tmp_path):
    rng = random.Random(12)
    names = ["".join(rng.choice("abÄß%_ ") for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    nodes = spark.createDataFrame([(f"n{i}", n, "ST"[i % 2]) for i, n in enumerate(names)] + [("null", None, "S")], "node string, name string, type string")
    index = trigrams.NameIndex.build(nodes, f"file://{tmp_path}/ix", 4)
    for text in ("", "a", "AB", "ab%", "äß", "ß_a", "b a", "nothing", "aba"):
        for kind in (None, "S"):
            assert index.search(text, kind, 100).collect() == graph.search_entities(nodes, text, kind, 100).collect(), text
    piece, n = index.candidates("ab%a")
    counts = {p: sum(p in x.lower() for x in names) for p in ("ab%", "b%a")}
    assert n == counts[piece] == min(counts.values())
    scans = [x for x in index.search("ab%")._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert len(scans) == 1 and re.search(r"PartitionFilters: \[[^\]]*bucket", index.search("ab%")._jdf.queryExecution().simpleString()) is not None and "EqualTo(piece" in scans[0]
