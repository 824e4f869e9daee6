"""Vector index, sketches and as-of joins: recall, bounds, brute force, and the plans."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmere.operators import ann, sketches, temporal


def vectors_of(spark, n, seed, dim=16, clusters=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if clusters:
        x = x * 0.3 + rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)]
    return x.astype(np.float32), spark.createDataFrame([(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)], "id long, v array<float>, kind int").repartition(3)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_the_index_finds_most_neighbours(spark, tmp_path, metric):
    x, table = vectors_of(spark, 3_000, 1, clusters=20)
    index = ann.VectorIndex.build(table, f"file://{tmp_path}/ix", "id", "v", metric, carry=["kind"])
    asked = [row.tolist() for row in x[::50]]
    exact = {(r["query"], r["id"]): r["score"] for r in ann.exact_topk(table, asked, 10, "id", "v", metric).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = -(unit[0] @ unit.T) if metric == "cosine" else np.linalg.norm(x - x[0], axis=1)
    assert {i for q, i in exact if q == 0} == set(np.argsort(true, kind="stable")[:10].tolist())
    found = {(r["query"], r["id"]): r["score"] for r in index.search(asked, 10).collect()}
    assert len(found) == 10 * len(asked) and len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(abs(found[k] - exact[k]) < 1e-5 for k in found.keys() & exact.keys())
    assert index.probes < len(index.quantizer.centers) / 2
    few = index.search(asked[:1], 5, filters={"kind": [1, 2]}).collect()
    assert len(few) == 5 and all(r["id"] % 3 for r in few)


def test_the_index_reads_probed_cells_only(spark, tmp_path):
    x, table = vectors_of(spark, 2_000, 2)
    index = ann.VectorIndex.build(table, f"file://{tmp_path}/ix", "id", "v", cells=32)
    plan = index.search([x[0].tolist()], 5, probes=3)
    scans = [line for line in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [cell" in line for line in scans)
    near = [line for line in scans if "code" in line.split("ReadSchema")[1]]
    assert near and all("vector" not in line.split("ReadSchema")[1] for line in near)
    cells = index.quantizer.cells(index.quantizer.shaped(x))
    chosen = np.argsort(-(index.quantizer.shaped(x[:1]) @ index.quantizer.centers.T - (index.quantizer.centers**2).sum(axis=1) / 2))[0][:3]
    assert all(cells[r["id"]] in chosen for r in plan.collect())


def test_rows_come_and_go(spark, tmp_path):
    x, table = vectors_of(spark, 500, 3)
    index = ann.VectorIndex.build(table.filter("id < 400"), f"file://{tmp_path}/ix", "id", "v", cells=8)
    ask = lambda i: [r["id"] for r in index.search([x[i].tolist()], 3, probes=8).collect()]
    assert ask(450)[0] != 450
    index.append(table.filter("id >= 400"), "v")
    assert ask(450)[0] == 450
    index.delete(spark.createDataFrame([(450,)], "id long"))
    assert 450 not in ask(450) and ann.VectorIndex(spark, f"file://{tmp_path}/ix").search([], 3).count() == 0
    assert ann.VectorIndex.build(table.filter("false"), f"file://{tmp_path}/none", "id", "v") is None
    same = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(9)] + [(9, None)], "id long, v array<float>")
    assert len(ann.VectorIndex.build(same, f"file://{tmp_path}/same", "id", "v").search([[1.0, 0.0]], 20).collect()) == 9


def test_halves_merge_to_the_whole(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(f"g{rng.randrange(3)}", rng.randrange(900), rng.choice([None, rng.random()]), rng.randrange(2)) for _ in range(6_000)], "g string, who long, x double, half int")
    spec = sketches.Spec(distinct=["who"], quantile=["x"], frequent=["who"], tracked=1_024)
    halves = sketches.summarize(rows, ["g", "half"], spec)
    look = lambda s: {r["g"]: r for r in s.select("g", "n", sketches.distinct("who").alias("d"), sketches.quantile("x", 0.5).alias("q"), sketches.rank("x", 0.25).alias("r"), sketches.frequent("who", 900).alias("f")).collect()}
    merged, whole = look(sketches.merge(halves, ["g"], spec)), look(sketches.summarize(rows, ["g"], spec))
    for g, a in merged.items():
        mine = [r for r in rows.filter(F.col("g") == g).collect()]
        counts = {}
        for r in mine:
            counts[r["who"]] = counts.get(r["who"], 0) + 1
        xs = sorted(r["x"] for r in mine if r["x"] is not None)
        assert a["n"] == whole[g]["n"] == len(mine) and a["d"] == whole[g]["d"] and abs(a["d"] - len(counts)) <= sketches.DISTINCT_ERROR * len(counts)
        assert abs(bisect.bisect(xs, a["q"]) / len(xs) - 0.5) <= sketches.RANK_ERROR and abs(a["r"] - bisect.bisect(xs, 0.25) / len(xs)) <= sketches.RANK_ERROR
        assert {f["item"]: f["count"] for f in a["f"]} == counts
    empty = sketches.merge(sketches.summarize(rows.limit(0), ["g"], spec), ["g"], spec)
    assert empty.count() == 0


def test_stored_days(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{1 + i % 4} 10:00:00", i % 2, i) for i in range(200)], "ts string, g int, who long").withColumn("ts", F.to_timestamp("ts"))
    spec = sketches.Spec(distinct=["who"])
    store = sketches.Store(f"file://{tmp_path}/s", ["g"], spec)
    store.write(rows, "ts")
    store.write(rows.filter("day(ts) = 2").limit(1), "ts")  # the day again, with one row
    got = {r["g"]: (r["n"], r["d"]) for r in store.read(spark, "2024-01-02", "2024-01-03").select("g", "n", sketches.distinct("who").alias("d")).collect()}
    assert sum(n for n, _ in got.values()) == 51 and all(abs(n - d) <= 2 for n, d in got.values())
    plan = store.read(spark, "2024-01-02", "2024-01-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_frequent_users_whatever_their_number(spark, tmp_path):
    """4,096 users are tracked; up to 6,144 still fit a sketch, but not its list, and of more that are alike it lists none."""
    import duckdb
    from conftest import same

    from lexmere.plans import catalog

    users = {"few": 40, "tracked": 4_096, "fit": 5_000, "many": 9_000, None: 7_000}
    rows = [(t, u) for t, n in users.items() for u in range(n)]
    rows += [(t, u) for t in ("few", "many", None) for u in (3, 3, 5, 7, 8)] + [("many", None)] * 2 + [("few", None)] * 9 + [("none", None)] * 2
    events = spark.createDataFrame([(i, t, u, float(i % 7)) for i, (t, u) in enumerate(rows)], "event_id long, event_type string, user_id long, value double")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") % 5 * 86_400)
    c = duckdb.connect()
    for d, table in (("all", events), ("empty", events.limit(0))):
        table.withColumn("ts", ts).write.parquet(f"{tmp_path}/{d}/events.parquet")
        c.execute(f"create or replace view events as select * from '{tmp_path}/{d}/events.parquet/*.parquet'")
        want = c.sql(catalog.oracle_sql()["sketch_frequent"]).df()
        assert len(want) == (4_096 + 5_000 + 5 + 5 + 4 + 1 if d == "all" else 0)
        same(catalog.queries()["sketch_frequent"](spark, f"{tmp_path}/{d}").toPandas(), want)


def test_top_reads_rows_only_for_groups_beyond_the_sketch(spark):
    rows = spark.createDataFrame([("a", i % 50) for i in range(2_000)] + [("b", i % 3_000) for i in range(3_001)], "g string, who long")
    summaries = sketches.summarize(rows, ["g"], sketches.Spec(distinct=["who"], frequent=["who"], tracked=1_024))
    found = lambda r: sorted(map(tuple, sketches.top(summaries, r, ["g"], "who", 1, 1_024).collect()))
    assert found(rows) == [("a", i, 40) for i in range(50)] + [("b", 0, 2)]
    assert found(rows.filter("g = 'b'")) == found(rows) and found(rows.filter("g = 'a'")) == [("a", i, 40) for i in range(50)]


def test_membership_misses_nothing(spark):
    inside = spark.range(5_000).select((F.col("id") * 7).alias("k"))
    bits = sketches.merged_membership(sketches.membership(inside.filter("k % 2 = 0"), "k", 5_000).unionByName(sketches.membership(inside.filter("k % 2 = 1"), "k", 5_000)))
    asked = spark.range(20_000).withColumnRenamed("id", "k").unionByName(spark.createDataFrame([(None,)], "k long"))
    met = {r["k"] for r in sketches.maybe_members(asked, "k", bits, 5_000).collect()}
    true = set(range(0, 20_000, 7))
    assert true <= met and len(met - true) < 0.02 * 20_000


@pytest.mark.parametrize("strict, tolerance, how", [(False, None, "left"), (True, None, "left"), (False, 7, "inner"), (True, 3, "left")])
def test_asof_is_brute_force(spark, strict, tolerance, how):
    rng = random.Random(5)
    side = lambda n: [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.choice([None, *range(-50, 50)]), i) for i in range(n)]
    left, right = side(300), side(200)
    frame = lambda rows, v: spark.createDataFrame(rows, f"k string, t long, {v} int")
    got = temporal.asof_join(frame(left, "x"), frame(right, "y"), ["k"], "t", "t", width=7, take=["y", "t"], strict=strict, tolerance=tolerance, how=how, ties=["y"])
    want = []
    for k, t, x in left:
        before = [(rt, y) for rk, rt, y in right if None not in (k, t, rk, rt) and rk == k and (rt < t if strict else rt <= t)]
        rt, y = max(before, default=(None, None))
        if rt is not None and tolerance is not None and t - rt > tolerance:
            rt = y = None
        if rt is not None or how == "left":
            want.append((k, t, x, y, rt))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_asof_without_keys_and_with_times(spark):
    ts = lambda *s: spark.createDataFrame([(x,) for x in s], "t string").select(F.to_timestamp("t").alias("t"))
    left, right = ts("2024-01-01 00:00:00", "2024-01-05 12:00:00", "2023-12-31 23:59:59"), ts("2024-01-01 00:00:00", "2024-01-03 00:00:00").withColumn("v", F.day("t"))
    got = {str(r["t"]): r["right_v"] for r in temporal.asof_join(left, right, [], "t", "t", width=3_600, take=["v"]).collect()}
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-05 12:00:00": 3, "2023-12-31 23:59:59": None}
    ntz = {str(r["t"]): r["right_v"] for r in temporal.asof_join(*(d.withColumn("t", F.col("t").cast("timestamp_ntz")) for d in (left, right)), [], "t", "t", width=3_600, take=["v"], tolerance=86_400 * 3).collect()}
    assert ntz == got
    assert temporal.asof_join(left, right.limit(0), [], "t", "t", width=10).filter("right_v is not null").count() == 0
