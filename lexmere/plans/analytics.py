"""Registered queries of the vector index, the sketches, as-of joins and recursive SQL, with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexmere.operators import ann, graph, sketches, temporal, trigrams
from lexmere.plans.registry import query, read
from lexmere.sources.staging import shared_folder, staged


def _vectors(spark, d):
    """The index of all embeddings, and every vector whose id is divisible by 50."""
    table = read(spark, d, "embeddings")
    index = ann.VectorIndex.build(table, f"{shared_folder(spark)}/ann-{uuid.uuid4().hex}", "vec_id", "embedding", carry=["label"])
    asked = [(r["vec_id"], list(r["embedding"])) for r in table.filter("vec_id % 50 = 0 and embedding is not null").orderBy("vec_id").collect()]
    return table, index, asked


@query()
def vector_ann_topk(spark, d):
    """The ten nearest rows of each asked vector by the index: built, probed, ranked again by whole vectors."""
    _, index, asked = _vectors(spark, d)
    ids = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(asked)], "query int, asked_id long")
    return index.search([v for _, v in asked], 10).join(F.broadcast(ids), "query").select("asked_id", "vec_id", "score", "rank")


@query("select count(*) as asked, 10 * count(*) as rows, true as enough from embeddings where vec_id % 50 = 0")
def vector_ann_recall(spark, d):
    """Whether the index finds at least 0.9 of the true ten neighbours of the asked vectors; a tie with the tenth counts as found."""
    table, index, asked = _vectors(spark, d)
    found = staged(index.search([v for _, v in asked], 10), "ann-found")
    whole = staged(ann.exact_topk(table, [v for _, v in asked], 10, "vec_id", "embedding"), "ann-exact")
    tenth = whole.groupBy("query").agg(F.min("score").alias("least"))
    hits = found.join(F.broadcast(tenth), "query").agg(F.count_if(F.col("score") >= F.col("least")).alias("hits"), F.count("*").alias("rows"))
    n = len(asked)
    return hits.select(F.lit(n).cast("long").alias("asked"), "rows", (F.col("hits") >= 0.9 * 10 * n).alias("enough"))


_SPEC = sketches.Spec(distinct=("user_id",), quantile=("value",), frequent=("user_id",))


def _daily(spark, d):
    """The summaries of events by type and day, stored, and read back."""
    store = sketches.Store(f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}", ["event_type"], _SPEC)
    store.write(read(spark, d, "events"), "ts")
    return store


@query("select event_type, count(*) as n, count(distinct user_id) as users, true as near from events group by 1")
def sketch_distinct(spark, d):
    """Users by type of event from the stored days; near: whether the estimate is within its bound of the true number."""
    true = read(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    merged = _daily(spark, d).read(spark).select("event_type", "n", sketches.distinct("user_id").alias("estimate"))
    return merged.join(true, "event_type").select("event_type", "n", "users", (F.abs(F.col("estimate") - F.col("users")) <= sketches.DISTINCT_ERROR * F.col("users") + 1).alias("near"))


@query("select event_type, share, true as near from (select distinct event_type from events), (select unnest([0.1, 0.5, 0.9, 0.99]) as share)")
def sketch_quantiles(spark, d):
    """Four quantiles by type of event from the stored days; near: whether the true rank of each is within the bound."""
    shares = [0.1, 0.5, 0.9, 0.99]
    merged = _daily(spark, d).read(spark).select("event_type", F.explode(F.array(*[F.struct(F.lit(s).alias("share"), sketches.quantile("value", s).alias("at")) for s in shares])).alias("q")).select("event_type", "q.*")
    e = read(spark, d, "events").filter("value is not null")
    held = e.join(F.broadcast(merged), "event_type").groupBy("event_type", "share").agg(F.avg((F.col("value") <= F.col("at")).cast("double")).alias("upto"), F.avg((F.col("value") < F.col("at")).cast("double")).alias("under"))
    near = (F.col("under") - sketches.RANK_ERROR <= F.col("share")) & (F.col("share") <= F.col("upto") + sketches.RANK_ERROR)
    return held.select("event_type", "share", near.alias("near"))


@query("select event_type, user_id, n from (select event_type, user_id, count(*) as n, rank() over (partition by event_type order by count(*) desc) as r from events group by 1, 2) where r <= 3")
def sketch_frequent(spark, d):
    """The users met most often by type of event, those that tie with the third included: from the stored days, and for types of more users than they hold from the events."""
    return sketches.top(_daily(spark, d).read(spark), read(spark, d, "events"), ["event_type"], "user_id", 3).withColumnRenamed("count", "n")


@query("select count(*) as customers, true as whole, true as few from customer where c_custkey in (select o_custkey from orders)")
def sketch_membership(spark, d):
    """Customers with orders by a filter of the orders' keys, made of two halves: none is missed (whole), few others pass."""
    orders, customers = read(spark, d, "orders"), read(spark, d, "customer")
    expected = orders.select("o_custkey").distinct().count()
    halves = [sketches.membership(orders.filter(F.col("o_orderkey") % 2 == i), "o_custkey", expected) for i in range(2)]
    met = sketches.maybe_members(customers.select("c_custkey"), "c_custkey", sketches.merged_membership(halves[0].unionByName(halves[1])), expected)
    true = orders.select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("real")).distinct()
    joined = customers.select("c_custkey").join(true, "c_custkey", "left").join(met.withColumn("met", F.lit(True)), "c_custkey", "left")
    real, hit = F.coalesce("real", F.lit(False)), F.coalesce("met", F.lit(False))
    return joined.agg(F.count_if(real).alias("customers"), F.bool_and(~real | hit).alias("whole"), (F.count_if(~real & hit) <= 5 + 0.03 * F.count("*")).alias("few"))


_BUYS, _VIEWS = "(select event_id, user_id, ts from events where event_type = 'purchase')", "(select event_id, user_id, ts, value from events where event_type = 'view')"


def _sides(spark, d):
    e = read(spark, d, "events")
    return e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'").select("event_id", "user_id", "ts", "value")


@query(f"select b.event_id, b.user_id, v.event_id as view_id, v.value as view_value from {_BUYS} b asof left join {_VIEWS} v on b.user_id = v.user_id and b.ts >= v.ts")
def asof_left(spark, d):
    """Each purchase with its user's last view before it, or none."""
    out = temporal.asof_join(*_sides(spark, d), ["user_id"], "ts", "ts", width=86_400, take=["event_id", "value"], prefix="view_", ties=["event_id"])
    return out.select("event_id", "user_id", F.col("view_event_id").alias("view_id"), "view_value")


@query(f"select b.event_id, v.event_id as view_id from {_BUYS} b asof join {_VIEWS} v on b.user_id = v.user_id and b.ts > v.ts where b.ts - v.ts <= interval 12 hours")
def asof_within(spark, d):
    """Purchases with a view of the same user in the twelve hours before."""
    out = temporal.asof_join(*_sides(spark, d), ["user_id"], "ts", "ts", width=43_200, take=["event_id"], strict=True, tolerance=43_200, how="inner", prefix="view_")
    return out.select("event_id", F.col("view_event_id").alias("view_id"))


@query("select o.o_orderkey, p.o_orderkey as previous from orders o asof left join orders p on o.o_custkey = p.o_custkey and o.o_orderkey > p.o_orderkey")
def asof_numbers(spark, d):
    """Each order with its customer's order before it, by number."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return temporal.asof_join(o, o, ["o_custkey"], "o_orderkey", "o_orderkey", width=20_000, take=["o_orderkey"], strict=True, prefix="p_").select("o_orderkey", F.col("p_o_orderkey").alias("previous"))


@query("""with pieces as (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as p from (select doc_id, list_filter(list_transform(string_split_regex(trim(text, chr(10) || chr(9) || ' ' || chr(13)), '\n\n+'), lambda x: trim(x, chr(10) || chr(9) || ' ' || chr(13))), lambda x: x != '') as l from documents))
select doc_id, count(*) as paragraphs, sum(length(p))::bigint as chars from pieces group by 1""")
def lateral_chunks(spark, d):
    """A table function in a lateral join: chunk_text with room for one paragraph, as SQL text."""
    from lexmere.functions import tables

    tables.register(spark)
    read(spark, d, "documents").select("doc_id", "text").createOrReplaceTempView("docs")
    return spark.sql("select d.doc_id, count(*) as paragraphs, sum(length(c.text)) as chars from docs d, lateral chunk_text(d.text, 1) c group by d.doc_id")


@query("select 's' || s_suppkey as node, s_name as name, 'supplier' as type from supplier where contains(lower(s_name), '0001') or contains(lower(s_name), 'ier#00000009') order by name, node limit 100")
def entity_search_index(spark, d):
    """Suppliers by parts of their names, through the index of three-letter pieces."""
    names = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"))
    index = trigrams.NameIndex.build(names, f"{shared_folder(spark)}/names-{uuid.uuid4().hex}", 8)
    return index.search("0001", limit=100).unionByName(index.search("IER#00000009", "supplier", limit=100)).distinct().orderBy("name", "node").limit(100)


@query()
def graph_communities(spark, d):
    """Groups of regions, nations and suppliers, by modularity."""
    from lexmere.plans.catalog import _graph

    return graph.communities(_graph(spark, d)[1])


@query("select 'found' as way, 3 as nodes from supplier join nation on s_nationkey = n_nationkey where s_suppkey = 1")
def graph_lightest_path(spark, d):
    """The lightest way from a supplier to its region, by the distances' predecessors."""
    from lexmere.plans.catalog import _graph

    _, edges = _graph(spark, d)
    s = read(spark, d, "supplier").filter("s_suppkey = 1").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).head()
    found = graph.lightest_path(edges, "s1", f"r{s['n_regionkey']}")
    return spark.createDataFrame([("found" if found and found[1][1] == f"n{s['s_nationkey']}" else "lost", len(found[1]))], "way string, nodes int")
