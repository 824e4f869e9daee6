"""SQL as users write it: checked to be a query, then run as it is over views of the tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmere.operators.sql import check_query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Steps of a recursion that Spark takes at most, and rows, without limit here: the texts have bounds of their own.
RECURSION = {"spark.sql.cteRecursionLevelLimit": "100", "spark.sql.cteRecursionRowLimit": "-1"}
_WAYS = """ways as (select concat('n', cast(n_nationkey as varchar(20))) as src, concat('r', cast(n_regionkey as varchar(20))) as dst from nation union all select concat('r', cast(n_regionkey as varchar(20))), concat('n', cast(n_nationkey as varchar(20))) from nation
union all select concat('s', cast(s_suppkey as varchar(20))), concat('n', cast(s_nationkey as varchar(20))) from supplier union all select concat('n', cast(s_nationkey as varchar(20))), concat('s', cast(s_suppkey as varchar(20))) from supplier)"""

SQL = {
    "sql_recursive_walks": f"with recursive {_WAYS}, walk as (select 'n3' as node, '/n3/' as path, 0 as depth union all select dst, concat(path, dst, '/'), depth + 1 from walk join ways on src = node where depth < 4 and path not like concat('%/', dst, '/%')) select node, path, depth from walk",
    "sql_recursive_closure": f"with recursive {_WAYS}, up as (select src as node, dst as above, 1 as depth from ways where src like 's%' or dst like 'r%' union all select node, dst, depth + 1 from up join ways on src = above where depth < 10 and dst like 'r%') select node, above, min(depth) as depth from up group by node, above",
    "sql_recursive_parts": "with recursive tree as (select p_partkey as root, p_partkey as part, p_retailprice as price, 1 as times, 0 as depth from part union all select root, p_partkey, p_retailprice, times * cast(1 + p_size % 2 as int), depth + 1 from tree join part on cast(floor(p_partkey / 3.0) as bigint) = part and p_partkey > part where depth < 20) select root, count(*) as parts, max(depth) as depth, round(sum(price * times), 2) as cost from tree group by root",
    "sql_lateral": "select n_name, t.s_suppkey, t.best from nation, lateral (select s_suppkey, max(s_acctbal) as best from supplier where s_nationkey = n_nationkey and s_acctbal > n_nationkey group by s_suppkey) t",
    "sql_lateral_left": "select c_custkey, t.orders, t.spent from customer left join lateral (select count(*) as orders, round(sum(o_totalprice), 2) as spent from orders where o_custkey = c_custkey and o_orderstatus = 'F') t on true",
    "sql_join3": "select n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name",
    "sql_pricing_summary": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by l_returnflag, l_linestatus",
    "sql_window_rank": "select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r, dense_rank() over (partition by o_custkey order by o_orderstatus) as dr from orders",
    "sql_window_frame": "select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as running from orders",
    "sql_setops": "select n_regionkey as k from nation union select c_nationkey from customer intersect select s_nationkey from supplier except select 3",
    "sql_cube": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)",
    "sql_rollup": "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())",
    "sql_semi_anti": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000) and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')",
    "sql_correlated": "select p_partkey, p_retailprice from part p where p_retailprice > (select avg(p_retailprice) * 1.05 from part q where q.p_brand = p.p_brand)",
    "sql_full_outer": "select coalesce(c_nationkey, s_nationkey) as nation, customers, suppliers from (select c_nationkey, count(*) as customers from customer group by c_nationkey) c full join (select s_nationkey, count(*) as suppliers from supplier group by s_nationkey) s on c_nationkey = s_nationkey",
    "sql_case_like": "select case when p_type like '%BRASS%' then 'brass' else 'other' end as metal, count(*) as n, min(p_size) as small, max(p_size) as large from part group by 1",
    "sql_having": "select l_suppkey, count(distinct l_partkey) as parts from lineitem group by l_suppkey having count(distinct l_partkey) > 10",
    "sql_cte": "with big as (select o_custkey, sum(o_totalprice) as spent from orders group by o_custkey), top as (select max(spent) as most from big) select o_custkey, round(spent, 2) as spent from big, top where spent > most * 0.5",
    "sql_filter_agg": "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o, round(avg(o_totalprice), 2) as mean from orders group by o_orderpriority",
}


def runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        check_query(spark, text, names)
        if "recursive" in text:
            for name, value in RECURSION.items():
                spark.conf.set(name, value)
        for t in names:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    return run
