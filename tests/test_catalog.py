import pytest
from conftest import same

from lexmere.plans import catalog

#: Kept out of the small run: the same operators run in other tests.
SLOW = {"graph_pagerank", "graph_distances"}


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_query_matches_its_oracle(spark, sf_dir, duck, name):
    same(catalog.queries()[name](spark, sf_dir).toPandas(), duck.sql(catalog.oracle_sql()[name]).df())


#: Queries whose small table is too small to tell: on the next size as well.
LARGER = ["rrf_floor_exclusion", "rrf_fusion", "hybrid_search", "vector_ann_recall", "sketch_quantiles", "asof_left", "entity_search_index", "chunk_code_braces"]


@pytest.mark.parametrize("name", LARGER)
def test_query_matches_its_oracle_on_more_rows(spark, sf_dir, name):
    import duckdb

    d = sf_dir.replace("sf0.001", "sf0.01")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    same(catalog.queries()[name](spark, d).toPandas(), c.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_plans_push_down_and_prune(spark, sf_dir):
    plan = catalog.queries()["stats_by_type"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lang:string,n_chars:bigint>" in plan
    top = catalog.queries()["vector_topk_cosine"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top and "Exchange" not in top
    near = catalog.queries()["graph_neighbors"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in near and "Cartesian" not in near


def test_entry_registers_everything():
    import __spark_entry__ as e

    assert "hybrid_search" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
