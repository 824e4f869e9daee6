"""SQL by text: what the guard refuses, and writes against the same statements by hand."""

import uuid

import pytest
from pyspark.sql import functions as F

from lexmere.api import KnowledgeBase
from lexmere.operators import relational, sql


@pytest.fixture
def tables(spark):
    spark.range(3).createOrReplaceTempView("secretview")
    return {"t": spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string"), "u": spark.createDataFrame([(2, "x")], "i int, s string")}


@pytest.mark.parametrize("bad", [
    "select IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')",
    "select * from IDENTIFIER('secretview')",
    "select * from secretview where exists (with secretview as (select 1) select 1)",
    "select * from t where exists (with secretview as (select 1) select 1) and i in (select id from secretview)",
    "with `parquet.abc` as (select 1) select * from parquet.abc",
    "with parquet as (select 1) select * from parquet.`/etc`",
    "with a as (select * from b), b as (select 1) select * from a",
    "with secretview as (select * from secretview) select * from secretview",
    "select * from default.t", "select * from spark_catalog.default.t", "select input_file_name() from t", "select current_user()", "select from_protobuf(s, 'm', '/etc/x') from t",
    "select xpath(s, 'a') from t", "select a.b.upper(s) from t", "select system.builtin.reflect('a', 'b') from t", "select * from t lateral view java_method('a', 'b') x", "select made_up(s) from t",
    "select * from python_worker_logs()", "select * from t, lateral (select * from secretview)", "from t insert into u select *", "table secretview", "explain select 1", "cache table t", "select * from t version as of 1",
])
def test_the_guard_refuses(spark, tables, bad):
    with pytest.raises(ValueError):
        sql.check_query(spark, bad, tables)


@pytest.mark.parametrize("good", [
    "with a as (select i from t), b as (select i from a) select * from b join u using (i)", "with recursive w(n) as (select 1 union all select n + 1 from w where n < 5) select * from w",
    "select * from t where exists (with u as (select 1 as z) select z from u) and i in (select i from u)", "select t.i, x.m from t, lateral (select max(i) as m from u where u.i = t.i) x",
    "select i, upper(s), count(*) over (partition by s), transform(array(i), v -> v + 1) from t", "select * from t lateral view explode(array(1, 2)) e as x", "select s, approx_top_k(i, 2) from t group by s", "select `i`, 'select reflect()' from T -- reflect()",
])
def test_the_guard_allows(spark, tables, good):
    sql.check_query(spark, good, tables)
    for n, df in tables.items():
        df.createOrReplaceTempView(n)
    spark.sql(good).collect()


def test_tag_ids_are_those_of_python(spark):
    row = spark.createDataFrame([("t", "né")], "a string, b string").select(relational.tag_id_of(F.col("a"), F.col("b"))).head()
    assert row[0] == uuid.uuid5(uuid.NAMESPACE_OID, "t/né").hex


def test_writes_by_text(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    other = KnowledgeBase(spark, f"file://{tmp_path}/kb", tenant="other")
    assert other.sql_execute("insert into tags (name, color) values ('urgent', 'blue')") == {"affected_rows": 1}
    assert kb.sql_execute("insert into tags (name, color) values ('urgent', 'red'), (:n, 'green')", {"n": "it's; drop"}) == {"affected_rows": 2}
    kb.add_tag("urgent", "pink")  # the same tag, by its id
    assert kb.sql_query("select name, color from tags order by name")["rows"] == [{"name": "it's; drop", "color": "green"}, {"name": "urgent", "color": "pink"}]
    assert kb.sql_execute("insert into metadata (key, value, doc_id) select name, color, null from tags") == {"affected_rows": 2}
    assert kb.sql_execute("insert into metadata (key, value, doc_id) values (?, ?, ?)", ["k", "v", "d"]) == {"affected_rows": 1}
    assert kb.sql_execute("update metadata m set value = upper(value), doc_id = 'e' where m.doc_id = 'd' or key in (select name from tags where color = 'green')") == {"affected_rows": 2}
    assert kb.get_metadata(doc_id="e") == {"k": "V", "it's; drop": "GREEN"} and kb.get_metadata() == {"urgent": "pink"}
    merge = """merge into metadata m using (select 'k' as key, 'new' as value, 'e' as doc_id union all select 'urgent', 'gone', null union all select 'fresh', 'f', 'e') s
        on m.key = s.key and m.doc_id <=> s.doc_id when matched and s.value = 'gone' then delete when matched then update set value = s.value when not matched then insert (key, value, doc_id) values (s.key, s.value, s.doc_id)"""
    versions = len(kb.list_versions())
    assert kb.sql_execute(merge) == {"affected_rows": 3} and len(kb.list_versions()) == versions + 1
    assert kb.get_metadata() == {} and kb.get_metadata(doc_id="e") == {"k": "new", "it's; drop": "GREEN", "fresh": "f"}
    assert kb.sql_execute("delete from metadata where doc_id = 'nobody'") == {"affected_rows": 0} and len(kb.list_versions()) == versions + 1
    assert kb.sql_execute("delete from tags where name = 'urgent'") == {"affected_rows": 1}
    assert other.sql_query("select name, color from tags")["rows"] == [{"name": "urgent", "color": "blue"}]


@pytest.mark.parametrize("bad", [
    "delete from tags", "update tags set color = 'x'", "delete from tags where true", "drop table tags", "insert into events (event_id) values ('x')", "insert overwrite tags select * from tags", "update tags set tenant_id = 'other' where name = 'a'",
    "insert into tags (name, tenant_id) values ('x', 'other')", "insert into tags (color) values ('x')", "insert into tags (name) values ('a')", "insert into tags (name) values ('n'), ('n')", "insert into tags (name, color) values ('x')",
    "insert into tags (name, nope) values ('x', 'y')", "insert into tags (name) select id from secretview", "update tags set name = 'b' where name = 'a'", "update tags set color = reflect('a', 'b') where name = 'a'", "delete from tags where name in (select id from secretview)",
    "merge into tags t using (select 'a' as name union all select 'a') s on t.name = s.name when matched then update set color = 'z'", "merge into tags t using tags s on t.name = s.name when not matched by source then delete",
    "insert into parquet.`/tmp/x` values (1)", "select 1", "insert into metadata (key, doc_id) values (null, 'd')", "insert into documents (source) values ('x')", "nonsense",
])
def test_writes_that_are_refused(spark, tmp_path_factory, refusing, bad):
    before = refusing.list_versions()
    assert "error" in refusing.sql_execute(bad) and refusing.list_versions() == before


@pytest.fixture(scope="module")
def refusing(spark, tmp_path_factory):
    spark.range(3).createOrReplaceTempView("secretview")
    kb = KnowledgeBase(spark, f"file://{tmp_path_factory.mktemp('kb')}/kb")
    kb.add_tag("a")
    kb.add_tag("b")
    return kb
