"""Registered queries of the knowledge base's own steps: file types, chunkers on nested and long texts, recorded extractions, keys that
expire, relations among visited nodes, writes by SQL text; with the SQL that says the same."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lexmere.functions import text, vectors
from lexmere.operators import chunking, extraction, graph, relational, search, sql
from lexmere.plans.registry import query, read
from lexmere.sources import files
from lexmere.streaming import events as ev
from lexmere.streaming import stateful

_ENDINGS = (".py", ".JS", ".md", ".rst", ".txt", ".go", "", ".unknown")


@query(f"""with p as (select doc_id, 'in/' || source || '/' || doc_id || list_extract([{', '.join(f"'{e}'" for e in _ENDINGS)}], (doc_id % 8 + 1)::int) as path, doc_id % 16 = 6 as led from documents)
select doc_id, case doc_id % 8 when 0 then '.py' when 1 then '.js' when 2 then '.md' when 3 then '.rst' when 4 then '.txt' when 5 then '.go' when 6 then '' else '.unknown' end as extension,
case doc_id % 8 when 0 then 'python' when 1 then 'javascript' when 5 then 'go' else case when led then 'javascript' end end as language,
case when doc_id % 8 in (0, 1, 5) or led then 'code' when doc_id % 8 in (2, 3) then 'markdown' else 'text' end as file_type, case when led then 'markdown' else 'text' end as raw_type from p""")
def file_types(spark, d):
    """Extension, language and type by file name and first line, and the type of the text without a name."""
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % 8 + 1).cast("int"))
    docs = read(spark, d, "documents").select("doc_id", F.concat(F.lit("in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path"), F.when(F.col("doc_id") % 16 == 6, F.lit("#!/usr/bin/env node\n1")).otherwise(F.lit("plain")).alias("body"))
    return docs.select("doc_id", text.extension(F.col("path")).alias("extension"), text.language(F.col("path"), F.col("body")).alias("language"), text.file_type(F.col("path"), F.col("body")).alias("file_type"), text.raw_text_type(F.col("body")).alias("raw_type"))


def _documents(docs, kind, language=None):
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("made").alias("source"), F.lit(kind).alias("source_type"), F.lit(language).cast("string").alias("language"), "text", F.lit("t").alias("tenant_id"))


@query(r"""with recursive l as (select doc_id, string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\n\n+') as l from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) != ''),
fold as (select doc_id, l, 1 as i, 0 as g, length(l[1]) as size from l union all
select doc_id, l, i + 1, case when size + length(l[i + 1]) > 800 then g + 1 else g end, case when size + length(l[i + 1]) > 800 then length(l[i + 1]) else size + length(l[i + 1]) end from fold where i < len(l))
select doc_id::varchar as doc_id, g as chunk_index, string_agg(l[i], chr(10) || chr(10) order by i) as text from fold group by doc_id, g""")
def chunk_paragraphs(spark, d):
    """All documents through the paragraph chunker, whole texts compared."""
    return chunking.chunk_documents(_documents(read(spark, d, "documents"), "text"), 800).select("doc_id", "chunk_index", "text")


_ITEMS = r"items as (select item_id::varchar as i, rpad(regexp_replace(regexp_replace(text, '[\"\\]', ' ', 'g'), '\s+', ' ', 'g'), 300, 'x') as p from benchmark)"


def _items(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), F.rpad(F.regexp_replace(F.regexp_replace("text", r'["\\]', " "), r"\s+", " "), 300, "x").alias("p"))


@query(f"""with {_ITEMS}, n as (select chr(10) as n) select i as doc_id, c.* from items, n, lateral (
select 0 as chunk_index, 'A ' || i as path, '# A ' || i || n || p as text, 'section' as chunk_type, null::int as parent_index, 1 as sibling_order, 1 as sibling_count
union all select 1, 'A ' || i || ' > B', '## B' || n || p || n || n || p, 'section_fragment', 0, 1, 3
union all select 2, 'A ' || i || ' > B', p, 'section_fragment', 0, 2, 3
union all select 3, 'A ' || i || ' > B > C', '### C' || n || 'few words', 'section', 2, 1, 1
union all select 4, 'A ' || i || ' > D', '## D' || n || 'end', 'section', 0, 3, 3) c""")
def chunk_markdown_nested(spark, d):
    """Nested headings after front matter, a section too long that is cut at blank lines, and who is whose parent and sibling."""
    body = F.concat(F.lit("---\ntitle: T\n---\nleft out\n# A "), "doc_id", F.lit("\n"), "p", F.lit("\n## B\n"), "p", F.lit("\n\n"), "p", F.lit("\n\n"), "p", F.lit("\n### C\nfew words\n## D\nend"))
    made = chunking.chunk_documents(_documents(_items(spark, d).withColumn("text", body), "markdown"), 700)
    up = made.select(F.col("chunk_id").alias("up"), F.col("chunk_index").alias("parent_index"))
    return made.join(up, F.col("parent_chunk_id") == F.col("up"), "left").select("doc_id", "chunk_index", F.array_join("heading_path", " > ").alias("path"), "text", "chunk_type", "parent_index", "sibling_order", "sibling_count")


@query(f"""with {_ITEMS}, n as (select chr(10) as n) select i as doc_id, c.* from items, n, lateral (
select 0 as chunk_index, 'imports' as chunk_type, null::varchar as entity_name, 'import os' as text
union all select 1, 'class', 'Big' || i, 'class Big' || i || ':' || n || n || '    def a(self):' || n || '        return "' || p || '"'
union all select 2, 'class', 'Big' || i, '    def b(self):' || n || '        return "' || p || '"'
union all select 3, 'function', 'f', 'def f():' || n || '    pass' || n || n || 'def g():' || n || '    pass') c""")
def chunk_code_long(spark, d):
    """A class too long for a chunk is cut at its methods; small neighbours of one type are joined."""
    body = F.concat(F.lit("import os\nclass Big"), "doc_id", F.lit(':\n    def a(self):\n        return "'), "p", F.lit('"\n    def b(self):\n        return "'), "p", F.lit('"\ndef f():\n    pass\ndef g():\n    pass\n'))
    return chunking.chunk_documents(_documents(_items(spark, d).withColumn("text", body), "code", "python"), 400).select("doc_id", "chunk_index", "chunk_type", "entity_name", "text")


@query(f"""with {_ITEMS}, n as (select chr(10) as n) select i as doc_id, c.* from items, n, lateral (
select 0 as chunk_index, 0 as start_line, 2 as end_line, 'x = 1' || n || 'y = "' || p || '"' || n || 'def one' as text
union all select 1, 3, 4, 'z = 2' || n || 'class Two') c""")
def chunk_code_lines(spark, d):
    """Code of a language without a grammar, by lines: a boundary ends a chunk once enough is gathered."""
    body = F.concat(F.lit('x = 1\ny = "'), "p", F.lit('"\ndef one\nz = 2\nclass Two'))
    return chunking.chunk_documents(_documents(_items(spark, d).withColumn("text", body), "code", "lua")).select("doc_id", "chunk_index", "start_line", "end_line", "text")


@query(f"""with {_ITEMS} select i::bigint as doc_id, c.* from items, lateral (
select 0 as pos, 'Head ' || i as text, 'Title' as element_type, 0 as depth union all select 1, rtrim(p), 'NarrativeText', null union all select 2, 'one', 'ListItem', null union all select 3, 'two words', 'ListItem', null
union all select 4, 'Under', 'Title', 1 union all select 5, 'last line', 'NarrativeText', null) c""")
def markdown_elements(spark, d):
    """Titles, paragraphs and list items of Markdown in order."""
    body = F.concat(F.lit("# Head "), "doc_id", F.lit("\n\n"), "p", F.lit("\n\n- one\n* two words\n\n## Under\nlast line\n"))
    return files.elements(_items(spark, d).select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text")), "markdown")


@query("""with t as (select distinct text from documents where text is not null), x as (select sha256(text) as sha, substr(text, 3, 5) as name, 2 as s, 7 as e, length(text) as n from t)
select doc_id::varchar as chunk_id, 0 as pos, name, 'Concept' as entity_type, s as start_char, e as end_char, 0.9::double as confidence from documents join x on sha256(text) = sha where e <= n""")
def recorded_entities(spark, d):
    """Extractions that were recorded for a text belong to every chunk with it; places that can't be are left out."""
    docs = read(spark, d, "documents").filter("text is not null")
    places = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("end")) for p, a, b in ((0, 2, 7), (1, None, 3), (2, 5, 4), (3, -1, 2), (4, 0, 100_000_000))])
    made = docs.select("text").distinct().select(F.sha2("text", 256).alias("sha"), F.lit("Concept").alias("class"), F.substring("text", 3, 5).alias("text"), F.lit(0.9).alias("confidence"), F.inline(places))
    return extraction.recorded(docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "text"), made)


@query("select doc_id, 'label' || quality as name from labels where quality is not null union all select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and quality is not null)")
def extraction_fallback(spark, d):
    """What the first extractor found, and the second one's for documents of which it found nothing."""
    first = read(spark, d, "labels").filter("quality is not null").select("doc_id", F.concat(F.lit("label"), "quality").alias("name"))
    return extraction.with_fallback(first, read(spark, d, "documents").select("doc_id", F.col("source").alias("name")))


@query("""with found as (select conv_id as chunk_id, turn as pos, role || turn as name, case when turn % 2 = 0 then turn / 10.0::double end as confidence from conversations),
ordered as (select *, row_number() over (partition by chunk_id order by pos, name) as n from found),
pairs as (select a.chunk_id, a.name as source, b.name as target, coalesce((a.confidence + b.confidence) / 2, a.confidence, b.confidence) as confidence, row_number() over (partition by a.chunk_id order by a.n, b.n) as r from ordered a join ordered b on a.chunk_id = b.chunk_id and a.n < b.n)
select chunk_id, source, target, 'MENTIONS' as relation_type, round(confidence, 6) as confidence from pairs where r <= 10""")
def cooccurrence_confidence(spark, d):
    """Relations of things met together, with the mean of their confidences or the one that is known."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("chunk_id"), F.col("turn").alias("pos"), F.concat("role", F.col("turn").cast("string")).alias("name"), F.when(F.col("turn") % 2 == 0, F.col("turn") / 10.0).alias("confidence"))
    return extraction.cooccurrences(c).withColumn("confidence", F.round("confidence", 6))


_NOW = dt.datetime(2024, 1, 30, 12)


@query(f"""with k as (select user_id, max(ts) + interval 12 hour as expires from events group by 1)
select event_id, user_id from events e where not exists (select 1 from k where k.user_id = e.user_id and k.user_id % 3 != 0 and (k.user_id % 3 = 1 or expires > timestamp '{_NOW}'))""")
def idempotent_expiry(spark, d):
    """Commands whose key has no result that is still valid: some keys have none, some never expire, some have."""
    e = read(spark, d, "events")
    last = e.groupBy("user_id").agg((F.max("ts") + F.expr("interval 12 hours")).cast("timestamp").alias("at"))
    keys = last.select(F.col("user_id").cast("string").alias("idempotency_key"), F.when(F.col("user_id") % 3 != 0, "done").alias("result"), F.when(F.col("user_id") % 3 != 1, F.col("at")).alias("expires_at"))
    return ev.unseen(e.select("event_id", "user_id", F.col("user_id").cast("string").alias("idempotency_key")), keys, F.lit(_NOW)).select("event_id", "user_id")


@query("""select event_type, time_bucket(interval 1 hour, ts) - s * interval 1 hour as start, count(*) as n from events, (select unnest([0, 1, 2]) as s) group by 1, 2""")
def ev_sliding(spark, d):
    """Events by type in windows of three hours that begin every hour."""
    e = read(spark, d, "events").select("event_type", F.col("ts").alias("created_at"))
    return stateful.sliding_counts(e, "3 hours", "1 hour", ["event_type"]).select("event_type", "start", "n")


@query("""with recursive ways as (select 'n' || n_nationkey as a, 'r' || n_regionkey as b from nation union all select 'r' || n_regionkey, 'n' || n_nationkey from nation),
reach as (select 'n3' as node, 0 as depth union select b, depth + 1 from reach join ways on node = a where depth < 2)
select 'n' || n_nationkey as src, 'r' || n_regionkey as dst, 'PART_OF' as kind from nation where 'n' || n_nationkey in (select node from reach) and 'r' || n_regionkey in (select node from reach)""")
def graph_relations_among(spark, d):
    """The relations between the nodes that a search of two steps visits, of one kind."""
    from lexmere.plans.catalog import _graph

    edges = _graph(spark, d)[1]
    return graph.relations_among(edges, graph.bfs_min_depth(edges.filter("src like 'n%'"), "n3", 2), ("PART_OF",)).select("src", "dst", "kind")


@query("select e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score from embeddings e, (select embedding from embeddings where vec_id = 7) q order by 2 desc, 1 limit 20")
def vector_similar_self(spark, d):
    """The rows nearest to a stored one, itself first."""
    return search.similar_to(read(spark, d, "embeddings"), 7, 20, "vec_id", "embedding", exclude_self=False)


@query("select 'all' as part, false as degraded union all select 'zeros', true union all select 'none', false")
def vectors_degraded(spark, d):
    """Whether all vectors are zeros: of the table, of the same with zeros in place, and of none."""
    rows = read(spark, d, "embeddings").select(F.col("embedding").alias("vector"))
    zeros = rows.select(F.transform("vector", lambda x: x * 0).alias("vector"))
    parts = {"all": rows, "zeros": zeros, "none": rows.filter("false")}
    out = [vectors.degraded(df).select(F.lit(n).alias("part"), "degraded") for n, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _written(spark, d, statement, args=None):
    """labels after a statement."""
    labels = read(spark, d, "labels").select("doc_id", "quality", "toxic").dropDuplicates(["doc_id"])
    tables = {"labels": labels, "documents": read(spark, d, "documents").select("doc_id", "lang", "n_chars")}
    write, _ = sql.Writer(spark, tables, {"labels": ["doc_id"]}, {}).compile(statement, args)
    left = labels if write.gone is None else relational.null_safe(labels, write.gone, ["doc_id"], "left_anti")
    return left if write.rows is None else left.unionByName(write.rows)


@query("""select doc_id, quality, toxic from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id and n_chars < 500) and not exists (select 1 from documents d where d.doc_id = l.doc_id and n_chars > 5000)
union all select l.doc_id, 9, toxic from labels l join documents d on d.doc_id = l.doc_id where n_chars > 5000 union all select doc_id, 5, 0 from documents d where n_chars > 3000 and not exists (select 1 from labels l where l.doc_id = d.doc_id)""")
def sql_write_merge(spark, d):
    """A MERGE by text: short documents' labels go, long ones' change, unlabelled long documents get one."""
    return _written(spark, d, """merge into labels using (select doc_id, n_chars from documents) s on labels.doc_id = s.doc_id when matched and s.n_chars < 500 then delete
        when matched and s.n_chars > 5000 then update set quality = 9 when not matched and s.n_chars > 3000 then insert (doc_id, quality, toxic) values (s.doc_id, 5, 0)""")


@query("select doc_id, case when toxic = 1 or doc_id in (select doc_id from documents where lang = 'de') then coalesce(quality, 0) + 10 else quality end as quality, toxic from labels")
def sql_write_update(spark, d):
    """An UPDATE by text with a subquery and a value for a marker."""
    return _written(spark, d, "update labels l set quality = coalesce(quality, 0) + 10 where l.toxic = 1 or doc_id in (select doc_id from documents where lang = :lang)", {"lang": "de"})


@query("select doc_id, quality, toxic from labels where not (quality = 0 and toxic = 0) or quality is null or toxic is null union all select doc_id, 7, 1 from documents where doc_id not in (select doc_id from labels) and n_chars > 10000")
def sql_write_insert_delete(spark, d):
    """A DELETE by text, then an INSERT from a query."""
    gone = _written(spark, d, "delete from labels where quality = 0 and toxic = 0")
    added, _ = sql.Writer(spark, {"labels": read(spark, d, "labels").select("doc_id", "quality", "toxic"), "documents": read(spark, d, "documents").select("doc_id", "n_chars")}, {"labels": ["doc_id"]}, {}).compile("insert into labels (doc_id, quality, toxic) select doc_id, 7, 1 from documents where n_chars > 10000 and doc_id not in (select doc_id from labels)")
    return gone.unionByName(added.rows)


@query(r"""with l as (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as s from (select doc_id, string_split(text, chr(10)) as l from documents)),
k as (select *, case when trim(s, chr(9) || chr(32) || chr(13)) = '' then 'blank' when regexp_matches(s, '^ {0,3}#{1,6}[ \t]+\S') then 'Title' when regexp_matches(s, '^ {0,3}>') then 'Quote' when regexp_matches(s, '^[ \t]*([-*+]|[0-9]{1,9}[.)])[ \t]+\S') then 'ListItem' else 'NarrativeText' end as kind from l),
g as (select *, case when kind in ('Title', 'ListItem') or kind is distinct from lag(kind) over (partition by doc_id order by i) then 1 else 0 end as new from k),
b as (select doc_id, kind, sum(new) over (partition by doc_id order by i) as block, s, i from g)
select doc_id, element_type, count(*) as blocks, sum(chars)::bigint as chars from (select doc_id, kind as element_type, block, length(trim(string_agg(s, chr(10) order by i), chr(9) || chr(32) || chr(13))) as chars from b where kind != 'blank' group by all) group by all""")
def document_blocks(spark, d):
    """How many blocks of each kind every document has, and how long they are."""
    from lexmere.sources.blocks import block_elements

    return block_elements(read(spark, d, "documents").select("doc_id", "text")).groupBy("doc_id", "element_type").agg(F.count("*").alias("blocks"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars"))
