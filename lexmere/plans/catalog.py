"""The registered queries: each operator over the shared tables, and the SQL that says the same.

documents play documents; conversations (conv_id, turn) play (document, chunk index); embeddings
play chunk vectors, vec_id for doc_id; nations, regions, suppliers and customers play a graph.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmere.functions import vectors
from lexmere.operators import chunking, extraction, graph, relational, search
from lexmere.plans import passthrough
from lexmere.plans.registry import QUERIES as _QUERIES
from lexmere.plans.registry import SQL as _SQL
from lexmere.plans.registry import Query, query, read
from lexmere.sources.staging import shared_folder
from lexmere.streaming import events as ev

TERMS = ["the", "thand", "oner", "tion"]
COMMON = ["the", "and", "of"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """A query comes with its vector; here it is that of one stored row."""
    return [float(x) for x in read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).head()["embedding"]]


_COS = "round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6)"
_NEAR = f"""near as (select e.vec_id as id, {_COS} as score from embeddings e, (select embedding from embeddings where vec_id = 0) q order by score desc, id limit 20)"""


def _bm25_sql(terms: list[str], k: int | None, extra: str = "") -> str:
    quoted = ", ".join(f"'{t}'" for t in sorted(set(terms)))
    return f"""tok as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w != '') as w from documents),
len as (select doc_id, len(w) as dl, w from tok), stat as (select count(*) filter (dl > 0) as n, avg(dl) filter (dl > 0) as avgdl from len),
tf as (select doc_id, dl, term, count(*) as tf from (select doc_id, dl, unnest(w) as term from len) where term in ({quoted}) group by all),
df as (select term, count(*) as df from tf group by 1),
bm as (select doc_id as id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score from tf join df using (term), stat {extra} group by 1 order by score desc, id {f'limit {k}' if k else ''})"""


@query(f"with {_NEAR} select id as vec_id, score from near order by score desc, id limit 10")
def vector_topk_cosine(spark, d):
    return search.vector_topk(read(spark, d, "embeddings"), _vector(spark, d), 10, "vec_id", "embedding")


@query("select e.vec_id, round(list_distance(e.embedding::double[], q.embedding::double[]), 6) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q where label in (1, 2, 3) order by 2, 1 limit 10")
def vector_topk_l2_filtered(spark, d):
    return search.vector_topk(read(spark, d, "embeddings"), _vector(spark, d), 10, "vec_id", "embedding", "l2", {"label": [1, 2, 3]})


@query(f"select e.vec_id, {_COS} as score from embeddings e, (select embedding from embeddings where vec_id = 7) q where e.vec_id != 7 order by 2 desc, 1 limit 20")
def vector_similar_rows(spark, d):
    return search.similar_to(read(spark, d, "embeddings"), 7, 20, "vec_id", "embedding")


@query(f"with {_bm25_sql(TERMS, 20)} select id as doc_id, score from bm")
def fts_bm25_topk(spark, d):
    return search.bm25(read(spark, d, "documents"), TERMS, 20, "doc_id")


@query(f"with {_bm25_sql(COMMON, None)} select id as doc_id, score from bm join tok on bm.id = tok.doc_id where list_has_all(w, ['the', 'and', 'of']) order by score desc, id limit 20")
def fts_conjunctive(spark, d):
    return search.conjunctive(read(spark, d, "documents"), COMMON, 20, "doc_id")


def _lists(spark, d):
    near = search.vector_topk(read(spark, d, "embeddings"), _vector(spark, d), 20, "vec_id", "embedding").withColumnRenamed("vec_id", "id")
    words = search.bm25(read(spark, d, "documents"), TERMS, 20, "doc_id").withColumnRenamed("doc_id", "id")
    return near, words


_FUSE = f"""{_NEAR}, {_bm25_sql(TERMS, 20)},
ranked as (select id, 0 as l, score, row_number() over (order by score desc, id) as r from near union all select id, 1, score, row_number() over (order by score desc, id) from bm)"""


@query(f"with {_FUSE}, fused as (select id, round(sum(1 / (60 + r)), 6) as score, min((l, r)) as f from ranked group by id) select id, score from fused order by score desc, f, id limit 10")
def rrf_fusion(spark, d):
    return search.rrf(list(_lists(spark, d)), "id", 10)


@query(f"""with {_FUSE}, kept as (select r.* from ranked r left join embeddings on vec_id = id where (label is null or label not in (0, 1)) and (l = 1 or score >= 0.3)),
fused as (select id, round(sum(1 / (60 + r)), 6) as score, min((l, r)) as f from kept group by id) select id, score from fused order by score desc, f, id limit 10""")
def rrf_floor_exclusion(spark, d):
    types = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("type"))
    return search.rrf([x.join(types, "id", "left") for x in _lists(spark, d)], "id", 10, floor=0.3, excluded=("0", "1"), type_col="type")


_indexes: dict[tuple[str, str], search.TextIndex] = {}


def _index(spark, d):
    """The stored index of the documents' texts: built once for a session and folder, as a knowledge base does when it takes texts in."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        _indexes[key] = search.TextIndex.build(read(spark, d, "documents"), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", "doc_id")
    return _indexes[key]


@query(f"with {_bm25_sql(TERMS, 20)} select id as doc_id, score from bm")
def fts_index_topk(spark, d):
    """The search of fts_bm25_topk over the stored index."""
    return _index(spark, d).search(TERMS, 20)


@query(f"with {_FUSE.replace('from embeddings e,', 'from (select * from embeddings where vec_id in (select doc_id from documents)) e,')}, fused as (select id, round(sum(1 / (60 + r)), 6) as score, min((l, r)) as f from ranked group by id) select id as doc_id, score from fused order by score desc, f, id limit 10")
def hybrid_search(spark, d):
    """The flagship: all documents, those with a vector by vector and all by words, which are looked up in the stored index."""
    own = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return search.hybrid(read(spark, d, "documents").select("doc_id").join(own, "doc_id", "left"), _vector(spark, d), TERMS, 10, "doc_id", "embedding", index=_index(spark, d))


@query("select c.conv_id, c.turn, h.turn as hit_index from conversations c join conversations h on c.conv_id = h.conv_id and c.turn between h.turn - 1 and h.turn + 2 where h.turn = 2")
def context_window(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn")
    return search.context(c, c.filter("turn = 2"), 1, 2, "conv_id", "turn")


@query("""select conv_id, turn, hit_index, distance from (select c.conv_id, c.turn, h.turn as hit_index, abs(c.turn - h.turn) as distance,
row_number() over (partition by h.conv_id, h.turn order by abs(c.turn - h.turn), c.turn) as n from conversations c join conversations h on c.conv_id = h.conv_id and abs(c.turn - h.turn) <= 2 and c.turn != h.turn where h.role = 'user') where n <= 2""")
def context_nearest_n(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role")
    return search.nearest_context(c.drop("role"), c.filter("role = 'user'"), 2, "conv_id", "turn")


@query(f"""with {_bm25_sql(TERMS, 5)}, top as (select source, text, row_number() over (order by score desc, id) as n from bm join documents on doc_id = id)
select string_agg('---' || chr(10) || 'Source [' || n || ']: ' || source || chr(10) || text, chr(10) || chr(10) order by n) as context from top""")
def retrieve_context(spark, d):
    """The whole texts of the five documents that a search over all finds."""
    found = _index(spark, d).search(TERMS, 5).withColumn("rank", F.struct((-F.col("score")).alias("s"), "doc_id"))
    return search.context_strings(read(spark, d, "documents").select("doc_id", "source", "text").join(F.broadcast(found), "doc_id"))


@query("select doc_id, i - 1 as pos, line, length(line) as char_count from (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents))")
def chunk_lines(spark, d):
    return chunking.lines(read(spark, d, "documents"))


_ABBR = ", ".join(f"'{a}'" for a in chunking.ABBREVIATIONS)


@query(f"""with w as (select doc_id, unnest(range(1, len(l) + 1)) as pos, unnest(l) as word from (select doc_id, string_split(replace(text, chr(10), ' '), ' ') as l from documents)),
e as (select *, (regexp_matches(word, '[.?!]$') and lower(regexp_replace(word, '[.?!]+$', '')) not in ({_ABBR}))::int as fin from w),
n as (select *, coalesce(sum(fin) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as sentence_id from e)
select doc_id, sentence_id::bigint as sentence_id, trim(string_agg(word, ' ' order by pos)) as sentence from n group by all having trim(string_agg(word, ' ' order by pos)) != ''""")
def chunk_sentences(spark, d):
    return chunking.sentences(read(spark, d, "documents"))


@query("""with recursive l as (select doc_id, string_split(text, chr(10)) as l from documents),
fold as (select doc_id, l, 1 as i, 0 as g, length(l[1]) as size from l union all
select doc_id, l, i + 1, case when size + length(l[i + 1]) > 800 then g + 1 else g end, case when size + length(l[i + 1]) > 800 then length(l[i + 1]) else size + length(l[i + 1]) end from fold where i < len(l))
select doc_id, g as group_id, count(*) as parts, sum(length(l[i]))::bigint as chars from fold group by all""")
def chunk_paragraph_pack(spark, d):
    return chunking.pack_lines(read(spark, d, "documents"), 800)


def _sources(spark, d, kind, text, language=None):
    """Benchmark items as files of a kind, with ``text`` made of i, the item's id, and t, its words on one line."""
    items = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("i"), F.regexp_replace("text", r"\s+", " ").alias("t"))
    return items.select(F.col("i").alias("doc_id"), F.lit("made").alias("source"), F.lit(kind).alias("source_type"), F.lit(language).cast("string").alias("language"), text.alias("text"), F.lit("t").alias("tenant_id"))


_ITEMS = r"items as (select item_id::varchar as i, regexp_replace(text, '\s+', ' ', 'g') as t from benchmark)"


def _markdown(spark, d):
    return _sources(spark, d, "markdown", F.concat(F.lit("# Item "), "i", F.lit("\n"), "t", F.lit("\n## Its Notes\n"), "t"))


@query(f"""with {_ITEMS} select i as doc_id, 0 as chunk_index, 'Item ' || i as path, '# Item ' || i || chr(10) || t as text from items
union all select i, 1, 'Item ' || i || ' > Its Notes', '## Its Notes' || chr(10) || t from items""")
def chunk_markdown(spark, d):
    """Each item as a file of two sections, which the markdown chunker tells apart with their paths."""
    return chunking.chunk_documents(_markdown(spark, d), 100_000).select("doc_id", "chunk_index", F.array_join("heading_path", " > ").alias("path"), "text")


@query(f"""with {_ITEMS} select i as doc_id, 0 as chunk_index, 'function' as chunk_type, 'step_' || i as entity_name, 'def step_' || i || '():' || chr(10) || '    return "' || translate(t, '"\\', '  ') || '"' as text from items
union all select i, 1, 'class', 'Part' || i, 'class Part' || i || ':' || chr(10) || '    pass' from items""")
def chunk_code(spark, d):
    """Each item as a Python file of a function and a class."""
    body = F.concat(F.lit("def step_"), "i", F.lit('():\n    return "'), F.translate("t", '"\\', "  "), F.lit('"\n\n\nclass Part'), "i", F.lit(":\n    pass\n"))
    made = chunking.chunk_documents(_sources(spark, d, "code", body, "python"), 100_000)
    return made.select("doc_id", "chunk_index", "chunk_type", "entity_name", "text")


@query(f"with {_ITEMS} select i as doc_id, 0 as pos, 'Item ' || i as name, 1 as level, 'Concept' as entity_type from items union all select i, 1, 'Its Notes', 2, 'Concept' from items")
def markdown_entities(spark, d):
    """The entities that headings give; CamelCase words are those of camelcase_entities."""
    found = extraction.with_ontology(extraction.entities(_markdown(spark, d)))
    return found.filter("pattern = 'heading'").select("doc_id", "pos", "name", "level", "entity_type")

#: A function and a type of each brace language, with braces where they don't count; {i}: the item's id, {t}: its words.
_BRACED = {
    "javascript": ("export async function step_{i}(x) {\n  const s = \"}} {t}\", r = /[}/]{2}\\}/g; // }\n  return `a ${ {k: `}${x}`} } {`;\n}", "class Part{i} {\n  run() { return '{'; } /* } */\n}"),
    "typescript": ("function step_{i}<T>(x: T): string {\n  return '}' + `${x}}` + \"{t}\"; // {\n}", "interface Part{i} {\n  a: { b: string }; /* {{ */\n}"),
    "go": ("func step_{i}(x int) string {\n\treturn `} {t} \\` + string('{') // }\n}", "type Part{i} struct {\n\tA struct{ B int } // }\n}"),
    "rust": ("pub fn step_{i}<'a>(x: &'a str) -> char {\n    let s = r#\"} {t} \" }\"#; /* } /* { */ } */\n    '}'\n}", "struct Part{i}<'a> {\n    a: &'a str, // }\n}"),
    "java": ("public class Step{i} {\n  String s = \"\"\"\n    } {t} \\\"\"\" }\n    \"\"\"; char c = '}';\n}", "interface Part{i} {\n  /* } */ void run();\n}"),
}
_CODE_WORDS = r"items as (select item_id::varchar as i, regexp_replace(regexp_replace(text, '[\"`\\\\$]', ' ', 'g'), '\s+', ' ', 'g') as t from benchmark)"


def _braced_sql(language, n, kind, name):
    text = _BRACED[language][n].replace("'", "''")
    return f"select i || '-{language}' as doc_id, {n} as chunk_index, '{kind}' as chunk_type, '{name}' || i as entity_name, replace(replace('{text}', '{{i}}', i), '{{t}}', t) as text from items"


_KINDS = {"javascript": ("function", "class"), "typescript": ("function", "interface"), "go": ("function", "type"), "rust": ("function", "struct"), "java": ("class", "interface")}


@query(f"with {_CODE_WORDS} " + " union all ".join(_braced_sql(k, n, _KINDS[k][n], "Part" if n else "Step" if k == "java" else "step_") for k in _BRACED for n in (0, 1)))
def chunk_code_braces(spark, d):
    """Each item as files of five languages whose strings, templates, regular expressions and comments hold braces: one definition a chunk."""
    items = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("i"), F.regexp_replace(F.regexp_replace("text", r'["`\\$]', " "), r"\s+", " ").alias("t"))
    files = F.array(*[F.struct(F.lit(k).alias("language"), F.lit("\n\n".join(v)).alias("body")) for k, v in _BRACED.items()])
    made = items.select("i", "t", F.inline(files)).select(
        F.concat("i", F.lit("-"), "language").alias("doc_id"), F.lit("made").alias("source"), F.lit("code").alias("source_type"), "language",
        F.replace(F.replace("body", F.lit("{i}"), F.col("i")), F.lit("{t}"), F.col("t")).alias("text"), F.lit("t").alias("tenant_id"))
    return chunking.chunk_documents(made, 100_000).select("doc_id", "chunk_index", "chunk_type", "entity_name", "text")


_HALVES = "c as (select user_id::varchar as k, max(event_id) as v from events group by 1), d as (select user_id::varchar as k, max(event_id) as v from events where event_id % 2 = 0 group by 1)"


@query(f"with {_HALVES} select 1 as version, k as key, v::varchar as value from c union all select 2, c.k, coalesce(d.v + 1000000, c.v)::varchar from c left join d using (k) union all select 3, k, v::varchar from c")
def stored_versions(spark, d):
    """Three versions of a stored table: written, merged into, restored; each read back."""
    from lexmere.sources.snapshots import Store

    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    last = lambda e, more: e.groupBy(F.col("user_id").cast("string").alias("key")).agg((F.max("event_id") + more).cast("string").alias("value"))
    rows = lambda e, more: last(e, more).select("key", "value", F.lit(None).cast("string").alias("doc_id"), F.lit("t").alias("tenant_id"))
    e = read(spark, d, "events")
    store.upsert({"metadata": rows(e, 0)}, "all")
    store.upsert({"metadata": rows(e.filter("event_id % 2 = 0"), 1_000_000)}, "even")
    store.restore(1)
    reads = [store.table("metadata", v).select(F.lit(v).alias("version"), "key", "value") for v in (1, 2, 3)]
    return reads[0].unionByName(reads[1]).unionByName(reads[2])


@query()
def chunk_documents(spark, d):
    """Documents through the paragraph chunker."""
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source"), F.lit("text").alias("source_type"), F.lit(None).cast("string").alias("language"), "text", F.lit("t").alias("tenant_id"))
    return chunking.chunk_documents(docs, 800).drop("created_at")


@query("""with p as (select conv_id as doc_id, turn as chunk_index, list_transform(range(0, (turn % 4) + 1), lambda k: case when k = turn % 4 and k > 0 then 'h' || turn else 'h' || k end) as path from conversations)
select c.doc_id, c.chunk_index, max(u.chunk_index) as parent_index from p c left join p u on c.doc_id = u.doc_id and u.chunk_index < c.chunk_index and len(u.path) < len(c.path) and u.path = c.path[1:len(u.path)] group by 1, 2""")
def hierarchy_parent(spark, d):
    c = read(spark, d, "conversations")
    path = F.transform(F.sequence(F.lit(0), (F.col("turn") % 4).cast("int")), lambda k: F.when((k == F.col("turn") % 4) & (k > 0), F.concat(F.lit("h"), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("h"), k.cast("string"))))
    return chunking.heading_parents(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), path.alias("heading_path")))


@query("select page_id, pos, trim(heading) as heading from (select page_id, unnest(range(len(h))) as pos, unnest(h) as heading from (select page_id, regexp_extract_all(html, '<h([1-6])[^>]*>([^<]*)</h[1-6]>', 2) as h from pages))")
def html_headings(spark, d):
    found = F.regexp_extract_all("html", F.lit(r"<h([1-6])[^>]*>([^<]*)</h[1-6]>"), F.lit(2))
    return read(spark, d, "pages").select("page_id", F.posexplode(found).alias("pos", "heading")).withColumn("heading", F.trim("heading"))


@query()
def html_elements(spark, d):
    from lexmere.sources.files import html_elements as parse

    return parse(read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


@query("select doc_id, sha256(text) as sha, length(text) as chars from documents")
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").alias("chars"))


@query("select sha256(text) as sha, count(*) as copies, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")
def exact_dups(spark, d):
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query("select count(*) as texts, count(distinct sha256(text)) as embedded, false as degraded from documents")
def embed_deduplicated(spark, d):
    docs = read(spark, d, "documents")
    made = vectors.embed_texts(docs, vectors.SeededEmbedder(16), "doc_id")
    return made.agg(F.count("*").alias("texts"), F.count_distinct("vector").alias("embedded"), F.bool_and(F.forall("vector", lambda x: x == 0)).alias("degraded"))


_CAMEL = "list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+([A-Z][a-z]+)*') and length(w) > 2)"


@query(f"select doc_id, name, count(*) as n from (select doc_id, unnest({_CAMEL}) as name from documents) group by all")
def camelcase_entities(spark, d):
    from lexmere.functions.text import camel_case

    return read(spark, d, "documents").select("doc_id", F.explode(camel_case(F.col("text"))).alias("name")).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


_CONCEPTS = ", ".join(f"case when regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){c}([^\\p{{L}}\\p{{N}}_]|$)') then '{c.title()}' end" for c in extraction.CONCEPTS)
_FOUND = f"""found as (select doc_id, unnest(range(len(x))) as pos, unnest(x) as name from (select doc_id, list_concat({_CAMEL}, list_filter([{_CONCEPTS}], lambda w: w is not null)) as x from documents)),
firsts as (select doc_id, name, min(pos) as pos from found group by all)"""


@query(f"with {_FOUND} select doc_id, pos, name, 'CONCEPT' as kind, 'Concept' as entity_type from firsts")
def entity_dedup(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", F.lit("text").alias("source_type"))
    return extraction.with_ontology(extraction.entities(docs)).select("doc_id", "pos", "name", "kind", "entity_type")


@query(f"""with {_FOUND}, ordered as (select doc_id, name, row_number() over (partition by doc_id order by pos, name) as n from firsts),
pairs as (select a.doc_id, a.name as source, b.name as target, row_number() over (partition by a.doc_id order by a.n, b.n) as r from ordered a join ordered b on a.doc_id = b.doc_id and a.n < b.n and b.n <= 11)
select doc_id, source, target, 'MENTIONS' as relation_type, 0.5::double as confidence from pairs where r <= 10""")
def cooccurrence_relations(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", F.lit("text").alias("source_type"))
    return extraction.cooccurrences_within(extraction.entity_lists(docs), confidence=0.5)


def _graph(spark, d):
    """Regions, nations and suppliers as nodes; a part points to its whole."""
    r, n, s = (read(spark, d, t) for t in ("region", "nation", "supplier"))
    nodes = r.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.col("r_name").alias("name"), F.lit("region").alias("type"))
    nodes = nodes.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_name").alias("name"), F.lit("nation").alias("type")))
    nodes = nodes.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_name").alias("name"), F.lit("supplier").alias("type")))
    edges = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("PART_OF").alias("kind"), (F.col("n_nationkey") % 5 + 1).cast("double").alias("weight"))
    edges = edges.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("PART_OF").alias("kind"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("weight")))
    return nodes, edges


_GRAPH = """nodes as (select 'r' || r_regionkey as node, r_name as name, 'region' as type from region union all select 'n' || n_nationkey, n_name, 'nation' from nation union all select 's' || s_suppkey, s_name, 'supplier' from supplier),
edges as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst, 'PART_OF' as kind, (n_nationkey % 5 + 1)::double as weight from nation union all select 's' || s_suppkey, 'n' || s_nationkey, 'PART_OF', (s_suppkey % 7 + 1)::double from supplier),
ways as (select src, dst, kind, 'outgoing' as direction from edges union all select dst, src, kind, 'incoming' from edges)"""


@query(f"with {_GRAPH} select node, name, kind, direction from ways join nodes on node = dst where src = 'n3'")
def graph_neighbors(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.neighbours(edges, nodes, "n3")


@query(f"with {_GRAPH} select node, name, type from nodes where contains(lower(name), 'ion_1') order by name, node limit 20")
def entity_search(spark, d):
    return graph.search_entities(_graph(spark, d)[0], "ion_1")


@query(f"with {_GRAPH} select src, a.name as src_name, kind, dst, b.name as dst_name from edges join nodes a on a.node = src join nodes b on b.node = dst where src = 'n3' or dst = 'n3'")
def relation_names(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.relations_of(edges, nodes, "n3")


@query(f"with recursive {_GRAPH}, w as (select dst as node, kind, src as via, 1 as depth from ways where src = 'n3' and src != dst union select ways.dst, ways.kind, ways.src, depth + 1 from w join ways on w.node = ways.src where depth < 3 and ways.src != ways.dst) select distinct node, kind, via, depth from w")
def graph_bfs_walks(spark, d):
    return graph.walks(_graph(spark, d)[1], "n3", 3)


@query(f"with recursive {_GRAPH}, w as (select 's1' as node, 0 as depth union select dst, depth + 1 from w join edges on node = src where depth < 3) select distinct node, depth from w")
def graph_bfs_directed(spark, d):
    return graph.bfs_directed(_graph(spark, d)[1], "s1", 3)


_REACH = f"with recursive {_GRAPH}, w as (select 'n3' as node, 0 as depth union select dst, depth + 1 from w join ways on node = src where depth < 4)"


@query(f"{_REACH} select node, min(depth) as depth from w group by 1")
def graph_bfs_min_depth(spark, d):
    return graph.bfs_min_depth(_graph(spark, d)[1], "n3", 4)


@query(f"""with recursive {_GRAPH}, w as (select 'n3' as node, ['n3'] as path union all select dst, list_append(path, dst) from w join ways on node = src where len(path) < 6 and not list_contains(path, dst))
select min(path) as path from w where node = 'n8' and len(path) = (select min(len(path)) from w where node = 'n8') having min(path) is not null""")
def graph_shortest_path(spark, d):
    found = graph.bfs_paths(_graph(spark, d)[1], "n3", 6).filter("node = 'n8'")
    return found.select("path")


def _ranks(n: int) -> str:
    steps, last = [], "r0"
    for i in range(1, n + 1):
        steps.append(f"g{i} as (select dst, sum(rank / degree) as got from links join {last} on src = node group by 1), r{i} as materialized (select node, 0.15 / (select count(*) from all_) + 0.85 * (coalesce(got, 0) + (1 - (select coalesce(sum(got), 0) from g{i})) / (select count(*) from all_)) as rank from all_ left join g{i} on node = dst)")
        last = f"r{i}"
    return ", ".join(steps)


@query(f"""with {_GRAPH}, all_ as (select src as node from edges union select dst from edges), links as (select src, dst, count(*) over (partition by src) as degree from (select distinct src, dst from edges)),
r0 as (select node, 1.0::double / (select count(*) from all_) as rank from all_), {_ranks(5)} select node, round(rank, 9) as rank from r5""")
def graph_pagerank(spark, d):
    return graph.pagerank(_graph(spark, d)[1], 5).select("node", F.round("rank", 9).alias("rank"))


@query(f"with recursive {_GRAPH}, w as (select 's1' as node, 0.0::double as distance union all select dst, distance + weight from w join edges on node = src) select node, min(distance) as distance from w group by 1")
def graph_distances(spark, d):
    return graph.distances(_graph(spark, d)[1], "s1").select("node", "distance")



@query("""select count(distinct d.conv_id) as documents, count(c.turn) as chunks, count(*) filter (c.role = 'user') as user_chunks, round(avg(length(c.text)), 2) as avg_chars from (select distinct conv_id from conversations) d left join conversations c on c.conv_id = d.conv_id""")
def document_stats(spark, d):
    c = read(spark, d, "conversations")
    docs = c.select(F.col("conv_id").alias("doc_id")).distinct().withColumn("created_at", F.lit(None).cast("timestamp"))
    chunks = c.select(F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "user", "code").otherwise("text").alias("source_type"), "text")
    return relational.document_stats(docs, chunks).select("documents", "chunks", F.col("code_chunks").alias("user_chunks"), "avg_chars")


@query("select lang, count(*) as documents, sum(n_chars)::bigint as chars from documents group by 1")
def stats_by_type(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("select 'documents' as name, count(*) as rows from documents union all select 'conversations', count(*) from conversations union all select 'events', count(*) from events")
def table_counts(spark, d):
    return relational.counts({n: read(spark, d, n) for n in ("documents", "conversations", "events")})


def _events(spark, d):
    return ev.numbered(read(spark, d, "events").select("event_id", F.col("user_id").alias("aggregate_id"), "event_type", F.col("props").alias("payload"), F.col("ts").alias("created_at"), "value"))


_EVENTS = "ev as (select event_id, user_id as aggregate_id, event_type, props as payload, ts as created_at, value, row_number() over (partition by user_id order by ts, event_id) as version from events)"


@query(f"with {_EVENTS} select aggregate_id, max(version) as version, count(*) as events, min(created_at) as first_at, max(created_at) as last_at from ev group by 1")
def event_versions(spark, d):
    return ev.versions(_events(spark, d))


@query(f"with {_EVENTS} select ev.event_id, ev.created_at from ev, (select created_at as c, event_id as e from ev where event_id = 10) p where ev.created_at > c or (ev.created_at = c and ev.event_id > e) order by 2, 1 limit 100")
def events_since(spark, d):
    log = _events(spark, d)
    at = log.filter("event_id = 10").select("created_at", "event_id").head()
    return ev.since(log, at["created_at"], at["event_id"], 100).select("event_id", "created_at")


_TAGS = """bridge as (select doc_id, 'quality' || quality as tag from labels where quality is not null union all select doc_id, 'toxic' from labels where toxic = 1),
tags as (select tag, 'c' || length(tag) as color from (select distinct tag from bridge))"""


@query(f"with {_TAGS} select doc_id, tag as name, color from bridge join tags using (tag)")
def tags_of_document(spark, d):
    l = read(spark, d, "labels")
    bridge = l.filter("quality is not null").select("doc_id", F.concat(F.lit("quality"), "quality").alias("tag")).unionByName(l.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("tag")))
    tags = bridge.select("tag").distinct().withColumn("color", F.concat(F.lit("c"), F.length("tag").cast("string")))
    return bridge.join(tags, "tag").select("doc_id", F.col("tag").alias("name"), "color")


@query("select 'lang' as key, lang as value, doc_id::varchar as doc_id from documents where doc_id = 5 order by 1")
def metadata_get(spark, d):
    m = read(spark, d, "documents").select(F.lit("lang").alias("key"), F.col("lang").alias("value"), F.col("doc_id").cast("string").alias("doc_id"))
    return relational.metadata_of(m, "lang", "5")


_MERGE = """base as (select doc_id, lang, source from documents where doc_id % 3 != 0), delta as (select doc_id, 'xx' as lang, source from documents where doc_id % 2 = 0)
select doc_id, lang, source from (select *, row_number() over (partition by doc_id order by side {}) as n from (select *, 0 as side from base union all select *, 1 from delta)) where n = 1"""


def _merge_sides(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.filter("doc_id % 3 != 0"), docs.filter("doc_id % 2 = 0").withColumn("lang", F.lit("xx"))


@query("with " + _MERGE.format("desc"))
def metadata_upsert(spark, d):
    return relational.keyed_merge(*_merge_sides(spark, d), ["doc_id"])


@query("with " + _MERGE.format("asc"))
def insert_ignore(spark, d):
    return relational.keyed_merge(*_merge_sides(spark, d), ["doc_id"], "ignore")


@query("select doc_id, quality from labels where not exists (select 1 from documents d where d.doc_id = labels.doc_id and source = 'src0')")
def delete_cascade(spark, d):
    gone = read(spark, d, "documents").filter("source = 'src0'")
    return relational.delete_where(read(spark, d, "labels").select("doc_id", "quality"), gone, ["doc_id"])


@query("select doc_id, lang from documents except all select doc_id, case when doc_id % 20 = 0 then 'xx' else lang end from documents")
def version_diff(spark, d):
    old = read(spark, d, "documents").select("doc_id", "lang")
    return old.exceptAll(old.withColumn("lang", F.when(F.col("doc_id") % 20 == 0, "xx").otherwise(F.col("lang"))))


@query("select l_orderkey from lineitem l where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'O')")
def fk_missing(spark, d):
    return relational.missing_parents(read(spark, d, "lineitem").select("l_orderkey"), read(spark, d, "orders").filter("o_orderstatus = 'O'"), "l_orderkey", "o_orderkey")


@query("select json_extract_string(props, '$.k') as k, count(*) as n from events group by 1")
def json_props(spark, d):
    return read(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("select doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w != '')) as n from documents")
def tokens_per_doc(spark, d):
    from lexmere.functions.text import tokens

    return read(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("n"))


@query("select doc_id, source from documents order by source desc, doc_id limit 20 offset 40")
def pagination(spark, d):
    return relational.page(read(spark, d, "documents").select("doc_id", "source"), [F.desc("source"), "doc_id"], 40, 20)


@query("select event_id, user_id from events where user_id not in (select user_id from events where value > 150)")
def idempotent_dedup(spark, d):
    e = read(spark, d, "events")
    keys = e.filter("value > 150").select(F.col("user_id").cast("string").alias("idempotency_key"), F.lit("r").alias("result"), F.lit(None).cast("timestamp").alias("expires_at"))
    return ev.unseen(e.select("event_id", "user_id", F.col("user_id").cast("string").alias("idempotency_key")), keys).select("event_id", "user_id")


@query("select 'p' as projection_name, user_id as event_id, count(*) as retry_count, count(*) >= 3 as permanent from events where value < 20 group by user_id")
def dlq_rollup(spark, d):
    return ev.failures(read(spark, d, "events").filter("value < 20").select(F.lit("p").alias("projection_name"), F.col("user_id").alias("event_id")))


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def ev_tumbling(spark, d):
    e = read(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""with g as (select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 30 minute then 1 else 0 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts, event_id) as s from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, s""")
def ev_session(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("select user_id, event_id, lag(event_id) over (partition by user_id order by ts, event_id) as previous, row_number() over (partition by user_id order by ts, event_id) as n from events")
def ev_previous(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select("user_id", "event_id", F.lag("event_id").over(w).alias("previous"), F.row_number().over(w).alias("n"))


from lexmere.plans import analytics, knowledge  # noqa: E402, F401  register their queries

for _name, _text in passthrough.SQL.items():
    _QUERIES[_name] = passthrough.runner(_text)
    _SQL[_name] = _text


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
