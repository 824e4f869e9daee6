import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexmere.llm import catalog, decontam, nbsvm, neardup, oracles, secrets
from lexmere.llm.catalog import tokenizer
from lexmere.llm.shared import stage, table


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_matches_its_oracle(spark, sf_dir, duck, name):
    same(catalog.queries()[name](spark, sf_dir).toPandas(), duck.sql(oracles.SQL[name]).df())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries()) == list(range(1, 14))


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_tokens_of_a_whole_table_are_the_librarys(spark, sf_dir, texts):
    plain, want, start = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), [], 0
    for doc_id in sorted(texts):
        ids = [*plain.encode(texts[doc_id], add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), checksum(ids)))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in catalog.op2_rans_tokens(spark, sf_dir).collect()) == want


def best_fit(lengths, capacity=2048):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_packing_of_a_whole_table(spark, sf_dir, texts):
    plain, want = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), set()
    for doc_id, text in texts.items():
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        want |= {(doc_id, k, s, len(ids[s : s + 2048]), checksum(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))}
    rows = catalog.op6_best_fit_packing(spark, sf_dir).collect()
    assert len(rows) == len(want) and {tuple(r)[:5] for r in rows} == want
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(filled) == best_fit([r["length"] for r in rows])


def entropy(part):
    return -sum(c / len(part) * math.log2(c / len(part)) for c in collections.Counter(part).values())


def test_secrets_of_a_whole_table(spark, sf_dir, texts):
    """Base spans by plain patterns; added spans by the entropy of every window, counted anew; strings drawn at random are put into some texts."""
    kinds = ["assign", "access", "hex", *(c.kind for c in secrets.CLASSES)]
    rng = random.Random(31)
    signs = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "ABCDEF0123456789"]
    planted = {i: f"{t} {''.join(rng.choice(rng.choice(signs)) for _ in range(3))} x/{''.join(rng.choice(signs[i % 4]) for _ in range(rng.randrange(18, 70)))}/é {t[:200]}" for i, t in texts.items() if i % 3 == 0}
    planted |= {-1 - i: t for i, t in texts.items()}
    rows = {r["doc_id"]: r for r in catalog.op8_secret_scan(spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    more = spark.createDataFrame(list(planted.items()), "doc_id long, text string").repartition(4)
    rows |= {r["doc_id"]: r for r in secrets.scan_secrets(more).collect() if r["doc_id"] not in rows or r["doc_id"] % 3 == 0}
    met = set()
    for doc_id, text in ((texts | planted) if rows else {}).items():
        low = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
        base = [("assign", *m.span()) for m in low.finditer(text) if len(m[2]) >= 12]
        base += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
        base += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
        held = [(a, b) for _, a, b in base]
        added = []
        for c in secrets.CLASSES:
            own = []
            for m in re.finditer(f"[{re.escape(c.signs)}]{{20,}}", text):
                odd = [p.span() for p in re.finditer("[^/_=+-]+", m[0]) if not any(re.fullmatch(x, p[0]) for x in secrets.ALLOWED)]
                run = m[0][odd[0][0] : odd[-1][1]] if odd else ""
                if not re.search(r"\d", run) or not re.search("[A-Za-z]", run):
                    continue
                hidden = {i for x in secrets.PLACEHOLDER.finditer(run) for i in range(*x.span())}
                inside = sorted({j for w, share in c.widths for i in range(len(run) - w + 1) if not hidden & set(range(i, i + w)) and entropy(run[i : i + w]) >= secrets.threshold(len(c.signs), w, share) - 1e-9 for j in range(i, i + w)})
                for i, j in enumerate(inside):
                    if not i or inside[i - 1] != j - 1:
                        own.append([m.start() + odd[0][0] + j, 0])
                    own[-1][1] = m.start() + odd[0][0] + j + 1
            own = [(a, b) for a, b in own if not any(x <= a and b <= y for x, y in held)]
            held += own
            added += [(c.kind, a, b) for a, b in own]
        met |= {k for k, _, _ in added}
        written = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))
        r = rows[doc_id]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in base) for x in kinds[:3]]
        assert r["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest() and r["spans"] == written(base + added)
    assert len(met) >= 4


def test_classifier_on_labels_it_has_not_seen(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = nbsvm.score(docs, nbsvm.fit(docs, labels)).join(labels, "doc_id").filter("held_out and quality is not null").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_quality_rules_keep_what_is_labelled_good(spark):
    d = "/root/testdata/sf0.01"
    rows = catalog.op10_quality_rules(spark, d).filter("not base_failed").join(table(spark, d, "labels"), "doc_id").filter("quality is not null").collect()
    assert len(rows) > 100 and sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.99 * len(rows)


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == columns and out.schema == docs.schema
        if name == "line dedup":
            assert out.count() == docs.count()
        if name == "near-dedup":
            found = neardup.near_duplicates(docs, 5, 80).filter("kept")
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in found.collect())
        if name == "decontamination":
            bad = decontam.judge(decontam.find(docs, table(spark, sf_dir, "benchmark"))).filter("contaminated")
            assert out.count() == docs.count() - bad.count()
        if name != "packing":
            docs = stage(out, "test")
    assert out.select("doc_id").distinct().count() == docs.count()


CLASHING = ("key", "n_lines", "n_removed", "label", "score", "n", "node", "comp", "w", "near", "hits")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_with_odd_rows(spark, sf_dir, name):
    """Nulls, empty texts, repeated ids and rows, columns of the names that operators use, an empty table."""
    item = next(r["text"] for r in table(spark, sf_dir, "benchmark").collect() if len(r["text"].split()) >= 20)
    prose = [r["text"] for r in table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").filter("length(text) between 500 and 3000").orderBy("doc_id").limit(3).collect()]
    same_lines = "\n".join(f"{prose[0].split()[i]} line {i} here." for i in range(4))
    rows = [(None, prose[0]), (None, prose[1]), (None, None), (5, ""), (5, prose[2]), (5, prose[1]), (5, prose[1]), (6, item), (None, item), (8, f"{prose[0][:200]}\n{same_lines}"), (9, same_lines), (10, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = stage(docs.select("*", *[F.concat(F.lit(f"own {c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING]), "odd")
    step = dict(corpus_pipeline.STAGES)[name]
    assert step(spark, docs.limit(0), sf_dir).count() == 0
    out = step(spark, docs, sf_dir)
    if name == "packing":
        assert sorted(r["doc_id"] is None for r in out.filter("piece = 0").collect()) == sorted(i is None for i, _ in rows)
        return
    assert out.schema.names == docs.schema.names
    got = out.collect()
    assert all(r[c] == f"own {c} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in got for c in CLASHING)
    kept = collections.Counter((r["doc_id"], r["text"]) for r in got)
    if name == "near-dedup":  # of the text with ids null and 5 the one with an id stays, once; of the item the one with an id
        assert kept == collections.Counter([r for r in set(rows) if r not in [(None, prose[1]), (None, item)]])
    elif name == "decontamination":
        assert kept == collections.Counter([r for r in rows if r[1] != item])
    elif name == "line dedup":
        assert sum(kept.values()) == len(rows) and kept[9, ""] == 1 and kept[None, None] == kept[10, None] == 1 <= kept[5, ""]
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    else:
        assert set(kept) <= set(rows) and all(kept[r] in (0, rows.count(r)) for r in rows)
