"""URL filters, periodic runs and whitening against brute force and exact arithmetic, with odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmere.llm import catalog, periodic, urlfilter, whitening
from lexmere.llm.shared import table


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.floats(0, 1), st.integers(0, 2**32))
def test_a_cascade_is_exact_on_its_universe(n, share, seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 2**64, (n, 2), np.uint64)
    listed = rng.random(n) < share
    levels = urlfilter.load(urlfilter.dump(urlfilter.build(keys, listed)))
    assert (urlfilter.holds(levels, keys) == listed).all()


def test_a_cascade_is_small():
    keys = np.random.default_rng(1).integers(0, 2**64, (200_000, 2), np.uint64)
    listed = np.arange(len(keys)) < 2_000
    assert len(urlfilter.dump(urlfilter.build(keys, listed))) * 8 < 20 * 2_000
    with pytest.raises(RuntimeError):
        urlfilter.build(np.ones((2, 2), np.uint64), np.array([True, False]))


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def verdict_of(url, rules, listed):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[3], "block" if max(fits)[2] else "allow"
    return host, path, None, "block" if host in listed else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/1?x#y", "x://y://z.net/es/", "http://a.net/fr/?q=http://b.com/", "http://.net/es/x", "http://net/es/",
    "http://net./es/", "http://xnet/es/1", "http://a.b.c.d.e.net/fr/9", "http://user@bad.org:80/es/", "http://bad.org", "http://bad.org#frag", "http://BAD.org?x", "http://sub.bad.org/", "http://é.com/en/", "http://İ.example.com/en/x",
    "http://example.com/en", "http://example.com/EN/", "a\n://multi.net\n/fr/", "http://" + "a." * 3000 + "net/es/" + "x" * 9000, "http://www.www.example.com/en/", "http://?evil.com/", "http://a.com/xy", "http://m.a.com/xyz",
]


@pytest.mark.parametrize("volume_bytes, shard_keys", [(1 << 25, 500_000), (200, 5)])
def test_urls_are_judged_as_by_hand(spark, volume_bytes, shard_keys):
    rules = [*catalog.URL_RULES, ("a.com", "/xy", "block"), ("m.a.com", "/", "allow"), ("", "/", "block"), ("never.fits", "xy", "block"), ("?evil.com", "", "block"), ("tie.org", "/", "allow"), ("tie.org", "/", "block")]
    listed = {"bad.org", "nowhere.org", "?evil.com"}
    urls = [*URLS, *URLS, "http://tie.org/1"]
    pages = spark.createDataFrame([(i % 50 or None, u, "x", "y", "z") for i, u in enumerate(urls)], "page_id long, url string, host string, marks string, rule string")
    both = lambda p: urlfilter.judge(p, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(x,) for x in listed], "host string"), volume_bytes, shard_keys)
    got = sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in both(pages).collect())))
    assert got == sorted(str((i % 50 or None, *verdict_of(u, rules, listed))) for i, u in enumerate(urls))
    assert both(pages.limit(0)).count() == 0
    none = urlfilter.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "host string"))
    assert [r["verdict"] for r in none.collect()] == ["allow"] * len(urls)


def brute_runs(words, least=24, times=3):
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32))
def test_runs_are_those_of_brute_force(seed):
    rng = random.Random(seed)
    n, k = rng.randint(0, 500), rng.choice([1, 2, 3, 60])
    words = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 5 else 0):
        a, p = rng.randrange(n), rng.randint(1, n // 3 + 1)
        for i in range(a, min(n, a + p * rng.randint(2, 9) + rng.randint(0, p))):
            words[i] = words[a + (i - a) % p]
    ids = np.unique(words, return_inverse=True)[1] if n else np.zeros(0, np.int64)
    least, times = rng.choice([(24, 3), (2, 2), (6, 4)])
    assert periodic.runs_of(ids, least, times) == brute_runs(words, least, times)


def test_runs_of_long_texts():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 400, 60_000)
    ids[20_000:50_000] = ids[20_000:29_000].tolist() * 3 + ids[20_000:23_000].tolist()
    ids[55_000:] = 7
    got = periodic.runs_of(ids)
    assert got[0][2] == 9_000 and got[0][0] <= 20_000 <= got[0][0] + 3 and got[1][2] == 1 and len(got) == 2
    assert periodic.runs_of(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]


def expected_runs(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    listed = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), n


def test_runs_of_a_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = {tuple(r) for r in catalog.op12_periodic_runs(spark, sf_dir).collect()}
    assert got == {expected_runs(*d) for d in docs} and any(r[1] for r in got)


def test_runs_with_odd_rows(spark):
    texts = [None, "", " \t\n ", "one", "a " * 23, "a " * 24, "É\x1cü " * 40, "x y z\x0b" * 9 + "tail", "w" * 50_000 + " b" * 30, "\u3000 c " * 30]
    rows = [(i if i % 3 else None, t, "x") for i, t in enumerate(texts * 2 + [" ".join(map(str, range(400)))] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    assert sorted(map(str, (tuple(r) for r in periodic.find_runs(docs, edit=periodic.repeated_tail).collect()))) == sorted(str(expected_runs(i, t)) for i, t, _ in rows)
    assert periodic.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, times=1)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(1, 90), st.integers(0, 2**32))
def test_products_of_slices_are_exact(rows, dim, bits, seed):
    rng = random.Random(seed)
    x = [[rng.randint(-(1 << bits), 1 << bits) for _ in range(dim)] for _ in range(rows)]
    a = np.array(x, np.int64 if bits < 62 else object).reshape(rows, dim)
    want = [[sum(r[i] * r[j] for r in x) for j in range(dim)] for i in range(dim)]
    got = whitening.gram(a).tolist()
    assert got == want
    pieces = whitening.to_pieces([v for row in got for v in row])
    assert [whitening.from_pieces(p) for p in zip(*pieces, strict=True)] == [v for row in want for v in row]


def test_a_block_at_the_bound_is_exact():
    x = np.full((whitening.BLOCK + 3, 1), (1 << 48) - 1, np.int64)
    assert whitening.gram(x)[0, 0] == len(x) * ((1 << 48) - 1) ** 2


def test_whitening_of_a_whole_table(spark, sf_dir):
    source = {r["vec_id"]: [int(np.floor(64 * float(v))) + 1_000_000 for v in r["embedding"]] for r in table(spark, sf_dir, "embeddings").collect()}
    rows = catalog.op13_whitening(spark, sf_dir).collect()
    ids, n = sorted(source), len(source)
    x = np.array([source[i] for i in ids], object)
    d = n * x - x.sum(axis=0)
    exact = (d.T @ d)  # of Python integers
    v = np.array([[Fraction(c, n**3) for c in row] for row in exact.tolist()], float)
    values, vectors = np.linalg.eigh(v)
    want = (d.astype(float) / n) @ vectors[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    assert len(rows) == n * 32
    got = np.zeros((n, 32))
    for r in rows:
        got[ids.index(r["vec_id"]), r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum(c * c for c in d[ids.index(r["vec_id"])]) and r["identity_error"] < 1e-9
        assert abs(r["explained"] / (values[::-1][r["component"] - 1] / values.sum()) - 1) < 1e-9
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-8
    assert min(np.abs(got - want * np.sign((got * want).sum(axis=0))).max(axis=0)) < 1e-8


def test_whitening_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [[float(v) for v in rng.normal(size=3)] for _ in range(40)]
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [-1e300, 1e300, 0.0]]
    schema = "vec_id long, embedding array<double>, n string, component string"
    frame = lambda vectors: spark.createDataFrame([(i or None, v, "x", "y") for i, v in enumerate(vectors)], schema).repartition(3)
    rows = whitening.whiten(frame([*good, good[0], good[0], *odd[:6]]), "vec_id", "embedding").collect()
    assert len(rows) == 42 * 3 and {r["n"] for r in rows} == {42} and {r["component"] for r in rows} == {1, 2, 3} and rows[0]["identity_error"] < 1e-9
    far = whitening.whiten(frame([*good, *odd]), "vec_id", "embedding").collect()
    assert len(far) == 41 * 3 and all(r["deviation"] is None for r in far)
    flat = whitening.whiten(frame([[1.0, 2.0, 3.0]] * 5), "vec_id", "embedding").collect()
    assert len(flat) == 15 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in flat)
    line = whitening.whiten(frame([[float(i), 2.0 * i, 1.0] for i in range(9)]), "vec_id", "embedding").collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True), (3, True)} and line[0]["identity_error"] < 1e-9
    assert whitening.whiten(frame(good).limit(0), "vec_id", "embedding").count() == 0
    whole, x = whitening.integers(pa.array([[1.0, None], None, [0.5, -0.5]]).slice(1), 2)
    assert whole.tolist() == [1] and x.tolist() == [[1_000_032, 999_968]]
