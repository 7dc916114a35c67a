"""Ranked search, periodic runs and sharding against brute force, with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edgeflow.llm import queries, runs, search, sharding
from tests.llm.test_operators import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COMMON = "The same  line, again and again"
LOOP = "one two three " * 9
#: doc_id, text; a third of the rows are copies of one text, and two rows are equal.
DOCS = (
    [(i, prose(40 + i, 300 + i)) for i in range(40)]
    + [(100 + i, COMMON) for i in range(60)]
    + [(200, None), (201, ""), (202, " \t\n"), (203, "... --"), (204, "ÄÖ Ä İi THE"), (205, LOOP), (206, "a " * 30), (207, prose(6000, 9)), (208, LOOP + "x " + LOOP), (209, COMMON), (209, COMMON), (None, COMMON), (None, prose(20, 3)), (None, prose(20, 3)), (210, "a b a b a b a b c"), (211, "Aa aa Aa aa Aa aa Aa aa"), (212, "x" * 100_000)]
)
ITEMS = [(0, "the same line, THE line"), (1, prose(30, 301)), (2, None), (3, ""), (4, "ä İi"), (5, "nothing-has-this"), (6, "again"), (6, "again"), (None, "one two a"), (7, prose(60, 9))]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame([(i, t, "user's") for i, t in DOCS], "doc_id long, text string, size string").repartition(5)
    return d.selectExpr("*", "'s' AS shard", "'x' AS score", "'r' AS rank", "'r' AS runs", "'c' AS collapsed").persist()


def brute_search(docs, items, k=10):
    found = [(i, collections.Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    n_docs, every = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        own, scored = TERM.findall((text or "").translate(UPPER)), []
        for i, c in found:
            m = 25 + 75 * sum(c.values()) * n_docs // every
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            scored += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def brute_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    # A longer period of the same run shows as a stretch inside or around it: keep those whose period is smallest.
    return sorted((s, n, q) for (s, n), q in found.items() if not any(all(words[s + k] == words[s + k + p] for k in range(n - p)) for p in range(1, q)))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_search(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS score", "2 AS doc_id")
    got = search.search(docs, items)
    assert rows(got, "item_id", "rank", "doc_id", "score") == sorted(brute_search(DOCS, ITEMS), key=repr)
    assert search.search(docs.limit(0), items).collect() == [] and search.search(docs, items.limit(0)).collect() == []


def test_search_in_blocks(spark, docs, monkeypatch):
    """Many blocks of items, few cells at once, sums past what doubles hold: the same rows."""
    monkeypatch.setattr(search, "BLOCK_BYTES", 100)
    monkeypatch.setattr(search, "EXACT", 1)
    monkeypatch.setattr(search, "CELLS", 64)
    items = spark.createDataFrame(ITEMS[:2] + ITEMS[6:9], "item_id long, text string")
    got = search.search(docs.where("doc_id < 120"), items, k=3)
    assert rows(got, "item_id", "rank", "doc_id", "score") == sorted(brute_search([d for d in DOCS if d[0] is not None and d[0] < 120], ITEMS[:2] + ITEMS[6:9], 3), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24))
def test_lyndon_arrays(word):
    lengths = [max(k for k in range(1, len(word) - i + 1) if all(word[i : i + k] < word[j : i + k] for j in range(i + 1, i + k))) for i in range(len(word))]
    assert runs.lyndon(word) == lengths


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 4), st.integers(0, 70))
def test_runs_of_random_words(seed, letters, n):
    r = random.Random(seed)
    word = [r.randrange(letters) for _ in range(n)]
    for _ in range(r.randrange(3)):
        if n > 8:
            a, q = r.randrange(n - 4), r.randint(1, 7)
            word = word[:a] + [word[min(n - 1, a + (i - a) % q)] for i in range(a, min(n, a + q * 6))] + word[a + q * 6 :]
    ids = np.array(word, np.int64)
    assert runs.runs(ids, 2, 2) == brute_runs(word, 2, 2)
    found = [(int(p[0]) + s, k, q) for p in runs.stretches(ids, np.zeros(len(ids), np.int64)) for s, k, q in runs.runs(ids[p])]
    assert sorted(found) == brute_runs(word)


def brute_collapse(i, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        a, e = h // 10 % n, 3 + h // 10 % 8
        words = [words[k] if k < a else words[a + (k - a) % (1 + (n - a) // e)] for k in range(n)]
    found = brute_runs(words) if len(words) < 3000 else []
    top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (i, len(found), *top, 1000 * top[1] // top[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_op12(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "WORDS", 500)
    # Ids whose hash repeats a tail, over texts of their own.
    planted = [(i, prose(60 + i % 90, i)) for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs.select("doc_id", "text", "size", "runs").union(spark.createDataFrame([(i, t, "", "") for i, t in planted], "doc_id long, text string, size string, runs string")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    want = [brute_collapse(i, t) for i, t in DOCS + planted]
    assert rows(got, "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256") == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 12
    text = {r["doc_id"]: bytes(r["collapsed"]) for r in runs.find_runs(docs).collect()}
    assert text[205] == b"one two three" and text[206] == b"a" and text[200] == b""
    assert runs.find_runs(docs.limit(0)).collect() == []


def test_op13(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_sharding(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(sharding.ORACLE_SQL)
    names = [c[0] for c in cur.description]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted(cur.fetchall(), key=repr)
    check_shards([(r["doc_id"], r["size"], r["shard"], r["slot"], r["text_crc32"]) for r in got], 40, {i: t for i, t in DOCS if i is not None})


def check_shards(got, n, texts):
    total, largest = sum(r[1] for r in got), max(r[1] for r in got)
    held = collections.defaultdict(list)
    for _, size, shard, slot, _ in got:
        held[shard].append((slot, size))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in held.values()) and set(held) <= set(range(n))
    assert all(abs(sum(s for _, s in held.get(k, [])) - total / n) <= largest for k in range(n))
    for i, size, _, _, crc in got:
        if i is not None:
            raw = (texts[i] or "").encode()
            assert (size, crc) == (len(raw) + 16, zlib.crc32(raw))


def test_shards_of_few_rows(spark, docs):
    """Shards that split the common text, keep small groups whole, and give all columns back."""
    some = docs.where("doc_id between 5 and 160 or doc_id in (201, 209)").select("doc_id", "text", "shard", "runs")
    out = sharding.shards(some, 7)
    assert out.columns == ["doc_id", "text", "runs", "size", "shard", "slot"]
    got = [(r["doc_id"], r["size"], r["shard"], r["slot"], zlib.crc32((r["text"] or "").encode())) for r in out.collect()]
    check_shards(got, 7, dict(DOCS))
    assert len({g[2] for g in got if g[0] and 100 <= g[0] < 160}) > 1
    assert sharding.shards(docs.limit(0), 3).collect() == []
    odd = sharding.shards(docs.where("doc_id is null or text is null"), 2).select("shard", "slot").collect()
    assert len(odd) == sum(i is None or t is None for i, t in DOCS) == len(set(map(tuple, odd)))


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(DOCS) and {r[0] for r in back.select("shard").distinct().collect()} <= set(range(5))
