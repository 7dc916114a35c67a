import collections
import hashlib
import math
import pathlib
import re
import uuid
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from edgeflow.llm import chat, ctw, language, mixing, packing, queries, simhash, suffix, tokencount, vectors
from edgeflow.llm.text import words
from edgeflow.llm.tokens import word_ids
from edgeflow.operators import components, joins
from edgeflow.storage import Saved, shared_dir

SF = "/root/testdata/sf0.001"
rng = np.random.default_rng(3)
WORDS = ["".join(rng.choice(list("abcdefghijklmnoprstuéü"), int(rng.integers(1, 9)))) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


BASE = prose(120, 1)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
LONG = prose(20_000, 2)
#: doc_id, text, lang, source: nulls in every column, empty and very long texts, ties, repeated rows.
ROWS = [
    (0, BASE, "a", "x"), (1, NEAR, "a", "x"), (2, BASE.upper(), "a", None), (0, BASE, "a", "x"), (3, None, None, "y"), (4, "", "b", "y"),
    (5, " \n\t ", None, "y"), (6, "12 34 !", "b", "x"), (None, BASE, "a", "z"), (None, None, None, None), (7, LONG, "b", "x"),
    (8, prose(30, 5) + "\n" + BASE[100:500] + " tail " + prose(40, 6), "b", "x"), (9, "aaaa" * 300, "a", "y"), (10, "two words", "b", "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ["fp", "n", "start", "ids", "spans", "kept", "anchor", "class", "block", "score", "copy", "rate", "held", "id", "part"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return d.withColumns({c: F.lit("clash") for c in CLASH}).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 10 SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(items, linked):
    comp = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def test_simhash(docs, nothing):
    fps = [brute_fingerprint(t) for _, t, *_ in ROWS]
    comp = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    low = {c: min((ROWS[i][0] for i, d in enumerate(comp) if d == c and ROWS[i][0] is not None), default=None) for c in comp}
    want = sorted([(r[0], f, low[c]) for r, f, c in zip(ROWS, fps, comp, strict=True)], key=repr)
    got = [(r[0], r[1] & (2**64 - 1), r[2]) for r in rows(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")]
    assert sorted(got, key=repr) == want
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0


@pytest.mark.parametrize("tile", [1, 3, 2048])
def test_simhash_tiles_lose_nothing(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    r = np.random.default_rng(7)
    fps = {int(x) for x in r.integers(0, 2**64, 40, dtype=np.uint64)}
    fps |= {f ^ (1 << int(a)) ^ (1 << int(b)) for f in list(fps) for a, b in [r.integers(0, 64, 2)]}
    fps |= {f ^ (1 << int(r.integers(0, 64))) for f in list(fps)[:30]}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    want = {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2}
    for segments in (4, 8):
        monkeypatch.setattr(simhash, "SEGMENTS", ((1 << 63, segments),))
        got = [frozenset((r[0] & (2**64 - 1), r[1] & (2**64 - 1))) for r in simhash.links(df).collect()]
        assert set(got) == want and len(got) == len(want)


def test_one_of_each(docs):
    kept = rows(simhash.one_of_each(docs), "doc_id", "text")
    assert [i for i, _ in kept if i is not None] == [0, 10, 2, 3, 6, 7, 8, 9]  # upper-case ü and é stay
    assert not [i for i, _ in kept if i is None]


def brute_likeness(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for t in (a, b)))
    return len(x & y) / len(x | y)


def brute_kept(texts):
    """Ids that stay: one of each group linked by likeness or by two bits."""
    items = [(brute_fingerprint(t), t) for t in texts]
    comp = brute_components(items, lambda a, b: (a[0] ^ b[0]).bit_count() <= 2 or brute_likeness(a[1], b[1]) >= 0.8)
    return sorted({comp.index(c) for c in comp})


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r[0] for r in simhash.one_of_each(docs).select("doc_id").collect())


def fresh(n, seed):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**9, n))


def test_near_copies_are_those_of_likeness(spark):
    """Short texts with a word appended, and pairs just over and just under 0.8."""
    texts = []
    for n in (5, 6, 7, 8, 9, 10, 12, 20):
        texts += [fresh(n, n), fresh(n, n) + " more"]
    for seed, n in enumerate((40, 100, 400)):
        base = fresh(n, 100 + seed)
        for share in (0.70, 0.78, 0.79, 0.80, 0.81, 0.85):
            texts += [base.replace("w", f"{share}w"), base.replace("w", f"{share}w") + " " + fresh(round((n - 4) / share) - n + 4, 200 + seed)]
    texts += ["", "  ", "one", "One", "line " * 50 + fresh(30, 9), "line " * 50 + fresh(30, 10)]
    want = brute_kept(texts)
    assert kept_of(spark, texts) == want and len(want) < len(texts)
    assert [brute_likeness(texts[6], texts[7]), want.count(7)] == [0.8, 0]


def test_near_copies_with_repeated_passages(spark):
    """A repeated passage changes the number of words, not the set of shingles."""
    texts = []
    for seed in range(300, 304):
        half = fresh(100, seed)
        again = fresh(100, seed + 10)
        texts += [f"{half} {again}", f"{half} {again} {again} {again}"]
    want = brute_kept(texts)
    assert want == [0, 2, 4, 6] and kept_of(spark, texts) == want


def test_near_copies_with_blocks_added(spark):
    """No pair of likeness 0.80 to 0.85 is lost where a block is appended or put before."""
    texts = []
    for seed in range(400, 460):
        n = (8, 20, 40, 100, 200, 400)[seed % 6]
        block = fresh(int((n - 4) / 0.801) - n + 4, seed + 100)
        texts += [fresh(n, seed), f"{fresh(n, seed)} {block}" if seed % 4 < 2 else f"{block} {fresh(n, seed)}"]
    pairs = [brute_likeness(*texts[i : i + 2]) for i in range(0, len(texts), 2)]
    assert min(pairs) >= 0.8 and kept_of(spark, texts) == list(range(0, len(texts), 2))


@pytest.mark.parametrize("group", [2, 7, 256])
def test_near_copies_in_a_crowd(spark, monkeypatch, group):
    """Variants of one text, of many sizes and likenesses, whether their shingles' sets are one tile or many."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(7)
    base, texts = fresh(90, 500).split(), []
    for k in range(70):
        w = base[: int(rng.integers(50, 91))] + fresh(int(rng.integers(0, 12)), 600 + k).split()
        for at in rng.integers(0, len(w), int(rng.integers(0, 4))):
            w[at] = f"edit{k}x{at}"
        texts.append(" ".join(w))
    want = brute_kept(texts)
    assert kept_of(spark, texts) == want and 5 < len(want) < len(texts)


def test_sets_of_one_hash(spark):
    """Sets of equal first and different second 64 bits are told apart; the others keep their names."""
    rows = [(1, 5, 7, "a"), (2, 5, 7, "b"), (3, 5, 9, "c"), (4, 6, 9, "d"), (5, 5, 9, "e")]
    got = simhash._told_apart(Saved(spark.createDataFrame(rows, "id long, sid long, sid2 long, x string")))
    sid = {r["id"]: r["sid"] for r in got.df.collect()}
    assert sid[1] == sid[2] == 5 and sid[4] == 6 and sid[3] == sid[5] and sid[3] not in (5, 6)


@pytest.mark.parametrize("crowd", [0, 60, 110])
def test_tiles_lose_no_alike_pair(spark, monkeypatch, crowd):
    """Every pair of different components that is alike, from tiles of every kind; few others."""
    monkeypatch.setattr(simhash, "GROUP", 5)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: int(rng.integers(5, 400))], rng.integers(0, 1 << 63, int(rng.integers(0, 30))).astype(np.uint64)])) for _ in range(120)]
    comp = [0 if i < crowd else i % 50 for i in range(120)]
    items = [(i, len(h), comp[i], simhash.parities(h), k) for i, h in enumerate(sets) for k in range(2)]
    left = spark.createDataFrame(items, "sid long, n long, comp long, parities binary, h long").repartition(5)
    got = {(r.a, r.b) for r in simhash._tiled(left, 0.8).collect()}
    pairs = [(i, j) for i in range(120) for j in range(120) if comp[i] < comp[j]]
    alike = {(i, j) for i, j in pairs if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert alike <= got <= set(pairs) and len(got) < len(alike) + 0.1 * len(pairs) and (len(alike) > 100 or crowd)


# 2 packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))


@pytest.mark.parametrize("size,windows", [(2048, 32), (16, 2)])
def test_packing(docs, nothing, tokenizer, size, windows):
    path = queries.vocabulary("word_bpe_49k.json")
    got = packing.pack(docs, path, size=size, windows=windows, min_cut=4).collect()
    want = collections.Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in ROWS)
    pieces = collections.defaultdict(list)
    for p in got:
        ids = tuple(np.frombuffer(p["ids"], "<u4").tolist())
        assert len(ids) == p["length"] and 0 < p["length"] <= size
        pieces[p["doc_id"], p["doc_tokens"]].append((p["start"], ids))
    have = collections.Counter()
    for (doc, total), found in pieces.items():
        same = [w for w in want for _ in range(want[w]) if w[0] == doc and len(w[1]) == total]
        left = collections.Counter(x for w in same for x in enumerate(w[1]))
        left.subtract(collections.Counter((s + k, x) for s, ids in found for k, x in enumerate(ids)))
        assert not +left and not -left
        have.update(same)
    assert have == want
    for s in {p["sequence_id"] for p in got}:
        at = 0
        for p in sorted((p for p in got if p["sequence_id"] == s), key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == p["filled"] <= size
    assert packing.pack(nothing, path).count() == 0


def test_packing_pads_little(spark):
    got = packing.pack(queries.table(spark, "/root/testdata/sf0.01", "documents"), queries.vocabulary("word_bpe_49k.json"))
    total, sequences = got.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert 1 - total / (2048 * sequences) < 0.01


def test_ids_are_the_tokenizers(tokenizer):
    """Latin-1, Turkish capitals, combining marks, controls and punctuation, alone and together."""
    coder = word_ids(queries.vocabulary("word_bpe_49k.json"))
    kinds = ["aBzZ", "éÀßµªºñÿ", "İıŞĞ", "e\u0301o\u0308", "\x00\x1f\u200b\ufeff", ".,;!'-", "0189", "中文カ", "Ωж", "😀", "\u00a0\u2003 \n\t"]
    r = np.random.default_rng(4)
    for n in range(20_000):
        chosen = r.choice(len(kinds), int(r.integers(1, 4)))
        t = "".join(kinds[k][int(r.integers(len(kinds[k])))] for k in r.choice(chosen, int(r.integers(1, 9))))
        t += ["", ".", ",", "..", ".,"][n % 5]
        assert coder.ids(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


@pytest.mark.parametrize("kind", ["smallint", "string", "decimal(20,0)"])
def test_packing_ids_of_any_type(spark, kind):
    big = "12345678901234567" if kind == "decimal(20,0)" else "123"
    d = spark.createDataFrame([(big, "one two"), (None, "three"), ("7", None)], "i string, text string").select(F.col("i").cast(kind).alias("doc_id"), "text")
    got = packing.pack(d, queries.vocabulary("word_bpe_49k.json"), size=4)
    assert {None if r[0] is None else str(r[0]) for r in got.select("doc_id").collect()} == {big, None, "7"} and dict(got.dtypes)["doc_id"] == kind


# 3 language


def test_language(spark, docs, nothing):
    path = queries.vocabulary("piece_bpe_32k.model")
    d = queries.table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(d, path, keys=["doc_id", "lang"]).where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0}
    few = language.identify(docs, path).collect()
    assert len(few) == len(ROWS) and {r["lang_pred"] for r in few} <= {"a", "b", "und"}
    assert {r["doc_id"] for r in few if r["lang_pred"] == "und"} == {3, 4, 5, 6, None}
    assert language.identify(nothing, path).count() == 0
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string")), path).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def test_rare_languages_are_learned(spark):
    """A language of a few rows among many has its place, whatever the sample's size."""
    path = queries.vocabulary("piece_bpe_32k.model")
    many = [(i, f"the cat sat on the mat {i}", "en") for i in range(3000)] + [(3000 + i, f"żółw gęś łódź {i}", "pl") for i in range(3)]
    model = language.fit(spark.createDataFrame(many, "doc_id long, text string, lang string"), path, sample_rows=200)
    assert model.names == ["en", "pl"] and model.prior.tolist() == pytest.approx([3000 / 3003, 3 / 3003])
    got = model.predict(spark.createDataFrame([(1, "gęś łódź żółw"), (2, "the mat")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["pl", "en"]


def test_forward_sums_all_segmentations():
    path = queries.vocabulary("piece_bpe_32k.model")
    index, n, _ = language.vocabulary(path)
    p = np.random.default_rng(0).random((n, 2)) + 0.1
    p /= p.sum(axis=0)

    def brute(w):
        if not w:
            return np.ones(2)
        return sum(p[index[w[:k]]] * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in index)

    for w in ("▁there", "▁über", "▁a"):
        assert language.log_scores([w], p, path)[0] == pytest.approx(np.log(brute(w)))
    gain = language.expected(["▁there"], np.array([[2.0, 0.0]]), p, path)
    lengths = np.zeros(n)
    for piece, i in index.items():
        lengths[i] = len(piece)
    assert lengths @ gain[:, 0] == pytest.approx(2 * len("▁there")) and not gain[:, 1].any()


# 4 token counts


def test_token_counts(spark, docs, nothing, tokenizer, tmp_path):
    path = queries.vocabulary("word_bpe_49k.json")
    want = sorted([(r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS], key=repr)
    for most in (64 << 20, 500, 1):
        assert rows(tokencount.count_tokens(docs, path, max_bytes=most), "doc_id", "n_tokens") == want
    assert rows(tokencount.count_tokens(docs.orderBy(F.rand(1)).repartition(5, "doc_id"), path), "doc_id", "n_tokens") == want
    assert tokencount.count_tokens(nothing, path).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(tokencount, "WIDTH", 1)
            one = tokencount.count_tokens(docs, path).count()
            assert one < 0
    other = F.udf(lambda _: uuid.uuid4().int % 10**6, "long").asNondeterministic()
    shuffled = docs.withColumn("doc_id", other("text"))  # another table each time it is read
    with pytest.raises(Exception, match="differ in their documents"):
        tokencount.count_tokens(shuffled, path)
    tokencount.write_flat(docs, str(tmp_path / "f"), path)
    for block in (1, 5, 64):
        got = tokencount.stitch(tokencount.scan(spark, str(tmp_path / "f"), block=block)).collect()
        assert sorted(r["n_tokens"] for r in got) == sorted(n for _, n in want) and all(r["complete"] for r in got)
    np.array([7, 0, 0, 5, 6], "<u2").tofile(tmp_path / "part-0")
    got = tokencount.stitch(tokencount.scan(spark, str(tmp_path / "part-0"), block=2)).collect()
    assert sorted((r["ordinal"], r["n_tokens"], r["complete"]) for r in got) == [(0, 1, True), (1, 0, True), (2, 2, False)]


# 5 and 8 vectors


def vector_rows():
    r = np.random.default_rng(5)
    base = r.standard_normal((30, 16))
    out = [(i, (base[i % 30] + 0.04 * r.standard_normal(16) * (i >= 30)).tolist(), int(i % 3) if i % 7 else None) for i in range(90)]
    out += [(90, None, 1), (91, [0.0] * 16, 1), (92, [float("nan")] * 16, 1), (93, [None, *[1.0] * 15], 1), (94, [float("inf")] * 16, 1), (95, [], 1)]
    out += [(96, out[3][1], 0), (97, out[3][1], 0), (98, [2 * x for x in out[3][1]], 0), (None, out[3][1], 0), (99, [1.0, 2.0], 0), (100, [1.0, 2.0], 0)]
    return out


def test_near_links(spark, monkeypatch):
    data = vector_rows()
    usable = [v is not None and v and None not in v and np.isfinite(v).all() and any(v) and lab is not None for _, v, lab in data]

    def linked(i, j):
        (_, a, la), (_, b, lb) = data[i], data[j]
        if not (usable[i] and usable[j] and la == lb and len(a) == len(b)):
            return False
        a, b = np.array(a), np.array(b)
        return a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.98

    comp = brute_components(list(range(len(data))), linked)
    low = {c: min((data[i][0] for i, d in enumerate(comp) if d == c and data[i][0] is not None), default=None) for c in comp}
    want = sorted([(d[0], sum(linked(i, j) for j in range(len(data)) if j != i), low[comp[i]]) for i, d in enumerate(data)], key=repr)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("class", F.lit(1))
    assert sum(n for _, n, _ in want) > 100
    for block in (1024, 2):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = vectors.near_links(df)
        assert rows(got, "vec_id", "n_links", "component_id") == want
    assert vectors.near_links(df.limit(0)).count() == 0


@pytest.mark.parametrize("cosine", [0.98, 0.985, 0.99, 0.999])
def test_near_links_recall(cosine):
    """Pairs at this cosine in the table's 64 dimensions share a bucket of one of the tables."""
    r = np.random.default_rng(6)
    a = vectors.units(r.standard_normal((20_000, 64)))
    other = r.standard_normal(a.shape)
    other -= (other * a).sum(axis=1, keepdims=True) * a
    b = cosine * a + math.sqrt(1 - cosine * cosine) * vectors.units(other)
    lattice = vectors.Lattice(32, 12, 1.5)
    assert (lattice.keys(a) == lattice.keys(vectors.units(b))).any(axis=1).mean() >= 0.999


@pytest.mark.parametrize("bucket,queries_", [(4096, 512), (7, 3), (1, 1)])
def test_top_products(spark, bucket, queries_):
    r = np.random.default_rng(8)
    data = [(i, (r.standard_normal(6) * r.choice([0.01, 1, 5])).round(2).tolist()) for i in range(120)]
    data += [(120, None), (121, [float("nan")] * 6), (150, data[3][1]), (151, data[3][1]), (152, [0.0] * 6), (200, [1.0, 2.0])]
    data += [(0, data[0][1]), (0, [1.5] * 6), (7, data[7][1]), (50, data[50][1]), (None, data[9][1]), (None, data[9][1])]  # repeated and null ids
    fine = [(i, [math.floor(256 * x) for x in v] + [0] * (6 - len(v))) for i, v in data if v and np.isfinite(v).all()]
    want = []
    for q, a in fine:
        if q is not None and q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i is None, i or 0) for i, b in fine if i != q)[:5]
            want += [(q, k + 1, None if no else i, -s) for k, (s, no, i) in enumerate(best)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("norm", F.lit("x")).repartition(3)
    got = vectors.top_products(df, F.col("vec_id") % 50 == 0, bucket=bucket, queries=queries_)
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert vectors.top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pruned_tiles_are_not_joined(spark):
    """Queries that only long candidates can answer meet the level of the longest alone."""
    r = np.random.default_rng(2)
    unit = r.standard_normal((600, 8))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    data = [(i, (unit[i] * (100 if i < 300 else 0.1)).tolist()) for i in range(600)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    met = []
    save = vectors.save
    with pytest.MonkeyPatch.context() as m:


        def watched(x):
            out = save(x)
            if "deepest" in out.columns:
                met.extend(r["deepest"] for r in out.collect())
            return out

        m.setattr(vectors, "save", watched)
        vectors.top_products(df, F.col("vec_id") < 20, bucket=100, queries=10).collect()
    assert len(met) == 2 and max(met) < 5


def test_blocks_and_tiles_stay_off_the_driver(spark):
    """No join of query blocks and tiles is a broadcast, however small their files seem."""
    r = np.random.default_rng(3)
    v = r.standard_normal((2000, 32)).round(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    ints = np.floor(256 * v).astype(np.int64)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")  # a block in front of each of 50 tiles is more
    try:
        got = rows(vectors.top_products(df, F.col("vec_id") % 5 == 0, bucket=40, queries=40), "query_id", "rank", "vec_id", "score")
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    want = []
    for q in range(0, 2000, 5):
        score = ints @ ints[q]
        best = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want, key=repr)


def test_best_of_a_group_met_tile_by_tile():
    """A group's thresholds rise from tile to tile; own ids, ties, null ids and wide numbers come out as by brute force."""
    r = np.random.default_rng(4)
    for scale in (3, 40_000, 1 << 29):
        q, c = (r.integers(-scale, scale, (n, 5)) for n in (300, 900))
        ids = [None if i % 97 == 0 else int(i % 700) for i in range(900)]

        def part(v, ids):
            columns = {"row": pa.array(range(len(v)), pa.int64()), "id": pa.array(ids, pa.int64()), "norm": pa.array(np.sqrt((v.astype(float) ** 2).sum(axis=1)))}
            columns |= {"v": pa.array(v.tolist(), pa.list_(pa.int64())), "floor": pa.nulls(len(v), pa.int64())}
            return pa.StructArray.from_arrays(list(columns.values()), list(columns))

        best = vectors.Best(part(q, list(range(300))), 5, 0.9)
        for s in range(0, 900, 70):
            best.meet(part(c[s : s + 70], ids[s : s + 70]))
        got = {}
        for b in best.batches():
            for x in b.to_pylist():
                got.setdefault(x["row"], []).append((-x["score"], x["vec_id"] is None, x["vec_id"] or 0))
        for i in range(300):
            scores = [sum(int(x) * int(y) for x, y in zip(q[i], v, strict=True)) for v in c]
            assert sorted(got[i]) == sorted((-s, x is None, x or 0) for s, x in zip(scores, ids, strict=True) if x != i)[:5]


# 6 chat, 7 mixing: against SQL


def test_chat(spark):
    t = [
        (1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"), (3, 5, "user", "a"), (4, 0, "user", "a"), (4, 9, "bot", "b"), (4, 5000, "user", "c"),
        (5, None, None, None), (5, 1, "user", ""), (6, None, None, None), (None, 0, "user", "z"), (None, 0, "user", "z"), (7, 0, "user", "z"), (8, 0, "user", "ab"),
        (9, 0, "user", LONG), (9, 1, "bot", LONG), (10, 0, "user", LONG),
    ]
    df = spark.createDataFrame(t, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("x"))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", t)
    cur = con.execute(chat.ORACLE_SQL)
    names = [c[0] for c in cur.description]
    want = sorted(map(tuple, cur.fetchall()), key=repr)
    assert rows(chat.format_chats(df), *names) == want and {r[0] for r in want} == {2, 5, 8, 9, None}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_mixing(docs, nothing):
    plain = [r for r in ROWS]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", plain)
    cur = con.execute(mixing.ORACLE_SQL)
    names = [c[0] for c in cur.description]
    got = mixing.mix(docs)
    # The SQL keeps equal rows as one with a summed count; their copies are numbered on.
    have = collections.Counter((r["doc_id"], r["source"], r["text"]) for r in got.collect())
    assert have == collections.Counter(tuple(r[names.index(c)] for c in ("doc_id", "source", "text")) for r in cur.fetchall())
    assert mixing.mix(nothing).count() == 0


def test_poisson(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 19_000, "big").otherwise("small").alias("source"))
    got = dict(tuple(r) for r in mixing.mix(d, weights={"big": 0.5, "small": 0.5}, total=40_000).groupBy("source").count().collect())
    assert got["big"] == pytest.approx(20_000, rel=0.03) and got["small"] == pytest.approx(20_000, rel=0.03)
    counts = spark.range(20_000).select(mixing.poisson(F.lit(40.0), F.lit(1), F.col("id")).alias("n")).agg(F.mean("n"), F.variance("n")).first()
    assert counts[0] == pytest.approx(40, rel=0.01) and counts[1] == pytest.approx(40, rel=0.05)


# 9 language model


class BruteTree:
    """Context-tree weighting by its definition, node by node."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.children, self.known = depth, collections.Counter(), collections.defaultdict(set), {}
        for t in texts:
            for node, bit in self.decisions(t):
                for d in range(depth + 1):
                    here = self.at(node, d)
                    self.n[here, bit] += 1
                    self.known[here] = None
                    if d:
                        self.children[self.at(node, d - 1)].add(here)

    def decisions(self, text):
        line = bytes(self.depth) + b" ".join([*re.sub(rb"[A-Z]", lambda m: m[0].lower(), text).split(), b"\0"])
        for i in range(self.depth, len(line)):
            path = ""
            for bit in f"{line[i]:08b}":
                yield (line[i - self.depth : i], path), int(bit)
                path += bit

    def at(self, node, d):
        return node[0][self.depth - d :], node[1]

    def kt(self, node):
        a, b = self.n[node, 0], self.n[node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def weighted(self, node):
        if self.known[node] is None:
            own = self.kt(node)
            if len(node[0]) < self.depth:
                rest = sum(map(self.weighted, self.children[node]))
                top = max(own, rest)
                own = top + math.log(math.exp(own - top) + math.exp(rest - top)) - math.log(2)
            self.known[node] = own
        return self.known[node]

    def probability(self, node, bit, d=0):
        here = self.at(node, d)
        if here not in self.known:
            return None
        own = (self.n[here, bit] + 0.5) / (self.n[here, 0] + self.n[here, 1] + 1)
        deeper = self.probability(node, bit, d + 1) if d < self.depth else None
        if deeper is None:
            return own
        stop = math.exp(self.kt(here) - math.log(2) - self.weighted(here))
        return stop * own + (1 - stop) * deeper

    def score(self, text):
        return sum(math.log10(self.probability(node, bit) or 0.5) for node, bit in self.decisions(text))


def test_ctw(docs, nothing, monkeypatch):
    monkeypatch.setattr(ctw, "FAN", 2)
    few = [r for r in ROWS if r[0] != 7]
    train = [(t or "").encode() for i, t, *_ in few if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    seen = collections.Counter(w for t in train for w in words(t))
    total, distinct = sum(seen.values()) + len(train), len(seen) + 1
    tree = BruteTree(train, ctw.DEPTH)
    want = []
    for i, t, *_ in few:
        w = words((t or "").encode())
        base = sum(math.log10(seen[x] + 0.5) for x in w) + math.log10(len(train) + 0.5) - (len(w) + 1) * math.log10(total + 0.5 * (distinct + 1))
        want.append((i, len(w) + 1, sum(seen[x] > 0 for x in w) + 1, total, pytest.approx(base), pytest.approx(tree.score((t or "").encode()))))
    key = lambda r: (r[0] is None, r[0], r[1])
    for block_bytes in (10**9, 1000):
        got = ctw.score(docs.where("doc_id is null or doc_id <> 7"), block_bytes=block_bytes)
        got = got.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
        assert [tuple(r) for r in sorted(got, key=key)] == sorted(want, key=key)
    assert ctw.score(nothing).count() == 0
    assert ctw.score(docs).where("doc_id = 7").first()["n_tokens"] == 20_001


def test_ctw_beats_words(spark):
    got = ctw.score(queries.table(spark, "/root/testdata/sf0.01", "documents")).where("held_out")
    trees, unigrams = got.agg(F.sum("score"), F.sum("base_score")).first()
    assert trees > unigrams


def test_ctw_is_a_distribution():
    gram = ctw.grams([BASE.encode()])[0]
    levels = ctw._levels(*np.unique(gram, return_counts=True), 0)
    context = int(gram[50]) >> 8
    every = np.array([(context << 8) | b for b in range(256)])
    p = ctw._probability(levels, every, 0)
    assert np.where(np.isnan(p), 0.5, p).prod(axis=1).sum() == pytest.approx(1)


def test_planes():
    r = np.random.default_rng(1)
    for width in (7, 8):
        x = np.sort(r.integers(0, 1 << (8 * width - 1), 1000, dtype=np.uint64))
        assert (ctw.unplanes(ctw.planes(x, width), width, np.uint64) == x).all()
    assert len(ctw.unplanes(ctw.planes(x[:0], 7), 7)) == 0


# 1 suffix arrays


def brute_removed(data, least, keep):
    """Removed bytes of each (id, text), rows in corpus order."""
    starts = collections.Counter(t[s : s + least] for t in data for s in range(len(t) - least + 1))
    out, seen = [], set()
    for t in data:
        gone = bytearray(len(t))
        for s in range(len(t) - least + 1):
            w = t[s : s + least]
            if (starts[w] > 1) if keep == "none" else (w in seen):
                gone[s : s + least] = b"\1" * least
            seen.add(w)
        out.append(bytes(gone))
    return out


@pytest.mark.parametrize("group", [512, 1])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeats(spark, docs, nothing, monkeypatch, group, keep):
    monkeypatch.setattr(suffix, "GROUP", group)
    data = list(ROWS)
    data = sorted({(r[0], r[1]) for r in data}, key=lambda r: (r[0] is None, r[0] or 0)) if keep == "first" else [(r[0], r[1]) for r in data]
    texts = [(t or "").encode() for _, t in data]
    want = []
    for (i, _), t, gone in zip(data, texts, brute_removed(texts, 60, keep), strict=True):
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        want.append((i, len(t), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    got = suffix.remove_repeats(docs if keep == "none" else docs.dropDuplicates(["doc_id", "text"]), least=60, keep=keep)
    assert rows(got, "doc_id", "n_bytes", F.size("spans").cast("long"), F.sha2("kept", 256)) == sorted(want, key=repr)
    assert suffix.remove_repeats(nothing).count() == 0


def test_longest_previous():
    text = b"abracadabra-abracadabra"
    order, lcp = suffix.suffix_order(text + bytes(30), np.arange(len(text)), np.zeros(len(text), np.int64), 30)
    got = np.zeros(len(text), int)
    got[order] = suffix.longest_previous(np.arange(len(text))[order], lcp)
    for i in range(len(text)):
        best = max((k for j in range(i) for k in range(len(text) - i + 1) if text[j : j + k] == text[i : i + k]), default=0)
        assert min(got[i], len(text) - i) == best


def test_repeats_keep_the_bytes_of_stretches_once(spark, docs, monkeypatch):
    """Once different stretches are saved, the table of their occurrences has gone: one table holds their bytes."""
    base = pathlib.Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    old, seen, work = set(base.iterdir()), [], suffix._shared

    def looked(least):
        new = [str(p) for p in set(base.iterdir()) - old if p.name.startswith("edgeflow-")]
        seen.append([p for p in new if "data" in spark.read.parquet(p).columns])
        return work(least)

    monkeypatch.setattr(suffix, "_shared", looked)
    assert suffix.remove_repeats(docs, least=60, keep="none").where("size(spans) > 0").count()
    assert len(seen[0]) == 1


def test_groups_with_a_common_passage_are_not_compared_with_themselves(spark, monkeypatch):
    """Two groups of near copies share a passage, so the lowest set of one is tried for all of the other: pivots tie these, not all pairs."""
    passage, tails = [f"p{i}" for i in range(44)], [[f"{g}{i}" for i in range(20)] for g in "tu"]
    rows = [(40 * g + i, " ".join([*passage, *tails[g], f"only{g}x{i}"])) for g in (0, 1) for i in range(40)]
    checked, verified = [], simhash._verified

    def spy(docs, kinds, pairs, *more):
        checked.append(pairs.count())
        return verified(docs, kinds, pairs, *more)

    monkeypatch.setattr(simhash, "_verified", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__d", F.md5("text"))
    got = simhash.near_duplicates(docs, radius=0, keep=("__d",), similarity=0.8)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: 40 * (i // 40) for i in range(80)}
    assert sum(checked) <= 4 * len(rows), checked


def test_a_sieve_loses_no_row(spark):
    """Rows that are asked for pass, null hashes too; of the others nearly none, so that they need not be shuffled."""
    df = spark.range(20_000).select("id", F.when(F.col("id") > 0, F.xxhash64("id")).alias("h"))
    may, rest = (sorted(r.id for r in x.collect()) for x in joins.sieve(df.where("id % 40 = 0").select("h"), 500)(df, F.col("h")))
    assert sorted(may + rest) == list(range(20_000)) and set(range(0, 20_000, 40)) <= set(may) and len(may) < 2_000


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_connected_is_the_same_by_a_forest(spark, monkeypatch, few):
    monkeypatch.setattr(components, "SMALL", few)
    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, p)) for p in rng.integers(-50, 50, (40, 2))] + [(None, 3)]
    want = {i: i for p in pairs[:-1] if p[0] != p[1] for i in p}
    for _ in want:
        for a, b in pairs[:-1]:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    for links in (pairs, []):
        got = components.connected(spark.createDataFrame(links, "src long, dst long")).collect()
        assert sorted((r.id, r.comp) for r in got) == (sorted(want.items()) if links else [])


def test_pivots_and_checks_shuffle_no_text_that_is_not_asked_for(spark, monkeypatch):
    """Of 200 texts two are near copies: the join that checks them takes a few of the texts."""
    taken, real = [], simhash.sieve

    def spy(keys, rows):
        parts = real(keys, rows)

        def count(df, h):
            out = parts(df, h)
            taken.append(out[0].count())
            return out

        return count

    monkeypatch.setattr(simhash, "sieve", spy)
    texts = [fresh(60, 900 + i) for i in range(199)]
    assert kept_of(spark, [*texts, f"{texts[5]} more"]) == list(range(199))
    assert taken and max(taken) < 20
