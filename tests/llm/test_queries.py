"""The registered queries and the pipeline's stages, against brute force on small tables."""

import collections
import hashlib
import math
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edgeflow.llm import language, mixing, queries, stages
from tests.llm.test_operators import BASE, brute_components, brute_fingerprint, brute_likeness, brute_removed, prose

SF = "/root/testdata/sf0.001"
#: What stages and operators add, as columns of the user's.
CLASH = ["score", "lang_pred", "held_out", "n_bytes", "spans", "kept", "copy", "rate", "position_key", "fp", "sid", "component_id", "id", "text_", "scored"]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


PASSAGE = prose(90, 41)
LONG = prose(30_000, 43)
#: doc_id, text, lang, source
DOCS = [
    (0, BASE, "a", "x"), (1, BASE.replace(BASE.split()[60], "changed", 1), "a", "x"), (0, BASE, "a", "x"), (2, None, "a", "y"), (3, "", "b", None), (4, " \n ", "b", "y"),
    (5, prose(30, 51) + " " + PASSAGE + " " + prose(60, 52), "a", "x"), (6, prose(45, 53) + "\n" + PASSAGE + " " + prose(20, 54), "b", "x"), (7, LONG, "a", "y"),
    (8, "word " * 500, "b", "x"), (None, prose(40, 55), None, "x"), (None, prose(40, 55), None, "x"), (None, None, None, None), (9, "12 34 ..", "a", "x"), (10, prose(25, 56), "b", "z"),
    (11, prose(20, 57) + " " + " ".join(PASSAGE.split()[:30]) + " " + prose(20, 58), "a", "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("int"))
    return d.withColumns({c: F.lit(f"user's {c}") for c in CLASH}).repartition(3).persist()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, docs, stage):
    got = stage(spark, docs, SF)
    assert got.dtypes == docs.dtypes and got.count() > 0
    for c in CLASH:
        assert {r[0] for r in got.select(c).distinct().collect()} == {f"user's {c}"}
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_language_stage(spark, docs):
    got = rows(stages.known_language(spark, docs, SF), "doc_id", "text")
    assert got == sorted([r[:2] for r in DOCS if r[1] and re.search(r"[a-zü]", r[1])], key=repr)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert stages.known_language(spark, unlabelled, SF).count() == len(DOCS)


def test_near_copies_stage(spark, docs):
    items = [(brute_fingerprint(t), t or "") for _, t, *_ in DOCS]
    comp = brute_components(items, lambda a, b: (a[0] ^ b[0]).bit_count() <= 2 or (bool(a[1].split()) and bool(b[1].split()) and brute_likeness(a[1], b[1]) >= 0.8))
    want = {}
    for (i, t, *_), c in zip(DOCS, comp, strict=True):
        key = (i is None, i or 0, hashlib.md5(t.encode()).hexdigest() if t is not None else "")
        want[c] = min(want.get(c, (key, i, t)), (key, i, t), key=lambda x: x[0])
    assert rows(stages.near_copies(spark, docs, SF), "doc_id", "text") == sorted([w[1:] for w in want.values()], key=repr)


def test_repeats_stage(spark, docs):
    data = sorted({(r[0], r[1]) for r in DOCS if r[0] is not None}, key=lambda r: r[0])
    texts = [(t or "").encode() for _, t in data]
    want = []
    for (i, t), raw, gone in zip(data, texts, brute_removed(texts, stages.PASSAGE, "first"), strict=True):
        cut = bytearray(len(raw))
        for m in re.finditer(b"\1+", gone):
            a, b = m.span()
            while a and raw[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(raw) and raw[b] & 0xC0 == 0x80:
                b += 1
            if len(raw[a:b].split()) >= stages.PASSAGE_WORDS:
                cut[a:b] = b"\1" * (b - a)
        kept = bytes(x for x, g in zip(raw, cut, strict=True) if not g).decode()
        if not any(cut):
            want.append((i, t, None if t is None else len(t)))
        elif kept:
            want.append((i, kept, len(kept)))
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    assert rows(stages.repeats(spark, some, SF), "doc_id", "text", "n_chars") == sorted(want, key=repr)
    assert len(next(t for i, t, _ in want if i == 6)) < len(dict(data)[6]) and dict((i, t) for i, t, _ in want)[11] == dict(data)[11]


def test_mixing_stage(spark, docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", DOCS)
    cur = con.execute(mixing.ORACLE_SQL)
    at = [[c[0] for c in cur.description].index(c) for c in ("doc_id", "source", "text")]
    want = collections.Counter(tuple(r[i] for i in at) for r in cur.fetchall())
    assert collections.Counter(tuple(r) for r in stages.mixed(spark, docs, SF).select("doc_id", "source", "text").collect()) == want
    # Copies of a row are numbered from 0.
    one = mixing.mix(docs.where("doc_id = 10"), total=5).select("copy").collect()
    assert sorted(r[0] for r in one) == list(range(len(one)))


def test_packing_stage(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    got = stages.packed(spark, docs, SF)
    total = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, *_ in DOCS)
    assert got.agg(F.sum("length")).first()[0] == total and stages.packed(spark, docs.limit(0), SF).count() == 0


def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents")
    first, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == first.columns, name
        kept.append({r[0] for r in docs.select("doc_id").collect()})
    assert len(kept[0]) == 200 and kept[1] < kept[0] and kept[2] <= kept[1] and kept[3] <= kept[2]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    total = sum(len(t.encode(r[0], add_special_tokens=False).ids) + 1 for r in docs.select("text").collect())
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == total


# Queries on tables of their own


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with long shared passages, and embeddings with planted links, as a folder of tables."""
    folder = str(tmp_path_factory.mktemp("tables"))
    shared = prose(120, 71)
    texts = [r[1] for r in DOCS] + ["under" * 40 + " the", "x" * 64, "é" * 63 + " a"] + [prose(50, 80 + i) + " " + shared[i : 600 + 3 * i] + "é " + prose(30, 90 + i) for i in range(8)] + [shared, shared + " x", "ü" * 300, "ü" * 300 + "a"]
    data = [(i, t, ("a", "b", None)[i % 3], ("x", "y")[i % 2], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    r = np.random.default_rng(9)
    base = r.standard_normal((60, 64))
    vecs = [(i, base[i % 60] if i < 60 else base[i % 60] + r.standard_normal(64) * r.choice([0.05, 0.1, 0.15, 0.2, 0.25]), i % 60 % 4) for i in range(240)]
    spark.createDataFrame([(i, v.tolist(), lab) for i, v, lab in vecs], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder, data


def test_op1(spark, tables):
    folder, data = tables
    texts = [(t or "").encode() for _, t, *_ in data]
    want = []
    for (i, *_), t, gone in zip(data, texts, brute_removed(texts, 400, "none"), strict=True):
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        want.append((i, len(t), len(t) - len(kept), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    assert sum(w[2] > 0 for w in want) > 8
    got = queries.op1_suffix_dedup(spark, folder)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    plain = {r["doc_id"]: r["text"] for r in got.where("n_removed = 0").collect()}
    assert all(plain[i] == (t or "") for i, t, *_ in data if i in plain)


def test_op2(spark, tables):
    from tokenizers import Tokenizer

    folder, data = tables
    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    got = queries.op2_packing(spark, folder).collect()
    for i, text, *_ in data:
        ids, at = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted((p for p in got if p["doc_id"] == i), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def test_op3_posterior(spark, tables):
    """The score is the posterior of the prediction, by sums over segmentations word by word."""
    folder, data = tables
    path = queries.vocabulary("piece_bpe_32k.model")
    docs = queries.table(spark, folder, "documents")
    model = language.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"), path)
    index, _, _ = language.vocabulary(path)

    def log_word(w, lang):
        a = [Fraction(1)] + [Fraction(0)] * len(w)  # of words of any length
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - 20), j):
                piece = index.get(w[i:j], index[f"<0x{w[i].encode()[0]:02X}>"] if j == i + 1 else None)
                if piece is not None:
                    a[j] += a[i] * Fraction(float(model.p[piece, lang]))
        return math.log(a[-1].numerator) - math.log(a[-1].denominator)

    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, folder).collect()}
    assert len(got) == len(data)
    for i, text, *_ in data:
        w = language.words(text)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        if not w:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
        elif len(w) < 200:
            z = np.array([math.log(model.prior[k]) + sum(log_word(x, k) for x in w) for k in range(len(model.names))])
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert got[i]["lang_pred"] == model.names[int(z.argmax())] and got[i]["score"] == pytest.approx(p.max(), abs=1e-6)


def test_op4(spark, tables):
    from tokenizers import Tokenizer

    folder, data = tables
    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = [(i, len(t.encode(text or "", add_special_tokens=False).ids)) for i, text, *_ in data]
    assert rows(queries.op4_token_counts(spark, folder), "doc_id", "n_tokens") == sorted(want, key=repr)


def test_op9(spark, tables):
    """Base, counts and fold by brute force; the trees' scores are log probabilities that beat the base on texts they were trained on."""
    folder, data = tables
    text_words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for i, t, *_ in data}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in text_words}
    seen = collections.Counter(w for i, ws in text_words.items() if not held[i] for w in ws)
    ends = sum(not h for h in held.values())
    total, distinct = sum(seen.values()) + ends, len(seen) + 1
    got = {r["doc_id"]: r for r in queries.op9_lm_scoring(spark, folder).collect()}
    assert got.keys() == text_words.keys()
    for i, ws in text_words.items():
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (distinct + 1))) for c in [*(seen[w] for w in ws), ends])
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws) + 1, sum(seen[w] > 0 for w in ws) + 1, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert sum(r["score"] - r["base_score"] for i, r in got.items() if not held[i]) > 0


def test_op10(spark, tables):
    folder, data = tables
    items = [brute_fingerprint(t) for _, t, *_ in data]
    comp = brute_components(items, lambda a, b: (a ^ b).bit_count() <= 2)
    want = [(i, f"{f:016x}", min(data[k][0] for k in range(len(data)) if comp[k] == c)) for (i, *_), f, c in zip(data, items, comp, strict=True)]
    assert rows(queries.op10_simhash(spark, folder), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_op5(spark, tables):
    folder, _ = tables
    data = [(r["vec_id"], np.array(r["embedding"], np.float32).astype(float), r["label"]) for r in queries.table(spark, folder, "embeddings").orderBy("vec_id").collect()]

    def linked(i, j):
        (_, a, la), (_, b, lb) = data[i], data[j]
        return la == lb and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.98

    comp = brute_components(range(len(data)), linked)
    n = [sum(linked(i, j) for j in range(len(data)) if j != i) for i in range(len(data))]
    assert sum(n) > 100
    want = [(data[i][0], n[i], data[comp.index(comp[i])][0], comp.index(comp[i]) == i) for i in range(len(data))]
    assert rows(queries.op5_embedding_dedup(spark, folder), "vec_id", "n_links", "component_id", "kept") == sorted(want, key=repr)


def test_op8(spark, tables):
    folder, _ = tables
    data = [(r["vec_id"], [math.floor(256 * float(np.float32(x))) for x in r["embedding"]]) for r in queries.table(spark, folder, "embeddings").collect()]
    want = []
    for q, a in data:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in data if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert rows(queries.op8_topk(spark, folder), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_settings_stay(spark, tables):
    """No query leaves the session's batch settings changed."""
    folder, _ = tables
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    queries.op4_token_counts(spark, folder).count()
    queries.op10_simhash(spark, folder).count()
    queries.op1_suffix_dedup(spark, folder).count()
    assert [spark.conf.get(k) for k in keys] == before


def test_tables_go(spark, tables):
    """A settled operator leaves its result alone in the shared folder; a scope leaves nothing."""
    import os

    from edgeflow.storage import scope, shared_dir

    folder, _ = tables
    at = shared_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(at))
    assert queries.op5_embedding_dedup(spark, folder).count() == 240
    assert len(set(os.listdir(at)) - before) == 1
    before = set(os.listdir(at))
    with scope(spark):
        assert queries.op10_simhash(spark, folder).count() > 0
    assert set(os.listdir(at)) == before
