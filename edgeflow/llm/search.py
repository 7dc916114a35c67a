"""Ranked lexical search, reversed: the items' inverted index is broadcast and documents stream through it.

A document's terms are counted once, against the vocabulary of the items, and saved: which of
these terms it holds, how often, and how many terms it has in all.  From these rows come the
corpus counts (documents, terms, documents per term), then the scores: each task holds the
index (for each term the items with it and how often), turns a batch of documents into
scores and keeps the ``k`` best documents of each item so far.  What tasks have kept is
merged in two steps, by item and share, then by item.

The index is of the items, never of the documents.  Items are taken in blocks of about
``BLOCK_BYTES`` of text, so that an index of any number of items fits; documents are
streamed once for each block.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from edgeflow.llm.text import batch_rows, utf8
from edgeflow.storage import Saved, save, settled

#: Bytes that separate terms (all of ASCII but digits and letters), and A-Z to lower case.
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
#: Text of the items of a block, about.
BLOCK_BYTES = 4 << 20
#: Cells of the matrix of documents and items, or of documents and terms, that is held at once.
CELLS = 1 << 22
#: Shares by which what tasks keep is merged first.
SHARES = 64
#: Scores below this are whole numbers in doubles.
EXACT = 1 << 53


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _count(vocabulary: dict[bytes, int]):
    """Of each text: how many terms, which of the vocabulary's, and how often each."""

    def each(batches):
        for b in batches:
            n, which, often = [], [], []
            for t in utf8(b.column(1)):
                found = terms(t)
                own = Counter(x for x in map(vocabulary.get, found) if x is not None)
                n.append(len(found))
                which.append(list(own.keys()))
                often.append(list(own.values()))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "terms", "tfs"])

    return each


def _totals(size: int):
    """Documents with terms, all terms, and documents for each term, as (key, count): one row of each a task."""

    def each(batches):
        docs, every, df = 0, 0, np.zeros(size, np.int64)
        for b in batches:
            n = b.column(0).to_numpy()
            docs, every = docs + int((n > 0).sum()), every + int(n.sum())
            df += np.bincount(pa.compute.list_flatten(b.column(1)).to_numpy(), minlength=size)
        held = np.flatnonzero(df)
        keys, counts = np.concatenate([[-2, -1], held]), np.concatenate([[docs, every], df[held]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "count"])

    return each


class Index:
    """The items' terms with their weights, and how often each item holds each term."""

    def __init__(self, found: list[list[int]], weights: np.ndarray, docs: int, every: int):
        self.docs, self.every, self.weights, self.items = docs, every, weights, len(found)
        pairs = Counter((t, i) for i, own in enumerate(found) for t in own)
        self.term, self.item, self.times = (np.array(x, np.int64) for x in zip(*((t, i, c) for (t, i), c in sorted(pairs.items())), strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        self.begin = np.searchsorted(self.term, np.arange(len(weights) + 1))
        longest = max((len(own) for own in found), default=0)
        self.exact = longest * int(weights.max(initial=0)) * 1_000_000 < EXACT

    def scores(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Documents by items: ``row, term, tf`` are the documents' terms, ``n`` their lengths."""
        product = 75 * self.docs
        mean = (n * product if int(n.max(initial=0)) * product < 1 << 63 else n.astype(object) * product) // max(self.every, 1)
        m = 25 + mean.astype(np.int64)
        worth = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        out = np.zeros(len(n) * self.items, np.int64)
        # A term's worth goes to each of its items, so many at a time.
        each = self.begin[term + 1] - self.begin[term]
        turn = np.cumsum(each) // CELLS
        for part in np.split(np.arange(len(term)), np.flatnonzero(np.diff(turn)) + 1):
            k = each[part]
            posting = np.repeat(self.begin[term[part]] - np.cumsum(k) + k, k) + np.arange(k.sum())
            cell = np.repeat(row[part], k) * self.items + self.item[posting]
            add = np.repeat(worth[part], k) * self.times[posting]
            if self.exact:
                out += np.bincount(cell, add, len(out)).astype(np.int64)
            else:
                np.add.at(out, cell, add)
        return out.reshape(len(n), self.items)


def _best(held, k: int, kind: pa.DataType):
    """The ``k`` best documents of each item that this task has seen, as (item, score, doc)."""

    def each(batches):
        index: Index = held.value
        heaps: list[list[tuple]] = [[] for _ in range(index.items)]
        least = np.ones(index.items, np.int64)
        for b in batches:
            ids = b.column(0).to_pylist()
            every = b.column(1).to_numpy()
            for a in range(0, b.num_rows, step := max(1, CELLS // max(index.items, 1))):
                z = min(a + step, b.num_rows)
                own, often = (b.column(c).slice(a, z - a) for c in (2, 3))
                row = np.repeat(np.arange(z - a), pa.compute.list_value_length(own).to_numpy())
                score = index.scores(every[a:z], row, *(pa.compute.list_flatten(x).to_numpy().astype(np.int64) for x in (own, often)))
                for i in np.flatnonzero((score >= least).any(axis=0)).tolist():
                    new = np.flatnonzero(score[:, i] >= least[i])
                    new = new if len(new) <= 4 * k else new[score[new, i] >= np.partition(score[new, i], -k)[-k]]
                    heaps[i] = sorted([*heaps[i], *((-int(score[d, i]), ids[a + d] is None, ids[a + d]) for d in new.tolist())], key=lambda x: x[:2] + ((x[2],) if x[2] is not None else ()))[:k]
                    if len(heaps[i]) == k:
                        least[i] = -heaps[i][-1][0]
        rows = [(i, -s, d) for i, own in enumerate(heaps) for s, _, d in own]
        for at in range(0, len(rows), 1 << 16):
            items, score, doc = zip(*rows[at : at + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(score, pa.int64()), pa.array(doc, kind)], ["item", "score", "doc"])

    return each


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item, with ``rank``."""
    for key in (["item", F.pmod(F.xxhash64("doc", "score"), F.lit(SHARES))], ["item"]):
        order = Window.partitionBy(*key).orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows


def _block(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """``item, rank, doc, score`` for these texts, numbered from 0, whose index fits in a task."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    found = [[vocabulary.setdefault(t, len(vocabulary)) for t in terms(text.encode())] for text in texts]
    kind = docs.schema["doc"].dataType
    schema = T.StructType().add("doc", kind).add("n", "long").add("terms", T.ArrayType(T.IntegerType())).add("tfs", T.ArrayType(T.LongType()))
    with batch_rows(spark):
        counted = Saved(docs.mapInArrow(_count(vocabulary), schema))
        sums = counted.df.select("n", "terms").mapInArrow(_totals(len(vocabulary)), "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))
        sums = {r["key"]: r["count"] for r in sums.collect()}  # a row for each term of these items, and two
        n, every = sums.get(-2, 0), sums.get(-1, 0)
        weights = np.array([weight(n, sums.get(t, 0)) for t in range(len(vocabulary))], np.int64)
        held = spark.sparkContext.broadcast(Index(found, weights, n, every))
        best = T.StructType().add("item", "long").add("score", "long").add("doc", kind)
        kept = save(_merged(counted.df.mapInArrow(_best(held, k, to_arrow_type(kind)), best), k))
    held.destroy()
    counted.drop()
    return kept


@settled
def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank`` (from 1), ``doc_id`` and ``score``, all scores above 0.

    A term of weight w that a document holds tf times adds w * (10^9 tf div (1000 tf + 8 m))
    for each time the item holds it; m is 25 plus 75 times the document's length over the
    mean.  Equal scores by ascending id, null ids last.  A null, empty or termless text, of an
    item or a document, is found with nothing; documents of equal or null id are documents of
    their own, and equal items are items of their own.  Very long texts are counted whole.
    Without documents or items there are no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    texts = save(asked.select("text").distinct())
    blocks = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    out = None
    for b in range(blocks):
        own = [r[0] for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()]
        kept = _block(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")), own, k)
        part = kept.join(spark.createDataFrame(list(enumerate(own)), "item long, text string"), "item")
        out = part if out is None else out.union(part)
    return out.join(asked, "text").select(F.col("id").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_id), "score")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), t AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL
), len AS (
  SELECT doc_id, count(*) AS n FROM d GROUP BY ALL
), c AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS every FROM len
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term, docs
), own AS (
  SELECT item_id, term, count(*) AS times FROM t GROUP BY ALL
), s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // every))))::BIGINT AS score
  FROM own JOIN tf USING (term) JOIN w USING (term) JOIN len USING (doc_id), c GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
