"""Language-model scoring of texts: context-tree weighting over bytes, beside a word unigram base.

A text is its tokens (lower-cased words, then an end) written as bytes: every word is
followed by a space, the end is a zero byte.  A byte is decomposed into eight binary
decisions; each decision has a context tree over the preceding bytes, up to ``DEPTH``.
Every node holds the Krichevsky-Trofimov (KT) estimate of the bits seen there, and the tree
mixes, at every depth, "stop here" with "look one byte further" in the proportion of the
two block probabilities.  The trees are trained on the training texts, then held fixed.

Dataflow.  Texts are dealt into blocks of bounded size.  A block asks each shard of the
model for the distinct words and (DEPTH + 1)-grams it contains, with their training counts,
packed.  A shard owns whole subtrees: all grams with the same ``split`` bytes before the
predicted one.  Requests to a shard are added up ``FAN`` blocks at a time, round by round, so
no task sees more than ``FAN`` packed rows, and each row at most the shard's distinct grams.
A shard evaluates its subtrees once; the blocks' requests, sorted behind it, stream past it.
What travels is the distinct grams and words of blocks, so it grows with the corpus, and each
part of the model once; the model grows with the corpus's distinct grams, which its alphabet
bounds, and is dealt over as many shards as there are blocks, or as their root demands past ``SHARDS``.  Only the nodes above the subtrees go to the driver, whose number the
alphabet bounds (255 * 65,793 for three bytes) and which are counted first; past ``TOP_ROWS``
shards own the larger subtrees of two bytes, which leaves at most 255 * 257 rows above.
Words travel as 64-bit hashes, probabilities of grams in single precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeflow.llm.language import fold
from edgeflow.llm.text import batch_rows, utf8, words
from edgeflow.storage import Saved, release, save, settled

DEPTH = 6
TOP_ROWS = 1_000_000
#: Blocks up to which a part of the model stands by each (past them parts grow as the root of the blocks), and blocks that are added up at once.
SHARDS, FAN = 4096, 32
#: Bytes of text that make up a block, about.
BLOCK_BYTES = 16_000_000
END = b"\x00"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x >= 0.5: Stirling's series, shifted up by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT block probability of so many zeros and ones."""
    a, b = zeros.astype(float), ones.astype(float)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


def lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as modelled, one after the other: bytes, each text after DEPTH zeros, and the texts' own lengths."""
    own = [b" ".join([*words(t), END]) for t in texts]
    start = bytes(DEPTH)
    return np.frombuffer(b"".join([x for t in own for x in (start, t)]), np.uint8), np.fromiter(map(len, own), np.int64, len(own))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(DEPTH + 1)-grams of the texts, one per byte: the preceding bytes and the byte, big-endian; and bytes per text."""
    line, size = lines(texts)
    if not len(size):
        return np.zeros(0, np.int64), size
    gram = np.zeros(len(line) - DEPTH, np.int64)
    for j in range(DEPTH + 1):
        gram = (gram << 8) | line[j : j + len(gram)]
    # What ends in the zeros before a later text is no gram of a text.
    ends = np.cumsum(size + DEPTH) - DEPTH
    inside = np.ones(len(gram), bool)
    for k in range(DEPTH):
        inside[ends[:-1] + k] = False
    return gram[inside], size


def _bits(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per gram and decision: the path so far (1 to 255) and the bit."""
    byte = gram & 255
    k = np.arange(8)
    return (byte[:, None] | 256) >> (8 - k), (byte[:, None] >> (7 - k)) & 1


class Level:
    """Nodes of one depth: for each (context, path), bit counts and log block probabilities."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        """key: sorted and unique; below: sum of the children's weighted log probabilities."""
        self.key, self.zeros, self.ones = key, zeros, ones
        kt = log_kt(zeros, ones)
        self.weighted = kt if below is None else np.logaddexp(kt, below) - np.log(2)
        #: How much of the mixture stops at this node.
        self.stop = np.ones(len(key)) if below is None else np.exp(kt - np.log(2) - self.weighted)

    def mix(self, key: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of the bits given the deeper nodes' (NaN: no such node); NaN where this node is unseen.

        A node whose deeper node is unseen speaks for itself: fixed trees have nothing to say there.
        """
        if not len(self.key):
            return np.full(len(key), np.nan)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        z, o = self.zeros[at], self.ones[at]
        own = (np.where(bit == 1, o, z) + 0.5) / (z + o + 1.0)
        if deeper is not None:
            own = np.where(np.isnan(deeper), own, self.stop[at] * own + (1 - self.stop[at]) * deeper)
        return np.where(self.key[at] == key, own, np.nan)


def _group(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def _levels(gram: np.ndarray, n: np.ndarray, top: int) -> dict[int, Level]:
    """Nodes at depths ``top`` to DEPTH of trained grams with their counts."""
    path, bit = _bits(gram)
    context = (gram >> 8)[:, None]
    key = ((context << 8) | path).ravel()
    ones, total = (bit * n[:, None]).ravel(), np.repeat(n, 8)
    levels, below = {}, None
    for d in range(DEPTH, top - 1, -1):
        if d < DEPTH:
            # Keep the last d bytes of context.
            key = (((key >> 8) & ((1 << (8 * d)) - 1)) << 8) | (key & 255)
        key, got = _group(key, total, ones, *([] if below is None else [below]))
        total, ones = got[:2]
        levels[d] = Level(key, total - ones, ones, got[2] if below is not None else None)
        below = levels[d].weighted
    return levels


def _probability(levels: dict[int, Level], gram: np.ndarray, top: int, deeper: np.ndarray | None = None, bottom: int = DEPTH) -> np.ndarray:
    """Probability of each of the grams' eight bits, mixed over depths ``bottom`` up to ``top``."""
    path, bit = _bits(gram)
    p = deeper
    for d in range(bottom, top - 1, -1):
        context = ((gram >> 8) & ((1 << (8 * d)) - 1))[:, None]
        p = levels[d].mix(((context << 8) | path).ravel(), bit.ravel(), None if p is None else p.ravel()).reshape(-1, 8)
    return p


class Block:
    """The words and grams of a block's texts."""

    #: Bytes of text whose grams are sorted at once; bounds memory.
    PART = 1 << 21

    def __init__(self, texts: list[bytes]):
        index: dict[bytes, int] = {}
        put = index.setdefault
        found = [[put(w, len(index)) for w in words(t)] for t in texts]
        self.n_words = np.fromiter(map(len, found), np.int64, len(found))
        self.word = np.fromiter((x for f in found for x in f), np.int64, int(self.n_words.sum()))
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), np.uint64, len(index))
        self.texts = texts

    def parts(self, chosen: np.ndarray):
        """Runs of the chosen texts, of about PART bytes, and of at least one text."""
        part, size = [], 0
        for i in chosen.tolist():
            part.append(i)
            size += len(self.texts[i])
            if size >= self.PART:
                yield part
                part, size = [], 0
        if part:
            yield part

    def counts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams of the chosen texts, sorted, and how often each occurs."""
        found = [np.unique(grams([self.texts[i] for i in p])[0], return_counts=True) for p in self.parts(chosen)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gram, (n,) = _group(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return gram, n


def _shard_of_gram(gram: np.ndarray, split: int, shards: int) -> np.ndarray:
    """By the ``split`` bytes before the predicted one, mixed."""
    context = ((gram >> 8) & ((1 << (8 * split)) - 1)).astype(np.uint64)
    return ((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards


def planes(values: np.ndarray, width: int) -> bytes:
    """Sorted whole numbers as gaps, byte plane by byte plane: short once compressed."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(data: bytes, width: int, kind=np.int64) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(width, -1).T
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=np.uint64).astype(kind)


#: Bytes of a gram, of a word's hash, and of a count in a block or in a sum of blocks.
GRAM, WORD, COUNT = DEPTH + 1, 8, 6


def _counts_packed(n: np.ndarray) -> bytes:
    return n.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :COUNT].T.tobytes()


def _counts_unpacked(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(COUNT, -1).T
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :COUNT] = rows
    return out.reshape(-1).view("<u8").astype(np.int64)


def _by_shard(shard: np.ndarray, shards: int) -> list[np.ndarray]:
    """Positions of each shard's elements, in their order."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


PACKED = "words binary, word_n binary, grams binary, gram_n binary"
NAMES = ["words", "word_n", "grams", "gram_n"]


def _requests(split: int, shards: int):
    """For each shard, a block's distinct words and grams with their training counts."""

    def ask(table: pa.Table) -> pa.Table:
        block = Block([t for c in table.column("text").chunks for t in utf8(c)])
        trains = ~np.array(table.column("held").to_pylist(), bool)
        word_n = np.bincount(block.word[trains[block.doc]], minlength=len(block.hashes))
        order = np.argsort(block.hashes)
        hashes, word_n = block.hashes[order], word_n[order]
        (g, n), (other, _) = block.counts(np.flatnonzero(trains)), block.counts(np.flatnonzero(~trains))
        gram, (gram_n,) = _group(np.concatenate([g, other]), np.concatenate([n, np.zeros(len(other), np.int64)]))
        rows = [[], [], [], [], [], []]
        of_word, of_gram = _by_shard((hashes % np.uint64(shards)).astype(np.int64), shards), _by_shard(_shard_of_gram(gram, split, shards), shards)
        for s, (w, x) in enumerate(zip(of_word, of_gram, strict=True)):
            if not len(w) and not len(x):
                continue
            cells = table.column("block")[0].as_py(), s, planes(hashes[w], WORD), _counts_packed(word_n[w]), planes(gram[x], GRAM), _counts_packed(gram_n[x])
            for column, cell in zip(rows, cells, strict=True):
                column.append(cell)
        types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["block", "shard", *NAMES])

    return ask, f"block long, shard long, {PACKED}"


def _summed(table: pa.Table, keys: str, counts: str, width: int, kind) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([unplanes(b, width, kind) for b in table.column(keys).to_pylist()])
    n = np.concatenate([_counts_unpacked(b) for b in table.column(counts).to_pylist()])
    key, (n,) = _group(key, n)
    return key, n


def _merged(table: pa.Table) -> pa.Table:
    """The requests of some blocks to a shard as one."""
    word, n = _summed(table, "words", "word_n", WORD, np.uint64)
    gram, gn = _summed(table, "grams", "gram_n", GRAM, np.int64)
    cells = table.column("shard")[0].as_py(), table.column("to")[0].as_py(), planes(word, WORD), _counts_packed(n), planes(gram, GRAM), _counts_packed(gn)
    return pa.table([pa.array([c], t) for c, t in zip(cells, [pa.int64(), pa.int64(), *[pa.binary()] * 4], strict=True)], ["shard", "to", *NAMES])


def _one(table: pa.Table) -> tuple[np.ndarray, ...]:
    """A shard's words and grams with their counts, from its one merged row."""
    row = {c: table.column(c)[0].as_py() for c in NAMES}
    return unplanes(row["words"], WORD, np.uint64), _counts_unpacked(row["word_n"]), unplanes(row["grams"], GRAM), _counts_unpacked(row["gram_n"])


def _summary(split: int):
    """A shard's word totals (key -1: tokens, distinct) and its nodes, added up by what lies above them."""

    def summarise(table: pa.Table) -> pa.Table:
        _, n, gram, gn = _one(table)
        level = _levels(gram[gn > 0], gn[gn > 0], split)[split]
        up = (((level.key >> 8) & ((1 << (8 * (split - 1))) - 1)) << 8) | (level.key & 255)
        key, (zeros, ones, below) = _group(up, level.zeros, level.ones, level.weighted)
        return pa.table(
            [pa.array(np.append(key, -1)), pa.array(np.append(zeros, n.sum())), pa.array(np.append(ones, (n > 0).sum())), pa.array(np.append(below, 0.0))],
            ["key", "zeros", "ones", "below"],
        )

    return summarise, "key long, zeros long, ones long, below double"


def _top(rows: pa.Table, split: int) -> dict[int, Level]:
    """The nodes above the subtrees."""
    key, zeros, ones, below = (rows.column(c).to_numpy() for c in ("key", "zeros", "ones", "below"))
    levels = {}
    for d in range(split - 1, -1, -1):
        if d < split - 1:
            key = (((key >> 8) & ((1 << (8 * d)) - 1)) << 8) | (key & 255)
        key, (zeros, ones, below) = _group(key, zeros, ones, below)
        levels[d] = Level(key, zeros, ones, below)
        below = levels[d].weighted
    return levels


def _model(split: int, top):
    """A shard's words with their counts, and its grams with their log10 probabilities."""

    def evaluate(table: pa.Table) -> pa.Table:
        word, n, gram, gn = _one(table)
        p = _probability(_levels(gram[gn > 0], gn[gn > 0], split), gram, split)
        p = _probability(top.value, gram, 0, p, split - 1)
        logs = np.log10(np.where(np.isnan(p), 0.5, p)).sum(axis=1)
        cells = table.column("shard")[0].as_py(), planes(word, WORD), _counts_packed(n), planes(gram, GRAM), logs.astype("<f8").tobytes()
        return pa.table([pa.array([c], t) for c, t in zip(cells, [pa.int64(), *[pa.binary()] * 4], strict=True)], ["shard", *NAMES[:3], "logs"])

    return evaluate, "shard long, words binary, word_n binary, grams binary, logs binary"


def _answers():
    """What the shards' models say to requests, in the order of each request.

    Rows come sorted by shard, its model (block -1) before its requests, which stream past it.
    """

    def answer(batches):
        held = None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c) for c in ("shard", "block", "words", "word_n", "grams", "logs")), strict=True):
                shard, block = row[0].as_py(), row[1].as_py()
                w, n, g, logs = (x.as_py() for x in row[2:])
                if block < 0:
                    model = unplanes(w, WORD, np.uint64), _counts_unpacked(n), unplanes(g, GRAM), np.frombuffer(logs, "<f8").astype("<f4")
                    held = shard
                    continue
                if held != shard:
                    raise ValueError(f"no model of shard {shard}")
                word, counts, gram, log = model
                c = _counts_packed(counts[np.searchsorted(word, unplanes(w, WORD, np.uint64))])
                out.append((block, shard, c, log[np.searchsorted(gram, unplanes(g, GRAM))].tobytes()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "shard", "word_n", "logs"])

    return answer, "block long, shard long, word_n binary, logs binary"


def _scores(split: int, shards: int, end_n: int, total: int, distinct: int):
    def given(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block([t for c in docs.column("text").chunks for t in utf8(c)])
        everyone = np.arange(len(block.texts))
        by = sorted(zip(*(answers.column(c).to_pylist() for c in ("shard", "word_n", "logs")), strict=True))
        gram, _ = block.counts(everyone)
        logs = np.empty(len(gram))
        order = np.argsort(block.hashes)
        of_word, of_gram = _by_shard((block.hashes[order] % np.uint64(shards)).astype(np.int64), shards), _by_shard(_shard_of_gram(gram, split, shards), shards)
        c = np.empty(len(block.hashes))
        for s, word_n, log in by:
            c[order[of_word[s]]] = _counts_unpacked(word_n)
            logs[of_gram[s]] = np.frombuffer(log, "<f4")
        n = len(block.texts)
        score, size = np.zeros(n), np.zeros(n, np.int64)
        for p in block.parts(everyone):
            g, sizes = grams([block.texts[i] for i in p])
            seen, place = np.unique(g, return_inverse=True)
            each = logs[np.searchsorted(gram, seen)][place]
            score[p] = np.add.reduceat(each, np.cumsum(sizes) - sizes)
            size[p] = sizes
        tokens = block.n_words + 1
        base = np.bincount(block.doc, np.log10(c + 0.5)[block.word], n) + np.log10(end_n + 0.5)
        base -= tokens * np.log10(total + 0.5 * (distinct + 1))
        known = np.bincount(block.doc, (c > 0)[block.word], n).astype(np.int64) + int(end_n > 0)
        out = [docs.column("id"), docs.column("held"), size, tokens, known, np.full(n, total), base, score, -score * np.log2(10) / size]
        names = ["id", "held_out", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in out], names)

    return given, "held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


@settled
def score(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row: ``doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    Rows with ``crc32(doc_id as text) mod folds = held`` teach nothing; a null id teaches.
    ``base_score`` is the log10 probability under the smoothed word unigram, ``score`` under
    the context trees; ``bits_per_byte`` is the latter's code length over ``n_bytes``, the
    text's bytes as modelled.  Null and empty texts are one end token; a very long text is
    scored whole, within its block.  Repeated rows are rows and score alike; an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    source = source.withColumn("held", F.coalesce(fold("id", folds) == held, F.lit(False)))
    kind = source.schema["id"].dataType.simpleString()
    size, end_n = source.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held"))).first()
    n_blocks = int((size or 0) // block_bytes) + 1
    shards = n_blocks if n_blocks <= SHARDS else SHARDS * math.isqrt(n_blocks) // math.isqrt(SHARDS)
    source = source.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)))
    for split in (3, 2):
        ask, schema = _requests(split, shards)
        asked = Saved(source.groupBy("block").applyInArrow(ask, schema))
        merged, groups = asked.df.withColumnRenamed("block", "to"), n_blocks
        before = None
        while groups > 1 or before is None:
            groups = -(-groups // FAN)
            up = merged.withColumn("to", F.expr(f"`to` div {FAN}")).groupBy("shard", "to")
            up = Saved(up.applyInArrow(_merged, f"shard long, `to` long, {PACKED}"))
            if before:
                before.drop()
            before, merged = up, up.df
        summarise, schema = _summary(split)
        sums = merged.groupBy("shard").applyInArrow(summarise, schema).groupBy("key")
        sums = save(sums.agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]))
        if split == 2 or sums.count() <= TOP_ROWS:
            break
        asked.drop()
        before.drop()
    rows = sums.toArrow()
    words_row = rows.filter(pa.compute.equal(rows.column("key"), -1)).to_pylist() or [{"zeros": 0, "ones": 0}]
    total, distinct = words_row[0]["zeros"] + end_n, words_row[0]["ones"] + int(end_n > 0)
    top = spark.sparkContext.broadcast(_top(rows.filter(pa.compute.greater_equal(rows.column("key"), 0)), split))
    evaluate, schema = _model(split, top)
    model = Saved(merged.groupBy("shard").applyInArrow(evaluate, schema))
    before.drop()
    # Requests are sorted behind their shard's model: each goes once to where it is, and so does the model.
    columns = ["shard", "block", "words", "word_n", "grams", "logs"]
    models = model.df.withColumn("block", F.lit(-1).cast("bigint")).select(*columns)
    questions = asked.df.withColumns({"word_n": F.lit(None).cast("binary"), "logs": F.lit(None).cast("binary")}).select(*columns)
    answer, schema = _answers()
    with batch_rows(spark):
        answers = Saved(models.union(questions).repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(answer, schema))
    asked.drop()
    model.drop()
    release(spark)
    given, schema = _scores(split, shards, end_n, total, distinct)
    out = source.groupBy("block").cogroup(answers.df.groupBy("block")).applyInArrow(given, f"id {kind}, {schema}")
    return out.withColumnRenamed("id", doc_id)
