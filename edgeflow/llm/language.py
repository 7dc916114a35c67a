"""Language identification by segmentation-marginalised unigrams.

A language is a probability for every piece of a fixed public vocabulary.  The probability
of a word is the sum, over all its segmentations into pieces, of the product of the pieces'
probabilities (the forward algorithm); a text's is the product over its words.  The piece
probabilities are fitted by expectation-maximisation over all segmentations.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeflow.llm.text import batch_rows
from edgeflow.storage import Saved, save

LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of a word that is scored among others of its length; the sums of a longer one are rescaled as they grow.
#: The model learns from a longer run of letters in pieces of so many.
WORD = 63
MARK = "▁"
LEAST = 1e-6
#: Probabilities are scaled so per character, to stay clear of underflow.
SCALE = 1e4
CACHE = 4_500_000
#: Labels that may be languages, at most: a probability of every piece for each goes to all tasks (258 MB for so many).
LANGUAGES = 1000
#: A worker's word scores under the model it used last.
_SCORED: dict = {}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], int, int]:
    """Piece -> index, number of indices, length of the longest piece.

    A character outside the vocabulary is the byte piece of its leading UTF-8 byte.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    index = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    index |= {f"<0x{b:02X}>": n + b for b in range(256)}
    return index, n + 256, max(map(len, index))


#: A piece is looked up by a rolling hash of its code points.
START, STEP = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3 * 0x9E3779B1 + 2 & 0xFFFFFFFFFFFFFFFF | 1)


@lru_cache(maxsize=2)
def _hashed(path: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sorted hashes of the pieces, their indices, the longest piece's length, the first byte piece's index."""
    index, n, longest = vocabulary(path)
    h = []
    for piece in index:
        x = int(START)
        for c in piece:
            x = (x ^ ord(c)) * int(STEP) & 0xFFFFFFFFFFFFFFFF
        h.append(x)
    h = np.array(h, np.uint64)
    order = np.argsort(h)
    if (np.diff(h[order]) == 0).any():
        raise ValueError("two pieces have one hash")
    return h[order], np.array(list(index.values()), np.int64)[order], longest, n - 256


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased, with the word mark before each."""
    found = [w for w in LETTERS.findall(text.lower()) if w.isascii() or any(map(str.isalpha, w))] if text else []
    return [MARK + w for w in found]


def short_words(text: str | None) -> list[str]:
    """``words``, the long ones in pieces."""
    return [MARK + w[i : i + WORD] for w in words(text) for i in range(1, len(w), WORD)]


def _edges(group: list[str], path: str) -> tuple[np.ndarray, ...]:
    """Segmentation lattice of words of one length: word, start, end, piece of every edge."""
    hashes, pieces, longest, first_byte = _hashed(path)
    n = len(group[0])
    letters = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, n)
    found: list[tuple] = []
    for j in range(n):
        h = np.full(len(group), START)
        for i in range(j + 1, min(n, j + longest) + 1):
            h = (h ^ letters[:, i - 1]) * STEP
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            piece = np.where(hashes[at] == h, pieces[at], -1)
            if i == j + 1:
                c = letters[:, j].astype(np.int64)
                lead = np.select([c < 0x80, c < 0x800, c < 0x10000], [c, 0xC0 | c >> 6, 0xE0 | c >> 12], 0xF0 | c >> 18)
                piece = np.where(piece < 0, first_byte + lead, piece)
            word = np.flatnonzero(piece >= 0)
            found.append((word, np.full(len(word), j), np.full(len(word), i), piece[word]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _by(first: np.ndarray, second: np.ndarray, n: int):
    """Edges sorted by (first, second), and for each value of first its slice and group starts."""
    order = np.lexsort((second, first))
    f, s = first[order], second[order]
    bounds = np.searchsorted(f, np.arange(n + 1))
    return order, bounds, [np.flatnonzero(np.diff(s[a:b], prepend=-1)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def forward(group: list[str], p: np.ndarray, path: str) -> tuple[np.ndarray, tuple]:
    """Scaled sums over segmentations, ``[word, position, language]``, of words of one length."""
    word, start, end, piece = _edges(group, path)
    n = len(group[0])
    a = np.zeros((len(group), n + 1, p.shape[1]))
    a[:, 0] = 1
    scaled = p[piece] * (SCALE ** (end - start))[:, None]
    order, bounds, starts = _by(end, word, n + 1)
    for i in range(1, n + 1):
        e = order[bounds[i] : bounds[i + 1]]
        a[:, i] = np.add.reduceat(a[word[e], start[e]] * scaled[e], starts[i], axis=0)
    return a, (word, start, end, piece, scaled)


def log_score_long(word: str, p: np.ndarray, path: str) -> np.ndarray:
    """``log_scores`` of one word of any length: only the last sums are held, and rescaled on the way."""
    hashes, pieces, longest, first_byte = _hashed(path)
    letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
    n = len(letters)
    lead = np.select([letters < 0x80, letters < 0x800, letters < 0x10000], [letters, 0xC0 | letters >> 6, 0xE0 | letters >> 12], 0xF0 | letters >> 18)
    h = np.full(n, START)
    piece = np.full((n, longest), -1)  # by first letter and length less one
    for k in range(min(longest, n)):
        h = (h[: n - k] ^ letters[k:].astype(np.uint64)) * STEP
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        piece[: n - k, k] = np.where(hashes[at] == h, pieces[at], -1)
    piece[:, 0] = np.where(piece[:, 0] < 0, first_byte + lead, piece[:, 0])
    recent = np.zeros((longest, p.shape[1]))  # sums over segmentations up to each of the last places, by place modulo longest
    recent[0] = 1
    total = np.zeros(p.shape[1])
    for i in range(1, n + 1):
        size = np.arange(1, min(i, longest) + 1)
        by = piece[i - size, size - 1]
        ends = by >= 0
        scaled = p[by[ends]] * (SCALE ** size[ends])[:, None]
        recent[i % longest] = (recent[(i - size[ends]) % longest] * scaled).sum(axis=0)
        if i % 16 == 0:
            top = recent.max(axis=0)
            recent /= top
            total += np.log(top)
    return total + np.log(recent[n % longest]) - n * np.log(SCALE)


def log_scores(batch: list[str], p: np.ndarray, path: str) -> np.ndarray:
    """Natural log probability of each word under each language."""
    out = np.empty((len(batch), p.shape[1]))
    sizes = np.fromiter(map(len, batch), np.int64, len(batch))
    for i in np.flatnonzero(sizes > WORD + len(MARK)):
        out[i] = log_score_long(batch[i], p, path)
    for n in np.unique(sizes[sizes <= WORD + len(MARK)]):
        at = np.flatnonzero(sizes == n)
        for k in range(0, len(at), 4096):
            part = at[k : k + 4096]
            a, _ = forward([batch[i] for i in part], p, path)
            out[part] = np.log(a[:, n]) - n * np.log(SCALE)
    return out


def expected(batch: list[str], counts: np.ndarray, p: np.ndarray, path: str) -> np.ndarray:
    """Expected piece counts ``[piece, language]`` of words with the given counts per language."""
    total = np.zeros_like(p)
    sizes = np.fromiter(map(len, batch), np.int64, len(batch))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for k in range(0, len(at), 4096):
            part = at[k : k + 4096]
            a, (word, start, end, piece, scaled) = forward([batch[i] for i in part], p, path)
            b = np.zeros_like(a)
            b[:, n] = counts[part] / a[:, n]
            order, bounds, starts = _by(start, word, n + 1)
            for j in range(n - 1, 0, -1):
                e = order[bounds[j] : bounds[j + 1]]
                b[:, j] = np.add.reduceat(b[word[e], end[e]] * scaled[e], starts[j], axis=0)
            gain = a[word, start] * scaled * b[word, end]
            for lang in range(p.shape[1]):
                total[:, lang] += np.bincount(piece, gain[:, lang], len(total))
    return total


def fold(doc_id: str, mod: int = 5) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


class Languages:
    """Fitted piece probabilities ``p[piece, language]`` and the languages' shares of documents."""

    def __init__(self, names: list, p: np.ndarray, prior: np.ndarray, path: str):
        self.key = uuid.uuid4().hex
        self.names, self.p, self.prior, self.path = names, p, prior, path

    def predict(self, docs: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
        """``keys`` (all columns by default), ``lang_pred`` and ``score``, the posterior of the prediction.

        The result is computed at once, in small batches, and saved.
        Keys of these names give way.  ``und`` and 0 where a text is null or has no letter, or where no language is known.
        """
        keys = [c for c in (docs.columns if keys is None else keys) if c not in ("lang_pred", "score")]
        at_text = keys.index(text) if text in keys else len(keys)
        names, p, prior, path = [str(x) for x in self.names], self.p, np.log(self.prior), self.path
        model = self.key

        def each(batches):
            if _SCORED.get("model") != model:
                _SCORED.clear()
                _SCORED.update(model=model, known={}, table=np.empty((1 << 16, max(1, len(names)))))
            known, table = _SCORED["known"], _SCORED["table"]
            for b in batches:
                texts = [words(t) for t in b.column(at_text).to_pylist()] if names else [[]] * b.num_rows
                if len(known) * table.shape[1] > CACHE:
                    known.clear()
                fresh = list({w for t in texts for w in t} - known.keys())
                if fresh:
                    while len(known) + len(fresh) > len(table):
                        table = np.concatenate([table, np.empty_like(table)])
                    table[len(known) : len(known) + len(fresh)] = log_scores(fresh, p, path)
                    _SCORED["table"] = table
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                said, score = [], []
                for t in texts:
                    if not t:
                        said.append("und")
                        score.append(0.0)
                        continue
                    z = prior.copy()
                    at = np.fromiter(map(known.__getitem__, t), np.int64, len(t))
                    for k in range(0, len(at), 1 << 16):
                        z += table[at[k : k + (1 << 16)]].sum(axis=0)
                    z = np.exp(z - z.max())
                    said.append(names[int(z.argmax())])
                    score.append(float(z.max() / z.sum()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(said, pa.string()), pa.array(score, pa.float64())], [*keys, "lang_pred", "score"])

        schema = docs.select(*keys).schema.add("lang_pred", "string").add("score", "double")
        rows = docs.select(*keys) if text in keys else docs.select(*keys, F.col(text).alias("__text"))
        with batch_rows(docs.sparkSession):
            return save(rows.mapInArrow(each, schema))


def fit(labelled: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 10_000, rounds: int = 3) -> Languages:
    """Fit on ``sample_rows`` rows with a language at most, evenly from each language: those whose hash lies below its share.

    Languages and their priors come from a count over all rows.  The shares follow from it, so
    the sample is bounded in the mean, whatever the input, and a language of few rows is
    learned from all of them.  More than ``LANGUAGES`` languages raise.  Rows of null language
    teach nothing; null texts only count as documents of their language.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    share = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(share) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    names = sorted(share)
    _, n, _ = vocabulary(path)
    if not names:
        return Languages([], np.zeros((n, 0)), np.zeros(0), path)
    most = [(x, int(min(1.0, sample_rows / len(names) / share[x]) * (1 << 32))) for x in names]
    below = labelled.sparkSession.createDataFrame(most, f"lang {rows.schema['lang'].dataType.simpleString()}, below long")
    bounded = Saved(rows.join(F.broadcast(below), "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 32)) < F.col("below")).drop("below"))
    column = {x: i for i, x in enumerate(names)}

    def counted(batches):
        seen = Counter()
        for b in batches:
            for x, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen.update((column[x], w) for w in short_words(t))
            if len(seen) > 300_000:
                yield out(seen)
                seen = Counter()
        yield out(seen)

    def out(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w for _, w in seen], pa.string()), pa.array([x for x, _ in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["word", "lang", "n"]
        )

    spread = bounded.df.select("lang", "text").repartition(max(8, labelled.sparkSession.sparkContext.defaultParallelism))
    pairs = spread.mapInArrow(counted, "word string, lang long, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    with batch_rows(labelled.sparkSession):
        table = Saved(pairs)
    p = np.full((n, len(names)), 1.0 / n)
    for _ in range(rounds):
        p = _refit(table.df, p, path)
    table.drop()
    bounded.drop()
    prior = np.array([share[x] for x in names], float)
    return Languages(names, p, prior / prior.sum(), path)


def _refit(table: DataFrame, p: np.ndarray, path: str) -> np.ndarray:
    def gained(batches):
        total = np.zeros_like(p)
        for b in batches:
            seen, at = np.unique(np.array(b.column("word").to_pylist(), object), return_inverse=True)
            counts = np.zeros((len(seen), p.shape[1]))
            np.add.at(counts, (at, b.column("lang").to_numpy()), b.column("n").to_numpy())
            total += expected(list(seen), counts, p, path)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["piece", "lang", "n"])

    gains = table.mapInArrow(gained, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
    with batch_rows(table.sparkSession, 20_000):
        rows = gains.toArrow()  # one row for each piece and language at most
    out = np.zeros_like(p)
    out[rows.column("piece").to_numpy(), rows.column("lang").to_numpy()] = rows.column("n").to_numpy()
    return np.maximum((out + 0.01) / (out + 0.01).sum(axis=0), LEAST)


def identify(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keys: list[str] | None = None,
    folds: int = 5, sample_rows: int = 10_000,
) -> DataFrame:
    """Fit on the rows outside the held-out fold and predict every row: ``keys``, ``held_out``, ``lang_pred``, ``score``.

    The held-out fold has ``crc32(doc_id as text) mod folds = 0``; a null id is not held out.
    ``und`` and 0 where a text is null or has no letter; of equally likely languages the first
    by name is taken; a very long text is scored whole.  Repeated rows are rows and score
    alike; an empty table gives no rows; other columns are ignored unless in ``keys``.
    """
    out = F.coalesce(fold(doc_id, folds) == 0, F.lit(False))
    model = fit(docs.where(~out), path, doc_id, text, lang, sample_rows)
    keys = [doc_id] if keys is None else keys
    held = docs.withColumn("held_out", out)
    return model.predict(held, text, [*[c for c in keys if c != "held_out"], "held_out"])
