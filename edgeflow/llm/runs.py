"""Periodic runs of words: Lyndon arrays by grouping, under both orders, extended to runs.

A *run* is a stretch with smallest period q that no neighbouring word extends.  One of the
two orders of the alphabet makes the longest Lyndon words that start in the run, past its
first word, exactly its roots of q words (the runs theorem), so the Lyndon arrays under both
orders name every run; how far the period reaches comes from the longest common extensions
(LCE) of the roots to both sides.

The Lyndon arrays come from the first phase of Baier's suffix sorter.  Suffixes lie in
groups of equal context, where a context is the Lyndon word found so far; groups are taken
from the greatest to the least.  A suffix whose context ends where l suffixes of the group
at hand follow one another takes their l contexts to its own and moves to a group just above
the one it was in.  When all groups are done, a suffix's context is its longest Lyndon prefix.

A run of ``times`` periods or more repeats each pair of neighbouring words ``times - 1`` times
or more, and each four words at least twice.  Stretches of a text without such pairs hold no
run and are set aside by counting, again and again, until nothing goes; a run lies in one of
the stretches left, whole, and so do the words that end it or their absence.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeflow.llm.text import batch_rows, utf8
from edgeflow.storage import save

#: Words that a run has at least, and periods.
LEAST, TIMES = 6, 4
#: Words of the texts that are looked at together.
WORDS = 1 << 18


def lyndon(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place; ``word`` holds numbers from 0."""
    n = len(word)
    first, size, context, members = {}, [0] * n, [0] * n, [()] * n
    # A group is known by the first of the places that it takes among the suffixes in order;
    # ``begin`` tells by the last of these where a group begins.
    begin, at = [0] * n, 0
    places: dict[int, list[int]] = {}
    for i, w in enumerate(word):
        places.setdefault(w, []).append(i)
    for w in sorted(places):
        first[w] = at
        size[at], context[at], members[at] = len(places[w]), 1, places[w]
        begin[at + size[at] - 1] = at
        at += size[at]
    group = [first[w] for w in word]
    before = [-1] * n
    end = n - 1
    while end >= 0:
        g = begin[end]
        end -= size[g]
        long = context[g]
        count: dict[int, int] = {}
        for i in sorted(x for x in members[g] if group[x] == g):
            p = i - 1
            while p >= 0 and group[p] > g:
                p = before[p]
            if p >= 0 and group[p] == g:  # it follows a suffix of its own group, so they share what lies before
                p = before[p]
            before[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, times in count.items():
            by_count.setdefault(times, []).append(p)
        for times in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_count[times]:
                moved.setdefault(group[p], []).append(p)
            for old, them in moved.items():
                size[old] -= len(them)
                new = old + size[old]
                if new > old:
                    begin[new - 1] = old
                    context[new], size[new], members[new] = context[old] + times * long, len(them), them
                    begin[new + len(them) - 1] = new
                    for p in them:
                        group[p] = new
                else:  # all of the group moves: it keeps its place
                    context[old] += times * long
                    size[old], members[old] = len(them), them
    return [context[g] for g in group]


def extension(word: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a on equal those from b on, to the right (``step`` 1) or, ending before a and b, to the left (-1)."""
    n, done, look = len(word), 0, 64
    most = n - max(a, b) if step > 0 else min(a, b)
    while done < most:
        k = min(look, most - done)
        x, y = (word[c + done : c + done + k] if step > 0 else word[c - done - k : c - done][::-1] for c in (a, b))
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + int(differ[0])
        done, look = done + k, look * 2
    return done


def runs(word: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``least`` words and ``times`` periods (2 at least) or more, in order."""
    _, rank = np.unique(word, return_inverse=True)
    found = set()
    for order in (rank, rank.max(initial=0) - rank):
        root = np.array(lyndon(order.tolist()), np.int64)
        # A run holds this many roots one after another past its first word.
        at = np.arange(len(root))
        first = np.ones(len(root), bool)
        for k in range(1, times - 1):
            first &= at + (k + 1) * root <= len(root)
            next_ = np.where(first, at + k * root, at)
            first &= root[next_] == root
            for inside in (0, root // 2, root - 1):
                first &= rank[next_ + inside] == rank[at + inside]
        reach: dict[int, int] = {}
        for i in np.flatnonzero(first).tolist():
            q = int(root[i])
            if reach.get(q, 0) >= i + q:  # a root of the run found before
                continue
            right = extension(rank, i, i + q, 1)
            left = extension(rank, i, i + q, -1)
            reach[q] = i + q + right
            if left + right + q >= max(least, times * q):
                found.add((i - left, left + right + q, q))
    return sorted(found)


def _repeated(ids: np.ndarray, stretch: np.ndarray, words: int, times: int) -> np.ndarray:
    """Whether so many words from each place on, all in its stretch, are there as often in it."""
    n = len(ids) - words + 1
    good = np.zeros(len(ids), bool)
    if n <= 0:
        return good
    name = ids
    k = 1
    while k < words:
        _, name = np.unique(name[: len(name) - k] * (len(ids) + 1) + name[k:], return_inverse=True)
        k *= 2
    inside = stretch[:n] == stretch[words - 1 :]
    _, name, count = np.unique(stretch[:n] * (len(ids) + 1) + name, return_inverse=True, return_counts=True)
    # Windows that cross into another stretch have names of their own only by chance; they are not counted on.
    good[:n] = inside & (count[name] >= times)
    return good


def stretches(ids: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Places of the stretches that may hold runs; ``ids`` from 0, ``text`` the number of the text of each word."""
    place = np.arange(len(ids))
    own, broken = ids, text
    while True:
        before = len(place)
        _, own = np.unique(own, return_inverse=True)
        stretch = np.cumsum(np.diff(broken, prepend=-1) != 0) if len(broken) else broken
        for words, often in ((2, times - 1), (4, 2)):
            good = _repeated(own, stretch, words, often)
            # Neighbours stay together if a good window covers both.
            last = np.maximum.accumulate(np.where(good, np.arange(len(own)), -words))
            joined = np.arange(len(own)) - last < words - 1
            stretch = np.cumsum(np.concatenate([[True], ~joined[:-1]])) if len(own) else stretch
        size = np.bincount(stretch)[stretch] if len(own) else stretch
        keep = size >= least
        place, own, broken = place[keep], own[keep], stretch[keep]
        if len(place) == before or not len(place):
            break
    return np.split(place, np.flatnonzero(np.diff(broken)) + 1) if len(place) else []


def repeated_tail(words: list[bytes], doc_id) -> list[bytes]:
    """The contract's rule: of every tenth hash, the words from some place on repeat so many of them."""
    n = len(words)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def _analysed(texts: list[list[bytes]], least: int, times: int):
    """For each text its words, its runs and which of its words a run repeats."""
    codes, which, base = [], [], 0
    for k, words in enumerate(texts):
        index = dict.fromkeys(words)
        for code, w in enumerate(index, base):
            index[w] = code
        codes.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        which.append(np.full(len(words), k, np.int64))
        base += len(index)
    ids, text = np.concatenate([np.zeros(0, np.int64), *codes]), np.concatenate([np.zeros(0, np.int64), *which])
    begins = np.cumsum([0, *map(len, texts)])
    found = [[] for _ in texts]
    for place in stretches(ids, text, least, times):
        k = int(text[place[0]])
        first = int(place[0] - begins[k])
        found[k] += [(first + s, n, q) for s, n, q in runs(ids[place], least, times)]
    for words, r in zip(texts, found, strict=True):
        r.sort(key=lambda x: (x[0], x[2]))
        gone = np.zeros(len(words) + 1, np.int64)
        for s, n, q in r:
            gone[s + q] += 1
            gone[s + n] -= 1
        yield words, r, np.cumsum(gone[:-1]) > 0


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, changed=None) -> DataFrame:
    """Each row's ``doc_id``, ``n_runs``, the longest run's ``start, length, period`` (in words, from 0) and ``exponent_milli``, ``runs`` and ``collapsed``.

    ``runs`` lists every run by start, then period; ``collapsed`` are the words, joined by a
    space, without those that a run holds past its first period, as UTF-8.  Words are runs of bytes
    other than 0x20 and 0x09-0x0D.  Of runs of the greatest length the first, then that of least
    period; four nulls without a run.  ``changed(words, doc_id)`` may replace a text's words
    first.  A null or blank text has no words; rows are texts of their own, whatever their
    ids, null ids too; a very long text is taken whole.  An empty table gives no rows.  Other columns are ignored.
    """
    schema = docs.select(doc_id).schema
    for name in ("n_runs", "start", "length", "period", "exponent_milli"):
        schema = schema.add(name, "long")
    runs_type = "array<struct<start: bigint, length: bigint, period: bigint>>"
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def batch(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        best, every, collapsed = [], [], []
        for words, r, gone in _analysed(texts, least, times):
            top = min(r, key=lambda x: (-x[1], x[0], x[2]), default=None)
            best.append((len(r), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None))
            every.append([dict(zip(("start", "length", "period"), x, strict=True)) for x in r])
            collapsed.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if r else b" ".join(words))
        columns = [pa.array(c, pa.int64()) for c in zip(*best, strict=True)]
        names = [doc_id, "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
        return pa.RecordBatch.from_arrays([ids, *columns, pa.array(every, pa.list_(one)), pa.array(collapsed, pa.binary())], names)

    def each(batches):
        for b in batches:
            ids, texts, first, held = b.column(0), [], 0, 0
            keys = ids.to_pylist() if changed else [None] * b.num_rows
            for k, t in enumerate(utf8(b.column(1))):
                words = t.split() if t else []
                texts.append(changed(words, keys[k]) if changed else words)
                held += len(words)
                if held >= WORDS:
                    yield batch(ids.slice(first, len(texts)), texts)
                    texts, first, held = [], k + 1, 0
            if texts:
                yield batch(ids.slice(first, len(texts)), texts)

    with batch_rows(docs.sparkSession):
        return save(docs.select(F.col(doc_id), F.col(text)).mapInArrow(each, f"{plain}, runs {runs_type}, collapsed binary"))


def runs_sha256(runs: str = "runs") -> Column:
    """SHA-256 of a line ``start,length,period`` for every run; each ends in a line feed."""
    line = F.transform(runs, lambda x: F.concat(F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return F.sha2(F.encode(F.array_join(line, ""), "UTF-8"), 256)
