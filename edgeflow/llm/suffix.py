"""Repeated passages by suffix arrays: longest-previous-factor arrays over candidate stretches.

A byte goes if it lies in a string of ``least`` bytes that also starts elsewhere (or, to
keep the first copy, earlier).  Suffixes are sorted, neighbours' common prefixes found, and
the previous and next smaller positions in suffix order give each suffix its longest match
with an earlier position (the longest previous factor); the greater positions give the
later ones.

A suffix array over the whole corpus is not needed: equal strings of ``least`` bytes choose
the same anchor, the leftmost k-byte string of least hash within them.  Every string start
thus belongs to one anchor, the starts of an anchor occurrence are one run, and a run's
bytes are a *stretch*.  Strings match only if their stretches have equal anchors, so

1. anchors that occur once in the corpus are set aside by counting hashes;
2. the stretches of the others are cut out; equal stretches become one, with a count;
3. stretches of one anchor get a suffix array together.

An anchor with more than ``GROUP`` different stretches (a passage that very many documents
share in different surroundings) is cut into finer stretches by a longer anchor inside
each, level by level, up to ``least`` bytes, where equal anchors are equal stretches; so no
group grows with the corpus, nothing is capped, and the result is the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeflow.llm.text import batch_rows, utf8
from edgeflow.operators.joins import sieve
from edgeflow.storage import Saved, release, save, settled

#: Different stretches of one anchor that share a suffix array.
GROUP = 512
#: Anchor lengths by level, as shares of ``least`` short of the whole; the last level is whole strings.
FINER = (0.16, 0.84, 0.98, 1.0)
#: String starts whose anchors are found at once.
PIECE = 1 << 17
PLACE = np.uint64((1 << 20) - 1)
MULTIPLIER = 0x9E3779B97F4A7C15
_SYMBOL = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)


def _powers(base: int) -> np.ndarray:
    out = np.full(1 << 18, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(MULTIPLIER), _powers(pow(MULTIPLIER, -1, 1 << 64))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k-byte string: rolling, alike wherever the string stands."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOL[data] * _UP[: len(data)], out=total[1:])
    n = len(data) - k + 1
    h = (total[k:] - total[:-k]) * _DOWN[:n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values: block minima from the left and from the right."""
    n = len(h) - w + 1
    grid = np.full(-(-len(h) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(h)] = h
    grid = grid.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(texts: list[bytes], least: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts of one anchor: text, first start, number of starts, anchor hash.

    The anchor of a string is its leftmost k-byte string of least hash, by the hash's upper 44 bits.
    """
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    out: list[tuple] = []
    for a in range(0, max(0, len(flat) - least + 1), PIECE):
        data = flat[a : a + PIECE + least - 1]
        h = gram_hashes(data, k)
        low = window_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), least - k + 1)
        place = (low & PLACE).astype(np.int64)
        start = np.arange(a, a + len(low))
        doc = np.searchsorted(ends, start, "right")
        ok = start + least <= ends[np.minimum(doc, len(ends) - 1)]
        place, start, doc = place[ok], start[ok], doc[ok]
        if len(start):
            new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            out.append((doc[new], start[new] - (ends - sizes)[doc[new]], np.diff(new, append=len(start)), h[place[new]]))
    if not out:
        out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def longest_previous(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factors in suffix order.

    ``position`` lists the suffixes' positions in suffix order, ``lcp[i]`` the common prefix
    of suffixes i - 1 and i.  The earlier position that shares the most with a suffix is its
    previous or next smaller position in that order; both are found for all suffixes at once
    by jumping along the pointers of those passed over, with the least common prefix on the way.
    """
    n = len(position)
    best = np.zeros(n, lcp.dtype)
    for side in (1, -1):
        p = np.append(position[::side], -1)  # a sentinel below all, at index -1
        between = lcp if side == 1 else np.append(lcp[1:], 0)[::-1]
        to, share = np.arange(-1, n - 1), between.copy()
        todo = np.flatnonzero(p[to] > p[:n])
        while len(todo):
            over = to[todo]
            share[todo] = np.minimum(share[todo], share[over])
            to[todo] = to[over]
            todo = todo[p[to[todo]] > p[todo]]
        share[to < 0] = 0
        best = np.maximum(best, share[::side])
    return best


def suffix_order(buffer: bytes, starts: np.ndarray, groups: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by group, then by their first ``least`` bytes; common prefixes of neighbours."""
    order = np.empty(len(starts), np.int64)
    bounds = np.append(np.flatnonzero(np.diff(groups, prepend=-1)), len(starts)).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        cut = [buffer[s : s + least] for s in starts[a:b].tolist()]
        order[a:b] = sorted(range(b - a), key=cut.__getitem__)
        order[a:b] += a
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(buffer, np.uint8), least)
    lcp = np.zeros(len(starts), np.int64)
    at = starts[order]
    for a in range(1, len(at), 2048):
        x, y = rows[at[a - 1 : a + 2047][: len(at[a : a + 2048])]], rows[at[a : a + 2048]]
        differ = x != y
        lcp[a : a + 2048] = np.where(differ.any(axis=1), differ.argmax(axis=1), least)
    lcp[np.array(bounds[:-1], np.int64)] = 0
    return order, lcp


def _runs(flags: np.ndarray) -> list[int]:
    """Flattened [from, to) pairs of the set flags."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).tolist()


def _shared(least: int):
    """Suffix arrays over groups of stretches; the batches' rows are sorted by anchor and first occurrence."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        data = [r[3] for r in rows]
        counts = np.array([len(d) - least + 1 for d in data])
        base = np.cumsum([0, *map(len, data[:-1])])
        starts = np.concatenate([np.arange(b, b + c) for b, c in zip(base, counts, strict=True)])
        group = np.repeat(np.unique([r[0] for r in rows], return_inverse=True)[1], counts)
        order = np.argsort(group, kind="stable")
        starts, group = starts[order], group[order]
        sa, lcp = suffix_order(b"".join(data), starts, group, least)
        position = starts[sa]
        earlier, later = longest_previous(position, lcp), longest_previous(-position + position.max(), lcp)
        size = sum(map(len, data))
        lead, any_ = np.zeros(size, bool), np.zeros(size, bool)
        lead[position] = earlier >= least
        any_[position] = (earlier >= least) | (later >= least)
        out = [], [], [], []
        for (_, c1, c2, d, n), b, c in zip(rows, base, counts, strict=True):
            out[0].append(c1)
            out[1].append(c2)
            out[2].append([0, int(c)] if n > 1 else _runs(any_[b : b + c]))
            out[3].append(_runs(lead[b : b + c]))
        pairs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pairs, pairs), strict=True)], ["c1", "c2", "any", "lead"])

    def each(batches):
        held: list[tuple] = []
        for b in batches:
            held.extend(zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield work(held[:cut])
                held = held[cut:]
        if held:
            yield work(held)

    return each, "c1 long, c2 long, any array<long>, lead array<long>"


def _digest(stretch: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(stretch, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _cut(least: int, owner: list[str], types: str):
    """Stretches at given runs: rows of ``owner`` columns, the text and a list of (start, n, anchor)."""

    def each(batches):
        for b in batches:
            rows = []
            for *keys, t, runs in zip(*(b.column(i).to_pylist() for i in range(len(owner))), utf8(b.column(len(owner))), b.column(len(owner) + 1).to_pylist(), strict=True):
                for r in runs:
                    s = t[r["start"] : r["start"] + r["n"] + least - 1]
                    rows.append((*keys, r["start"], r["anchor"], *_digest(s), s))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    names = [*owner, "start", "anchor", "c1", "c2", "data"]
    kinds = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in zip(owner, types.split(), strict=True)] + [(n, pa.int64()) for n in names[len(owner) : -1]] + [("data", pa.binary())])
    return each, ", ".join([f"{n} {t}" for n, t in zip(owner, types.split(), strict=True)] + ["start long, anchor long, c1 long, c2 long, data binary"])


def _different(cut: DataFrame, least: int) -> Saved:
    """The different stretches of ``cut``, which has a row for each occurrence: ``at`` (its place in corpus order), ``n`` (how often), anchor, digest and bytes."""
    held = cut.groupBy("anchor", "c1", "c2").agg(F.first("data").alias("data"), F.sum("n").alias("n"), F.min("at").alias("at"))
    held = Saved(held.withColumn("m", (F.length("data") - least + 1).cast("long")))
    release(cut.sparkSession)
    return held


def _matches(held: Saved, least: int, level: int) -> DataFrame:
    """``c1, c2, any, lead, at``: the matched starts of every stretch that has some; the table of different stretches then goes.

    ``any`` are runs of starts that match elsewhere, ``lead`` those that match earlier, for the first occurrence, which is at ``at``.
    """
    unique = held.df
    # Saved, so that the joins are plain shuffle joins, whose large partitions Spark may split.
    sizes = save(unique.groupBy("anchor").agg(F.count("*").alias("different")))
    none, whole = F.array().cast("array<bigint>"), F.array(F.lit(0).cast("long"), "m")
    alone = unique.where("n > 1").select("anchor", "c1", "c2", "m").join(sizes.where("different = 1"), "anchor")
    alone = alone.select("c1", "c2", whole.alias("any"), none.alias("lead"))
    work, schema = _shared(least)
    # The bytes of stretches whose anchor has no other are not shuffled again.
    several, hashed = sizes.where(f"different between 2 and {GROUP}"), F.xxhash64("anchor")
    some = sieve(several.select(hashed), several.count())(unique.select("anchor", "c1", "c2", "data", "n", "at"), hashed)[0]
    some = some.join(several, "anchor")
    some = some.repartition("anchor").sortWithinPartitions("anchor", "at").select("anchor", "c1", "c2", "data", "n")
    found = alone.union(some.mapInArrow(work, schema))
    crowded = sizes.where(f"different > {GROUP}")
    if level + 1 < len(FINER) and crowded.limit(1).count():
        found = found.union(_finer(unique.join(crowded, "anchor", "left_semi"), least, level + 1))
    found = Saved(found.where("size(any) > 0"))
    out = save(found.df.join(unique.select("c1", "c2", "at"), ["c1", "c2"]))
    held.drop()
    found.drop()
    return out


def _finer(stretches: DataFrame, least: int, level: int) -> DataFrame:
    """``c1, c2, any, lead`` of stretches by cutting them at longer anchors."""
    k = max(1, int(least * FINER[level]))

    def runs(batches):
        for b in batches:
            texts = b.column("data").to_pylist()
            doc, start, n, anchor = anchors(texts, least, k)
            rows = []
            p1, p2 = b.column("c1").to_pylist(), b.column("c2").to_pylist()
            for d, s, m, x in zip(doc.tolist(), start.tolist(), n.tolist(), anchor.view(np.int64).tolist(), strict=True):
                part = texts[d][s : s + m + least - 1]
                rows.append((p1[d], p2[d], s, x, *_digest(part), part))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["p1", "p2", "start", "anchor", "c1", "c2", "data"])

    parts = save(stretches.select("c1", "c2", "data").mapInArrow(runs, "p1 long, p2 long, start long, anchor long, c1 long, c2 long, data binary"))
    a = parts.withColumn("m", F.length("data") - least + 1).alias("a")
    b = stretches.select(F.col("c1").alias("p1"), F.col("c2").alias("p2"), "n", F.col("at").alias("whole_at")).alias("b")
    placed = a.join(b, ["p1", "p2"]).withColumn("at", F.col("whole_at").withField("start", F.col("whole_at.start") + F.col("start")))
    found = _matches(_different(placed, least), least, level).withColumnRenamed("at", "first_at")
    joined = placed.select("p1", "p2", "start", "at", "c1", "c2", "m").join(found, ["c1", "c2"])
    move = lambda c: F.transform(c, lambda x: x + F.col("start"))
    lead = F.when(F.col("at") == F.col("first_at"), F.col("lead")).otherwise(F.array(F.lit(0).cast("long"), F.col("m").cast("long")))
    each = joined.select("p1", "p2", move("any").alias("any"), move(lead).alias("lead"))
    both = each.groupBy("p1", "p2").agg(F.flatten(F.collect_list("any")).alias("any"), F.flatten(F.collect_list("lead")).alias("lead"))
    return both.select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), "any", "lead")


def _spans(parts: list[dict], least: int) -> list[tuple[int, int]]:
    """Merged byte spans covered by strings at the matched starts."""
    runs = sorted((p["start"] + a, p["start"] + b + least - 1) for p in parts for a, b in zip(p["runs"][::2], p["runs"][1::2], strict=True))
    out: list[tuple[int, int]] = []
    for a, b in runs:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _whole(spans: list[tuple[int, int]], t: bytes) -> list[tuple[int, int]]:
    """Spans widened to character bounds; those that then touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        while a and t[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(t) and t[b] & 0xC0 == 0x80:
            b += 1
        if out and a <= out[-1][1]:
            a = out.pop()[0]
        out.append((a, b))
    return out


@settled
def _remove_repeats(docs: DataFrame, doc_id: str, text: str, least: int, keep: str, columns: list[str] | None, characters: bool, least_words: int) -> DataFrame:
    """See ``remove_repeats``."""
    spark = docs.sparkSession
    columns = [c for c in ([doc_id] if columns is None else columns) if c not in ("n_bytes", "spans", "kept")]
    kind = docs.schema[doc_id].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    key = {"__id": F.col(doc_id), "__t1": F.xxhash64(body), "__t2": F.xxhash64(F.lit(1), body)}
    source = docs.select(*columns, *[c.alias(n) for n, c in key.items()], body.alias("__text"))
    long = source.where(F.octet_length("__text") >= least).select(*key, "__text")
    k, names = max(1, int(least * FINER[0])), list(key)

    def anchored(batches):
        for b in batches:
            doc, start, n, h = anchors(utf8(b.column(3)), least, k)
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), pa.array(start), pa.array(n), pa.array(h.view(np.int64))], [*names, "start", "n", "anchor"])

    kinds = f"__id {kind}, __t1 long, __t2 long"
    every = Saved(long.mapInArrow(anchored, f"{kinds}, start long, n long, anchor long"))
    again = save(every.df.groupBy("anchor").count().where("count > 1").select("anchor"))
    where = Saved(every.df.join(again, "anchor").groupBy(*key).agg(F.collect_set(F.struct("start", "n", "anchor")).alias("runs")))
    every.drop()
    release(spark)
    # Texts without such anchors, and below those without matches, are not shuffled.
    hashed = F.xxhash64(*names)
    a, b = sieve(where.df.select(hashed), where.df.count())(long, hashed)[0].alias("a"), where.df.alias("b")
    same = F.col("a.__id").eqNullSafe(F.col("b.__id")) & (F.col("a.__t1") == F.col("b.__t1")) & (F.col("a.__t2") == F.col("b.__t2"))
    cutter, schema = _cut(least, list(key), f"{kind} long long")
    held = Saved(a.join(b, same).select("a.*", "b.runs").mapInArrow(cutter, schema))
    cut = held.df
    at = F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), "start")
    where.drop()
    release(spark)
    seen = save(cut.select(*key, "start", "c1", "c2", at.alias("here"), (F.length("data") - least + 1).cast("long").alias("m")).distinct())
    release(spark)
    different = _different(cut.select(at.alias("at"), F.lit(1).cast("long").alias("n"), "anchor", "c1", "c2", "data"), least)
    # What occurs is now in ``seen`` without its bytes, and each different stretch once with them.
    held.drop()
    found = _matches(different, least, 0)
    release(spark)
    if keep == "first":
        runs = F.when(F.col("here") == F.col("at"), F.col("lead")).otherwise(F.array(F.lit(0).cast("long"), F.col("m")))
    else:
        runs = F.col("any")
    parts = seen.join(found, ["c1", "c2"]).select(*key, "start", runs.alias("runs")).where("size(runs) > 0")
    parts = Saved(parts.groupBy(*key).agg(F.collect_list(F.struct("start", "runs")).alias("parts"))).df
    release(spark)
    may, rest = sieve(parts.select(hashed), parts.count())(source, hashed)
    joined = may.alias("a").join(parts.alias("b"), same, "left").select(*[f"a.{c}" for c in columns], "a.__text", "b.parts")
    joined = joined.union(rest.select(*columns, "__text", F.lit(None).cast(parts.schema["parts"].dataType)))

    def kept(batches):
        for b in batches:
            size, spans, rest = [], [], []
            for t, p in zip(utf8(b.column(b.num_columns - 2)), b.column(b.num_columns - 1).to_pylist(), strict=True):
                gone = _spans(p, least) if p else []
                if characters:
                    gone = _whole(gone, t)
                if least_words:
                    gone = [(x, y) for x, y in gone if len(t[x:y].split()) >= least_words]
                cuts = [0, *[x for s in gone for x in s], len(t)]
                size.append(len(t))
                spans.append([{"start": x, "end": y} for x, y in gone])
                rest.append(b"".join(t[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)) if gone else t)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(size, pa.int64()), pa.array(spans, span), pa.array(rest, pa.binary())], [*columns, "n_bytes", "spans", "kept"])

    out = docs.select(*columns).schema.add("n_bytes", "long").add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "binary")
    return joined.mapInArrow(kept, out)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 400, keep: str = "first", columns: list[str] | None = None, characters: bool = False,
    least_words: int = 0,
) -> DataFrame:
    """``columns`` (the id by default), ``n_bytes``, ``spans`` (removed byte ranges) and ``kept`` (the other bytes).

    With ``keep="first"`` the first copy of a repeated string stays, in the order of
    ``doc_id`` (null last), text digests and position; with ``keep="none"`` every copy goes.
    Texts are UTF-8 bytes, null is empty; strings never cross documents; texts shorter than
    ``least`` bytes pass whole.  With ``characters`` a span takes along the whole of any
    character it cuts, so that what is kept is UTF-8; with ``least_words`` a span of fewer words
    stays.  Very long texts are searched whole, a piece at a time.  Rows equal in id and text share their result.
    Columns of the added ones' names give way to them.  An empty table gives no rows.
    """
    with batch_rows(docs.sparkSession):
        return _remove_repeats(docs, doc_id, text, least, keep, columns, characters, least_words)
