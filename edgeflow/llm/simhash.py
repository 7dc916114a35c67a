"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Distinct fingerprints are dealt into tiles by the population counts of their segments.
Two fingerprints within ``radius`` bits have population counts whose differences, summed
over the segments, are at most ``radius``; so only tile pairs within that distance are
compared, with numpy's exclusive-or and bit counts, and no link is lost.  More segments
make finer tiles; their number follows from how many fingerprints there are and changes
only the work, never the result.
"""

from __future__ import annotations

import logging
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from edgeflow.llm.text import batch_rows, utf8, words
from edgeflow.operators.components import connected
from edgeflow.operators.joins import sieve
from edgeflow.storage import Saved, release, save, settled

log = logging.getLogger("edgeflow")
SEED = 42
TILE = 2048
#: (fingerprints up to, segments)
SEGMENTS = ((1 << 23, 4), (1 << 63, 8))


def _digests(w: list[bytes], shingle: int) -> np.ndarray:
    """The XXH64 of each run of so many words, or of all of them if they are fewer."""
    k = min(shingle, len(w))
    flat = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(w) - k + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The majority bit of the XXH64 of each word shingle; 0 where the text has no words."""
    w = words(text)
    if not w:
        return 0
    h = _digests(w, shingle)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[i : i + (1 << 14), None].view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str, keys: list[str], shingle: int = 3) -> DataFrame:
    """``keys`` and the fingerprint as a BIGINT bit pattern ``fp``."""
    fields = docs.select(*keys).schema

    def each(batches):
        for b in batches:
            texts = utf8(b.column(b.num_columns - 1))
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], [*keys, "fp"])

    return docs.select(*keys, F.col(text).alias("__text")).mapInArrow(each, fields.add("fp", "long"))


def _steps(segments: int, radius: int) -> list[int]:
    """Tile-key differences within the radius, one of each opposite pair, and zero."""
    out = [0]
    for d in product(range(-radius, radius + 1), repeat=segments) if segments <= 4 else _sparse(segments, radius):
        if sum(map(abs, d)) <= radius and any(d) and next(x for x in d if x) > 0:
            out.append(sum(x << (7 * i) for i, x in enumerate(d)))
    return out


def _sparse(segments: int, radius: int):
    """Integer vectors of absolute sum up to the radius."""
    if segments == 0:
        yield ()
        return
    for x in range(-radius, radius + 1):
        for rest in _sparse(segments - 1, radius - abs(x)):
            yield (x, *rest)


def _compare(radius: int):
    def each(batches):
        for b in batches:
            left, right = b.column("fa"), b.column("fb")
            same = b.column("same").to_pylist()
            us, vs = [], []
            for i in range(b.num_rows):
                x = left[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                y = right[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                for k in range(0, len(x), 256):
                    p, q = np.nonzero(np.bitwise_count(x[k : k + 256, None] ^ y[None, :]) <= radius)
                    if same[i]:
                        p, q = p[p + k < q], q[p + k < q]
                    if len(p):
                        us.append(x[p + k])
                        vs.append(y[q])
            if us:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(z).view(np.int64)) for z in (us, vs)], ["src", "dst"]
                )

    return each


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs ``src, dst`` of distinct fingerprints (column ``fp``) that differ in 1 to ``radius`` bits."""
    n = fps.count()
    segments = next(m for most, m in SEGMENTS if n <= most)
    width = 64 // segments
    mask = (1 << width) - 1
    key = sum(
        (F.shiftleft(F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit(mask).cast("long"))).cast("long") + radius, 7 * i) for i in range(segments)),
        F.lit(0).cast("long"),
    )
    keyed = fps.select("fp", key.alias("key"))
    parts = save(keyed.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")))
    tiles = save(
        keyed.join(parts, "key")
        .groupBy("key", F.pmod(F.xxhash64("fp"), "parts").cast("int").alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    steps = _steps(segments, radius)

    def role(s: str, sign: int, other: str) -> DataFrame:
        """Each tile once for every tile that it meets: two tiles of one key, and of neighbouring keys, have a key of their own."""
        met = tiles.withColumn("step", F.explode(F.array(*[F.lit(sign * x).cast("long") for x in steps])))
        met = met.withColumn("there", F.col("key") + F.col("step")).join(parts.withColumnRenamed("key", "there"), "there")
        # Of two tiles of one key the one of the lower number is on side a.
        low, high = (F.col("part"), F.col("parts") - 1) if s == "a" else (F.lit(0), F.col("part"))
        range_ = F.when(F.col("step") == 0, F.sequence(low, high)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        return met.select(F.col("key").alias(f"k{s}"), F.col("part").alias(f"p{s}"), F.col("there").alias(f"k{other}"), F.explode(range_).alias(f"p{other}"), F.col("fps").alias(f"f{s}"))

    both = role("a", 1, "b").join(role("b", -1, "a"), ["ka", "pa", "kb", "pb"])
    pairs = both.select("fa", "fb", ((F.col("ka") == F.col("kb")) & (F.col("pa") == F.col("pb"))).alias("same"))
    return pairs.mapInArrow(_compare(radius), "src long, dst long")


@settled
def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3, keep: tuple[str, ...] = (),
    similarity: float | None = None,
) -> DataFrame:
    """Each row's ``doc_id``, ``keep`` columns, ``fp`` and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``radius``
    differing bits, the row itself included.  Null and empty texts have fingerprint 0 and link like any other;
    a very long text is fingerprinted whole, some shingles at a time;
    with ``similarity`` (then ``keep`` must hold a digest ``__d``) rows link by the likeness of their five-word shingle sets, too;
    null ids never become a component's id unless the whole component has none; repeated
    rows stay rows.  An empty table gives an empty result.  Other columns are ignored.
    """
    cols = [F.col(doc_id).alias("__id"), *keep, F.col(text).alias("__t")]
    names = ["__id", *keep]
    with batch_rows(docs.sparkSession):
        if similarity is None:
            rows = save(fingerprints(docs.select(*cols), "__t", names, shingle))
        else:
            wide = _told_apart(Saved(_sets(docs.select(*cols), "__t", names, similarity, shingle)))
            # One row of each set keeps its prefix; the documents go on without.
            first = F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("__d").alias("d"), "fp", "n", "parities", "prefix")
            kinds = Saved(wide.df.groupBy("sid").agg(F.min(first).alias("p")).select("sid", "p.*"))
            release(docs.sparkSession)
            rows = save(wide.df.drop("prefix", "n", "parities", "sid2"))
            wide.drop()
            release(docs.sparkSession)
        distinct = save(rows.groupBy("fp").agg(F.min("__id").alias("low")))
        joined = links(distinct, radius)
        if similarity is not None:
            joined = joined.union(similar_links(docs.select(F.col(doc_id).alias("__id"), *keep, text), rows, kinds, text, similarity))
        found = connected(joined)
    rooted = distinct.join(found.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("comp", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("__id").alias(doc_id), *keep, "fp", "component_id")


#: Words of the shingles that make a text's set.
SET_SHINGLE = 5
#: Shingles that many documents share are put last in the order of prefixes: documents sampled
#: to find them, the least share of these that holds such a shingle, and how many are kept.
#: They change the work, never the result.
SAMPLE, COMMON, MOST_COMMON = 10_000, 0.002, 20_000
SLACK = 1e-9
#: Bits of a set's parities, and how many sets of one shingle are compared in one piece.
PARITIES, GROUP = 1024, 256
#: Sets of a shingle that are compared with each other at once; of more, pivots are tried first.
FEW = 16
#: Sets that a turn of pivots tries, up to which another turn costs more than to compare what is left.
WORTH = 256


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct XXH64 of the five-word shingles; of the whole text where it has fewer words."""
    w = words(text)
    return np.unique(_digests(w, SET_SHINGLE)) if w else np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)


def prefix(h: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, common ones last: sets of at least this likeness share one of theirs."""
    take = len(h) - int(np.ceil(similarity * len(h) - SLACK)) + 1
    late = np.isin(h, common, assume_unique=True)
    return np.concatenate([h[~late], h[late]])[:take]


def parities(h: np.ndarray) -> bytes:
    """For each of ``PARITIES`` bins whether the set has an odd number of shingles there.

    Where two sets differ in d of these bits they differ in d shingles or more.
    """
    odd = np.bincount((h % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sets(docs: DataFrame, text: str, keys: list[str], similarity: float, shingle: int) -> DataFrame:
    """``keys``, ``fp``, a digest ``sid, sid2`` of the shingle set, its size ``n``, ``parities`` and ``prefix``."""
    spark = docs.sparkSession
    share = min(1.0, SAMPLE / max(1, docs.count()))
    sample = docs.select(F.col(text).alias("t")).where(F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def each_sampled(batches):
        for b in batches:
            found = np.concatenate([np.empty(0, np.uint64), *(shingle_set(t) for t in utf8(b.column(0)))])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    often = sample.mapInArrow(each_sampled, "h long").groupBy("h").count().where(F.col("count") >= max(3, SAMPLE * COMMON))
    common = np.array([r[0] for r in often.orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()], np.int64).view(np.uint64)

    def each(batches):
        for b in batches:
            texts = utf8(b.column(b.num_columns - 1))
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            sets = [shingle_set(t) for t in texts]
            sid = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            sid2 = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED + 1) for h in sets], np.uint64).view(np.int64)
            first = [prefix(h, similarity, common).view(np.int64) for h in sets]
            odd = pa.array([parities(h) for h in sets], pa.binary())
            values = [pa.array(fp), pa.array(sid), pa.array(sid2), pa.array([len(h) for h in sets], pa.int64()), odd, pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *values], [*keys, "fp", "sid", "sid2", "n", "parities", "prefix"])

    schema = docs.select(*keys).schema.add("fp", "long").add("sid", "long").add("sid2", "long").add("n", "long").add("parities", "binary")
    schema = schema.add("prefix", ArrayType(LongType()))
    return docs.select(*keys, F.col(text).alias("__text")).mapInArrow(each, schema)


def _told_apart(wide: Saved) -> Saved:
    """Sets whose first 64 bits are alike but not the second get a ``sid`` of both; at 10^10 documents there are a few."""
    same = wide.df.groupBy("sid").agg(F.min("sid2").alias("low"), F.max("sid2").alias("high")).where("low <> high").select("sid", "low")
    clash = Saved(same)
    if clash.df.limit(1).count():
        sid = F.when(F.col("low") != F.col("sid2"), F.xxhash64("sid", "sid2")).otherwise(F.col("sid"))
        apart = Saved(wide.df.join(clash.df, "sid", "left").withColumn("sid", sid).select(*wide.df.columns))
        wide.drop()
        wide = apart
    clash.drop()
    return wide


def _alike(similarity: float):
    """Pairs of sets whose exact likeness is ``similarity`` or more."""

    def each(batches):
        for b in batches:
            hold = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("ha"), b.column("hb"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                hold[i] = both >= similarity * (len(x) + len(y) - both) - SLACK
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(hold))

    return each


def _verified(docs: DataFrame, kinds: DataFrame, pairs: DataFrame, text: str, similarity: float) -> DataFrame:
    """Those of the saved pairs ``a, b`` of sets that are alike, by the sets of their texts."""

    def each(batches):
        for b in batches:
            sets = pa.array([shingle_set(t).tobytes() for t in utf8(b.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["sid", "h"])

    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    asked = Saved(kinds.join(wanted, "sid").select("sid", "id", "d"))
    k = asked.df.alias("k")
    # Only texts that are asked for are shuffled, but for a few.
    may = sieve(asked.df.select(F.xxhash64("id", "d")), asked.df.count())
    found = may(docs.select("__id", "__d", text), F.xxhash64("__id", "__d"))[0].alias("x").join(k, F.col("x.__id").eqNullSafe(F.col("k.id")) & (F.col("x.__d") == F.col("k.d")))
    found = found.select("k.sid", F.col(f"x.{text}").alias("t")).mapInArrow(each, "sid long, h binary").dropDuplicates(["sid"])
    sets = Saved(found)
    release(docs.sparkSession)
    both = pairs.join(sets.df.select(F.col("sid").alias("a"), F.col("h").alias("ha")), "a")
    both = both.join(sets.df.select(F.col("sid").alias("b"), F.col("h").alias("hb")), "b")
    out = save(both.select("a", "b", "ha", "hb").mapInArrow(_alike(similarity), "a long, b long"))
    sets.drop()
    asked.drop()
    release(docs.sparkSession)
    return out


def _possible(similarity: float, within: bool):
    """Pairs of sets of two tiles (or of one) that their sizes and parities do not rule out."""

    def tile(b, i, side):
        ids, sizes, comps = (b.column(f"{c}{side}")[i].values.to_numpy(zero_copy_only=False) for c in ("sid", "n", "comp"))
        odd = b"".join(b.column(f"parities{side}")[i].values.to_pylist())
        return ids, sizes, comps, np.frombuffer(odd, np.uint64).reshape(len(ids), -1)

    def each(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = tile(b, i, "a")
                y = x if within else tile(b, i, "b")
                found = []
                for k in range(0, len(x[0]), 64):
                    n, m = x[1][k : k + 64, None], y[1][None, :]
                    c, d = x[2][k : k + 64, None], y[2][None, :]
                    differ = np.bitwise_count(x[3][k : k + 64, None] ^ y[3][None, :]).sum(axis=2, dtype=np.int64)
                    may = (n + m - differ) / 2 >= similarity / (1 + similarity) * (n + m) - 1e-6
                    may &= (c < d if within else c != d) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - SLACK)
                    p, q = np.nonzero(may)
                    swap = x[2][p + k] > y[2][q]
                    left, right = (x[0][p + k], x[1][p + k]), (y[0][q], y[1][q])
                    found.append([np.where(swap, s, r) for r, s in zip((*left, *right), (*right, *left), strict=True)])
                both = [np.concatenate(z) for z in zip(*found, strict=True)]
                if len(both[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in both], ["a", "na", "b", "nb"])

    return each


def _size_class(similarity: float):
    """Sizes whose ratio is at least ``similarity`` lie in the same or in neighbouring classes."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(float(1e-6 - np.log(similarity)))).cast("int")


def _nearest(similarity: float):
    """For pairs ``a, b`` with sizes and parities: those that may be alike, and how many shingles both have at most."""

    def each(batches):
        for b in batches:
            n, m = (b.column(c).to_numpy() for c in ("na", "nb"))
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("pa", "pb"))
            most = (n + m - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)) / 2
            may = most >= similarity / (1 + similarity) * (n + m) - 1e-6
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(most)], ["a", "b", "most"]).filter(pa.array(may))

    return each


def _pivots(left: DataFrame, kinds: DataFrame, similarity: float, turn: int) -> DataFrame:
    """``a, b``: for each set ``b`` of a shingle that more than ``FEW`` sets share, one at most that it may be like.

    A shingle has a pivot in each size class, another one each ``turn``; every set meets those of its shingles
    that are not in its component, so pairs are no more than the rows of ``left``.  Parities are fetched
    once for each pair and choose the likeliest.
    """
    many = left.groupBy("h").count().where(F.col("count") > FEW).select("h")
    rows = left.join(many, "h").withColumn("cls", _size_class(similarity))
    first = rows.groupBy("h", "cls").agg(F.min(F.struct(F.xxhash64("sid", F.lit(turn)).alias("k"), "sid", "n", "comp")).alias("p"))
    met = rows.join(first, ["h", "cls"]).where("comp <> p.comp").where(F.least("n", "p.n") >= float(similarity) * F.greatest("n", "p.n") - SLACK)
    pairs = met.select(F.col("p.sid").alias("a"), F.col("p.n").alias("na"), F.col("sid").alias("b"), F.col("n").alias("nb")).distinct()
    odd = lambda s: kinds.select(F.col("sid").alias(s), F.col("parities").alias(f"p{s}"))
    near = pairs.join(odd("a"), "a").join(odd("b"), "b").mapInArrow(_nearest(similarity), "a long, b long, most double")
    return near.groupBy("b").agg(F.max(F.struct("most", "a")).alias("best")).select("best.a", "b")


def _tiled(left: DataFrame, similarity: float, kinds: DataFrame | None = None) -> DataFrame:
    """``a, na, b, nb`` for each shingle ``h`` that two sets of different ``comp`` share and that may be alike.

    The sets of a shingle are one tile if they are few.  Else they are dealt into tiles by
    size class and hash, and only tiles of the same or the next class meet, each two of them
    under a key of their own.  The component that most of a shingle's sets belong to already,
    the crowd, has tiles of its own, which never meet each other: nothing in them is apart.
    ``kinds`` has the parities of each ``sid``; without it ``left`` has them.
    """
    crowds = left.groupBy("h", "comp").count().groupBy("h").agg(F.sum("count").alias("all"), F.max(F.struct("count", "comp")).alias("top"))
    many = crowds.where(F.col("all") > GROUP).select("h", F.col("top.comp").alias("crowd"))
    cls = _size_class(similarity)
    placed = left.join(many, "h", "left").withColumns({"cls": F.when(F.col("crowd").isNotNull(), cls).otherwise(-1), "own": F.coalesce(F.col("comp") == F.col("crowd"), F.lit(False))}).drop("crowd")
    tiles_of = lambda own: F.ceil(F.sum((F.col("own") == own).cast("int")) / GROUP).cast("int")
    parts = Saved(placed.groupBy("h", "cls").agg(tiles_of(False).alias("mixed"), tiles_of(True).alias("one")))
    release(left.sparkSession)
    members = ("sid", "n", "comp", "parities")
    # Tiles of the crowd, the component with most of a shingle's sets, are numbered after the others.
    turn = lambda k: F.pmod(F.xxhash64("sid"), F.greatest(F.col(k), F.lit(1))).cast("int")
    part = F.when(F.col("own"), F.col("mixed") + turn("one")).otherwise(turn("mixed")).alias("part")
    dealt = placed.join(parts.df, ["h", "cls"]).select("h", "cls", "mixed", "one", part, "sid", "n", "comp")
    # Parities come last, so that they are shuffled but once for each shingle.
    odd = kinds or left.dropDuplicates(["sid"])
    dealt = dealt.join(odd.select("sid", "parities"), "sid").groupBy("h", "cls", "mixed", "one", "part")
    tiles = Saved(dealt.agg(F.collect_list(F.struct(*members)).alias("m")))
    release(left.sparkSession)
    side = {s: [F.col(f"m.{c}").alias(f"{c}{s}") for c in members] for s in "ab"}
    pairs = "a long, na long, b long, nb long"
    alone = tiles.df.where((F.size("m") > 1) & (F.col("part") < F.col("mixed"))).select(*side["a"]).mapInArrow(_possible(similarity, True), pairs)

    def role(s: str, step: int, other: str) -> DataFrame:
        """Each tile once for every tile that it meets: those of its class on one side of it, and the next class; two of the crowd never meet."""
        near = parts.df.where("cls >= 0").select("h", (F.col("cls") - step).alias("cls"), F.col("mixed").alias("m2"), F.col("one").alias("o2"))
        own = F.expr(f"transform(filter(sequence(0, mixed + one - 1), q -> q {'>' if step > 0 else '<'} part and (part < mixed or q < mixed)), q -> struct(cls as c, q as p))")
        next_ = F.expr(f"transform(filter(sequence(0, greatest(coalesce(m2 + o2, 1), 1) - 1), q -> m2 is not null and (part < mixed or q < m2)), q -> struct(cls + {step} as c, q as p))")
        met = tiles.df.where("cls >= 0").join(near, ["h", "cls"], "left").withColumn("o", F.explode(F.concat(own, next_)))
        return met.select(
            "h", F.col("cls").alias(f"c{s}"), F.col("part").alias(f"p{s}"), F.col("o.c").alias(f"c{other}"), F.col("o.p").alias(f"p{other}"), *side[s]
        )

    met = role("a", 1, "b").join(role("b", -1, "a"), ["h", "ca", "pa", "cb", "pb"])
    across = met.select(*[f"{c}{s}" for s in "ab" for c in members]).mapInArrow(_possible(similarity, False), pairs)
    return alone.union(across)


def _recomposed(left: Saved, links: DataFrame) -> Saved:
    """The rows of shingles that still have sets of several components, once ``links`` have tied some."""
    comp = left.df.select("sid", "comp").distinct()
    tied = links.join(comp.select(F.col("sid").alias("a"), F.col("comp").alias("src")), "a").join(comp.select(F.col("sid").alias("b"), F.col("comp").alias("dst")), "b")
    now = connected(tied.select("src", "dst")).select(F.col("id").alias("comp"), F.col("comp").alias("low"))
    rows = left.df.join(now, "comp", "left").withColumn("comp", F.coalesce("low", "comp")).drop("low")
    several = rows.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("h")
    out = Saved(rows.join(several, "h").select(*left.df.columns))
    left.drop()
    release(left.spark)
    return out


def similar_links(docs: DataFrame, rows: DataFrame, wide: Saved, text: str, similarity: float) -> DataFrame:
    """Links ``src, dst`` of fingerprints that join what is connected by sharing ``similarity`` of the five-word shingles.

    Exact: sets as alike as that share a shingle of their prefixes, and more of them the less
    their remainders can make up for; each pair proposed so is checked on the whole sets.
    Sets are first compared with the lowest that shares a prefix shingle; then, where many share one, with pivots, turn
    by turn, while these tie an eighth of what they meet; then only pairs
    which those links leave apart, so that a group of copies is not compared with itself.
    These meet in tiles, where sizes and parities rule out nearly all that are not alike.
    ``rows`` holds ``__id, __d, fp, sid`` of each document; ``wide``, which goes, ``sid, id, d, fp, n, parities, prefix`` of each set.
    """
    tokens = wide.df.select("sid", "n", F.explode("prefix").alias("h"))
    often = Saved(tokens.groupBy("h").count().where("count > 1").select("h"))
    release(docs.sparkSession)
    shared = Saved(tokens.join(often.df, "h"))
    kinds = Saved(wide.df.drop("prefix"))
    often.drop()
    wide.drop()
    release(docs.sparkSession)

    def candidates(pairs: DataFrame) -> DataFrame:
        """Of ``a, na, b, nb`` for each shared prefix shingle, the pairs that can be alike."""
        t, less, more = F.lit(float(similarity)), F.least("na", "nb"), F.greatest("na", "nb")
        sized = pairs.where(less >= t * more - SLACK).groupBy("a", "na", "b", "nb").count()
        reach = F.col("count") + F.ceil(t * more - SLACK) - 1
        return sized.where(reach >= t / (1 + t) * (F.col("na") + F.col("nb")) - 1e-6).select("a", "b")

    low = shared.df.groupBy("h").agg(F.min(F.struct("sid", "n")).alias("low")).select("h", F.col("low.sid").alias("a"), F.col("low.n").alias("na"))
    s = shared.df.join(low, "h").where("a <> sid").select("a", "na", F.col("sid").alias("b"), F.col("n").alias("nb"))
    # A set meets a lowest one at some of their common shingles only, so their number is no bound here: the most decide.
    s = s.where(F.least("na", "nb") >= float(similarity) * F.greatest("na", "nb") - SLACK).groupBy("b", "a").count()
    best = s.groupBy("b").agg(F.max(F.struct("count", "a")).alias("best")).where("best.count > 1")
    pairs = Saved(best.select("best.a", "b"))
    release(docs.sparkSession)
    star = _verified(docs, kinds.df, pairs.df, text, similarity)
    joined = connected(star, "a", "b").withColumnRenamed("id", "sid")
    comp = shared.df.join(joined, "sid", "left").select("sid", "n", "h", F.coalesce("comp", "sid").alias("comp"))
    apart = Saved(comp)
    shared.drop()
    pairs.drop()
    release(docs.sparkSession)
    several = apart.df.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("h")
    left = Saved(apart.df.join(several, "h"))
    apart.drop()
    release(docs.sparkSession)
    turn, agreed = 0, star
    while True:
        turn += 1
        pairs = Saved(_pivots(left.df, kinds.df, similarity, turn))
        tried = pairs.df.count()
        good = _verified(docs, kinds.df, pairs.df, text, similarity) if tried else pairs.df
        found = good.count() if tried else 0
        log.info("similar sets: turn %d tries %d pivots' pairs, %d hold", turn, tried, found)
        if found:
            agreed = agreed.union(good)
            left = _recomposed(left, good)
        pairs.drop()
        # A turn that tries or ties few sets leaves few that further ones would; so many are soon compared.
        if tried <= WORTH or found < tried // 8:
            break
    rest = Saved(candidates(_tiled(left.df, similarity, kinds.df)))
    left.drop()
    release(docs.sparkSession)
    links = agreed.union(_verified(docs, kinds.df, rest.df, text, similarity))
    fp = kinds.df.select("sid", "fp")
    links = links.join(fp.select(F.col("sid").alias("a"), F.col("fp").alias("src")), "a").join(fp.select(F.col("sid").alias("b"), F.col("fp").alias("dst")), "b")
    equal = rows.select("sid", F.col("fp").alias("src")).join(fp.withColumnRenamed("fp", "dst"), "sid").where("src <> dst")
    out = save(links.select("src", "dst").union(equal.select("src", "dst")).where("src <> dst").distinct())
    for t in (kinds, rest):
        t.drop()
    return out


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3, similarity: float | None = 0.8
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one of smallest id, then of smallest text digest.

    Rows link where their fingerprints differ in at most ``radius`` bits or, if
    ``similarity`` is given, where their five-word shingle sets are as alike as that or more.
    """
    digest = F.coalesce(F.md5(F.encode(F.col(text), "UTF-8")), F.lit(""))
    rows = near_duplicates(docs.withColumn("__d", digest), doc_id, text, radius, shingle, ("__d",), similarity)
    pick = F.struct(F.col(doc_id).isNull().alias("no"), F.col(doc_id).alias("id"), F.col("__d").alias("d"))
    # Components whose rows all lack an id are told apart by fingerprint alone.
    group = F.when(F.col("component_id").isNull(), F.col("fp"))
    best = rows.groupBy("component_id", group.alias("g")).agg(F.min(pick).alias("p"), F.count("*").alias("n"))
    best = save(best.select("p.id", "p.d"))
    out = docs.join(best, docs[doc_id].eqNullSafe(best["id"]) & (digest == best["d"]), "left_semi")
    same = out.groupBy(doc_id, digest.alias("d")).count().where("count > 1").limit(1).count()
    return out.dropDuplicates([doc_id, text]) if same else out
