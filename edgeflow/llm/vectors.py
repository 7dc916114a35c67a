"""Embedding operators: p-stable hashing near-dedup and exact top-k by norm buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeflow.llm.text import batch_rows
from edgeflow.operators.components import star_contraction
from edgeflow.operators.ordered import in_order, with_running
from edgeflow.storage import Saved, save, settled

#: Vectors in a block that one comparison holds; bounds memory, not results.
BLOCK = 1024
#: Length levels of the candidates, at most.
LEVELS = 256
#: Tiles of candidates that queries meet in one go, components of such queries, and partitions of a comparison, at most.
TILES, COMPONENTS, PARTITIONS = 64, 1 << 23, 10_000


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """Vectors of a list column, each as float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def usable(column: str):
    """Not null, not empty, and every component there and finite."""
    wrong = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(wrong, F.lit(True))


class Lattice:
    """Quantised random projections of unit vectors: ``tables`` keys of ``hashes`` each."""

    def __init__(self, tables: int, hashes: int, width: float, seed: int = 5):
        self.tables, self.hashes, self.width, self.seed = tables, hashes, width, seed
        self.made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def keys(self, unit: np.ndarray) -> np.ndarray:
        d = unit.shape[1]
        if d not in self.made:
            rng = np.random.default_rng(self.seed)
            n = self.tables * self.hashes
            self.made[d] = (
                rng.standard_normal((d, n)) / self.width,
                rng.random(n),
                rng.integers(1, 1 << 62, self.hashes, dtype=np.int64) | 1,
            )
        a, b, mix = self.made[d]
        # Row by row sums in a fixed order: a vector's keys must not depend on its batch.
        cells = np.floor(np.einsum("ij,jk->ik", unit, a) + b).astype(np.int64).reshape(-1, self.tables, self.hashes)
        with np.errstate(over="ignore"):
            return (cells * mix).sum(axis=2)


def units(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1, keepdims=True)
    v = vectors / top
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


@settled
def near_links(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    least: float = 0.98, tables: int = 32, hashes: int = 12, width: float = 1.5,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Rows of equal, non-null label link where their cosine, in double precision, is at least
    ``least``.  Candidates come from ``tables`` p-stable hash tables over unit vectors and
    every candidate is checked exactly, so no false link is made; two vectors at a cosine of
    0.98 share none of the tables with a probability under 1e-4, closer ones less.
    Equal vectors are one class with a count, and blocks of a bucket are compared pairwise,
    each pair of blocks under its own key, so groups of copies are never expanded into pairs:
    a block pair yields counts and a spanning set of links.  A pair found in several tables counts in the first only.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows of
    null label, link with nothing; vectors of unequal length neither.  Null ids yield null
    components unless they link.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = rows.sparkSession
    # Single-precision components travel as they are; arithmetic is in double precision.
    single = rows.schema[vector].dataType.simpleString() == "array<float>"
    vec = F.col(vector) if single else F.col(vector).cast("array<double>")
    source = rows.select(F.col(vec_id).alias("id"), vec.alias("vec"), F.col(label).alias("label"))
    good = usable("vec") & F.col("label").isNotNull() & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    source = source.withColumns({f"d{k}": F.when(good, F.xxhash64(F.lit(k), "label", "vec")) for k in (1, 2)})
    # Equal vectors are known by 128 bits; their class gets a number of its own, fixed by saving it.
    equal = source.where("d1 is not null").groupBy("d1", "d2").agg(
        F.min("id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec")
    )
    classes = save(equal.withColumn("class", F.monotonically_increasing_id()))
    lattice = Lattice(tables, hashes, width)
    kind = classes.schema["label"].dataType.simpleString()

    def hashed(batches):
        for b in batches:
            vecs = rows_of(b.column("vec"))
            ids = b.column("class").to_numpy(zero_copy_only=False)
            sizes = np.array([len(v) for v in vecs])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                keys = lattice.keys(units(np.array([vecs[i] for i in at])))
                t = np.tile(np.arange(tables, dtype=np.int64), len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[at], tables)), b.column("label").take(pa.array(np.repeat(at, tables))), pa.array(t), pa.array(keys.ravel())],
                    ["class", "label", "tab", "cell"],
                )

    cells = classes.select("class", "label", "vec").mapInArrow(hashed, f"class long, label {kind}, tab long, cell long")
    cells = save(cells.select("class", F.col("tab").alias("tab"), F.xxhash64("label", "tab", "cell").alias("bucket")))
    shared = cells.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    shared = shared.select("bucket", F.ceil(F.col("m") / BLOCK).alias("parts"))
    placed = cells.join(shared, "bucket").join(classes.select("class", "n", "vec"), "class")
    blocks = save(
        placed.groupBy("bucket", "tab", "parts", F.pmod(F.xxhash64("class"), "parts").alias("part")).agg(
            F.collect_list(F.struct("class", "n", "vec")).alias("v")
        )
    )
    # A bucket of one block is compared in place; of more, each pair of blocks meets under a key of its own.
    inside = blocks.select("tab", F.lit(True).alias("same"), F.col("v").alias("va"), F.lit(None).cast(blocks.schema["v"].dataType).alias("vb"))
    several = blocks.where("parts > 1")
    last = F.col("parts") - 1
    a = several.where(F.col("part") < last).select("bucket", "tab", F.col("part").alias("pa"), F.explode(F.sequence(F.col("part") + 1, last)).alias("pb"), F.col("v").alias("va"))
    b = several.where("part > 0").select("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("part") - 1)).alias("pa"), F.col("part").alias("pb"), F.col("v").alias("vb"))
    across = a.join(b, ["bucket", "pa", "pb"]).select("tab", F.lit(False).alias("same"), "va", "vb")
    pairs = inside.union(across)

    def compared(batches):
        for b in batches:
            for i in range(b.num_rows):
                tab, same = b.column("tab")[i].as_py(), b.column("same")[i].as_py()
                left = block(b.column("va")[i].values)
                right = left if same else block(b.column("vb")[i].values)
                for d in left.keys() & right.keys():
                    yield from linked(left[d], right[d], tab, same)

    def block(v: pa.StructArray) -> dict:
        vecs, out = rows_of(v.field("vec")), {}
        ids, n = (v.field(c).to_numpy(zero_copy_only=False) for c in ("class", "n"))
        sizes = np.array([len(x) for x in vecs])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            unit = units(np.array([vecs[i] for i in at]))
            out[int(d)] = ids[at], n[at], unit, lattice.keys(unit)
        return out

    def linked(x, y, tab: int, same: bool):
        near = x[2] @ y[2].T >= least
        for t in range(tab):
            near &= x[3][:, t][:, None] != y[3][:, t][None, :]
        if same:
            near &= np.triu(np.ones(near.shape, bool), 1)
        p, q = near.any(axis=1), near.any(axis=0)
        if not p.any():
            return
        near, xi, xn, yi, yn = near[p][:, q], x[0][p], x[1][p], y[0][q], y[1][q]
        ids = np.concatenate([xi, yi])
        links = np.concatenate([near @ yn, near.T @ xn])
        # Smallest class reachable within this block pair: enough links to keep it connected.
        left, right = xi.copy(), yi.copy()
        while True:
            r = np.minimum(right, np.where(near, left[:, None], np.iinfo(np.int64).max).min(axis=0))
            le = np.minimum(left, np.where(near, r[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (r == right).all() and (le == left).all():
                break
            left, right = le, r
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(np.concatenate([left, right]))], ["class", "links", "root"])

    with batch_rows(spark, 16):
        found = save(pairs.mapInArrow(compared, "class long, links long, root long"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    comps = star_contraction(found.select(F.col("class").alias("src"), F.col("root").alias("dst")).distinct())
    known = classes.select("class", "low", "n").join(links, "class", "left").join(comps.withColumnRenamed("id", "class"), "class", "left")
    known = known.select("class", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "class").alias("comp"))
    known = save(known)
    lows = known.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = known.join(lows, "comp").select("class", "n_links", "component_id")
    named = classes.select("d1", "d2", "class").join(named, "class").drop("class")
    out = source.select("id", "d1", "d2").join(named, ["d1", "d2"], "left").select(
        F.col("id").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("d1").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))


def quantised(column: str, scale: float):
    return F.transform(F.col(column).cast("array<double>"), lambda x: F.floor(x * scale))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, those that end early filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _largest(v: np.ndarray) -> float:
    return max(float(v.max(initial=0)), -float(v.min(initial=0)))


class Best:
    """Queries, and the ``k`` best of the candidates that each has met so far and that reach its floor."""

    #: Floor of a query that has none: below every score.
    NONE = np.iinfo(np.int64).min + 1

    def __init__(self, qs: pa.StructArray, k: int, coordinate_from: float):
        self.qs, self.k, self.coordinate_from = qs, k, coordinate_from
        self.v, self.norm = _matrix(qs.field("v")), qs.field("norm").to_numpy(zero_copy_only=False)
        self.floor = qs.field("floor").fill_null(self.NONE).to_numpy(zero_copy_only=False).copy()
        self.cast: dict = {}
        # What was found: numbers of queries, scores, candidates' ids.
        self.r, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), qs.field("id").slice(0, 0)

    def picked(self, rows: slice, c: np.ndarray, norm: np.ndarray) -> np.ndarray | None:
        """Candidates that one of these queries may need; None for all."""
        need, own, longest = self.floor[rows].astype(np.float64), self.norm[rows], norm.max(initial=0.0)
        if (need <= 0).any() or not own.all():
            return None  # nothing to prune with yet
        cosine = need / (own * longest) * (1 - 1e-9) if longest else np.full(len(need), 2.0)
        by_length = (cosine <= 1) & (cosine < self.coordinate_from)
        some = norm >= (need[by_length] / own[by_length]).min(initial=np.inf) * (1 - 1e-9)
        for r in np.flatnonzero((cosine <= 1) & ~by_length):
            v = self.v[rows.start + r].astype(np.float64)
            focus = np.abs(v).argmax()
            f = v[focus] / own[r]
            x = np.divide(c[:, focus].astype(np.float64), norm, where=norm > 0, out=np.zeros(len(c))) if focus < c.shape[1] else np.zeros(len(c))
            some |= f * x + np.sqrt(max(0.0, 1 - f * f)) * np.sqrt(np.maximum(0, 1 - x**2)) >= cosine[r] - 1e-9
        return np.flatnonzero(some)

    def meet(self, cs: pa.StructArray) -> None:
        """Take the candidates' best."""
        # In the order of their ids, null last, so that the first of equal scores is the one to keep.
        cs = cs.take(pa.compute.sort_indices(cs.field("id")))
        c, norm = _matrix(cs.field("v")), cs.field("norm").to_numpy(zero_copy_only=False)
        width = min(self.v.shape[1], c.shape[1])  # a component that either lacks counts as 0
        big = _largest(self.v) * _largest(c) * width
        # Whole numbers below these bounds, and so all their sums, are exact.
        kind = np.float32 if big < 2**24 else np.float64 if big < 2**53 else np.int64 if big < 2**62 else object
        if (kind, width) not in self.cast:
            self.cast = {(kind, width): self.v[:, :width].astype(kind)}
        a, b = self.cast[kind, width], np.ascontiguousarray(c[:, :width].astype(kind))
        lowest = -np.inf if kind in (np.float32, np.float64) else np.iinfo(np.int64).min if kind is np.int64 else -(1 << 200)
        same, at = self.own(cs)
        found = []
        for s in range(0, len(a), 256):
            rows = slice(s, min(s + 256, len(a)))
            some = self.picked(rows, c, norm)
            if some is not None and not len(some):
                continue
            score = a[rows] @ (b if some is None else b[some]).T
            own = slice(*np.searchsorted(same, [rows.start, rows.stop]))
            i, j = same[own] - s, at[own]
            if some is not None:
                place = np.searchsorted(some, j)
                there = (place < len(some)) & (some[np.minimum(place, len(some) - 1)] == j)
                i, j = i[there], place[there]
            score[i, j] = lowest
            low = self.floor[rows].astype(kind)
            flat = np.flatnonzero(score >= low[:, None])
            if len(flat) > 8 * self.k * len(low) and score.shape[1] > self.k:
                low = np.maximum(low, np.partition(score, -self.k, axis=1)[:, -self.k])
                flat = np.flatnonzero(score >= low[:, None])
            r, j = np.divmod(flat, score.shape[1])
            starts = np.searchsorted(r, np.arange(len(low) + 1))
            keep = np.ones(len(r), bool)
            for q in np.flatnonzero(np.diff(starts) > self.k):
                mine = slice(starts[q], starts[q + 1])
                keep[mine] = False
                keep[starts[q] + np.argsort(-score[q, j[mine]], kind="stable")[: self.k]] = True
            r, j = r[keep], j[keep]
            found.append((r + s, score[r, j].astype(np.int64), j if some is None else some[j]))
        if found:
            r, score, j = (np.concatenate(x) for x in zip(*found, strict=True))
            self.take(r, score, cs.field("id").take(pa.array(j)))

    def own(self, cs: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        """Queries, ascending, and the candidates of their own ids."""
        every = pa.concat_arrays([self.qs.field("id"), cs.field("id")])
        codes = every.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        mine, theirs = codes[: len(self.qs)], codes[len(self.qs) :]
        order = np.argsort(theirs, kind="stable")
        begin, end = (np.searchsorted(theirs[order], mine, side) for side in ("left", "right"))
        n = end - begin
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        return np.repeat(np.arange(len(mine)), n), order[place]

    def take(self, r: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """Put what was found to what was kept, and keep the best."""
        hit = np.zeros(len(self.qs), bool)
        hit[r] = True
        again = hit[self.r]
        r, score, ids = np.concatenate([self.r[again], r]), np.concatenate([self.score[again], score]), pa.concat_arrays([self.ids.filter(pa.array(again)), ids])
        tie = np.empty(len(r), np.int64)
        tie[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(r))
        order = np.lexsort((tie, -score, r))
        r = r[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        order, r, place = order[place < self.k], r[place < self.k], place[place < self.k]
        score, ids = score[order], ids.take(pa.array(order))
        full = place == self.k - 1
        self.floor[r[full]] = np.maximum(self.floor[r[full]], score[full])
        self.r, self.score = np.concatenate([self.r[~again], r]), np.concatenate([self.score[~again], score])
        self.ids = pa.concat_arrays([self.ids.filter(pa.array(~again)), ids])

    def batches(self):
        """``row, query_id, vec_id, score`` of what is kept."""
        for i in range(0, len(self.r), 1 << 16):
            r = pa.array(self.r[i : i + (1 << 16)])
            columns = self.qs.field("row").take(r), self.qs.field("id").take(r), self.ids.slice(i, 1 << 16), pa.array(self.score[i : i + (1 << 16)])
            yield pa.RecordBatch.from_arrays(list(columns), ["row", "query_id", "vec_id", "score"])


@settled
def top_products(
    rows: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5,
    scale: float = 256.0, bucket: int = 4096, queries: int = 512, coordinate_from: float = 0.9,
) -> DataFrame:
    """Exact inner-product top-k of integer vectors ``floor(scale * x)``: ``query_id, rank, vec_id, score``.

    Candidates are grouped by vector length into levels, dealt into tiles of about ``bucket``
    rows.  Every query first meets a tile of the longest, which gives it a threshold.  The
    threshold divided by the query's length is the length that a candidate must reach; divided
    by a tile's greatest length too, it is the cosine a candidate must reach there: over 1 the
    tile is skipped; from ``coordinate_from`` candidates are pruned by what the query's largest
    coordinate allows, below by length.  What is left is verified by exact products.
    Queries are put into blocks of ``queries`` in the order of the length they need, and blocks
    into groups of ``COMPONENTS`` components.  A group meets the tiles in ranges of ``TILES``, under a key
    each: a task holds one group and one tile at a time and goes through the range from the longest
    tile on, its thresholds rising.  A block takes part only in ranges that its least demanding
    query needs.  So a tile is shuffled once a group and a block once a range, and nothing but
    the first tile goes through the driver; the products themselves are one for each query and candidate that pruning leaves.
    Candidates with the query's own id are left out; ties go to the smaller id; a query has
    fewer rows if there are fewer candidates.  Of rows with repeated ids each is a candidate,
    and each that is a query gets its own ranks.  Vectors that are null, empty or hold null or
    non-finite components take no part; components missing at the end count as 0.
    Null ids are candidates that sort last.  An empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    ints = rows.withColumn("__v", F.col(vector).cast("array<double>")).where(usable("__v"))
    ints = ints.select(F.col(vec_id).alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), quantised("__v", scale).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # Rows are told apart by a number that is fixed by saving it.
    ints = save(ints.withColumns({"norm": norm, "row": F.monotonically_increasing_id()}))
    kind = ints.schema["id"].dataType.simpleString()
    # Bounds of the levels; a level of many rows is dealt into parts.
    levels = max(1, min(LEVELS, ints.count() // bucket))
    reach = F.max(F.greatest(F.array_max("v"), F.bitwise_not(F.array_min("v"))))
    cuts, reach, width = ints.agg(F.percentile_approx("norm", [i / levels for i in range(1, levels)] or [0.5], 10_000), reach, F.max(F.size("v"))).first()
    number = "smallint" if (reach or 0) < 1 << 15 else "int" if reach < 1 << 31 else "bigint"
    ints = ints.withColumn("v", F.col("v").cast(f"array<{number}>"))
    cuts = sorted(map(float, set(cuts or [])))

    def counted(low: int, high: int):
        """How many of all cuts are above the length, by halves; of the cuts it is not below there are so many."""
        at = (low + high) // 2
        return F.lit(len(cuts) - low) if low == high else F.when(F.col("norm") < cuts[at], counted(low, at)).otherwise(counted(at + 1, high))

    level = counted(0, len(cuts))
    leveled = ints.select("id", "v", "norm", "row", level.alias("level"))
    sizes = leveled.groupBy("level").agg(F.ceil(F.count("*") / bucket).alias("parts"), F.max("norm").alias("longest"))
    sizes = sorted(map(tuple, sizes.collect())) or [(0, 1, 0.0)]  # at most LEVELS rows
    # Tiles are numbered from the longest level on; a level's end with this number.
    ends = np.cumsum([parts for _, parts, _ in sizes]).tolist()
    of_level, first = ({lv: x for (lv, _, _), x in zip(sizes, xs, strict=True)} for xs in ([parts for _, parts, _ in sizes], [0, *ends[:-1]]))
    of_level, first = (F.array(*[F.lit(x.get(lv, 0)) for lv in range(len(cuts) + 1)])[F.col("level")] for x in (of_level, first))
    tiles = leveled.groupBy((first + F.pmod(F.xxhash64("row"), of_level)).alias("tile"))
    # Readers may take all rows of a file at once, so few large ones go to a file.
    fit = lambda n: max(1, COMPONENTS // (2 * n * max(1, width or 1)))
    tiles = Saved(tiles.agg(F.collect_list(F.struct("id", "norm", "v")).alias("c")), file_rows=fit(bucket)).df
    # One tile of the longest, of about ``bucket`` rows, goes to all tasks.
    longest = tiles.where("tile = 0").select("c").toArrow().column("c").combine_chunks()
    head = spark.sparkContext.broadcast(longest.values if len(longest) else None)

    def first_scores(batches):
        for b in batches:
            floor = pa.nulls(b.num_rows, pa.int64())
            if head.value is not None:
                best = Best(pa.StructArray.from_arrays([*b.columns, floor], [*b.schema.names, "floor"]), k, coordinate_from)
                best.meet(head.value)
                floor = pa.array(best.floor, mask=best.floor == Best.NONE)
            yield pa.RecordBatch.from_arrays([*b.columns, floor], [*b.schema.names, "floor"])

    asked = ints.where("q").select("row", "id", "norm", "v")
    with batch_rows(spark, 4096):
        asked = save(asked.mapInArrow(first_scores, f"row long, id {kind}, norm double, v array<{number}>, floor long"))
    # The length a candidate must reach; queries without a positive threshold meet every level.
    need = F.when((F.col("floor") > 0) & (F.col("norm") > 0), F.col("floor") / F.col("norm") * (1 - 1e-9)).otherwise(F.lit(-1.0))
    placed = with_running(in_order(asked.withColumn("need", need), "need", "row"), F.struct("need", "row"), place=F.lit(1))
    deepest = sum((F.when(F.col("need") <= x, 1).otherwise(0) for _, _, x in sizes), F.lit(-1))
    placed = placed.withColumn("block", F.expr(f"(place - 1) div {queries}")).repartition(max(1, -(-asked.count() // (queries * fit(queries)))), "block")
    blocks = placed.groupBy("block").agg(F.collect_list(F.struct("row", "id", "norm", "v", "floor")).alias("qs"), F.max(deepest).alias("deepest"))
    blocks = save(blocks.where("deepest >= 0").withColumn("group", F.expr(f"block div {2 * fit(queries)}")))
    depth = blocks.groupBy("group").agg(F.max("deepest").alias("deepest")).groupBy("deepest").count()
    depth = dict(map(tuple, depth.collect()))  # at most LEVELS rows
    # Ranges of tiles: as many as keep all cores busy, at least.
    each = max(1, min(TILES, ends[-1] // (4 * spark.sparkContext.defaultParallelism)))
    ranges = [-(-end // each) for end in ends]  # that reach down to each level
    n = ranges[-1]
    left = blocks.withColumn("range", F.explode(F.sequence(F.lit(0), F.array(*map(F.lit, ranges))[F.col("deepest")] - 1)))
    # Groups come in the order of what they need, so those that a range must meet are the first so many.
    right = tiles.withColumn("range", F.expr(f"tile div {each}"))
    meets = sum((F.when(F.col("range") < ranges[d], groups).otherwise(0) for d, groups in depth.items()), F.lit(0))
    right = right.withColumn("meets", meets).where("meets > 0").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    cell = (F.col("group") * n + F.col("range")).alias("cell")
    left = left.select(cell, F.col("block").alias("no"), "qs", F.lit(None).cast(tiles.schema["c"].dataType).alias("c"))
    right = right.select(cell, F.col("tile").alias("no"), F.lit(None).cast(blocks.schema["qs"].dataType).alias("qs"), "c")
    cells = max(1, min(PARTITIONS, sum(groups * ranges[d] for d, groups in depth.items())))
    # A cell's blocks come before its tiles.
    both = left.union(right).repartition(cells, "cell").sortWithinPartitions("cell", F.col("qs").isNull(), "no")

    def scored(batches):
        now, qs, best = None, [], None
        for b in batches:
            for i, at in enumerate(b.column("cell").to_pylist()):
                if at != now:
                    yield from best.batches() if best else ()
                    now, qs, best = at, [], None
                if b.column("qs")[i].is_valid:
                    qs.append(b.column("qs")[i].values)
                    continue
                if qs:
                    qs, best = [], Best(pa.concat_arrays(qs), k, coordinate_from)
                best.meet(b.column("c")[i].values)
        yield from best.batches() if best else ()

    with batch_rows(spark, 4):
        hits = save(both.select("cell", "qs", "c").mapInArrow(scored, f"row long, query_id {kind}, vec_id {kind}, score long"))
    w = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
