"""Connected components of an undirected view of an edge table."""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeflow.operators.joins import SHARE, SMALL, hub_limit, looked_up, shares
from edgeflow.storage import Saved

log = logging.getLogger("edgeflow")
#: Vertices of a task's forest, and edges that are joined to it at once, at least.
HELD, AT_ONCE = 1 << 22, 1 << 18


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _round(e: DataFrame, count: int) -> Saved:
    """One large-star and one small-star rewrite of ``count`` links ``u, v``."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    limit = hub_limit(e, 2 * count)
    least = Saved(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
    low = least.df.select("u", "m")
    large = (
        looked_up(both, low, "u", least.df.where(F.col("n") >= limit)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )
    mid = Saved(large, file_rows=SHARE)
    least.drop()
    least = Saved(mid.df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    low = least.df.select("u", "m")
    small = (
        looked_up(mid.df, low, "u", least.df.where(F.col("n") >= limit))
        .where("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(low.select("u", F.col("m").alias("v")))
        .distinct()
    )
    after = Saved(small, file_rows=SHARE)
    mid.drop()
    least.drop()
    return after


def star_contraction(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, comp)`` for every vertex that has an edge; ``comp`` is the smallest id reachable.

    Alternates the large-star and small-star rewrites until the edge set is a forest of
    stars around the component minima; the number of rounds is logarithmic in practice and
    does not depend on the diameter.  Each round is two grouped minima (combined before the
    shuffle) joined back to the edges by ordinary shuffle joins; a hub, as the minimum of a large
    component becomes, tells its own to every task, and its edges stay where they are.  Tasks of the rounds are as many as
    the links ask, so what one holds does not grow with the input.  Null endpoints and self-loops carry no link.
    """
    first = edges.where(F.col(src) != F.col(dst)).select(
        F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")
    )
    spark = edges.sparkSession
    raw = Saved(first, file_rows=SHARE)
    with shares(spark, raw.df.count()):
        held = Saved(raw.df.distinct(), file_rows=SHARE)
    raw.drop()
    before = _signature(held.df)
    while True:
        with shares(spark, 2 * before[0]):
            after = _round(held.df, before[0])
        held.drop()
        held = after
        now = _signature(held.df)
        log.info("components: %d links left", now[0])
        if now == before:
            break
        before = now
    e = held.df
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    )


class Forest:
    """Disjoint sets of vertices; a set's root is its smallest id.

    ``ids`` are sorted and ``parent`` tells each one's parent by place, at or before its own.
    """

    def __init__(self):
        self.ids = self.parent = np.zeros(0, np.int64)

    def find(self, at: np.ndarray) -> np.ndarray:
        """Roots of all places at once; every step halves the paths that it takes."""
        while True:
            up = self.parent[at]
            over = self.parent[up]
            if (up == over).all():
                return up
            self.parent[at] = over
            at = over

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        """Unite the ends of all edges: roots that an edge ties hook on to the least they meet, until none is apart."""
        ids = np.union1d(self.ids, np.concatenate([u, v]))
        moved = np.searchsorted(ids, self.ids)
        parent = np.arange(len(ids))
        parent[moved] = moved[self.parent]
        self.ids, self.parent = ids, parent
        a, b = np.searchsorted(ids, u), np.searchsorted(ids, v)
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))

    def links(self) -> pa.RecordBatch:
        """Every vertex but the roots, with its root."""
        root = self.find(np.arange(len(self.ids)))
        below = np.flatnonzero(root != np.arange(len(self.ids)))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[below]), pa.array(self.ids[root[below]])], ["src", "dst"])

    def roots(self) -> pa.RecordBatch:
        """Every vertex with its root."""
        root = self.find(np.arange(len(self.ids)))
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(self.ids[root])], ["id", "comp"])


def local_forests(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Links ``src, dst`` that tie the same vertices as the edges do: each task's edges as a forest.

    A task sends one link at most for each vertex it has seen but the roots, however many edges
    it has read.  A forest of ``HELD`` vertices is sent and a new one begun.
    """

    def each(batches):
        forest, us, vs, held = Forest(), [], [], 0
        for b in batches:
            us.append(b.column(0).to_numpy())
            vs.append(b.column(1).to_numpy())
            held += b.num_rows
            # As many new edges as old vertices at least, so that a vertex is copied seldom.
            if held >= max(AT_ONCE, len(forest.ids) // 2):
                forest.join(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [], [], 0
                if len(forest.ids) > HELD:
                    yield forest.links()
                    forest = Forest()
        if us:
            forest.join(np.concatenate(us), np.concatenate(vs))
        yield forest.links()

    ends = edges.where(F.col(src) != F.col(dst)).select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst"))
    return ends.mapInArrow(each, "src long, dst long")


def union_find(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, comp)`` as ``star_contraction`` gives them, from each task's forest in place of its edges."""
    return star_contraction(local_forests(edges, src, dst))


def connected(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, comp)`` as ``star_contraction`` gives them; of links that were counted and are ``SMALL`` at most one forest is made at once."""

    def each(batches):
        forest = Forest()
        for b in batches:
            forest.join(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield forest.roots()

    held = Saved(links.where(F.col(src) != F.col(dst)).select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst")))
    if held.df.count() > SMALL:
        found = star_contraction(held.df)
    else:
        found = Saved(held.df.coalesce(1).mapInArrow(each, "id long, comp long")).df
    held.drop()
    return found
