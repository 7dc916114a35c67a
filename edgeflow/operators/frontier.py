"""Levels of a search while the frontier is small: one light job a level.

The edges are dealt evenly over tasks once, each share sorted by source and held as one
block, in memory or on the executors' disks; a lost block is made again from the saved
edges.  A level's job looks the frontier up in every block: no join, no table, no plan.  A hub's
edges lie in all blocks.  Only the frontier travels, as in a broadcast, and its size is
held: a block that finds more than its part of ``FRONTIER`` ids says so without sending them,
and the search goes on by joins.  A long search whose live edges are no more than a block holds
is ended by the task that gets them, in one job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from edgeflow.storage import Saved

#: Ids of a frontier, and ids that any block may always send.
FRONTIER, TELL = 1 << 16, 1 << 10
#: Edges of a block at most (a task holds some six copies of their 16 bytes while it packs them), and at least where there are several.
BLOCK_EDGES, LEAST_EDGES = 1 << 20, 1 << 16
#: Ids that are kept before they are written.
PENDING = 1 << 18
#: Levels from which on a search is a long one.
LONG = 8


def _by_source(batches) -> tuple[np.ndarray, np.ndarray]:
    own = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    src, dst = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*own, strict=True) if own else ((), ())))
    order = np.argsort(src, kind="stable")
    return src[order], dst[order]


def _packed(batches):
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in _by_source(batches)], ["src", "dst"])


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places ``start`` to ``start + many``, one range after the other."""
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())


class Blocks:
    """Edges, both ways, in blocks that can be looked up by source."""

    def __init__(self, edges: DataFrame, count: int):
        self.spark = edges.sparkSession
        self.parts = max(1, -(-count // BLOCK_EDGES), min(self.spark.sparkContext.defaultParallelism, count // LEAST_EDGES))
        packed = edges.select("src", "dst").repartition(self.parts, "src", "dst").mapInArrow(_packed, "src binary, dst binary")
        self.held = packed.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def next(self, front: np.ndarray, before: np.ndarray) -> np.ndarray | None:
        """The sorted neighbours of ``front`` that are neither in it nor in the level before; None if they may be too many."""
        tell = max(TELL, FRONTIER // self.parts)

        def near(rows):
            for s, d in rows:
                src, dst = (np.frombuffer(x, np.int64) for x in (s, d))
                start = np.searchsorted(src, front, "left")
                many = np.searchsorted(src, front, "right") - start
                found = np.unique(dst[_ranges(start, many)])
                for known in (front, before):
                    found = found[~np.isin(found, known, assume_unique=True)]
                yield found.tobytes() if len(found) <= tell else None

        heard = self.held.mapPartitions(near).collect()
        if None in heard:
            return None
        return np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in heard]))

    def drop(self) -> None:
        self.held.unpersist()


def table(spark, levels: list[tuple[int, np.ndarray]]) -> Saved:
    """``id, dist`` of some levels."""
    ids = np.concatenate([np.zeros(0, np.int64), *(x for _, x in levels)])
    dist = np.repeat(np.array([n for n, _ in levels], np.int64), [len(x) for _, x in levels])
    return Saved(spark.createDataFrame(pa.table({"id": ids, "dist": dist}), "id long, dist long"))


def ids(level: Saved | None) -> np.ndarray:
    """The sorted ids of a level that is known to be small."""
    return np.sort(np.array([r[0] for r in level.df.select("id").collect()] if level else [], np.int64))


def alone(edges: DataFrame, front: np.ndarray, before: np.ndarray, depth: int) -> Saved:
    """``id, dist`` of all levels past ``front``, which is level ``depth``; the edges are counted and no more than a block holds."""

    def search(batches):
        src, dst = _by_source(batches)
        ids, to = np.unique(np.concatenate([src, dst, front, before]), return_inverse=True)
        to, near = to[len(src) : 2 * len(src)], np.searchsorted(ids, front)
        start = np.searchsorted(src, ids, "left")
        many = np.searchsorted(src, ids, "right") - start
        dist = np.full(len(ids), -1, np.int64)
        dist[near], dist[np.searchsorted(ids, before)], level = depth, depth, depth
        while len(near):
            level += 1
            far = to[_ranges(start[near], many[near])]
            near = np.unique(far[dist[far] < 0])
            dist[near] = level
        new = dist > depth
        yield pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(dist[new])], ["id", "dist"])

    return Saved(edges.select("src", "dst").repartition(1).mapInArrow(search, "id long, dist long"))


def walk(blocks: Blocks, front: np.ndarray, before: np.ndarray, depth: int, until: int | None = None):
    """Levels past ``front``, which is level ``depth``, up to ``until``: a list of (level, ids) at a time, the last of them empty if the search is over."""
    pending = []
    while (near := blocks.next(front, before)) is not None:
        depth += 1
        pending.append((depth, near))
        if not len(near) or len(near) > FRONTIER or depth == until:
            break
        before, front = front, near
        if sum(len(x) for _, x in pending) >= PENDING:
            yield pending
            pending = []
    yield pending
