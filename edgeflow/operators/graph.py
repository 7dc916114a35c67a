"""A directed multigraph: edges ``src, dst`` and a bound ``n`` on vertex ids."""

from __future__ import annotations

import logging
import pickle
from functools import cached_property, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeflow.operators import frontier
from edgeflow.operators.components import star_contraction, union_find
from edgeflow.operators.joins import SHARE, hubs, looked_up, told
from edgeflow.storage import Saved, save

ALPHA = 0.85
#: A heavy source's edges are dealt over so many keys.
SALTS = 64
#: Levels of a search whose tables are kept apart before they become one.
TABLES = 16
#: Leaves are peeled off as long as each turn takes one in so many edges.
PEEL = 8
#: States of a fold that a task merges.
FAN = 16
log = logging.getLogger("edgeflow")


def _stack(tiers: list[list[Saved]], table: Saved) -> None:
    """Keep a table; of every ``TABLES`` tables of a tier make one of the next, so that few stay, each row copied seldom."""
    for tier in tiers:
        tier.append(table)
        if len(tier) < TABLES:
            return
        whole = tier[0].df
        for t in tier[1:]:
            whole = whole.union(t.df)
        table = Saved(whole)
        for t in tier:
            t.drop()
        tier.clear()
    tiers.append([table])


def _without(edges: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """Edges that none of the ``rows`` vertices ``ids`` is an end of."""
    for end in ("src", "dst"):
        edges = edges.join(told(ids.select(F.col("id").alias(end)), rows), end, "left_anti")
    return edges.select("src", "dst")


def _peeled(live: Saved, edges: int, front: DataFrame, found: int) -> tuple[Saved, int, list[Saved]]:
    """Edges, both ways, without leaves: what is left, its count, and ``id, parent`` of the leaves of each turn.

    A leaf is a vertex with one neighbour, its parent, and not one of ``front``.  It ends every path that meets it, so a
    search may leave it out and place it below its parent afterwards.  Turns end once the edges fit one block.
    """
    turns, most = [], edges
    while edges > frontier.BLOCK_EDGES and edges <= most:
        near = live.df.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("parent"), F.count("*").alias("n"))
        turns.append(Saved(near.where("n = 1").join(told(front.select("id"), found), "id", "left_anti").select("id", "parent")))
        rest = Saved(_without(live.df, turns[-1].df, turns[-1].df.count()))
        live.drop()
        live, most, edges = rest, edges - edges // PEEL, rest.df.count()
        log.info("bfs: %d edges are left without leaves", edges)
    return live, edges, turns


class Graph:
    """Operators over an edge table.  Ids are 0 to ``n - 1``; without ``n`` it is the largest id plus one."""

    def __init__(self, edges: DataFrame, n: int | None = None):
        self.edges = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
        self._n = n

    @property
    def spark(self):
        return self.edges.sparkSession

    @cached_property
    def n(self) -> int:
        if self._n is not None:
            return self._n
        return self.stats().first()["nodes"]

    def validated(self) -> Graph:
        """The same graph, with an id outside 0 to ``n - 1`` raising an error when the edges are read."""
        bad = (F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= self.n) | F.col("src").isNull() | F.col("dst").isNull()
        stop = F.raise_error(F.concat_ws(" ", F.lit("edge outside the graph:"), "src", "dst")).cast("bigint")
        return Graph(self.edges.withColumn("src", F.when(bad, stop).otherwise(F.col("src"))), self.n)

    def vertices(self) -> DataFrame:
        return self.spark.range(self.n)

    def everywhere(self, state: DataFrame, **defaults) -> DataFrame:
        """``state`` over all vertices, with defaults where it has no row; a partition has ``SHARE`` of the vertices at most, about."""
        every, parts = self.vertices(), -(-self.n // SHARE)
        if parts > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            every, state = every.repartition(parts, "id"), state.repartition(parts, "id")
        out = every.join(told(state), "id", "left")
        return out.withColumns({k: F.coalesce(F.col(k), v) for k, v in defaults.items()})

    def stats(self) -> DataFrame:
        """``max_x, max_y, edges, nodes``; zeros for a graph without edges."""
        top = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("bigint")
        s = self.edges.agg(top("src").alias("max_x"), top("dst").alias("max_y"), F.count("*").alias("edges"))
        return s.withColumn("nodes", F.greatest("max_x", "max_y") + 1)

    def out_degree(self) -> DataFrame:
        """``id, deg`` with multiplicity, for vertices with an out-edge."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))

    def symmetric(self) -> DataFrame:
        return self.edges.union(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def edge_weights(self) -> DataFrame:
        """Every edge with its source's out-degree."""
        return self.edges.join(self.out_degree().withColumnRenamed("id", "src"), "src")

    def aggregate_messages(self, state: DataFrame, message, combine, to: str = "dst") -> DataFrame:
        """Send ``message`` (a column over ``src``, ``dst`` and the sender's state) along edges; ``combine`` at the receiver."""
        sender = "src" if to == "dst" else "dst"
        sent = self.edges.join(state.withColumnRenamed("id", sender), sender)
        return sent.select(F.col(to).alias("id"), message.alias("m")).groupBy("id").agg(combine("m").alias("m"))

    def fold_edges(self, start, step, merge, finish, schema: str) -> DataFrame:
        """A state of any kind over all edges: ``finish`` of it gives columns (name to values) of ``schema``.

        ``start()`` makes a task's state, ``step(state, src, dst)`` takes a batch of edges as arrays
        and returns it, ``merge(a, b)`` makes one of two.  Tasks send their states; tasks merge ``FAN`` of them, in rounds, so
        none sees more.  What a state holds must fit in a task; steps and merges must not
        depend on the order of edges.
        """

        def folded(batches):
            state = start()
            for b in batches:
                state = step(state, b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([pickle.dumps(state)])], ["k", "state"])

        def merged(table: pa.Table) -> pa.Table:
            states = map(pickle.loads, table.column("state").to_pylist())
            return pa.table({"k": table.column("k")[:1], "state": pa.array([pickle.dumps(reduce(merge, states))], pa.binary())})

        def finished(batches):
            for b in batches:
                for data in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_pydict(finish(pickle.loads(data)))

        states = Saved(self.edges.mapInArrow(folded, "k long, state binary"))
        while states.df.count() > 1:
            up = Saved(states.df.withColumn("k", F.expr(f"k div {FAN}")).groupBy("k").applyInArrow(merged, "k long, state binary"))
            states.drop()
            states = up
        return states.df.select("state").mapInArrow(finished, schema)

    def _shares(self) -> DataFrame:
        """Parallel edges as one: the share of a source's rank that goes to a target."""
        pairs = self.edges.groupBy("src", "dst").agg(F.count("*").alias("k"))
        return pairs.join(self.out_degree().withColumnRenamed("id", "src"), "src").select("src", "dst", (F.col("k") / F.col("deg")).alias("w"))

    def pagerank(self, alpha: float = ALPHA, iterations: int = 20, cut: int = 7, heavy_from: int | None = None) -> DataFrame:
        """``id, rank``: ``iterations`` synchronous steps from zero; not normalised, dangling mass dropped.

        The first step gives every vertex ``1 - alpha``.  Shares are partitioned by source
        once; a step's sums leave partitioned by vertex, which is how the next step joins
        them, so a step shuffles only the partial sums.  A source with ``heavy_from`` targets
        or more (by default half of a partition's even share) is dealt over ``SALTS`` keys
        and its rank sent to each.  Lineage is cut every ``cut`` steps.
        """
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        held = Saved(self._shares())
        limit = heavy_from or max(SALTS, held.df.count() // (2 * parts))
        # As the sources' targets add up to the edges, there are at most 2 * parts of these by default.
        heavy = Saved(held.df.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= limit).select("src", F.lit(True).alias("heavy")))
        salted = heavy.df.limit(1).count() > 0
        key = ["src", "salt"] if salted else ["src"]
        marked = held.df
        if salted:
            small = heavy.df if heavy_from else F.broadcast(heavy.df)
            salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("dst"), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))
            marked = marked.join(small, "src", "left").withColumn("salt", salt).drop("heavy")
        w = marked.repartition(parts, *key).persist()
        sums, kept = None, []
        for i in range(1, iterations):
            log.info("pagerank: step %d of %d", i, iterations)
            if sums is None:
                sent = w.select("dst", (F.col("w") * F.lit(alpha * (1 - alpha))).alias("c"))
            else:
                rank = F.lit(1 - alpha) + F.coalesce("s", F.lit(0.0))
                told = sums
                if salted:
                    salts = F.when(F.col("heavy"), F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
                    told = sums.join(small, "src", "left").withColumn("salt", F.explode(salts)).drop("heavy")
                sent = w.join(told, key, "left").select("dst", (F.col("w") * alpha * rank).alias("c"))
            sums = sent.groupBy("dst").agg(F.sum("c").alias("s")).withColumnRenamed("dst", "src")
            if i % cut == 0 or i == iterations - 1:
                kept.append(Saved(sums))
                sums = kept[-1].df
                for old in kept[:-1]:
                    old.drop()
                del kept[:-1]
        w.unpersist()
        held.drop()
        heavy.drop()
        if sums is None:
            sums = self.spark.createDataFrame([], "src bigint, s double")
        full = self.everywhere(sums.withColumnRenamed("src", "id"), s=F.lit(0.0))
        return full.select("id", (F.lit(1 - alpha if iterations else 0.0) + F.col("s")).alias("rank"))

    def components(self, method: str = "union") -> DataFrame:
        """``id, comp``: the smallest id of each vertex's weakly connected component.

        ``union`` makes each task's edges a disjoint-set forest and contracts the forests' stars;
        ``star`` contracts the edges' own; ``minlabel`` propagates labels.  All end at the same fixpoint.
        """
        if method == "minlabel":
            return self.label_propagation().withColumnRenamed("label", "comp")
        return self.everywhere({"union": union_find, "star": star_contraction}[method](self.edges), comp=F.col("id"))

    def label_propagation(self) -> DataFrame:
        """``id, label``: least labels passed along edges both ways until none falls.

        A vertex takes the least label around it; so does the vertex that lent it its label;
        then labels are replaced by their own labels.  With these jumps the number of rounds
        is about the logarithm of the diameter.
        """
        both = Saved(self.symmetric().where("src <> dst").distinct())
        links = both.df.count()
        crowded = hubs(both.df, "dst", links)
        state = Saved(both.df.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("label")).select("id", F.least("id", "label").alias("label")))
        while True:
            s = state.df
            near = looked_up(both.df, s.withColumnRenamed("id", "dst"), "dst", crowded.df)
            heard = s.join(told(near.groupBy(F.col("src").alias("id")).agg(F.min("label").alias("m"))), "id")
            hook = heard.groupBy(F.col("label").alias("id")).agg(F.min("m").alias("h"))
            low = heard.join(told(hook), "id", "left").select("id", F.least("label", "m", "h").alias("low"), "label")
            mid = Saved(low)
            jump = mid.df.select(F.col("id").alias("low"), F.col("low").alias("far"))
            shared = hubs(mid.df, "low", links)
            new = Saved(looked_up(mid.df, jump, "low", shared.df).select("id", F.least("low", "far").alias("label"), F.col("label").alias("old")))
            moved = new.df.where("label < old").limit(1).count()
            log.info("label propagation: %s", "some labels fell" if moved else "no label falls any more")
            state.drop()
            mid.drop()
            shared.drop()
            state = Saved(new.df.select("id", "label")) if moved else new
            if not moved:
                break
            new.drop()
        both.drop()
        crowded.drop()
        return self.everywhere(state.df.select("id", "label"), label=F.col("id"))

    def label_step(self) -> DataFrame:
        """One synchronous round of label propagation from own ids."""
        got = self.symmetric().groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m"))
        return self.vertices().join(got, "id", "left").select("id", F.least("id", F.coalesce("m", "id")).alias("label"))

    def bfs(self, root: int = 0) -> DataFrame:
        """``id, dist`` over edges taken both ways; null where ``root`` does not reach.

        A level joins the frontier to the edges.  As edges go both ways, its neighbours are of
        the level before, its own or the next, so the last two levels are all that is left out.
        Once half of the vertices that still have edges are visited, their edges are retired;
        each retirement halves what is left, so all of them together write the edges twice.
        While the frontier is small, levels are looked up in blocks of the live edges (see
        ``frontier``), a light job each; else joins take ``TABLES`` levels before blocks are made again.
        A search of ``LONG`` levels may have very many more.  Its leaves are then peeled off, which come below their
        parents at the end, and live edges that fit one block are searched by one task, all levels in a job.
        """
        live = Saved(self.symmetric().where("src <> dst").distinct())
        left, edges = live.df.select("src").distinct().count(), live.df.count()
        start = self.spark.range(1).select(F.lit(root).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("dist"))
        before, front, depth, tiers = None, Saved(start), 0, [[]]
        visited, kept_from, found, last, wait = 1, 0, 1, 0, 0
        leaves, peeled_at = None, 0

        def seen(*more: Saved) -> DataFrame:
            tables = [t.df for tier in tiers for t in tier] + [m.df for m in more if m]
            return reduce(DataFrame.union, tables)

        while True:
            long = depth >= frontier.LONG
            if long and edges <= frontier.BLOCK_EDGES and found <= frontier.FRONTIER:
                rest = frontier.alone(live.df, frontier.ids(front), frontier.ids(before), depth)
                log.info("bfs: levels from %d on by one task", depth + 1)
                for level in (before, front, rest):
                    if level:
                        _stack(tiers, level)
                before = front = None
                break
            if long and leaves is None:
                _stack(tiers, before)
                gone = seen().where(F.col("dist") >= kept_from)
                rest = Saved(_without(live.df, gone, visited))
                live.drop()
                live, edges, leaves = _peeled(rest, rest.df.count(), front.df, found)
                before, left, visited, kept_from, peeled_at, wait = None, live.df.select("src").distinct().count(), found, depth, depth, 0
                continue
            if not wait and found <= frontier.FRONTIER:
                blocks, wait = frontier.Blocks(live.df, edges), TABLES
                recent = [(depth - 1, frontier.ids(before)), (depth, frontier.ids(front))]
                for levels in frontier.walk(blocks, recent[1][1], recent[0][1], depth, frontier.LONG if leaves is None else None):
                    for old in (before, front):
                        if old:
                            old.drop()
                    recent += levels
                    _stack(tiers, frontier.table(self.spark, recent[:-2]))
                    recent, visited = recent[-2:], visited + sum(len(x) for _, x in levels)
                    before, front = (frontier.table(self.spark, [x]) for x in recent)
                blocks.drop()
                log.info("bfs: levels %d to %d by blocks", depth + 1, recent[1][0])
                depth, found, last = recent[1][0], len(recent[1][1]), len(recent[0][1])
                if not found:
                    break
                continue
            wait = max(0, wait - 1)
            depth += 1
            step = live.df.join(told(front.df.select(F.col("id").alias("src")), found), "src").select(F.col("dst").alias("id")).distinct()
            for known, rows in ((before, last), (front, found)):
                step = step.join(told(known.df.select("id"), rows), "id", "left_anti") if known else step
            level = Saved(step.withColumn("dist", F.lit(depth).cast("bigint")))
            found, last = level.df.count(), found
            log.info("bfs: %d vertices at level %d", found, depth)
            if not found:
                break
            if 2 * visited >= left:
                gone = seen(before, front).where(F.col("dist") >= kept_from)
                rest = Saved(live.df.join(told(gone.select(F.col("id").alias("src")), visited), "src", "left_anti"))
                live.drop()
                live, left, visited, kept_from, edges = rest, left - visited, 0, depth, rest.df.count()
            if before:
                _stack(tiers, before)
            before, front, visited = front, level, visited + found
        live.drop()
        for turn in reversed(leaves or []):
            up = seen(before, front).where(F.col("dist") >= peeled_at).select(F.col("id").alias("parent"), "dist")
            _stack(tiers, Saved(turn.df.join(told(up), "parent").select("id", (F.col("dist") + 1).alias("dist"))))
            turn.drop()
        return self.vertices().join(told(seen(before, front)), "id", "left")

    def bfs_tree(self, root: int = 0) -> DataFrame:
        """``id, parent``: for every vertex reached, its least neighbour one level up."""
        levels = save(self.bfs(root).where("dist is not null"))
        up = levels.select(F.col("id").alias("src"), F.col("dist").alias("up"))
        steps = self.symmetric().join(told(up), "src").join(told(levels.withColumnRenamed("id", "dst")), "dst").where("dist = up + 1")
        return steps.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))

    def live_edges(self, level: int, root: int = 0) -> DataFrame:
        """Edges that can still carry a search past ``level``: both ends beyond it, one by more than a level."""
        far = save(self.bfs(root).select("id", F.coalesce("dist", F.lit(1 << 40)).alias("d")))
        a, b = far.select(F.col("id").alias("src"), F.col("d").alias("da")), far.select(F.col("id").alias("dst"), F.col("d").alias("db"))
        return self.edges.join(told(a), "src").join(told(b), "dst").where((F.least("da", "db") > level) & (F.greatest("da", "db") > level + 1)).select("src", "dst")
