"""Physical orders of edges: curve codes, deltas, tiles, runs, compressed rows, dense names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeflow.functions.codec import delta_bytes, delta_decode, delta_encode, leb128_length
from edgeflow.functions.curve import decode_array, hilbert_code, hilbert_point, sort_key, unsigned
from edgeflow.operators.joins import told
from edgeflow.operators.ordered import in_order, walked, with_running

#: Edges in a row that holds a list.
RUN = 1 << 16


def _pattern(number: Column) -> Column:
    """A DECIMAL as a 64-bit pattern: modulo 2^64, the upper half negative."""
    whole = F.lit(str(1 << 64)).cast("decimal(38,0)")
    low = F.pmod(number, whole)
    return F.when(low >= F.lit(str(1 << 63)).cast("decimal(38,0)"), low - whole).otherwise(low).cast("bigint")


def coded(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", hilbert_code("src", "dst").alias("code"))


def curve_order(edges: DataFrame) -> DataFrame:
    """``rn, code``: all codes in unsigned order, duplicates kept."""
    return walked(coded(edges).select("code"), sort_key(F.col("code")), running={"rn": F.lit(1)}).select("rn", "code")


def together(*streams: DataFrame) -> DataFrame:
    """``code`` of all streams."""
    out = streams[0].select("code")
    for s in streams[1:]:
        out = out.unionByName(s.select("code"))
    return out


def points(codes: DataFrame) -> DataFrame:
    """``src, dst`` of codes."""
    return codes.select(hilbert_point("code").alias("p")).select(F.col("p.x").alias("src"), F.col("p.y").alias("dst"))


def merge(*streams: DataFrame, distinct: bool = False) -> DataFrame:
    """``code`` of all streams in unsigned order; ``distinct`` drops duplicates."""
    out = together(*streams)
    out = out.distinct() if distinct else out
    return out.orderBy(sort_key(F.col("code")))


def deltas(codes: DataFrame) -> DataFrame:
    """``rn, code, delta``: differences of distinct codes in unsigned order, the first from 0.

    Code 0, the edge (0, 0), has no positive delta and raises.
    """
    ordered = walked(codes.select("code").distinct(), sort_key(F.col("code")), previous={"previous": "code"}, default=0, running={"rn": F.lit(1)})
    gap = F.col("code").cast("decimal(38,0)") - F.col("previous").cast("decimal(38,0)")
    out = ordered.withColumn("delta", _pattern(gap))
    stop = F.raise_error(F.lit("edge (0, 0) cannot be delta coded")).cast("bigint")
    return out.select("rn", "code", F.when(F.col("delta") == 0, stop).otherwise(F.col("delta")).alias("delta"))


def delta_stream(codes: DataFrame) -> DataFrame:
    """``rn, bytes``: the coded deltas in order."""
    return deltas(codes).select("rn", delta_bytes(F.col("delta")).alias("bytes"))


def undelta(gaps: DataFrame) -> DataFrame:
    """``src, dst`` from ``rn, delta``: prefix sums, then points."""
    ranged = in_order(gaps.select("rn", "delta"), "rn")
    summed = with_running(ranged, F.col("rn"), code=unsigned(F.col("delta")).cast("decimal(38,0)"))
    return points(summed.select(_pattern(F.col("code")).alias("code")))


def delta_blocks(codes: DataFrame) -> DataFrame:
    """``first, n, data``: distinct codes as delta streams in a BINARY column, each from code 0 and of a batch's length at most."""

    def packed(batches):
        for b in batches:
            code = b.column(0).to_numpy().view(np.uint64)
            if len(code):
                data = delta_encode(np.diff(code, prepend=np.uint64(0)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([len(code)], pa.int64()), pa.array([data], pa.binary())], ["first", "n", "data"])

    key = sort_key(F.col("code"))
    ranged = codes.select("code").distinct().repartitionByRange(key).sortWithinPartitions(key)
    return ranged.mapInArrow(packed, "first long, n long, data binary")


def undelta_blocks(blocks: DataFrame) -> DataFrame:
    """``src, dst`` of delta streams in a BINARY column ``data``."""

    def unpacked(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                code = np.cumsum(np.array(delta_decode(data), np.uint64), dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in decode_array(code)], ["src", "dst"])

    return blocks.select("data").mapInArrow(unpacked, "src long, dst long")


def _in_runs(rows: DataFrame, order: list[Column], longest: int) -> DataFrame:
    """Adds ``run``: rows in the order, so many to a run, for groups that must not grow with a hub."""
    return walked(rows, *order, running={"rn": F.lit(1)}).withColumn("run", F.expr(f"(rn - 1) div {longest}")).drop("rn")


def tiles(edges: DataFrame, longest: int = RUN) -> DataFrame:
    """``tile, ux, uy, run, cnt, lowers``: edges by upper 32 bits of their code, lower halves in curve order.

    A tile that lies in several runs of ``longest`` edges has a row for each.
    """
    c = coded(edges).select(
        sort_key(F.col("code")).alias("key"),
        F.shiftrightunsigned("code", 32).alias("tile"), F.shiftright("src", 16).cast("int").alias("ux"), F.shiftright("dst", 16).cast("int").alias("uy"),
        F.struct(F.col("code").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).alias("low"), F.col("src").bitwiseAND(65535).cast("int").alias("lx"), F.col("dst").bitwiseAND(65535).cast("int").alias("ly")).alias("l"),
    )
    packed = F.transform(F.sort_array(F.collect_list("l")), lambda l: F.struct(l["lx"].alias("lx"), l["ly"].alias("ly")))
    return _in_runs(c, [F.col("key")], longest).groupBy("tile", "ux", "uy", "run").agg(F.count("*").alias("cnt"), packed.alias("lowers"))


def tile_counts(edges: DataFrame) -> DataFrame:
    """``tile, ux, uy, cnt`` without the contents: summed before the shuffle."""
    c = coded(edges).select(F.shiftrightunsigned("code", 32).alias("tile"), F.shiftright("src", 16).alias("ux"), F.shiftright("dst", 16).alias("uy"))
    return c.groupBy("tile", "ux", "uy").agg(F.count("*").alias("cnt"))


def untile(tiled: DataFrame) -> DataFrame:
    e = tiled.select("ux", "uy", F.explode("lowers").alias("l"))
    join = lambda u, low: F.shiftleft(F.col(u).cast("bigint"), 16).bitwiseOR(F.col(low).cast("bigint"))
    return e.select(join("ux", "l.lx").alias("src"), join("uy", "l.ly").alias("dst"))


def adjacency(edges: DataFrame, longest: int = RUN) -> DataFrame:
    """``src, run, cnt, dsts``: targets in order; a source that lies in several runs of ``longest`` edges has a row for each."""
    runs = _in_runs(edges.select("src", "dst"), [F.col("src"), F.col("dst")], longest)
    return runs.groupBy("src", "run").agg(F.count("*").alias("cnt"), F.sort_array(F.collect_list("dst")).alias("dsts"))


def unadjacency(runs: DataFrame) -> DataFrame:
    return runs.select("src", F.explode("dsts").alias("dst"))


def vertex_runs(edges: DataFrame) -> DataFrame:
    """``src, cnt`` of an edge list sorted by source."""
    return edges.groupBy("src").agg(F.count("*").alias("cnt"))


def runs_in_order(edges: DataFrame, position: str) -> DataFrame:
    """``run, src, cnt``: runs of equal sources in the order of ``position``, one vertex possibly in several."""
    ranged = walked(edges, position, previous={"before": "src"}, default=-1)
    run = walked(ranged, position, running={"run": (F.col("src") != F.col("before")).cast("int")})
    return run.groupBy("run", "src").agg(F.count("*").alias("cnt"))


def csr_gaps(edges: DataFrame) -> DataFrame:
    """``node, edge, gap``: differences of a node's targets in order, the first from 0."""
    at = F.struct("node", "edge")
    pairs = edges.select(F.col("src").alias("node"), F.col("dst").alias("edge")).distinct().withColumn("at", at)
    # Lags over the whole order, so that a hub is no single group.
    gaps = walked(pairs, "node", "edge", previous={"before": "at"})
    gap = F.when(F.col("before.node") == F.col("node"), F.col("edge") - F.col("before.edge")).otherwise(F.col("edge"))
    return gaps.select("node", "edge", gap.alias("gap"))


def csr_offsets(edges: DataFrame) -> DataFrame:
    """``node, end_byte``: where each node's LEB128 gaps end, for all nodes before the last."""
    sizes = csr_gaps(edges).groupBy("node").agg(F.sum(leb128_length(F.col("gap"))).alias("size"))
    last = sizes.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0]
    every = edges.sparkSession.range(last).withColumnRenamed("id", "node").join(sizes, "node", "left")
    return walked(every.withColumn("size", F.coalesce("size", F.lit(0))), "node", running={"end_byte": F.col("size")}).select("node", "end_byte")


def dense_names(edges: DataFrame) -> DataFrame:
    """``id, dense``: names 0, 1, 2 ... by first appearance over edges in (src, dst) order, source before target."""
    ordered = walked(edges.select("src", "dst"), "src", "dst", running={"rn": F.lit(1)})
    numbered = ordered.select("rn", F.posexplode(F.array("src", "dst")).alias("k", "id"))
    first = numbered.groupBy("id").agg(F.min(F.col("rn") * 2 + F.col("k")).alias("at"))
    return walked(first, "at", running={"dense": F.lit(1)}).select("id", (F.col("dense") - 1).alias("dense"))


def renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    a = names.select(F.col("id").alias("src"), F.col("dense").alias("s"))
    b = names.select(F.col("id").alias("dst"), F.col("dense").alias("d"))
    return edges.join(told(a), "src").join(told(b), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
