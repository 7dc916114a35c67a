"""The query catalogue: every graph operator on a derived graph, and the same result in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeflow.functions import codec, curve
from edgeflow.operators import layout
from edgeflow.operators.graph import Graph
from edgeflow.plans import fixtures
from edgeflow.sources import binary, datasource, files, text
from edgeflow.storage import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _with(body: str, *parts: str, name: str = "g1", times: int = 1, span: int | None = fixtures.SPAN) -> str:
    """SQL with the graph's tables; ``RECURSIVE`` is harmless where nothing recurs."""
    return f"WITH RECURSIVE {', '.join([fixtures.sql(name, times, span), *parts])} {body}"


def _quantised(rank: str) -> str:
    return f"cast(floor({rank} * 1e6 + 0.37) AS BIGINT)"


SYM = "sym AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"
PAIRS = "pairs AS MATERIALIZED (SELECT DISTINCT src, dst FROM sym WHERE src <> dst)"
LOW = (
    "low(id, comp) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT p.dst, min(low.comp) FROM low JOIN pairs p ON p.src = low.id "
    "JOIN recurring.low r ON r.id = p.dst WHERE low.comp < r.comp GROUP BY p.dst)"
)
LEVELS = (
    "b(id, dist) USING KEY (id) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT p.dst, min(b.dist) + 1 FROM b JOIN pairs p ON p.src = b.id "
    "LEFT JOIN recurring.b r ON r.id = p.dst WHERE r.id IS NULL GROUP BY p.dst)"
)
#: One digit of the curve a round, the highest first, over the distinct edges.
CODES = """h(src, dst, x, y, c, i) AS (
  SELECT src, dst, src, dst, 0::HUGEINT, 31 FROM (SELECT DISTINCT src, dst FROM e)
  UNION ALL
  SELECT src, dst,
    CASE WHEN (y >> i) & 1 = 1 THEN x WHEN (x >> i) & 1 = 1 THEN xor(y, 4294967295) ELSE y END,
    CASE WHEN (y >> i) & 1 = 1 THEN y WHEN (x >> i) & 1 = 1 THEN xor(x, 4294967295) ELSE x END,
    c * 4 + xor(3 * ((x >> i) & 1), (y >> i) & 1), i - 1
  FROM h WHERE i >= 0
), code AS MATERIALIZED (SELECT src, dst, c FROM h WHERE i = -1)"""
GAPS = "gaps AS (SELECT row_number() OVER (ORDER BY c) AS rn, (c - lag(c, 1, 0::HUGEINT) OVER (ORDER BY c))::BIGINT AS delta FROM code)"
LINES = """CASE o_orderkey % 5 WHEN 0 THEN '# ' || o_orderkey WHEN 1 THEN o_orderkey || ' ' || o_custkey
 WHEN 2 THEN o_orderkey || chr(9) || o_custkey WHEN 3 THEN '  ' || o_orderkey || '   ' || o_custkey || ' ' || o_orderstatus
 ELSE '+' || o_orderkey || ' ' || o_custkey || chr(9) || 'x y' END"""


@query("SELECT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderkey % 5 <> 0")
def scan_text(spark, sf_dir):
    path = f"{shared_dir(spark)}/edgeflow-lines-{uuid.uuid4().hex}"
    fixtures.table(spark, sf_dir, "orders").selectExpr(f"{LINES} AS value").write.text(path)
    return text.read_text(spark, path)


@query(_with("SELECT coalesce(max(src), 0) AS max_x, coalesce(max(dst), 0) AS max_y, count(*) AS edges, greatest(coalesce(max(src), 0), coalesce(max(dst), 0)) + 1 AS nodes FROM e"))
def stats(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).stats()


@query(_with("SELECT src AS id, count(*) AS deg FROM e GROUP BY src"))
def out_degree(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).out_degree()


@query(_with("SELECT e.src, e.dst, d.deg FROM e JOIN (SELECT src, count(*) AS deg FROM e GROUP BY src) d USING (src)"))
def edge_weights(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).edge_weights().select("src", "dst", "deg")


@query(_with("SELECT src, dst FROM sym", SYM))
def symmetrize(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).symmetric()


def _rank_sql(steps: int, name: str = "g1") -> str:
    parts = ["deg AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY src)", "r0 AS MATERIALIZED (SELECT id, 0.15::DOUBLE AS rank FROM v)"]
    for i in range(1, steps + 1):
        sent = f"SELECT e.dst, sum(0.85 * r.rank / d.deg) AS s FROM e JOIN deg d USING (src) JOIN r{i - 1} r ON r.id = e.src GROUP BY e.dst"
        parts.append(f"r{i} AS MATERIALIZED (SELECT v.id, 0.15 + coalesce(s, 0) AS rank FROM v LEFT JOIN ({sent}) t ON t.dst = v.id)")
    return _with(f"SELECT id, {_quantised('rank')} AS q FROM r{steps}", *parts, name=name)


@query(_rank_sql(1))
def pagerank_step(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).pagerank(iterations=2).selectExpr("id", f"{_quantised('rank')} AS q")


@query(_rank_sql(19, "g4"))
def pagerank_g4(spark, sf_dir):
    """Dangling vertices: their rank goes nowhere."""
    return fixtures.graph(spark, sf_dir, "g4").pagerank().selectExpr("id", f"{_quantised('rank')} AS q")


@query(_rank_sql(19, "g3"))
def pagerank_hubs(spark, sf_dir):
    """Heavy sources dealt over several keys."""
    return fixtures.graph(spark, sf_dir, "g3").pagerank(heavy_from=5).selectExpr("id", f"{_quantised('rank')} AS q")


@query(_rank_sql(19))
def pagerank(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).validated().pagerank().selectExpr("id", f"{_quantised('rank')} AS q")


@query(_with("SELECT v.id, least(v.id, coalesce(m, v.id)) AS label FROM v LEFT JOIN (SELECT src, min(dst) AS m FROM sym GROUP BY src) ON src = v.id", SYM))
def label_prop_step(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).label_step()


def _label(name):
    return lambda spark, sf_dir: fixtures.graph(spark, sf_dir, name).label_propagation()


def _components(name):
    return lambda spark, sf_dir: fixtures.graph(spark, sf_dir, name).components()


for _suffix, _name in (("", "g1"), ("_g2", "g2"), ("_g3", "g3"), ("_g4", "g4")):
    QUERIES[f"label_prop{_suffix}"] = _label(_name)
    SQL[f"label_prop{_suffix}"] = _with("SELECT id, comp AS label FROM low", SYM, PAIRS, LOW, name=_name)
    QUERIES[f"components{_suffix}"] = _components(_name)
    SQL[f"components{_suffix}"] = _with("SELECT id, comp FROM low", SYM, PAIRS, LOW, name=_name)


@query(_with("SELECT comp, count(*) AS n FROM low GROUP BY comp", SYM, PAIRS, LOW))
def component_sizes(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).components().groupBy("comp").agg(F.count("*").alias("n"))


@query(_with("SELECT count(*) AS non_roots FROM low WHERE id <> comp", SYM, PAIRS, LOW))
def non_roots(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).components().where("id <> comp").agg(F.count("*").alias("non_roots"))


@query(_with("SELECT id, comp FROM low", SYM, PAIRS, LOW))
def union_find(spark, sf_dir):
    """Components by a forest of disjoint sets in each task, contracted."""
    return fixtures.graph(spark, sf_dir).components("union")


@query(_with("SELECT count(*) AS non_roots FROM low WHERE id <> comp", SYM, PAIRS, LOW, name="g2"))
def union_find_non_roots(spark, sf_dir):
    return fixtures.graph(spark, sf_dir, "g2").components("union").where("id <> comp").agg(F.count("*").alias("non_roots"))


@query(_with("SELECT id, comp FROM low", SYM, PAIRS, LOW))
def components_star(spark, sf_dir):
    """Components by stars of the edges themselves."""
    return fixtures.graph(spark, sf_dir).components("star")


@query(_with("SELECT DISTINCT dst AS id FROM sym WHERE src = 0", SYM))
def seed_neighbors(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).symmetric().where("src = 0").select(F.col("dst").alias("id")).distinct()


@query(_with("SELECT id FROM low WHERE comp <> 0", SYM, PAIRS, LOW))
def outside_root_component(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).components().where("comp <> 0").select("id")


@query(_with("SELECT v.id, b.dist FROM v LEFT JOIN b USING (id)", SYM, PAIRS, LEVELS))
def bfs_levels(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).bfs()


def _levels(name):
    return lambda spark, sf_dir: fixtures.graph(spark, sf_dir, name).bfs()


for _name in ("g2", "g3", "g4"):
    QUERIES[f"bfs_levels_{_name}"] = _levels(_name)
    SQL[f"bfs_levels_{_name}"] = _with("SELECT v.id, b.dist FROM v LEFT JOIN b USING (id)", SYM, PAIRS, LEVELS, name=_name)


@query(_with("SELECT coalesce(b.dist, 0) AS dist, count(*) AS n FROM v LEFT JOIN b USING (id) GROUP BY 1", SYM, PAIRS, LEVELS))
def bfs_histogram(spark, sf_dir):
    """Unreached vertices are counted with level 0."""
    return fixtures.graph(spark, sf_dir).bfs().groupBy(F.coalesce("dist", F.lit(0)).cast("bigint").alias("dist")).agg(F.count("*").alias("n"))


@query(_with("SELECT p.dst AS id, min(p.src) AS parent FROM pairs p JOIN b x ON x.id = p.src JOIN b y ON y.id = p.dst WHERE y.dist = x.dist + 1 GROUP BY p.dst", SYM, PAIRS, LEVELS))
def bfs_tree(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).bfs_tree()


@query(_with("""SELECT src, dst FROM (SELECT e.src, e.dst, coalesce(x.dist, 1000000) AS a, coalesce(y.dist, 1000000) AS c
 FROM e LEFT JOIN b x ON x.id = e.src LEFT JOIN b y ON y.id = e.dst) WHERE least(a, c) > 1 AND greatest(a, c) > 2""", SYM, PAIRS, LEVELS))  # fmt: skip
def live_edges(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).live_edges(1)


ENCODED = _with("SELECT src, dst, c::BIGINT AS code FROM code", CODES)


@query(ENCODED)
def hilbert_encode(spark, sf_dir):
    e = layout.coded(fixtures.graph(spark, sf_dir).edges.distinct())
    return e.select("src", "dst", "code")


@query(ENCODED)
def hilbert_encode_native(spark, sf_dir):
    e = fixtures.graph(spark, sf_dir).edges.distinct()
    return e.select("src", "dst", curve.hilbert_code_native(F.col("src"), F.col("dst")).alias("code"))


@query(_with("SELECT c::BIGINT AS code, src AS x, dst AS y FROM code", CODES))
def hilbert_decode(spark, sf_dir):
    e = layout.coded(fixtures.graph(spark, sf_dir).edges.distinct())
    return e.select("code", curve.hilbert_point("code").alias("p")).select("code", "p.x", "p.y")


@query(_with("SELECT row_number() OVER (ORDER BY c) AS rn, c::BIGINT AS code FROM e JOIN code USING (src, dst)", CODES, times=977))
def hilbert_order(spark, sf_dir):
    rows = layout.curve_order(fixtures.graph(spark, sf_dir, times=977).edges)
    return rows.select("rn", "code")


@query(_with("SELECT rn, delta FROM gaps", CODES, GAPS))
def hilbert_deltas(spark, sf_dir):
    return layout.deltas(layout.coded(fixtures.graph(spark, sf_dir).edges)).select("rn", "delta")


@query(_with("""SELECT rn, delta, 2 * size - 1 AS len, repeat('00', (size - 1)::INT) || lpad(h, (2 * size)::INT, '0') AS hex
 FROM (SELECT rn, delta, upper(to_hex(delta)) AS h, ((length(upper(to_hex(delta))) + 1) // 2)::BIGINT AS size FROM gaps)""", CODES, GAPS))  # fmt: skip
def delta_bytes(spark, sf_dir):
    d = layout.deltas(layout.coded(fixtures.graph(spark, sf_dir).edges))
    return d.select("rn", "delta", codec.delta_length(F.col("delta")).alias("len"), codec.delta_hex(F.col("delta")).alias("hex"))


@query(_with("SELECT DISTINCT src, dst FROM e"))
def delta_roundtrip(spark, sf_dir):
    return layout.undelta(layout.deltas(layout.coded(fixtures.graph(spark, sf_dir).edges)))


@query(_with("SELECT (c >> 32)::BIGINT AS tile, src >> 16 AS ux, dst >> 16 AS uy, count(*) AS cnt FROM e JOIN code USING (src, dst) GROUP BY ALL", CODES, times=977))
def tiles(spark, sf_dir):
    return layout.tile_counts(fixtures.graph(spark, sf_dir, times=977).edges)


@query(_with("SELECT src, dst FROM e", times=977))
def tile_roundtrip(spark, sf_dir):
    return layout.untile(layout.tiles(fixtures.graph(spark, sf_dir, times=977).edges))


@query(_with("SELECT src, dst FROM e"))
def vertex_roundtrip(spark, sf_dir):
    return layout.unadjacency(layout.adjacency(fixtures.graph(spark, sf_dir).edges))


@query(_with("SELECT src, count(*) AS cnt FROM e GROUP BY src"))
def vertex_runs(spark, sf_dir):
    return layout.vertex_runs(fixtures.graph(spark, sf_dir).edges)


@query(_with("SELECT src, run, count(*) AS cnt, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS dsts FROM o GROUP BY src, run", f"o AS (SELECT *, (row_number() OVER (ORDER BY src, dst) - 1) // {layout.RUN} AS run FROM e)"))
def adjacency(spark, sf_dir):
    """A source that lies in two runs has a row for each."""
    rows = layout.adjacency(fixtures.graph(spark, sf_dir).edges)
    return rows.withColumn("dsts", F.concat_ws(" ", F.transform("dsts", lambda x: x.cast("string"))))


def _streams(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_linenumber") % 3).alias("k"))
    return [layout.coded(rows.where(f"k = {k}")) for k in range(3)]


def _written_streams(spark, sf_dir):
    """The three streams as delta files, each sorted and without the codes it repeats."""
    paths = [_place(spark, "stream") for _ in range(3)]
    for codes, path in zip(_streams(spark, sf_dir), paths, strict=True):
        binary.write_codes(codes, path)
    return paths


PER_STREAM = "SELECT c::BIGINT AS code FROM (SELECT DISTINCT l_orderkey::BIGINT AS src, l_partkey::BIGINT AS dst, l_linenumber % 3 AS k FROM lineitem) JOIN code USING (src, dst)"


@query(_with(PER_STREAM, CODES))
def merge_all(spark, sf_dir):
    """Sorted streams merged range by range in their own order; a code of two streams comes twice."""
    return binary.merge_codes(spark, _written_streams(spark, sf_dir), least_block=1 << 14, task_bytes=1 << 16)


@query(_with("SELECT c::BIGINT AS code FROM code", CODES))
def merge_distinct(spark, sf_dir):
    return binary.merge_codes(spark, _written_streams(spark, sf_dir), distinct=True, least_block=1 << 14, task_bytes=1 << 16)


@query(_with("SELECT c::BIGINT AS code FROM e JOIN code USING (src, dst)", CODES))
def merge_by_sort(spark, sf_dir):
    """Tables of codes in any order, as one in unsigned order."""
    return layout.merge(*_streams(spark, sf_dir)).select("code")


@query(_with("SELECT c::BIGINT AS code FROM code", CODES))
def merge_distinct_by_sort(spark, sf_dir):
    return layout.merge(*_streams(spark, sf_dir), distinct=True).select("code")


CSR = "g AS (SELECT src AS node, dst AS edge, dst - lag(dst, 1, 0) OVER (PARTITION BY src ORDER BY dst) AS gap FROM (SELECT DISTINCT src, dst FROM e))"


@query(_with("SELECT node, edge, gap FROM g", CSR))
def csr_gaps(spark, sf_dir):
    return layout.csr_gaps(fixtures.graph(spark, sf_dir).edges)


@query(_with("""SELECT range AS node, sum(coalesce(size, 0)) OVER (ORDER BY range)::BIGINT AS end_byte FROM range((SELECT max(src) FROM e))
 LEFT JOIN (SELECT node, sum(greatest(1, ceil(length(ltrim(to_binary(gap), '0')) / 7.0)))::BIGINT AS size FROM g GROUP BY node) ON node = range""", CSR))  # fmt: skip
def csr_offsets(spark, sf_dir):
    return layout.csr_offsets(fixtures.graph(spark, sf_dir).edges)


@query(_with("""SELECT id, row_number() OVER (ORDER BY place) - 1 AS dense FROM (SELECT id, min(place) AS place FROM (
 SELECT src AS id, 2 * rn AS place FROM o UNION ALL SELECT dst, 2 * rn + 1 FROM o) GROUP BY id)""", "o AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS rn FROM e)"))  # fmt: skip
def dense_renumber(spark, sf_dir):
    return layout.dense_names(fixtures.graph(spark, sf_dir).edges)


RENAMED = """o AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS rn FROM e), names AS MATERIALIZED (
 SELECT id, row_number() OVER (ORDER BY place) - 1 AS dense FROM (SELECT id, min(place) AS place FROM (
 SELECT src AS id, 2 * rn AS place FROM o UNION ALL SELECT dst, 2 * rn + 1 FROM o) GROUP BY id)),
renamed AS MATERIALIZED (SELECT a.dense AS src, b.dense AS dst FROM e JOIN names a ON a.id = e.src JOIN names b ON b.id = e.dst)"""


@query(_with("SELECT src, dst FROM renamed", RENAMED))
def renamed_edges(spark, sf_dir):
    e = fixtures.graph(spark, sf_dir).edges
    return layout.renamed(e, layout.dense_names(e))


# Formats: the graph goes to files in the shared folder and comes back from them.


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/edgeflow-{name}-{uuid.uuid4().hex}"


def _through(spark, edges: DataFrame, fmt: str, **options) -> DataFrame:
    path = _place(spark, fmt)
    binary.write(edges, fmt, path, **options)
    return binary.read(spark, fmt, path)


def _span(fmt: str) -> int | None:
    """Vertex, tile and delta files hold 32 bits of an id, CSR files any."""
    return None if fmt == "csr" else fixtures.SPAN


def _round_trip(fmt: str, times: int):
    return lambda spark, sf_dir: _through(spark, fixtures.graph(spark, sf_dir, times=times, span=_span(fmt)).edges, fmt)


for _query, _fmt, _times in (("text", "text", 1), ("vertex", "vertex", 977), ("tile", "hilbert", 977), ("delta", "compressed", 977), ("csr", "csr", 977), ("parquet", "parquet", 1)):
    QUERIES[f"{_query}_file_roundtrip"] = _round_trip(_fmt, _times)
    SQL[f"{_query}_file_roundtrip"] = _with(f"SELECT {'DISTINCT ' * (_fmt in ('compressed', 'csr'))}src, dst FROM e", times=_times, span=_span(_fmt))


@query(_with("SELECT src, dst FROM e"))
def converted(spark, sf_dir):
    """Text to vertex runs to tiles."""
    paths = [_place(spark, x) for x in ("text", "vertex", "tiles")]
    binary.write(fixtures.graph(spark, sf_dir).edges, "text", paths[0])
    binary.convert(spark, ("text", paths[0]), ("vertex", paths[1]))
    binary.convert(spark, ("vertex", paths[1]), ("hilbert", paths[2]))
    return binary.read(spark, "hilbert", paths[2])


@query(_with("SELECT src, dst FROM renamed", RENAMED))
def dense_tiles(spark, sf_dir):
    """Vertex runs to tiles whose vertices are renamed by first appearance."""
    paths = [_place(spark, x) for x in ("vertex", "tiles")]
    binary.write(fixtures.graph(spark, sf_dir).edges, "vertex", paths[0])
    binary.convert(spark, ("vertex", paths[0]), ("hilbert", paths[1]), dense=True)
    return binary.read(spark, "hilbert", paths[1])


@query(_with("SELECT c::BIGINT AS code FROM code", CODES))
def merged_delta_file(spark, sf_dir):
    """Three sorted streams, which share edges, as one of distinct codes."""
    whole = _place(spark, "merged")
    binary.merge_delta(spark, _written_streams(spark, sf_dir), whole)
    return binary.read_codes(spark, whole)


@query(_with("SELECT DISTINCT src, dst FROM e", times=977))
def delta_blocks_roundtrip(spark, sf_dir):
    """Delta streams in a BINARY column."""
    return layout.undelta_blocks(layout.delta_blocks(layout.coded(fixtures.graph(spark, sf_dir, times=977).edges)))


def _by_format(layout: str, fmt: str):
    def run(spark, sf_dir):
        path = _place(spark, fmt)
        binary.write(fixtures.graph(spark, sf_dir, times=977, span=_span(fmt)).edges, fmt, path)
        datasource.register(spark)
        return spark.read.format(f"edge_{layout}").load(path)

    return run


for _layout, _fmt in (("vertex", "vertex"), ("tile", "hilbert"), ("delta", "compressed"), ("csr", "csr")):
    QUERIES[f"{_layout}_data_source"] = _by_format(_layout, _fmt)
    SQL[f"{_layout}_data_source"] = _with(f"SELECT {'DISTINCT ' * (_layout in ('delta', 'csr'))}src, dst FROM e", times=977, span=_span(_fmt))


@query(_with("SELECT dst FROM e", times=977))
def source_columns(spark, sf_dir):
    """One column of a data source, and no other, by its schema."""
    path = _place(spark, "vertex")
    binary.write(fixtures.graph(spark, sf_dir, times=977).edges, "vertex", path)
    datasource.register(spark)
    return spark.read.format("edge_vertex").schema("dst bigint").load(path)


@query(_with("SELECT src, dst FROM e", times=977))
def marked_tiles(spark, sf_dir):
    """A user's own write by format, with marks so near that each part is read by many tasks."""
    path = _place(spark, "tiles")
    datasource.register(spark)
    rows = layout.coded(fixtures.graph(spark, sf_dir, times=977).edges).withColumn("key", curve.sort_key(F.col("code")))
    ordered = rows.repartitionByRange(2, "key").sortWithinPartitions("key").select("src", "dst")
    ordered.write.format("edge_tile").option("mark_bytes", 20_000).mode("append").save(path)
    return spark.read.format("edge_tile").load(path)


@query(_with("SELECT c::BIGINT AS code FROM code", CODES, times=977))
def split_delta_file(spark, sf_dir):
    """One delta file without marks, decoded in blocks of 64 KB whose borders are found first."""
    path = _place(spark, "stream")
    binary.write_stream(layout.coded(fixtures.graph(spark, sf_dir, times=977).edges), path)
    return binary.read_codes(spark, path, block=1 << 16)


FORMATS = ("text", "vertex", "hilbert", "parquet")
REPORT = "SELECT '{fmt}' AS fmt, max(src) AS max_x, max(dst) AS max_y, count(*) AS edges FROM {table}"


@query(_with(" UNION ALL ".join([REPORT.format(fmt=f, table="e") for f in FORMATS] + [REPORT.format(fmt=f, table="d") for f in ("compressed", "csr")]), "d AS (SELECT DISTINCT src, dst FROM e)"))
def stats_by_format(spark, sf_dir):
    """The same graph read in every mode."""
    out = None
    for fmt in (*FORMATS, "compressed", "csr"):
        s = Graph(_through(spark, fixtures.graph(spark, sf_dir).edges, fmt)).stats().select(F.lit(fmt).alias("fmt"), "max_x", "max_y", "edges")
        out = s if out is None else out.union(s)
    return out


RUNS = """o AS (SELECT src, dst, row_number() OVER (ORDER BY dst, src) AS p FROM (SELECT DISTINCT src, dst FROM e)),
 r AS (SELECT src, sum(s) OVER (ORDER BY p) AS run FROM (SELECT src, p, CASE WHEN src = lag(src) OVER (ORDER BY p) THEN 0 ELSE 1 END AS s FROM o))"""


@query(_with("SELECT run::BIGINT AS run, src, count(*) AS cnt FROM r GROUP BY run, src", RUNS, name="g3"))
def runs_by_position(spark, sf_dir):
    """Runs of equal sources in a file that is sorted by target."""
    e = fixtures.graph(spark, sf_dir, "g3").edges.distinct().withColumn("p", (F.col("dst") * (1 << 32)) + F.col("src"))
    return layout.runs_in_order(e, "p").select("run", "src", "cnt")


@query(_with("SELECT rn, tile, low FROM (SELECT row_number() OVER (ORDER BY c) AS rn, (c >> 32)::BIGINT AS tile, (c & 4294967295)::BIGINT AS low FROM e JOIN code USING (src, dst))", CODES, times=977))
def tile_order(spark, sf_dir):
    """The order in which the tile writer leaves edges: by tile, then inside it."""
    rows = layout.curve_order(fixtures.graph(spark, sf_dir, times=977).edges)
    return rows.select("rn", F.shiftrightunsigned("code", 32).alias("tile"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).alias("low"))


@query(_with("SELECT dst AS id, sum(src * 2 + 1)::BIGINT AS m FROM e GROUP BY dst"))
def message_sums(spark, sf_dir):
    """A message along every edge, made of the sender's state and summed at the receiver."""
    g = fixtures.graph(spark, sf_dir)
    return g.aggregate_messages(g.vertices().withColumn("x", F.col("id") * 2), F.col("x") + 1, F.sum)


HEAD = 20


@query(_with(f"SELECT id, count(*) % 2 = 1 AS odd, count(*) AS deg FROM (SELECT src AS id FROM sym) WHERE id < {HEAD} GROUP BY id", SYM))
def folded_degrees(spark, sf_dir):
    """A state that is no aggregate of Spark's: an array that every edge changes at both ends."""

    def step(state, src, dst):
        for ends in (src, dst):
            state += np.bincount(ends[ends < HEAD], minlength=HEAD)
        return state

    def finish(state):
        at = np.flatnonzero(state)
        return {"id": at, "odd": state[at] % 2 == 1, "deg": state[at]}

    return fixtures.graph(spark, sf_dir).fold_edges(lambda: np.zeros(HEAD, np.int64), step, np.add, finish, "id long, odd boolean, deg long")


@query(_with("SELECT src, dst FROM (SELECT DISTINCT src, dst FROM e) ORDER BY (src * 7919 + dst * 104729) % 1000003 DESC, src, dst LIMIT 25"))
def folded_top_edges(spark, sf_dir):
    """A bounded heap over all edges."""

    def best(state, src, dst):
        rows = np.unique(np.concatenate([state, np.stack([-((src * 7919 + dst * 104729) % 1000003), src, dst], axis=1)]), axis=0)
        return rows[:25]

    merge = lambda a, b: best(a, b[:, 1], b[:, 2])
    return fixtures.graph(spark, sf_dir).fold_edges(lambda: np.zeros((0, 3), np.int64), best, merge, lambda s: {"src": s[:, 1], "dst": s[:, 2]}, "src long, dst long")


@query(_with("SELECT c::BIGINT AS code FROM code", CODES))
def merge_framed(spark, sf_dir):
    """Sorted streams in LZ4 frames, merged from their frames."""
    paths = _written_streams(spark, sf_dir)
    for path in paths:
        files.compress(spark, path, f"{path}-lz4", 1 << 14)
    return binary.merge_codes(spark, [f"{p}-lz4" for p in paths], distinct=True, least_block=1 << 12, task_bytes=1 << 16)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
