import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgeflow.functions import codec
from edgeflow.operators import components, frontier, joins, layout
from edgeflow.operators import graph as graph_module
from edgeflow.operators.graph import Graph
from edgeflow.plans import catalogue, fixtures
from edgeflow.sources import binary, datasource, files, text
from edgeflow.streaming import ingest

M1 = ["# c", "0 1", "0 1", "1 2", "2 2", "3 4", "4 3", "6 0"]
SF = "/root/testdata/sf0.001"


def graph(spark, pairs, n=None):
    return Graph(spark.createDataFrame(pairs, "src long, dst long"), n)


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


@pytest.fixture(scope="module")
def m1(spark):
    return Graph(text.parse_lines(lines(spark, M1)), 8)


def table(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_small_graph(m1):
    assert table(m1.stats(), "max_x", "max_y", "edges", "nodes") == [(6, 4, 7, 7)]
    assert table(layout.vertex_runs(m1.edges), "src", "cnt") == [(0, 2), (1, 1), (2, 1), (3, 1), (4, 1), (6, 1)]
    for method in ("union", "star", "minlabel"):
        assert dict(table(m1.components(method), "id", "comp")) == {0: 0, 1: 0, 2: 0, 6: 0, 3: 3, 4: 3, 5: 5, 7: 7}
    assert dict(table(m1.bfs(), "id", "dist")[0:0] or [tuple(r) for r in m1.bfs().collect()]) == {0: 0, 1: 1, 6: 1, 2: 2, 3: None, 4: None, 5: None, 7: None}
    want = [0.2775, 0.385875, 3.031587, 0.96124, 0.96124, 0.15, 0.15, 0.15]
    assert [r["rank"] for r in m1.pagerank().orderBy("id").collect()] == pytest.approx(want, abs=1e-6)
    assert [r["code"] for r in layout.merge(layout.coded(m1.edges), distinct=True).collect()] == [3, 7, 8, 20, 31, 53]


def test_self_loop_at_the_root(spark):
    g = Graph(text.parse_lines(lines(spark, [*M1, "0 0"])), 8)
    assert dict(tuple(r) for r in g.bfs().collect())[0] == 0
    with pytest.raises(Exception, match="delta coded"):
        layout.deltas(layout.coded(g.edges)).collect()


@pytest.mark.parametrize("bad", ["", "1", "a b", "-1 2", "4294967296 0", " # x"])
def test_bad_lines_raise(spark, bad):
    with pytest.raises(Exception, match="not an edge"):
        text.parse_lines(lines(spark, [bad])).collect()


def test_good_lines(spark):
    assert table(text.parse_lines(lines(spark, ["1 2 extra", "\t+3\t4", "# no"])), "src", "dst") == [(1, 2), (3, 4)]


def test_empty_graph(spark):
    g = graph(spark, [], 3)
    assert table(g.stats(), "max_x", "max_y", "edges", "nodes") == [(0, 0, 0, 1)]
    assert table(g.components(), "id", "comp") == [(0, 0), (1, 1), (2, 2)]
    assert [r["rank"] for r in g.pagerank().collect()] == pytest.approx([0.15] * 3)


def test_ids_out_of_range_raise(spark):
    with pytest.raises(Exception, match="outside the graph"):
        graph(spark, [(0, 9)], 5).validated().pagerank().collect()


def test_runs_keep_file_order(spark):
    rows = spark.createDataFrame([(0, 5, 1), (1, 3, 2), (2, 5, 4)], "p long, src long, dst long")
    assert [tuple(r) for r in layout.runs_in_order(rows, "p").orderBy("run").select("src", "cnt").collect()] == [(5, 1), (3, 1), (5, 1)]


def test_dense_names(spark):
    # Traversal order is (src, dst): 7->3, 10->7, 10->10.
    g = graph(spark, [(10, 7), (10, 10), (7, 3)])
    names = layout.dense_names(g.edges)
    assert dict(table(names, "id", "dense")) == {7: 0, 3: 1, 10: 2}
    assert table(layout.renamed(g.edges, names), "src", "dst") == [(0, 1), (2, 0), (2, 2)]


def test_csr(spark, tmp_path):
    g = graph(spark, [(0, 5), (0, 300), (2, 1), (0, 5)])
    binary.write_csr(g.edges.coalesce(1), str(tmp_path / "c"))
    names = sorted(p.name for p in (tmp_path / "c").iterdir() if p.suffix in (".offsets", ".payload"))
    payload = b"".join((tmp_path / "c" / n).read_bytes() for n in names if n.endswith(".payload"))
    assert payload.hex() == "05a70201"
    assert table(layout.csr_offsets(g.edges), "node", "end_byte") == [(0, 3), (1, 3)]
    assert table(binary.read(spark, "csr", str(tmp_path / "c")), "src", "dst") == [(0, 5), (0, 300), (2, 1)]
    # One pair without a first node in its name: entry k ends node k, the last node has none.
    (tmp_path / "x.payload").write_bytes(bytes.fromhex("05a70201"))
    (tmp_path / "x.offsets").write_bytes(np.array([3, 3], "<u8").tobytes())
    assert table(binary.read_csr(spark, str(tmp_path / "x")), "src", "dst") == [(0, 5), (0, 300), (2, 1)]


@pytest.mark.parametrize("times", [1, 286331])
def test_formats_agree(spark, tmp_path, times):
    e = fixtures.graph(spark, SF, times=times).edges
    want = table(e, "src", "dst")
    for fmt in binary.WRITERS:
        binary.write(e, fmt, str(tmp_path / fmt))
        got = table(binary.read(spark, fmt, str(tmp_path / fmt)), "src", "dst")
        assert got == (sorted(set(want)) if fmt in ("compressed", "csr") else want), fmt
    assert table(layout.undelta(layout.deltas(layout.coded(e))), "src", "dst") == sorted(set(want))
    for f in (binary.read, binary.write):
        with pytest.raises(ValueError, match="unknown format"):
            f(spark, "other", "x")


def test_small_chunks(spark, tmp_path, monkeypatch):
    """Heads in chunks of two records and bodies three edges at a time give the same edges."""
    e = fixtures.graph(spark, SF, "g3").edges.union(spark.range(50).selectExpr("7L AS src", "id AS dst"))
    want = table(e, "src", "dst")
    for fmt in ("vertex", "hilbert", "csr"):
        binary.write(e, fmt, str(tmp_path / fmt))
        with monkeypatch.context() as m:
            m.setattr(binary, "CHUNK", 2)
            m.setattr(binary, "BATCH", 3)
            got = table(binary.read(spark, fmt, str(tmp_path / fmt)), "src", "dst")
        assert got == (sorted(set(want)) if fmt == "csr" else want), fmt


@pytest.mark.parametrize("fmt,suffix", [("vertex", ".edges"), ("vertex", ".nodes"), ("hilbert", ".lower"), ("csr", ".payload")])
def test_a_lost_file_raises(spark, tmp_path, fmt, suffix):
    binary.write(graph(spark, [(1, 2), (3, 4)]).edges, fmt, str(tmp_path / "g"))
    next(p for p in (tmp_path / "g").iterdir() if p.name.endswith(suffix) and not p.name.startswith(".")).unlink()
    with pytest.raises(FileNotFoundError, match="only one of"):
        binary.read(spark, fmt, str(tmp_path / "g"))


def test_a_short_file_raises(spark, tmp_path):
    (tmp_path / "g.nodes").write_bytes(np.array([(1, 3)], binary.NODES).tobytes())
    (tmp_path / "g.edges").write_bytes(np.array([5, 6], "<u4").tobytes())
    with pytest.raises(Exception, match="ends before its last run"):
        binary.read_vertex(spark, str(tmp_path / "g")).collect()
    (tmp_path / "g.edges").write_bytes(np.array([5, 6, 7], "<u4").tobytes())
    assert table(binary.read_vertex(spark, str(tmp_path / "g")), "src", "dst") == [(1, 5), (1, 6), (1, 7)]


def test_missing_paths_raise(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/other.txt").write_text("x")
    for fmt in ("vertex", "hilbert", "csr", "compressed"):
        for path in ("nothing", "d"):
            with pytest.raises(FileNotFoundError):
                binary.read(spark, fmt, str(tmp_path / path))


def test_delta_streams(spark, tmp_path):
    """A stream at its literal path; a code that does not increase, and an end inside a value."""
    codes = [3, 7, 8, 20, 31, 53]
    data = codec.delta_encode(np.diff(np.array(codes, np.uint64), prepend=np.uint64(0)))
    (tmp_path / "stream").write_bytes(data)
    assert sorted(r["code"] for r in binary.read_codes(spark, str(tmp_path / "stream")).collect()) == codes
    assert table(binary.read(spark, "compressed", str(tmp_path / "stream")), "src", "dst") == table(layout.points(spark.createDataFrame([(c,) for c in codes], "code long")), "src", "dst")
    (tmp_path / "stream").write_bytes(data + b"\0\1")
    with pytest.raises(Exception, match="ends inside a value"):
        binary.read_codes(spark, str(tmp_path / "stream")).collect()
    huge = codec.delta_encode(np.array([5, 2**64 - 3], np.uint64))  # comes to 2 after 5
    (tmp_path / "stream").write_bytes(huge)
    with pytest.raises(Exception, match="do not increase"):
        binary.read_codes(spark, str(tmp_path / "stream")).collect()
    assert [r["code"] for r in binary.read_codes(spark, str(tmp_path / "stream"), strict=False).collect()] == [5, 2]
    with pytest.raises(Exception, match="cannot be delta coded"):
        binary.write_delta(graph(spark, [(0, 0)]).edges, str(tmp_path / "z"))


def test_writers_leave_no_earlier_part(spark, tmp_path):
    for fmt in ("vertex", "hilbert", "compressed", "csr", "text"):
        path = str(tmp_path / fmt)
        binary.write(fixtures.graph(spark, SF).edges, fmt, path)
        with pytest.raises(Exception, match="(?i)exists"):
            binary.write(graph(spark, [(1, 2)]).edges, fmt, path)
        binary.write(graph(spark, [(1, 2)]).edges, fmt, path, overwrite=True)
        assert table(binary.read(spark, fmt, path), "src", "dst") == [(1, 2)]
        if fmt != "text":
            binary.write(graph(spark, []).edges, fmt, path, overwrite=True)
            assert binary.read(spark, fmt, path).count() == 0


def test_an_uncommitted_folder_does_not_read(spark, tmp_path):
    """One task of four fails: nothing is left to read.  A driver that goes before it commits leaves a folder that raises."""
    datasource.register(spark)
    rows = spark.range(0, 1000, 1, 4).selectExpr("IF(id = 900, raise_error('lost'), id) AS src", "id + 1 AS dst")
    rows = rows.selectExpr("cast(src AS bigint) AS src", "dst")
    for fmt in ("vertex", "tile", "csr"):
        with pytest.raises(Exception, match="lost"):
            rows.write.format(f"edge_{fmt}").mode("append").save(str(tmp_path / fmt))
        with pytest.raises(FileNotFoundError):
            binary.read(spark, {"tile": "hilbert"}.get(fmt, fmt), str(tmp_path / fmt)).count()
    binary.write(graph(spark, [(1, 2), (3, 4)]).edges, "vertex", str(tmp_path / "v"))
    (tmp_path / "v" / files.UNCOMMITTED).touch()
    for read in (lambda: binary.read(spark, "vertex", str(tmp_path / "v")), lambda: spark.read.format("edge_vertex").load(str(tmp_path / "v"))):
        with pytest.raises(Exception, match="did not commit"):
            read().count()
    (tmp_path / "v" / files.UNCOMMITTED).unlink()
    (tmp_path / "v" / "part-00009-x.nodes").write_bytes(b"left by a task that failed")
    assert table(binary.read(spark, "vertex", str(tmp_path / "v")), "src", "dst") == [(1, 2), (3, 4)]
    assert table(spark.read.format("edge_vertex").load(str(tmp_path / "v")), "src", "dst") == [(1, 2), (3, 4)]
    for p in (tmp_path / "v").glob("part-*.edges"):
        p.write_bytes(p.read_bytes()[:-1])
    with pytest.raises(Exception, match="as it was written"):
        binary.read(spark, "vertex", str(tmp_path / "v"))


def test_data_sources(spark, tmp_path):
    """Marks split a part, schemas choose columns, files from elsewhere are read as they are."""
    e = fixtures.graph(spark, SF, "g3", times=9_999_991).edges
    want = table(e, "src", "dst")
    datasource.register(spark)
    ordered = e.coalesce(1).sortWithinPartitions("src", "dst")
    ordered.write.format("edge_vertex").option("mark_bytes", 100).mode("append").save(str(tmp_path / "v"))
    got = spark.read.format("edge_vertex").load(str(tmp_path / "v"))
    assert table(got, "src", "dst") == want and table(got.select("dst"), "dst") == sorted((d,) for _, d in want)
    binary.write_codes(layout.coded(e), str(tmp_path / "d"), parts=1)
    codes = spark.read.format("edge_delta").schema("code bigint").load(str(tmp_path / "d"))
    assert table(codes, "code") == table(layout.coded(e).select("code").distinct(), "code")
    one = next((tmp_path / "d").glob("*.delta"))
    one.rename(tmp_path / "stream")
    assert table(spark.read.format("edge_delta").load(str(tmp_path / "stream")), "src", "dst") == sorted(set(want))
    with pytest.raises(Exception, match="columns are"):
        spark.read.format("edge_vertex").schema("dst string").load(str(tmp_path / "v")).count()


@pytest.mark.parametrize("block", [1, 5, 64, 1000])
def test_split_delta_streams(spark, tmp_path, block):
    """Blocks that cut values, and runs of zeros, anywhere give the codes of the whole stream."""
    r = np.random.default_rng(block)
    gaps = np.concatenate([r.integers(1, 1 << k, 40, dtype=np.uint64) << np.uint64(s) for k, s in ((8, 0), (16, 0), (8, 16), (20, 24), (50, 0))])
    r.shuffle(gaps)
    gaps = gaps[: 12 if block < 5 else len(gaps)]
    codes = np.cumsum(gaps, dtype=np.uint64)
    (tmp_path / "s").write_bytes(codec.delta_encode(gaps))
    got = binary.read_codes(spark, str(tmp_path / "s"), block=block)
    assert table(got, "code") == sorted((int(c),) for c in codes.view(np.int64))
    (tmp_path / "s").write_bytes(codec.delta_encode(gaps) + b"\0\0")
    with pytest.raises(Exception, match="ends inside a value"):
        binary.read_codes(spark, str(tmp_path / "s"), block=block).count()


@pytest.mark.parametrize("block,task", [(3, 10), (64, 200), (1 << 20, 1 << 20)])
def test_merge_of_streams(spark, tmp_path, block, task):
    """Streams that share codes, one empty, one past 2^63: in order over all partitions, and each code once if asked."""
    r = np.random.default_rng(3)
    every = [np.unique(r.integers(1, 1 << k, n, dtype=np.uint64)) for k, n in ((12, 200), (12, 150), (63, 40), (2, 1))]
    every[2] = np.concatenate([every[2], np.array([1 << 63, (1 << 64) - 1], np.uint64)])
    paths = [str(tmp_path / f"s{i}") for i in range(5)]
    for path, codes in zip(paths, [*every, np.zeros(0, np.uint64)], strict=True):
        (tmp_path / path.rpartition("/")[2]).write_bytes(codec.delta_encode(np.diff(codes, prepend=np.uint64(0))))
    want = np.sort(np.concatenate(every))
    got = binary.merge_codes(spark, paths, least_block=block, task_bytes=task)
    assert [r["code"] & (1 << 64) - 1 for r in got.collect()] == want.tolist()
    got = binary.merge_codes(spark, paths, distinct=True, least_block=block, task_bytes=task)
    assert [r["code"] & (1 << 64) - 1 for r in got.collect()] == np.unique(want).tolist()
    (tmp_path / "s4").write_bytes(codec.delta_encode(np.array([5, 2**64 - 3], np.uint64)))
    with pytest.raises(Exception, match="do not increase"):
        binary.merge_codes(spark, paths, least_block=1 << 20).collect()


@pytest.mark.parametrize("frame,block", [(7, 1), (100, 300), (1 << 20, 1 << 20)])
def test_lz4_frames(spark, tmp_path, frame, block):
    """Frames that cut values, frames to skip, one frame in all; what is no frame raises."""
    import struct

    gaps = np.random.default_rng(5).integers(1, 1 << 26, 60, dtype=np.uint64) << np.uint64(8)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.delta").write_bytes(codec.delta_encode(gaps))
    files.compress(spark, str(tmp_path / "a"), str(tmp_path / "b"), frame)
    packed = tmp_path / "b/x.delta.lz4"
    packed.write_bytes(struct.pack("<II", files.LZ4_SKIPPED, 3) + b"abc" + packed.read_bytes())
    want = sorted((int(c),) for c in np.cumsum(gaps))
    assert table(binary.read_codes(spark, str(tmp_path / "b"), block=block), "code") == want
    assert table(binary.read_codes(spark, str(packed), block=block), "code") == want
    assert len(files.frames(str(packed))) == -(-len(codec.delta_encode(gaps)) // frame)
    packed.write_bytes(packed.read_bytes()[:-9])
    with pytest.raises(Exception, match="ends inside|no LZ4 frame"):
        binary.read_codes(spark, str(packed)).count()


def test_folds(spark):
    """States of tasks, many and one, of no edges too."""
    pairs = [(i % 7, i) for i in range(100)]
    for parts in (1, 40):
        g = Graph(graph(spark, pairs).edges.repartition(parts))
        got = g.fold_edges(set, lambda s, a, b: s | set(zip(a.tolist(), b.tolist(), strict=True)), set.union, lambda s: {"n": [len(s)]}, "n long")
        assert got.first()["n"] == 100
    assert graph(spark, []).fold_edges(set, lambda s, a, b: s, set.union, lambda s: {"n": [len(s)]}, "n long").first()["n"] == 0


def test_csr_of_far_ids(spark, tmp_path):
    """A hub, and ids far apart: entries of the nodes between are written in pieces."""
    pairs = [(5, i * 3) for i in range(20_000)] + [(3_000_000, 1), (3_000_000, 1 << 31)]
    binary.write(graph(spark, pairs).edges.coalesce(1), "csr", str(tmp_path / "c"))
    assert table(binary.read(spark, "csr", str(tmp_path / "c")), "src", "dst") == sorted(pairs)


def test_runs_of_an_unsorted_file(spark, tmp_path):
    rows = spark.createDataFrame([(0, 5, 1), (1, 3, 2), (2, 5, 4)], "p long, src long, dst long")
    binary.write_runs(rows.coalesce(1), "p", str(tmp_path / "r"))
    heads = b"".join(p.read_bytes() for p in sorted((tmp_path / "r").glob("part-*.nodes")))
    assert np.frombuffer(heads, binary.NODES)["src"].tolist() == [5, 3, 5]
    assert table(binary.read_vertex(spark, str(tmp_path / "r")), "src", "dst") == [(3, 2), (5, 1), (5, 4)]


def test_hubs(spark):
    """A source with most edges is dealt over several keys and rows, with the same results."""
    pairs = [(0, i) for i in range(1, 200)] + [(i, 0) for i in range(1, 50)] + [(3, 4), (4, 5)]
    g = graph(spark, pairs, 200)
    plain, salted = (dict(tuple(r) for r in g.pagerank(heavy_from=h).collect()) for h in (10**6, 20))
    assert plain == pytest.approx(salted)
    runs = layout.adjacency(g.edges, longest=16).collect()
    assert max(r["cnt"] for r in runs) <= 16 and sorted((r["src"], d) for r in runs for d in r["dsts"]) == sorted(pairs)
    rows = layout.tiles(g.edges, longest=16)
    assert rows.agg(F.max("cnt")).first()[0] <= 16 and table(layout.untile(rows), "src", "dst") == sorted(pairs)


def test_long_searches(spark, monkeypatch):
    """A path longer than the tables that are kept apart."""
    monkeypatch.setattr(graph_module, "TABLES", 3)
    n = 30
    g = graph(spark, [(i, i + 1) for i in range(n)] + [(40, 41)], 42)
    assert dict(tuple(r) for r in g.bfs().collect()) == {i: i if i <= n else None for i in range(42)}


def test_long_searches_take_few_jobs(spark, monkeypatch):
    """A path's levels past the first few are found by one task, not by a job each."""
    asked, look = [], frontier.Blocks.next
    monkeypatch.setattr(frontier.Blocks, "next", lambda self, *x: asked.append(1) or look(self, *x))
    g = graph(spark, [(i, i + 1) for i in range(40)] + [(50, 51)], 52)
    assert dict(tuple(r) for r in g.bfs().collect()) == {i: i if i <= 40 else None for i in range(52)}
    assert len(asked) <= 8


@pytest.mark.parametrize("block,most", [(20, 1 << 16), (20, 2), (150, 1 << 16), (150, 3)])
def test_long_searches_peel_leaves(spark, monkeypatch, block, most):
    """Trees, rings and pairs, reached or not, whose leaves are peeled off until a block holds the rest or few are left: the levels of a plain search."""
    monkeypatch.setattr(frontier, "LONG", 2)
    monkeypatch.setattr(frontier, "BLOCK_EDGES", block)
    monkeypatch.setattr(frontier, "FRONTIER", most)
    monkeypatch.setattr(graph_module, "TABLES", 2)
    turns, peel = [], graph_module._peeled
    monkeypatch.setattr(graph_module, "_peeled", lambda *x: turns.append(peel(*x)) or turns[0])
    ring = [(i, (i + 1) % 14) for i in range(14)]
    trees = [(20 + i, i % 14) for i in range(30)] + [(50 + i, 20 + i) for i in range(20)] + [(70 + i, 50 + i // 2) for i in range(20)]
    apart = [(100 + i, 100 + (i + 1) % 5) for i in range(5)] + [(110 + i, 100 + i % 5) for i in range(9)] + [(120, 121), (130, 131), (131, 132), (133, 133)]
    pairs = ring + trees + apart
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist, now = {0: 0}, [0]
    while now:
        now = [x for x in {y for v in now for y in near[v]} if x not in dist and not dist.update({x: dist[now[0]] + 1})]
    got = graph(spark, pairs, 140).bfs().collect()
    assert len(got) == 140 and {r["id"]: r["dist"] for r in got} == {i: dist.get(i) for i in range(140)}
    assert turns[0][2] and turns[0][1] < 2 * len(pairs)


@pytest.mark.parametrize("most,tell", [(3, 1), (4, 10), (1 << 16, 2)])
def test_searches_by_blocks_and_joins(spark, monkeypatch, most, tell):
    """Frontiers that grow past what blocks send, fall under it again, and hubs: the levels of a plain search."""
    monkeypatch.setattr(frontier, "FRONTIER", most)
    monkeypatch.setattr(frontier, "TELL", tell)
    monkeypatch.setattr(frontier, "LEAST_EDGES", 8)
    monkeypatch.setattr(frontier, "PENDING", 5)
    monkeypatch.setattr(graph_module, "TABLES", 2)
    pairs = [(i, i + 1) for i in range(12)] + [(5, 100 + i) for i in range(30)] + [(100 + i, 200) for i in range(30)] + [(200 + i, 201 + i) for i in range(9)] + [(300, 301)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist, now = {0: 0}, [0]
    while now:
        now = [x for x in {y for v in now for y in near[v]} if x not in dist and not dist.update({x: dist[now[0]] + 1})]
    got = {r["id"]: r["dist"] for r in graph(spark, pairs, 310).bfs().collect()}
    assert got == {i: dist.get(i) for i in range(310)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60), st.integers(1, 20))
def test_forest(pairs, size):
    """Sets of vertices joined a few edges at a time; at most a link for each vertex that is no root."""
    f, comp = components.Forest(), {}
    for i in range(0, len(pairs), size):
        f.join(*np.array(pairs[i : i + size], np.int64).T)
    for a, b in pairs * len(pairs):
        low = min(comp.get(a, a), comp.get(b, b))
        comp[a] = comp[b] = low
    links = f.links().to_pydict()
    assert dict(zip(links["src"], links["dst"], strict=True)) == {v: c for v, c in comp.items() if v != c}


def test_forests_send_less(spark, monkeypatch):
    """A task sends a link for each vertex at most, however many edges it reads, and bounded forests tie the same."""
    e = fixtures.graph(spark, SF, "g3").edges.coalesce(1)
    many = e.union(e).union(e).coalesce(1)
    assert components.local_forests(many).count() < min(e.count(), many.selectExpr("explode(array(src, dst)) AS id").distinct().count())
    want = table(components.star_contraction(e), "id", "comp")
    monkeypatch.setattr(components, "HELD", 20)
    monkeypatch.setattr(components, "AT_ONCE", 16)
    assert table(components.union_find(e), "id", "comp") == want


def test_component_tasks_grow_with_links(spark, monkeypatch):
    """Rounds over more links have more partitions, and smaller reads, in place of larger ones; then the session has its own again."""
    e = fixtures.graph(spark, SF, "g3").edges
    want = table(components.union_find(e), "id", "comp")
    key, seen, saved = "spark.sql.shuffle.partitions", [], components.Saved

    def spy(df, *args, **options):
        seen.append((int(spark.conf.get(key)), spark.conf.get("spark.sql.files.maxPartitionBytes")))
        return saved(df, *args, **options)

    own = spark.conf.get(key), spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(components, "Saved", spy)
    monkeypatch.setattr(joins, "SHARE", 32)
    assert table(components.union_find(e), "id", "comp") == want
    assert max(n for n, _ in seen) > int(own[0]) and {size for n, size in seen if n > int(own[0])} == {str(joins.READ)}
    assert (spark.conf.get(key), spark.conf.get("spark.sql.files.maxPartitionBytes")) == own
    assert [joins._bytes(x) for x in ("8m", "134217728b", "1G", "512")] == [8 << 20, 1 << 27, 1 << 30, 512]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=20))
def test_properties(spark, pairs):
    g = graph(spark, pairs, 12)
    comp = {i: i for i in range(12)}
    for _ in range(12):
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert dict(table(g.components(), "id", "comp")) == comp
    assert dict(table(g.components("minlabel"), "id", "comp")) == comp
    assert dict(table(g.components("star"), "id", "comp")) == comp
    dist = dict(tuple(r) for r in g.bfs().collect())
    assert {i for i, d in dist.items() if d is not None} == {i for i, c in comp.items() if c == comp[0] and comp[0] == 0}
    for a, b in pairs:
        assert (dist[a] is None) == (dist[b] is None) and (dist[a] is None or abs(dist[a] - dist[b]) <= 1)
    rank = [r["rank"] for r in g.pagerank(iterations=4).collect()]
    assert min(rank) >= 0.15 - 1e-12 and sum(rank) <= 12 + 1e-9


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(M1))
    for name, f in (("stats", ingest.running_stats), ("degrees", ingest.running_degrees)):
        q = f(ingest.text_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("complete")
        q.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert table(spark.table("stats"), "max_x", "max_y", "edges", "nodes") == [(6, 4, 7, 7)]
    assert table(spark.table("degrees"), "id", "deg") == [(0, 2), (1, 1), (2, 1), (3, 1), (4, 1), (6, 1)]


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    cur = con.execute(catalogue.SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(map(tuple, cur.fetchall()), key=key)


def test_ids_over_32_bits_raise(spark, tmp_path):
    """The files hold 32 bits of an id: a wider one raises in place of losing its upper bits."""
    g = graph(spark, [(1, 2), (1 << 32, 3)])
    for fmt in ("vertex", "hilbert", "compressed"):
        with pytest.raises(Exception, match="over 32 bits"):
            binary.write(g.edges, fmt, str(tmp_path / fmt))


def test_spread_graphs_keep_to_32_bits(spark, tmp_path):
    """Keys that 977 times over pass 2^32 come back from every format as the SQL has them."""
    rows = spark.createDataFrame([(4_396_042 + i, i % 7, 1) for i in range(20)], "l_orderkey long, l_partkey long, l_linenumber long")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(9_000_000).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'; CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    names = ("vertex_file_roundtrip", "tile_file_roundtrip", "delta_file_roundtrip", "delta_blocks_roundtrip", "vertex_data_source", "tile_data_source", "delta_data_source", "marked_tiles")
    for name in names:
        want = sorted(con.execute(catalogue.SQL[name]).fetchall())
        assert len(want) == 20 and max(x for x, _ in want) < 1 << 32
        assert table(catalogue.QUERIES[name](spark, str(tmp_path)), "src", "dst") == want, name


def test_csr_heads_do_not_grow_with_the_span_of_ids(spark, tmp_path):
    """Nodes far apart: the heads hold a record a node that has edges, in place of eight bytes for every id between."""
    datasource.register(spark)
    pairs = [(i * 40_000_000, i * j) for i in range(100) for j in (1, 5)]
    near = [(i, i + k) for i in range(60_000) for k in (1, 2)]
    hub = [(59_999, 70_000 + i) for i in range(30_000)]
    for name, rows in (("far", pairs), ("mixed", near + hub + [(1_000_000 + 50 * i, i) for i in range(30_000)])):
        path = str(tmp_path / name)
        binary.write(graph(spark, rows).edges.coalesce(1), "csr", path)
        heads = [p for p in (tmp_path / name).iterdir() if p.suffix in binary.CSR_HEADS]
        assert sum(p.stat().st_size for p in heads) < 4_000_000
        assert {p.suffix for p in heads} >= ({".ends"} if name == "far" else set(binary.CSR_HEADS))
        assert table(binary.read(spark, "csr", path), "src", "dst") == sorted(set(rows))
        assert table(spark.read.format("edge_csr").load(path), "src", "dst") == sorted(set(rows))


def test_uncounted_tables_are_not_broadcast(spark, tmp_path):
    """Tables whose size Spark guesses from compressed files or Arrow functions do not go through the driver whole."""
    g = fixtures.graph(spark, SF)
    binary.write(g.edges, "vertex", str(tmp_path / "v"))
    read = binary.read(spark, "vertex", str(tmp_path / "v"))
    names = layout.dense_names(read)
    for df in (layout.renamed(read, names), g.label_propagation()):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        sides = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "part#" not in line]
        assert "SortMergeJoin" in plan and not sides, sides


def test_labels_of_a_hub(spark, monkeypatch):
    """Keys that many rows share are told to the tasks, and end at the same labels."""
    from edgeflow.operators import joins

    monkeypatch.setattr(joins, "HUB", 8)
    pairs = [(i, i + 1) for i in range(300)] + [(500, 400 + i) for i in range(60)]
    want = dict(table(graph(spark, pairs, 600).components("star"), "id", "comp"))
    assert dict(table(graph(spark, pairs, 600).label_propagation(), "id", "label")) == want
    assert want[300] == 0 and want[500] == 400 and want[301] == 301


def test_hubs_of_components_are_told(spark, monkeypatch):
    """The least id of a large component is no key of one task's join."""
    from edgeflow.operators import joins

    monkeypatch.setattr(joins, "HUB", 8)
    heavy, plain = [], components.looked_up

    def spied(df, table, key, hubs):
        heavy.append(hubs.count())
        return plain(df, table, key, hubs)

    monkeypatch.setattr(components, "looked_up", spied)
    pairs = [(0, i) for i in range(1, 80)] + [(200, 100 + i) for i in range(50)] + [(300, 301)]
    want = {i: 0 for i in range(80)} | {i: 100 for i in (*range(100, 150), 200)} | {300: 300, 301: 300}
    assert dict(table(components.star_contraction(graph(spark, pairs).edges), "id", "comp")) == want
    assert max(heavy) >= 1


def test_one_stream_of_many_ranges(spark, tmp_path):
    """A single file is strung together from ranges: the bytes that one writer of all codes would leave."""
    codes = [3, 7, 8, 20, 31, 53, 1 << 40, (1 << 63) + 9, (1 << 64) - 2]
    want = codec.delta_encode(np.diff(np.array(codes, np.uint64), prepend=np.uint64(0)))
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(c,) for c in [*signed, signed[2]]], "code long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        binary.write_stream(rows, f"file://{tmp_path}/s")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (tmp_path / "s").read_bytes() == want
    assert not (tmp_path / "s-parts").exists()
    binary.write_stream(rows.where("false"), f"file://{tmp_path}/none")
    assert (tmp_path / "none").read_bytes() == b""


def test_blocks_of_a_search_stay_small():
    """Four tasks of an executor pack their blocks, in some six copies of 16 bytes an edge, well within 4,000 MB."""
    assert 4 * 6 * 16 * frontier.BLOCK_EDGES < 1 << 30


def test_vertices_are_dealt_by_shares(spark, monkeypatch):
    """The last join of labels to all vertices has more tasks where there are more vertices, and the same result."""
    monkeypatch.setattr(graph_module, "SHARE", 10)
    state = spark.createDataFrame([(i, i % 7) for i in range(0, 200, 3)], "id long, label long")
    got = Graph(spark.createDataFrame([(0, 199)], "src long, dst long"), 200).everywhere(state, label=F.col("id"))
    assert got.rdd.getNumPartitions() == 20
    assert dict(table(got, "id", "label")) == {i: i if i % 3 else i % 7 for i in range(200)}


@pytest.mark.parametrize("name", ["csr_file_roundtrip", "csr_data_source"])
def test_csr_holds_ids_of_any_width(spark, tmp_path, name):
    """CSR files are not bound to 32 bits, so neither the query nor its SQL cuts an id."""
    keys = [4_396_042 + i for i in range(20)] + [9_000_000_000 + 7 * i for i in range(20)] + [1, 2]
    rows = spark.createDataFrame([(k, p, 1) for i, k in enumerate(keys) for p in (i % 7, k + i)], "l_orderkey long, l_partkey long, l_linenumber long")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(10).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'; CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted((977 * k, 977 * p) for i, k in enumerate(keys) for p in (i % 7, k + i))
    assert sorted(con.execute(catalogue.SQL[name]).fetchall()) == want
    assert table(catalogue.QUERIES[name](spark, str(tmp_path)), "src", "dst") == want
