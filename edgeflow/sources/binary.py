"""Binary edge files, little-endian and packed.

==========  ==========================================  ===================================
format      head file                                   body file
==========  ==========================================  ===================================
vertex      ``.nodes``: u32 source, u32 count           ``.edges``: u32 target
tile        ``.upper``: u16 x, u16 y, u32 count         ``.lower``: u16 x, u16 y
csr         ``.offsets``: u64 end byte of each node     ``.payload``: LEB128 gaps
            but the last; or, where few nodes have
            edges, ``.ends``: u64 end byte, u64
            successive nodes that end there
delta       none                                        coded gaps between sorted codes
==========  ==========================================  ===================================

A reader takes one pair of files by its prefix or a folder of pairs; a writer leaves one pair
per partition of a range-partitioned graph, and commits them together (see ``files``).  Heads are read first, in chunks, to find where
each chunk's body lies; then every chunk is a unit of work that reads its own byte range.
A vertex or a tile may have several runs, so a long one is never a single row anywhere.
Every delta file restarts from code 0, and may be in LZ4 frames (``.lz4``), which are read as blocks; a CSR part's nodes count from the number in its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeflow.functions.codec import BAD, ENTRIES, ZEROS, DeltaStream, delta_encode, delta_exits, leb128, leb128_decode
from edgeflow.functions.curve import decode_array, hilbert_code, sort_key
from edgeflow.operators import layout
from edgeflow.sources import files
from edgeflow.storage import remove

NODES = np.dtype([("src", "<u4"), ("cnt", "<u4")])
EDGES = np.dtype("<u4")
UPPER = np.dtype([("x", "<u2"), ("y", "<u2"), ("cnt", "<u4")])
LOWER = np.dtype([("x", "<u2"), ("y", "<u2")])
OFFSETS = np.dtype("<u8")
ENDS = np.dtype([("end", "<u8"), ("cnt", "<u8")])
#: Head files of a CSR pair, and offsets for each edge from which on a part goes on in ``.ends``.
CSR_HEADS, SPARSE = (".offsets", ".ends"), 4
#: Edges handed over at once, and head records of a chunk.
BATCH, CHUNK = 1 << 20, 1 << 18


def _edges(x: np.ndarray, y: np.ndarray):
    for i in range(0, len(x), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(v[i : i + BATCH].astype(np.int64)) for v in (x, y)], ["src", "dst"])


def whole_records(content: bytes, kind: np.dtype) -> np.ndarray:
    """Records of a file; a partial record at its end is left out."""
    return np.frombuffer(content, kind, len(content) // kind.itemsize)


CHUNKS = "head string, body string, start long, records long, at long, items long"


def _runs(spark: SparkSession, path: str, suffixes: tuple[str, str], kinds: tuple[np.dtype, np.dtype], decode) -> DataFrame:
    """Edges of run-length coded pairs: ``decode(runs, targets)`` gives both ends of the runs' edges."""
    found = files.pairs(spark, path, *suffixes)
    head, body = kinds

    def located(batches):
        """Chunks of the heads, with the place of each chunk's items in the body: a running sum of the counts."""
        for b in batches:
            for name, other, _, size in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows, start, at = [], 0, 0
                while len(runs := whole_records(files.read_range(name, start * head.itemsize, CHUNK * head.itemsize), head)):
                    items = int(runs["cnt"].sum(dtype=np.int64))
                    rows.append((name, other, start, len(runs), at, items))
                    start, at = start + len(runs), at + items
                if at > size // body.itemsize:
                    raise ValueError(f"{other} ends before its last run")
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], CHUNKS.replace(" string", "").replace(" long", "").split(", "))

    def read(batches):
        for b in batches:
            for name, other, start, records, at, _ in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                runs = whole_records(files.read_range(name, start * head.itemsize, records * head.itemsize), head)
                for ends in run_edges(other, runs, at, body, decode, BATCH):
                    yield from _edges(*ends)

    heads = files.spread(spark, found, "head string, body string, head_size long, body_size long", sum(h for _, _, h, _ in found))
    chunks = heads.mapInArrow(located, CHUNKS)
    return files.spread(spark, chunks, CHUNKS, sum(b for *_, b in found)).mapInArrow(read, "src long, dst long")


def run_edges(name: str, runs: np.ndarray, at: int, body: np.dtype, decode, most: int = BATCH):
    """Both ends of the runs' edges, so many at a time; the first run's items begin at ``at`` in the body file."""
    ends = np.cumsum(runs["cnt"], dtype=np.int64)
    items = int(ends[-1]) if len(ends) else 0
    for i in range(0, items, most):
        n = min(most, items - i)
        which = np.searchsorted(ends, np.arange(i, i + n), "right")
        found = whole_records(files.read_range(name, (at + i) * body.itemsize, n * body.itemsize), body)
        if len(found) < n:
            raise ValueError(f"{name} ends before its last run")
        yield decode(runs[which], found)


def vertex_ends(runs: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs["src"], targets


def tile_ends(runs: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple((runs[c].astype(np.int64) << 16) | low[c] for c in "xy")


def read_vertex(spark: SparkSession, path: str) -> DataFrame:
    return _runs(spark, path, (".nodes", ".edges"), (NODES, EDGES), vertex_ends)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return _runs(spark, path, (".upper", ".lower"), (UPPER, LOWER), tile_ends)


#: Bytes of a delta stream that a task decodes, about.
DELTA_BYTES = 32 << 20
BLOCKS = "name string, start long, size long, entry int, base long"


def decoded(name: str, start: int, size: int, entry: int, base: int, strict: bool):
    """Codes of the values that begin in a block of a file, batch by batch; ``base`` is the code before the first.

    ``entry`` tells how the block is entered (see ``codec.ENTRIES``): so many bytes of an earlier
    value are passed over, or so many zeros of the first value lie before the block.
    """
    stream, last, skip = DeltaStream(), np.uint64(base), max(entry, 0)
    stream.rest = bytes(max(-entry, 0))

    def coded(gaps):
        nonlocal last
        code = np.cumsum(gaps, dtype=np.uint64) + last
        before = np.concatenate([[last], code[:-1]]).astype(np.uint64)
        if strict and (code <= before).any():
            raise ValueError("codes do not increase")
        last = code[-1] if len(code) else last
        return code

    for piece in files.block_pieces(name, start, size):
        if skip < len(piece):
            yield coded(stream.feed(piece[skip:]))
        skip = max(0, skip - len(piece))
    if start + size < (final := files.size(name)):
        if any(stream.rest):
            # Its last value goes on in the next block, which passes over it.
            for more in files.block_pieces(name, start + size, final - start - size, 2 * ZEROS):
                for k in range(len(more)):
                    if len(got := stream.feed(more[k : k + 1])):
                        yield coded(got)
                        break
                if not stream.rest:
                    break
        else:
            stream.rest = b""  # the value whose zeros these are is the next block's
    stream.close()


def _framed(spark: SparkSession, found: dict[str, int], block: int) -> dict[str, list[tuple[int, int]]]:
    """Blocks of LZ4 files: whole frames, as many as come to ``block`` bytes; a task each looks for a file's."""

    def each(batches):
        for b in batches:
            names, blocks = b.column(0).to_pylist(), []
            for name in names:
                own: list[list[int]] = []
                for at, size in files.frames(name):
                    if own and own[-1][1] + size <= block:
                        own[-1][1] = at + size - own[-1][0]
                    else:
                        own.append([at, size])
                blocks.append([x for pair in own or [[0, 0]] for x in pair])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(blocks, pa.list_(pa.int64()))], ["name", "blocks"])

    if not found:
        return {}
    rows = files.spread(spark, [(n,) for n in found], "name string", 0).mapInArrow(each, "name string, blocks array<long>").collect()
    return {r["name"]: list(zip(r["blocks"][::2], r["blocks"][1::2], strict=True)) for r in rows}


def _delta_blocks(spark: SparkSession, found: dict[str, int], known: dict[str, list] | None, block: int) -> list[tuple]:
    """``BLOCKS`` of delta files: from the marks of their writer, or found by two looks at their bytes.

    The first look tells for each block how each way to enter it leaves it; chained from a
    file's start, the ways that are taken.  The second adds up each block's gaps.
    """
    if known is not None:
        rows = []
        for name, size in found.items():
            marks = [[0, 0], *known.get(name.rpartition("/")[2], [])]
            for (at, code), (end, _) in zip(marks, [*marks[1:], [size, 0]], strict=True):
                rows.append((name, at, end - at, 0, code))
        return rows
    framed = _framed(spark, {n: s for n, s in found.items() if n.endswith(files.LZ4)}, block)
    rows = [(n, at, min(block, size - at)) for n, size in found.items() if n not in framed for at in range(0, max(size, 1), block)]
    rows += [(n, at, size) for n, own in framed.items() for at, size in own]
    if len({n for n, *_ in rows}) == len(rows):
        return [(*r, 0, 0) for r in rows]

    def looked(batches):
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(3)]
            exits = [delta_exits(files.block_pieces(n, at, size)) for n, at, size in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(exits, pa.list_(pa.int32()))], ["name", "start", "exits"])

    def summed(batches):
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(5)]
            sums = np.zeros(b.num_rows, np.uint64)
            for i, block in enumerate(zip(*columns, strict=True)):
                for code in decoded(*block, strict=False):
                    sums[i] = code[-1] if len(code) else sums[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(sums.view(np.int64))], ["name", "start", "sum"])

    every = files.spread(spark, rows, "name string, start long, size long", sum(found.values()))
    exits = {(r["name"], r["start"]): r["exits"] for r in every.mapInArrow(looked, "name string, start long, exits array<int>").collect()}  # a row a block
    entered, entry = [], {}
    for n, at, size in rows:
        way = entry.get(n, 0)
        if way == BAD:
            raise ValueError(f"{n}: a value of over eight bytes")
        entered.append((n, at, size, way, 0))
        entry[n] = exits[n, at][list(ENTRIES).index(way)]
    if any(entry.values()):
        raise ValueError("the delta stream ends inside a value")
    blocks = files.spread(spark, entered, BLOCKS, sum(found.values()))
    sums = {(r["name"], r["start"]): r["sum"] for r in blocks.mapInArrow(summed, "name string, start long, sum long").collect()}
    based, base = [], {}
    for n, at, size, way, _ in entered:
        based.append((n, at, size, way, base.get(n, 0)))
        base[n] = int(np.uint64((base.get(n, 0) + sums[n, at]) % (1 << 64)).astype(np.int64))
    return based


def read_codes(spark: SparkSession, path: str, strict: bool = True, block: int = DELTA_BYTES) -> DataFrame:
    """``code`` of delta streams: the file at ``path`` whatever its name, or every ``.delta`` file of a folder.

    ``strict`` wants codes that increase throughout each file.  A file of more than
    ``block`` bytes is decoded by many tasks: between its writer's marks, or in blocks whose borders are found first.
    """
    found, marks = _streams(spark, path)

    def decode(batches):
        for b in batches:
            for name, start, size, entry, base in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                for code in decoded(name, start, size, entry, base & (1 << 64) - 1, strict):
                    yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64))], ["code"])

    blocks = _delta_blocks(spark, found, marks, block)
    return files.spread(spark, blocks, BLOCKS, sum(found.values())).mapInArrow(decode, "code long")


def _streams(spark: SparkSession, path: str) -> tuple[dict[str, int], dict[str, list] | None]:
    """Delta files of a path with their bytes, and their writer's marks if it left any."""
    every, one = files.listed(spark, path), files.is_file(spark, path)
    found = every if one else {n: s for n, s in every.items() if n.endswith((".delta", ".delta" + files.LZ4))}
    if every and not found:
        raise FileNotFoundError(f"{path}: no .delta files")
    said = None if one else files.manifest(path)
    if said:
        files.whole(path, found)
    return found, said and said["marks"]


#: Streams that a task merges at most, bytes of a stream's blocks there at least, and blocks in all, about.
WAYS, LEAST_BLOCK, MOST_BLOCKS = 64, 1 << 20, 100_000


def merged_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted arrays as one: where each of b's goes among a's, equal ones after them."""
    at = np.searchsorted(a, b, "right") + np.arange(len(b))
    out, own = np.empty(len(a) + len(b), a.dtype), np.ones(len(a) + len(b), bool)
    own[at] = False
    out[at], out[own] = b, a
    return out


def merge_codes(spark: SparkSession, paths: list[str], distinct: bool = False, least_block: int = LEAST_BLOCK, task_bytes: int = DELTA_BYTES) -> DataFrame:
    """``code`` of sorted delta streams in unsigned order, without sorting: partitions hold successive ranges of codes.

    The code before each block of a stream is known, so ranges are cut at these; a task
    decodes the blocks that reach into its range, each stream's in its own order, and merges
    them two and two.  A stream that does not increase raises.  A code of several streams comes
    as often, or once if ``distinct``.  More than ``WAYS`` files are sorted instead.
    """
    found = {}
    for path in paths:
        found |= _streams(spark, path)[0]
    total = sum(found.values())
    if len(found) > WAYS:
        return layout.merge(*[read_codes(spark, p) for p in paths], distinct=distinct)
    rows = _delta_blocks(spark, found, None, max(least_block, total // MOST_BLOCKS))
    unsigned = [(n, at, size, way, base & (1 << 64) - 1) for n, at, size, way, base in rows]
    # A block's codes lie past its own base, up to the base of the file's next block.
    ends = [b[4] if b and b[0] == a[0] else (1 << 64) - 1 for a, b in zip(unsigned, [*unsigned[1:], None], strict=True)]
    cuts, held = [0], 0
    for _, _, size, _, base in sorted(unsigned, key=lambda r: r[4]):
        if held >= task_bytes and base > cuts[-1]:
            cuts.append(base)
            held = 0
        held += size
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    tasks = []
    for k, (low, high) in enumerate(zip(cuts, [*cuts[1:], (1 << 64) - 1], strict=True)):
        own = [r for r, end in zip(unsigned, ends, strict=True) if r[4] < high and (end > low or not low)]
        tasks.append((k, signed(low), signed(high), [(*r[:4], signed(r[4])) for r in own]))

    def run(batches):
        for b in batches:
            for low, high, blocks in zip(*(b.column(c).to_pylist() for c in ("low", "high", "blocks")), strict=True):
                low, high = np.uint64(low & (1 << 64) - 1), np.uint64(high & (1 << 64) - 1)
                streams: dict[str, list] = {}
                for x in blocks:
                    for code in decoded(x["name"], x["start"], x["size"], x["entry"], x["base"] & (1 << 64) - 1, True):
                        streams.setdefault(x["name"], []).append(code[(code > low) & (code <= high)])
                parts = [np.concatenate(x) for x in streams.values()]
                while len(parts) > 1:
                    parts = [merged_two(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
                code = parts[0] if parts else np.zeros(0, np.uint64)
                code = code[np.concatenate([[True], code[1:] != code[:-1]])] if distinct and len(code) else code
                for i in range(0, len(code), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(code[i : i + BATCH].view(np.int64))], ["code"])

    schema = "k long, low long, high long, blocks array<struct<name: string, start: bigint, size: bigint, entry: int, base: bigint>>"
    return spark.createDataFrame(tasks, schema).repartitionByRange(len(tasks), "k").sortWithinPartitions("k").mapInArrow(run, "code long")


def read_delta(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Edges of delta streams; see ``read_codes``."""
    return layout.points(read_codes(spark, path, strict))


def csr_chunks(head: str, body: str, size: int, whole: int, most: int = CHUNK):
    """Chunks of a CSR pair: first entry, nodes, where their bytes begin in the body, how many they are, the part's first node."""
    tail = head.rpartition("/")[2].rpartition(".")[0].rpartition("-from")
    first = int(tail[2]) if tail[1] else 0
    kind = csr_kind(head)
    nodes, at = size // kind.itemsize + 1, 0
    for start in range(0, nodes, most):
        n = min(most, nodes - start)
        ends, passed = csr_ends(head, start, n) if kind is ENDS else (csr_ends(head, start + n - 1, 1)[0], None)
        end = int(ends[-1]) if start + n < nodes else whole
        if end > whole or end < at:
            raise ValueError(f"{body} ends before its last node")
        yield start, n, at, end - at, first
        # Of runs, the first node is told as if every record before had been of one node.
        at, first = end, first if passed is None else first + int(passed.sum()) - n


def csr_kind(head: str) -> np.dtype:
    return ENDS if head.endswith(CSR_HEADS[1]) else OFFSETS


def csr_ends(head: str, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """End bytes of some records of a CSR head, and how many nodes each stands for."""
    kind = csr_kind(head)
    found = whole_records(files.read_range(head, start * kind.itemsize, n * kind.itemsize), kind)
    if kind is OFFSETS:
        return found.astype(np.int64), np.ones(len(found), np.int64)
    return found["end"].astype(np.int64), found["cnt"].astype(np.int64)


def csr_chunk_edges(head: str, body: str, start: int, n: int, at: int, size: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of a chunk's edges; its nodes begin where the ones before them end."""
    ends, passed = csr_ends(head, start, n)
    begins = np.concatenate([[at], ends[: n - 1]]) - at
    nodes = first + start + np.concatenate([[0], np.cumsum(passed[: n - 1])])
    gap, place = leb128_decode(np.frombuffer(files.read_range(body, at, size), np.uint8))
    owner = np.searchsorted(begins, place, "right") - 1
    total = np.cumsum(gap, dtype=np.uint64)
    new = np.flatnonzero(np.diff(owner, prepend=-1))
    before = np.repeat(total[new] - gap[new], np.diff(new, append=len(owner)))
    return nodes[owner], total - before


def csr_edges(head: str, body: str, size: int, whole: int):
    """Both ends of a pair's edges, chunk by chunk."""
    for chunk in csr_chunks(head, body, size, whole):
        yield csr_chunk_edges(head, body, *chunk)


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """Edges of CSR pairs; the name ``<anything>-from<node>`` tells a part's first node, which is 0 without."""
    found = files.pairs(spark, path, CSR_HEADS, ".payload")

    def located(batches):
        for b in batches:
            for head, body, size, whole in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows = [(head, body, *chunk) for chunk in csr_chunks(head, body, size, whole, CHUNK)]
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split(" ")[0] for x in f"{CHUNKS}, first long".split(", ")])

    def read(batches):
        for b in batches:
            for chunk in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                yield from _edges(*csr_chunk_edges(*chunk))

    rows = files.spread(spark, found, "head string, body string, head_size long, body_size long", sum(h for _, _, h, _ in found))
    chunks = rows.mapInArrow(located, f"{CHUNKS}, first long")
    return files.spread(spark, chunks, CHUNKS, sum(b for *_, b in found)).mapInArrow(read, "src long, dst long")


def _run_starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of a batch's edges, which must fit in the 32 bits that a file holds of an id."""
    src, dst = b.column("src").to_numpy(), b.column("dst").to_numpy()
    if ((src | dst) >> 32).any():
        raise ValueError("an id of over 32 bits does not fit in the file")
    return src, dst


def _run_parts(batches, mark):
    heads = items = 0
    for b in batches:
        src, dst = _ids(b)
        at = _run_starts(src)
        mark(heads, items)
        heads, items = heads + len(at), items + len(src)
        yield ".nodes", np.rec.fromarrays([src[at], np.diff(at, append=len(src))], dtype=NODES).tobytes()
        yield ".edges", dst.astype(EDGES).tobytes()


def _tile_parts(batches, mark):
    heads = items = 0
    for b in batches:
        x, y = _ids(b)
        at = _run_starts(x >> 16, y >> 16)
        mark(heads, items)
        heads, items = heads + len(at), items + len(x)
        yield ".upper", np.rec.fromarrays([(x >> 16)[at], (y >> 16)[at], np.diff(at, append=len(x))], dtype=UPPER).tobytes()
        yield ".lower", np.rec.fromarrays([x & 65535, y & 65535], dtype=LOWER).tobytes()


def _delta_parts(batches, mark):
    last, size = np.uint64(0), 0
    for b in batches:
        code = b.column("code").to_numpy().view(np.uint64)
        if len(code):
            data = delta_encode(np.diff(code, prepend=last))
            mark(size, int(last.astype(np.int64)))
            last, size = code[-1], size + len(data)
            yield ".delta", data


def _csr_parts(batches, mark):
    first, node, edge, size, edges, sparse = None, 0, 0, 0, 0, False
    for src, dst in ((b.column("src").to_numpy(), b.column("dst").to_numpy()) for b in batches if b.num_rows):
        edges += len(src)
        if first is None or not sparse and src[-1] - first > SPARSE * edges + CHUNK:
            # Offsets that outgrow the edges end here: the part goes on in a pair that counts empty nodes.
            sparse = first is not None or bool(src[-1] - src[0] > SPARSE * edges + CHUNK)
            if first is not None and src[0] == node:
                # A node's gaps lie in one pair.
                own = int(np.searchsorted(src, node, "right"))
                data, each = leb128(np.diff(dst[:own], prepend=edge))
                yield f"-from{first}.payload", data
                src, dst = src[own:], dst[own:]
            first = node = int(src[0])
            edge = size = 0
        same = np.concatenate([[src[0] == node], src[1:] == src[:-1]])
        before = np.where(same, np.concatenate([[edge], dst[:-1]]), 0)
        data, each = leb128(dst - before)
        reach = size + np.concatenate([[0], np.cumsum(each)])
        if sparse:
            at = np.flatnonzero(~same)
            yield f"-from{first}.ends", np.rec.fromarrays([reach[at], np.diff(src[at], prepend=node)], dtype=ENDS).tobytes()
            yield f"-from{first}.payload", data
            node, edge, size = int(src[-1]), int(dst[-1]), int(reach[-1])
            continue
        # A step to a later node ends all nodes from the last one up to it; a wide gap between ids is written in pieces.
        steps, begin = np.diff(src, prepend=node), 0
        ends = np.cumsum(steps)
        while begin < len(steps):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK, "right")))
            for left in range(0, max(int(steps[begin]) if stop == begin + 1 else 1, 1), CHUNK):
                repeat = steps[begin:stop] if stop > begin + 1 else np.minimum(steps[begin:stop] - left, CHUNK)
                yield f"-from{first}.offsets", np.repeat(reach[begin:stop], repeat).astype(OFFSETS).tobytes()
            begin = stop
        yield f"-from{first}.payload", data
        node, edge, size = int(src[-1]), int(dst[-1]), int(reach[-1])


PARTS = {"vertex": _run_parts, "tile": _tile_parts, "delta": _delta_parts, "csr": _csr_parts}


def _put(rows: DataFrame, layout: str, folder: str, overwrite: bool) -> None:
    """Ordered partitions as parts of a folder, which are committed together."""
    from edgeflow.sources import datasource

    datasource.register(rows.sparkSession)
    rows.write.format(f"edge_{layout}").mode("overwrite" if overwrite else "append").save(folder)


def write_vertex(edges: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Runs by source, targets in order."""
    _ranged(edges.select("src", "dst"), "src", "dst", folder=folder, layout="vertex", overwrite=overwrite)


def write_runs(edges: DataFrame, position: str, folder: str, overwrite: bool = False) -> None:
    """Runs of equal sources in the order of ``position``, as in an unsorted file: a vertex may come again later."""
    _ranged(edges.select("src", "dst", position), position, folder=folder, layout="vertex", overwrite=overwrite)


def write_tiles(edges: DataFrame, folder: str, dense: bool = False, overwrite: bool = False) -> None:
    """Tiles in curve order, edges in curve order inside; ``dense`` renames vertices by first appearance."""
    if dense:
        edges = layout.renamed(edges, layout.dense_names(edges))
    coded = edges.select("src", "dst", sort_key(hilbert_code("src", "dst")).alias("key"))
    _ranged(coded, "key", folder=folder, layout="tile", overwrite=overwrite)


def write_codes(codes: DataFrame, folder: str, overwrite: bool = False, parts: int | None = None) -> None:
    """Distinct codes as delta files, by ranges of the curve, in so many ``parts``; code 0, edge (0, 0), raises."""
    keyed = codes.select("code").distinct().withColumn("key", sort_key(F.col("code")))
    ranged = keyed.repartitionByRange(parts, "key") if parts else keyed.repartitionByRange("key")
    _put(ranged.sortWithinPartitions("key"), "delta", folder, overwrite)


def write_stream(codes: DataFrame, path: str) -> None:
    """Distinct codes as one delta stream, the file ``path``, without marks.

    Ranges are written beside it by many tasks.  One task strings them together: it gives each
    range's first code its gap from the last of the one before and copies the rest, a piece at a time.
    """
    spark, parts = codes.sparkSession, f"{path}-parts"
    write_codes(codes, parts)
    found = files.listed(spark, parts)

    def ended(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            last = [int(code[-1].astype(np.int64)) for n in names for code in [c for c in decoded(n, 0, files.size(n), 0, 0, True) if len(c)][-1:]]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(last, pa.int64())], ["name", "last"])

    def strung(batches):
        for b in batches:
            for to, names, lasts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                fs, at = files.opened(to)
                before = np.uint64(0)
                # A task that runs again writes the same file again.
                with fs.open_output_stream(at, compression=None) as out:
                    for name, last in zip(names, lasts, strict=True):
                        head = files.read_range(name, 0, 2 * ZEROS + 1)
                        zeros = len(head) - len(head.lstrip(b"\0"))
                        first = np.uint64(int.from_bytes(head[zeros : 2 * zeros + 1], "big"))
                        out.write(delta_encode(np.array([first - before], np.uint64)))
                        for piece in files.pieces_from(name, 2 * zeros + 1):
                            out.write(piece)
                        before = np.uint64(last & (1 << 64) - 1)
            yield b

    # Names carry their range's number.
    own = files.spread(spark, [(n,) for n in sorted(found)], "name string", sum(found.values())).mapInArrow(ended, "name string, last long")
    rows = sorted(tuple(r) for r in own.collect())  # a row a range
    schema = "path string, names array<string>, lasts array<long>"
    spark.createDataFrame([(path, [n for n, _ in rows], [x for _, x in rows])], schema).mapInArrow(strung, schema).count()
    remove(spark, parts)


def write_delta(edges: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Distinct edges as delta files; see ``write_codes``."""
    write_codes(edges.select(hilbert_code("src", "dst").alias("code")), folder, overwrite)


def merge_delta(spark: SparkSession, paths: list[str], folder: str, overwrite: bool = False) -> None:
    """Several delta streams as one of distinct codes, written as they are merged."""
    _put(merge_codes(spark, paths, distinct=True), "delta", folder, overwrite)


def write_csr(edges: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Distinct edges as CSR pairs, by ranges of nodes; a part's name tells its first node."""
    # By node alone, so that a node's gaps lie in one part.
    rows = edges.select("src", "dst").distinct().repartitionByRange("src").sortWithinPartitions("src", "dst")
    _put(rows, "csr", folder, overwrite)


def _ranged(rows: DataFrame, *order: str, folder: str, layout: str, overwrite: bool) -> None:
    _put(rows.repartitionByRange(*order).sortWithinPartitions(*order), layout, folder, overwrite)


def _text(spark: SparkSession, path: str) -> DataFrame:
    from edgeflow.sources.text import read_text

    return read_text(spark, path)


def _write_text(edges: DataFrame, path: str, overwrite: bool = False) -> None:
    from edgeflow.sources.text import write_text

    write_text(edges, path, overwrite)


READERS = {"text": _text, "vertex": read_vertex, "hilbert": read_tiles, "compressed": read_delta, "csr": read_csr, "parquet": lambda s, p: s.read.parquet(p)}
WRITERS = {
    "text": _write_text, "vertex": write_vertex, "hilbert": write_tiles, "compressed": write_delta, "csr": write_csr,
    "parquet": lambda e, p, overwrite=False: e.write.mode("overwrite" if overwrite else "error").parquet(p),
}


def _known(table: dict, fmt: str):
    if fmt not in table:
        raise ValueError(f"unknown format {fmt!r}: one of {', '.join(table)}")
    return table[fmt]


def read(spark: SparkSession, fmt: str, path: str) -> DataFrame:
    """Edges of ``path`` in any format: text, vertex, hilbert, compressed, csr or parquet."""
    return _known(READERS, fmt)(spark, path)


def write(edges: DataFrame, fmt: str, path: str, **options) -> None:
    """Edges to ``path`` in any format; ``overwrite`` replaces what is there, ``dense`` renames the vertices of tiles."""
    _known(WRITERS, fmt)(edges, path, **options)


def convert(spark: SparkSession, source: tuple[str, str], target: tuple[str, str], **options) -> None:
    """From one (format, path) to another."""
    write(read(spark, *source), *target, **options)
