"""The graph formats as Spark data sources: ``spark.read.format("edge_vertex").load(folder)``.

``edge_vertex``, ``edge_tile``, ``edge_delta`` and ``edge_csr`` read ``src, dst`` (``edge_delta``
also ``code``); a schema of some of the columns reads no others.  A partition is a range between
two marks of the writer, or a whole pair of files from elsewhere.

Writers take rows whose partitions are in the format's order, as ``binary.write`` makes them,
and commit in two phases: see ``files``.  Modes are ``append``, which wants no folder there, and
``overwrite``.  ``mark_bytes`` is how far marks lie apart.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from edgeflow.functions.curve import decode_array
from edgeflow.sources import binary, files


class Part(InputPartition):
    """Bytes of a part: its files (head and body, or one), where its records begin and end, and what the first builds on."""

    def __init__(self, names: tuple, start: list, end: list):
        self.names, self.start, self.end = names, start, end


class Written(WriterCommitMessage):
    def __init__(self, sizes: dict[str, int], key: str, marks: list):
        self.sizes, self.key, self.marks = sizes, key, marks


def _info(path: str) -> dict[str, int]:
    """Files of a folder, or one file, that count, and their bytes."""
    fs, at = files.opened(path)
    one = fs.get_file_info(at)
    if one.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [one] if one.is_file else fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
    found = {i.path: i.size for i in every if i.is_file and not i.base_name.startswith(("_", "."))}
    said = None if one.is_file else files.manifest(path)
    if said is None:
        return found
    files.whole(path, found)
    return {n: s for n, s in found.items() if n.rpartition("/")[2] in said["files"]}


class EdgeReader(DataSourceReader):
    def __init__(self, layout: str, path: str, columns: list[str]):
        self.layout, self.path, self.columns = layout, path, columns

    def partitions(self):
        found = _info(self.path)
        said = files.manifest(self.path) if files.opened(self.path)[0].get_file_info(files.opened(self.path)[1]).type == pyarrow.fs.FileType.Directory else None
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        suffixes = SUFFIXES[self.layout]
        first = binary.CSR_HEADS if self.layout == "csr" else suffixes[:1]
        heads = {n.removesuffix(x): n for x in first for n in found if n.endswith(x) or self.layout == "delta" and not said}
        if found and not heads:
            raise FileNotFoundError(f"{self.path}: no {' and '.join(suffixes)} files")
        out = []
        for base, head in sorted(heads.items()):
            names = [head, *(base + x for x in suffixes[1:])]
            if lost := [n for n in names if n not in found]:
                raise FileNotFoundError(f"{lost[0]}: only one of {' and '.join(suffixes)} is there")
            marks = [[0, 0], *(said["marks"].get(base.rpartition("/")[2] + (suffixes[0] if self.layout == "delta" else ""), []) if said else [])]
            names = tuple(scheme + n for n in names)
            out += [Part(names, a, z) for a, z in zip(marks, [*marks[1:], None], strict=True)]
        return out or [Part((), [0, 0], None)]

    def read(self, partition: Part):
        if not partition.names:
            return
        for edges in READ[self.layout](partition, "code" in self.columns):
            yield pa.RecordBatch.from_arrays([pa.array(edges[c].astype(np.int64)) for c in self.columns], self.columns)


def _runs(layout: str):
    (head, body), kinds, decode = {
        "vertex": ((".nodes", ".edges"), (binary.NODES, binary.EDGES), binary.vertex_ends),
        "tile": ((".upper", ".lower"), (binary.UPPER, binary.LOWER), binary.tile_ends),
    }[layout]

    def read(part: Part, _):
        (start, at), end = part.start, part.end[0] if part.end else None
        while end is None or start < end:
            n = binary.CHUNK if end is None else min(binary.CHUNK, end - start)
            runs = binary.whole_records(files.read_range(part.names[0], start * kinds[0].itemsize, n * kinds[0].itemsize), kinds[0])
            if not len(runs):
                break
            for x, y in binary.run_edges(part.names[1], runs, at, kinds[1], decode):
                yield {"src": x, "dst": y}
            start, at = start + len(runs), at + int(runs["cnt"].sum(dtype=np.int64))

    return read


def _delta(part: Part, code_only: bool):
    (start, base), name = part.start, part.names[0]
    size = (part.end[0] if part.end else files.size(name)) - start
    for code in binary.decoded(name, start, size, 0, base & (1 << 64) - 1, True):
        x, y = (code, code) if code_only else decode_array(code)
        yield {"src": x, "dst": y, "code": code.view(np.int64)}


def _csr(part: Part, _):
    head, body = part.names
    for x, y in binary.csr_edges(head, body, files.size(head), files.size(body)):
        yield {"src": x, "dst": y}


SUFFIXES = {"vertex": (".nodes", ".edges"), "tile": (".upper", ".lower"), "delta": (".delta",), "csr": (".offsets", ".payload")}
READ = {"vertex": _runs("vertex"), "tile": _runs("tile"), "delta": _delta, "csr": _csr}


class EdgeWriter(DataSourceArrowWriter):
    def __init__(self, layout: str, path: str, overwrite: bool, mark_bytes: int):
        self.layout, self.path, self.mark_bytes = layout, path, mark_bytes
        fs, at = files.opened(path)
        if fs.get_file_info(at).type != pyarrow.fs.FileType.NotFound:
            if not overwrite:
                raise FileExistsError(f"{path} exists")
            fs.delete_dir(at)
        fs.create_dir(at, recursive=True)
        fs.open_output_stream(f"{at}/{files.UNCOMMITTED}").close()

    def write(self, iterator):
        fs, at = files.opened(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        held, sizes, marks, since = {}, {}, [], 0

        def mark(a: int, b: int):
            nonlocal since
            if since >= self.mark_bytes:
                marks.append([a, b])
                since = 0

        try:
            for suffix, data in binary.PARTS[self.layout](iterator, mark):
                if suffix not in held:
                    held[suffix] = fs.open_output_stream(f"{at}/{name}{suffix}")
                held[suffix].write(data)
                sizes[name + suffix] = sizes.get(name + suffix, 0) + len(data)
                since += len(data)
        finally:
            for f in held.values():
                f.close()
        return Written(sizes, name + (".delta" if self.layout == "delta" else ""), marks)

    def commit(self, messages) -> None:
        fs, at = files.opened(self.path)
        done = [m for m in messages if m]
        said = {"layout": self.layout, "files": {n: s for m in done for n, s in m.sizes.items()}, "marks": {m.key: m.marks for m in done if m.marks}}
        with fs.open_output_stream(f"{at}/.{files.MANIFEST}") as f:
            f.write(json.dumps(said).encode())
        fs.move(f"{at}/.{files.MANIFEST}", f"{at}/{files.MANIFEST}")
        fs.delete_file(f"{at}/{files.UNCOMMITTED}")

    def abort(self, messages) -> None:
        fs, at = files.opened(self.path)
        if fs.get_file_info(at).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(at)


class EdgeFiles(DataSource):
    layout = ""

    @classmethod
    def name(cls) -> str:
        return f"edge_{cls.layout}"

    def schema(self) -> str:
        return "src bigint, dst bigint"

    def reader(self, schema: StructType) -> EdgeReader:
        known = ("src", "dst", "code") if self.layout == "delta" else ("src", "dst")
        for field in schema:
            if field.name not in known or field.dataType.simpleString() != "bigint":
                raise ValueError(f"{field.name} {field.dataType.simpleString()}: columns are {', '.join(known)}, all bigint")
        return EdgeReader(self.layout, self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> EdgeWriter:
        return EdgeWriter(self.layout, self.options["path"], overwrite, int(self.options.get("mark_bytes", files.TASK_BYTES)))


class VertexFiles(EdgeFiles):
    layout = "vertex"


class TileFiles(EdgeFiles):
    layout = "tile"


class DeltaFiles(EdgeFiles):
    layout = "delta"


class CsrFiles(EdgeFiles):
    layout = "csr"


def register(spark: SparkSession) -> None:
    """Make the formats known to the session."""
    for kind in (VertexFiles, TileFiles, DeltaFiles, CsrFiles):
        spark.dataSource.register(kind)
