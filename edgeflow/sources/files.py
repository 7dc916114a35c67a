"""Files of a graph: listing through Hadoop's file systems, reading by byte range within tasks, committed writes.

Tasks open files through ``pyarrow.fs``, so a path may be local (and shared), on HDFS or in an
object store.  Nothing is read past what a task needs and no content is shuffled.

A folder is written in two phases.  Before any task runs the folder holds ``UNCOMMITTED``, and no
reader takes it.  Tasks write files of names that no other attempt uses.  When all are done
the driver writes ``MANIFEST``, which names the files that count, their bytes and their marks,
and takes the first file away; if one fails, the folder goes.  A folder with neither file came from elsewhere and is read as it is.
"""

from __future__ import annotations

import io
import json
import struct

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from edgeflow.storage import exists, file_system

#: Bytes of files that a task reads, about.
TASK_BYTES = 128 << 20
MANIFEST, UNCOMMITTED = "_manifest.json", "_uncommitted"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def read_range(path: str, start: int, size: int) -> bytes:
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        return f.read_at(size, start)


def size(path: str) -> int:
    fs, at = opened(path)
    return fs.get_file_info(at).size


def pieces_from(path: str, start: int, most: int | None = None, step: int = 1 << 20):
    """A file's bytes from a place on, so many at a time."""
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        end = f.size() if most is None else start + most
        for place in range(start, end, step):
            yield f.read_at(min(step, end - place), place)


class _Window(io.RawIOBase):
    """Some bytes of an open file as a file."""

    def __init__(self, f, start: int, size: int):
        self.f, self.at, self.end = f, start, start + size

    def readable(self):
        return True

    def read(self, n: int = -1) -> bytes:
        left = self.end - self.at
        data = self.f.read_at(left if n is None or n < 0 else min(n, left), self.at)
        self.at += len(data)
        return data


#: Files of this suffix hold LZ4 frames: fixed values of that format.
LZ4 = ".lz4"
LZ4_FRAME, LZ4_SKIPPED, LZ4_STORED = 0x184D2204, 0x184D2A50, 1 << 31
LZ4_BLOCK_SUM, LZ4_CONTENT_SIZE, LZ4_CONTENT_SUM, LZ4_DICTIONARY = 1 << 4, 1 << 3, 1 << 2, 1


def frames(path: str) -> list[tuple[int, int]]:
    """Where the LZ4 frames of a file begin and how long they are: only the headers are read."""
    fs, at = opened(path)
    found = []
    with fs.open_input_file(at) as f:
        place, end = 0, f.size()
        number = lambda x: struct.unpack("<I", f.read_at(4, x))[0]
        while place < end:
            begin, magic = place, number(place) if place + 4 <= end else 0
            if magic & ~15 == LZ4_SKIPPED:
                place += 8 + number(place + 4)
                continue
            if magic != LZ4_FRAME:
                raise ValueError(f"{path}: no LZ4 frame at byte {place}")
            flags = f.read_at(1, place + 4)[0]
            place += 7 + 8 * bool(flags & LZ4_CONTENT_SIZE) + 4 * bool(flags & LZ4_DICTIONARY)
            while place + 4 <= end and (size := number(place)):
                place += 4 + size % LZ4_STORED + 4 * bool(flags & LZ4_BLOCK_SUM)
            place += 4 + 4 * bool(flags & LZ4_CONTENT_SUM)
            if place > end:
                raise ValueError(f"{path} ends inside an LZ4 frame")
            found.append((begin, place - begin))
    return found


def block_pieces(path: str, start: int, size: int, step: int = 1 << 20):
    """The bytes of a block of a file, so many at a time; of whole LZ4 frames, what they hold."""
    if not path.endswith(LZ4):
        yield from pieces_from(path, start, size, step)
        return
    fs, at = opened(path)
    with fs.open_input_file(at) as f, pa.CompressedInputStream(pa.PythonFile(_Window(f, start, size), "r"), "lz4") as held:
        while data := held.read(step):
            yield data


def manifest(path: str) -> dict | None:
    """What a folder's writer has committed: ``files`` (name to bytes) and ``marks``; None for files from elsewhere.

    A folder whose writer has not come to its end raises.
    """
    fs, at = opened(path)
    there = {i.base_name for i in fs.get_file_info([f"{at}/{MANIFEST}", f"{at}/{UNCOMMITTED}"]) if i.type == pyarrow.fs.FileType.File}
    if UNCOMMITTED in there:
        raise FileNotFoundError(f"{path}: its writer did not commit it")
    if MANIFEST not in there:
        return None
    with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


def listed(spark: SparkSession, path: str) -> dict[str, int]:
    """Every file of ``path`` (itself, or in the folder and below it) and its bytes; raises where there is none.

    Of a committed folder, the files that its manifest names.
    """
    at, fs = file_system(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    found, it = {}, fs.listFiles(at, True)
    while it.hasNext():
        one = it.next()
        name = one.getPath().toString()
        if not name.rpartition("/")[2].startswith(("_", ".")):
            found[name] = one.getLen()
    if fs.getFileStatus(at).isFile() or (said := manifest(path)) is None:
        return found
    return {n: s for n, s in found.items() if n.rpartition("/")[2] in said["files"]}


def whole(path: str, found: dict[str, int]) -> None:
    """Raise if a committed folder has lost a file, or part of one."""
    said = manifest(path)
    have = {n.rpartition("/")[2]: s for n, s in found.items()}
    for name, size in said["files"].items() if said else ():
        if have.get(name) != size:
            raise FileNotFoundError(f"{path}: {name} is not there as it was written")


def is_file(spark: SparkSession, path: str) -> bool:
    at, fs = file_system(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def pairs(spark: SparkSession, path: str, head: str | tuple[str, ...], body: str) -> list[tuple[str, str, int, int]]:
    """Head (of one suffix or another) and body files of ``path`` as a prefix, or of all pairs in the folder ``path``, with their bytes.

    A file without its partner raises, and so does a path that holds other files only, or is not
    there.  An empty folder is an empty graph.
    """
    heads = (head,) if isinstance(head, str) else head
    if exists(spark, path):
        found = listed(spark, path)
    else:
        found = {}
        for suffix in (*heads, body):
            if exists(spark, path + suffix):
                found |= listed(spark, path + suffix)
    a, b = ({n.removesuffix(x): (n, s) for x in every for n, s in found.items() if n.endswith(x)} for every in (heads, (body,)))
    head = " or ".join(heads)
    if not a and not b and (found or not exists(spark, path)):
        raise FileNotFoundError(f"{path}: no {head} and {body} files")
    if a.keys() != b.keys():
        alone = sorted(a.keys() ^ b.keys())[0]
        raise FileNotFoundError(f"{alone}: only one of {head} and {body} is there")
    if exists(spark, path):
        whole(path, found)
    return [(a[k][0], b[k][0], a[k][1], b[k][1]) for k in sorted(a)]


def spread(spark: SparkSession, rows: list | DataFrame, schema: str, size: int) -> DataFrame:
    """Small rows that stand for ``size`` bytes of work, dealt over as many tasks as that needs."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    df = spark.createDataFrame(rows, schema) if isinstance(rows, list) else rows
    return df.repartition(tasks)


def compress(spark: SparkSession, source: str, target: str, frame: int = 4 << 20) -> None:
    """The files of one folder in another, in LZ4 frames of so many bytes each."""

    def each(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, at = opened(target)
                fs.create_dir(at, recursive=True)
                # A task that runs again writes the same file again.
                with fs.open_output_stream(f"{at}/{name.rpartition('/')[2]}{LZ4}", compression=None) as out:
                    for piece in pieces_from(name, 0, None, frame):
                        packed = pa.BufferOutputStream()
                        with pa.CompressedOutputStream(packed, "lz4") as f:
                            f.write(piece)
                        out.write(packed.getvalue())
            yield b

    found = listed(spark, source)
    spread(spark, [(n,) for n in found], "name string", sum(found.values())).mapInArrow(each, "name string").count()
