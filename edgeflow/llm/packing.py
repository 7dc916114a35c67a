"""Packing token streams into fixed windows: bounded-space best fit.

Every partition keeps a fixed number of open windows.  A document's full windows stand
alone; the rest goes to the open window that it fills best.  When none has room, a new
window opens; when none may open, the fullest is emitted, topped up first with the head of
the document unless its gap is under ``min_cut`` tokens.  What is open at the end of a
partition is merged in rounds of ``FAN`` partitions, so no task ever holds more than
``FAN * windows`` windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from edgeflow.llm.text import batch_rows
from edgeflow.llm.tokens import word_ids
from edgeflow.storage import Saved

FAN = 16
TYPES = "start long, length long, ids binary, doc_tokens long, round integer, part long, window long, offset long, filled long, closed boolean"


class Packer:
    """Open windows of pieces ``(id, start, ids, doc_tokens)``; emits rows of whole windows."""

    def __init__(self, size: int, windows: int, min_cut: int, turn: int, part: int):
        self.size, self.most, self.min_cut, self.turn, self.part = size, windows, min_cut, turn, part
        self.open: list[list] = []  # [room, pieces]
        self.made, self.rows, self.held = 0, [], 0

    def emit(self, window: list, closed: bool = True) -> None:
        room, pieces = window
        at, number = 0, self.made
        self.made += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, ids, total, self.turn, self.part, number, at, self.size - room, closed))
            at += n
        self.held += at

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        step = 4 * self.size
        while len(ids) >= step:
            self.emit([0, [(doc, start, ids[:step], total)]])
            start, ids = start + self.size, ids[step:]
        while ids:
            n = len(ids) // 4
            fit = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if fit is None and len(self.open) < self.most:
                self.open.append(fit := [self.size, []])
            if fit is not None:
                fit[0] -= n
                fit[1].append((doc, start, ids, total))
                if not fit[0]:
                    self.open.remove(fit)
                    self.emit(fit)
                return
            full = min(self.open, key=lambda w: w[0])
            self.open.remove(full)
            if full[0] >= self.min_cut:
                cut = full[0]
                full[1].append((doc, start, ids[: 4 * cut], total))
                full[0], start, ids = 0, start + cut, ids[4 * cut :]
            self.emit(full)

    def finish(self, last: bool) -> None:
        """Hand over what is open; in the last round cut it so that only one window has a gap."""
        left, self.open = self.open, []
        if last:
            self.most, self.min_cut = 1, 1
            for _, pieces in sorted(left, key=lambda w: w[0]):
                for p in pieces:
                    self.add(*p)
            left, self.open = self.open, []
        for w in left:
            self.emit(w, last)

    def take(self) -> list[tuple]:
        rows, self.rows, self.held = self.rows, [], 0
        return rows


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 2048,
    windows: int = 32,
    end_id: int = 1,
    min_cut: int = 16,
) -> DataFrame:
    """Pieces of all documents, packed: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset, filled``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers; the pieces of a
    document are its whole id sequence (the text's ids, then ``end_id``), each id once.
    Pieces of a sequence lie from offset 0 without gaps; ``filled`` is the sequence's length
    before padding.  ``doc_id`` may be of any type.  A null or empty text is one piece of
    ``end_id``; a very long one is many full windows, handed on as they fill.  Among open
    windows of equal room the oldest is taken.  Rows with repeated or null ids are documents
    of their own.  An empty table gives no pieces.  Other columns are ignored.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = source.select("doc_id").schema
    for field in TYPES.split(", "):
        schema = schema.add(*field.split(" "))
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def first(batches):
        coder = word_ids(tokenizer)
        packer = Packer(size, windows, min_cut, 0, TaskContext.get().partitionId())
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = coder.ids(t) + end
                packer.add(doc, 0, ids, len(ids) // 4)
                if packer.held > 1 << 20:
                    yield batch(packer.take())
        packer.finish(False)
        yield batch(packer.take())

    def again(turn: int, last: bool):
        def merge(key: tuple, table: pa.Table) -> pa.Table:
            packer = Packer(size, windows, min_cut, turn, key[0].as_py())
            table = table.sort_by([(c, "ascending") for c in ("part", "window", "offset")])
            for piece in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                packer.add(*piece)
            packer.finish(last)
            return pa.Table.from_batches([batch(packer.take())])

        return merge

    with batch_rows(docs.sparkSession):
        made = [Saved(source.mapInArrow(first, schema))]
    parts = made[0].df.where("not closed").agg(F.max("part")).first()[0]
    turn = 0
    while parts is not None:
        turn, parts = turn + 1, (parts or 0) // FAN
        left = made[-1].df.where("not closed").withColumn("to", F.expr(f"part div {FAN}"))
        made.append(Saved(left.groupBy("to").applyInArrow(again(turn, parts == 0), schema)))
        if parts == 0:
            break
    out = made[0].df.where("closed")
    for m in made[1:]:
        out = out.union(m.df.where("closed"))
    sequence = F.expr("shiftleft(cast(round as bigint), 58) | shiftleft(part, 32) | window").alias("sequence_id")
    return out.select(F.col("doc_id").alias(doc_id), "start", "length", "ids", "doc_tokens", sequence, "offset", "filled")
