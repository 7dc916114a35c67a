"""Byte-level text helpers shared by the corpus operators."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa


def utf8(column: pa.Array) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased (``bytes`` methods touch ASCII only)."""
    return text.lower().split() if text else []


#: Rows of whole texts that travel to a Python worker at once, and their bytes; bounds memory, not results.
BATCH_ROWS = 512
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def batch_rows(spark, rows: int = BATCH_ROWS):
    """So many rows at a time to Python workers, for what is computed inside; then the session's own settings again."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in (SETTINGS | {next(iter(SETTINGS)): rows}).items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
