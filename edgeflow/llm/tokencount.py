"""Token counts from flat token files: a vectorised separator scan, stitched across blocks.

A flat token file is a run of fixed-width little-endian ids in which every document is
followed by an end-of-document id; it has no header and no index.  Files are read in blocks.
numpy finds a block's separators; a prefix maximum of the last separator's place and a
prefix sum of the separators' number, over the blocks before, tell where its first document
began and which document it is.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from edgeflow.llm.text import batch_rows
from edgeflow.llm.tokens import word_ids
from edgeflow.storage import Saved, remove, save, settled, shared_dir

#: Tokens of a block.
BLOCK = 1 << 20
END = 0
WIDTH = 2
DIFFER = "the flat files and the table differ in their documents"


def _placed(docs: DataFrame, seen: Observation) -> DataFrame:
    """Rows in an order within partitions that does not depend on how they arrive, with partition and place as ``m``.

    ``seen`` gets sums over all rows with their places: two reads that differ in any have others.
    """
    rows = docs.select("*", F.xxhash64("text").alias("digest")).sortWithinPartitions("id", "digest")
    rows = rows.withColumn("m", F.monotonically_increasing_id())
    h = F.xxhash64("m", "id", "digest")
    low, high = h.bitwiseAND(F.lit((1 << 31) - 1).cast("long")), F.shiftrightunsigned(h, 33)
    return rows.observe(seen, F.count("*").alias("rows"), F.sum(low).alias("low"), F.sum(high).alias("high"))


def write_flat(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", max_bytes: int = 64 << 20) -> dict:
    """Write the texts, by id and text digest within partitions, as flat files of 16-bit ids; returns the sums of ``_placed``.

    A stored id is the vocabulary's plus one; 0 ends a document; a vocabulary that needs more
    than 16 bits raises.  A file is closed once it holds ``max_bytes``.  The text sink writes
    a row's bytes as they are and the end id as its line separator, so any file system Spark
    knows will do.
    """

    def coded(batches):
        coder, file, size, place = word_ids(tokenizer), 0, 0, 0
        for b in batches:
            rows, files, places = [], [], []
            for t in b.column(0).to_pylist():
                ids = np.frombuffer(coder.ids(t), "<u4") + 1
                if len(ids) and int(ids.max()) >> 8 * WIDTH:
                    raise ValueError(f"an id does not fit into {WIDTH} bytes")
                if size >= max_bytes:
                    file, size = file + 1, 0
                rows.append(ids.astype("<u2").tobytes())
                files.append(file)
                places.append(place)
                size, place = size + len(rows[-1]) + WIDTH, place + 1
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(places, pa.int64()), pa.array(rows, pa.binary())], ["file", "place", "ids"])

    seen = Observation()
    source = _placed(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), seen).select("text")
    rows = source.mapInArrow(coded, "file long, place long, ids binary").sortWithinPartitions("file", "place")
    with batch_rows(docs.sparkSession):
        rows.select("file", F.col("ids").cast("string").alias("value")).write.option("lineSep", "\x00" * WIDTH).partitionBy("file").text(path)
    return seen.get


def scan(spark: SparkSession, path: str, end_id: int = END, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """``file, block, n_tokens, ends``: each block's token count and its separators' places in the file."""
    kind = {1: "<u1", 2: "<u2", 4: "<u4"}[width]

    def searched(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column(1)[i].as_buffer(), kind, len(b.column(1)[i].as_buffer()) // width)
                found = [np.flatnonzero(ids[a : a + block] == end_id) + a for a in range(0, len(ids), block)]
                n = [len(ids[a : a + block]) for a in range(0, len(ids), block)]
                name = b.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(n), pa.string()), pa.array(range(len(n)), pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                    ["file", "block", "n_tokens", "ends"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(searched, "file string, block long, n_tokens long, ends array<long>")


def stitch(blocks: DataFrame) -> DataFrame:
    """``file, ordinal, start, n_tokens, complete``: the documents of every file, from its blocks' separators.

    Tokens after the last separator are an incomplete document.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = blocks.select("file", "block", "n_tokens", "ends", F.size("ends").cast("long").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    placed = known.select(
        "file", "ends",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"),
    )
    ended = placed.select("file", "first", "ends", "previous", F.posexplode("ends").alias("k", "end"))
    begin = F.when(F.col("k") == 0, F.col("previous")).otherwise(F.element_at("ends", F.greatest("k", F.lit(1)))) + 1
    whole = ended.select("file", (F.col("first") + F.col("k")).alias("ordinal"), begin.alias("start"), (F.col("end") - begin).alias("n_tokens"), F.lit(True).alias("complete"))
    rest = known.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.sum("n_tokens").alias("all"))
    rest = rest.where("all > start").select("file", "ordinal", "start", (F.col("all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.union(rest)


@settled
def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", max_bytes: int = 64 << 20) -> DataFrame:
    """``doc_id, n_tokens`` of every document, by way of flat files in the shared folder.

    Null and empty texts have 0 tokens (their separator is not counted); very long texts are
    scanned block by block; rows of repeated or null id are rows, and equal rows count alike;
    an empty table gives none; other columns are ignored.  A document is known by its
    partition and its place there in the order of id and text digest, so the order in which
    rows arrive is of no account; a source that deals its rows out to partitions anew each
    time it is read should be saved first: rows or places that differ between the two reads raise.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/edgeflow-flat-{uuid.uuid4().hex}"
    written = write_flat(docs, path, tokenizer, doc_id, text, max_bytes)
    with batch_rows(spark, 1):
        blocks = Saved(scan(spark, path))
    remove(spark, path)
    at = lambda i: F.regexp_extract("file", r"file=(\d+)/part-(\d+)-", i).cast("long")
    held = blocks.df.groupBy("file").agg(F.sum(F.size("ends").cast("long")).alias("n"))
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("file", at(2).alias("part"), at(1).alias("number"), "n")
    held = held.select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    found = stitch(blocks.df).join(held, "file")
    found = found.select("part", (F.col("earlier") + F.col("ordinal")).alias("place"), "n_tokens", F.lit(1).alias("found"))
    seen = Observation()
    number = _placed(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), seen).select("id", "m")
    ids = number.select("id", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), F.lit(1).alias("asked"))
    both = ids.join(found, ["part", "place"], "full")
    wrong = F.raise_error(F.lit(DIFFER))
    out = save(both.select(
        F.col("id").alias(doc_id), F.when(F.col("found").isNull() | F.col("asked").isNull(), wrong.cast("long")).otherwise(F.col("n_tokens")).alias("n_tokens")
    ))
    # Of an empty table nothing is read again, and its join has no rows.
    if written["rows"] and seen.get != written:
        raise ValueError(DIFFER)
    return out
