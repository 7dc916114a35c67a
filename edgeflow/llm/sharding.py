"""Contiguous shards of near-equal bytes: global prefix sums of row sizes, cut at equal targets.

Rows are ordered by the MD5 of their text, then that of their id.  So equal texts are
neighbours, and a part of the order is a range of leading digits, known without sampling.
Each part sums its sizes by itself; one row of totals a part gives where each begins; a
row's shard is where the middle of its unit falls among the equal targets.  A unit is a
row, or the rows of a text if together they are no larger than the largest row, so such a
group is never cut.  Hence every cut lies within half the largest row of its target.

A text that holds more than a part's even share has parts of its own, by the digits of its
rows' ids.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeflow.storage import Saved

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Bytes of a part, about, and the hexadecimal digits that number the parts at most: 65,536 of them.
PART_BYTES, MOST_DIGITS = 512 << 20, 4
#: Hexadecimal digits by which a text's rows are split.
SPLIT_DIGITS = 6
PART = ["__p", "__h", "__s"]


def _leading(digest: str, digits: int) -> Column:
    """The first digits as a number; -1 where there are none."""
    return F.coalesce(F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint"), F.lit(-1))


def _digest(c: Column) -> Column:
    return F.coalesce(F.md5(F.encode(c, "UTF-8")), F.lit(""))


def _before(value: str, *order: str) -> Column:
    """The sum over the rows before, of a table with a row for each part or shard."""
    return F.coalesce(F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _in_parts(rows: DataFrame, groups: DataFrame, digits: int, share: int) -> DataFrame:
    """Adds the part of each row and whether its text is split (``__hot``).

    Parts are ordered by their digits, by the split texts of the same digits that lie before
    or at the row's own, and by the digits of the split.
    """
    # As their bytes add up to the total, there are at most 16 ** digits such texts.
    hot = groups.where(F.col("bytes") > share).select(_leading("__d", digits).alias("__p"), F.struct("__d", F.ceil(F.col("bytes") / share).alias("parts")).alias("x"))
    hot = hot.groupBy("__p").agg(F.collect_list("x").alias("__x"))
    out = rows.withColumn("__p", _leading("__d", digits)).join(F.broadcast(hot), "__p", "left")
    own = F.filter("__x", lambda x: x["__d"] == F.col("__d"))
    less = F.filter("__x", lambda x: x["__d"] < F.col("__d"))
    out = out.withColumns({"__own": F.get(own, F.lit(0))["parts"], "__h": F.coalesce(F.size(less), F.lit(0)) * 2})
    split = F.floor(F.greatest(_leading("__i", SPLIT_DIGITS), F.lit(0)) * F.col("__own") / 16**SPLIT_DIGITS)
    hotly = F.col("__own").isNotNull()
    return out.withColumns({"__hot": hotly, "__h": F.col("__h") + hotly.cast("int"), "__s": F.coalesce(split, F.lit(0))}).drop("__x", "__own")


def shards(docs: DataFrame, n_shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, with ``size`` (bytes of the text and ``ROW_BYTES``), ``shard`` (from 0) and ``slot`` (gapless from 0 in its shard).

    A shard's bytes differ from an even share by no more than the largest row's.  A null text
    and an empty one have no bytes; null ids come first among the rows of a text; rows equal
    in text and id take neighbouring slots in any order.  A row larger than a share leaves
    shards empty.  Very long texts pass whole.  Columns of the added ones' names give way to
    them.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES
    rows = docs.select(*columns, size.alias("__size"), _digest(F.col(text)).alias("__d"), _digest(F.col(doc_id).cast("string")).alias("__i"))
    groups = Saved(rows.groupBy("__d").agg(F.sum("__size").alias("bytes"), F.max("__size").alias("largest")))
    total, largest = groups.df.agg(F.coalesce(F.sum("bytes"), F.lit(1)), F.coalesce(F.max("largest"), F.lit(1))).first()
    wanted = max(16 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES)
    digits = next((d for d in range(1, MOST_DIGITS) if 16**d >= wanted), MOST_DIGITS)
    placed = _in_parts(rows, groups.df, digits, max(total // 16**digits, largest))

    inside = Window.partitionBy(*PART).orderBy("__d", "__i").rowsBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy(*PART, "__d")
    placed = placed.withColumns({"__at": F.sum("__size").over(inside) - F.col("__size"), "__rn": F.count("*").over(inside) - 1})
    placed = placed.withColumns({"__first": F.min("__at").over(alike), "__all": F.sum("__size").over(alike)})
    whole = ~F.col("__hot") & (F.col("__all") <= largest)
    middle = F.when(whole, 2 * F.col("__first") + F.col("__all")).otherwise(2 * F.col("__at") + F.col("__size"))
    held = Saved(placed.select(*columns, "__size", *PART, "__rn", middle.alias("__middle")))
    groups.drop()

    totals = held.df.groupBy(*PART).agg(F.sum("__size").alias("bytes"), F.count("*").alias("n"))
    starts = totals.select(*PART, _before("bytes", *PART).alias("__b0"), _before("n", *PART).alias("__n0"))
    # Twice a place in bytes, times the shards, may pass 64 bits.
    shard = F.expr(f"cast((cast(2 * __b0 + __middle as decimal(38,0)) * {n_shards}) div {2 * total} as int)")
    at = held.df.join(F.broadcast(starts), PART).withColumn("shard", shard)
    begins = at.groupBy("shard").agg(F.count("*").alias("n")).select("shard", _before("n", "shard").alias("__r0"))
    slot = F.col("__n0") + F.col("__rn") - F.col("__r0")
    return at.join(F.broadcast(begins), "shard").select(*columns, F.col("__size").alias("size"), "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, folder: str, n_shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> None:
    """``docs`` as Parquet files in a folder for each shard, rows in slot order; a shard may be several files."""
    rows = shards(docs, n_shards, doc_id, text).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(folder)


ORACLE_SQL = """
WITH s AS (
  SELECT doc_id, text, coalesce(strlen(text), 0) + 16 AS size, coalesce(md5(text), '') AS d, coalesce(md5(doc_id::VARCHAR), '') AS i FROM documents
), w AS (
  SELECT *, sum(size) OVER (ORDER BY d, i ROWS UNBOUNDED PRECEDING) - size AS place, row_number() OVER (ORDER BY d, i) AS rn,
         sum(size) OVER (PARTITION BY d) AS alike, (SELECT max(size) FROM s) AS largest, (SELECT sum(size) FROM s) AS total FROM s
), u AS (
  SELECT *, CASE WHEN alike <= largest THEN 2 * min(place) OVER (PARTITION BY d) + alike ELSE 2 * place + size END AS middle FROM w
), cut AS (
  SELECT *, (middle * 40 // (2 * total))::INTEGER AS shard FROM u
), bit AS (
  SELECT list(list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS t
  FROM (SELECT range AS v FROM range(256))
), b AS (
  SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM cut
)
SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)::BIGINT AS text_crc32,
       'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY rn) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM b, bit
"""
