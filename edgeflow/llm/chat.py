"""Logged conversations: cumulative snapshots collapsed, then rendered. DataFrame functions only.

A chat service that logs after every reply leaves snapshots, each a prefix of the next.
Rolling turn-prefix hashes find them: a turn's hash covers its position, role and text; a
prefix's hash is the exclusive-or of its turns' hashes, 128 bits wide.  A conversation goes
if its whole hash is that of a proper prefix of another; of equal conversations the one of
smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeflow.storage import save, settled

#: Turn positions are counted and hashed within blocks of so many turn numbers, and the
#: blocks' totals are carried over them, so that a very long conversation is many groups.
BLOCK = 1024
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turn_hash(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def _with_earlier_blocks(rows: DataFrame, column: str, total) -> DataFrame:
    """Adds ``before_<column>``: ``total`` of the column over the conversation's earlier blocks."""
    earlier = Window.partitionBy("conv").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "block").agg(total(column).alias("s"))
    sums = sums.select("conv", "block", F.coalesce(total("s").over(earlier), F.lit(0)).alias(f"before_{column}"))
    a, b = rows.alias("a"), sums.alias("b")
    same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & F.col("a.block").eqNullSafe(F.col("b.block"))
    return a.join(b, same).select("a.*", f"b.before_{column}")


def prefixes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, pos`` (from 1), ``role, text`` and the hash ``h1, h2`` of the turns up to this one.

    Order is by turn number (null first), then role, then text; equal turns keep all their rows.
    """
    t = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    t = t.withColumns({"block": F.floor(F.col("turn") / BLOCK), "one": F.lit(1)})
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    t = _with_earlier_blocks(t, "one", F.sum)
    t = t.withColumn("pos", F.row_number().over(inside) + F.col("before_one"))
    for k in (1, 2):
        t = _with_earlier_blocks(t.withColumn(f"t{k}", _turn_hash(k)), f"t{k}", F.bit_xor)
    rolled = {f"h{k}": F.bit_xor(f"t{k}").over(upto).bitwiseXOR(F.col(f"before_t{k}")) for k in (1, 2)}
    return t.withColumns(rolled).select("conv", "pos", "role", "text", "h1", "h2")


def maximal(rolled: DataFrame) -> DataFrame:
    """``conv, n_turns, n_equal``: conversations that are no proper prefix of another, one of each text."""
    last = rolled.groupBy("conv").agg(F.max(F.struct("pos", "h1", "h2")).alias("z"))
    whole = last.groupBy("z").agg(F.min("conv").alias("conv"), F.count("*").alias("n_equal"))
    whole = whole.select("conv", "n_equal", "z.pos", "z.h1", "z.h2")
    a, b = rolled.alias("a"), last.alias("b")
    shorter = a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.pos") < F.col("b.z.pos")))
    shorter = shorter.select("a.pos", "a.h1", "a.h2").distinct()
    return whole.join(shorter, ["pos", "h1", "h2"], "left_anti").select("conv", F.col("pos").alias("n_turns"), "n_equal")


@settled
def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per maximal conversation: its id, ``n_turns``, ``n_equal`` and ``rendered``.

    A turn is rendered as opening mark, role, line feed, text, closing mark; null roles and
    texts as empty.  Rows of null ``conv_id`` are one conversation.  Repeated turns are turns.
    Very long texts and conversations are hashed and rendered whole.  Turns without a number
    are one group of a conversation, to be sorted together.  An empty table gives no rows.
    Other columns are ignored.
    """
    rolled = save(prefixes(turns, conv_id, turn, role, text))
    kept = maximal(rolled)
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    a, b = rolled.alias("a"), kept.alias("b")
    said = a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv"))).select("b.conv", "b.n_turns", "b.n_equal", "a.pos", line.alias("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "")
    return said.groupBy("conv", "n_turns", "n_equal").agg(joined.alias("rendered")).withColumnRenamed("conv", conv_id)


ORACLE_SQL = r"""
WITH p AS (
  SELECT conv_id, count(*) OVER w AS n,
         string_agg(coalesce(role, chr(3)) || chr(1) || coalesce(text, chr(3)), chr(2)) OVER w AS said
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), whole AS (
  SELECT conv_id, max(n) AS n_turns, arg_max(said, n) AS said FROM p GROUP BY conv_id
), one AS (
  SELECT min(conv_id) AS conv_id, n_turns, said, count(*) AS n_equal FROM whole GROUP BY n_turns, said
), kept AS (
  SELECT * FROM one WHERE NOT EXISTS (
    SELECT 1 FROM p JOIN whole ON whole.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.n < whole.n_turns AND p.n = one.n_turns AND p.said = one.said)
)
SELECT k.conv_id, k.n_turns, k.n_equal,
       string_agg('<|im_start|>' || coalesce(c.role, '') || chr(10) || coalesce(c.text, '') || '<|im_end|>' || chr(10), ''
                  ORDER BY c.turn NULLS FIRST, c.role NULLS FIRST, c.text NULLS FIRST) AS rendered
FROM kept k JOIN conversations c ON c.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY ALL
"""
