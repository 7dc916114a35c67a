"""Text edge lists: one edge per line, ``#`` lines skipped, tokens after the second ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"^\s*\+?(\d+)\s+\+?(\d+)(\s.*)?$"
LARGEST = (1 << 32) - 1


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``src, dst`` of the lines; a line that is no edge, or an id over 2^32 - 1, raises when read.

    Only a ``#`` in the first place makes a comment.
    """
    rows = lines.where(~F.col(column).startswith("#"))

    def token(i: int):
        text = F.regexp_extract(column, LINE, i)
        stop = F.raise_error(F.concat(F.lit("not an edge: "), F.col(column))).cast("bigint")
        number = F.when(F.length(text).between(1, 18), text.try_cast("bigint"))
        return F.when(number.isNull() | (number > LARGEST), stop).otherwise(number)

    return rows.select(token(1).alias("src"), token(2).alias("dst"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def write_text(edges: DataFrame, path: str, overwrite: bool = False) -> None:
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite" if overwrite else "error").text(path)
