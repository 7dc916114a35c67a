"""Graphs derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeflow.operators.graph import Graph

#: name: (table, source, target, filter, table whose rows bound the ids; the largest id does without one)
GRAPHS = {
    "g1": ("lineitem", "l_orderkey", "l_partkey", None, "orders"),
    "g2": ("orders", "o_orderkey", "o_custkey", None, "orders"),
    "g3": ("lineitem", "l_partkey", "l_suppkey", "l_linenumber = 1", "part"),
    "g4": ("events", "user_id", "event_id % 500", "event_type = 'error'", None),
}

#: Ids of a spread graph lie below this where files hold 32 bits of an id.
SPAN = 1 << 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str, name: str = "g1", times: int = 1, span: int | None = SPAN) -> Graph:
    source, src, dst, keep, bound = GRAPHS[name]
    rows = table(spark, sf_dir, source)
    rows = rows.where(keep) if keep else rows
    edges = rows.select(_spread(F.expr(src).cast("bigint"), times, span).alias("src"), _spread(F.expr(dst).cast("bigint"), times, span).alias("dst"))
    n = table(spark, sf_dir, bound).count() * times if bound else None
    return Graph(edges, min(n, span) if bound and span and times > 1 else n)


def _spread(key: Column, times: int, span: int | None) -> Column:
    """Ids ``times`` apart, round the span if there is one: an odd ``times`` gives every key below it an id of its own."""
    key = key * times if times > 1 else key
    return key % span if times > 1 and span else key


def sql(name: str = "g1", times: int = 1, span: int | None = SPAN) -> str:
    """``e`` and ``v`` of the same graph, as common table expressions."""
    source, src, dst, keep, bound = GRAPHS[name]
    where = f" WHERE {keep}" if keep else ""
    n = f"count(*) FROM {bound}" if bound else "max(greatest(src, dst)) + 1 FROM e"
    spread = (f" * {times} % {span}" if span else f" * {times}") if times > 1 else ""
    return (
        f"e AS MATERIALIZED (SELECT ({src})::BIGINT{spread} AS src, ({dst})::BIGINT{spread} AS dst FROM {source}{where}), "
        f"v AS (SELECT range AS id FROM range((SELECT {n})))"
    )
