"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Source tables up to this many rows are broadcast after counting them; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000
#: A mean above this is drawn as a sum of independent draws of equal smaller means.
MEAN = 16.0
#: Terms of the distribution function of a mean of MEAN; the tail beyond is under 2^-52.
TERMS = 80


def uniform(*parts: Column) -> Column:
    """52 hash-seeded bits as a double in [0, 1): the leading hex digits of the parts' MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson(mean: Column, *seed: Column) -> Column:
    """A Poisson count of the given mean by inversion: how many values of the distribution function lie at or below u."""
    draws = F.ceil(F.greatest(mean, F.lit(1e-9)) / MEAN)
    part = mean / draws
    first = F.struct(F.exp(-part).alias("p"), F.exp(-part).alias("cdf"), F.lit(0).alias("n"))

    def one(i: Column) -> Column:
        u = uniform(*seed, i)
        step = lambda s, k: F.struct((s["p"] * part / k).alias("p"), (s["cdf"] + s["p"] * part / k).alias("cdf"), (s["n"] + (s["cdf"] <= u).cast("int")).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step, lambda s: s["n"])

    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), draws), F.lit(0), lambda n, i: n + one(i))


def rates(docs: DataFrame, source: str = "source", weights: dict | None = None, power: float = 0.5, total: float | None = None) -> DataFrame:
    """``source, n, rate``: mean repetitions that bring each source to its share of ``total`` rows (all rows by default).

    Shares are ``weights`` (missing sources: 0), or proportional to ``n ** power``.  Null is a source like any other.
    """
    per = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        pairs = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], f"source {docs.schema[source].dataType.simpleString()}, w double")
        a, b = per.alias("a"), pairs.alias("b")
        per = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", F.coalesce("b.w", F.lit(0.0)).alias("w"))
        share = F.col("w")
    per = per.withColumn("share", share)
    sums = per.agg(F.sum("share"), F.sum("n")).first()
    scale = (total if total is not None else sums[1] or 0) / (sums[0] or 1.0)
    return per.select("source", "n", (F.col("share") * F.lit(float(scale)) / F.col("n")).alias("rate"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: dict | None = None, power: float = 0.5,
    total: float | None = None, seed: int = 7, columns: list[str] | None = None,
) -> DataFrame:
    """Every document repeated a Poisson number of times, dealt out in a hash-seeded global order.

    Returns ``columns`` (all by default), ``copy`` (from 0), ``rate`` and ``position_key``, a
    hash of the whole row that deals the copies over all partitions and orders each of them.  The count depends on
    ``seed`` and ``doc_id`` only; rows of equal or null id share their count.  A null source
    is a source; columns of the added ones' names give way to them.  Null or long texts pass unchanged.  An empty table gives no rows.
    """
    columns = [c for c in columns or docs.columns if c not in ("copy", "rate", "position_key")]
    per = rates(docs, source, weights, power, total)
    per = F.broadcast(per) if per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else per
    a, b = docs.select(*columns, F.col(doc_id).alias("__i"), F.col(source).alias("__s")).alias("a"), per.alias("b")
    rated = a.join(b, F.col("__s").eqNullSafe(F.col("b.source"))).select("a.*", "b.rate")
    counted = rated.withColumn("__n", poisson(F.col("rate"), F.lit(seed), F.col("__i")))
    copies = counted.where("__n > 0").withColumn("copy", F.explode(F.expr("sequence(0, __n - 1)")))
    keyed = copies.withColumn("position_key", F.xxhash64(F.lit(seed), "__i", "copy", *columns))
    spread = keyed.repartition("position_key").sortWithinPartitions("position_key")
    return spread.select(*columns, "copy", "rate", "position_key")


ORACLE_SQL = """
WITH RECURSIVE per AS (
  SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS share FROM documents GROUP BY source
), r AS (
  SELECT source, share * ((SELECT sum(n) FROM per)::DOUBLE / (SELECT sum(share) FROM per)) / n AS rate FROM per
), d AS (
  SELECT doc_id, d.source, text, rate, ceil(greatest(rate, 1e-9) / 16.0)::BIGINT AS draws
  FROM documents d JOIN r ON r.source IS NOT DISTINCT FROM d.source
), u AS (
  SELECT doc_id, source, text, rate, rate / draws AS part,
         ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '\\N') || '|' || i::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT *, unnest(range(1, draws + 1)) AS i FROM d)
), c(part, k, p, cdf) AS (
  SELECT DISTINCT part, 0, exp(-part), exp(-part) FROM u
  UNION ALL SELECT part, k + 1, p * part / (k + 1), cdf + p * part / (k + 1) FROM c WHERE k < 79
), drawn AS (
  SELECT doc_id, source, text, (SELECT count(*) FROM c WHERE c.part = u.part AND c.cdf <= u.u) AS n FROM u
), total AS (
  SELECT doc_id, source, text, sum(n)::BIGINT AS n FROM drawn GROUP BY ALL
)
SELECT doc_id, source, text, unnest(range(0, n))::INTEGER AS copy FROM total
"""
