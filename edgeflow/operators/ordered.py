"""Windows over a total order without one task that holds all rows.

Rows are range-partitioned by the order; lags, counts and sums run within partitions and are
completed from one summary row per partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from edgeflow.storage import save

INSIDE = "part"


def walked(df: DataFrame, *order: Column | str, previous: dict[str, str] | None = None, default=None, running: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with lags and running sums over a total order, by one range shuffle and no other.

    ``previous`` names the lag of a column (``default`` for the first row), ``running`` the sum
    of a whole number up to and with each row.  A task walks through its sorted partition; the row
    that ends it tells what the next ones start from, one small row a partition.
    """
    previous, running = previous or {}, running or {}
    rows = df.withColumns({f"__{n}": c.cast("bigint") for n, c in running.items()})
    columns = rows.columns
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = StructType(list(ranged.schema.fields))
    for n, c in previous.items():
        schema = schema.add(n, rows.schema[c].dataType)
    for n in running:
        schema = schema.add(n, "long")
    schema = schema.add(INSIDE, "integer").add("__first", "boolean").add("__last", "boolean")

    names = list(running)  # the sums' columns stay here

    def walk(batches):
        part, sums, before, held = TaskContext.get().partitionId(), dict.fromkeys(names, 0), {}, None

        def out(last: bool):
            ends = np.zeros(held.num_rows, bool)
            ends[-1] = last
            return held.append_column("__last", pa.array(ends))

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                yield out(False)
            new, first = list(b.columns), np.zeros(b.num_rows, bool)
            first[0] = not before.get("seen")
            for n, c in previous.items():
                column = b.column(columns.index(c))
                new.append(pa.concat_arrays([before.get(n, pa.nulls(1, column.type)), column.slice(0, b.num_rows - 1)]))
                before[n] = column.slice(b.num_rows - 1)
            for n in names:
                total = np.cumsum(b.column(columns.index(f"__{n}")).fill_null(0).to_numpy()) + sums[n]
                sums[n] = int(total[-1])
                new.append(pa.array(total))
            before["seen"] = True
            new += [pa.array(np.full(b.num_rows, part, np.int32)), pa.array(first)]
            held = pa.RecordBatch.from_arrays(new, [*columns, *previous, *names, INSIDE, "__first"])
        if held is not None:
            yield out(True)

    found = save(ranged.mapInArrow(walk, schema))
    earlier = Window.orderBy(INSIDE).rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"__b_{n}": F.last(c).over(earlier) for n, c in previous.items()} | {f"__b_{n}": F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in running}
    starts = found.where("__last").select(INSIDE, *[c.alias(n) for n, c in carried.items()], (F.row_number().over(Window.orderBy(INSIDE)) == 1).alias("__none"))
    both = found.join(F.broadcast(starts), INSIDE)
    lag = lambda n: F.when(F.col("__first"), F.when(F.col("__none"), F.lit(default)).otherwise(F.col(f"__b_{n}"))).otherwise(F.col(n)).alias(n)
    return both.select(*df.columns, *[lag(n) for n in previous], *[(F.col(n) + F.col(f"__b_{n}")).alias(n) for n in running])


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` range-partitioned by a total order, with its partition's number in ``part``; saved."""
    return save(df.repartitionByRange(*order).withColumn(INSIDE, F.spark_partition_id()))


def _summaries(ranged: DataFrame, **totals: Column) -> DataFrame:
    """One row per partition, so at most as many as there are shuffle partitions."""
    return ranged.groupBy(INSIDE).agg(*[c.alias(n) for n, c in totals.items()])


def with_running(ranged: DataFrame, order: Column, **sums: Column) -> DataFrame:
    """Adds running sums in the whole order, each row included."""
    before = Window.orderBy(INSIDE).rowsBetween(Window.unboundedPreceding, -1)
    totals = _summaries(ranged, **{f"__{n}": F.sum(c) for n, c in sums.items()})
    offsets = totals.select(INSIDE, *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    w = Window.partitionBy(INSIDE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = ranged.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}).join(F.broadcast(offsets), INSIDE)
    return inner.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop(*[f"__{n}" for n in sums])
