"""Dealing and as-of lookups whose tasks stay small whatever the rows of a table or key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

#: Slices of a stretch of time, whose last values meet in one window row by row.
SLICES = 1024

#: Rows of a task that sorts several times; the sum of its sorts is what it needs at most.
ROWS_PER_TASK = 100_000


def tasks_for(rows, per_task=ROWS_PER_TASK):
    """How many tasks the rows of a written table need; its footers hold their number."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per_task))


def dealt(rows, *keys, per_task=ROWS_PER_TASK):
    """The rows of a written table dealt by ``keys`` over a number of tasks that grows with the table.

    Windows, aggregations and unions by these keys (and more) keep the dealing.  Exchanges that
    Spark adds have a set number of partitions, or are merged up to a size on the wire, so the
    sorts of a task would grow with the table.
    """
    return rows.repartition(tasks_for(rows, per_task), *keys)


def as_of(asks, entries, keys, time, values, stretch, in_order=False):
    """The ``asks`` with the ``values`` of the latest entry of their keys up to their ``time``.

    ``time`` is an integer column of both sides, and each side has one row per key and time.
    ``in_order`` says that the first of the ``values`` grows with the time, which then need not be kept beside it.
    Entries and asks share a window inside a slice of time, of which a ``stretch`` has ``SLICES``;
    what came before the slice is found among the last entries of the slices.  A window holds
    the rows of one key and slice, or one row per slice of a key, as many as the time it covers
    asks for whatever its rows, for every key alike.  Asks without an earlier entry have nulls.
    """
    fine = max(1, stretch // SLICES)
    entry = F.struct(*values) if in_order else F.struct(time, *values)
    rows = asks.withColumn("_asks", F.lit(1)).unionByName(
        entries.select(*keys, time, F.lit(0).alias("_asks"), entry.alias("_entry")), allowMissingColumns=True
    )
    rows = rows.withColumn("_slice", F.floor(F.col(time) / F.lit(fine)))
    place = [*keys, "_slice"]
    # An entry stands before an ask of the same time.
    inside = Window.partitionBy(*place).orderBy(time, "_asks").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_inside", F.last("_entry", ignorenulls=True).over(inside))
    slices = rows.groupBy(*place).agg(F.max("_entry").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(*place, F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    found = local.filter("_asks = 1").join(carried.filter("_carried is not null"), place, "left")
    latest = F.coalesce("_inside", "_carried")
    return found.select(*asks.columns, *[latest[v].alias(v) for v in values])
