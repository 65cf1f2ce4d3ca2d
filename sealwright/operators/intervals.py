"""Points in half-open intervals as an equi-join, over a grid of blocks whose sizes are powers of sixteen.

An interval is cut into the few blocks that lie in it, and in no larger block that does: at most thirty for each level. A point lies in one block of each level, and
meets an interval in exactly one of them, or in none. The levels are as many as the finite bounds of the intervals need. Nothing is broadcast, no pair is made that the
blocks do not hold, and a block that many points share is an ordinary join key, which Spark splits if it is hot.

`within` gives every pair. Where only their number is asked, `counted` makes none: it sums starts and ends in the order of their times, over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.session import written

BASE = 16


def _tick(c: Column, kind: T.DataType) -> Column:
    """Whole seconds of a time, or the floor of a number."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_seconds(c.cast("timestamp"))
    if isinstance(kind, T.NumericType):
        return F.floor(c).cast("long")
    raise ValueError(f"no grid over {kind.simpleString()}")


def _blocks(a: Column, b: Column, levels: int) -> Column:
    """(level, block) of the whole blocks of [a, b) that lie in no larger whole block."""
    lo = [F.ceil(a / BASE**k).cast("long") for k in range(levels + 1)]
    hi = [F.floor(b / BASE**k).cast("long") for k in range(levels + 1)]

    def run(k: int, first: Column, last: Column) -> Column:
        return F.when(first < last, F.transform(F.sequence(first, last - 1), lambda n: F.struct(F.lit(k).alias("level"), n.alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))

    parts = []
    for k in range(levels + 1):
        whole = run(k, lo[k], hi[k])
        if k < levels:
            parts.append(F.when(lo[k + 1] < hi[k + 1], F.concat(run(k, lo[k], lo[k + 1] * BASE), run(k, hi[k + 1] * BASE, hi[k]))).otherwise(whole))
        else:
            parts.append(whole)
    return F.concat(*parts)


def within(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """`points` joined to the `intervals` of the same `on` columns with start <= at < end; null bounds are open, a null `at` lies in none.

    at, start and end are times or numbers. Columns other than `on` must differ. One aggregation over the intervals finds the range of their bounds.
    """
    kinds = {f.name: f.dataType for f in [*points.schema.fields, *intervals.schema.fields]}
    t, a, b = _tick(F.col(at), kinds[at]), _tick(F.col(start), kinds[start]), _tick(F.col(end), kinds[end])
    low, high = intervals.agg(F.coalesce(F.least(F.min(a), F.min(b)), F.lit(0)), F.coalesce(F.greatest(F.max(a), F.max(b)), F.lit(0))).first()
    size, levels = high - low + 3, 0  # one tick below all bounds, and one above
    while BASE**levels < size:
        levels += 1
    held = intervals.select("*", F.inline(_blocks(F.coalesce(a - (low - 1), F.lit(0)), F.coalesce(b - (low - 1) + 1, F.lit(size)), levels)))
    place = F.least(F.greatest(t, F.lit(low - 1)), F.lit(high + 1)) - (low - 1)
    looked = points.where(F.col(at).isNotNull()).select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    looked = looked.withColumn("block", F.floor(place / F.pow(F.lit(float(BASE)), F.col("level"))).cast("long"))
    inside = (F.col(start).isNull() | (F.col(start) <= F.col(at))) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    # Spark takes the blocks to be as small as the intervals they come from, and would broadcast them
    return looked.join(held.hint("merge"), [*on, "level", "block"]).where(inside).drop("level", "block")


def counted(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, name: str = "n") -> DataFrame:
    """`points` with the number of the `intervals` that `within` would join to each, 0 for none.

    What holds at a time is the starts up to it less the ends up to it. Each different time of the points and bounds is one row of a sort by range, whatever the number of
    points and intervals there; a partition sums its own rows and gets the total of those before it.
    """
    keys = [F.col(c).alias(f"on{i}_") for i, c in enumerate(on)]
    names = [f"on{i}_" for i in range(len(on))]
    whole = intervals.where(F.col(start).isNull() | F.col(end).isNull() | (F.col(start) < F.col(end)))
    step = lambda c, n, asked: [F.col(c).isNotNull().alias("late_"), F.col(c).alias("t_"), F.lit(n).cast("long").alias("d_"), F.lit(asked).alias("asked_")]
    # an open start is before all times; an open end never comes
    steps = points.where(F.col(at).isNotNull()).select(*keys, *step(at, 0, True))
    steps = steps.union(whole.select(*keys, *step(start, 1, False))).union(whole.where(F.col(end).isNotNull()).select(*keys, *step(end, -1, False)))
    place = [*names, "late_", "t_"]
    times = steps.dropna(subset=names).groupBy(*place).agg(F.sum("d_").alias("d_"), F.max("asked_").alias("asked_"))
    # written, so that a partition stays what it is
    laid = written(times.repartitionByRange(*place).withColumn("part_", F.spark_partition_id()), "interval-steps")
    totals = laid.groupBy("part_", *names).agg(F.sum("d_").alias("d_"))
    before = totals.select("part_", *names, F.coalesce(F.sum("d_").over(Window.partitionBy(*names).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    own = F.sum("d_").over(Window.partitionBy("part_", *names).orderBy("late_", "t_").rowsBetween(Window.unboundedPreceding, 0))
    held = laid.withColumn("own_", own).where("asked_").join(before, ["part_", *names]).select(*names, "t_", (F.col("own_") + F.col("before_")).alias("n_"))
    same = [F.col(c) == F.col(f"on{i}_") for i, c in enumerate(on)]
    out = points.join(held.where("n_ > 0"), [*same, F.col(at) == F.col("t_")], "left")
    return out.select(*points.columns, F.coalesce("n_", F.lit(0)).alias(name))
