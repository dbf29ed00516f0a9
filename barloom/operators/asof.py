"""As-of join: each left row with the last right row of its keys at or before it.

Both sides are dealt to stretches of time. A window inside a stretch finds what is in it, and one row a stretch carries over what the
stretches before leave; there is no range join, and a key's history is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a stretch: so many minutes in microseconds, or so many of a number's units.
STRETCH = 65_536


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], width: int | None = None) -> DataFrame:
    """`left` with `values` of the last right row whose `on` is not after its own; NULL without one.

    `on` is a timestamp, or a number of the same kind on both sides; `width` is that of a stretch, in microseconds or the number's
    units. Of right rows at one time that with the greatest values counts. Null keys and null times meet nothing; left rows
    come back each, with their columns, of which none may be called as a value.
    """
    if taken := {v.lower() for v in values} & {c.lower() for c in left.columns}:
        raise ValueError(f"left has columns {', '.join(sorted(taken))} already")
    keys, time = [*keys], dict(left.dtypes)[on]
    place = F.unix_micros(F.col(on).cast("timestamp")) if time.startswith("timestamp") else F.col(on)
    width = width or STRETCH * (60_000_000 if time.startswith("timestamp") else 1)
    names = [*keys, on, "_s", "_v", "_l"]
    cut = lambda df: df.withColumn("_s", F.floor(place / width))
    value = F.struct(*values)
    known = F.col(on).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    r = cut(right.where(known)).withColumn("_v", value).withColumn("_l", F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType)).select(*names)
    rows = cut(left).withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType)).withColumn("_l", F.struct(*left.columns)).select(*names)
    both = r.unionByName(rows)
    # at one time right rows come first, the greatest last
    inside = Window.partitionBy(*keys, "_s").orderBy(F.col(on), F.col("_l").isNotNull(), F.col("_v")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_here", F.last("_v", ignorenulls=True).over(inside)).where("_l is not null")
    ends = both.groupBy(*keys, "_s").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct(on, "_v"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_s", F.last("_end", ignorenulls=True).over(before).getField("_v").alias("_carried"))
    met = found.join(carried, [*keys, "_s"], "left")
    got = F.when(known, F.coalesce("_here", "_carried"))
    return met.withColumn("_got", got).select("_l.*", *(F.col("_got").getField(v).alias(v) for v in values))
