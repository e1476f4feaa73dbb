"""Running "last value so far" that does not put a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def carry_last(df: DataFrame, keys: list[str], order: str, value: str, name: str,
               inclusive: bool = True, block: int = 4096) -> DataFrame:
    """Add ``name``: the last non-null ``value`` up to (or, exclusive, before) each row.

    A plain window would sort a key's rows in one task.  Here the rows of a key are cut into
    blocks of ``block`` consecutive order numbers; each block is scanned by itself, one row
    per block carries its last value on, and the carry is joined back on (key, block).
    """
    end = 0 if inclusive else -1
    cut = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    scanned = cut.withColumn("_in", F.last(value, ignorenulls=True).over(inside))
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    blocks = cut.groupBy(*keys, "_block").agg(last.alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_block", F.last("_last.v", ignorenulls=True).over(before).alias("_carry"))
    joined = scanned.join(carried, [*keys, "_block"], "left")
    return joined.withColumn(name, F.coalesce("_in", "_carry")).drop("_block", "_in", "_carry")
