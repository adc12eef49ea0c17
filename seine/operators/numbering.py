"""Row numbers of groups that one task could not hold.

Rows are dealt by ranges of group and order, numbered within their ranges, and moved up by what earlier ranges of their group
hold; the numbers of ranges are a small table. Rows of one group that are equal in the order may come in any order among
themselves, so the order should end with a key.

Defined results: null groups are one group; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seine.session import stored


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with each row's number in its group, from 1."""
    placed = stored(df.repartitionByRange(*group, *order).withColumn("seine_range", F.spark_partition_id()), "numbered")
    inside = placed.withColumn("seine_own", F.row_number().over(Window.partitionBy("seine_range", *group).orderBy(*order)))
    counts = placed.groupBy("seine_range", *group).agg(F.count("*").alias("seine_count"))
    earlier = Window.partitionBy(*group).orderBy("seine_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("seine_range", *group, F.coalesce(F.sum("seine_count").over(earlier), F.lit(0)).alias("seine_before"))
    i, b = inside.alias("i"), before.alias("b")
    same = F.col("i.seine_range") == F.col("b.seine_range")
    for g in group:
        same = same & F.col(f"i.`{g}`").eqNullSafe(F.col(f"b.`{g}`"))
    return i.join(b, same).select(*[F.col(f"i.`{c}`") for c in df.columns], (F.col("seine_own") + F.col("seine_before")).cast("int").alias(name))
