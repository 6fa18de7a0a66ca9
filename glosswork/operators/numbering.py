"""Row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.operators.shared import kept

BROADCAST_ROWS = 200_000


def number_rows(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "row_no", start: int = 0) -> DataFrame:
    """``df`` with consecutive numbers from ``start`` + 1 in ``order``, restarting in each ``group``.

    Rows are range-partitioned and sorted, and written once, so that their places do not change; a row's number is its place among its
    partition's rows of the group plus the rows of the group in earlier partitions.  Only a count for each partition
    and group is gathered.  Columns of ``order`` must tell rows apart.
    """
    group = group or []
    placed = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = kept(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    counts = placed.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*[F.col(c) for c in group]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = kept(counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n"), "offsets")
    renamed = offsets.select("_part", "_first", "_before", *[F.col(c).alias(f"_{c}") for c in group])
    same = placed["_part"] == renamed["_part"]
    for c in group:
        same = same & placed[c].eqNullSafe(renamed[f"_{c}"])
    number = (F.col("_at") - F.col("_first") + F.col("_before") + start + 1).cast("bigint").alias(name)
    side = F.broadcast(renamed) if offsets.count() <= BROADCAST_ROWS else renamed
    return placed.join(side, same).select(*[placed[c] for c in df.columns], number)
