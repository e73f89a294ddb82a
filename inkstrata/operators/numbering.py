"""Places in an order without a task for each group: range partitions number their own rows and are shifted by those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.session import checkpointed


def place_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with the 1-based place of each row among those of its keys; with no keys, among all rows.

    ``order`` must be total. A key with most of the rows is spread over as many partitions as its rows fill; what is ordered by
    one task at a time is one partition, and the counts of a key's partitions.
    """
    spread = checkpointed(df.repartitionByRange(*[F.asc(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return spread.join(shift, [*keys, "_part"]).withColumn(name, F.col("_before") + local).drop("_part", "_before")
