"""Row numbers within groups of any size, without one task for a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.plans.lineage import cut


def numbered(df: DataFrame, groups: list[str], order: str, name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... within each group by ``order`` (unique in its group).

    Rows are range-partitioned by group and order, so that a group that holds a third of
    all rows spans many partitions; each partition numbers its own part, and the parts
    before it, one count a partition and group, are added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(df.repartitionByRange(n, *groups, order).withColumn("_pid", F.spark_partition_id()), "ranked")
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy(*groups, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = spread.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid", *groups).orderBy(order)))
    keys = [*groups, "_pid"]
    named = offsets.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], "_off")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(keys)])
    return own.join(named, same).withColumn(name, F.col("_rn") + F.col("_off")).drop("_rn", "_off", "_pid", *[f"_o{i}" for i in range(len(keys))])
