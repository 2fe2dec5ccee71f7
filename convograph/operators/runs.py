"""Order within groups of any size: range-sorted runs instead of one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convograph.session import cut, parallelism


def in_runs(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows with ``run`` (their range partition), ``pos`` (from 1 inside the run) and ``before`` (the row ahead in it).

    ``rows`` must be slim: they are written once to the shared folder, since the range boundaries are sampled
    and must be the same for every later use.
    """
    cols = rows.columns
    spread = rows.repartitionByRange(parallelism(rows.sparkSession), *key, *order).withColumn("run", F.spark_partition_id())
    fixed = cut(spread)
    w = Window.partitionBy(*key, "run").orderBy(*order)
    return fixed.withColumn("pos", F.row_number().over(w)).withColumn("before", F.lag(F.struct(*cols)).over(w))


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str = "ord") -> DataFrame:
    """Rows with their number (from 1) in their group's order; a huge group spreads over several partitions."""
    cols = rows.columns
    runs = in_runs(rows, key, order).drop("before")
    before = Window.partitionBy(*key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.groupBy(*key, "run").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return runs.join(offsets, [*key, "run"]).select(*cols, (F.col("offset") + F.col("pos")).cast("long").alias(name))
