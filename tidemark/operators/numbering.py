"""Consecutive numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.cluster import join_small, scratch_path, settle


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with each row's place in its group, from 0, by ``order`` (nulls first).

    A window would bring a group into one task. Here the rows are cut by ranges of (group, order) and
    written; what each range holds of a group is counted, and the counts of the ranges before are
    added to the place within the range. Rows that tie take places next to each other, in the order in
    which they were read. A null in ``group`` is a group of its own; an empty table stays empty.
    """
    group = list(group)
    spark = df.sparkSession
    path = scratch_path(spark, "numbered")
    # The partition a row comes from splits ties, so equal rows need not meet in one task.
    ranged = df.withColumn("__from", F.spark_partition_id())
    keys = [*group, *order, "__from"]
    ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__from").withColumn(
        "__at", F.monotonically_increasing_id()).write.parquet(path)
    # The id of a row is its task's number above 33 bits for its place in the task.
    rows = spark.read.parquet(path).withColumns({"__range": F.shiftright("__at", 33), "__group": F.struct(*group)})
    counts = rows.groupBy("__group", "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(W.partitionBy("__group").orderBy("__range")) - F.col("__n")
    counts = settle(counts.select("__group", "__range", "__first", before.alias("__before")))
    # A range has few groups or each of them has few rows: no salt is needed.
    placed = join_small(rows, counts, ["__group", "__range"], salts=1)
    return placed.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).select(*df.columns, name)
