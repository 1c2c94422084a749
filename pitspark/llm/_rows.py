"""Identities of rows that follow from their content alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def occurrences(ids: DataFrame) -> DataFrame:
    """``ids`` (place: a number of ``monotonically_increasing_id``, h: a hash of the content) with ``copy``: 1, 2, ... among rows of
    one h. Occurrences count on from one input partition to the next, so no task sees all copies of a row. Which
    of equal rows has which number follows from the layout, that they have the numbers 1 to n does not."""
    ids = ids.withColumn("_part", F.shiftright("place", 33))
    ids = ids.withColumn("_i", F.row_number().over(Window.partitionBy("h", "_part").orderBy("place")))
    before = F.sum("n").over(Window.partitionBy("h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = ids.groupBy("h", "_part").agg(F.max("_i").alias("n")).withColumn("_base", before).where("_base > 0").select("h", "_part", "_base")
    return ids.join(bases, ["h", "_part"], "left").withColumn("copy", F.col("_i") + F.coalesce("_base", F.lit(0))).drop("_part", "_i", "_base")
