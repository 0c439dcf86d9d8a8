"""Ranks inside groups of any size, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts that each group is ranked in, at least, and rows of the whole table for each part more: a part of a group that holds
#: all rows has no more than about ROWS_PER_SALT.
SALTS = 256
ROWS_PER_SALT = 500_000


def salted_rank(df: DataFrame, keys: Sequence[str], unique: str, name: str = "rank", salts: int | None = None) -> DataFrame:
    """Add a rank from 0 inside each group of ``keys``, every value once; ``unique`` is a column unique in the group.

    The order is that of a hash of ``unique`` and then ``unique``, so equal input gives equal ranks.
    """
    salts = salts or max(SALTS, df.count() // ROWS_PER_SALT)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(unique), F.lit(salts)))
    counts = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_salt")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(unique))
    return salted.withColumn("_r", inside).join(before, [*keys, "_salt"]).withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_salt", "_r", "_before")


def global_rank(df: DataFrame, order: Sequence, name: str = "rank", total: str | None = None) -> DataFrame:
    """Add a rank from 1 over the whole table in the given order, and optionally the sum of column ``total`` before each
    row, by a range sort: each task ranks its own range, and one row per range carries the offsets."""
    from gavelspark.session import cut

    ranged = cut(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sums = F.sum(total) if total else F.lit(0)
    sizes = ranged.groupBy("_pid").agg(F.count("*").alias("_n"), sums.alias("_t") if total else F.max(F.lit(0)).alias("_t"))
    ahead = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_sum"))
    inside = Window.partitionBy("_pid").orderBy(*order)
    out = ranged.withColumn("_r", F.row_number().over(inside))
    if total:
        out = out.withColumn("_s", F.coalesce(F.sum(total).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(F.broadcast(offsets), "_pid").withColumn(name, (F.col("_before") + F.col("_r")).cast("long"))
    if total:
        out = out.withColumn("total_before", (F.col("_sum") + F.col("_s")).cast("long"))
    return out.drop("_pid", "_r", "_before", "_sum", "_s")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of every group in the given order; ranks are cut in each task before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows of every group with their rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
