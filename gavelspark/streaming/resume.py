"""Resumable labelling as a stream: new files of claims are read once, claims already saved are left out, and each batch
is appended to the saved set. An extension; the batch form is ``operators.records.upsert``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.operators.ranking import first_by


def claim_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Claims from JSON lines files as they arrive in a folder."""
    return spark.readStream.schema(schema).json(path)


def distinct_stream(claims: DataFrame, keys: list[str], at: str, lateness: str) -> DataFrame:
    """The first of equal claims within a watermark, so the state stays bounded."""
    return claims.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def arrivals(claims: DataFrame, at: str, width: str, lateness: str, by: str) -> DataFrame:
    """Claims for each window of time and value of ``by``, final once the watermark has passed."""
    return claims.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def resume(claims: DataFrame, saved: str, checkpoint: str, key: str, label: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Label what is not saved yet and append it to the Parquet folder ``saved``; run again, it goes on where it ended.

    A batch that is repeated after a failure finds its own keys saved and adds nothing.
    """
    spark = claims.sparkSession

    def save(batch: DataFrame, _: int) -> None:
        once = first_by(batch.where(F.col(key).isNotNull()), [key], [F.to_json(F.struct(*batch.columns))])
        try:
            done = spark.read.parquet(saved).select(key)
        except Exception:
            done = spark.createDataFrame([], batch.select(key).schema)
        label(once.join(done, key, "left_anti")).write.mode("append").parquet(saved)

    claims.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
