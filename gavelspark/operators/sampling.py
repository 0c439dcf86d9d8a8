"""Seeded, exact splits and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.operators.ranking import salted_rank


def seeded_order(seed: int, key: Column | str) -> Column:
    """A sort key that shuffles rows the same way for one seed."""
    return F.xxhash64(F.lit(seed), F.col(key) if isinstance(key, str) else key)


def stratified(df: DataFrame, by: Sequence[str], unique: str, parts: dict[str, float], seed: int = 42) -> DataFrame:
    """Rows dealt to named parts with exact proportions inside each stratum, rounded to whole rows.

    Ranks inside a stratum come from salted parts, so a stratum may hold any share of the rows.
    """
    hashed = df.withColumn("_u", F.struct(seeded_order(seed, unique).alias("h"), F.col(unique).alias("k")))
    ranked = salted_rank(hashed, by, "_u", "_rank").drop("_u")
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    joined = ranked.withColumnsRenamed({}).join(sizes, list(by))
    out, upto = None, 0.0
    names = list(parts)
    for name in names[:-1]:
        upto += parts[name]
        edge = F.round(F.col("_n") * upto)
        out = F.when(F.col("_rank") < edge, name) if out is None else out.when(F.col("_rank") < edge, name)
    split = out.otherwise(names[-1]) if out is not None else F.lit(names[-1])
    return joined.withColumn("split", split).drop("_rank", "_n")
