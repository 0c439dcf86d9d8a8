"""Counts, statistics relations and evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def debate_stats(statements: DataFrame) -> DataFrame:
    """One row: statements, first and last day, distinct named speakers."""
    day = F.to_date("time")
    return statements.agg(F.count("*").alias("total_statements"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.countDistinct(F.when(F.col("who_en") != "", F.col("who_en"))).alias("speakers"))


def distinct_with_null(column: str) -> Column:
    """Distinct values, null counted as one."""
    return F.countDistinct(column) + F.max(F.col(column).isNull().cast("int"))


def long_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of every value of several columns in one pass: section_no, category, name, value as text."""
    pairs = F.array(*[F.struct(F.lit(k).alias("section_no"), F.lit(c).alias("category"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("name")) for k, c in enumerate(columns, 1)])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.section_no", "p.category", "p.name").agg(F.count("*").cast("string").alias("value"))


def counter_rows(counters: DataFrame, section_no: int) -> DataFrame:
    """Counters whose names part at the first point into category and name."""
    dotted = F.contains(F.col("name"), F.lit("."))
    category = F.when(dotted, F.substring_index("name", ".", 1)).otherwise("counter")
    rest = F.when(dotted, F.expr("substring(name, instr(name, '.') + 1)")).otherwise(F.col("name"))
    return counters.select(F.lit(section_no).alias("section_no"), category.alias("category"), rest.alias("name"), F.col("value").cast("string").alias("value"))


def value_shares(df: DataFrame, by: Sequence[str], column: str, digits: int = 3) -> DataFrame:
    """Counts and shares of a column's values inside each group, shares rounded half to even."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    totals = df.groupBy(*by).agg(F.count("*").alias("_total"))
    return counts.join(totals, list(by)).withColumn("share", F.bround(F.col("n") / F.col("_total"), digits)).drop("_total")


def length_percentiles(df: DataFrame, length: Column, threshold: int) -> DataFrame:
    """Percentiles 50, 90, 95 and 99 with linear interpolation, truncated, the greatest, and how many exceed a bound."""
    return df.select(length.alias("n")).agg(
        *[F.floor(F.percentile("n", p / 100)).cast("int").alias(f"p{p}") for p in (50, 90, 95, 99)], F.max("n").alias("longest"), F.count_if(F.col("n") > threshold).alias("n_above")
    )


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs on either side; undefined counts as 0."""
    sides = df.select(F.explode(F.array(F.struct(F.col(actual).alias("label"), F.lit(1).alias("a"), F.lit(0).alias("p"), F.lit(0).alias("h")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.equal_null(F.col(actual), F.col(predicted)).cast("int").alias("h")))).alias("s"))
    sums = sides.groupBy("s.label").agg(F.sum("s.a").alias("support"), F.sum("s.p").alias("n_predicted"), F.sum("s.h").alias("hits"))
    precision = F.when(F.col("n_predicted") > 0, F.col("hits") / F.col("n_predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("hits") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: rows, accuracy (0 when empty) and macro F1."""
    macro = class_report(df, actual, predicted).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.avg(F.equal_null(F.col(actual), F.col(predicted)).cast("double")), F.lit(0.0)).alias("accuracy")).crossJoin(macro)  # two single rows


def confusion(df: DataFrame, actual: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Confusion matrix in the given label order with zeros: row_no, actual, and a column for each predicted label."""
    cells = [F.count_if(F.col(predicted) == p).alias(f"pred_{p}") for p in labels]
    rows = df.where(F.col(actual).isin(*labels)).groupBy(F.col(actual).alias("actual")).agg(*cells)
    order = df.sparkSession.createDataFrame(list(enumerate(labels)), "row_no int, actual string")
    return order.join(F.broadcast(rows), "actual", "left").fillna(0).select("row_no", "actual", *(f"pred_{p}" for p in labels))


def compare(base: DataFrame, tuned: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Two one-row summaries side by side: metric, base, tuned, delta."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("m")).select("m.*")

    return long(base, "base").join(long(tuned, "tuned"), "metric").withColumn("delta", F.col("tuned") - F.col("base"))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that a table lacks."""
    return [c for c in required if c not in df.columns]


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls in each column, long."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns])).alias("c")).select("c.*")
