"""Row-level set operations: current versions, first-wins rules, anti joins, upserts, unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.functions.text import claim_key, match_key
from gavelspark.operators.ranking import first_by


def current(df: DataFrame, key: str = "id", at: str = "loaded_at", deletable: bool = False) -> DataFrame:
    """The latest row of every key; rows without a key are dropped, and keys whose latest row is a deletion if asked.

    Ties on ``at`` go to the row that sorts last by all its columns, so the result is the same on every run.
    """
    rest = [c for c in df.columns if c not in (key, at)]
    newest = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_row")).select(key, "_row.*").select(*df.columns)
    return newest.where("deleted_at is null") if deletable else newest


def without_keys(df: DataFrame, taken: DataFrame, key: Column) -> DataFrame:
    """Rows whose key is not in ``taken`` (one column ``key``); a null key is never taken."""
    return df.withColumn("_key", key).join(taken.select(F.col("key").alias("_key")).where("_key is not null").distinct(), "_key", "left_anti").drop("_key")


def without_claims(df: DataFrame, taken: DataFrame, text: str = "claim_text") -> DataFrame:
    """Rows whose claim, by its comparison key, is not among the claims of ``taken``."""
    return without_keys(df, taken.select(match_key(text).alias("key")), match_key(text))


def distinct_claims(df: DataFrame, text: str = "claim_text", seq: str = "seq") -> DataFrame:
    """The first row of every claim by its comparison key; rows with an empty key are dropped."""
    return first_by(df.withColumn("_key", match_key(text)).where("_key <> ''"), ["_key"], [seq]).drop("_key")


def first_label(df: DataFrame, text: str, label: str, evidence: Sequence[str], seq: str = "seq") -> DataFrame:
    """Order-dependent deduplication with its reason: the first label of a claim wins, later rows with another label are
    ``conflict``, and of the rows left all but the first of each claim and evidence are ``duplicate``; others have null.
    """
    # a claim may hold any share of the rows: first ones are aggregated and joined back, no claim is gathered in a window
    missing = F.lit("\u0000")
    keyed = df.withColumn("_claim", F.coalesce(claim_key(text), missing)).withColumn("_evidence", F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in evidence]))
    won = keyed.groupBy("_claim").agg(F.min(F.struct(F.col(seq).alias("s"), F.col(label).alias("l"))).alias("_won"))
    judged = keyed.join(won, "_claim").withColumn("_agrees", F.equal_null(F.col("_won")["l"], F.col(label)))
    firsts = judged.groupBy("_claim", "_agrees", "_evidence").agg(F.min(seq).alias("_first"))
    reason = F.when(~F.col("_agrees"), "conflict").when(F.col(seq) > F.col("_first"), "duplicate")
    return judged.join(firsts, ["_claim", "_agrees", "_evidence"]).withColumn("reason", reason).select(*df.columns, "reason")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows and those new ones whose key does not exist yet, so saved rows are never overwritten.

    Every row of a new key is kept; a null key never exists.
    """
    fresh = new.join(existing.select(key).distinct(), key, "left_anti").select(*new.columns)
    return existing.unionByName(fresh, allowMissingColumns=True)


def header_union(columns: Sequence[str], more: Sequence[str]) -> list[str]:
    """Columns and those of ``more`` that are absent, in order."""
    return [*columns, *(c for c in more if c not in columns)]


def by_label_priority(df: DataFrame, label: str, middle: Sequence[str], fallback: Sequence[str], order: Sequence, target: int, mode: str) -> DataFrame:
    """Rows chosen by label: ``middle_only``; ``middle_first`` (all middle rows and enough of the others to reach the
    target); ``all_labels`` (middle, then the others, cut at the target)."""
    middles = df.where(F.col(label).isin(*middle))
    if mode == "middle_only":
        return middles
    others = df.where(F.col(label).isin(*fallback))
    have = middles.count()
    if mode == "middle_first":
        return middles.unionByName(others.orderBy(*order).limit(max(0, target - have)))
    return middles.orderBy(*order).limit(target).unionByName(others.orderBy(*order).limit(max(0, target - have)))
