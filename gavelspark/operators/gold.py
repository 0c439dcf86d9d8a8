"""Resolution of ambiguous candidates by explicit scores, and their enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.functions import patterns as P
from gavelspark.functions import text as X
from gavelspark.functions.values import parse_day, whole_number

FIXED_TYPES = ("introduced_date", "status_snapshot", "session_parliament", "sponsor")
GOLD_COLUMNS = ("source_context_local", "dataset_tier", "label_source", "gold_resolution_method", "gold_resolution_score", "source_session_id", "source_bill_debated_id")


def _nearness(source: Column, event: Column, reach: int, penalty: int | None) -> Column:
    """Points for an event shortly before the source's day, and less than none for one after it."""
    days = F.datediff(source, event)
    late = F.lit(0) if penalty is None else -(penalty + F.least(F.abs(days), F.lit(365)))
    return F.when(source.isNull() | event.isNull(), 0).when(days >= 0, F.greatest(F.lit(0), reach - F.least(days, F.lit(reach)))).otherwise(late)


def with_metadata(rows: DataFrame, statements: DataFrame, bills: DataFrame) -> DataFrame:
    """Candidates with what their statement and bill say, looked up by parsed ids; rows without a match keep nulls.

    ``statements``: id, bill_debated_id, session_id; ``bills``: id, introduced, latest_debate_date. Ids must be unique.
    """
    s = statements.select(F.col("id").alias("_sid"), F.col("bill_debated_id").alias("meta_bill_id"), F.col("session_id").cast("string").alias("meta_session_id"))
    b = bills.select(F.col("id").alias("_bid"), F.col("introduced").alias("meta_introduced"), F.col("latest_debate_date").alias("meta_latest"))
    keyed = rows.withColumn("_sid", whole_number("source_statement_id")).withColumn("_bid", whole_number("bill_id"))
    return keyed.join(s, "_sid", "left").join(b, "_bid", "left").drop("_sid")


def candidate_score(parsed_bill: str = "_bid") -> Column:
    """Score of a candidate from ``with_metadata``; each term is 0 where something it needs is missing."""
    source, vote = parse_day("source_date"), parse_day("vote_date")
    same_bill = F.when(F.col("meta_bill_id") == F.col(parsed_bill), 1000).otherwise(0)
    same_session = F.when((F.col("meta_session_id") != "") & (F.col("meta_session_id") == F.col("session_id")), 275).otherwise(0)
    said_session, said_parliament = (F.regexp_extract(X.or_empty("claim_text"), P.ORDINALS, g) for g in (1, 2))
    agrees = (said_parliament == X.or_empty("parliament_number")) & (said_session == X.or_empty("session_number"))
    ordinal = F.when(said_session == "", 0).when(agrees, 450).otherwise(-450)
    kind = F.when((F.col("claim_type") == "party_vote_direction") & vote.isNotNull(), 50).when(F.col("claim_type").isin(*FIXED_TYPES), 30).otherwise(0)
    dates = _nearness(source, vote, 180, 240) + _nearness(source, F.col("meta_introduced"), 120, 160) + _nearness(source, F.col("meta_latest"), 40, None)
    return same_bill + same_session + ordinal + dates + kind


def resolve_groups(scored: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """One row for every group with the outcome: ``single_candidate`` (score 0), ``score_tie`` and
    ``negative_best_score`` (dropped, but returned with their outcome), else ``scored_resolution``.

    ``scored`` needs ``score``. Groups are aggregated, not gathered: the winner is the greatest struct.
    """
    best = scored.groupBy(*keys).agg(F.count("*").alias("n_candidates"), F.max("score").alias("best"))
    joined = scored.join(best.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.equal_null(F.col(k), F.col(f"_{k}")) for k in keys]).drop(*(f"_{k}" for k in keys))
    tops = joined.where("score = best").groupBy(*keys, "n_candidates", "best").agg(F.count("*").alias("ties"), F.min(seq).alias(seq))
    method = F.when(F.col("n_candidates") == 1, "single_candidate").when(F.col("ties") > 1, "score_tie").when(F.col("best") < 0, "negative_best_score").otherwise("scored_resolution")
    return tops.withColumn("method", method).withColumn("score", F.when(F.col("n_candidates") == 1, 0).otherwise(F.col("best"))).withColumn("kept", F.col("method").isin("single_candidate", "scored_resolution")).drop("best", "ties")


def enrich(rows: DataFrame) -> DataFrame:
    """Chosen rows (with ``method`` and the metadata) in their gold form."""
    context = X.local_context_v2("source_context", "claim_text")
    return rows.withColumns({
        "source_context_local": context, "dataset_tier": F.lit("gold"), "label_source": F.lit("deterministic_db_rule"), "gold_resolution_method": F.col("method"),
        "source_session_id": X.or_empty("meta_session_id"), "source_bill_debated_id": X.or_empty(F.col("meta_bill_id").cast("string")),
    })
