"""The pipelines as a whole: vote claims with their records, gold rows, silver rows, and the merged training set.

Each takes relations, returns relations (lazy but for what is cut), and has an ``export_`` counterpart that writes its files.
Statistics are long relations of section_no, category, name and value.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.functions import patterns as P
from gavelspark.functions import text as X
from gavelspark.operators import boundaries, gold, merge, metrics, records, silver, templates, votes
from gavelspark.operators.ranking import global_rank
from gavelspark.session import cut
from gavelspark.sources import sinks

#: The narrow files cut from the master rows.
PROJECTIONS = {
    "factcheck_claim_label": ("claim_text", "label"),
    "factcheck_claim_context_label": ("claim_text", "source_context", "label"),
    "factcheck_claim_evidence_label": ("claim_text", "evidence_text", "label"),
    "factcheck_claim_evidence_explanation": ("claim_text", "evidence_text", "label", "explanation"),
}


def stats_rows(rows: DataFrame, totals: Mapping[str, Column], columns: Sequence[str], counters: DataFrame | None = None) -> DataFrame:
    """Statistics in sections: overall totals, the values of some columns, and counters named ``category.name``."""
    totals = {k: v.cast("string") for k, v in totals.items()}
    overall = rows.agg(*[v.alias(k) for k, v in totals.items()]).select(F.explode(F.array(*[F.struct(F.lit(0).alias("section_no"), F.lit("overall").alias("category"), F.lit(k).alias("name"), F.col(k).alias("value")) for k in totals])).alias("r")).select("r.*")
    parts = [overall, metrics.long_counts(rows, columns)] + ([metrics.counter_rows(counters, len(columns) + 1)] if counters is not None else [])
    return reduce(DataFrame.unionByName, parts)


def _label_totals() -> dict[str, Column]:
    return {"total_rows": F.count("*"), "true_rows": F.count_if(F.col("label") == "True"), "false_rows": F.count_if(F.col("label") == "False")}


# Vote claims --------------------------------------------------------------------------------------------------------


def vote_dataset(statements: DataFrame, facts: DataFrame, patterns: Sequence[tuple[str, int, str]], ratio: float = 0.0, seed: int = 42, statement_limit: int | None = None, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid master rows and counters. ``statements``: from ``votes.bill_statements``; ``facts``: from ``votes.vote_facts``.

    A statement limit takes the earliest statements, as the ordered scan does; None takes all.
    """
    limited = statements if statement_limit is None else statements.orderBy(F.asc_nulls_last("source_date"), "statement_id").limit(statement_limit)
    spoken, facts = cut(limited), cut(facts)
    claims = cut(votes.vote_claims(spoken, facts, patterns))
    natural = cut(votes.vote_rows(claims, spoken, facts, now))
    made = votes.synthetic_negatives(natural, ratio, seed)
    # synthetic rows come after all others, in the order of their numbers
    order = F.struct(F.when(F.col("claim_origin") == "synthetic_fallback", 1).otherwise(0).alias("part"), F.element_at(F.split("claim_id", "-"), -1).cast("long").alias("n"))
    combined = natural.drop("seq").unionByName(made.drop("seq")).withColumn("seq", order).withColumn("_evidence", X.claim_key("evidence_text"))
    judged = cut(records.first_label(combined, "claim_text", "label", ["_evidence"]))
    names = {"conflict": "skipped.conflicting_claim_label", "duplicate": "skipped.duplicate_claim_evidence"}
    dropped = judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("value")).select(F.coalesce(*[F.when(F.col("reason") == k, v) for k, v in names.items()]).alias("name"), "value")
    totals = spoken.agg(F.lit("candidate.statements").alias("name"), F.count("*").alias("value"))
    synthetic = judged.where("claim_origin = 'synthetic_fallback'").agg(F.lit("generated.synthetic_false_rows").alias("name"), F.count("*").alias("value")).where("value > 0")
    counters = reduce(DataFrame.unionByName, (totals, votes.drop_counts(claims, spoken).where("value > 0"), synthetic, dropped))
    kept = judged.where("reason is null").drop("reason", "_evidence")
    return votes.require_valid(kept, votes.REQUIRED, "evidence_text"), counters


def vote_pairs(rows: DataFrame) -> DataFrame:
    """Training pairs of master rows: prompt, completion, metadata."""
    meta = F.struct("claim_id", "label", "verdict_relation", "claim_type", "bill_number", "votequestion_id", "party_name")
    return rows.select(templates.vote_prompt().alias("prompt"), templates.vote_completion().alias("completion"), meta.alias("metadata"))


def vote_stats(rows: DataFrame, counters: DataFrame) -> DataFrame:
    return stats_rows(rows, _label_totals(), ["claim_type", "claim_origin", "rule_id"], counters)


def export_votes(rows: DataFrame, counters: DataFrame, root: str) -> None:
    """Master file, its projections, pairs and statistics."""
    sinks.export(rows, root, {"factcheck_master": votes.MASTER_COLUMNS, **PROJECTIONS}, vote_pairs(rows), vote_stats(rows, counters).orderBy("section_no", "name"))


# Gold ---------------------------------------------------------------------------------------------------------------

GOLD_KEYS = ("source_statement_id", "claim_text", "claim_type")


def gold_dataset(rows: DataFrame, statements: DataFrame, bills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The best row of every group of candidates, enriched, in order of date and claim id; and counters.

    ``rows``: master rows with ``seq``; ``statements``: id, bill_debated_id, session_id; ``bills``: id, introduced,
    latest_debate_date; ids must be unique.
    """
    scored = cut(gold.with_metadata(rows, statements, bills).withColumn("score", gold.candidate_score()))
    groups = cut(gold.resolve_groups(scored, GOLD_KEYS))
    chosen = groups.where("kept").select("seq", "method", F.col("score").cast("string").alias("gold_resolution_score"))
    enriched = gold.enrich(scored.join(chosen, "seq")).select(*rows.columns, *[c for c in gold.GOLD_COLUMNS if c not in rows.columns])
    resolved = groups.groupBy(F.concat(F.lit("resolution."), F.col("method")).alias("name")).agg(F.count("*").alias("value"))
    lost = groups.where("not kept").agg(F.lit("skipped.unresolved_ambiguous_group").alias("name"), F.count("*").alias("value"))
    members = groups.where("method = 'scored_resolution' and score <> 0").agg(F.lit("resolution.scored_group_rows").alias("name"), F.coalesce(F.sum("n_candidates"), F.lit(0)).alias("value"))
    counters = reduce(DataFrame.unionByName, (resolved, lost, members)).where("value > 0")
    return enriched.orderBy(F.asc_nulls_first("source_date"), F.asc_nulls_first("claim_id"), "seq"), counters


def gold_pairs(rows: DataFrame) -> DataFrame:
    meta = F.struct("claim_id", F.lit("gold").alias("dataset_tier"), F.lit("deterministic_db_rule").alias("label_source"), "label", "claim_family", "claim_type", "bill_id", "bill_number", "source_statement_id")
    return rows.select(templates.gold_prompt().alias("prompt"), templates.gold_completion().alias("completion"), meta.alias("metadata"))


def gold_stats(rows: DataFrame, counters: DataFrame) -> DataFrame:
    return stats_rows(rows, _label_totals(), ["claim_family", "claim_type", "rule_id", "gold_resolution_method"], counters)


def export_gold(rows: DataFrame, counters: DataFrame, root: str) -> None:
    columns = records.header_union([c for c in rows.columns if c != "seq"], gold.GOLD_COLUMNS)
    sinks.export(rows, root, {"factcheck_gold_master": columns}, gold_pairs(rows), gold_stats(rows, counters).orderBy("section_no", "name"))


# Silver -------------------------------------------------------------------------------------------------------------


def silver_dataset(
    candidates: DataFrame, make: Callable[[], Callable[[Sequence[str]], Sequence[str | None]]], existing: DataFrame | None = None,
    target: int = 150, max_calls: int = 360, priority: str = "middle_first", min_confidence: int = 60, now: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Silver rows, those of earlier runs first, and counters. ``candidates``: from ``silver.candidate_pool``, with
    ``full_context``; ``make`` builds the model's function, which gives null for a call that failed.

    Calls stop as they would one by one, at the target or the number of calls, whichever comes first.
    """
    asked = candidates.orderBy("rn", "claim_type").limit(max_calls * 2).withColumn("source_context_local", X.local_context_v2("full_context", "claim_text", offset_fallback=False))
    prompted = asked.withColumn("prompt", templates.labelling_prompt())
    labelled = cut(silver.label_rows(boundaries.call_model(prompted, "prompt", make), min_confidence=min_confidence, now=now))
    middle = F.col("label").isin(*P.MIDDLE_LABELS)
    counts = middle if priority == "middle_only" else F.col("label").isin(*P.SILVER_LABELS)
    outcomes = labelled.withColumn("error", F.col("answer").isNull()).withColumn("accepted", F.col("reason").isNull() & counts)
    order = ["rn", "claim_type"]
    used = cut(silver.calls_until(outcomes, order, target, max_calls))
    kept = used.where("reason is null")
    fresh = records.by_label_priority(kept, "label", P.MIDDLE_LABELS, P.FALLBACK_LABELS, order, target, priority)
    fresh = cut((fresh.orderBy(*order).limit(target) if priority == "middle_only" else fresh).select(*silver.SILVER_COLUMNS))
    rows = fresh if existing is None else existing.select(*silver.SILVER_COLUMNS).unionByName(fresh)
    new_middle = F.count_if(middle)
    counters = [
        fresh.agg(F.count("*").alias("overall.new_rows"), new_middle.alias("overall.middle_rows"), (F.count("*") - new_middle).alias("overall.fallback_rows")),
        used.agg(F.count_if(~F.col("error")).alias("overall.api_calls"), F.count_if("error").alias("skipped.api_error"), F.count_if(~F.col("error") & F.col("reason").isNotNull()).alias("skipped.filtered_or_rejected")),
    ]
    if existing is not None:
        counters.append(existing.agg(F.count("*").alias("overall.existing_rows")))
    long = [c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value")) for n in c.columns])).alias("r")).select("r.*") for c in counters]
    return rows, reduce(DataFrame.unionByName, long)


def silver_pairs(rows: DataFrame) -> DataFrame:
    meta = F.struct("claim_id", F.lit("silver").alias("dataset_tier"), F.lit("openai_llm").alias("label_source"), "label", "not_binary_reason", "claim_type", "source_statement_id", "model_name")
    return rows.select(templates.silver_prompt().alias("prompt"), templates.silver_completion().alias("completion"), meta.alias("metadata"))


def silver_stats(rows: DataFrame, counters: DataFrame) -> DataFrame:
    return stats_rows(rows, {"total_rows": F.count("*"), "distinct_claim_types": metrics.distinct_with_null("claim_type")}, ["label", "claim_type", "model_name"], counters)


def export_silver(rows: DataFrame, counters: DataFrame, root: str) -> None:
    sinks.export(rows, root, {"liar_silver_master": silver.SILVER_COLUMNS}, silver_pairs(rows), silver_stats(rows, counters).orderBy("section_no", "name"))


# Merge --------------------------------------------------------------------------------------------------------------

TARGETS = {"true": 500, "false": 500}


def merged_dataset(gold_items: DataFrame, silver_items: DataFrame, targets: Mapping[str, int] = TARGETS) -> DataFrame:
    """Silver items, then the selected gold ones: place_no, prompt, completion, metadata, label, claim_type, source_dataset.

    Items: from ``merge.training_items``, with ``metadata`` (a struct) where known.
    """
    chosen = merge.select_balanced(gold_items, silver_items.select("claim_text", "label"), targets)
    labels = list(targets)
    ahead = F.coalesce(*[F.when(F.col("label") == k, n) for n, k in enumerate(labels)])
    first = silver_items.select("pair_id", "prompt", "completion", "label", "claim_type", "claim_text", "source_dataset", F.lit(0).alias("part"), F.lit(0).alias("ahead"), F.col("pair_id").alias("at"))
    second = chosen.select("pair_id", "prompt", "completion", "label", "claim_type", "claim_text", "source_dataset", F.lit(1).alias("part"), ahead.alias("ahead"), F.col("place").cast("long").alias("at"))
    numbered = global_rank(first.unionByName(second), [F.asc("part"), F.asc("ahead"), F.asc("at"), F.asc("pair_id")], "place_no")
    claim = F.coalesce(F.col("claim_text"), merge.prompt_claim("prompt"))
    meta = F.struct(F.col("source_dataset"), F.lower("label").alias("merged_label"), claim.alias("claim_text"))
    return numbered.select("place_no", "pair_id", "prompt", "completion", meta.alias("metadata"), "label", "claim_type", "source_dataset")


def merged_stats(rows: DataFrame) -> DataFrame:
    """Totals, and counts of label, source and claim type, the latter also for each source."""
    wide = rows.select("label", "source_dataset", X.or_empty("claim_type").alias("claim_type"))
    totals = {"total_rows": F.count("*"), "silver_rows": F.count_if(F.col("source_dataset") == "silver"), "selected_gold_rows": F.count_if(F.col("source_dataset") == "gold")}
    whole = stats_rows(wide, totals, ["label", "source_dataset", "claim_type"])
    parts = [metrics.long_counts(wide.where(F.col("source_dataset") == s).select(F.col("claim_type").alias(f"{s}_claim_type")), [f"{s}_claim_type"]).withColumn("section_no", F.lit(n)) for n, s in ((4, "gold"), (5, "silver"))]
    return reduce(DataFrame.unionByName, (whole, *parts))


def export_merged(rows: DataFrame, root: str) -> None:
    sinks.export(rows, root, {}, rows.select("prompt", "completion", "metadata"), merged_stats(rows).orderBy("section_no", "name"))

