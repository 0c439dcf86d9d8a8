"""The silver pipeline: candidate claims, selection, label acceptance and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.functions import patterns as P
from gavelspark.functions import text as X
from gavelspark.functions.values import claim_id, percent, provenance, tolerant_json
from gavelspark.operators.ranking import global_rank, top_by
from gavelspark.operators.records import distinct_claims, without_claims

PAYLOAD = (
    "accept boolean, label string, confidence double, not_binary_reason string, rationale string, evidence_summary string, "
    "used_sources array<struct<title:string,url:string,source_type:string,why_relevant:string>>, reason string"
)


def recent_statements(statements: DataFrame, since: str | None, limit: int) -> DataFrame:
    """The newest statements that are not procedural (unknown counts as not), with text, newest first."""
    rows = statements.where(~F.coalesce("procedural", F.lit(False))).where("content_en is not null and content_en <> ''")
    if since:
        rows = rows.where(F.col("time") >= F.lit(since).cast("timestamp_ntz"))
    return rows.orderBy(F.to_date("time").desc_nulls_first(), F.asc_nulls_last("sequence"), "id").limit(limit)


def candidate_claims(statements: DataFrame) -> DataFrame:
    """Usable sentences of each statement with its context. ``statements``: id, content, who_en, and context columns."""
    plain = X.strip(X.untag(X.or_empty("content_en")))
    sentences = F.filter(X.split_sentences(plain), X.usable_claim)
    rows = statements.select(F.col("id").alias("statement_id"), "document_id", F.to_date("time").cast("string").alias("date"), F.col("who_en").alias("speaker"), "h1_en", "h2_en", "h3_en", F.posexplode(sentences).alias("pos", "claim_text"))
    kinded = rows.withColumn("claim_type", X.claim_type("claim_text"))
    return kinded.withColumn("score", X.candidate_score("claim_text", "claim_type"))


def diverse(candidates: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """``n`` candidates taken in turn from the claim types in alphabetical order, the best of each type first.

    Only the first ``n`` of each type can be chosen, so each task keeps no more than that.
    """
    best = top_by(candidates, ["claim_type"], [F.desc("score"), F.length("claim_text").desc(), F.col(seq)], n)
    return best.orderBy("rn", "claim_type").limit(n)


def prefix_until(rows: DataFrame, amount: str, order: Sequence, limit: int, seed: int = 0) -> DataFrame:
    """Rows consumed in order until ``seed`` and the amounts so far reach ``limit``; tested after each row, so the first
    is always kept and the one that crosses the limit too."""
    ranked = global_rank(rows, order, "rn", total=amount)
    return ranked.where((F.col("rn") == 1) | (F.col("total_before") + F.lit(seed) < limit)).drop("total_before")


def calls_until(outcomes: DataFrame, order: Sequence, target: int, max_calls: int) -> DataFrame:
    """Outcomes (``accepted``, ``error``) used before the target of accepted rows or of calls was reached; an error is
    no call."""
    counted = outcomes.withColumn("_a", F.col("accepted").cast("long")).withColumn("_c", (~F.col("error")).cast("long"))
    by_accept = global_rank(counted, order, "_call", total="_a").where(F.col("total_before") < target).drop("total_before", "_call")
    return global_rank(by_accept, order, "_call", total="_c").where(F.col("total_before") < max_calls).drop("total_before", "_call", "_a", "_c")


def candidate_pool(seeds: DataFrame, statements: DataFrame, taken: DataFrame, n: int) -> DataFrame:
    """Seeds first; if fewer than ``n`` distinct untaken ones are left, sentences of as many statements as are needed
    for four times ``n``; then the distinct untaken claims, chosen in turn by type.

    ``seeds``: the columns of ``candidate_claims`` with a whole number ``seq``; the result's ``seq`` is a struct, seeds before
    sentences, these by statement and place.
    """
    seeds = seeds.withColumn("seq", F.struct(F.lit(0).alias("part"), F.col("seq").cast("long").alias("at"), F.lit(0).cast("long").alias("pos")))
    kept = without_claims(distinct_claims(seeds), taken)
    have = kept.count()
    if have < n:
        found = candidate_claims(statements)
        per = found.groupBy("statement_id").agg(F.count("*").alias("_n"))
        used = prefix_until(per, "_n", ["statement_id"], 4 * n, have).select("statement_id")
        more = found.join(used, "statement_id", "left_semi").withColumn("seq", F.struct(F.lit(1).alias("part"), F.col("statement_id").alias("at"), F.col("pos").cast("long").alias("pos")))
        kept = without_claims(distinct_claims(seeds.unionByName(more, allowMissingColumns=True)), taken)
    return diverse(kept, n)


def acceptance(payload: Column, statement: Column | str, min_confidence: int) -> Column:
    """Why a label payload is refused, by the first guard that fails; null if it is accepted."""
    label = F.lower(X.strip(X.or_empty(payload["label"])))
    confidence = percent(payload["confidence"])
    sources = provenance(statement, payload["used_sources"])
    return (
        F.when(payload.isNull() | ~F.coalesce(payload["accept"], F.lit(False)), "not_accepted")
        .when(~label.isin(*P.SILVER_LABELS), "bad_label")
        .when(confidence < min_confidence, "low_confidence")
        .when((X.spaces(X.or_empty(payload["rationale"])) == "") | (X.spaces(X.or_empty(payload["evidence_summary"])) == ""), "no_evidence")
        .when(~F.exists(sources, lambda s: s["url"] != ""), "no_official_source")
        .when(label.isin(*P.MIDDLE_LABELS) & (X.spaces(X.or_empty(payload["not_binary_reason"])) == ""), "no_middle_reason")
    )


#: Columns of a silver row, in order.
SILVER_COLUMNS = (
    "claim_id", "claim_text", "source_context", "source_context_local", "source_speaker", "source_date", "source_session", "source_document_id", "source_statement_id",
    "source_topic_h1", "source_topic_h2", "source_topic_h3", "claim_type", "label", "dataset_tier", "label_source", "label_rationale", "not_binary_reason", "label_confidence",
    "evidence_text", "evidence_provenance_json", "model_name", "prompt_version", "generated_at", "notes",
)
#: What every silver row says of its making.
SILVER_FIXED = {"dataset_tier": "silver", "label_source": "openai_llm", "prompt_version": "liar_silver_v2_middle_first", "notes": "Silver / LLM-labeled. Non-deterministic."}


def label_rows(candidates: DataFrame, answer: str = "answer", min_confidence: int = 60, model: str = "model", now: Column | None = None) -> DataFrame:
    """Candidates with a raw answer as silver rows of ``SILVER_COLUMNS``, all strings; refused ones keep their ``reason``.

    ``candidates``: claim_text, statement_id, date, source_context_local, and where known full_context, speaker, session,
    document_id, h1_en, h2_en, h3_en, claim_type and model; other columns are kept. Missing values are empty.
    """
    p, known = F.col("_p"), set(candidates.columns)
    given = lambda c: X.or_empty(F.col(c).cast("string")) if c in known else F.lit("")
    parsed = candidates.withColumn("_p", tolerant_json(answer, PAYLOAD)).withColumn("reason", acceptance(p, "statement_id", min_confidence))
    local, summary = given("source_context_local"), X.or_empty(p["evidence_summary"])
    both = F.concat(F.lit("Hansard context: "), local, F.lit(" Official evidence: "), summary)
    columns = {
        "claim_id": claim_id("claim_text", given("statement_id"), given("date")), "source_context": given("full_context"), "source_speaker": given("speaker"), "source_date": given("date"),
        "source_session": given("session"), "source_document_id": given("document_id"), "source_statement_id": given("statement_id"),
        "source_topic_h1": given("h1_en"), "source_topic_h2": given("h2_en"), "source_topic_h3": given("h3_en"), "claim_type": X.or_else(given("claim_type"), "general"),
        "label": F.lower(X.strip(p["label"])), "label_rationale": X.trim_hard(p["rationale"], 320), "not_binary_reason": X.trim_hard(p["not_binary_reason"], 220),
        "label_confidence": X.or_empty(percent(p["confidence"]).cast("string")), "evidence_text": X.trim_hard(F.when((summary != "") & (local != ""), both).otherwise(X.or_else(summary, local)), 900),
        "evidence_provenance_json": F.to_json(provenance(given("statement_id"), p["used_sources"])), "model_name": given(model),
        "generated_at": F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "source_context_local": local,
        **{k: F.lit(v) for k, v in SILVER_FIXED.items()},
    }
    rest = [c for c in candidates.columns if c not in SILVER_COLUMNS]
    return parsed.withColumns(columns).select(*SILVER_COLUMNS, *rest, "reason")
