"""The pipelines as a whole, on fixtures small enough to follow by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gavelspark.operators import merge, silver, votes
from gavelspark.plans import pipelines
from gavelspark.sources import readers

DAY = dt.date(2020, 1, 30)
PARTIES = [(8, "River Union"), (9, "Green League")]


@pytest.fixture(scope="module")
def vote_input(spark):
    facts = [(100 + n, 50, 7, p, name, v, DAY, "Second reading", "C-12", "An Act", "44-1", 44, 1, "Y", 120, 80) for n, ((p, name), v) in enumerate(zip(PARTIES, "YN", strict=True))]
    facts = spark.createDataFrame(facts, "partyvote_id bigint, votequestion_id bigint, bill_id bigint, party_id bigint, party_name string, vote string, vote_date date, votequestion_description string, bill_number string, bill_title string, session_id string, parliamentnum int, sessnum int, vote_result string, yea_total int, nay_total int")
    texts = [
        "We met. The River Union voted for Bill C-12. It was late.", "The Green League voted for Bill C-12.", "The River Union voted for Bill C-99.", "",
        "The River Union voted for Bill C-12.", "Maybe the River Union voted for it.",
    ]
    said = spark.createDataFrame([(k, 70 + k, DAY if k else None, "Ann Bell (Green)", 7, t, "C-12") for k, t in enumerate(texts)], "statement_id bigint, document_id bigint, source_date date, who_en string, bill_id bigint, source_context string, bill_number string")
    patterns = [(rf"\b(?:{name})\b", i, name) for i, name in PARTIES]
    return said, facts, patterns


def test_vote_dataset(vote_input):
    rows, counters = pipelines.vote_dataset(*vote_input, now=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = {r.claim_id: r for r in rows.collect()}
    # the statement without a date comes last and repeats the claim of an earlier one
    assert {k: (r.claim_text, r.label, r.source_statement_id) for k, r in got.items()} == {"claim-1": ("The Green League voted for Bill C-12.", "False", "1"), "claim-2": ("The River Union voted for Bill C-12.", "True", "4")}
    assert set(votes.MASTER_COLUMNS) < set(rows.columns) and len(votes.MASTER_COLUMNS) == 47
    r = got["claim-1"]
    assert r.contradiction_field == "vote_direction" and r.verdict_relation == "CONTRADICTED" and r.source_party == "Green" and r.parliament_number == "44" and r.generated_at.startswith("2024-01-01T00:00:00")
    assert json.loads(r.evidence_primary_ids) == {"bill_id": 7, "party_id": 9, "partyvote_id": 101, "votequestion_id": 50} and json.loads(r.evidence_json)["vote_date"] == "2020-01-30"
    assert r.evidence_text == 'House vote question: "Second reading" The Green League voted against on 2020-01-30.'
    names = {c.name: c.value for c in counters.collect()}
    assert names == {"candidate.statements": 6, "candidate.sentences": 5, "skipped.bill_number_mismatch": 1, "skipped.empty_source_context": 1, "skipped.uncertain_claim_language": 1, "unresolved.statements": 2, "skipped.duplicate_claim_evidence": 1}


def test_synthetic_rows_and_statement_limit(vote_input):
    rows, counters = pipelines.vote_dataset(*vote_input, ratio=1.0)
    made = [r for r in rows.collect() if r.claim_origin == "synthetic_fallback"]
    assert [(r.claim_id, r.label, r.claim_text, r.source_table) for r in made] == [("claim-synth-1", "False", "The River Union voted against Bill C-12.", "synthetic_from_public.hansards_statement")]
    assert {c.name: c.value for c in counters.collect()}["generated.synthetic_false_rows"] == 1
    assert pipelines.vote_dataset(*vote_input, statement_limit=1)[0].count() == 1


def test_vote_export(spark, vote_input, tmp_path):
    rows, counters = pipelines.vote_dataset(*vote_input)
    pipelines.export_votes(rows, counters, str(tmp_path))
    assert readers.read_csv(spark, str(tmp_path / "factcheck_master")).columns == list(votes.MASTER_COLUMNS)
    assert readers.read_csv(spark, str(tmp_path / "factcheck_claim_evidence_explanation")).columns == ["claim_text", "evidence_text", "label", "explanation"]
    stats = {(r["category"], r["name"]): r["value"] for r in readers.read_csv(spark, str(tmp_path / "stats")).collect()}
    assert stats["overall", "total_rows"] == "2" and stats["overall", "false_rows"] == "1" and stats["skipped", "bill_number_mismatch"] == "1" and stats["rule_id", votes.MASTER_FIXED["rule_id"]] == "2"
    assert spark.read.json(str(tmp_path / "pairs")).select("metadata.claim_id").count() == 2


def test_invalid_rows_are_refused(vote_input):
    rows, _ = pipelines.vote_dataset(*vote_input)
    with pytest.raises(ValueError, match="bad_label"):
        votes.require_valid(rows.withColumn("label", F.lit("Maybe")), votes.REQUIRED)


def test_gold_dataset(spark, vote_input, tmp_path):
    master = pipelines.vote_dataset(*vote_input)[0].withColumn("seq", F.monotonically_increasing_id())
    twice = master.unionByName(master.withColumn("seq", F.col("seq") + 1000).where("claim_id = 'claim-1'").withColumn("bill_id", F.lit("8")))
    statements = spark.createDataFrame([(1, 8, "44-1")], "id bigint, bill_debated_id bigint, session_id string")
    bills = spark.createDataFrame([(7, DAY, DAY), (8, DAY, DAY)], "id bigint, introduced date, latest_debate_date date")
    rows, counters = pipelines.gold_dataset(twice, statements, bills)
    got = {r.claim_id: (r.bill_id, r.gold_resolution_method, r.source_bill_debated_id) for r in rows.collect()}
    assert got == {"claim-1": ("8", "scored_resolution", "8"), "claim-2": ("7", "single_candidate", "")}
    assert {c.name: c.value for c in counters.collect()} == {"resolution.scored_resolution": 1, "resolution.single_candidate": 1, "resolution.scored_group_rows": 2}
    pipelines.export_gold(rows, counters, str(tmp_path))
    assert "gold_resolution_score" in readers.read_csv(spark, str(tmp_path / "factcheck_gold_master")).columns
    tie = master.unionByName(master.withColumn("seq", F.col("seq") + 1000))
    assert pipelines.gold_dataset(tie, statements, bills)[0].count() == 0


ACCEPTED = '{"accept": true, "label": "%s", "confidence": 0.9, "not_binary_reason": "r", "rationale": "a", "evidence_summary": "b", "used_sources": [{"title": "t", "url": "https://www.parl.ca/x"}]}'


def test_silver_dataset(spark, tmp_path):
    rows = [(k, "general", f"claim {k}", k, f"2020-01-0{k}", f"Before. claim {k}. After.", "Ann", None, None) for k in range(1, 8)]
    pool = spark.createDataFrame(rows, "rn int, claim_type string, claim_text string, statement_id bigint, date string, full_context string, speaker string, h1_en string, h2_en string")

    def make():
        answers = {"1": None, "2": ACCEPTED % "true", "3": ACCEPTED % "half-true", "4": '{"accept": false}', "5": ACCEPTED % "barely-true", "6": ACCEPTED % "false", "7": ACCEPTED % "true"}
        return lambda prompts: [answers[p.split("Claim:\nclaim ")[1][0]] for p in prompts]

    got, counters = pipelines.silver_dataset(pool, make, target=3)
    assert got.columns == list(silver.SILVER_COLUMNS) and len(got.columns) == 25
    claims = lambda rows: sorted(r.claim_text for r in rows.collect())
    assert claims(got) == ["claim 2", "claim 3", "claim 5"] and {r.source_context_local for r in got.collect()} == {f"Before. claim {k}. After." for k in (2, 3, 5)}
    assert {c.name: c.value for c in counters.collect()} == {"overall.new_rows": 3, "overall.middle_rows": 2, "overall.fallback_rows": 1, "overall.api_calls": 4, "skipped.api_error": 1, "skipped.filtered_or_rejected": 1}
    again, _ = pipelines.silver_dataset(pool, make, got, target=1, priority="middle_only")
    assert claims(again) == ["claim 2", "claim 3", "claim 3", "claim 5"]
    assert claims(pipelines.silver_dataset(pool, make, max_calls=2)[0]) == ["claim 2", "claim 3"]
    pipelines.export_silver(got, counters, str(tmp_path))
    stats = {(r["category"], r["name"]): r["value"] for r in readers.read_csv(spark, str(tmp_path / "stats")).collect()}
    assert stats["label", "half-true"] == "1" and stats["overall", "api_calls"] == "4"


def test_merged_dataset(spark, tmp_path):
    text = "The committee heard %s that the bridge was closed for the whole of the year."
    pairs = spark.createDataFrame([(k, "p", f"VERDICT: {'TRUE' if k % 2 else 'FALSE'}\n", f"c{k}") for k in range(8)], "pair_id bigint, prompt string, completion string, claim_id string")
    masters = spark.createDataFrame([(k, f"c{k}", text % k, "status_snapshot", "2021-01-01") for k in range(8)], "seq bigint, claim_id string, claim_text string, claim_type string, source_date string")
    gold_items = merge.training_items(pairs, masters, "gold")
    silver_items = merge.training_items(pairs.where("pair_id < 2"), masters, "silver").withColumn("pair_id", F.col("pair_id") + 100)
    rows = pipelines.merged_dataset(gold_items, silver_items, {"true": 3, "false": 2})
    got = [(r.place_no, r.pair_id, r.label, r.source_dataset, r.metadata.merged_label) for r in rows.orderBy("place_no").collect()]
    assert got == [(1, 100, "false", "silver", "false"), (2, 101, "true", "silver", "true"), (3, 3, "true", "gold", "true"), (4, 5, "true", "gold", "true"), (5, 2, "false", "gold", "false")]
    pipelines.export_merged(rows, str(tmp_path))
    stats = {(r["category"], r["name"]): r["value"] for r in readers.read_csv(spark, str(tmp_path / "stats")).collect()}
    assert stats["overall", "selected_gold_rows"] == "3" and stats["silver_claim_type", "status_snapshot"] == "2" and stats["gold_claim_type", "status_snapshot"] == "3"


def test_empty_inputs(spark, vote_input):
    said, facts, patterns = vote_input
    rows, counters = pipelines.vote_dataset(said.limit(0), facts.limit(0), patterns, 1.0)
    assert rows.count() == 0 and pipelines.vote_stats(rows, counters).where("category = 'overall'").count() == 3
