import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gavelspark.operators import gold, merge, metrics, ranking, records, references, sampling, silver, votes

AT = dt.datetime


# orphan references


def refs_case(spark, parents, rows):
    p = spark.createDataFrame(parents, "id bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz, extra string")
    r = spark.createDataFrame(rows, "id bigint, ref bigint, loaded_at timestamp_ntz, kind string, bucket int")
    ref = references.Reference("t", "id", "ref", "p")
    found = references.orphan_references(references.referring_rows(r, ref), references.parent_states(p))
    return sorted((x.row_id, x.ref_id, x.kind) for x in found.collect())


def test_orphan_kinds(spark):
    parents = [(1, AT(2020, 1, 1), None, "a"), (2, AT(2020, 1, 1), None, "a"), (2, AT(2021, 1, 1), AT(2021, 1, 1), "a"), (3, AT(2022, 1, 1), None, "a"), (4, AT(2020, 1, 1), AT(2020, 1, 1), ""), (4, AT(2020, 2, 1), None, ""), (None, AT(2020, 1, 1), None, "")]
    rows = [(10, 1, AT(2020, 5, 1), "x", 0), (11, 2, AT(2020, 5, 1), "x", 0), (12, 3, AT(2020, 5, 1), "x", 0), (12, 3, AT(2023, 5, 1), "x", 0), (13, 9, AT(2020, 5, 1), "x", 0), (14, None, AT(2020, 5, 1), "x", 0), (15, -5, None, "x", 0), (16, 4, AT(2020, 5, 1), "x", 0), (17, 3, AT(2023, 1, 1), "x", 0)]
    assert refs_case(spark, parents, rows) == [(11, 2, "deleted"), (12, 3, "late"), (13, 9, "missing"), (15, -5, "missing")]


def test_orphans_of_empty_tables(spark):
    assert refs_case(spark, [], [(1, 7, AT(2020, 1, 1), "x", 0)]) == [(1, 7, "missing")]
    assert refs_case(spark, [(1, AT(2020, 1, 1), None, "")], []) == []


def test_orphans_equal_brute_force(spark):
    rng = random.Random(3)
    parents = [(k, AT(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 500)), AT(2021, 1, 1) if rng.random() < 0.2 else None, "") for k in rng.choices([*range(1, 60), 65535, 65536, 65537, -1, 1 << 40], k=90)]
    rows = [(i, rng.choice([*range(0, 70), 65535, 65536, 65538, -1, -2, 1 << 40]), AT(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 500)), "", 0) for i in range(300)]
    first, last = {}, {}
    for k, at, gone, _ in parents:
        first[k] = min(first.get(k, at), at)
        last[k] = max(last.get(k, (at, False)), (at, gone is not None))
    expected = sorted((i, k, "missing" if k not in first else "deleted" if last[k][1] else "late") for i, k, at, *_ in rows if k not in first or last[k][1] or first[k] > at)
    assert refs_case(spark, parents, rows) == expected


def test_runs_are_contiguous(spark):
    states = spark.createDataFrame([(k, AT(2020, 1, 1), False) for k in (1, 2, 3, 7, 8)] + [(4, AT(2020, 1, 1), True)], "key bigint, first_at timestamp_ntz, gone boolean")
    assert sorted((r["start"], r["end"], r["gone"]) for r in references.key_runs(states).collect()) == [(1, 3, False), (4, 4, True), (7, 8, False)]


# ranks


def test_ranks_are_complete(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(200)], "g int, k bigint")
    for group in range(3):
        got = sorted(r["rank"] for r in ranking.salted_rank(df, ["g"], "k").where(F.col("g") == group).collect())
        assert got == list(range(len(got)))
    totals = ranking.global_rank(df, [F.desc("k")], "rn", total="k").orderBy("rn").collect()
    assert [r["rn"] for r in totals] == list(range(1, 201))
    assert totals[2]["total_before"] == 199 + 198


# records


def test_first_label_and_duplicates(spark):
    rows = [(1, "A.", "True", "e1"), (2, "a", "True", "e2"), (3, "A", "False", "e1"), (4, "a.", "True", "e1"), (5, None, "True", None)]
    df = spark.createDataFrame(rows, "seq bigint, claim_text string, label string, ev string")
    got = {r.seq: r.reason for r in records.first_label(df, "claim_text", "label", ["ev"]).collect()}
    assert got == {1: None, 2: None, 3: "conflict", 4: "duplicate", 5: None}


def test_upsert_keeps_saved_rows(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k bigint, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d"), (None, "m")], "k bigint, v string")
    assert sorted(str(tuple(r)) for r in records.upsert(old, new, "k").collect()) == sorted(map(str, [(1, "a"), (None, "n"), (2, "c"), (2, "d"), (None, "m")]))


def test_header_union():
    assert records.header_union(["a", "b"], ["b", "c"]) == ["a", "b", "c"]


@pytest.mark.parametrize("mode,expected", [("middle_only", 3), ("middle_first", 3), ("all_labels", 2)])
def test_label_priority(spark, mode, expected):
    df = spark.createDataFrame([(1, "half-true"), (2, "half-true"), (3, "pants-fire"), (4, "true")], "seq int, label string")
    assert records.by_label_priority(df, "label", ["half-true", "pants-fire"], ["true"], ["seq"], 2, mode).count() == expected


# votes

PARTIES = [(r"\b(?:conservative party of canada|conservative|conservatives|cpc)\b", 1, "Conservative"), (r"\b(?:liberal|liberals|lpc|lib\.)\b", 2, "Liberal")]


@pytest.mark.parametrize(
    "sentence,bill,reason",
    [
        ("The Liberals voted for it.", "C-1", None),
        ("The Liberals voted for Bill C-2.", "C-1", "bill_number_mismatch"),
        ("The Liberals voted for Bill c-1.", "C-1", None),
        ("The Liberals voted for it and voted against it.", "C-1", "direction_ambiguous"),
        ("The Liberals know voters voted for it.", "C-1", "electorate_language"),
        ("Perhaps the Liberals voted for it.", "C-1", "uncertain_claim_language"),
        ("The Liberals and Conservatives voted for it.", "C-1", "party_ambiguous_or_missing"),
        ("They voted for it.", "C-1", "party_ambiguous_or_missing"),
        ("The Liberals said they voted for it.", "C-1", "party_ambiguous_or_missing"),
        ("The Liberals" + " x" * 39 + " voted for it.", "C-1", None),
        ("The Liberals" + " x" * 40 + " voted for it.", "C-1", "party_ambiguous_or_missing"),
        ("He voted for it, the Liberals said.", "C-1", "party_ambiguous_or_missing"),
    ],
)
def test_rejection_cascade(spark, sentence, bill, reason):
    r, _ = votes.claim_reason(F.col("s"), F.col("b"), PARTIES)
    assert spark.createDataFrame([(sentence, bill)], "s string, b string").select(r.alias("r")).first()["r"] == reason


@pytest.mark.parametrize("sentence,description,cue", [("the motion and report", "a report", "motion"), ("the motion", "the Motion", None), ("the report", "on it", "report"), ("a motion, an amendment", "x", "motion")])
def test_grounding(spark, sentence, description, cue):
    got = spark.createDataFrame([(sentence, description)], "s string, d string").select(votes.ungrounded_object(F.col("s"), F.col("d")).alias("c")).first()["c"]
    assert got == cue


def fact(i, bill, party, day, vote="Y"):
    return (i, i, bill, party, vote, day, "desc", "Liberal")


def test_fact_resolution(spark):
    day = dt.date(2020, 1, 1)
    facts = [fact(1, 1, 2, dt.date(2019, 1, 1)), fact(2, 2, 2, day), fact(3, 2, 2, dt.date(2019, 1, 1)), fact(4, 3, 2, day), fact(5, 3, 2, day), fact(6, 4, 2, dt.date(2018, 1, 1)), fact(7, 4, 2, dt.date(2019, 1, 1))]
    f = spark.createDataFrame(facts, "partyvote_id bigint, votequestion_id bigint, bill_id bigint, party_id bigint, vote string, vote_date date, votequestion_description string, party_name string")
    rows = [(b, b, "C-1", day, "The Liberals voted for it.") for b in range(1, 6)] + [(6, 2, "C-1", None, "The Liberals voted for it."), (7, 1, "C-1", day, "")]
    s = spark.createDataFrame(rows, "statement_id bigint, bill_id bigint, bill_number string, source_date date, source_context string")
    got = {r.statement_id: (r.reason, r.partyvote_id) for r in votes.vote_claims(s, f, PARTIES).collect()}
    assert got == {1: (None, 1), 2: (None, 2), 3: ("ambiguous_vote_fact", None), 4: ("multiple_vote_events", None), 5: ("no_vote_fact", None), 6: ("multiple_vote_events", None), 7: ("empty_source_context", None)}


def test_party_aliases():
    rows = [{"id": 1, "name_en": "Liberal Party of Canada", "short_name_en": "Liberal"}, {"id": 2, "name_en": "The New NDP", "short_name_en": None}]
    assert [(i, n) for _, i, n in votes.party_patterns(rows)] == [(1, "Liberal Party of Canada"), (2, "The New NDP")]


# gold


@pytest.mark.parametrize("days,expected", [(-366, -605), (-1, -241), (0, 180), (1, 179), (180, 0), (181, 0)])
def test_temporal_score(spark, days, expected):
    vote = dt.date(2020, 1, 1)
    row = [(str(vote + dt.timedelta(days=days)), str(vote))]
    score = gold._nearness(F.col("s").cast("date"), F.col("v").cast("date"), 180, 240)
    assert spark.createDataFrame(row, "s string, v string").select(score.alias("x")).first()["x"] == expected


def test_group_resolution(spark):
    rows = [(1, "a", -9), (2, "b", 5), (3, "b", 5), (4, "c", -1), (5, "c", -2), (6, "d", 7), (7, "d", 3), (8, "e", 0), (9, "e", -4)]
    got = {r.g: (r.seq, r.method, r.score, r.kept) for r in gold.resolve_groups(spark.createDataFrame(rows, "seq bigint, g string, score int"), ["g"]).collect()}
    assert got == {"a": (1, "single_candidate", 0, True), "b": (2, "score_tie", 5, False), "c": (4, "negative_best_score", -1, False), "d": (6, "scored_resolution", 7, True), "e": (8, "scored_resolution", 0, True)}


# silver


def test_round_robin(spark):
    rows = [(1, "x", "a", 5), (2, "yy", "a", 5), (3, "z", "a", 5), (4, "w", "b", 1)]
    df = spark.createDataFrame(rows, "seq bigint, claim_text string, claim_type string, score int")
    assert [r.seq for r in silver.diverse(df, 3).orderBy("rn", "claim_type").collect()] == [2, 4, 1]


@pytest.mark.parametrize("amounts,limit,seed,kept", [([5, 1, 1], 5, 0, 1), ([2, 2, 2], 4, 0, 2), ([1, 1, 1], 9, 0, 3), ([1, 1], 4, 4, 1)])
def test_prefix(spark, amounts, limit, seed, kept):
    df = spark.createDataFrame(list(enumerate(amounts)), "i bigint, n bigint")
    assert silver.prefix_until(df, "n", ["i"], limit, seed).count() == kept


GOOD = {"accept": True, "label": "half-true", "confidence": 0.8, "not_binary_reason": "mixed", "rationale": "r", "evidence_summary": "e", "used_sources": [{"title": "t", "url": "https://parl.ca"}]}


@pytest.mark.parametrize(
    "change,reason",
    [({}, None), ({"accept": False}, "not_accepted"), ({"label": "maybe"}, "bad_label"), ({"confidence": 0.5}, "low_confidence"), ({"confidence": None}, None), ({"rationale": " "}, "no_evidence"), ({"evidence_summary": None}, "no_evidence"), ({"used_sources": [{"url": "https://x.com"}]}, "no_official_source"), ({"used_sources": None}, "no_official_source"), ({"not_binary_reason": ""}, "no_middle_reason"), ({"not_binary_reason": "", "label": "True"}, None)],
)
def test_acceptance(spark, change, reason):
    import json

    df = spark.createDataFrame([("c", "1", "2020-01-01", "ctx", json.dumps(GOOD | change))], "claim_text string, statement_id string, date string, source_context_local string, answer string")
    assert silver.label_rows(df).first()["reason"] == reason


# merge


def greedy(target, caps, weights):
    quota = {k: min(caps.get(k, 0), int(target * w)) for k, w in weights.items()}
    left = target - sum(quota.values())
    while left > 0:
        room = [k for k in weights if quota[k] < caps.get(k, 0)]
        if not room:
            break
        best = max(room, key=lambda k: (weights[k], caps.get(k, 0) - quota[k], -list(weights).index(k)))
        quota[best] += 1
        left -= 1
    return quota


def test_quotas_equal_one_by_one_filling():
    rng = random.Random(9)
    for _ in range(2000):
        weights = {"a": rng.choice([0.4, 0.3]), "b": 0.4, "c": 0.2}
        caps = {k: rng.randint(0, 30) for k in weights}
        target = rng.randint(0, 70)
        assert merge.major_quotas(target, caps, weights) == greedy(target, caps, weights)


def test_balanced_selection(spark):
    text = "A claim about Bill C-4 that is long enough to be kept, number {}, in 2021"
    rows = [(i, "p", "c", text.format(i), "party_vote_direction" if i % 2 else "sponsor", "2021-01-01", "true" if i % 3 else "false") for i in range(40)]
    items = spark.createDataFrame(rows, "pair_id bigint, prompt string, completion string, claim_text string, claim_type string, source_date string, label string")
    taken = spark.createDataFrame([(text.format(0), "false"), ("x", "true")], "claim_text string, label string")
    got = merge.select_balanced(items, taken, {"true": 10, "false": 4}).collect()
    assert sum(r.label == "true" for r in got) == 9 and sum(r.label == "false" for r in got) == 3
    assert all(r.claim_type == "sponsor" for r in got) and 0 not in {r.pair_id for r in got}


# metrics and samples


@pytest.mark.parametrize("pairs,accuracy,macro", [([("A", "A"), ("B", "B")], 1.0, 1.0), ([("A", "B"), ("B", "A")], 0.0, 0.0), ([("A", "A"), ("B", "X")], 0.5, 1 / 3), ([], 0.0, 0.0)])
def test_summary(spark, pairs, accuracy, macro):
    r = metrics.summary(spark.createDataFrame(pairs, "a string, p string"), "a", "p").first()
    assert (r.accuracy, round(r.macro_f1, 9)) == (accuracy, round(macro, 9))


def test_stratified_is_exact_and_repeats(spark):
    df = spark.createDataFrame([(i, "x" if i % 4 else "y") for i in range(400)], "i bigint, s string")
    parts = {"train": 0.8, "validation": 0.1, "test": 0.1}
    one, two = (sorted(map(tuple, sampling.stratified(df, ["s"], "i", parts, 7).select("i", "split").collect())) for _ in range(2))
    assert one == two
    counts = {(r.s, r.split): r["count"] for r in sampling.stratified(df, ["s"], "i", parts, 7).groupBy("s", "split").count().collect()}
    assert counts == {("x", "train"): 240, ("x", "validation"): 30, ("x", "test"): 30, ("y", "train"): 80, ("y", "validation"): 10, ("y", "test"): 10}


def test_top_k_ties_and_nulls(spark):
    from gavelspark.operators import retrieval

    base = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "id bigint, vector array<double>")
    query = spark.createDataFrame([(9, [1.0, 0.0])], "query_id bigint, vector array<double>")
    assert [(r.id, r.rn) for r in retrieval.top_k(base, query, 2).orderBy("rn").collect()] == [(1, 1), (2, 2)]
    assert retrieval.top_k(base.limit(0), query, 2).count() == 0
    assert retrieval.top_k(base, query.limit(0), 2).count() == 0
