import pytest

from gavelspark.llm import overlap

BASE = 'Check this.\n\nClaim: "The Green League voted for Bill C-12 at division 7710."\nSpeaker: Ann Bell\nDate: 2020-01-30\nBill: C-12\nNamed party: Green League\nDivision: 7710\n\nContext: The harbour office tabled a study of the old water mains before the spring sitting closed. Nobody in the northern towns was told of its costs.\n\nEvidence: In division 7710 on C-12 the Green League voted for; the count was 120 to 80.\n\nReply with VERDICT, CONFIDENCE, EXPLANATION and CORRECTION.'
YES = "VERDICT: TRUE\nCONFIDENCE: 90\nEXPLANATION: The record shows it.\nCORRECTION: N/A"
NO = YES.replace("TRUE", "FALSE")


@pytest.mark.parametrize(
    "prompt,answer,same",
    [
        (BASE, YES, True), (BASE.upper(), YES, True), (BASE.replace("2020-01-30", "January 30, 2020"), YES, True), (BASE.replace("harbour office", "harbuor office"), YES, True),
        (BASE.replace("tabled", "presented"), YES, True), (BASE.replace(" Nobody", " I thank my colleague. Nobody"), YES, True), (BASE.replace("Check this.", "Assess the claim."), YES.replace("90", "70"), True),
        (BASE, NO, False), (BASE.replace("voted for Bill", "voted against Bill"), YES, False), (BASE.replace("Green League", "River Union"), YES, False), (BASE.replace("7710", "7711"), YES, False),
        (BASE.replace("C-12", "C-13"), YES, False), (BASE.replace("Ann Bell", "Carl Dunn"), YES, False), (BASE.replace("2020-01-30", "2020-02-28"), YES, False),
        (BASE.replace("The harbour office tabled a study of the old water mains before the spring sitting closed. Nobody in the northern towns was told of its costs.", "Seventeen ferries stopped running when winter came early to all our islands, said every mayor."), YES, False),
    ],
)
def test_same_record(prompt, answer, same):
    assert overlap.same_record(BASE, YES, prompt, answer) is same


def table(spark, rows):
    return spark.createDataFrame(rows, "pair_id bigint, prompt string, completion string, split string, term string")


def test_copies_and_splits(spark):
    other = BASE.replace("7710", "8899").replace("Ann Bell", "Carl Dunn").replace("C-12", "C-77")
    rows = [(1, BASE, YES, "train", ""), (2, BASE, YES, "test", ""), (3, BASE.upper(), YES, "train", ""), (4, BASE.replace("tabled", "presented"), YES, "validation", ""), (5, other, NO, "test", ""), (6, None, None, "train", ""), (7, None, None, "test", ""), (8, "", "", "test", ""), (9, BASE, NO, "test", "")]
    rows += [(100 + i, f"Words of record {i} number {i * 7} and {i * 13}", f"VERDICT: TRUE {i}", "train", "") for i in range(40)]
    got = {(r.pair_id_a, r.pair_id_b) for r in overlap.overlaps(table(spark, rows)).collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (3, 4)}


def test_empty(spark):
    assert overlap.overlaps(table(spark, [])).count() == 0


def test_lists_lose_no_pair_of_the_cosine(spark):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(70):
        prompt = BASE.replace("7710", str(7710 + rng.randrange(3))).replace("2020-01-30", rng.choice(["2020-01-30", "2020-02-28"])).replace("voted for Bill", rng.choice(["voted for Bill", "voted against Bill"]))
        prompt = rng.choice([prompt, prompt.replace("Date:", "Day:"), prompt.replace("Claim:", ""), prompt.replace("harbour office", "northern towns")])
        rows.append((i, prompt, rng.choice([YES, NO]), rng.choice(["train", "test"]), ""))
    vectors = []
    for i, p, a, split, _ in rows:
        vectors += [(i, k, d, c, split == "train", split != "train") for k, d, c in overlap.record_keys(p, a)]
    frame = spark.createDataFrame(vectors, "class bigint, key string, day string, claimed boolean, in_train boolean, in_held boolean")
    got = {(r.train_class, r.held_class) for r in overlap.listed_pairs(frame).collect()}
    dated = {(i, k): (d, c) for i, k, d, c, _, _ in vectors}
    assert got
    for i, p, a, s, _ in rows:
        for j, q, b, t, _ in rows:
            if s == "train" and t == "test" and (i, j) not in got:
                for k in {k for k, _, _ in overlap.record_keys(p, a)}:
                    for m in {m for m, _, _ in overlap.record_keys(q, b)}:
                        apart = k == m and (dated[i, k][0] and dated[j, m][0] and dated[i, k][0] != dated[j, m][0] or k.startswith("prompt|") and dated[i, k][1] and dated[j, m][1])
                        assert apart or overlap.cosine(overlap.record_vector(p, k), overlap.record_vector(q, m)) < overlap.THRESHOLD
    for p in (BASE, "no claim"):
        for k, _, _ in overlap.record_keys(p, YES):
            assert abs(overlap.cosine(overlap.record_vector(p, k), overlap.record_vector(p, k)) - 1) < 1e-9


def test_copies_are_not_multiplied_out(spark):
    rows = [(i, BASE, YES, "train" if i % 2 else "test", "") for i in range(60)] + [(100, BASE.replace("tabled", "presented"), YES, "test", "")]
    got = {r.pair_id: (r["class"], r.n_links) for r in overlap.overlap_links(table(spark, rows)).collect()}
    assert len(got) == 61 and got[1] == (0, 2) and got[0] == (0, 1) and got[100] == (100, 1)
    pairs = table(spark, rows).withColumnRenamed("term", "source_dataset")
    assert [(r.split, r.n_records) for r in overlap.overlap_report(pairs).collect()] == [("test", 31)]


def test_same_record_far_below_any_cosine_is_found(spark):
    # words that do not matter, misspelt ones and an added sentence are rare, and weigh the more the larger the corpus
    evidence = BASE[BASE.index("Evidence:") : BASE.index("\n\nReply")]
    other = BASE.replace(evidence, "Evidence: Quarterly herring landings rebounded near Skorvane while beekeepers, glaziers and millwrights petitioned for cheaper lanterns.")
    other = other.replace("Check this.", "Kindly weigh what follows.").replace("harbour", "harbuor").replace("tabled", "tablde").replace("Nobody", "I rise gratefully, honoured constituents. Nobody")
    rows = [(1, BASE, YES, "train", ""), (2, other, YES, "test", "")]
    rows += [(100 + i, f'Claim: "The Green League voted for Bill C-12 at division {i}."\nSpeaker: Ann Bell\nDate: 2020-01-30\nContext: The office tabled a study of the old water mains before the spring sitting closed.', YES, "train", "") for i in range(200)]
    assert overlap.same_record(BASE, YES, other, YES)
    assert [tuple(r) for r in overlap.overlaps(table(spark, rows)).collect()] == [(1, 2)]


def test_keys_lose_no_pair_of_the_exact_check(spark):
    forms = [BASE, BASE.upper(), BASE.replace("2020-01-30", "January 30, 2020"), BASE.replace("2020-01-30", "30/01/2020"), BASE.replace("2020-01-30", "01/30/2020"), BASE.replace("Date: 2020-01-30\n", ""), BASE.replace("Claim:", "Affirmation :"), BASE.replace("Claim:", ""), BASE.replace("Claim:", "").replace("tabled", "tabeld"), BASE.replace("voted for Bill", "voted against Bill"), BASE.replace("7710", "7711"), BASE.replace("harbour", "harbuor"), "", "Weigh this one", "Weigh this noe", None]
    records = [(p, a) for p in forms for a in (YES, NO, None)]
    rows = [(2 * i + held, p, a, "test" if held else "train", "") for i, (p, a) in enumerate(records) for held in (0, 1)]
    got = {(r.pair_id_a, r.pair_id_b) for r in overlap.overlaps(table(spark, rows)).collect()}
    same = {(i, j) for i, (p, a) in enumerate(records) for j, (q, b) in enumerate(records) if overlap.same_record(p, a, q, b)}
    assert {(min(2 * i, 2 * j + 1), max(2 * i, 2 * j + 1)) for i, j in same} <= got
