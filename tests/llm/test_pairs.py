import pytest
from pyspark.sql import functions as F

from gavelspark.llm import pairs

PROMPT = 'Check the claim below.\n\nClaim: "The Green League voted for Bill C-12 at division 7."\nSpeaker: A B\n\nContext: The office tabled a study of the old water mains without any delay at all. It was late.\n\nEvidence: In division 7 on C-12 the Green League voted against.\n\nGive VERDICT, CONFIDENCE, EXPLANATION and CORRECTION.'
SOUND = "VERDICT: FALSE\nCONFIDENCE: 90\nEXPLANATION: The record shows that the Green League voted against it.\nCORRECTION: The Green League voted against C-12."


@pytest.mark.parametrize(
    "answer,defect",
    [
        (None, "empty"), ("", "empty"), (" \n", "empty"), ("​", "empty"), ("<p></p>", "empty"), ("...", "empty"), ("N/A", "empty"), ("VERDICT: \nCONFIDENCE: \nEXPLANATION: \nCORRECTION: ", "empty"),
        (SOUND, None), (SOUND.replace("\n", "\r\n\r\n"), None), ("VERDICT: TRUE\nCONFIDENCE: 90\nEXPLANATION: Voted for, division 7.\nCORRECTION: N/A", None),
        (SOUND.replace("The record shows", "The minister declined to comment, but the record shows"), None),
        (SOUND.replace("voted against it.", "voted against it. One said: « Le comité a demandé une étude »."), None),
        (SOUND.replace("The record", 'He said "The Green League voted for Bill C-12 at..." but the record'), None),
        ("I'm sorry, but I can't help with that request.", "refusal"), ("VERDICT: N/A\nCONFIDENCE: 0\nEXPLANATION: My guidelines do not allow me to rate this.\nCORRECTION: N/A", "refusal"), ("Let's talk about something else instead.", "refusal"),
        (PROMPT, "copy"), ("The Green League voted for Bill C-12 at division 7.", "copy"), ("Answer: THE GREEN LEAGUE VOTED FOR BILL C-12 AT DIVISION 7.", "copy"),
        ("VERDICT: FALSE\nCONFIDENCE: 90\nEXPLANATION: The office tabled a study of the old water mains without any delay at all.\nCORRECTION: N/A", "copy"),
        ("VERDICT: FALSE\nCONFIDENCE: 90\nEXPLANATION: Le registre du vote contredit cette affirmation au sujet du projet de loi.\nCORRECTION: S. O.", "language"),
        ("VERDICT: TRUE\nCONFIDENCE: 90\nEXPLANATION: El registro de la votación confirma lo que dijo la persona sobre el proyecto.\nCORRECTION: No corresponde.", "language"),
        ("漁村の皆様を代表して発言します。", "language"),
        ("VERDICT:", "empty"), ("VERDICT: TRUE\nCONFID", "truncated"), ("VERDICT: TRUE\nCONFIDENCE: 90\nEXPLANATION: Voted agai", "truncated"), (SOUND[: SOUND.index("CORRECTION")], "truncated"),
    ],
)
def test_rules(answer, defect):
    assert pairs.judge(PROMPT, answer, False, False, False) == defect


@pytest.mark.parametrize("answer", ["Paris.", "The answer is 42 because six times seven is forty-two."])
def test_an_answer_to_another_question_is_no_refusal(answer):
    assert pairs.judge("What is it? Explain in one line to the class.", answer, False, False, False) is None
    assert pairs.judge(PROMPT, answer, False, False, False) == "refusal"  # the verdict asked for is not given


@pytest.mark.parametrize("text,language", [("Det här är en mening om broar som ingen har byggt åt byn ännu idag", "other"), ("To jest zdanie po polsku o moście który nie został jeszcze zbudowany przez nikogo", "other"), ("Bu köprünün ne zaman onarılacağını bakan henüz kimseye söylemedi bugün", "other"), ("The office tabled a study of the old water mains", "en"), ("Voted for, division 7.", "en"), ("7.", None)])
def test_languages_without_a_list(text, language):
    from gavelspark.llm import languages

    assert languages.guess(text) == language


def test_null_prompt_never_copies():
    assert pairs.judge(None, SOUND, False, False, False) is None


def test_shortened_versions(spark):
    rows = [("a b",), ("a b c",), ("a b c",), ("b",), (None,), ("",), ("z",)]
    assert sorted(r.t for r in pairs.shortened(spark.createDataFrame(rows, "t string")).collect()) == ["a b"]
    assert pairs.shortened(spark.createDataFrame([], "t string")).count() == 0


def test_shortened_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    texts = {"".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))) for _ in range(400)}
    expected = sorted(t for t in texts if any(u != t and u.startswith(t) for u in texts))
    assert sorted(r.t for r in pairs.shortened(spark.createDataFrame([(t,) for t in texts], "t string")).collect()) == expected


def test_correction_cut_short_is_found_by_its_neighbours(spark):
    rows = [(i, PROMPT, SOUND.replace("90", str(90 + i % 5))) for i in range(20)] + [(99, PROMPT, SOUND[:-9])] + [(100, PROMPT, SOUND[:-2])]
    got = {r.pair_id: r.defect for r in pairs.defective_pairs(spark.createDataFrame(rows, "pair_id bigint, prompt string, completion string")).collect()}
    assert got == {99: "truncated", 100: "truncated"}


def test_correction_cut_inside_not_applicable_is_found(spark):
    sound = "VERDICT: TRUE\nCONFIDENCE: 90\nEXPLANATION: The record of division {} shows it.\nCORRECTION: {}"
    ends = ["N/A"] * 6 + ["S. O."] * 6 + ["N", "N/", "S."]
    words = "seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty".split()
    rows = [(i, PROMPT, sound.format(w, e)) for i, (w, e) in enumerate(zip(words, ends, strict=True))]
    got = {r.pair_id: r.defect for r in pairs.defective_pairs(spark.createDataFrame(rows, "pair_id bigint, prompt string, completion string")).collect()}
    assert got == {12: "truncated", 13: "truncated", 14: "truncated"}


def test_length_limit(spark):
    rows = [("x" * n + ".", n) for n in range(30, 70)] + [("y" * 50 + str(i) + "z" * (46 - len(str(i))), 100 + i) for i in range(40)]
    few = [(t, f) for t, f in rows if f < 108]
    stock = [("TRUE", 500)] * 60 + [("N/A so far", 501)] * 60
    frame = lambda r: spark.createDataFrame(r, "text string, form long").where(pairs.unfinished(F.col("text"))).select(F.length("text").alias("n"), "form")
    assert [r.n for r in pairs.limit_lengths(frame(rows)).collect()] == [96] and [r.n for r in pairs.limit_lengths(frame(few + stock)).collect()] == [96]
    assert pairs.limit_lengths(frame([(t, f) for t, f in rows if f < 103] + stock)).count() == 0


def test_empty_table(spark):
    assert pairs.defective_pairs(spark.createDataFrame([], "pair_id bigint, prompt string, completion string")).count() == 0
