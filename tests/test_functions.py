"""One row for every branch of the text and value rules, with the values that the rules give."""

import re

import pytest
from pyspark.sql import functions as F

from gavelspark.functions import patterns as P
from gavelspark.functions import text as X
from gavelspark.functions import values as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("text,limit,expected", [("a b c", 5, "a b c"), ("abc def ghi", 9, "abc..."), ("abcdefghijk", 8, "abcde..."), ("ab,; cdefgh", 8, "ab...")])
def test_trim_at_words(spark, text, limit, expected):
    assert one(spark, text, lambda c: X.trim_words(c, limit)) == expected


@pytest.mark.parametrize("text,expected", [("x" * 10, "x" * 10), ("x" * 11, "x" * 9 + "..."), (None, ""), ("  a  b ", "a b")])
def test_trim_hard_may_be_two_longer(spark, text, expected):
    assert one(spark, text, lambda c: X.trim_hard(c, 10)) == expected


@pytest.mark.parametrize("text,expected", [("We  Vote.", "we vote"), ("end..", "end."), ("end .", "end")])
def test_claim_key_drops_one_period(spark, text, expected):
    assert one(spark, text, X.claim_key) == expected


@pytest.mark.parametrize("text,expected", [("A <b>x</b>y z", "A x y z"), (None, ""), ("", "")])
def test_clean(spark, text, expected):
    assert one(spark, text, X.clean) == expected


@pytest.mark.parametrize("text,expected", [("a &amp; b&#39;c", "a b&#39;c")])
def test_named_entities_only(spark, text, expected):
    assert one(spark, text, X.clean_html) == expected


@pytest.mark.parametrize("text,expected", [("He voted for it", "for"), ("voted for and voted against", None), ("no", None), ("VOTED  AGAINST", "against")])
def test_direction(spark, text, expected):
    assert one(spark, text, X.vote_direction) == expected


@pytest.mark.parametrize("text,expected", [("In fact", "legislative"), ("the economy", "economic"), ("a vote", "vote"), ("nothing", "general"), (None, "general")])
def test_claim_type_by_part_words(spark, text, expected):
    assert one(spark, text, X.claim_type) == expected


def test_recency_hits_part_words(spark):
    assert one(spark, "we know", lambda c: X.candidate_score(c, F.lit("other")), "string") == 1


@pytest.mark.parametrize("text,expected", [("They voted for it and voted for that", "They voted against it and voted for that"), ("they Voted Against it", "they voted for it"), ("none", "none")])
def test_flip_first_only(spark, text, expected):
    assert one(spark, text, X.flip_direction) == expected


@pytest.mark.parametrize("n,letters,expected", [(29, 29, False), (30, 30, True), (500, 500, True), (501, 501, False), (100, 49, False), (100, 50, True)])
def test_quality_bounds(spark, n, letters, expected):
    assert one(spark, "a" * letters + "1" * (n - letters), X.quality_claim) is expected


@pytest.mark.parametrize("opening", ["The House met", "Mr. Speaker, no", "In my opinion it", "It being noon", "Pursuant to order", "(Some hon. members: oh"])
def test_procedural_openings(spark, opening):
    assert one(spark, opening + " and so on for a long while", X.quality_claim) is False


@pytest.mark.parametrize("value,expected", [("0", 0), ("0.005", 0), ("0.5", 50), ("1", 100), ("1.5", 2), ("60.5", 60), ("150", 100), ("-3", 0), ("x", None), (None, None), ("NaN", None), ("Infinity", None)])
def test_percent(spark, value, expected):
    assert one(spark, value, V.percent) == expected


@pytest.mark.parametrize("url,expected", [("https://canada.ca/x", True), ("https://www.canada.ca", True), ("https://evilcanada.ca/", True), ("https://canada.ca:443/", False), ("https://u:p@canada.ca/", True), ("", False), ("not a url", False)])
def test_official_without_dot_border(spark, url, expected):
    assert one(spark, url, V.official) is expected


@pytest.mark.parametrize("text,expected", [('```json\n{"a": 1}\n```', 1), ('so: {"a": 2} ok', 2), ("nothing", None), ('{"a": 3}', 3), (None, None)])
def test_tolerant_json(spark, text, expected):
    got = one(spark, text, lambda c: V.tolerant_json(c, "a int"))
    assert (got["a"] if got else None) == expected


@pytest.mark.parametrize("text,expected", [("2024-1-5", "2024-01-05"), ("2024-01-05T10:00", "2024-01-05"), ("bad", None), (None, None)])
def test_parse_day(spark, text, expected):
    got = one(spark, text, V.parse_day)
    assert (str(got) if got else None) == expected


def test_vote_sentences_equal_expansion_to_terminators(spark):
    """The rewrite equals expanding every vote phrase to the nearest terminators, on random texts."""
    import random

    rng = random.Random(5)
    words = ["a", "voted for", "voted against", "b.", "c?", "d!", "e", "Voted  for"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    texts = [re.sub(r"\s+", " ", t).strip() for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.vote_sentences("t").alias("s")).collect()

    def expand(t):
        out = []
        for m in re.finditer(r"\bvoted\s+(?:for|against)\b", t, re.I):
            begin = max(t.rfind(c, 0, m.start()) for c in ".?!\n") + 1
            ends = [p for c in ".?!\n" if (p := t.find(c, m.end())) >= 0]
            s = " ".join(t[begin : (min(ends) if ends else len(t)) + 1].split())
            if s and s not in out:
                out.append(s)
        return out

    for r in rows:
        assert list(r["s"]) == expand(texts[r["i"]])


def test_contexts(spark):
    text = "One is here. Two voted for it. Three left. Four."
    assert one(spark, text, lambda c: X.local_context(c, F.lit("Two voted for it."))) == "One is here. Two voted for it. Three left."
    assert one(spark, text, lambda c: X.local_context(c, F.lit("absent"))) == "absent"
    assert one(spark, text, lambda c: X.local_context_v2(c, F.lit("two VOTED for it."))) == "One is here. Two voted for it. Three left."
    assert one(spark, "", lambda c: X.local_context_v2(c, F.lit("x"))) == "x"


def test_format_and_verdicts(spark):
    good = "VERDICT: TRUE\nCONFIDENCE: 90\nEXPLANATION: so\nCORRECTION: N/A"
    assert one(spark, good, X.has_format) is True
    assert one(spark, good.replace("CONFIDENCE: 90", ""), X.has_format) is False
    assert one(spark, None, X.has_format) is False
    assert one(spark, "VERDICT: HALF-TRUE", lambda c: F.lower(F.regexp_extract(c, P.VERDICT_TOKEN, 1))) == "half-true"


def test_nulls_and_long_texts(spark):
    functions = (X.clean, X.match_key, X.claim_type, X.usable_claim, X.quality_claim, X.signal_score, lambda c: X.trim_hard(c, 9), X.split_sentences)
    for f in functions:
        one(spark, None, f)
        one(spark, "", f)
        one(spark, "word. " * 20000, f)
