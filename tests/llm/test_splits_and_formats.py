import random

import pytest
from pyspark.sql import functions as F

from gavelspark.llm import formats, splits


@pytest.mark.parametrize("text,expected", [("3000472", "3000472"), (" 0300.0 ", "300"), ("3e2", "300"), ("nan", None), ("None", None), ("", None), (None, None), ("-", None), ("1.5", "1.5"), ("12 a", None)])
def test_number_ids(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(splits.number_text(splits.number_id("t")).alias("n")).first()["n"]
    assert got == expected


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)] + [(500, k) for k in range(501, 560)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in splits.star_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in root}


def test_groups(spark):
    rows = [(1, "10", "5"), (2, "10.0", "7"), (3, "11", "07"), (4, "12", None), (5, " 12", "nan"), (6, None, None), (7, None, "9"), (8, "x", "9.0")]
    got = {r.seq: r.group_key for r in splits.linked_groups(spark.createDataFrame(rows, "seq bigint, s string, b string"), "s", "b").collect()}
    assert got == {1: "b:5", 2: "b:5", 3: "b:5", 4: "s:12", 5: "s:12", 7: "b:9", 8: "b:9"}
    assert splits.linked_groups(spark.createDataFrame([], "seq bigint, s string, b string"), "s", "b").count() == 0


def test_split_keeps_groups_and_proportions(spark):
    rng = random.Random(8)
    rows = [(i, str(rng.randint(1, 900)), str(1 if rng.random() < 0.3 else rng.randint(2, 600)) if rng.random() < 0.2 else None) for i in range(2000)] + [(5000 + i, None, None) for i in range(50)]
    got = splits.split_records(spark.createDataFrame(rows, "seq bigint, s string, b string"), "s", "b").collect()
    assert len(got) == len(rows)
    by_group = {}
    for r in got:
        by_group.setdefault(r.group_key, set()).add(r.split)
    assert all(len(v) == 1 for v in by_group.values())
    share = {n: sum(r.split == n for r in got) / len(got) for n in splits.TARGETS}
    assert abs(share["train"] - 0.8) < 0.06 and abs(share["test"] - 0.1) < 0.04 and abs(share["validation"] - 0.1) < 0.04


def test_largest_differencing_balances():
    rng = random.Random(6)
    histogram = {rng.randint(1, 500): rng.randint(1, 90) for _ in range(40)}
    sums, last = splits.largest_differencing(histogram, 20)
    assert sum(sums) == sum(w * c for w, c in histogram.items())
    assert all(len(last.get(w, [])) == c % 20 for w, c in histogram.items())
    assert max(sums) - min(sums) <= max(1, 0.01 * max(sums))
    assert splits.largest_differencing({}, 5) == ([0] * 5, {})


FORMS = [
    ("The café cost $1,204.5 in 2020.", "THE  CAFÉ COST $1 204.5 IN 2020", True), ("rate 29.1 percent", "rate 291 percent", False), ("café", "cafe", False), ("a-b", "a b", True),
    ("Party: X | Vote: for", "Vote: for; Party: X", True), ("Party: X | Vote: for", '{"Vote": "for", "Party": "X"}', True), ("Party: X | Vote: for", "Vote: for\nParty: X", True), ("Party: X | Vote: for", "Party: for | Vote: X", False),
    ("(Party: X | Vote: for)", "«Vote: for; Party: X.»", True), ("one two", "two one", False), ("Version 1.2.3", "version 1.2.3!", True), ("Version 1.2.3", "version 12.3", False), ("", "...", True), ("Straße", "STRASSE", True),
    ("Cafe\u0301: X | Vote: for", "VOTE: for; CAFÉ: x", True), ("The \ufb01rst", "THE FIRST", True), ("A very long name of a field that goes on and on and on: 1 | b: 2", "b: 2; a very long name of a field that goes on and on and on: 1", True),
]


@pytest.mark.parametrize("a,b,same", FORMS)
def test_forms(spark, a, b, same):
    df = spark.createDataFrame([("t", 1, a), ("t", 2, b), ("t", 3, None), ("u", 1, a)], "table_name string, seq bigint, text string")
    assert [tuple(r) for r in formats.form_copies(df).collect()] == ([("t", 1, 2)] if same else [])
    assert {(r.table_name, r.seq): r.n_copies for r in formats.collapsed(df).collect()}[("t", 1)] == 1 + same


def test_hot_form_and_empty(spark):
    df = spark.range(300).select(F.lit("t").alias("table_name"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "Hot claim, 7").otherwise(F.concat(F.lit("claim "), F.col("id"))).alias("text"))
    assert formats.form_copies(df).count() == 99
    assert formats.form_copies(df.limit(0)).count() == 0
