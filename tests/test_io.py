import json

import pytest
from pyspark.sql import functions as F

from gavelspark.operators import boundaries
from gavelspark.sources import readers, sinks
from gavelspark.streaming import resume


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", text', "line\nbreak"), (2, None, "é"), (3, "", "x,y")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    sinks.write_csv(df, str(tmp_path / "c"), ["id", "b", "a", "absent"], one_file=True)
    back = readers.read_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["id", "b", "a", "absent"]
    assert {tuple(r) for r in back.collect()} == {("1", "line\nbreak", 'a "quoted", text', ""), ("2", "é", "", ""), ("3", "x,y", "", "")}


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("﻿id,v\n1,x\n".encode())
    assert readers.read_csv(spark, str(tmp_path / "b.csv")).columns == ["id", "v"]


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "id int, t string")
    sinks.write_json_array(df, str(tmp_path / "a.json"))
    assert sorted(json.loads((tmp_path / "a.json").read_text()), key=lambda r: r["id"]) == [{"id": 1, "t": "é"}, {"id": 2, "t": None}]
    assert readers.read_json_array(spark, str(tmp_path / "a.json"), "id int, t string").count() == 2
    sinks.write_json_lines(df, str(tmp_path / "l"))
    assert readers.read_json_lines(spark, str(tmp_path / "l"), "id int, t string").count() == 2


def test_optional_inputs(spark, tmp_path):
    assert readers.read_claims(spark, [str(tmp_path / "none.json")]).count() == 0
    (tmp_path / "c.json").write_text('[{"claim_text": "x", "context": {"date": "2020-01-01"}}]')
    assert readers.read_claims(spark, [str(tmp_path / "c.json"), str(tmp_path / "none.json")]).count() == 1
    assert readers.table_or_empty(spark, "no_such_table").count() == 0


def test_dotenv_and_options(tmp_path):
    (tmp_path / ".env").write_text("A=1\n# c\nB='two'\nbad\n")
    assert readers.load_dotenv(str(tmp_path / ".env"), {"A": "0"}) == {"A": "0", "B": "two"}
    assert readers.load_dotenv(str(tmp_path / "none"), {}) == {}
    options = readers.jdbc_options({"DB_NAME": "d", "DB_USER": "u"}, host="h")
    assert options["url"] == "jdbc:postgresql://h:5432/d" and options["user"] == "u"


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    stats = spark.createDataFrame([("c", "n", "1")], "category string, name string, value string")
    sinks.export(df, str(tmp_path), {"master": ["id", "v"], "narrow": ["v"]}, pairs=df, stats=stats)
    assert readers.read_csv(spark, str(tmp_path / "narrow")).columns == ["v"]
    assert readers.read_csv(spark, str(tmp_path / "stats")).count() == 1


def test_resume_adds_only_new(spark, tmp_path):
    (tmp_path / "in").mkdir()
    args = str(tmp_path / "saved"), str(tmp_path / "check"), "k"
    for name, rows in (("a", [(1, "x"), (1, "y"), (None, "n")]), ("b", [(1, "z"), (2, "w")])):
        (tmp_path / "in" / f"{name}.json").write_text("".join(json.dumps({"k": k, "v": v}) + "\n" for k, v in rows))
        resume.resume(resume.claim_stream(spark, str(tmp_path / "in"), "k bigint, v string"), *args)
    assert sorted(tuple(r) for r in spark.read.parquet(args[0]).collect()) == [(1, "x"), (2, "w")]


def test_boundaries(spark):
    df = spark.createDataFrame([(1, "a b. c"), (2, None)], "id int, t string")
    answers = boundaries.call_model(df, "t", lambda: lambda ps: [None if p is None else p.upper() for p in ps])
    assert {(r.id, r.answer) for r in answers.collect()} == {(1, "A B. C"), (2, None)}
    vectors = boundaries.embed(df, "t", lambda: lambda ts: [[float(len(t or "")), 1] for t in ts])
    assert {(r.id, tuple(r.embedding)) for r in vectors.collect()} == {(1, (6.0, 1.0)), (2, (0.0, 1.0))}
    parts = boundaries.segment(df, "t", lambda: lambda t: t.split(". "))
    assert {(r.id, len(r.sentences)) for r in parts.collect()} == {(1, 2), (2, 0)}
    assert [r.n for r in df.orderBy("id").select(boundaries.token_count("t").alias("n")).collect()] == [3, 0]


def test_json_array_in_ascii(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "id int, t string")
    sinks.write_json_array(df, str(tmp_path / "a.json"), ascii_only=True)
    text = (tmp_path / "a.json").read_text()
    assert text.isascii() and "\\u00e9" in text and sorted(r["id"] for r in json.loads(text)) == [1, 2]


def test_json_array_refuses_more_rows(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_json_array(spark.range(5), str(tmp_path / "a.json"), most=4)


def test_splits_and_predictions_are_written_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "TRUE"), (2, "test", "FALSE"), (3, "train", None)], "id int, split string, pred string")
    sinks.write_parts(df, str(tmp_path), "split", ["train", "test", "validation"])
    sizes = [readers.read_json_lines(spark, str(tmp_path / f"{n}_json"), "id int, split string, pred string").count() for n in ("train", "test", "validation")]
    assert sizes == [2, 1, 0] and sorted(r.pred for r in readers.read_csv(spark, str(tmp_path / "train_csv")).collect()) == ["", "TRUE"]


def test_jdbc_read_in_ranges(spark, tmp_path):
    options = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100).selectExpr("cast(id as int) as id", "concat('n', id) as name")
    rows.write.format("jdbc").options(**options).option("dbtable", "t").save()
    whole = readers.read_jdbc(spark, "t", options)
    parts = readers.read_jdbc(spark, '(SELECT "id", "name" FROM t WHERE "id" >= 10) q', options, "id", (10, 100), 4)
    assert whole.count() == 100 and parts.rdd.getNumPartitions() == 4 and sorted(r.id for r in parts.collect()) == list(range(10, 100))


def test_word_sentences(spark):
    df = spark.createDataFrame([(1, "It rose by 2.5 percent. They left!"), (2, None)], "id int, t string").orderBy("id")
    assert [r.s for r in df.select(boundaries.word_sentences("t").alias("s")).collect()] == [[["It", "rose", "by", "2.5", "percent"], ["They", "left"]], []]


def test_chat_text(spark):
    df = spark.createDataFrame([("p", "c"), ("p", "c</s>"), (None, None)], "p string, c string")
    assert [r.t for r in df.select(boundaries.chat_text("p", "c").alias("t")).collect()] == ["p\nc</s>", "p\nc</s>", "\n</s>"]


def test_streams_of_distinct_claims_and_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("a", "2020-01-01T00:00:00"), ("a", "2020-01-01T00:05:00"), ("b", "2020-01-01T02:00:00")]
    (tmp_path / "in" / "x.json").write_text("".join(json.dumps({"k": k, "at": t}) + "\n" for k, t in rows))
    stream = resume.claim_stream(spark, str(tmp_path / "in"), "k string, at timestamp")
    for name, df, mode in (("d", resume.distinct_stream(stream, ["k"], "at", "1 hour"), "append"), ("a", resume.arrivals(stream, "at", "1 hour", "1 hour", "k"), "complete")):
        df.writeStream.format("memory").queryName(f"gavel_{name}").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("gavel_d").count() == 2 and spark.table("gavel_a").count() == 2


def test_cut_keeps_rows_and_types(spark):
    from gavelspark.session import cut

    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, timestamp_ntz'2020-01-01 00:00:00' AS t, array(1L) AS c")
    kept = cut(df)
    assert kept.dtypes == df.dtypes and kept.collect() == df.collect()
    twice = df.select("a", F.col("b").alias("A"), F.lit(None).alias("n"))
    assert cut(twice).collect() == twice.collect() and cut(df.limit(0)).count() == 0
