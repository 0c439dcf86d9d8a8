"""Queries of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.llm import alignment, formats, leakage, overlap, packing, pairs, pii, sentences, splits
from gavelspark.llm.dealing import dealt
from gavelspark.session import table


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("factcheck_master", "liar_silver_master")
    return table(spark, sf_dir, names[0]).select(F.lit(names[0]).alias("table_name"), "seq", F.col("claim_text").alias("text")).unionByName(
        table(spark, sf_dir, names[1]).select(F.lit(names[1]).alias("table_name"), "seq", F.col("claim_text").alias("text"))
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = table(spark, sf_dir, "hansards_statement").select(F.lit("hansards_statement").alias("table_name"), F.col("id").alias("row_id"), F.col("loaded_at").alias("at"), F.col("content_en").alias("text"))
    checked = table(spark, sf_dir, "factcheck_master").select(F.lit("factcheck_master").alias("table_name"), F.col("seq").alias("row_id"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("source_context").alias("text"))
    return dealt(spoken.unionByName(checked))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, sf_dir, "training_pairs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(table(spark, sf_dir, "training_pairs"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_links(table(spark, sf_dir, "training_pairs"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "training_pairs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(table(spark, sf_dir, "hansards_statement").select("id", F.col("loaded_at").alias("at"), F.col("content_en").alias("first"), F.col("content_fr").alias("second")))
    found = alignment.aligned_sentences(spark, rows, at="at")
    return found.select(F.col("id").alias("statement_id"), F.col("first_start").alias("en_start"), F.col("second_start").alias("fr_start"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.linked_groups(table(spark, sf_dir, "factcheck_master"), "source_statement_id", "bill_id")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_records(table(spark, sf_dir, "factcheck_master"), "source_statement_id", "bill_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.form_copies(_claims(spark, sf_dir))


def p5_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.collapsed(_claims(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_starts(_texts(spark, sf_dir), "at")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_documents(spark, sf_dir))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_documents(spark, sf_dir), table(spark, sf_dir, "heldout_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the leaks those with enough consecutive words; pieces in another order stand in p9_leaks."""
    return p9_leaks(spark, sf_dir).where("kind = 'passage'").select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_spans(_documents(spark, sf_dir))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage by name."""
    every = (p1_found, p2_found, p2_links, p2_report, p3_found, p4_found, p4_splits, p5_found, p5_claims, p7_found, p8_containers, p9_leaks, p9_found, p10_found, p10_redacted)
    return {f.__name__: f for f in every}


_NUMBER = r"'^[+-]?[0-9]+([.][0-9]*)?([eE][+-]?[0-9]{1,2})?$'"


def _number(column: str) -> str:
    text = f"regexp_replace({column}, '^[\\s ]+|[\\s ]+$', '', 'g')"
    return f"CASE WHEN regexp_matches({text}, {_NUMBER}) THEN try_cast({text} AS DECIMAL(38,9)) END"


_P4 = f"""
WITH RECURSIVE r AS MATERIALIZED (
  SELECT seq, {_number('source_statement_id')} AS s, {_number('bill_id')} AS b FROM factcheck_master
), k AS MATERIALIZED (SELECT * FROM r WHERE s IS NOT NULL OR b IS NOT NULL),
e AS MATERIALIZED (
  SELECT DISTINCT x.b AS a, y.b AS z FROM k x JOIN k y ON x.s = y.s WHERE x.b IS NOT NULL AND y.b IS NOT NULL
), walk(a, z) AS (
  SELECT a, z FROM e UNION SELECT w.a, e.z FROM walk w JOIN e ON w.z = e.a
), root AS MATERIALIZED (SELECT a AS b, min(z) AS root FROM walk GROUP BY a),
anchor AS MATERIALIZED (SELECT s, min(b) AS b FROM k WHERE s IS NOT NULL GROUP BY s),
n AS (SELECT k.seq, k.s, coalesce(k.b, anchor.b) AS b FROM k LEFT JOIN anchor USING (s))
SELECT n.seq, CASE WHEN n.b IS NULL THEN 's:' || CAST(n.s AS DECIMAL(38,0)) ELSE 'b:' || CAST(coalesce(root.root, n.b) AS DECIMAL(38,0)) END AS group_key
FROM n LEFT JOIN root ON n.b = root.b
"""

_BARE = "replace(lower(upper(regexp_replace({0}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\x{{E000}}]', '', 'g'))), 'ß', 'ss')"


def _bare(x: str) -> str:
    return _BARE.format(x)


def _keyed() -> str:
    field = "regexp_matches(p, '^[^\\p{L}\\p{N}:=]*\\p{L}[\\p{L}\\p{M}\\p{N} _\"-]*\\s*[:=](?s:.+)$')"
    name = _bare("regexp_extract(p, '^([^:=]*)[:=]', 1)")
    value = _bare("regexp_replace(p, '^[^:=]*[:=]', '')")
    branches = []
    for separator in ("[|]", ";", "[\\r\\n]+", '"\\s*,\\s*"', ","):
        parts = f"list_filter(regexp_split_to_array(t, '{separator}'), lambda p: regexp_matches(p, '[\\p{{L}}\\p{{N}}]'))"
        branches.append(f"WHEN len({parts}) >= 2 AND len(list_filter({parts}, lambda p: NOT {field})) = 0 THEN array_to_string(list_sort(list_transform({parts}, lambda p: {name} || ':' || {value})), '|')")
    return f"CASE {' '.join(branches)} ELSE {_bare('t')} END"


_P5 = f"""
WITH c AS (
  SELECT 'factcheck_master' AS table_name, seq, nfc_normalize(claim_text) AS t FROM factcheck_master WHERE claim_text IS NOT NULL
  UNION ALL SELECT 'liar_silver_master', seq, nfc_normalize(claim_text) FROM liar_silver_master WHERE claim_text IS NOT NULL
), p AS (
  -- two passes: the decimal points of 1.2.3 overlap
  SELECT table_name, seq, regexp_replace(regexp_replace(t, '(\\p{{Nd}})[.](\\p{{Nd}})', '\\1' || chr(57344) || '\\2', 'g'), '(\\p{{Nd}})[.](\\p{{Nd}})', '\\1' || chr(57344) || '\\2', 'g') AS t FROM c
), k AS (SELECT table_name, seq, {_keyed()} AS key FROM p),
f AS (SELECT table_name, key, min(seq) AS first_seq FROM k GROUP BY ALL)
SELECT DISTINCT table_name, first_seq, seq AS copy_seq FROM k JOIN f USING (table_name, key) WHERE seq > first_seq
"""
_P5_CLAIMS = f"""
WITH copies AS ({_P5}), claims AS (SELECT DISTINCT 'factcheck_master' AS table_name, seq FROM factcheck_master WHERE claim_text IS NOT NULL UNION ALL SELECT DISTINCT 'liar_silver_master', seq FROM liar_silver_master WHERE claim_text IS NOT NULL)
SELECT table_name, seq, 1 + (SELECT count(*) FROM copies c WHERE c.table_name = k.table_name AND c.first_seq = k.seq) AS n_copies FROM claims k WHERE NOT EXISTS (SELECT 1 FROM copies c WHERE c.table_name = k.table_name AND c.copy_seq = k.seq)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express over whole tables."""
    return {"p4_found": _P4, "p5_found": _P5, "p5_claims": _P5_CLAIMS}
