"""Queries of general operators on the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gavelspark.operators import references as refs
from gavelspark.session import table

REFERENCES = (
    refs.Reference("hansards_statement", "id", "bill_debated_id", "bills_bill"),
    refs.Reference("bills_votequestion", "id", "bill_id", "bills_bill"),
    refs.Reference("bills_partyvote", "id", "party_id", "core_party"),
)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for parent in ("bills_bill", "core_party"):
        states = refs.parent_states(table(spark, sf_dir, parent))
        rows = None
        for ref in (r for r in REFERENCES if r.parent == parent):
            own = refs.referring_rows(table(spark, sf_dir, ref.table_name), ref)
            rows = own if rows is None else rows.unionByName(own)
        part = refs.orphan_references(rows, states)
        found = part if found is None else found.unionByName(part)
    return found


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "row_id", "ref_id", "kind")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.orphan_report(_orphans(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p6_found": p6_found, "p6_report": p6_report}


_P6 = """
WITH p AS (
  SELECT 'bill' AS parent, id, min(loaded_at) AS first_at, arg_max(CASE WHEN deleted_at IS NULL THEN 0 ELSE 1 END, loaded_at) AS gone FROM bills_bill WHERE id IS NOT NULL GROUP BY id
  UNION ALL
  SELECT 'party', id, min(loaded_at), arg_max(CASE WHEN deleted_at IS NULL THEN 0 ELSE 1 END, loaded_at) FROM core_party WHERE id IS NOT NULL GROUP BY id
), r AS (
  SELECT 'hansards_statement' AS table_name, 'bill' AS parent, id AS row_id, bill_debated_id AS ref_id, min(loaded_at) AS loaded_at FROM hansards_statement WHERE bill_debated_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'bills_votequestion', 'bill', id, bill_id, min(loaded_at) FROM bills_votequestion WHERE bill_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'bills_partyvote', 'party', id, party_id, min(loaded_at) FROM bills_partyvote WHERE party_id IS NOT NULL GROUP BY ALL
), o AS (
  SELECT r.table_name, r.row_id, r.ref_id, r.loaded_at,
    CASE WHEN p.id IS NULL THEN 'missing' WHEN p.gone = 1 THEN 'deleted' WHEN p.first_at > r.loaded_at THEN 'late' END AS kind
  FROM r LEFT JOIN p ON r.parent = p.parent AND r.ref_id = p.id
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _P6 + "SELECT table_name, row_id, ref_id, kind FROM o WHERE kind IS NOT NULL",
        "p6_report": _P6 + "SELECT table_name, strftime(loaded_at, '%Y-%m') AS month, kind, count(*) AS n_rows, count(DISTINCT ref_id) AS n_refs FROM o WHERE kind IS NOT NULL GROUP BY ALL",
    }
