"""References to records that do not exist.

Parent keys are compressed into contiguous runs, references are matched as-of to the run that starts at or before them,
and a key beyond that run's end is an orphan. Runs never cross a fixed-width key bucket, so that finding them needs no
global sort and no task holds more than one bucket of keys, and references are reduced to distinct keys before the match,
so that a key with a third of all references costs one row there.

Defined results: a null reference is no reference; a null parent key is no parent; an empty parent table makes every
reference missing; exact repeats count once; ties on ``loaded_at`` in the parent go to the row that reports a deletion;
a null ``loaded_at`` counts as before all others. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bucket holds 2 ** BUCKET_BITS keys: the most distinct keys that one window group can hold.
BUCKET_BITS = 16


@dataclass(frozen=True)
class Reference:
    """One foreign key: the referring table with its key, the reference column and the parent table's name."""

    table_name: str
    row_key: str
    ref_column: str
    parent: str


def _loaded(df: DataFrame, column: str = "loaded_at") -> Column:
    return F.coalesce(df[column].cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def _bucket(key: str) -> Column:
    return F.shiftright(key, BUCKET_BITS)


def parent_states(parent: DataFrame, key: str = "id", deletable: bool = True) -> DataFrame:
    """One row per parent key: the first time it was loaded and whether its latest row reports a deletion."""
    deleted = F.col("deleted_at").isNotNull() if deletable else F.lit(False)
    rows = parent.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("key"), _loaded(parent).alias("at"), deleted.alias("gone")
    )
    return rows.groupBy("key").agg(F.min("at").alias("first_at"), F.max(F.struct("at", "gone"))["gone"].alias("gone"))


def key_runs(states: DataFrame) -> DataFrame:
    """Contiguous runs of parent keys of one state, split at bucket borders."""
    order = Window.partitionBy("bucket", "gone").orderBy("key")
    return (
        states.withColumn("bucket", _bucket("key"))
        .withColumn("island", F.col("key") - F.row_number().over(order))
        .groupBy("bucket", "gone", "island")
        .agg(F.min("key").alias("start"), F.max("key").alias("end"), F.max("first_at").alias("latest_first"))
        .select("bucket", "gone", "start", "end", "latest_first")
    )


def match_runs(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """As-of match of distinct referenced keys to the preceding run of either state.

    ``keys``: key, first_at. Returns each key with ``covered`` (a live or deleted run holds it), ``gone`` and
    ``maybe_late`` (some key of its run was first loaded after the first reference).
    """
    none = F.lit(None)
    marks = runs.select(
        "bucket", F.col("start").alias("key"), F.lit(0).alias("is_key"), none.cast("timestamp_ntz").alias("first_at"),
        F.when(~F.col("gone"), F.struct("start", "end", "latest_first")).alias("live"),
        F.when(F.col("gone"), F.struct("start", "end", "latest_first")).alias("dead"),
    )
    run_type = "struct<start:bigint,end:bigint,latest_first:timestamp_ntz>"
    probes = keys.select(
        _bucket("key").alias("bucket"), "key", F.lit(1).alias("is_key"), "first_at",
        none.cast(run_type).alias("live"), none.cast(run_type).alias("dead"),
    )
    order = Window.partitionBy("bucket").orderBy("key", "is_key").rowsBetween(Window.unboundedPreceding, 0)
    seen = (
        marks.unionByName(probes)
        .withColumn("live", F.last("live", ignorenulls=True).over(order))
        .withColumn("dead", F.last("dead", ignorenulls=True).over(order))
        .where("is_key = 1")
    )
    in_live = F.coalesce(F.col("key") <= F.col("live.end"), F.lit(False))
    in_dead = F.coalesce(F.col("key") <= F.col("dead.end"), F.lit(False))
    return seen.select(
        "key", (in_live | in_dead).alias("covered"), in_dead.alias("gone"),
        (in_live & (F.col("live.latest_first") > F.col("first_at"))).alias("maybe_late"),
    )


def referring_rows(df: DataFrame, ref: Reference) -> DataFrame:
    """Distinct (row, reference) pairs with the first time each was loaded."""
    return (
        df.where(F.col(ref.ref_column).isNotNull())
        .select(
            F.lit(ref.table_name).alias("table_name"), F.col(ref.row_key).cast("long").alias("row_id"),
            F.col(ref.ref_column).cast("long").alias("ref_id"), _loaded(df).alias("at"),
        )
        .groupBy("table_name", "row_id", "ref_id")
        .agg(F.min("at").alias("loaded_at"))
    )


def orphan_references(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Referring rows whose key is ``missing``, ``deleted`` or ``late`` in the parent.

    ``rows``: table_name, row_id, ref_id, loaded_at. Returns these columns and ``kind``. Only keys that the runs mark
    are looked up again, and only those marked ``maybe_late`` need the parent's own first load.
    """
    keys = rows.groupBy(F.col("ref_id").alias("key")).agg(F.min("loaded_at").alias("first_at"))
    marked = match_runs(keys, key_runs(states)).where("not covered or gone or maybe_late")
    late = states.join(marked.where("covered and not gone").select("key"), "key", "left_semi").select("key", F.col("first_at").alias("parent_at"))
    verdicts = marked.join(late, "key", "left").select(F.col("key").alias("ref_id"), "covered", "gone", "parent_at")
    kind = F.when(~F.col("covered"), "missing").when(F.col("gone"), "deleted").when(F.col("parent_at") > F.col("loaded_at"), "late")
    return rows.join(verdicts, "ref_id").withColumn("kind", kind).where("kind is not null").select("table_name", "row_id", "ref_id", "loaded_at", "kind")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table, month of load and kind."""
    return (
        orphans.groupBy("table_name", F.date_format("loaded_at", "yyyy-MM").alias("month"), "kind")
        .agg(F.count("*").alias("n_rows"), F.countDistinct("ref_id").alias("n_refs"))
    )
