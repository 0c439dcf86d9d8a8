"""Sinks: CSV with a fixed header, JSON lines and arrays, and several projections of one relation."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.session import cut


def flat(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The given columns in order as strings, missing columns and values empty; nested values as JSON."""
    kinds = dict(df.dtypes)

    def value(c: str) -> Column:
        if c not in kinds:
            return F.lit("")
        nested = kinds[c].startswith(("struct", "array", "map"))
        return F.coalesce(F.to_json(c) if nested else F.col(c).cast("string"), F.lit(""))

    return df.select(*[value(c).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str], one_file: bool = False, line_end: str = "\n") -> None:
    """CSV with a header and minimal quoting. One file only on request: it is written by one task.

    ``\\r\\n`` also rewrites line breaks inside fields, so ``\\n`` is the default.
    """
    rows = flat(df, columns)
    rows = rows.coalesce(1) if one_file else rows
    rows.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="", nullValue="", lineSep=line_end).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, text unescaped."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_array(df: DataFrame, path: str, ascii_only: bool = False, most: int = 1_000_000) -> None:
    """A pretty JSON array in one file, for small outputs: more than ``most`` rows are refused, not cut."""
    if df.count() > most:
        raise ValueError(f"more than {most} rows; write JSON lines")
    names = df.columns
    with open(path, "w", encoding="utf-8") as f:
        rows = [json.loads(r["j"]) for r in df.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()]
        json.dump(rows, f, ensure_ascii=ascii_only, indent=2, default=str)


def write_parts(df: DataFrame, root: str, by: str, names: Sequence[str]) -> None:
    """One folder of JSON lines and one of CSV for every named value of ``by`` (splits, predictions), read once."""
    once = cut(df)
    for name in names:
        part = once.where(F.equal_null(F.col(by), F.lit(name)))
        write_json_lines(part, f"{root}/{name}_json")
        write_csv(part, f"{root}/{name}_csv", part.columns)


def export(rows: DataFrame, root: str, projections: Mapping[str, Sequence[str]], pairs: DataFrame | None = None, stats: DataFrame | None = None) -> None:
    """Several projections of one relation, computed once, with its pairs and statistics."""
    once = cut(rows)
    for name, columns in projections.items():
        write_csv(once, f"{root}/{name}", columns)
    if pairs is not None:
        write_json_lines(pairs, f"{root}/pairs")
    if stats is not None:
        write_csv(stats, f"{root}/stats", ("category", "name", "value"))
