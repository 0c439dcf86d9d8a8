"""Duplicates hidden by formatting differences.

Progressive partition refinement: rows are first classed by cheap invariants of the composed text, counts of digits and of a
few letters by plain character counting; only classes with several members get the costlier key, the whole canonical text
with its named fields in order. Classes are counted by partial aggregation and joined back, so a group with a third of all
rows is never gathered in one task.

Two texts are the same if their letters, marks and digits agree in order after canonical composition and case folding;
a point between two digits counts, everything else is formatting. A text made of two or more ``name: value`` fields is
compared with its fields in name order.

Defined results: a null text is no claim and has no copies; texts without any letter or digit (the empty one among
them) are copies of one another; of equal ``seq`` (none is expected) each distinct value counts once.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.session import cut

#: Separators between the fields of a claim written as named fields, tried in this order.
SEPARATORS = (r"[|]", r";", r"[\r\n]+", r'"\s*,\s*"', r",")
FIELD = r'^[^\p{L}\p{N}:=]*[\p{L}][\p{L}\p{M}\p{N} _"-]*\s*[:=](?s:.+)$'
#: Stands for a decimal point in a skeleton; a private-use character that is no letter, mark or digit.
POINT = "\ue000"
#: Characters whose counts make the cheap class: in composed text no change of form adds or removes one of them (letters that
#: case folding makes of others, as s of a sharp s or f and i of a ligature, are not among them).
COUNTED = ("eE", "oO", "rR", "cC", "dD", "uU", "02468", "13579", "01")

_DECOMPOSED = r"[\p{M}\u1100-\u11FF\u2126\u212A\u212B]"
_SPLITS = tuple(regex.compile(s) for s in SEPARATORS)
_FIELD = regex.compile(FIELD)
_LETTER = regex.compile(r"[\p{L}\p{N}]")
_NAME = re.compile(r"[^:=]*[:=]")
_POINT = re.compile(r"(?<=\d)[.](?=\d)")
_FORM = regex.compile(rf"[^\p{{L}}\p{{M}}\p{{N}}{POINT}]+")
_ASCII_FORM = re.compile(r"[^A-Za-z0-9]+")


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(text=[unicodedata.normalize("NFC", t) for t in pdf.text])


def composed(rows: DataFrame) -> DataFrame:
    """Rows with their ``text`` in canonical composition; only texts with a combining mark or a decomposable sign leave the
    JVM. ``rows``: table_name, seq, text."""
    marked = (F.length("text") < F.octet_length("text")) & F.col("text").rlike(_DECOMPOSED)
    return rows.where(~marked).unionByName(rows.where(marked).mapInPandas(_composed, "table_name string, seq long, text string"))


def cheap_class() -> list[Column]:
    """Invariants under every allowed change, field order included, by counting characters."""
    return [(F.length("text") - F.length(F.translate("text", c, ""))).cast("int").alias(f"n_{k}") for k, c in enumerate(COUNTED)]


def skeleton(text: str) -> str:
    """Letters, marks, digits and decimal points of a composed text, case folded."""
    bare = _POINT.sub(POINT, text) if "." in text else text
    bare = _ASCII_FORM.sub("", bare) if bare.isascii() else _FORM.sub("", bare)
    return bare.upper().lower().replace("\u00df", "ss")


def canonical(text: str) -> str:
    """The whole comparison key of a composed text: the skeleton, or the sorted skeletons of its named fields."""
    if ":" in text or "=" in text:
        for split in _SPLITS:
            parts = [p for p in split.split(text) if _LETTER.search(p)]
            if len(parts) >= 2 and all(_FIELD.match(p) for p in parts):
                return "|".join(sorted(f"{skeleton(p[: m.end() - 1])}:{skeleton(p[m.end() :])}" for p in parts for m in (_NAME.match(p),)))
    return skeleton(text)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[["table_name", "seq"]].assign(key=[hashlib.sha256(canonical(t).encode("utf-8", "surrogatepass")).hexdigest() for t in pdf.text])


def form_groups(claims: DataFrame) -> DataFrame:
    """Rows that may share their claim with another row, with their key. ``claims``: table_name, seq, text. Returns
    table_name, seq, key."""
    rows = composed(claims.where("text is not null").select("table_name", "seq", "text"))
    classed = rows.select("table_name", "seq", "text", F.xxhash64(*cheap_class()).alias("class"))
    several = classed.groupBy("table_name", "class").agg(F.min("seq").alias("low"), F.max("seq").alias("high")).where("low < high").select("table_name", "class")
    return classed.join(several, ["table_name", "class"], "left_semi").select("table_name", "seq", "text").mapInPandas(_keyed, "table_name string, seq long, key string")


def form_copies(claims: DataFrame) -> DataFrame:
    """Every row that repeats an earlier one, with the first such row. Returns table_name, first_seq, copy_seq."""
    rows = cut(form_groups(claims))
    first = rows.groupBy("table_name", "key").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).where("first_seq < last_seq").drop("last_seq")
    return rows.join(first, ["table_name", "key"]).where("seq > first_seq").select("table_name", "first_seq", F.col("seq").alias("copy_seq")).distinct()


def collapsed(claims: DataFrame) -> DataFrame:
    """Each claim once: its first row and the number of rows that state it. Returns table_name, seq, n_copies."""
    copies = cut(form_copies(claims))
    counts = copies.groupBy("table_name", F.col("first_seq").alias("seq")).agg(F.count("*").alias("extra"))
    kept = claims.where("text is not null").select("table_name", "seq").distinct().join(copies.select("table_name", F.col("copy_seq").alias("seq")), ["table_name", "seq"], "left_anti")
    return kept.join(counts, ["table_name", "seq"], "left").select("table_name", "seq", (F.coalesce("extra", F.lit(0)) + 1).alias("n_copies"))
