"""Dates, numbers, JSON, hashes and addresses as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelspark.functions import patterns as P
from gavelspark.functions.text import _col, or_empty, strip, unfence


def parse_day(text: Column | str) -> Column:
    """The first ten characters as a date, padded or not; null where they are none."""
    return F.try_to_date(F.substring(_col(text), 1, 10), "y-M-d")


def year_of(text: Column | str) -> Column:
    """The leading four digits as a year, else 0."""
    t = or_empty(text)
    return F.when(t.rlike(r"^[0-9]{4}"), F.substring(t, 1, 4).cast("int")).otherwise(0)


def whole_number(text: Column | str) -> Column:
    """A text as an integer; null where it is none."""
    return _col(text).try_cast("bigint")


def percent(value: Column | str) -> Column:
    """A confidence on either scale as 0 to 100, rounded half to even; null where it is no number."""
    number = _col(value).try_cast("double")
    scaled = F.when((number >= 0) & (number <= 1), number * 100).otherwise(number)
    finite = F.when(~F.isnan(scaled) & (F.abs(scaled) < 1e9), scaled)
    return F.when(finite.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.bround(finite, 0).cast("int"))))


def length_cap(p99: Column | str) -> Column:
    """A percentile of lengths as the next multiple of 64, kept between 1,024 and 2,048."""
    return (F.ceil(F.least(F.lit(2048), F.greatest(F.lit(1024), _col(p99) + 64)) / 64) * 64).cast("int")


def claim_id(text: Column | str, statement: Column | str, day: Column | str) -> Column:
    """A stable id from a claim's text, statement and date."""
    return F.concat(F.lit("silver_"), F.substring(F.sha1(F.concat_ws("|", or_empty(text), or_empty(statement), or_empty(day))), 1, 12))


def authority(url: Column | str) -> Column:
    """Host and port of an address in lower case, without a user."""
    found = F.regexp_extract(_col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(found, r"^.*@", ""))


def official(url: Column | str) -> Column:
    """Whether an address ends in one of the official domains, with no border before it and the port kept."""
    host = authority(url)
    return reduce(lambda a, b: a | b, ((host == s) | F.endswith(host, F.lit(s)) for s in P.OFFICIAL_SUFFIXES))


def sorted_json(struct: Column) -> Column:
    """A struct as JSON with nulls kept; give its fields in name order."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def tolerant_json(text: Column | str, schema: str) -> Column:
    """JSON inside fences or prose: the text itself, else its outermost braces, else null."""
    bare = unfence(text)
    whole = F.from_json(F.when(bare.rlike(r"(?s)^\{.*\}$"), bare), schema, {"mode": "PERMISSIVE"})
    inner = F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")), schema, {"mode": "PERMISSIVE"})
    return F.coalesce(whole, inner)


ENVELOPE = "output_text string, model string, output array<struct<content:array<struct<text:string>>>>"


def output_text(envelope: Column | str) -> Column:
    """The text of a model's answer envelope: its own field, else the parts of its content by line."""
    e = F.from_json(_col(envelope), ENVELOPE)
    parts = F.flatten(F.transform(F.coalesce(e["output"], F.array().cast("array<struct<content:array<struct<text:string>>>>")), lambda o: F.coalesce(F.transform(o["content"], lambda c: c["text"]), F.array().cast("array<string>"))))
    joined = F.array_join(F.filter(parts, lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    return F.coalesce(F.nullif(e["output_text"], F.lit("")), joined)


SOURCE = "struct<title:string,url:string,source_type:string,why_relevant:string>"


def provenance(statement: Column | str, sources: Column) -> Column:
    """A fixed first item and the named sources, those with an address only if it is official."""
    own = F.struct(
        F.lit("Hansard statement").alias("title"), F.lit("").alias("url"), F.lit("parliamentary").alias("source_type"),
        F.concat(F.lit("Statement "), or_empty(statement), F.lit(" provides the natural claim context.")).alias("why_relevant"),
    )
    kept = F.filter(F.coalesce(sources, F.array().cast(f"array<{SOURCE}>")), lambda s: s.isNotNull() & ((strip(or_empty(s["url"])) == "") | official(strip(s["url"]))))
    tidy = F.transform(kept, lambda s: F.struct(or_empty(s["title"]).alias("title"), strip(or_empty(s["url"])).alias("url"), F.coalesce(s["source_type"], F.lit("official")).alias("source_type"), or_empty(s["why_relevant"]).alias("why_relevant")))
    return F.concat(F.array(own), tidy)


def normed(vector: Column | str) -> Column:
    """A vector of length one; the zero vector stays."""
    v = _col(vector)
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(F.lit(0.0)))


def inner_product(a: Column | str, b: Column | str) -> Column:
    """Inner product of two vectors of one length."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
