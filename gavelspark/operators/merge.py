"""Balanced selection of training pairs from gold and silver sets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.functions import patterns as P
from gavelspark.functions import text as X
from gavelspark.functions.values import year_of
from gavelspark.operators.ranking import top_by
from gavelspark.operators.records import without_claims


def training_items(pairs: DataFrame, masters: DataFrame, source: str) -> DataFrame:
    """Pairs with their master row; of several masters with one claim id the last counts, pairs without one are dropped.

    ``pairs``: pair_id, prompt, completion, claim_id; ``masters``: seq, claim_id, claim_text, claim_type, source_date.
    """
    last = masters.where("claim_id is not null").groupBy("claim_id").agg(F.max(F.struct("seq", "claim_text", "claim_type", "source_date")).alias("m")).select("claim_id", "m.claim_text", "m.claim_type", "m.source_date")
    label = F.lower(F.regexp_extract(X.or_empty("completion"), P.VERDICT_TOKEN, 1))
    return pairs.select("pair_id", "prompt", "completion", "claim_id").join(last, "claim_id").withColumn("label", label).withColumn("source_dataset", F.lit(source))


def item_score() -> dict[str, Column]:
    """The four descending sort keys of a gold item."""
    t, n, m = X.or_empty("claim_text"), F.length(X.or_empty("claim_text")), F.length(X.or_empty("prompt"))
    year = year_of("source_date")
    score = (
        F.when(n.between(60, 220), 4).when(n.between(45, 320), 2).otherwise(-4)
        + F.when(t.rlike(P.GOLD_BILL_CODE), 2).otherwise(0) + F.when(t.rlike(r"\b\d{4}\b"), 1).otherwise(0) + F.when(t.rlike(P.GOLD_STAGES), 1).otherwise(0)
        + F.when(m <= 2200, 1).when(m > 3000, -1).otherwise(0) + F.when(year >= 2020, 2).when(year >= 2010, 1).otherwise(0)
        - F.when(F.col("claim_type") == "party_vote_direction", 1).otherwise(0)
    )
    return {"s1": score, "s2": year, "s3": -m, "s4": -n}


def major_quotas(target: int, capacities: Mapping[str, int], weights: Mapping[str, float] = P.MAJOR_WEIGHTS) -> dict[str, int]:
    """Places for each weighted type: its share within its capacity first, then what is left by weight and spare room.

    A few scalars from one small aggregate, so this runs on the driver. A spare place goes to the heaviest type with
    room, of equal weights to the one with more room, then to the first declared.
    """
    quota = {k: min(capacities.get(k, 0), int(target * w)) for k, w in weights.items()}
    left = target - sum(quota.values())
    order = list(weights)
    for weight in sorted(set(weights.values()), reverse=True):
        level = [k for k in order if weights[k] == weight]
        while left > 0:
            room = [(capacities.get(k, 0) - quota[k], -order.index(k), k) for k in level if capacities.get(k, 0) > quota[k]]
            if not room:
                break
            most, _, name = max(room)
            second = max([r for r, _, k in room if k != name], default=0)
            step = min(left, max(1, most - second))
            quota[name] += step
            left -= step
    return quota


def select_balanced(items: DataFrame, silver: DataFrame, targets: Mapping[str, int], weights: Mapping[str, float] = P.MAJOR_WEIGHTS) -> DataFrame:
    """Gold items for each label up to its target less the silver ones: rare types first, then the weighted types within
    their quotas, each by score; claims that silver has are left out.

    ``items``: from ``training_items``; ``silver``: claim_text, label. At most target rows of each type are ranked.
    """
    kinds = [*P.RARE_TYPES, *weights]
    have = {r["label"]: r["n"] for r in silver.where(F.col("label").isin(*targets)).groupBy("label").agg(F.count("*").alias("n")).collect()}
    good = without_claims(items.where(X.merge_candidate("claim_text") & F.col("label").isin(*targets)), silver).withColumns(item_score())
    counts = {(r["label"], r["claim_type"]): r["n"] for r in good.where(F.col("claim_type").isin(*kinds)).groupBy("label", "claim_type").agg(F.count("*").alias("n")).collect()}
    rows = []
    for label, target in targets.items():
        need = max(0, target - have.get(label, 0))
        rare = [(label, t, min(counts.get((label, t), 0), need), k) for k, t in enumerate(P.RARE_TYPES)]
        left = max(0, need - sum(r[2] for r in rare))
        major = major_quotas(left, {t: counts.get((label, t), 0) for t in weights}, weights)
        rows += [*rare, *((label, t, q, len(rare) + k) for k, (t, q) in enumerate(major.items()))]
    quota = good.sparkSession.createDataFrame(rows, "label string, claim_type string, quota int, priority int")
    order = [F.desc("s1"), F.desc("s2"), F.desc("s3"), F.desc("s4"), F.col("pair_id")]
    largest = max([r[2] for r in rows], default=0)
    ranked = top_by(good, ["label", "claim_type"], order, largest).join(F.broadcast(quota), ["label", "claim_type"]).where("rn <= quota")
    need = {label: max(0, t - have.get(label, 0)) for label, t in targets.items()}
    cut = top_by(ranked, ["label"], [F.col("priority"), F.col("rn")], max(need.values(), default=0), "place")
    limit = F.coalesce(*[F.when(F.col("label") == k, v) for k, v in need.items()])
    return cut.where(F.col("place") <= limit).drop("s1", "s2", "s3", "s4", "rn", "quota")


def merged_metadata(metadata: Column, source: Column | str, label: Column | str, claim: Column | str) -> Column:
    """Pair metadata with its dataset, lower-case label and claim text, the latter from the prompt where missing."""
    return metadata.withField("source_dataset", X._col(source)).withField("merged_label", F.lower(X._col(label))).withField("claim_text", X._col(claim))


def prompt_claim(prompt: Column | str) -> Column:
    """The claim text inside a prompt, else empty."""
    return X.strip(F.regexp_extract(X.or_empty(prompt), P.PROMPT_CLAIM, 1))
