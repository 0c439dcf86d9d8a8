"""Splits that keep related records together.

1. *Components.* Records are linked by equal source ids and equal entity ids. Every source is first folded onto its
   smallest entity, which leaves a graph of entities only; large-star and small-star rounds then contract it to stars.
   Each round is two joins and aggregations over distinct edges and is cut by a checkpoint in shared storage.
2. *Balance.* Components are weighted by their records. Only the histogram weight -> number of components reaches the
   driver; N records have at most sqrt(2 N) distinct weights. The largest-differencing method combines the extreme
   weights into ``BINS`` nearly equal bins, and whole bins go to the splits by target proportion.

Defined results: ids that are null or no numbers are no ids; a record without any id is in no group (its split is drawn
alone, as a component of one); repeated rows keep their own ``seq``; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.operators.ranking import salted_rank
from gavelspark.session import cut

#: Equal bins that the components are combined into before whole bins are dealt to splits.
BINS = 40
TARGETS = {"train": 0.8, "validation": 0.1, "test": 0.1}
NUMBER = r"^[+-]?[0-9]+([.][0-9]*)?([eE][+-]?[0-9]{1,2})?$"


def number_id(column: Column | str) -> Column:
    """An id as a number, however it was written (blanks, leading zeros, a trailing .0, an exponent); else null."""
    text = F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"^[\s ]+|[\s ]+$", "")
    return F.when(text.rlike(NUMBER), text.try_cast("decimal(38,9)"))


def number_text(number: Column) -> Column:
    """A number in plain digits, without trailing zeros."""
    whole = F.floor(number)
    return F.when(number == whole, whole.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(number.cast("string"), r"0+$", ""))


def star_components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges``: a, b (any orderable type, nulls and loops ignored). Returns node, root: every node that has an edge and
    the smallest node of its component. A hub's edges are joined, never collected into one group.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = large.where("a <> b").distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now


def linked_groups(records: DataFrame, source: str, entity: str) -> DataFrame:
    """Records with at least one id and the key of their group.

    ``records``: seq and two id columns. Adds ``group_key``: ``b:`` and the group's smallest entity, or ``s:`` and its
    smallest source where no record of the group has an entity.
    """
    rows = records.select("seq", number_id(source).alias("s"), number_id(entity).alias("b")).where("s is not null or b is not null")
    pairs = rows.where("s is not null").groupBy("s", "b").agg(F.count("*").alias("n"))
    anchor = pairs.groupBy("s").agg(F.min("b").alias("anchor"))
    edges = pairs.where("b is not null").join(anchor, "s").select(F.col("b").alias("a"), F.col("anchor").alias("b"))
    roots = star_components(edges)
    held = rows.join(anchor, "s", "left").withColumn("node", F.coalesce("b", "anchor"))
    keyed = held.join(roots, "node", "left")
    entity_key = F.concat(F.lit("b:"), number_text(F.coalesce("root", "node")))
    return keyed.select("seq", F.when(F.col("node").isNotNull(), entity_key).otherwise(F.concat(F.lit("s:"), number_text(F.col("s")))).alias("group_key"))


def largest_differencing(histogram: Mapping[int, int], bins: int) -> tuple[list[int], dict[int, list[int]]]:
    """Deal weights to ``bins`` nearly equal bins.

    Returns the bins' sums and, for each weight, the bins of its last ``count % bins`` items; all items before those
    are dealt in turn, one to each bin, which is what combining ``bins`` equal weights gives.
    """
    base = sum(weight * (count // bins) for weight, count in histogram.items())
    heap: list[tuple[int, int, list[tuple[int, list]]]] = []
    order = 0
    for weight, count in histogram.items():
        for _ in range(count % bins):
            heap.append((-weight, order, [(weight, [weight])]))
            order += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, x = heapq.heappop(heap)
        _, _, y = heapq.heappop(heap)
        x = x + [(0, [])] * (bins - len(x))
        y = [(0, [])] * (bins - len(y)) + y[::-1]
        joined = sorted(((a + b, p + q if p and q else p or q) for (a, p), (b, q) in zip(x, y, strict=True)), key=lambda v: -v[0])
        low = joined[-1][0]
        # only differences matter from here on; the sums are taken again at the end
        trimmed = [(s - low, items) for s, items in joined]
        heapq.heappush(heap, (-trimmed[0][0], order, trimmed))
        order += 1
    final = heap[0][2] if heap else []
    final = final + [(0, [])] * (bins - len(final))
    last: dict[int, list[int]] = {}
    sums = []
    for k, (_, items) in enumerate(final):
        sums.append(base + sum(items))
        for weight in items:
            last.setdefault(weight, []).append(k)
    return sums, last


def deal_bins(sums: Sequence[int], targets: Mapping[str, float]) -> list[str]:
    """Give every bin, largest first, to the split that is furthest below its target."""
    total = sum(sums) or 1
    share = sum(targets.values())
    left = {name: total * part / share for name, part in targets.items()}
    out = [""] * len(sums)
    for k in sorted(range(len(sums)), key=lambda k: (-sums[k], k)):
        name = max(left, key=lambda n: (left[n], targets[n]))
        out[k] = name
        left[name] -= sums[k]
    return out


def balanced_splits(spark: SparkSession, groups: DataFrame, targets: Mapping[str, float] = TARGETS, bins: int = BINS) -> DataFrame:
    """One split for each group. ``groups``: group_key, weight. Returns group_key, split."""
    groups = cut(groups.select("group_key", F.col("weight").cast("long").alias("weight")))
    histogram = {r["weight"]: r["n"] for r in groups.groupBy("weight").agg(F.count("*").alias("n")).orderBy("weight").collect()}
    sums, last = largest_differencing(histogram, bins)
    split = deal_bins(sums, targets)
    rest = spark.createDataFrame([(w, i, split[k]) for w, ks in last.items() for i, k in enumerate(ks)] or [(-1, 0, "")], "weight long, place long, rest_split string")
    whole = spark.createDataFrame([(w, c - c % bins) for w, c in histogram.items()] or [(-1, 0)], "weight long, n_whole long")
    in_turn = F.element_at(F.array(*[F.lit(s) for s in split]), (F.col("rank") % bins + 1).cast("int"))
    return (
        salted_rank(groups, ["weight"], "group_key")
        .join(whole, "weight")
        .withColumn("place", F.col("rank") - F.col("n_whole"))
        .join(rest, ["weight", "place"], "left")
        .select("group_key", F.when(F.col("place") < 0, in_turn).otherwise(F.col("rest_split")).alias("split"))
    )


def split_records(records: DataFrame, source: str, entity: str, targets: Mapping[str, float] = TARGETS, bins: int = BINS) -> DataFrame:
    """Every record with its group and split; a record without ids is a group of its own, ``r:`` and its seq."""
    linked = cut(linked_groups(records, source, entity))
    alone = records.select("seq").join(linked.select("seq"), "seq", "left_anti").select("seq", F.concat(F.lit("r:"), F.col("seq").cast("string")).alias("group_key"))
    every = linked.unionByName(alone)
    splits = balanced_splits(records.sparkSession, every.groupBy("group_key").agg(F.count("*").alias("weight")), targets, bins)
    return every.join(splits, "group_key").select("seq", "group_key", "split")
