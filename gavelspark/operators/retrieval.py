"""Exact top-k retrieval by inner product of normed vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.functions.values import normed

#: Queries searched for at a time; a block is broadcast, so this bounds what each task holds.
QUERY_BLOCK = 4096


def top_k(base: DataFrame, queries: DataFrame, k: int = 5, least: float | None = None) -> DataFrame:
    """The ``k`` nearest rows of ``base`` for every query; ties go to the smaller id; ``least`` is a strict bound after.

    ``base``: id, vector; ``queries``: query_id, vector. The queries go out in blocks against all rows; every task keeps
    ``k`` rows for each query, and a window over these picks the best. Null vectors match nothing.
    """
    spark = base.sparkSession
    rows = base.where("vector is not null").select("id", normed("vector").alias("v"))
    schema = "query_id long, id long, score double"
    out = spark.createDataFrame([], schema)

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([q for q, _ in block], dtype=np.int64), np.array([v for _, v in block], dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, vectors = shared.value
            kept: pd.DataFrame | None = None
            for pdf in batches:
                if not len(pdf):
                    continue
                scores = np.stack(pdf.v.to_numpy()) @ vectors.T
                n = min(k, len(pdf))
                # rows in id order, a stable sort: ties keep the smaller id
                order = np.argsort(pdf.id.to_numpy(), kind="stable")
                scores, row_ids = scores[order], pdf.id.to_numpy()[order]
                top = np.argsort(-np.round(scores, 12), axis=0, kind="stable")[:n]
                part = pd.DataFrame({"query_id": np.repeat(ids, n), "id": row_ids[top.T].ravel(), "score": np.take_along_axis(scores, top, 0).T.ravel()})
                kept = part if kept is None else pd.concat([kept, part])
                kept = kept.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if kept is not None:
                yield kept

        return rows.mapInPandas(run, schema)

    block = []
    for row in queries.where("vector is not null").select("query_id", normed("vector").alias("v")).orderBy("query_id").toLocalIterator():
        block.append((row["query_id"], row["v"]))
        if len(block) == QUERY_BLOCK:
            out, block = out.unionByName(search(block)), []
    if block:
        out = out.unionByName(search(block))
    rank = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    best = out.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= k)
    return best if least is None else best.where(F.col("score") > least)
