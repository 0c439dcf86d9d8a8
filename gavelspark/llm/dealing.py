"""Dealing the rows of small scans to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(scan: DataFrame) -> DataFrame:
    """The rows of a scan; dealt to all cores where it has fewer splits than there are cores, as it is otherwise.

    For scans that feed much Python work: one or two small files would keep most cores idle. Which core sees a row changes,
    nothing else; a table large enough to have a split for every core is never shuffled. ``scan``: no join or aggregate.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
