"""Problem 3: the N best items of every group.

``row_number() <= n`` over a window: the optimiser's group limit keeps at most
``n`` rows per group and task before the shuffle, so a group of millions of
items sends ``n`` rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_items(items: DataFrame, groups: list[str], order: list[Column], n: int, rank: str = "item_rank") -> DataFrame:
    """The first ``n`` rows of every group by ``order``, numbered from 1.

    ``order`` must end in a column that is unique within the group, or equal
    rows are numbered arbitrarily among themselves.  Null keys form a group.  A
    column of ``items`` that is itself named ``rank`` becomes ``<rank>_kept``
    (``order`` and ``groups`` then name it so).  Empty items give no rows.
    """
    if n < 1:
        raise ValueError("n must be positive")
    if rank in items.columns:
        items = items.withColumnRenamed(rank, f"{rank}_kept")
    return items.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(rank) <= n)
