"""Insert-only writes: the first writer of a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.operators.ordering import first_of_each


def new_rows(
    batch: DataFrame, stored: DataFrame, keys: list[str], order: list[Column] | None = None
) -> DataFrame:
    """Rows of the batch whose key is neither stored nor held by an earlier row.

    `order` says which of equal keys in the batch is first; None states that the
    batch has no equal keys.
    """
    firsts = first_of_each(batch, keys, order) if order else batch
    return firsts.join(stored.select(*keys), keys, "left_anti")

