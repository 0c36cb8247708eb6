"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut

#: Hash values that rows are drawn by.
SPACE = 1 << 31


def drawn_ids(rows: DataFrame, by: str, most: int) -> DataFrame:
    """doc_id and `by` of about `most` rows of each value of `by`, drawn by a hash of the id; never more than
    that but for the spread of the hash (a few in the hundred). rows: doc_id and by, without nulls."""
    rows = rows.select("doc_id", by)
    sizes = cut(rows.groupBy(by).count())
    share = rows.join(bounded(sizes), by)  # one row for each label
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(SPACE))
    return cut(share.filter(draw * F.col("count") < F.lit(most) * F.lit(SPACE)).select("doc_id", by))
