"""The folder tree: paths with their own and their subtrees' counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folder_tree(folders: DataFrame, hide_empty: bool = False) -> DataFrame:
    """path, name, depth, items (of the folder itself, over all parts of a split mailbox) and total (of its subtree).
    Parents that no row names are added. folders: path, items."""
    own = folders.groupBy("path").agg(F.sum("items").cast("long").alias("items"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    # each folder counts for all folders above it; sums are partial before the shuffle
    total = own.select(F.explode(above).alias("path"), "items").groupBy("path").agg(F.sum("items").cast("long").alias("total"))
    out = total.join(own, "path", "left").select(
        "path", F.substring_index("path", "/", -1).alias("name"), (F.size(F.split("path", "/")) - 1).alias("depth"), F.coalesce("items", F.lit(0).cast("long")).alias("items"), "total"
    )
    return out.filter("total > 0") if hide_empty else out
