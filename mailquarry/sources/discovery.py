"""Which files are sources, what their mailboxes are called, and where moved sources are now."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailquarry.functions.text import nocase

_SPLIT = r"^(.+?)(?:[ _.\-]\(?\d{1,4}\)?|\(\d{1,4}\))$"


def files_below(spark: SparkSession, folder: str) -> DataFrame:
    """path, size and mtime of all files below a folder, without their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


def classify(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path, kind and source of mail files: archives are sources themselves, loose messages belong to their folder.
    Sources that known (path) has are left out."""
    low = F.lower("path")
    kind = F.when(F.rlike(low, F.lit(r"\.(?:pst|ost)$")), "pst").when(F.rlike(low, F.lit(r"\.msg$")), "msg_folder")
    out = files.select("path", kind.alias("kind")).filter(F.col("kind").isNotNull())
    out = out.withColumn("source", F.when(F.col("kind") == "pst", F.col("path")).otherwise(F.regexp_replace("path", r"[/\\][^/\\]*$", "")))
    if known is not None:
        seen = known.select(nocase(F.col("path")).alias("__seen"))
        out = out.join(seen, nocase(F.col("source")) == F.col("__seen"), "left_anti")
    return out


def mailbox_names(files: DataFrame) -> DataFrame:
    """path and mailbox: the file's name without a part number, which only counts as one if the rest is an address or
    another file has the same rest."""
    stem = F.regexp_replace(F.regexp_extract(F.regexp_replace("path", r"[/\\]+$", ""), r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    own = files.select("path", stem.alias("stem"))
    bare = F.trim(F.regexp_extract("stem", _SPLIT, 1))
    own = own.withColumn("base", F.when(bare != "", bare)).withColumn("shared", F.coalesce("base", "stem"))
    n = F.count(F.lit(1)).over(W.partitionBy(F.lower("shared")))
    split = F.col("base").isNotNull() & (F.contains("base", F.lit("@")) | (n > 1))
    return own.withColumn("__n", n).select("path", F.when(split, F.col("base")).otherwise(F.col("stem")).alias("mailbox"))


def normalised(path: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/+$", "")


def _normal(path: str) -> str:
    return path.strip().replace("\\", "/").rstrip("/")


def is_under(path: Column, prefix: str) -> Column:
    """Whether a path is prefix or below it, in any case and with either separator."""
    key, low = F.lower(normalised(path)), _normal(prefix).lower()
    return (key == low) | F.startswith(key, F.lit(low + "/"))


def relocated(path: Column, old: str, new: str) -> Column:
    """The path with the prefix old replaced by new; null if it isn't below old."""
    rest = F.substring(normalised(path), len(_normal(old)) + 1, 100000)
    return F.when(is_under(path, old), F.concat(F.lit(_normal(new)), rest))


def infer_relocation(old: str, new: str) -> tuple[str, str]:
    """The prefixes left when the common end of an old and a new path is cut off; neither becomes empty."""
    a, b = _normal(old).split("/"), _normal(new).split("/")
    k = 0
    while k < min(len(a), len(b)) - 1 and a[-1 - k].lower() == b[-1 - k].lower():
        k += 1
    cut = lambda p: "/".join(p[: len(p) - k]) or "/"
    return cut(a), cut(b)


def relocate(sources: DataFrame, present: DataFrame, old: str, new: str) -> DataFrame:
    """id, path, target and outcome of the sources below old: relocated, not_found, size_mismatch or path_in_use.
    present: path and size of the files that are there now. Nothing is changed."""
    moved = sources.select("id", "path", "size", relocated(F.col("path"), old, new).alias("target")).filter(F.col("target").isNotNull())
    there = present.select(nocase(normalised(F.regexp_replace("path", "^file:", ""))).alias("__p"), F.col("size").alias("__size"))
    used = sources.select(nocase(normalised(F.col("path"))).alias("__used")).distinct()
    key = nocase(normalised(F.col("target")))
    out = moved.join(there, key == F.col("__p"), "left").join(used, key == F.col("__used"), "left")
    outcome = (
        F.when(F.col("__p").isNull(), "not_found")
        .when((F.col("size") > 0) & (F.col("size") != F.col("__size")), "size_mismatch")
        .when(F.col("__used").isNotNull(), "path_in_use")
        .otherwise("relocated")
    )
    return out.select("id", "path", "target", outcome.alias("outcome"))


def natural_parts(name: str) -> list:
    return [int(p) if p.isdigit() else p.lower() for p in re.split(r"(\d+)", name)]
