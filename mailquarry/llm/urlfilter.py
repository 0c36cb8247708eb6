"""URL filtering by lists of host and path rules.

Each URL is expanded into the host suffixes and path prefixes that some rule could have. An expression is
known by the first bytes of its SHA-256, by which URLs and rules meet in an equi-join; the full digest
then confirms the match, and the longest rule decides. All of it is DataFrame work inside the JVM.

Defined results: a null URL, or one without '://', has an empty host and path, which no rule fits. Pages
that no rule fits get the default verdict. Repeated page ids stay repeated. Of rules that are equally long
the blocking one wins. An empty rule list leaves every page with the default verdict. A very long URL has no more expressions than the rules
have host lengths and path lengths. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, only, table

#: Rules of the registered query: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Hexadecimal digits of the short hash.
SHORT = 8

#: Rules up to this many bytes of hosts and paths are broadcast; longer lists are shuffled.
BROADCAST_BYTES = 32 << 20


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def _expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Array of (host, path) with as many labels and as long a path as some rule has."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    hosts = F.filter(F.array(*(F.when(dots >= k - 1, F.substring_index(host, ".", -k)) for k in labels)), lambda x: x.isNotNull())
    paths = F.filter(F.array(*(F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths)), lambda x: x.isNotNull())
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("host"), p.alias("path")))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule ('host' + 'path', null if none fits) and verdict for every row of pages.

    The driver learns only which label counts and path lengths the rules have, two short lists of numbers
    bounded by the length of a host name and of a path. Rules whose measured size is within
    BROADCAST_BYTES are broadcast; longer lists are shuffled, where Spark splits skewed keys.
    """
    spark = pages.sparkSession
    known = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull()).select(
        ascii_lower(F.col("host")).alias("host"), "path", "verdict"
    )
    sizes = known.select((F.size(F.split("host", r"\.", -1))).alias("labels"), F.length("path").alias("length")).distinct()
    pairs = sizes.agg(F.array_sort(F.collect_set("labels")), F.array_sort(F.collect_set("length"))).first()
    weight = known.agg(F.sum(F.length("host") + F.length("path") + 150)).first()[0] or 0
    labels, lengths = pairs[0], pairs[1]
    urls = only(pages, "page_id", "url").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row_id")
    )
    if not labels:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # of two verdicts for the same expression the blocking one holds
    listed = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    listed = listed.select(
        F.substring(_digest(F.col("host"), F.col("path")), 1, SHORT).alias("short"),
        _digest(F.col("host"), F.col("path")).alias("full"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    spread = urls.withColumn("e", F.explode_outer(_expressions(F.col("host"), F.col("path"), labels, lengths)))
    spread = spread.withColumn("digest", _digest(F.col("e.host"), F.col("e.path"))).drop("e")
    spread = spread.withColumn("short", F.substring("digest", 1, SHORT))
    met = spread.join(F.broadcast(listed) if weight <= BROADCAST_BYTES else listed, "short", "left")
    fits = F.when(F.col("digest") == F.col("full"), F.struct(F.length("rule").alias("n"), F.col("verdict"), F.col("rule")))
    # the rows of a page lie together, so the partial aggregate sends one row a page to the shuffle
    best = met.groupBy("row_id", "page_id", "host", "path").agg(F.max(fits).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_frame(spark))


ORACLE = r"""
WITH p AS (SELECT page_id,
  CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r(verdict, h, q) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
m AS (SELECT row_number() OVER () AS k, * FROM p),
b AS (SELECT k, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
      FROM m JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(b.verdict, 'allow') AS verdict FROM m LEFT JOIN b USING (k)
"""
