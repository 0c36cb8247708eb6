"""Look-alike domains and impersonated names over the whole case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailquarry.functions.domains import skeleton, within_one_edit
from mailquarry.functions.mail import domain_of, label, organisational, suffix

LEAST, RATIO = 5, 5


def domain_counts(messages: DataFrame) -> DataFrame:
    """Messages by sender domain."""
    return messages.select(domain_of(F.col("sender_email")).alias("domain")).filter(F.col("domain").isNotNull()).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def organisations(domains: DataFrame) -> DataFrame:
    """domains (domain, n) rolled up to organisational domains that have a dot."""
    # of an array, so that what makes the column, and the rule itself, stand once in the generated code
    own = domains.select(F.get(F.transform(F.array("domain"), organisational), F.lit(0)).alias("domain"), "n")
    return own.filter(F.contains("domain", F.lit("."))).groupBy("domain").agg(F.sum("n").cast("long").alias("n"))


def lookalikes(domains: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """domain, resembles, kind and messages: rare domains that resemble a much more frequent one.

    Candidates meet by equality, never all with all: same label, same skeleton, or a part of a label. If one edit
    leads from a frequent label to another, it leaves the first or the last half as it is, or swaps the two characters
    where the halves meet; so a frequent label is known by its halves and by itself without those two, and any label by
    what these would be if it had the frequent one's length. Where several frequent domains fit, the most
    frequent counts, then the first by name.
    """
    org = organisations(domains).select("domain", "n", label(F.col("domain")).alias("label"), suffix(F.col("domain")).alias("suffix"))
    org = org.withColumn("skel", skeleton(F.col("label")))
    rare = org.filter(F.length("label") >= 4)
    often = org.filter(F.col("n") >= least).select(*(F.col(c).alias(f"f_{c}") for c in org.columns))

    def parts(c: Column, lengths: Column) -> Column:
        """For each length the halves of a label that has it, and of c's own length c without the two characters where they meet. A function
        of each length, not an expression for each, keeps the generated code short."""

        def of(n: Column) -> Column:
            h = F.floor(n / 2).cast("int")
            rest = (n - h).cast("int")
            key = lambda mark, *text: F.concat(F.lit(mark), n.cast("string"), F.lit(":"), *text)
            first = key("<", c.substr(F.lit(1), h))
            met = F.when(n == F.length(c), key("=", c.substr(F.lit(1), h - 1), F.lit("|"), c.substr(h + 2, rest)))
            return F.array(first, key(">", c.substr(F.greatest(F.length(c) - rest + 1, F.lit(1)), rest)), F.coalesce(met, first))

        return F.explode(F.array_distinct(F.flatten(F.transform(lengths, of))))

    n = F.length("label")
    own = parts(F.col("label"), F.array(n - 1, n, n + 1))
    known = parts(F.col("f_label"), F.array(F.length("f_label")))
    same_label = rare.join(often, F.col("label") == F.col("f_label"))
    same_skeleton = rare.join(often, F.col("skel") == F.col("f_skel"))
    near = rare.withColumn("part", own).join(often.filter(F.length("f_label") >= 5).withColumn("part", known), "part").drop("part")
    near = near.select(*near.columns, within_one_edit(F.col("label"), F.col("f_label")).alias("edit")).filter("edit")
    met = same_label.union(same_skeleton.select(*same_label.columns)).withColumn("edit", F.lit(False))
    pairs = met.select(*near.columns).union(near).distinct()
    pairs = pairs.filter((F.col("domain") != F.col("f_domain")) & (F.col("f_n") >= F.col("n") * ratio))
    differs = F.col("label") != F.col("f_label")
    kind = (
        F.when(~differs & (F.col("suffix") != F.col("f_suffix")), "suffix")
        .when(differs & (F.col("skel") == F.col("f_skel")), F.when(F.contains("domain", F.lit("xn--")), "punycode").otherwise("homoglyph"))
        .when(differs & F.col("edit"), "typo")
    )
    first = F.row_number().over(W.partitionBy("domain").orderBy(F.col("f_n").desc(), F.col("f_domain")))
    found = pairs.withColumn("kind", kind).filter(F.col("kind").isNotNull()).withColumn("k", first).filter("k = 1")
    return found.select("domain", F.col("f_domain").alias("resembles"), "kind", F.col("n").alias("messages"))


def names(messages: DataFrame) -> DataFrame:
    """Messages by lower-case display name (five characters or more, no address) and sender address."""
    some = messages.filter((F.length("sender_name") >= 5) & F.contains("sender_email", F.lit("@")) & ~F.contains("sender_name", F.lit("@")))
    return some.groupBy(F.lower("sender_name").alias("name"), F.lower("sender_email").alias("email")).agg(F.count(F.lit(1)).alias("n"))


def dominant(counts: DataFrame) -> DataFrame:
    """Each name's most frequent address; of equals the first."""
    w = W.partitionBy("name").orderBy(F.col("n").desc(), F.col("email"))
    return counts.withColumn("k", F.row_number().over(w)).filter("k = 1").select("name", F.col("email").alias("top_email"), F.col("n").alias("top_n"))


def impersonated(counts: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """name and email of rare addresses, of another organisation, under a name that another address mostly uses."""
    both = counts.join(dominant(counts), "name")
    other = ~organisational(domain_of(F.col("email"))).eqNullSafe(organisational(domain_of(F.col("top_email"))))
    return both.filter((F.col("email") != F.col("top_email")) & (F.col("top_n") >= least) & (F.col("top_n") >= F.col("n") * ratio) & other).select("name", "email")


def case_flags(messages: DataFrame, looks: DataFrame, fakes: DataFrame) -> DataFrame:
    """id and spoof_flags of all messages with a sender address: bits 8 (look-alike domain) and 32 (impersonated name)
    set anew, all others as they were."""
    own = messages.filter(F.contains("sender_email", F.lit("@"))).select(
        "id", F.lower("sender_name").alias("name"), F.lower("sender_email").alias("email"), organisational(domain_of(F.col("sender_email"))).alias("org"), "spoof_flags"
    )
    out = own.join(looks.select(F.col("domain").alias("org"), F.lit(8).alias("b8")), "org", "left").join(fakes.withColumn("b32", F.lit(32)), ["name", "email"], "left")
    kept = F.coalesce("spoof_flags", F.lit(0)).bitwiseAND(~40)
    return out.select("id", kept.bitwiseOR(F.coalesce("b8", F.lit(0))).bitwiseOR(F.coalesce("b32", F.lit(0))).alias("spoof_flags"))
