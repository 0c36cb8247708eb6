"""Addresses, domains, subjects, message ids and header blocks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand before the at sign of an address, and behind it.
BEFORE_AT = r"[A-Za-z0-9._%+\-'!#$&*/=?^`{|}~]"
BEHIND_AT = r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"

#: An address begins where such a run does, or where the address before it ended. So a long run without an at sign, such as encoded data, is gone through once.
ADDRESS = rf"(?:\G|(?<!{BEFORE_AT})){BEFORE_AT}++@{BEHIND_AT}"

#: Second-level names under which organisations register in two-letter domains.
SECOND_LEVEL = ["co", "com", "org", "net", "gov", "ac", "edu", "gouv", "asso", "or", "ne", "go"]

#: Reply and forward marks before a subject.
REPLY_MARKS = ["re", "tr", "fw", "fwd", "rv", "aw", "wg", "sv", "vs", "antw", "res", "enc"]


def addresses(c: Column) -> Column:
    """All addresses in a text, in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ADDRESS), F.lit(0)), F.lower)


def first_address(c: Column) -> Column:
    return F.get(addresses(c), F.lit(0))


def domain_of(address: Column) -> Column:
    """What follows the last @, in lower case; null if there is nothing."""
    d = F.lower(F.regexp_replace(F.trim(F.regexp_extract(address, "@([^@]+)$", 1)), "[>.]+$", ""))
    return F.when(d != "", d)


def organisational(domain: Column) -> Column:
    """The registered domain: the last two labels, or three below a two-letter domain's second level."""
    clean = F.regexp_replace(F.lower(F.trim(domain)), r"\.+$", "")
    parts = F.split(clean, r"\.")
    n = F.size(parts)
    keep = F.when((F.length(F.element_at(parts, -1)) == 2) & F.get(parts, n - 2).isin(SECOND_LEVEL), 3).otherwise(2)
    return F.when(F.trim(domain) != "", F.when(n <= 2, clean).otherwise(_last(parts, keep)))


def _last(parts: Column, keep: Column) -> Column:
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - keep + 1, F.lit(1)), keep), ".")


def label(org: Column) -> Column:
    return F.substring_index(org, ".", 1)


def suffix(org: Column) -> Column:
    return F.regexp_extract(org, r"^[^.]*\.(.*)$", 1)


def normalise_subject(c: Column) -> Column:
    marks = "|".join(REPLY_MARKS)
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)^\s*(?:(?:{marks})\s*(?:\[\d+\])?\s*:\s*)+", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def normalise_id(c: Column) -> Column:
    out = F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), "^[<>]+", ""), "[<>]+$", ""))
    return F.when(F.trim(c) != "", out)


def referenced_ids(in_reply_to: Column, references: Column) -> Column:
    """Normalised ids that a message refers to; bare ids count only where none stands in brackets."""
    bracketed = F.regexp_extract_all(F.coalesce(references, F.lit("")), F.lit(r"<([^<>\s]+)>"), F.lit(1))
    bare = F.filter(F.split(F.coalesce(references, F.lit("")), "[ \t,]+"), lambda x: x != "")
    listed = F.when(F.size(bracketed) > 0, bracketed).otherwise(bare)
    return F.array_compact(F.concat(F.array(normalise_id(in_reply_to)), F.transform(listed, normalise_id)))


# --- header blocks --------------------------------------------------------------------------------------


def headers(raw: Column) -> Column:
    """array<struct<name, value>> of a header block, in order, folded lines joined.

    The block ends at its first empty line; a name has no blank before its colon; leading empty lines are skipped.
    """
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), "\r", "")
    text = F.regexp_replace(text, "^\n+", "")
    text = F.substring_index(text, "\n\n", 1)
    text = F.regexp_replace(text, "[ \t]*\n[ \t]+", " ")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"^[^ :]+:")))
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).alias("value")))


def all_of(block: Column, name: str) -> Column:
    return F.transform(F.filter(block, lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"])


def first_of(block: Column, name: str) -> Column:
    return F.get(all_of(block, name), F.lit(0))


def verdict(header: Column, method: str) -> Column:
    """The verdict of a method in an Authentication-Results header; of several DKIM ones a pass wins."""
    found = F.transform(F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(rf"(?i)\b{method}\s*=\s*([a-z]+)"), F.lit(1)), F.lower)
    if method == "dkim":
        return F.when(F.array_contains(found, "pass"), F.lit("pass")).otherwise(F.get(found, F.lit(0)))
    return F.get(found, F.lit(0))


def authentication(block: Column) -> Column:
    """struct<spf, dkim, dmarc>: of the topmost Authentication-Results header with a verdict; SPF else of Received-SPF."""
    results = F.filter(all_of(block, "Authentication-Results"), lambda h: F.rlike(h, F.lit(r"(?i)\b(?:spf|dkim|dmarc)\s*=\s*[a-z]")))
    top = F.get(results, F.lit(0))
    received = F.lower(F.regexp_extract(F.coalesce(first_of(block, "Received-SPF"), F.lit("")), r"(?i)^\s*([a-z]+)", 1))
    spf = F.coalesce(verdict(top, "spf"), F.when(received != "", received))
    return F.struct(spf.alias("spf"), verdict(top, "dkim").alias("dkim"), verdict(top, "dmarc").alias("dmarc"))


#: Verdicts that count as failures.
FAILURES = ["fail", "softfail", "permerror"]


def misleading_name(name: Column, email: Column) -> Column:
    """Whether a display name holds an address of another organisation than the sender's."""
    own = organisational(domain_of(email))
    other = F.exists(addresses(name), lambda a: F.coalesce(organisational(domain_of(a)) != own, F.lit(False)))
    return F.coalesce((F.trim(name) != "") & (F.trim(email) != "") & other, F.lit(False))


def spoof_flags(name: Column, email: Column, from_header: Column, reply_to: Column, return_path: Column, spf: Column, dkim: Column, dmarc: Column) -> Column:
    """Bits: 1 all Reply-To organisations differ from the sender's, 2 the Return-Path's differs, 4 the display
    name shows another organisation's address, 16 an authentication method failed."""
    own = organisational(domain_of(F.coalesce(first_address(from_header), F.lower(email))))
    replies = F.array_compact(F.transform(addresses(reply_to), lambda a: organisational(domain_of(a))))
    path = organisational(domain_of(first_address(return_path)))
    failed = [F.coalesce(v.isin(FAILURES), F.lit(False)) for v in (spf, dkim, dmarc)]
    bits = [
        (1, own.isNotNull() & (F.size(replies) > 0) & ~F.array_contains(replies, own)),
        (2, own.isNotNull() & path.isNotNull() & (path != own)),
        (4, misleading_name(name, email)),
        (16, failed[0] | failed[1] | failed[2]),
    ]
    out = F.lit(0)
    for bit, test in bits:
        out = out + F.when(test, bit).otherwise(0)
    return out


# --- Received ---------------------------------------------------------------------------------------------

_STOPS = ["by", "with", "id", "for", "via", "from"]
_PRIVATE = r"^(?:10\.|127\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.)"


def _between(body: Column, keyword: str) -> Column:
    from .dates import once

    stops = "|".join(s for s in _STOPS if s != keyword)
    value = F.trim(F.regexp_extract(body, rf"(?is)(?:^|\s){keyword}\s+(.*?)(?:\s(?:{stops})\s|$)", 1))
    return once(value, lambda x: F.when(x != "", F.substring(x, 1, 200)))


def hops(block: Column) -> Column:
    """array<struct<index, from, from_ip, by, with, time>> of the Received headers, oldest first."""
    from .dates import once, parse_date

    last = lambda a: F.get(a, F.size(a) - 1)
    filled = lambda c: once(c, lambda x: F.when(x != "", x))

    def address(sender: Column) -> Column:
        six = F.regexp_extract(sender, r"\[(?:IPv6:)?([0-9a-fA-F:]{6,})\]", 1)
        paren = F.regexp_extract(sender, r"\(([0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){3,7})\)", 1)
        four = F.regexp_extract_all(sender, F.lit(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), F.lit(0))
        of = lambda own: F.coalesce(once(F.filter(own, lambda x: ~F.rlike(x, F.lit(_PRIVATE))), last), last(own))
        return F.coalesce(filled(six), filled(paren), once(four, of))

    def hop(raw: Column, i: Column) -> Column:
        stamp = F.when(F.contains(raw, F.lit(";")), parse_date(F.regexp_extract(raw, r"(?s);([^;]*)$", 1)))

        def of(body: Column) -> Column:
            ip = once(F.regexp_extract(body, r"(?is)\bfrom\b(.*?)(?:\bby\b|$)", 1), address)
            return F.struct((i + 1).alias("index"), _between(body, "from").alias("from"), ip.alias("from_ip"), _between(body, "by").alias("by"), _between(body, "with").alias("with"), stamp.alias("time"))

        return once(F.regexp_replace(raw, r"(?s);[^;]*$", ""), of)

    return F.transform(F.reverse(all_of(block, "Received")), hop)


def with_delays(path: Column) -> Column:
    """Seconds of each hop since the previous one that has a time."""
    zero = F.struct(F.array().cast("array<bigint>").alias("delays"), F.lit(None).cast("timestamp").alias("last"))

    def step(acc: Column, h: Column) -> Column:
        gap = F.unix_seconds(h["time"]) - F.unix_seconds(acc["last"])
        return F.struct(F.array_append(acc["delays"], gap).alias("delays"), F.coalesce(h["time"], acc["last"]).alias("last"))

    return F.aggregate(path, zero, step, lambda a: a["delays"])
