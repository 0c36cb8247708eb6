"""Queries on the analysis of a whole case: spoofing, look-alikes, threads, extraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from mailquarry.functions import mail as M
from mailquarry.operators import impersonation, store, threads
from mailquarry.plans.queries_formats import TIDY
from mailquarry.plans.queries_tables import _NAMED, _named
from mailquarry.plans.registry import ATT, KEY, by_key, customers, query
from mailquarry.sources.case import fixture_domains, fixture_subjects, fixture_threads, table

#: Names, addresses and headers of a message, and the flags they get; all from the key of a customer.
_SPOOF = {
    "name": by_key(KEY, "c_name", "c_name", "'desk@lagune' || {k} || '.test'", "'Nora'", "'Nora'", "NULL", "'nora@atelier' || {k} || '.test'"),
    "email": by_key(KEY, *["'nora@atelier' || {k} || '.test'"] * 5, "'n@one' || {k} || '.co.uk'", "NULL"),
    "hdr": by_key(KEY, "NULL", "'Nora <nora@atelier' || {k} || '.test>'", "NULL", "NULL", "NULL", "NULL", "NULL"),
    "reply": by_key(KEY, "'desk@lagune' || {k} || '.test'", "NULL", "NULL", "'a@shop.atelier' || {k} || '.test'", "'q@lagune' || {k} || '.test'", "'m@two.co.uk, p@three' || {k} || '.co.uk'", "'desk@lagune.test'"),
    "path": by_key(KEY, "NULL", "'r@lagune' || {k} || '.test'", "NULL", "'<b@post.atelier' || {k} || '.test>'", "'r@lagune.test'", "NULL", "NULL"),
    "spf": by_key(KEY, "'pass'", "'pass'", "NULL", "'pass'", "'neutral'", "NULL", "NULL"),
    "dkim": by_key(KEY, "NULL", "NULL", "NULL", "'pass'", "'fail'", "NULL", "NULL"),
    "dmarc": by_key(KEY, "NULL", "NULL", "NULL", "'pass'", "NULL", "'fail'", "NULL"),
}


@query(f"SELECT c_custkey AS k, {by_key(KEY, '1', '2', '4', '0', '19', '17', '0')} AS flags FROM customer")
def spf1_spoof_flags(spark, sf_dir):
    return customers(spark, sf_dir, **_SPOOF).select("k", M.spoof_flags(*(F.col(c) for c in _SPOOF)).alias("flags"))


#: A header block of each customer's message: by turns another Return-Path, another Reply-To and a failure, nothing of these.
_BLOCKS = "'From: Lea <lea@maurin' || c_custkey || '.test>' || chr(10) || " + by_key(
    KEY,
    "'Return-Path: <bounce@lagune' || {k} || '.test>' || chr(10) || 'Authentication-Results: x; spf=pass; dkim=pass'",
    "'Reply-To: desk@lagune' || {k} || '.test' || chr(10) || 'Authentication-Results: x; spf=pass; dkim=fail'",
    "'Reply-To: desk@shop.maurin' || {k} || '.test' || chr(10) || 'Return-Path: <b@maurin' || {k} || '.test>'",
)


@query(f"SELECT c_custkey AS k, {by_key(KEY, '2', '17', '0')} AS flags FROM customer")
def spf1_header_block(spark, sf_dir):
    h = customers(spark, sf_dir, raw=_BLOCKS, email="'lea@maurin' || c_custkey || '.test'").select("k", "email", M.headers(F.col("raw")).alias("h")).withColumn("a", M.authentication(F.col("h")))
    first = lambda n: M.first_of(F.col("h"), n)
    flags = M.spoof_flags(F.lit("Lea"), F.col("email"), first("From"), first("Reply-To"), first("Return-Path"), F.col("a.spf"), F.col("a.dkim"), F.col("a.dmarc"))
    return h.select("k", flags.alias("flags"))


_ORGQ = "CASE WHEN len(string_split(domain, '.')) <= 2 THEN domain ELSE array_to_string(string_split(domain, '.')[-2:], '.') END"
_DOM = "array_to_string(list_reverse(list_reverse(string_split(replace(regexp_extract(url, '://([^/?#]*)', 1), '.example.', '.'), '.'))[1:2]), '.')"
_SKEL = "replace(replace(replace(translate(lower({0}), '015il|-_', 'olslll'), 'rn', 'm'), 'vv', 'w'), 'cl', 'd')"
_LOOK = f"""WITH d AS (SELECT {_DOM} AS domain FROM pages), o AS (SELECT {_ORGQ} AS domain, count(*) AS n FROM d GROUP BY 1),
  l AS (SELECT domain, n, split_part(domain, '.', 1) AS label, substr(domain, length(split_part(domain, '.', 1)) + 2) AS suffix, {_SKEL.format("split_part(domain, '.', 1)")} AS skel FROM o WHERE contains(domain, '.')),
  p AS (SELECT a.domain, f.domain AS resembles, a.n AS messages, f.n AS fn,
        CASE WHEN a.label = f.label AND a.suffix <> f.suffix THEN 'suffix' WHEN a.label <> f.label AND a.skel = f.skel THEN 'homoglyph'
             WHEN a.label <> f.label AND length(f.label) >= 5 AND damerau_levenshtein(a.label, f.label) <= 1 THEN 'typo' END AS kind
        FROM l a JOIN l f ON f.n >= 5 AND f.n >= 5 * a.n AND f.domain <> a.domain WHERE length(a.label) >= 4)
  SELECT domain, resembles, kind, messages FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY fn DESC, resembles) AS k FROM p WHERE kind IS NOT NULL) WHERE k = 1"""


@query(_LOOK)
def spf3_lookalikes(spark, sf_dir):
    return impersonation.lookalikes(fixture_domains(spark, sf_dir))


#: Customers as sender domains in fives: a frequent one, and ones that look like it by a digit, by what is behind the label, by a letter more, not at all. The
#: letters of two frequent ones differ in two places at least.
_CODE = "translate(lpad(CAST(CAST(floor(c_custkey / 5) AS BIGINT) AS STRING), 6, '0') || reverse(lpad(CAST(CAST(floor(c_custkey / 5) AS BIGINT) AS STRING), 6, '0')), '0123456789', 'bdfghjkmpt')"
_SENDERS = by_key(KEY, f"'vale' || {_CODE} || '.test'", f"'va1e' || {_CODE} || '.test'", f"'vale' || {_CODE} || '.shop'", f"'vale' || {_CODE} || 'x.test'", f"'q' || {_CODE} || 'zz.test'")
_SENT = by_key(KEY, "80", "1", "2", "1", "3")


@query(f"""SELECT {_SENDERS} AS domain, 'vale' || {_CODE} || '.test' AS resembles, {by_key(KEY, "''", "'homoglyph'", "'suffix'", "'typo'", "''")} AS kind, CAST({_SENT} AS BIGINT) AS messages FROM customer WHERE c_custkey % 5 IN (1, 2, 3)""")
def jon9_domain_pairs(spark, sf_dir):
    return impersonation.lookalikes(customers(spark, sf_dir, domain=_SENDERS, n=f"CAST({_SENT} AS BIGINT)"))


_FAKE = "fk AS (SELECT ct.name, ct.email FROM ct JOIN tp USING (name) WHERE email <> top_email AND top_n >= 2 AND top_n >= n AND split_part(email, '@', 2) <> split_part(top_email, '@', 2))"


@query(f"WITH {_NAMED}, {_FAKE} SELECT name, email FROM fk")
def spf4_impersonated_names(spark, sf_dir):
    return impersonation.impersonated(impersonation.names(_named(spark, sf_dir)), least=2, ratio=1)


@query(f"WITH {_NAMED}, {_FAKE} SELECT nm.id, CAST(CASE WHEN nm.email LIKE '%@d1.fr' THEN 8 ELSE 0 END + CASE WHEN fk.name IS NOT NULL THEN 32 ELSE 0 END AS INTEGER) AS spoof_flags FROM nm LEFT JOIN fk USING (name, email) WHERE nm.email IS NOT NULL")
def spf2_case_flags(spark, sf_dir):
    m = _named(spark, sf_dir)
    fakes = impersonation.impersonated(impersonation.names(m), least=2, ratio=1)
    return impersonation.case_flags(m, spark.createDataFrame([("d1.fr",)], "domain string"), fakes)


@query(f"WITH {_NAMED}, {_FAKE} SELECT nm.id, fk.name IS NOT NULL AS flagged FROM nm LEFT JOIN fk USING (name, email)")
def jon12_flag_back_join(spark, sf_dir):
    m = _named(spark, sf_dir)
    fakes = impersonation.impersonated(impersonation.names(m), least=2, ratio=1).withColumn("flagged", F.lit(True))
    own = m.select("id", F.lower("sender_name").alias("name"), F.lower("sender_email").alias("email"))
    return own.join(fakes, ["name", "email"], "left").select("id", F.coalesce("flagged", F.lit(False)).alias("flagged"))


_THREADS = """WITH i AS (SELECT conv_id * 1000000 + turn AS id, conv_id FROM conversations), r AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
  t AS (SELECT conv_id * 1000000 + turn AS id, min(conv_id * 1000000 + turn) OVER (PARTITION BY conv_id, run) AS thread_id, CAST(count(*) OVER (PARTITION BY conv_id, run) AS INTEGER) AS thread_count FROM r) SELECT id, thread_id, thread_count FROM t"""


@query(_THREADS)
def thr1_strong_threads(spark, sf_dir):
    return threads.build(fixture_threads(spark, sf_dir), weak=False)


#: Without a link inside a subject before, a message's own thread is met only after a link in common, so what it links to is the nearest of eight that fits.
_WEAK = """s AS (SELECT conv_id * 1000000 + turn AS id, conv_id, turn, (conv_id * 3 + turn) % 40 AS subject, (conv_id * 37 + turn * 11) % 2000 AS day, 'a' || conv_id % 7 AS p1, role || turn % 3 AS p2 FROM conversations),
  o AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY day, id) AS k FROM s),
  w AS (SELECT x.id AS a, arg_max(y.id, y.k) AS b FROM o x JOIN o y ON x.subject = y.subject AND y.k < x.k AND y.k >= x.k - 8 AND x.day - y.day <= 120 AND (x.p1 = y.p1 OR x.p2 = y.p2) GROUP BY x.id)"""


@query(
    f"""WITH RECURSIVE {_WEAK}, e AS (SELECT a, b FROM w UNION ALL SELECT b, a FROM w UNION ALL SELECT conv_id * 1000000, conv_id * 1000000 + 1 FROM s WHERE turn = 1 AND conv_id % 2 = 0
  UNION ALL SELECT conv_id * 1000000 + 1, conv_id * 1000000 FROM s WHERE turn = 1 AND conv_id % 2 = 0),
  r AS (SELECT id AS n, id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.n WHERE r.root < e.b), m AS (SELECT n AS id, min(root) AS thread_id FROM r GROUP BY n)
  SELECT id, thread_id, CAST(count(*) OVER (PARTITION BY thread_id) AS INTEGER) AS thread_count FROM m"""
)
def thr2_weak_links(spark, sf_dir):
    return threads.build(fixture_subjects(spark, sf_dir))


@query(f"WITH {_WEAK} SELECT a, b FROM w")
def jon10_weak_candidates(spark, sf_dir):
    items = fixture_subjects(spark, sf_dir)
    return threads.weak_edges(items, threads.components(threads.strong_edges(items)))


@query("SELECT thread_id, CAST(max(thread_count) AS INTEGER) AS thread_count, count(*) AS n FROM (" + _THREADS + ") GROUP BY thread_id")
def thr3_thread_sizes(spark, sf_dir):
    t = threads.build(fixture_threads(spark, sf_dir), weak=False)
    return t.groupBy("thread_id").agg(F.max("thread_count").alias("thread_count"), F.count(F.lit(1)).alias("n"))


@query("SELECT thread_count, count(*) AS messages, count(DISTINCT thread_id) AS threads FROM (" + _THREADS + ") GROUP BY thread_count")
def agg13_thread_size(spark, sf_dir):
    t = threads.build(fixture_threads(spark, sf_dir), weak=False)
    return t.groupBy("thread_count").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("thread_id").alias("threads"))


@query("SELECT o_orderkey AS id, CAST(o_custkey % 10 AS INTEGER) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM orders WHERE o_orderkey % 7 = 0 OR (o_orderkey % 11 = 0 AND o_custkey % 10 = 0)")
def thr4_changed_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    plain = (F.col("o_custkey") % 10).cast("int")
    old = o.select(F.col("o_orderkey").alias("id"), F.when((F.col("o_orderkey") % 11 == 0) & (plain == 0), F.lit(None)).otherwise(plain).alias("v"))
    new = o.select(F.col("o_orderkey").alias("id"), (plain + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("v"))
    return store.changed(old, new, "id", ["v"])


@query("SELECT id, thread_id FROM (" + _THREADS + ")")
def thr4_incremental_threads(spark, sf_dir):
    """Every third turn first, then the others, which tie together what was apart."""
    items, state = fixture_threads(spark, sf_dir), threads.start(spark)
    for part in ("id % 3 = 0", "id % 3 = 2", "id % 3 = 1"):
        state, _ = threads.extend(state, items.filter(part))
    return state.labels.withColumnRenamed("root", "thread_id")


# --- extraction -------------------------------------------------------------------------------------------------


@query(f"""WITH {ATT}, t AS (SELECT message_id, {TIDY.format('content')} AS c FROM att) SELECT message_id, '0' AS idx_path, message_id || '.html' AS name, CASE WHEN c = '' THEN 'empty' ELSE 'ok' END AS status, sha256(html) AS sha256, CAST(length(c) AS INTEGER) AS chars
  FROM t JOIN pages ON page_id = message_id""")
def ext2_extracted_attachments(spark, sf_dir):
    from mailquarry.extract.dispatch import extract_frame

    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("message_id"), F.lit("0").alias("idx_path"), F.concat(F.col("page_id"), F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("data"))
    return extract_frame(p).select("message_id", "idx_path", "name", "status", "sha256", "chars")


#: Names and first bytes of files, and what they are.
_FILES = [
    ("'a' || {k} || '.docx'", "504B0304", "zip"), ("'a.doc'", "504B050600", "zip"), ("'a' || {k} || '.pdf'", "255044462D", "pdf"), ("'a' || {k} || '.pdf'", "68656C6C6F", "pdf"), ("'a' || {k} || '.doc'", "D0CF11E0A1B11AE1", "ole"),
    ("'a' || {k} || '.txt'", "68656C6C6F", "text"), ("'x' || {k} || '.docx'", "68656C6C6F", "unsupported"), ("'a' || {k} || '.bin'", "0001", "unsupported"), ("'a' || {k} || '.txt'", "0A20FF7B5C72746631", "rtf"),
    ("'m' || {k} || '.eml'", "46726F6D3A", "mime"), ("'P.MHTML'", "46726F6D3A", "html"), ("'a' || {k} || '.url'", "5B", "text"), ("'a' || {k} || '.kml'", "3C", "xml"), ("'a' || {k} || '.config'", "3C", "xml"), ("'a' || {k} || '.py'", "23", "unsupported"),
    ("'a' || {k} || '.msg'", "68656C6C6F", "unsupported"), ("'a' || {k} || '.reg'", "57", "text"),
]


@query(f"""SELECT c_custkey AS k, {by_key(KEY, *(f"'{kind}'" for _, _, kind in _FILES))} AS kind FROM customer""")
def ext1_format_sniffing(spark, sf_dir):
    from mailquarry.extract.dispatch import sniff

    def run(batches):
        for b in batches:
            kinds = [sniff(n, bytes.fromhex(h)) or "unsupported" for n, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string())], names=["k", "kind"])

    own = customers(spark, sf_dir, name=by_key(KEY, *(n for n, _, _ in _FILES)), head=by_key(KEY, *(f"'{h}'" for _, h, _ in _FILES)))
    return own.mapInArrow(run, "k long, kind string")


@query("SELECT page_id, CASE WHEN octet_length(encode(html)) > 2000 THEN 'toolarge' WHEN html = '' THEN 'empty' ELSE 'ok' END AS status FROM pages")
def ext12_status_chain(spark, sf_dir):
    from mailquarry.extract.dispatch import first_status

    p = table(spark, sf_dir, "pages").select("page_id", F.lit("x.html").alias("name"), F.col("html").cast("binary").alias("data"))
    return p.select("page_id", F.coalesce(first_status(F.col("name"), F.col("data"), 2000), F.lit("ok")).alias("status"))
