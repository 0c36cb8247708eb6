"""Queries on joins, aggregates, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mailquarry.functions import sensitive as S
from mailquarry.operators import impersonation, store, threads
from mailquarry.operators.labels import csv_cell, csv_quoted
from mailquarry.operators.tree import folder_tree
from mailquarry.plans.registry import ATT, KEY, MSG, by_key, by_python, customers, query
from mailquarry.sources.case import fixture_attachments, fixture_domains, fixture_messages, fixture_threads, table
from mailquarry.sources.discovery import mailbox_names



def n_rows():
    return F.count(F.lit(1))


# --- joins ----------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, c_name, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 45""")
def jon1_dimensions(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem").filter("l_quantity > 45")
    out = li.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name")


@query(f"WITH {ATT} SELECT d.doc_id, a.name FROM documents d JOIN att a ON a.message_id = d.doc_id WHERE contains(a.name, 'casino')")
def jon3_attachment_rows(spark, sf_dir):
    a = fixture_attachments(spark, sf_dir).filter(F.contains("name", F.lit("casino")))
    return table(spark, sf_dir, "documents").join(a, F.col("doc_id") == F.col("message_id")).select("doc_id", "name")


@query("""SELECT f.o_orderkey, f.o_orderstatus, c.c_name, n.n_name FROM orders f JOIN customer c ON f.o_custkey = c.c_custkey
  LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey = c.c_nationkey % 5 WHERE f.o_totalprice > 300000""")
def jon4_inner_and_left(spark, sf_dir):
    f = table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 10")
    out = f.join(c, F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(n, (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("n_regionkey") == F.col("c_nationkey") % 5), "left")
    return out.select("o_orderkey", "o_orderstatus", "c_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def jon5_in_subquery(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jon6_not_in_subquery(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def jon7_exists(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000")
    return table(spark, sf_dir, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("n_name")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS first_order FROM customer")
def jon8_scalar_subqueries(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(n_rows().alias("n"), F.min("o_orderkey").alias("first_order"))
    out = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"), "first_order")


@query("""WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations) SELECT a.conv_id * 1000000 + a.turn AS id, b.conv_id * 1000000 + b.turn AS answered FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""")
def jon11_reference_lookup(spark, sf_dir):
    """Messages with those that they refer to, as threads are tied from them."""
    edges = threads.strong_edges(fixture_threads(spark, sf_dir)).filter("a <> b")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("answered")).distinct()


# --- aggregates -------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM documents WHERE n_chars > 1000")
def agg1_total(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("n_chars > 1000").agg(n_rows().alias("n"))


_DOMAIN = "array_to_string(list_reverse(list_reverse(string_split(replace(regexp_extract(url, '://([^/?#]*)', 1), '.example.', '.'), '.'))[1:2]), '.')"


@query(f"SELECT {_DOMAIN} AS domain, count(*) AS n FROM pages GROUP BY 1")
def agg2_messages_per_domain(spark, sf_dir):
    return fixture_domains(spark, sf_dir)


_ORG = "CASE WHEN len(p) <= 2 THEN array_to_string(p, '.') WHEN length(p[-1]) = 2 AND p[-2] IN ('co','com','org','net','gov','ac','edu','gouv','asso','or','ne','go') THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END"


@query(f"WITH h AS (SELECT string_split(lower(regexp_extract(url, '://([^/?#]*)', 1)), '.') AS p FROM pages) SELECT {_ORG} AS domain, count(*) AS n FROM h GROUP BY 1 HAVING contains(domain, '.')")
def agg3_organisations(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("domain")).groupBy("domain").agg(n_rows().alias("n"))
    return impersonation.organisations(hosts)


def _named(spark, sf_dir):
    m = fixture_messages(spark, sf_dir)
    mail = F.concat(F.lit("u"), F.col("sender_id") % 7, F.lit("@d"), F.col("sender_id") % 3, F.lit(".fr"))
    return m.select("id", F.concat(F.col("msg_class"), F.lit(" Person")).alias("sender_name"), mail.alias("sender_email"), F.lit(0).alias("spoof_flags"))


_NAMED = f"""{MSG}, nm AS (SELECT id, lower(msg_class || ' Person') AS name, 'u' || (sender_id % 7) || '@d' || (sender_id % 3) || '.fr' AS email FROM msg),
  ct AS (SELECT name, email, count(*) AS n FROM nm WHERE name IS NOT NULL AND email IS NOT NULL GROUP BY 1, 2),
  tp AS (SELECT name, email AS top_email, n AS top_n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, email) AS k FROM ct) WHERE k = 1)"""


@query(f"WITH {_NAMED} SELECT name, email, n FROM ct")
def agg4_names_and_addresses(spark, sf_dir):
    return impersonation.names(_named(spark, sf_dir))


@query(f"WITH {_NAMED} SELECT name, top_email, top_n FROM tp")
def agg5_dominant_address(spark, sf_dir):
    return impersonation.dominant(impersonation.names(_named(spark, sf_dir)))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 1")
def agg6_most_frequent(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(n_rows().alias("n")).orderBy(F.col("n").desc(), "p_brand").limit(1)


_TREE = f"""WITH {MSG}, o AS (SELECT folder_path AS path, count(*) AS items FROM msg GROUP BY 1),
  a AS (SELECT split_part(path, '/', 1) AS path, items FROM o UNION ALL SELECT path, items FROM o),
  t AS (SELECT path, CAST(sum(items) AS BIGINT) AS total FROM a GROUP BY 1)
  SELECT t.path, CASE WHEN contains(t.path, '/') THEN split_part(t.path, '/', 2) ELSE t.path END AS name, CAST(CASE WHEN contains(t.path, '/') THEN 1 ELSE 0 END AS INTEGER) AS depth,
  CAST(coalesce(o.items, 0) AS BIGINT) AS items, t.total FROM t LEFT JOIN o USING (path)"""


def _folders(spark, sf_dir):
    return fixture_messages(spark, sf_dir).groupBy(F.col("folder_path").alias("path")).agg(n_rows().alias("items"))


@query(_TREE)
def agg8_folder_tree(spark, sf_dir):
    return folder_tree(_folders(spark, sf_dir))


@query(f"SELECT * FROM ({_TREE}) WHERE path <> 'de' AND path NOT LIKE 'de/%'")
def agg9_pruned_tree(spark, sf_dir):
    """The folders of one language have no messages, so its subtree goes."""
    few = _folders(spark, sf_dir).select("path", F.when(F.startswith("path", F.lit("de/")), 0).otherwise(F.col("items")).alias("items"))
    return folder_tree(few, hide_empty=True)


@query("SELECT path, min(name) AS name, min(depth) AS depth, CAST(sum(items) AS BIGINT) AS items FROM (SELECT n_name AS path, upper(n_name) AS name, n_regionkey AS depth, n_nationkey AS items FROM nation UNION ALL SELECT n_name, n_name, n_regionkey + 1, 5 FROM nation) GROUP BY path")
def agg7_merged_folders(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    parts = n.select(F.col("n_name").alias("path"), F.upper("n_name").alias("name"), F.col("n_regionkey").alias("depth"), F.col("n_nationkey").alias("items"))
    parts = parts.union(n.select("n_name", "n_name", F.col("n_regionkey") + 1, F.lit(5)))
    return parts.groupBy("path").agg(F.min("name").alias("name"), F.min("depth").alias("depth"), F.sum("items").cast("long").alias("items"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def agg10_status_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(n_rows().alias("n"))


@query("SELECT event_type, count(*) AS hits, count(DISTINCT user_id) AS messages FROM events GROUP BY event_type")
def agg11_hits_and_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(n_rows().alias("hits"), F.countDistinct("user_id").alias("messages"))


@query(f"WITH {MSG} SELECT id, CASE WHEN f < id THEN f END AS dup_of FROM (SELECT id, min(id) OVER (PARTITION BY mailbox, message_id) AS f FROM msg)")
def agg12_duplicates(spark, sf_dir):
    return store.duplicates(fixture_messages(spark, sf_dir)).select("id", "dup_of")


@query("SELECT user_id, CAST(bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 4 ELSE 8 END) AS INTEGER) AS sens_flags, least(count(*), 200) AS sens_count FROM events GROUP BY user_id")
def agg14_flags_and_counts(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "error", 4).otherwise(8)
    return S.summary(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), kind.alias("kind"))).withColumnRenamed("id", "user_id")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def agg15_counters(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(n_rows().alias("n"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def agg16_pending_sources(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select("o_custkey").distinct()


@query("SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def agg17_repeated_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(n_rows().alias("n")).filter("n > 1")


@query("SELECT count(DISTINCT n) AS sizes FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def agg17_distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(n_rows().alias("n")).agg(F.countDistinct("n").alias("sizes"))


@query("SELECT epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events GROUP BY 1")
def agg18_throughput(spark, sf_dir):
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    return table(spark, sf_dir, "events").groupBy(hour.alias("hour")).agg(n_rows().alias("n"))


# --- sources ----------------------------------------------------------------------------------------------------

#: Part numbers count behind an address, and where two files have the same rest.
_NAMES = [
    ("'/a' || {k} || '/jo@x' || {k} || '.test_2.pst'", "'jo@x' || {k} || '.test'"), ("'/a' || {k} || '/jo@y' || {k} || '.test.pst'", "'jo@y' || {k} || '.test'"), ("'/b/report' || {k} || '_2019.pst'", "'report' || {k} || '_2019'"),
    ("'/c/only' || {k} || '-03.pst'", "'only' || {k} || '-03'"), ("'/d/both' || ({k} - 4) || ' (1).pst'", "'both' || ({k} - 4)"), ("'/d/both' || ({k} - 5) || ' (2).pst'", "'both' || ({k} - 5)"),
]


@query(f"SELECT {by_key(KEY, *(p for p, _ in _NAMES))} AS path, {by_key(KEY, *(n for _, n in _NAMES))} AS mailbox FROM customer WHERE c_custkey < (SELECT count(*) // 6 * 6 FROM customer)")
def src2_mailbox_names(spark, sf_dir):
    """The last customers that don't make six are left out, since the names come in sixes."""
    own = customers(spark, sf_dir, path=by_key(KEY, *(p for p, _ in _NAMES)))
    whole = own.count() // 6 * 6
    return mailbox_names(own.filter(F.col("k") < whole).select("path"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def src11_table_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp '1997-01-01'").select("o_orderkey", "o_totalprice")


@query("SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def src12_list_sources(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_name").orderBy("n_name", "s_name")


@query("SELECT n_name, CAST(sum(s_suppkey) AS BIGINT) AS messages FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def src13_list_mailboxes(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    per = s.groupBy("s_nationkey").agg(F.sum("s_suppkey").cast("long").alias("messages"))
    return n.join(per, F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", "messages").orderBy("n_name")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS indexed FROM orders")
def src14_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(n_rows().alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("indexed"))


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P') AS pending")
def src15_pending_work(spark, sf_dir):
    some = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey").limit(1)
    return some.agg((n_rows() > 0).alias("pending"))


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey = 100")
def src16_point_lookup(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    out = t("orders").filter("o_orderkey = 100").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


_FOUND = by_key(KEY, "'/x/a' || {k} || '.pst'", "'/x/m' || {k} % 10 || '/' || {k} || '.msg'", "'/x/m' || {k} % 10 || '/' || {k} || '.MSG'", "'/x/readme' || {k} || '.txt'", "'/y/b' || {k} || '.OST'", "'/z/known' || {k} || '.pst'")


@query(f"""SELECT {_FOUND} AS path, {by_key(KEY, "'pst'", "'msg_folder'", "'msg_folder'", "''", "'pst'", "''")} AS kind, CASE WHEN c_custkey % 6 IN (1, 2) THEN '/x/m' || c_custkey % 10 ELSE {_FOUND} END AS source
  FROM customer WHERE c_custkey % 6 NOT IN (3, 5)""")
def src1_discovery(spark, sf_dir):
    from mailquarry.sources.discovery import classify

    found = customers(spark, sf_dir, path=_FOUND)
    return classify(found.select("path"), found.filter("k % 6 = 5").select("path"))


_SHOWN = by_key(KEY, "c_name || ' <a' || {k} || '@x.fr>'", "'a' || {k} || '@x.fr'", "c_name", "'A' || {k} || '@X.fr'", "''")


@query(f"SELECT c_custkey AS k, {_SHOWN} AS shown FROM customer")
def src9_recipient_display(spark, sf_dir):
    from mailquarry.operators.labels import recipient

    own = customers(spark, sf_dir, name=by_key(KEY, "c_name", "NULL", "c_name", "'A' || {k} || '@X.fr'", "NULL"), email=by_key(KEY, "'a' || {k} || '@x.fr'", "'a' || {k} || '@x.fr'", "''", "'a' || {k} || '@x.fr'", "NULL"))
    return own.select("k", recipient(F.col("name"), F.col("email")).alias("shown"))


@query("SELECT c_custkey, trim(u.part) AS recipient FROM customer, unnest(string_split(c_name || ';' || c_mktsegment || '; x', ';')) AS u(part)")
def src9_recipient_fallback(spark, sf_dir):
    shown = F.concat(F.col("c_name"), F.lit(";"), F.col("c_mktsegment"), F.lit("; x"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.transform(F.split(shown, ";"), lambda x: F.trim(x))).alias("recipient"))


# --- sinks ------------------------------------------------------------------------------------------------------


@query("""SELECT o.o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'new' || o_orderkey END, o_orderpriority) AS subject,
  CAST(CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 > 0 THEN o_orderkey % 5 WHEN true THEN o_custkey END AS BIGINT) AS size,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN ((o_custkey % 64) & 40) | 3 ELSE o_custkey % 64 END AS INTEGER) AS spoof_flags FROM (SELECT *, o_orderkey % 2 AS z FROM orders) o WHERE true AND o_orderkey % 3 IN (0, 1, 2)
  AND NOT (o_orderkey % 2 = 1 AND o_orderkey % 3 = 0) UNION ALL
  SELECT o_orderkey, o_orderpriority, o_custkey, CAST(o_custkey % 64 AS INTEGER) FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0""")
def snk1_merge_messages(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("subject"), F.col("o_custkey").alias("size"), (F.col("o_custkey") % 64).cast("int").alias("spoof_flags"))
    new = o.filter("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("new"), "o_orderkey")).alias("subject"), (F.col("o_orderkey") % 5).alias("size"), F.lit(3).alias("spoof_flags")
    )
    return store.merge_messages(old, new)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 1 AND o_orderkey % 3 = 0 THEN 'new' ELSE o_orderpriority END AS subject, CASE WHEN o_orderkey % 8 = 1 AND o_orderkey % 5 > 0 THEN o_orderkey % 5 ELSE o_custkey END AS size
  FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey + 1000000000, 'first', 1 FROM orders WHERE o_orderkey % 8 = 2""")
def snk1_bucketed_flush(spark, sf_dir):
    """A table in buckets: changes by the rules for messages, then new rows, then deletions."""
    from mailquarry.operators.buckets import BucketedTable, upsert_messages

    o = table(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("subject"), F.col("o_custkey").alias("size"))
    kept = BucketedTable(spark, f"{store.shared_dir(spark).rstrip('/')}/bucketed-{uuid.uuid4().hex}", old.schema, buckets=16)
    kept.merge(old)
    key = F.col("o_orderkey")
    kept.merge(o.filter(key % 8 == 1).select(key.alias("id"), F.when(key % 3 == 0, F.lit("new")).alias("subject"), (key % 5).alias("size")), upsert_messages)
    kept.merge(o.filter(key % 8 == 2).select((key + 1_000_000_000).alias("id"), F.lit("first").alias("subject"), F.lit(1).cast("long").alias("size")))
    kept.remove(old.filter("id % 11 = 0"))
    return kept.read()


@query("SELECT o_orderkey AS id, CAST(((o_custkey % 64) & 40) | (o_orderkey % 8) AS INTEGER) AS spoof_flags FROM orders")
def snk3_header_flush(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 64).cast("int").alias("spoof_flags"))
    new = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 8).cast("int").alias("spoof_flags"))
    return store.merge_messages(old, new)


@query("SELECT page_id AS message_id, url AS name FROM pages WHERE page_id % 4 <> 0 UNION ALL SELECT page_id, 'again' FROM pages WHERE page_id % 4 = 0")
def snk4_replace_attachments(spark, sf_dir):
    a = table(spark, sf_dir, "pages").select(F.col("page_id").alias("message_id"), F.col("url").alias("name"))
    new = a.filter("message_id % 4 = 0").withColumn("name", F.lit("again"))
    return store.replace_by_key(store.replace_by_key(a, new, "message_id"), new, "message_id")


@query("SELECT event_id AS message_id, CAST(user_id % 4 AS INTEGER) AS kind FROM events WHERE event_id % 3 <> 1 UNION ALL SELECT event_id, 9 FROM events WHERE event_id % 3 = 1")
def snk5_replace_findings(spark, sf_dir):
    f = table(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), (F.col("user_id") % 4).cast("int").alias("kind"))
    return store.replace_by_key(f, f.filter("message_id % 3 = 1").withColumn("kind", F.lit(9)), "message_id")


_CELL = "CASE WHEN coalesce({0}, '') = '' THEN '' ELSE chr(34) || replace(CASE WHEN regexp_matches(translate({0}, chr(10) || chr(13), '  '), '^[=+@\\t-]') THEN chr(39) || translate({0}, chr(10) || chr(13), '  ') ELSE translate({0}, chr(10) || chr(13), '  ') END, chr(34), chr(34) || chr(34)) || chr(34) END"


@query(f"SELECT doc_id, {_CELL.format('text')} || ';' || {_CELL.format('neg')} AS line FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN '-' || lang ELSE '=' || source END AS neg FROM documents)")
def snk6_csv_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("-"), "lang")).otherwise(F.concat(F.lit("="), "source")).alias("neg"))
    return d.select("doc_id", F.concat_ws(";", csv_cell(F.col("text")), csv_cell(F.col("neg"))).alias("line"))


@query("SELECT page_id, '\"' || page_id || '\";\"' || replace(url, '\"', '\"\"') || '\";\"\"' AS line FROM pages")
def snk7_attachment_inventory(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.concat_ws(";", csv_quoted(F.col("page_id")), csv_quoted(F.col("url")), csv_quoted(F.lit(None))).alias("line"))


_TAIL = "lpad(CAST(c_custkey % 100 AS STRING), 2, '0')"
#: A telephone number, a person's number and a card in each customer's text, and numbers that are none of these.
_PLANTED = f"'Call 06 11 22 33 ' || {_TAIL} || ', ' || repeat('x', CAST(c_custkey % 7 AS INTEGER)) || ' no 1 91 11 33 063 217 ' || lpad(CAST(97 - 1911133063217 % 97 AS STRING), 2, '0') || '; card 4111-1111-1111-1111, order 12 34 ' || c_custkey"
_REPORT = f"""SELECT c_custkey AS id, kind, CASE kind WHEN 8 THEN '06 ** ** ** ' || {_TAIL} WHEN 4 THEN '1 ** ** ** *** *** ' || lpad(CAST(97 - 1911133063217 % 97 AS STRING), 2, '0') ELSE '**** **** **** 1111' END AS masked,
  CAST(CASE kind WHEN 8 THEN 5 WHEN 4 THEN 25 + c_custkey % 7 ELSE 53 + c_custkey % 7 END AS INTEGER) AS pos, CAST(CASE kind WHEN 8 THEN 14 WHEN 4 THEN 21 ELSE 19 END AS INTEGER) AS len FROM customer, (VALUES (2), (4), (8)) v(kind)"""


@query(_REPORT)
def val4_planted_findings(spark, sf_dir):
    return S.scan(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_PLANTED).alias("text")))


@query(f"""SELECT c_custkey AS id, c_name || ';' || CASE kind WHEN 2 THEN 'Carte bancaire' WHEN 4 THEN 'N° de sécurité sociale' ELSE 'Téléphone' END || ';' || masked AS line FROM ({_REPORT}) r JOIN customer ON c_custkey = id""")
def snk8_sensitive_report(spark, sf_dir):
    """A line a finding: who, what, and the value masked; clear values never leave the scan."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.expr(_PLANTED).alias("text"))
    label = F.element_at(F.create_map(*(F.lit(x) for kv in S.LABELS.items() for x in kv)), F.col("kind"))
    return S.scan(own).join(own.select("id", "c_name"), "id").select("id", F.concat_ws(";", "c_name", label, "masked").alias("line"))


@query("SELECT doc_id, upper(sha256(text)) AS hash FROM documents")
def snk11_integrity_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.upper(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"))


@query("SELECT 'messages' AS tab, count(*) AS n FROM documents WHERE source <> 'src1' UNION ALL SELECT 'attachments', count(*) FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1') UNION ALL SELECT 'sources', count(DISTINCT source) - 1 FROM documents")
def snk12_remove_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("source_id"))
    tables = {"messages": d, "attachments": table(spark, sf_dir, "pages").select(F.col("page_id").alias("message_id")), "sources": d.select(F.col("source_id").alias("id")).distinct()}
    left = store.remove_source(tables, 1)
    out = [left[t].agg(n_rows().alias("n")).select(F.lit(t).alias("tab"), "n") for t in ("messages", "attachments", "sources")]
    return out[0].union(out[1]).union(out[2])


@query("SELECT s_suppkey AS id, CAST(CASE WHEN s_suppkey = 3 THEN 99 ELSE s_nationkey END AS BIGINT) AS mailbox_id FROM supplier")
def snk13_move_source(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("mailbox_id"))
    return store.move_source(s, s.withColumn("source_id", F.col("id")), 3, 99)[0]


@query("SELECT n_nationkey AS id, min(n_nationkey) OVER (PARTITION BY left(lower(n_name), 1)) AS \"into\" FROM nation")
def snk13_merge_mailboxes(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.substring("n_name", 1, 1).alias("name"))
    return store.merge_mailboxes(n)


_MOVED = by_key(KEY, "'E:' || chr(92) || 'Mail' || chr(92) || {k} || '.pst'", "'e:/mail/sub/' || {k} || '.pst'", "'E:' || chr(92) || 'Mailing' || chr(92) || {k}", "'/other/' || {k} || '.pst'", "'E:/MAIL'")


@query(f"""SELECT c_custkey AS k, {by_key(KEY, "'/data/' || {k} || '.pst'", "'/data/sub/' || {k} || '.pst'", "NULL", "NULL", "'/data'")} AS target FROM customer""")
def snk14_relocation(spark, sf_dir):
    from mailquarry.sources.discovery import relocated

    return customers(spark, sf_dir, path=_MOVED).select("k", relocated(F.col("path"), "E:\\Mail\\", "/data").alias("target"))


@query(f"""SELECT c_custkey AS k, {by_key(KEY, "'/old' || {k} || ' > /new/place'", "'E: > /mnt/e' || {k}", "'/a > /b'")} AS prefixes FROM customer""")
def snk14_inferred_prefixes(spark, sf_dir):
    from mailquarry.sources.discovery import infer_relocation

    pairs = by_key(KEY, "'/old' || {k} || '/x/a.pst|/new/place/X/A.pst'", "'E:' || chr(92) || 'm' || chr(92) || '1.pst|/mnt/e' || {k} || '/m/1.pst'", "'/a/' || {k} || '.pst|/b/' || {k} || '.pst'")
    return by_python(customers(spark, sf_dir, prefixes=pairs), "prefixes", lambda x: " > ".join(infer_relocation(*x.split("|"))))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")
def snk15_compaction(spark, sf_dir):
    path = f"{store.shared_dir(spark).rstrip('/')}/compacted-orders-{uuid.uuid4().hex}"
    store.compact(spark, f"{sf_dir}/orders.parquet", path, 2, "o_orderdate", "o_orderkey")
    return spark.read.parquet(path).agg(n_rows().alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT doc_id AS message_id, lang AS name FROM documents UNION ALL SELECT page_id + 1000000, url FROM pages")
def snk2_append_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), F.col("lang").alias("name"))
    p = table(spark, sf_dir, "pages").select((F.col("page_id") + 1000000).alias("message_id"), F.col("url").alias("name"))
    return d.unionByName(p)
