"""Queries on search: scope, language, full text, relevance, order."""

from __future__ import annotations

from dataclasses import replace


from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry.functions import text as X
from mailquarry.operators.labels import flag_labels, item_kind, shown_sender
from mailquarry.operators.store import duplicates
from mailquarry.plans.projection import OWN, projected
from mailquarry.plans.query import INDICES, parse
from mailquarry.plans.registry import ATT, KEY, MSG, by_key, by_python, customers, pad, query, toks
from mailquarry.functions.excerpts import highlight
from mailquarry.plans.search import MESSAGE_FIELDS, Request, candidates, pages, ranks, search, with_snippets
from mailquarry.plans.sorting import KEYS, cursor, order
from mailquarry.sources.case import Case, fixture_attachments, fixture_case, fixture_messages, table


def found(spark, sf_dir, text, **scope):
    """ids that a query finds in the fixture case."""
    return candidates(fixture_case(spark, sf_dir), parse(text), Request(query=text, **scope)).select("id")


def family(positive: list[str], negative: list[str] = ()) -> str:
    """SQL of a family search: each condition holds in the message or in an attachment."""
    def one(words: str) -> str:
        own = " OR ".join(f"contains(s, ' {w}') OR contains(b, ' {w}')" for w in words.split("|"))
        other = " OR ".join(f"contains(n, ' {w}') OR contains(c, ' {w}')" for w in words.split("|"))
        return f"(({own}) OR id IN (SELECT message_id FROM ap WHERE {other}))"

    tests = [one(w) for w in positive] + ["NOT " + one(w) for w in negative]
    return f"""WITH {MSG}, {ATT}, mp AS (SELECT id, {pad('subject')} AS s, {pad('body')} AS b FROM msg),
      ap AS (SELECT message_id, {pad('name')} AS n, {pad('content')} AS c FROM att) SELECT id FROM mp WHERE """ + " AND ".join(tests)


# --- scope ------------------------------------------------------------------------------------------------


@query(f"WITH {MSG} SELECT id, subject FROM msg WHERE mailbox = 'src3'")
def flt1_mailbox_scope(spark, sf_dir):
    c = fixture_case(spark, sf_dir)
    return candidates(c, parse(""), Request(mailbox="src3")).select("id", "subject")


@query(f"WITH {MSG} SELECT id FROM msg WHERE mailbox = 'src3' AND folder_path = 'de/src3'")
def flt2_folder_exact(spark, sf_dir):
    return found(spark, sf_dir, "", mailbox="src3", folder="de/src3", subtree=False)


@query(f"WITH {MSG} SELECT id FROM msg WHERE mailbox = 'src3' AND (folder_path = 'de' OR starts_with(folder_path, 'de/'))")
def flt3_folder_subtree(spark, sf_dir):
    return found(spark, sf_dir, "", mailbox="src3", folder="de")


@query(f"WITH {MSG}, lo AS (SELECT min(date_ms) AS a FROM msg) SELECT id, date_ms FROM msg WHERE date_ms >= epoch_ms(TIMESTAMP '2024-01-02') AND date_ms < epoch_ms(TIMESTAMP '2024-01-21')")
def flt4_date_range(spark, sf_dir):
    c = fixture_case(spark, sf_dir)
    r = Request(query="apres:2024-01-02 avant:20/01/2024")
    return candidates(c, parse(r.query), r).select("id", "date_ms")


@query(f"WITH {MSG} SELECT id FROM msg WHERE id IN (SELECT page_id FROM pages)")
def flt5_has_attachment(spark, sf_dir):
    c = fixture_case(spark, sf_dir)
    with_att = c.attachments.select(F.col("message_id").alias("id")).distinct().withColumn("has_att", F.lit(True))
    c = Case(c.messages.join(with_att, "id", "left"), c.attachments)
    return candidates(c, parse(""), Request(only_with_attachments=True)).select("id")


@query(f"WITH {MSG} SELECT id FROM (SELECT *, min(id) OVER (PARTITION BY mailbox, message_id) AS f FROM msg) WHERE id = f")
def flt6_hide_duplicates(spark, sf_dir):
    c = fixture_case(spark, sf_dir)
    return candidates(Case(duplicates(c.messages), c.attachments), parse(""), Request(hide_duplicates=True)).select("id")


def _flagged(spark, sf_dir):
    c = fixture_case(spark, sf_dir)
    m = c.messages.withColumn("spoof_flags", F.coalesce("flags", F.lit(0))).withColumn("auth_spf", F.col("msg_class")).withColumn("thread_id", F.col("quality").cast("long"))
    m = m.withColumn("auth_dkim", F.when(F.col("msg_class") == "click", "pass").when(F.col("msg_class") == "view", "fail"))
    return Case(m, c.attachments)


@query(f"WITH {MSG} SELECT id FROM msg WHERE coalesce(flags, 0) & 2 <> 0")
def flt7_flag_filter(spark, sf_dir):
    return candidates(_flagged(spark, sf_dir), parse("indice:returnpath"), Request()).select("id")


@query(f"WITH {MSG} SELECT id FROM msg WHERE coalesce(flags, 0) & 63 = 0")
def flt7_flag_filter_negated(spark, sf_dir):
    return candidates(_flagged(spark, sf_dir), parse("-indice:usurpation"), Request()).select("id")


@query(f"WITH {MSG} SELECT id FROM msg WHERE msg_class = 'view'")
def flt8_auth_filter(spark, sf_dir):
    return candidates(_flagged(spark, sf_dir), parse("dkim:echec"), Request()).select("id")


@query(f"WITH {MSG} SELECT id FROM msg WHERE (CASE msg_class WHEN 'click' THEN 'pass' WHEN 'view' THEN 'fail' END) IS DISTINCT FROM 'pass'")
def flt8_auth_negated_keeps_nulls(spark, sf_dir):
    return candidates(_flagged(spark, sf_dir), parse("-dkim:pass"), Request()).select("id")


@query(f"WITH {MSG} SELECT id FROM msg WHERE msg_class IS NULL OR msg_class NOT IN ('click', 'view')")
def flt8_auth_absent(spark, sf_dir):
    return candidates(_flagged(spark, sf_dir), parse("dkim:absent"), Request()).select("id")


@query(f"WITH {MSG} SELECT id FROM msg WHERE quality IS DISTINCT FROM 1")
def flt9_thread_filter_negated(spark, sf_dir):
    return candidates(_flagged(spark, sf_dir), parse("-fil:1"), Request()).select("id")


@query(f"WITH {MSG} SELECT id FROM msg WHERE quality = 1")
def flt9_thread_filter(spark, sf_dir):
    return candidates(_flagged(spark, sf_dir), parse("fil:1"), Request()).select("id")


# --- family search ------------------------------------------------------------------------------------------


@query(family(["the "], ["elle "]))
def flt10_family_search(spark, sf_dir):
    return found(spark, sf_dir, "the -elle")


@query(family(["elle ", "que "]))
def flt10_family_all_words(spark, sf_dir):
    return found(spark, sf_dir, "elle que")


@query(family(["le |la "], ["et "]))
def flt11_family_excluded(spark, sf_dir):
    return found(spark, sf_dir, "le OR la -et")


_ASKED = by_key(KEY, "'indice:inconnu' || {k}", "'fil:a' || {k}", "'spf:b' || {k}", "'-mot' || {k}", "'-mot' || {k} || ' avant:2020'", "'mot' || {k} || ' -autre'")


@query(f"SELECT c_custkey AS k, {by_key(KEY, *(f"'{n}'" for n in (1, 1, 1, 1, 0, 0)))} AS errors FROM customer")
def flt12_validation(spark, sf_dir):
    from mailquarry.plans.search import errors

    return by_python(customers(spark, sf_dir, errors=_ASKED), "errors", lambda q: str(len(errors(parse(q), Request(query=q)))))


#: All columns of a message, from the key of an order: numbers, texts and truth values by turns, with nulls.
_NUMBERS = ["date", "size", "att_count", "importance", "dup_of", "sent_date", "flag_status", "thread_id", "thread_count", "spoof_flags", "date_flags", "sens_flags", "sens_count"]
_TRUTHS = ["has_att", "indexed", "is_read", "hdr_done"]
_TEXTS = [c for c in OWN if c not in (*_NUMBERS, *_TRUTHS, "id", "mailbox_id")]
_MADE = (
    ["o_orderkey AS id", "o_custkey % 5 AS mailbox_id", "o_orderkey % 11 AS folder_id", "o_custkey % 3 AS source_id"]
    + [f"CASE WHEN o_orderkey % {k + 3} > 0 THEN o_orderkey * {k + 2} END AS {c}" for k, c in enumerate(_NUMBERS)]
    + [f"o_orderkey % {k + 2} = 0 AS {c}" for k, c in enumerate(_TRUTHS)]
    + [f"CASE WHEN o_orderkey % {k + 4} > 0 THEN '{c}' || o_orderkey END AS {c}" for k, c in enumerate(_TEXTS)]
)


@query(f"""SELECT {', '.join(OWN)}, 'box ' || mailbox_id AS mailbox, 'path/' || folder_id AS folder_path, 'source ' || source_id AS source_name, '/s/' || source_id AS source_path FROM (SELECT {', '.join(_MADE)} FROM orders) WHERE folder_id < 10""")
def flt13_result_projection(spark, sf_dir):
    """39 columns of orders as messages, joined with folders (of which one is missing), sources and mailboxes made from other tables."""
    key = F.col("id")
    named = lambda n, k, most, **columns: table(spark, sf_dir, n).select(F.col(k).cast("long").alias("id")).filter(key < most).select("id", *(F.concat(F.lit(v), key).alias(c) for c, v in columns.items()))
    folders, sources, boxes = named("nation", "n_nationkey", 10, path="path/"), named("nation", "n_nationkey", 3, display_name="source ", path="/s/"), named("region", "r_regionkey", 5, name="box ")
    return projected(table(spark, sf_dir, "orders").selectExpr(*_MADE), folders, sources, boxes)


_CLASSES = [
    ("IPM.Note", "Message"), ("IPM.Appointment", "Rendez-vous"), ("ipm.schedule.meeting.request", "Réunion"), ("IPM.Contact.x", "Contact"), ("IPM.DistList", "Contact"), ("IPM.Task", "Tâche"), ("IPM.StickyNote", "Note"),
    ("IPM.Activity", "Journal"), ("REPORT.IPM.Note.NDR", "Accusé"), ("IPM.Note.SMIME", "Chiffré"), ("", "Message"),
]


@query(f"""SELECT c_custkey AS k, {by_key(KEY, *(f"'{kind}'" for _, kind in _CLASSES))} AS kind FROM customer""")
def flt14_item_kind(spark, sf_dir):
    return customers(spark, sf_dir, cls=by_key(KEY, *(f"'{c}'" for c, _ in _CLASSES))).select("k", item_kind(F.col("cls")).alias("kind"))


@query(f"WITH {MSG} SELECT id, concat_ws(', ', CASE WHEN flags & 1 <> 0 THEN 'Reply-To différent' END, CASE WHEN flags & 2 <> 0 THEN 'Return-Path différent' END) AS labels FROM msg WHERE flags IS NOT NULL")
def flt15_flag_labels(spark, sf_dir):
    from mailquarry.operators.labels import SPOOF_LABELS

    return fixture_messages(spark, sf_dir).filter("flags is not null").select("id", flag_labels(F.col("flags"), SPOOF_LABELS).alias("labels"))


@query("SELECT c_custkey, CASE WHEN length(n) > 0 THEN n ELSE c_name END AS shown FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN NULL ELSE c_mktsegment END AS n FROM customer)")
def flt16_shown_sender(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 2, F.col("c_mktsegment"))
    return c.select("c_custkey", shown_sender(name, F.col("c_name")).alias("shown"))


@query(f"""SELECT c_custkey AS k, {by_key(KEY, "'size'", "'subject'", "'date_ms'")} AS col, {by_key(KEY, "true", "false", "true")} AS natural_desc FROM customer""")
def flt17_column_catalogue(spark, sf_dir):
    listed = F.create_map(*(F.lit(x) if isinstance(x, str) else x for k, (c, _, down) in KEYS.items() for x in (k, F.struct(F.lit(c).alias("col"), F.lit(down).alias("natural_desc")))))
    return customers(spark, sf_dir, key=by_key(KEY, "'size'", "'subject'", "'date'")).select("k", F.element_at(listed, F.col("key")).alias("x")).select("k", "x.*")


_N = "(c_custkey % 1000 + 1)"


@query(f"""SELECT c_custkey AS k, {by_key(KEY, f"{_N} || ' o'", f"{_N} || ' Ko'", f"{_N} || '.5 Ko'", f"{_N} || ' Mo'", f"{_N} || '.25 Go'", "''")} AS shown FROM customer""")
def flt18_size_text(spark, sf_dir):
    from mailquarry.operators.labels import size_text

    size = by_key(KEY, _N, f"{_N} * 1024", f"{_N} * 1024 + 512", f"{_N} * 1048576", f"({_N} * 4 + 1) * 268435456", "0 - c_custkey")
    return customers(spark, sf_dir, b=size).select("k", size_text(F.col("b").cast("long")).alias("shown"))


@query("SELECT page_id, lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\\.[^./]+$')) IN ('.com', '.html', '.sh') AND lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\\.[^./]+$')) <> '.html' AS risky FROM pages")
def flt19_dangerous_attachment(spark, sf_dir):
    from mailquarry.operators.labels import is_dangerous

    name = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    return table(spark, sf_dir, "pages").select("page_id", is_dangerous(name).alias("risky"))


# --- language -----------------------------------------------------------------------------------------------


@query(family(["of the "]))
def lng2_phrase(spark, sf_dir):
    return found(spark, sf_dir, '"of the"')


@query(family(["el"]))
def lng3_prefix(spark, sf_dir):
    return found(spark, sf_dir, "el*")


@query(family(["de l"]))
def lng3_phrase_prefix(spark, sf_dir):
    return found(spark, sf_dir, '"de l"*')


@query(family(["elle |que |der "]))
def lng4_alternatives(spark, sf_dir):
    return found(spark, sf_dir, "elle OR que OU der")


@query(family(["the "], ["is "]))
def lng5_excluded(spark, sf_dir):
    return found(spark, sf_dir, "the -is")


@query(f"WITH {MSG} SELECT id FROM msg WHERE contains({pad('subject')}, ' the ')")
def lng8_subject_field(spark, sf_dir):
    return found(spark, sf_dir, "objet:the")


@query(f"WITH {MSG} SELECT id FROM msg WHERE contains({pad('body')}, ' elle ')")
def lng9_body_field(spark, sf_dir):
    return found(spark, sf_dir, "corps:elle")


@query(f"WITH {ATT} SELECT DISTINCT message_id AS id FROM att WHERE contains({pad('name')}, ' casino ')")
def lng10_attachment_names(spark, sf_dir):
    return found(spark, sf_dir, "pj:casino")


@query(f"WITH {ATT} SELECT DISTINCT message_id AS id FROM att WHERE contains({pad('content')}, ' elle ')")
def lng11_attachment_contents(spark, sf_dir):
    return found(spark, sf_dir, "pjtexte:elle")


_YMD = ("year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)")
_PAD = lambda x: f"lpad(CAST({x} AS {{0}}), 2, '0')"
_DAYS = by_key("o_orderkey", f"{_YMD[0]} || '-' || {_YMD[1]} || '-' || {_YMD[2]}", f"{_PAD(_YMD[2])} || '/' || {_PAD(_YMD[1])} || '/' || {_YMD[0]}", f"{_YMD[2]} || '/' || {_YMD[1]} || '/' || {_YMD[0]}", f"{_YMD[0]} || '-' || {_PAD(_YMD[1])}",
               f"CAST({_YMD[0]} AS {{0}})", f"{_PAD(_YMD[2])} || '.' || {_PAD(_YMD[1])} || '.' || {_YMD[0]}", "'hier'", f"{_YMD[0]} || '-13-01'")


@query(f"""SELECT o_orderkey, {by_key("o_orderkey", *["strftime(o_orderdate, '%Y-%m-%d')"] * 3, "strftime(o_orderdate, '%Y-%m-01')", "strftime(o_orderdate, '%Y-01-01')", "strftime(o_orderdate, '%Y-%m-%d')", "NULL", "NULL")} AS d FROM orders""")
def lng12_date_forms(spark, sf_dir):
    def day(text: str) -> str | None:
        found = parse(f"avant:{text}").before
        return found.isoformat() if found else None

    return by_python(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_DAYS.format("STRING")).alias("d")), "d", day)


@query(f"""SELECT c_custkey AS k, {by_key(KEY, "'spoof_flags&63 '", "'date_flags&127 '", "'sens_flags&15 '", "'-sens_flags&8 '")} || 'fil=' || c_custkey || ' -spf=fail' AS asked FROM customer""")
def lng13_filter_names(spark, sf_dir):
    def shown(text: str) -> str:
        return " ".join(("-" if f.negated else "") + ("{}&{}".format(*INDICES[f.value]) if f.field == "indice" else f"{f.field}={f.value}") for f in parse(text).filters)

    query = f"{by_key(KEY, "'indice:usurpation '", "'indice:dates '", "'indice:sensible '", "'-indice:tel '")} || 'mot' || c_custkey || ' fil:' || c_custkey || ' -spf:fail'"
    return by_python(customers(spark, sf_dir, asked=query), "asked", shown)


@query("SELECT c_custkey AS k, 'budget' || c_custkey || ',accord,de*,confid' || c_custkey || '*' AS terms FROM customer")
def lng14_highlight_terms(spark, sf_dir):
    query = """'budget' || c_custkey || ' -brouillon objet:accord "de confid' || c_custkey || '"*'"""
    return by_python(customers(spark, sf_dir, terms=query), "terms", lambda q: ",".join(parse(q).highlight))


_QUERIES = by_key(KEY, "'de: dup' || {k}", "'foo:bar' || {k}", "'a' || {k} || ' OR b c'", "'OR x' || {k}", "'a' || {k} || ' OR -b c'", "'avant:hier' || {k} || ' x'", "'!! ... x' || {k}", "chr(34) || 'a b' || {k}", "'a' || {k} || ' OR spf:fail b'")
_PARSED = by_key(KEY, "'dup' || {k}", "'foo:bar' || {k}", "'a' || {k} || '|b c'", "'x' || {k}", "'a' || {k} || ' c'", "'avant:hier' || {k} || ' x'", "'x' || {k}", "'a b' || {k}", "'a' || {k} || '|b'")


@query(f"SELECT c_custkey AS k, {_PARSED} AS parsed FROM customer")
def lng1_parser(spark, sf_dir):
    shown = lambda q: " ".join("|".join(t.text for t in c.alternatives) for c in parse(q).positive)
    return by_python(customers(spark, sf_dir, parsed=_QUERIES), "parsed", shown)


def _people(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    m = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("sender"), F.col("c_mktsegment").alias("recipients"), F.col("o_orderpriority").alias("subject"))
    return Case(m, spark.createDataFrame([], "message_id long, idx_path string, name string, content string"))


@query(f"SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains({pad('c_mktsegment')}, ' building ') AND NOT contains({pad('c_name')}, ' customer 000000001 ')")
def lng7_recipients_field(spark, sf_dir):
    return candidates(_people(spark, sf_dir), parse('a:building -de:"customer 000000001"'), Request()).select("id")


@query(f"SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains({pad('c_name')}, ' customer 000000007 ')")
def lng6_sender_field(spark, sf_dir):
    return candidates(_people(spark, sf_dir), parse('from:"customer 000000007"'), Request()).select("id")


# --- full text ------------------------------------------------------------------------------------------------


@query(f"WITH {MSG} SELECT id, CAST(len({toks('body')}) AS INTEGER) AS n_tokens, array_to_string({toks('subject')}, ' ') AS subject_tokens FROM msg")
def txt1_tokens(spark, sf_dir):
    m = fixture_messages(spark, sf_dir)
    return m.select("id", F.size(X.tokens(F.col("body"))).alias("n_tokens"), F.array_join(X.tokens(F.col("subject")), " ").alias("subject_tokens"))


def vocabulary(rows):
    """token, n (how often it stands in the bodies of rows) and docs (the ids that have it). A row's repeats are left out within the row, so tasks hold tokens, not pairs of token and id."""
    from mailquarry.operators.store import cut

    t = rows.select("id", X.tokens(F.col("body")).alias("tokens"))
    again = cut(rows.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("id"))  # ids of several rows, which are rare
    own = t.select("id", F.explode_outer(F.array_distinct("tokens")).alias("token"))
    if not again.isEmpty():
        own = own.join(again, "id", "left_anti").union(own.join(again, "id", "left_semi").distinct())
    all_, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    one = t.select(F.explode_outer("tokens").alias("token"), all_.alias("n"), none.alias("docs")).union(own.select("token", none, F.col("id").isNotNull().cast("long")))
    return one.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


@query(f"WITH {MSG}, t AS (SELECT id, unnest({toks('body')}) AS token FROM msg) SELECT token, count(*) AS n, count(DISTINCT id) AS docs FROM t GROUP BY token")
def txt2_vocabulary(spark, sf_dir):
    return vocabulary(fixture_messages(spark, sf_dir).select("id", "body"))


@query(f"WITH {MSG}, p AS (SELECT id, {pad('subject')} AS s, {pad('body')} AS b FROM msg) SELECT id FROM p WHERE (contains(s, ' the ') OR contains(b, ' the ')) AND (contains(s, ' of the ') OR contains(b, ' of the '))")
def txt2_postings_search(spark, sf_dir):
    from mailquarry.operators.postings import build_postings, lookup

    index = build_postings(fixture_messages(spark, sf_dir).select("id", "subject", "body"), ["subject", "body"])
    return lookup(index, ["the"]).join(lookup(index, ["of", "the"]), "id", "left_semi")


@query(f"WITH {MSG} SELECT id, contains({pad('subject')}, ' and ') AS in_subject, contains({pad('body')}, ' and ') AS in_body FROM msg")
def txt3_column_match(spark, sf_dir):
    m = fixture_messages(spark, sf_dir)
    return m.select("id", X.matches(X.padded(F.col("subject")), ["and"]).alias("in_subject"), X.matches(X.padded(F.col("body")), ["and"]).alias("in_body"))


_BM25 = f"""WITH {MSG}, t AS (SELECT id, {toks('subject')} AS s, {toks('body')} AS b FROM msg),
f AS (SELECT id, len(s) + len(b) AS dl, len(list_filter(s, lambda x: x = 'the')) AS fs, len(list_filter(b, lambda x: x = 'the')) AS fb FROM t),
k AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (fs + fb > 0) AS df FROM f)
SELECT id, round(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * (5 * fs + fb) * 2.2 / ((5 * fs + fb) + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS rank
FROM f, k WHERE fs + fb > 0"""


@query(_BM25)
def txt6_bm25(spark, sf_dir):
    return ranks(fixture_case(spark, sf_dir), parse("the")).select("id", F.round("rank", 6).alias("rank"))


@query(_BM25.replace("'the'", "'elle'") + " ORDER BY rank, id DESC LIMIT 20")
def srt4_relevance(spark, sf_dir):
    c = fixture_case(spark, sf_dir)
    m = c.messages.withColumn("date_ms", F.lit(0).cast("long"))
    page = search(Case(m, c.attachments.limit(0)), Request(query="elle", sort="relevance", limit=20))
    return page.select("id", F.round("rank", 6).alias("rank"))


@query(f"SELECT m.doc_id AS id, b.rank FROM documents m LEFT JOIN ({_BM25}) b ON b.id = m.doc_id")
def jon2_rank_join(spark, sf_dir):
    return fixture_messages(spark, sf_dir).select("id").join(txt6_bm25(spark, sf_dir), "id", "left")


@query()
def txt7_snippets(spark, sf_dir):
    c = fixture_case(spark, sf_dir)
    page = search(c, Request(query="elle", sort="size", limit=50))
    return with_snippets(c, page, "elle").select("id", "snippet")


@query(f"WITH {MSG} SELECT id, regexp_replace(regexp_replace(body, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS clean FROM msg")
def txt8_squeeze(spark, sf_dir):
    return fixture_messages(spark, sf_dir).select("id", X.squeeze(F.col("body")).alias("clean"))


@query(f"WITH {ATT} SELECT message_id, contains({pad('name')}, ' en ') OR contains({pad('content')}, ' en ') AS hit FROM att")
def txt9_attachment_hits(spark, sf_dir):
    a = fixture_attachments(spark, sf_dir)
    return a.select("message_id", (X.matches(X.padded(F.col("name")), ["en"]) | X.matches(X.padded(F.col("content")), ["en"])).alias("hit"))


_MARKED = "regexp_replace({0}, '(?i)(^|[^\\p{{L}}\\p{{N}}>])(the|of)($|[^\\p{{L}}\\p{{N}}<])', '\\1<mark class=\"pl-hit\">\\2</mark>\\3', 'g')"


@query(f"""WITH {MSG} SELECT id, '<style>the</style><i title="the">' || {_MARKED.format(_MARKED.format('subject'))} || '</i>' AS shown FROM msg""")
def txt10_highlight(spark, sf_dir):
    page = F.concat(F.lit('<style>the</style><i title="the">'), F.col("subject"), F.lit("</i>"))
    return fixture_messages(spark, sf_dir).select("id", highlight(page, ["the", "OF"]).alias("shown"))


@query(f"WITH {MSG} SELECT id, strip_accents(lower(subject)) AS folded FROM msg")
def txt11_fold(spark, sf_dir):
    return fixture_messages(spark, sf_dir).select("id", X.fold(F.col("subject")).alias("folded"))


@query(family(["elle |of the "], ["der "]))
def txt4_boolean_expression(spark, sf_dir):
    return found(spark, sf_dir, 'elle OR "of the" -der')


@query(family(["casino ", "the "]))
def txt5_family_over_attachments(spark, sf_dir):
    return found(spark, sf_dir, "casino the")




def _index(spark, sf_dir):
    """The fixture case's index, written anew."""
    import uuid

    from mailquarry.operators.store import shared_dir
    from mailquarry.plans.indexed import read_index, write_index

    path = f"{shared_dir(spark).rstrip('/')}/search-index-{uuid.uuid4().hex}"
    write_index(fixture_case(spark, sf_dir), path)
    return read_index(spark, path)


@query(family(["the "], ["elle "]))
def flt10_indexed_search(spark, sf_dir):
    from mailquarry.plans.indexed import found_ids

    return found_ids(_index(spark, sf_dir), parse("the -elle"))


@query(family(["of the |en", "the "], ["der "]))
def txt2_indexed_phrase_and_prefix(spark, sf_dir):
    from mailquarry.plans.indexed import found_ids

    return found_ids(_index(spark, sf_dir), parse('"of the" OR en* the -der'))


def _living(spark):
    """An empty index at a new path."""
    import uuid

    from mailquarry.operators.segments import SearchIndex
    from mailquarry.operators.store import shared_dir

    return SearchIndex(spark, f"{shared_dir(spark).rstrip('/')}/living-index-{uuid.uuid4().hex}")


def _ranked(spark, sf_dir):
    index = _living(spark)
    index.add(fixture_case(spark, sf_dir).messages)
    return index.snapshot()


@query(_BM25)
def txt6_ranked_index(spark, sf_dir):
    return _ranked(spark, sf_dir).ranked([(["the"], False, MESSAGE_FIELDS)]).select("id", F.round("rank", 6).alias("rank"))


@query(_BM25.replace("'the'", "'elle'") + " ORDER BY rank, id DESC LIMIT 20")
def srt4_ranked_page(spark, sf_dir):
    from mailquarry.plans.indexed import indexed_search

    c = fixture_case(spark, sf_dir)
    m = c.messages.withColumn("date_ms", F.lit(0).cast("long"))
    page = indexed_search(Case(m, c.attachments.limit(0)), _ranked(spark, sf_dir), Request(query="elle", sort="relevance", limit=20))
    return page.select("id", F.round("rank", 6).alias("rank"))


@query(f"SELECT id FROM ({family(['the '], ['elle '])}) WHERE id % 7 <> 0")
def snk2_living_index(spark, sf_dir):
    """Two thirds of the messages, half of them in an old state, then the rest and the changed ones, then deletions and a merge."""
    from mailquarry.plans.indexed import found_ids

    case, index = fixture_case(spark, sf_dir), _living(spark)
    of = lambda c: (case.messages.filter(c), case.attachments.filter(F.expr(c.replace("id", "message_id"))))
    index.add(*of("id % 3 = 0"))
    old, _ = of("id % 3 = 1")
    index.add(old.withColumn("body", F.lit("the old state, elle")))
    index.add(*of("id % 3 > 0"))
    index.delete(case.messages.filter("id % 7 = 0"))
    index.merge()
    return found_ids(index.snapshot().postings(), parse("the -elle"))


@query(f"SELECT id FROM ({family(['of the |en', 'the '], ['der '])})")
def snk15_one_segment(spark, sf_dir):
    """An index of several segments made one."""
    from mailquarry.plans.indexed import found_ids

    case, index = fixture_case(spark, sf_dir), _living(spark)
    for k in range(3):
        index.add(case.messages.filter(F.col("id") % 3 == k), case.attachments.filter(F.col("message_id") % 3 == k))
    index.optimise()
    return found_ids(index.snapshot().postings(), parse('"of the" OR en* the -der'))


# --- order ----------------------------------------------------------------------------------------------------

_FOLD = "translate(subject, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _place(page):
    """The place of every row of a sorted frame: within its partition, behind the rows of those before. Only counts of partitions meet in one task."""
    from pyspark.sql import Window as W

    from mailquarry.operators.store import cut

    rows = cut(page.select("id", F.monotonically_increasing_id().alias("at")))
    rows = rows.select("id", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("within"))
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("within") + 1).cast("int").alias("place"))  # one row a partition


@query(f"WITH {MSG} SELECT id, CAST(row_number() OVER (ORDER BY {_FOLD} ASC NULLS FIRST, date_ms DESC NULLS LAST, id DESC) AS INTEGER) AS place FROM msg")
def srt1_subject_order(spark, sf_dir):
    return _place(search(fixture_case(spark, sf_dir), Request(sort="subject", limit=None)))


_SPECS = [("size", "size true"), ("size:asc", "size false"), ("DateAsc", "date false"), ("SubjectAsc", "subject false"), ("bogus", "date true"), ("subject:desc", "subject true"), (" Sender ", "sender false"), ("relevance", "relevance false"), ("size:up", "date true")]


@query(f"""SELECT c_custkey AS k, {by_key(KEY, *(f"'{x}'" for _, x in _SPECS))} AS parsed FROM customer""")
def srt2_sort_specs(spark, sf_dir):
    from mailquarry.plans.sorting import parse_sort

    shown = lambda spec: "{} {}".format(*parse_sort(spec)).lower()
    return by_python(customers(spark, sf_dir, parsed=by_key(KEY, *(f"'{x}'" for x, _ in _SPECS))), "parsed", shown)


@query(f"WITH {MSG} SELECT id, CAST(row_number() OVER (ORDER BY date_ms ASC NULLS FIRST, id ASC) AS INTEGER) AS place FROM msg")
def srt3_date_order(spark, sf_dir):
    return _place(search(fixture_case(spark, sf_dir), Request(sort="date:asc", limit=None)))


@query(f"WITH {MSG} SELECT id FROM msg ORDER BY size DESC NULLS LAST, date_ms DESC NULLS LAST, id DESC LIMIT 40 OFFSET 40")
def srt5_second_page(spark, sf_dir):
    return search(fixture_case(spark, sf_dir), Request(sort="size", limit=40, offset=40)).select("id")


@query(family(["the "]))
def srt6_full_enumeration(spark, sf_dir):
    return search(fixture_case(spark, sf_dir), Request(query="the", limit=None)).select("id")


@query(f"WITH {MSG} SELECT id, CAST(row_number() OVER (ORDER BY {_FOLD} ASC NULLS FIRST, date_ms DESC NULLS LAST, id DESC) AS INTEGER) AS place FROM msg")
def srt6_keyset_pages(spark, sf_dir):
    """All rows by pages of a quarter of them; each page begins behind the last row of the one before, and none is sorted twice."""
    case = fixture_case(spark, sf_dir)
    size, out, before = -(-case.messages.count() // 4) or 1, None, 0
    for page in pages(case, Request(sort="subject", limit=size)):
        own = _place(page).withColumn("place", (F.col("place") + before).cast("int"))
        out, before = own if out is None else out.union(own), before + size
    return out


@query(f"WITH {MSG} SELECT id FROM msg ORDER BY date_ms DESC NULLS LAST, id DESC LIMIT 3000")
def srt7_more_rows(spark, sf_dir):
    """The first page of 1000 rows and the next 2000, which begin behind its last row."""
    case, first = fixture_case(spark, sf_dir), Request(limit=1000)
    page = search(case, first)
    return page.select("id").union(search(case, replace(first, limit=2000, after=cursor(page, "date", True))).select("id"))


@query("SELECT CAST(50 AS BIGINT) AS n, CAST(50 AS BIGINT) AS distinct_ids")
def srt8_random_sample(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id").orderBy(F.rand()).limit(50)
    return s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("distinct_ids"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey < c_custkey * 7 % 1000 THEN 'before' WHEN c_custkey = c_custkey * 7 % 1000 THEN 'same' ELSE 'behind' END AS place FROM customer")
def srt9_natural_order(spark, sf_dir):
    """Whether a part named by the key comes before one with another number, some of them written with zeros."""
    from mailquarry.extract.archives import natural_key

    def place(names: str) -> str:
        a, b = map(natural_key, names.split("|"))
        return "before" if a < b else "behind" if a > b else "same"

    return by_python(customers(spark, sf_dir, place="'slide' || c_custkey || '.xml|slide' || c_custkey * 7 % 1000 || '.xml'"), "place", place)


# --- sets -----------------------------------------------------------------------------------------------------


@query(f"WITH {MSG}, {ATT} SELECT id FROM msg WHERE contains({pad('subject')}, ' en ') UNION SELECT message_id FROM att WHERE contains({pad('name')}, ' en ')")
def set1_union_of_hits(spark, sf_dir):
    c = fixture_case(spark, sf_dir)
    own = c.messages.filter(X.matches(X.padded(F.col("subject")), ["en"])).select("id")
    return own.union(c.attachments.filter(X.matches(X.padded(F.col("name")), ["en"])).select("message_id")).distinct()


@query("SELECT doc_id FROM documents EXCEPT SELECT page_id FROM pages")
def set2_not_yet_indexed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT doc_id, list_has_any(w[1:len(w) // 2], w[len(w) // 2 + 1:]) AS shared FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def set3_shared_members(spark, sf_dir):
    w = F.split("text", " ", -1)
    half = F.floor(F.size(w) / 2).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.arrays_overlap(F.slice(w, F.lit(1), half), F.slice(w, half + 1, F.size(w) - half)).cast(T.BooleanType()).alias("shared"))
