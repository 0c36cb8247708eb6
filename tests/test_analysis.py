from datetime import datetime, timedelta

import pytest
from mailquarry.functions import dates, domains, excerpts, htmlscan, mail, sensitive
from mailquarry.functions import text as X
from mailquarry.operators import impersonation, threads
from mailquarry.operators.labels import SENSITIVE_LABELS, flag_labels
from mailquarry.operators.tree import folder_tree
from pyspark.sql import functions as F

D0 = datetime(2025, 10, 7, 8)

#: A name with a letter of another script, as it is written in addresses.
_CODED = "xn--" + "h\u0430rbourline".encode("punycode").decode()
_GIVEN = [("verdantmail.net", 80), ("verdantrnail.net", 1), ("verdantmail.shop", 2), ("verdantmaill.net", 1), ("glaciers.test", 60), ("glacier5.test", 3), ("harbourline.fr", 90), ("harb0urline.fr", 1),
          (f"{_CODED}.fr", 2), ("lone-pine.test", 4), ("vineyard.test", 7)]
_ALIKE = [("verdantrnail.net", "verdantmail.net", "homoglyph", 1), ("verdantmail.shop", "verdantmail.net", "suffix", 2), ("verdantmaill.net", "verdantmail.net", "typo", 1), ("glacier5.test", "glaciers.test", "homoglyph", 3),
          ("harb0urline.fr", "harbourline.fr", "homoglyph", 1), (f"{_CODED}.fr", "harbourline.fr", "punycode", 2)]

#: A header block with a folded hop, one hop that gives only an address, and verdicts that don't agree.
BLOCK = """Received: from relay.verdon.test (relay.verdon.test [192.0.2.44])\r
\tby inbox.maurin.test with ESMTPS id a9; Mon, 3 Mar 2025 18:20:41 +0100\r
Received: from [198.51.100.23]\r
 by relay.verdon.test with SMTP id b7; Mon, 3 Mar 2025 17:20:30 +0000\r
Authentication-Results: inbox.maurin.test; spf=pass smtp.mailfrom=verdon.test; dkim=fail; dmarc=none\r
From: Lea <lea@maurin.test>\r
Reply-To: desk@lagune.test\r
Return-Path: <bounce@news.maurin.test>\r
Subject: Inventaire de mars\r
\r
X-After: the block has ended\r
"""


def test_header_block(spark):
    df = spark.createDataFrame([(BLOCK,), ("",), (None,), ("\n\nA: 1\n B\nbad name: x\nC:2\n\nD: 3",)], "raw string").select(mail.headers(F.col("raw")).alias("h"))
    blocks = [[(x.name, x.value) for x in r.h] for r in df.collect()]
    assert len(blocks[0]) == 7 and blocks[1] == blocks[2] == [] and blocks[3] == [("A", "1 B"), ("C", "2")]
    row = df.limit(1).select(mail.authentication(F.col("h")).alias("a"), mail.hops(F.col("h")).alias("p")).select("a", "p", mail.with_delays(F.col("p")).alias("d")).first()
    assert tuple(row.a) == ("pass", "fail", "none")
    assert [(p["index"], p.from_ip, p.by) for p in row.p] == [(1, "198.51.100.23", "relay.verdon.test"), (2, "192.0.2.44", "inbox.maurin.test")] and row.d == [None, 11]


def test_addresses(spark):
    """As the plain expression finds them, in time that grows with the text."""
    import random
    import re
    import time

    plain = re.compile(rf"{mail.BEFORE_AT}+@{mail.BEHIND_AT}")
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab.@_-é <>'1", k=rng.randint(0, 40))) for _ in range(1500)] + ["a@b.c_d@e.fr", "x@y.z@w.v", "@a.b", "a@b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert {r.k: r.a for r in df.select("k", mail.addresses(F.col("t")).alias("a")).collect()} == {k: [x.lower() for x in plain.findall(t or "")] for k, t in enumerate(texts)}
    long = spark.createDataFrame([("A1b2" * 250_000 + " a@b.fr @" + "x" * 500_000,)], "t string").select(mail.addresses(F.col("t")).alias("a"))
    began = time.time()
    assert long.first().a == ["a@b.fr"] and time.time() - began < 20


def test_header_dates(spark):
    given = {"Tue, 7 Oct 2025 10:00:05 +0200 (CEST)": datetime(2025, 10, 7, 8, 0, 5), "7 Oct 25 10:00 EST": datetime(2025, 10, 7, 15), "junk": None, "99 Oct 2025 10:00": None}
    rows = spark.createDataFrame([(k,) for k in given], "s string").select("s", dates.parse_date(F.col("s")).alias("d")).collect()
    assert {r.s: r.d for r in rows} == given


def test_a_header_is_matched_once(spark):
    """Expressions that are named twice are computed twice: the parts of a date and of a hop must not match their text again and again."""
    df = spark.createDataFrame([("7 Oct 2025 10:00 +0200",)], "s string")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(dates.parse_date(F.col("s"))).count("(?i)(\\d{1,2})") == 2
    path = plan(mail.hops(mail.headers(F.col("s"))))
    assert path.count("\\bfrom\\b") == 1 and path.count("(?i)(\\d{1,2})") == 2


def test_date_flags(spark):
    now, m, h, d = datetime(2025, 10, 20), timedelta(minutes=1), timedelta(hours=1), timedelta(days=1)
    cases = [
        (D0 + timedelta(seconds=5), D0, D0 + timedelta(seconds=5), D0 + 30 * m, D0, [D0, D0 + timedelta(seconds=4)], 0),
        (D0, D0 + 3 * h, D0 + 2 * d, D0 - d, D0 - 3 * d, [D0, D0 - h], 1 + 2 + 4 + 8 + 64),
        (now + 30 * d, None, None, None, None, [], 16),
        (datetime(1990, 1, 1), None, None, None, None, [], 32),
        (D0 - 3 * m, D0, None, None, None, [None], 0),
        (None, None, None, None, None, None, 0),
    ]
    df = spark.createDataFrame([(i, *c[:-1], now) for i, c in enumerate(cases)], "k int, a timestamp, b timestamp, c timestamp, d timestamp, e timestamp, h array<timestamp>, n timestamp")
    got = {r.k: r.f for r in df.select("k", dates.date_flags(*(F.col(x) for x in "abcdehn")).alias("f")).collect()}
    assert got == {i: c[-1] for i, c in enumerate(cases)}


def test_lookalikes(spark):
    got = {r.domain: (r.resembles, r.kind) for r in impersonation.lookalikes(spark.createDataFrame(_GIVEN, "domain string, n long")).collect()}
    assert got == {d: (r, k) for d, r, k, _ in _ALIKE}


def test_one_edit_candidates_are_complete(spark):
    """Every pair within one edit meets by some half, whatever the edit."""
    import random

    rng = random.Random(1)
    base = "".join(rng.choices("abcde", k=9))
    edits = {base[:i] + base[i + 1 :] for i in range(9)} | {base[:i] + c + base[i:] for i in range(10) for c in "xz"} | {base[:i] + "x" + base[i + 1 :] for i in range(9)} | {base[:i] + base[i + 1] + base[i] + base[i + 2 :] for i in range(8)}
    given = [(base + ".com", 1000)] + [(e + ".com", 1) for e in edits if e != base]
    got = {r.domain for r in impersonation.lookalikes(spark.createDataFrame(given, "domain string, n long")).collect()}
    assert got == {e + ".com" for e in edits if e != base}


def test_sensitive_scan(spark):
    text = ("Merci de virer sur FR14 2004 1010 0505 0001 3M02 606 (ou DE89370400440532013000), carte 4111 1111 1111 1111, sécu 1 85 05 78 006 084 91 / corse 1 85 05 2A 006 084 35, "
            "tél 06 12 34 56 78 ou +33 6 12 34 56 78 ou +1 (415) 555-2671.")  # fmt: skip
    clean = "Commande 20241007123456 du 07/10/2025 à 10:00:00, ref 12 34 56 78 90, version 1.2.3.4 prix 1 234,56 €"
    wrong = "FR14 2004 1010 0505 0001 3M02 607, 4111 1111 1111 1112, 1 85 05 78 006 084 92"
    df = spark.createDataFrame([(1, text), (2, clean), (3, wrong), (4, None), (5, "1234567")], "id long, text string")
    hits = sensitive.scan(df).collect()
    kinds = [h.kind for h in sorted(hits, key=lambda h: h.pos) if h.id == 1]
    assert [kinds.count(k) for k in (1, 2, 4, 8)] == [2, 1, 2, 3] and {h.id for h in hits} == {1}
    masks = {h.masked for h in hits}
    assert {"FR14 **** **** 2606", "**** **** **** 1111"} <= masks
    assert tuple(sensitive.summary(sensitive.scan(df)).first()) == (1, 15, 8)
    shown = spark.range(1).select(flag_labels(F.lit(5), SENSITIVE_LABELS).alias("l")).first().l
    assert shown == "IBAN, N° de sécurité sociale"
    big = spark.createDataFrame([(1, "0" * 300_000)], "id long, text string")
    assert sensitive.scan(big).count() == 0


MAILS = "id long, message_id string, in_reply_to string, refs string, conv_key string, topic string, date_ms long, parties array<string>"
DAY = 86_400_000


def followed(rows):
    """Edges of weak links, subject by subject as described."""
    out, by_subject = set(), {}
    for i, root, subject, at, people in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
        by_subject.setdefault(subject, []).append((i, root, at, set(people or ())))
    for own in by_subject.values():
        up = {}

        def find(x, up=up):
            while x in up:
                x = up[x]
            return x

        for k, (i, root, at, people) in enumerate(own):
            for j, other, before, known in reversed(own[max(0, k - 8) : k]):
                a, b = find(root), find(other)
                if at - before > 120 * DAY or a == b:
                    break
                if people & known:
                    up[max(a, b)] = min(a, b)
                    out.add((i, j))
                    break
    return out


def test_threads(spark):
    rows = [
        (1, "<P1@lac.test>", None, None, None, "Chantier du pont", 10 * DAY, None), (2, "p2@lac.test", "p1@lac.test", None, None, None, None, None), (3, "p3@lac.test", None, "<p0@lac.test> <p2@lac.test>", None, "x", 0, None),
        (4, None, None, None, "KEY-A", "Devis", 0, None), (5, None, None, None, "KEY-A", None, 0, None),
        (6, None, None, None, None, "Inventaire du dépôt", 20 * DAY, ["lise", "omar"]), (7, None, None, None, None, "Re: Tr: Inventaire  du DÉPÔT", 139 * DAY, ["omar"]), (8, None, None, None, None, "inventaire du dépôt", 139 * DAY, ["zoe"]),
        (9, None, None, None, None, "Inventaire du dépôt", 260 * DAY, ["omar"]), (10, None, None, None, None, "Devis", 1 * DAY, ["lise"]), (11, None, None, None, None, "Devis", 2 * DAY, ["lise"]),
    ]
    got = {r.id: (r.thread_id, r.thread_count) for r in threads.build(spark.createDataFrame(rows, MAILS)).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 2), 5: (4, 2), 6: (6, 2), 7: (6, 2), 8: (8, 1), 9: (9, 1), 10: (10, 1), 11: (11, 1)}
    assert threads.build(spark.createDataFrame([], MAILS)).count() == 0


def test_incremental_threads(spark):
    """After each batch the labels are those of building anew; classes that nothing ties keep their rows."""
    import random

    rng = random.Random(6)
    rows = [(i, rng.choice([f"<M{rng.randrange(260)}@x>", None]), rng.choice([None, f"m{rng.randrange(260)}@x"]), rng.choice([None, f"<m{rng.randrange(300)}@x> <m{rng.randrange(300)}@x>"]) if i % 4 == 0 else None,
             rng.choice([None, None, None, f"k{rng.randrange(90)}"]), None, None, None) for i in rng.sample(range(1000), 240)]
    state, seen = threads.start(spark), []
    for k in range(4):
        batch = rows[k * 60 : (k + 1) * 60]
        old = {r.id: r.root for r in state.labels.collect()}
        seen += batch
        state, changed = threads.extend(state, spark.createDataFrame(batch, MAILS))
        whole = {r.id: r.thread_id for r in threads.build(spark.createDataFrame(seen, MAILS), weak=False).collect()}
        assert {r.id: r.root for r in state.labels.collect()} == whole
        assert {r.id: r.root for r in changed.collect()} == {i: r for i, r in whole.items() if old.get(i) != r}
    state, changed = threads.extend(state, spark.createDataFrame([], MAILS))
    assert changed.count() == 0 and state.labels.count() == 240


def weak_case(n, seed):
    import random

    rng = random.Random(seed)
    rows = [(i, rng.randrange(n) if rng.random() < 0.3 else i, f"matter {rng.choice([0, 0, 0, 1, 2])}", rng.randrange(900 if i % 2 else 90) * DAY, rng.sample("abcdefgh", 2)) for i in range(n)]
    return [(i, min(root, i), *rest) for i, root, *rest in rows]


def test_weak_links_brute_force(spark):
    """The stretches of a subject give what the whole subject gives, where a thread doesn't come back after a pause."""
    for seed in range(3):
        rows = [(i, i, *rest) for i, _, *rest in weak_case(400, seed)]
        items = spark.createDataFrame([(i, None, None, None, None, s, at, p) for i, _, s, at, p in rows], MAILS).repartition(3)
        got = [tuple(r) for r in threads.weak_edges(items, spark.createDataFrame([], "node long, root long")).collect()]
        assert len(got) == len(set(got)) and set(got) == followed(rows)


@pytest.mark.parametrize("plan", [{"spark.sql.autoBroadcastJoinThreshold": "-1"}, {"spark.sql.adaptive.autoBroadcastJoinThreshold": "100m"}])
def test_weak_links_keep_a_subject_together(spark, plan):
    """However Spark joins and splits what comes before, no link is lost."""
    own = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.coalescePartitions.enabled": "false", **plan}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        items = spark.range(6000).selectExpr("id", "CAST(NULL AS STRING) message_id", "CAST(NULL AS STRING) in_reply_to", "CAST(NULL AS STRING) refs", "CAST(NULL AS STRING) conv_key", "concat('matter ', id % 3) topic", "id * 1000 date_ms", "array('a') parties")
        roots = spark.createDataFrame([], "node long, root long")
        assert threads.weak_edges(items, roots).count() == 6000 - 3
    finally:
        for k in own:
            spark.conf.unset(k)


def test_thread_components_brute_force(spark):
    import random

    rng = random.Random(2)
    rows = [(i, f"m{rng.randrange(300)}@x", f"<m{rng.randrange(300)}@x>" if rng.random() < 0.4 else None, None, f"k{rng.randrange(400)}" if rng.random() < 0.2 else None, None, None, None) for i in range(250)]
    up = {i: i for i in range(250)}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in rows:
        for b in rows:
            if a[1] == b[1] or (a[4] and a[4] == b[4]) or (a[2] and a[2].strip("<>") == b[1]):
                x, y = find(a[0]), find(b[0])
                up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "id long, message_id string, in_reply_to string, refs string, conv_key string, topic string, date_ms long, parties array<string>")
    assert {r.id: r.thread_id for r in threads.build(df).collect()} == {i: find(i) for i in range(250)}


def test_folder_tree(spark):
    df = spark.createDataFrame([("a/b", 3), ("a/b", 2), ("a/b/c", 1), ("d", 0)], "path string, items long")
    assert {(r.path, r["name"], r.depth, r["items"], r.total) for r in folder_tree(df).collect()} == {("a", "a", 0, 0, 6), ("a/b", "b", 1, 5, 6), ("a/b/c", "c", 2, 1, 1), ("d", "d", 0, 0, 0)}
    assert folder_tree(df, hide_empty=True).count() == 3


def test_names_and_case_flags(spark):
    rows = [(i, "Jean Martin", "jean.martin@societe.fr", 16) for i in range(6)] + [(6, "Jean Martin", "jean.martin@societe-secure.ru", 1), (7, "Compta", "x@soc1ete.fr", 0), (8, None, "a@b.fr", 40), (9, "Jean MARTIN", "j@mail.societe.fr", 0)]
    m = spark.createDataFrame(rows, "id long, sender_name string, sender_email string, spoof_flags int")
    fakes = impersonation.impersonated(impersonation.names(m))
    assert [r.email for r in fakes.collect()] == ["jean.martin@societe-secure.ru"]
    looks = impersonation.lookalikes(impersonation.domain_counts(m))
    assert [(r.domain, r.resembles) for r in looks.collect()] == [("soc1ete.fr", "societe.fr")]
    flags = {r.id: r.spoof_flags for r in impersonation.case_flags(m, looks, fakes).collect()}
    assert flags == {**dict.fromkeys(range(6), 16), 6: 33, 7: 8, 8: 0, 9: 0}


def test_text_functions(spark):
    df = spark.createDataFrame([("a b a b a", "<p>x &amp; y</p><script>1</script>z", "Voilà the cat, THE dog")], "t string, h string, s string")
    pad = X.padded(F.col("t"))
    r = df.select(
        X.occurrences(pad, ["a", "b"]).alias("n"), X.occurrences(pad, ["a"]).alias("k"), X.occurrences(pad, ["a", "b", "a"]).alias("m"), X.token_count(pad).alias("c"), X.matches(pad, []).alias("e"),
        X.matches(pad, ["b", "a"], True).alias("p"), X.html_to_text(F.col("h")).alias("h"), excerpts.highlight(F.col("s"), ["the", "do*"]).alias("s"), excerpts.snippet(F.col("s"), [(["cat"], False)], 3).alias("x"),
    ).first()
    assert (r.n, r.k, r.m, r.c, r.e, r.p) == (2, 3, 2, 5, False, True)
    assert r.h == "x & y\n z" and r.s.replace(' class="pl-hit"', "") == "Voilà <mark>the</mark> cat, <mark>THE</mark> <mark>dog</mark>" and r.x == "Voilà the «cat»…"


def test_skeletons():
    assert domains.skeleton_of(_CODED) == domains.skeleton_of("harbourline") and domains.skeleton_of(None) == "" and domains.skeleton_of("xn--\x00bad") != ""


def test_marks_stay_out_of_tags_and_entities():
    finder = excerpts._finder(["cafe", "été*", "amp"])
    show = lambda h: excerpts.marked(h, finder).replace(excerpts.MARK, "[").replace(excerpts.END_MARK, "]")
    assert show("Le Café, cafés et CAFE") == "Le [Café], cafés et [CAFE]"
    assert show("<a title='cafe'>étés</a> &amp; amp") == "<a title='cafe'>[étés]</a> &amp; [amp]"
    assert show("<head><title>cafe</title></head><style>cafe{}</style>cafe") == "<head><title>cafe</title></head><style>cafe{}</style>[cafe]"
    assert excerpts.marked(None, finder) is None and excerpts._finder(["*", "..."]) is None
    many = "cafe <b>" * 6000
    assert excerpts.marked(many, finder).count(excerpts.END_MARK) == excerpts.MOST_MARKS + 1


def test_sanitised_pages(spark):
    """What is left of a fragment, and whether something of it would have been loaded."""
    cases = [
        ("<p>a</p>", "<p>a</p>", False), (None, None, False), ("", "", False),
        ("<SCRIPT src=x>a</SCRIPT ><script>b", "b", False), ("<noscript><img src='http://x.test'></noscript>", "", False), ("<meta http-equiv=refresh><base href='//x.test'>c", "c", False),
        ("<p onmouseover='f(\"x\")'>d</p>", "<p >d</p>", False), ("<form action=javascript:f>e</form>", '<form action="#">e</form>', False),
        ("<img src=//x.test/i>", f'<img src="" {htmlscan.BLOCKED}>', True), ("<img src=' HTTPS://x.test/i'>", f'<img src="" {htmlscan.BLOCKED}>', True), ("<img src='file:///c'>", f'<img src="" {htmlscan.BLOCKED}>', True),
        ("<img src='cid:a@b'>", "<img src='cid:a@b'>", False), ("<img src='data:image/png;base64,AA=='>", "<img src='data:image/png;base64,AA=='>", False),
        ("<img srcset='a.png 1x'>", "<img srcset='a.png 1x'>", False), ("<a href='https://x.test'>f</a>", "<a href='https://x.test'>f</a>", False),
        ("<use xlink:href='//x.test/a' href='//x.test/b'/>", '<use xlink:href="" href=""/>', True), ("<style>@import 'http://x.test/a.css';</style>", "<style>;</style>", True),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "k int, h string")
    got = {r.k: (r.c, r.b) for r in df.select("k", X.sanitise(F.col("h")).alias("c"), X.has_remote(F.col("h")).alias("b")).collect()}
    assert got == {i: (c[1], c[2]) for i, c in enumerate(cases)}


def test_sanitiser_reads_attributes_as_viewers_do():
    """However it is written, nothing runs and nothing is loaded; what is harmless stays as it is."""
    runs = [
        "<img/onerror=f()>", "<svg/onload='f()'>", "<a href='java&#115;cript:f()'>", "<a href='java\tscript:f()'>", "<a href=' \x01javascript:f()'>", "<a href=JAVASCRIPT&colon;f()>", "<form><button formaction='javascript:f()'>",
        "<a href='data:text/html;base64,x'>", "<img src=x onerror\n=\n'f()'>", "<img title='>' onerror=f()>", "<p =x onclick=f()>", "<scr<script>x</script>ipt>", "<x:y onload=f()>", "<body onload=f() onload=g()>",
    ]
    for page in runs:
        clean, _ = htmlscan.sanitised(page)
        assert not any(x in htmlscan.decoded(clean).lower().replace("\t", "").replace(" ", "") for x in ("javascript:", "f()", "g()", "data:text/html")), (page, clean)
    loads = [
        "<img src=&#104;ttp://x.test/i>", "<img src='ht\ntp://x.test/i'>", "<img/src=//x.test/i>", "<p style='background:url(&quot;http://x.test/i&quot;)'>", r"<p style='background:u\72l(http://x.test/i)'>", "<p style='background:u/**/rl(//x.test)'>",
        "<style>@import \"//x.test/a.css\";</style>", r"<style>a{b:\75rl(//x.test/i)}</style>", "<video poster=http://x.test/p>", "<image href=//x.test/i>", "<img srcset='a 1x, //x.test/b 2x'>",
    ]
    for page in loads:
        clean, blocked = htmlscan.sanitised(page)
        assert blocked and "x.test" not in clean, (page, clean)
    for page in ["<a href='https://x.test'>x</a>", "<p title='on sale = now'>1 < 2 & 3 > 2</p>", "<p onto>", "<!-- <img src='//x.test'> -->", "<img src='cid:a' alt='//x'>", "<p style='color:red'>", "< b>", "<", "<p", "<style>a{}</style>", "<styled style=x>"]:
        assert htmlscan.sanitised(page) == (page, False), page
    big = "<a b" * 100_000 + "<p style='url(" * 2_000 + "<" * 100_000
    assert htmlscan.text_of(big) is not None and htmlscan.sanitised(big)[0]


def test_page_text():
    cases = {
        "<p>a</p>b<br>c<BR/>d": "a\nb\nc\nd", "<td>1</td><td>2</td>": "1 2", "x<script>if (a<b) f('</p>')</script >y": "x y", "<title>t</title>a<o:p>z</o:p>b": "a b", "<!-- <p> -->a": "a",
        "&eacute;&euro;&#233;&#xE9;&amp;lt;&nope;&amp": "é€éé&lt;&nope;&amp", "a\n\n\n\n b": "a\n\n b", "a\r\nb\u00a0\t c": "a\nb c", "<script>open": "open", "a < b": "a < b", "<h1>t</h1>x": "t\nx", "": "",
    }
    assert {k: htmlscan.text_of(k) for k in cases} == cases and htmlscan.text_of(None) is None


def test_values_without_overlaps_match_brute_force():
    import random

    rng = random.Random(3)
    pieces = ["FR76 3000 6000 0112 3456 7890 189", "4111 1111 1111 1111", "01 23 45 67 89", "+44 20 7946 0958", "2 69 05 49 588 157 80", "12", " ", "-", "x"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "", ","]) for _ in range(rng.randint(1, 10)))
        hits = sorted((sensitive.ORDER[k], m.start(), m.end() - m.start(), k) for k, rx in sensitive.PATTERNS for m in rx.finditer(text) if sensitive.CHECKS[k](m.group()))
        kept = []
        for _, start, length, kind in hits:
            if not any(start < s + n and s < start + length for _, s, n in kept):
                kept.append((kind, start, length))
        assert sensitive.find(text) == (sorted(kept, key=lambda h: h[1]) if len(text) >= 8 else [])
