"""Queries on string, date and validation functions."""

from __future__ import annotations

import base64
import struct
from datetime import datetime

from pyspark.sql import functions as F

from mailquarry.functions import dates as D
from mailquarry.functions import domains as N
from mailquarry.functions import mail as M
from mailquarry.functions import sensitive as S
from mailquarry.functions import text as X
from mailquarry.plans.registry import HTML_TEXT, KEY, MSG, by_key, customers, query, reading
from mailquarry.sources.case import fixture_messages, spread, table


# --- addresses, domains, subjects -------------------------------------------------------------------------------

_ADDR = r"[A-Za-z0-9._%+\-''!#$&*/=?^`{|}~]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"


@query(f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{_ADDR}'), lambda x: lower(x)), ',') AS addresses FROM documents")
def str1_addresses(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(M.addresses(F.col("text")), ",").alias("addresses"))


_DOMAINS = by_key(KEY, "'u' || {k} || '@Host' || {k} || '.TEST'", "'a@b@X' || {k} || '.Com'", "'x@y' || {k} || '.org>'", "'nobody' || {k}", "'x' || {k} || '@'", "'q@z' || {k} || '.net..'")


@query(f"""SELECT c_custkey AS k, {by_key(KEY, "'host' || {k} || '.test'", "'x' || {k} || '.com'", "'y' || {k} || '.org'", "NULL", "NULL", "'z' || {k} || '.net'")} AS domain FROM customer""")
def str2_domain_of(spark, sf_dir):
    return customers(spark, sf_dir, address=_DOMAINS).select("k", M.domain_of(F.col("address")).alias("domain"))


_ORG = "CASE WHEN len(p) <= 2 THEN array_to_string(p, '.') WHEN length(p[-1]) = 2 AND p[-2] IN ('co','com','org','net','gov','ac','edu','gouv','asso','or','ne','go') THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END"


@query(f"WITH h AS (SELECT page_id, string_split(lower(regexp_extract(url, '://([^/?#]*)', 1)) || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.uk' ELSE '.co.uk' END, '.') AS p FROM pages) SELECT page_id, {_ORG} AS org FROM h")
def str3_organisational(spark, sf_dir):
    host = F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, ".uk").otherwise(".co.uk"))
    return table(spark, sf_dir, "pages").select("page_id", M.organisational(host).alias("org"))


_NAMES = by_key(KEY, "'acme' || {k} || '.co.uk'", "'lac' || {k} || '.fr'", "'alone' || {k}")


@query(f"""SELECT c_custkey AS k, {by_key(KEY, "'acme' || {k}", "'lac' || {k}", "'alone' || {k}")} AS label, {by_key(KEY, "'co.uk'", "'fr'", "''")} AS suffix FROM customer""")
def str4_label_and_suffix(spark, sf_dir):
    return customers(spark, sf_dir, org=_NAMES).select("k", M.label(F.col("org")).alias("label"), M.suffix(F.col("org")).alias("suffix"))


_SEEN = by_key(KEY, "'corner-shop' || {k}", "'Bou1ang3rie_' || {k}", "'vvater' || {k}", "'c|ock' || {k}", "'роса' || {k}", "'hôtel' || {k}")
_SHAPES = by_key(KEY, "'comershop' || n", "'boulang3rle' || n", "'water' || n", "'dock' || n", "'poca' || n", "'hotel' || n")


@query(f"SELECT c_custkey AS k, {_SHAPES} AS skeleton FROM (SELECT c_custkey, translate(CAST(c_custkey AS VARCHAR), '015', 'ols') AS n FROM customer)")
def str5_skeleton(spark, sf_dir):
    return customers(spark, sf_dir, label=_SEEN).select("k", N.skeleton(F.col("label")).alias("skeleton"))


@query("SELECT a.c_custkey, damerau_levenshtein(a.c_name, b.c_name) <= 1 AS near FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 9")
def str6_one_edit(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    b = a.select((F.col("c_custkey") - 9).alias("c_custkey"), F.col("c_name").alias("other"))
    return a.join(b, "c_custkey").select("c_custkey", N.within_one_edit(F.col("c_name"), F.col("other")).alias("near"))


_TOPICS = by_key(KEY, "'Re[' || {k} || ']:  FW : Dossier   ' || c_name", "'Retard: ' || c_name", "'  AW:WG: ' || c_name || ' '", "NULL", "'ENC :  A' || chr(9) || c_name", "'Sv : re: ANTW:' || c_name")


@query(f"""SELECT c_custkey AS k, {by_key(KEY, "'dossier ' || lower(c_name)", "'retard: ' || lower(c_name)", "lower(c_name)", "''", "'a ' || lower(c_name)", "lower(c_name)")} AS clean FROM customer""")
def str7_normalise_subject(spark, sf_dir):
    return customers(spark, sf_dir, subject=_TOPICS).select("k", M.normalise_subject(F.col("subject")).alias("clean"))


_IDS = by_key(KEY, "'<A' || {k} || '@X>'", "'  b' || {k} || '@Y '", "''", "NULL", "'<<c' || {k} || '>>'")


@query(f"""SELECT c_custkey AS k, {by_key(KEY, "'a' || {k} || '@x'", "'b' || {k} || '@y'", "NULL", "NULL", "'c' || {k}")} AS clean FROM customer""")
def str8_normalise_id(spark, sf_dir):
    return customers(spark, sf_dir, id=_IDS).select("k", M.normalise_id(F.col("id")).alias("clean"))


_ANSWERED = by_key(KEY, "'<A' || {k} || '@x>'", "NULL", "NULL", "'g' || {k} || '@x'")
_REFERRED = by_key(KEY, "'<b' || {k} || '@x> junk <C@x>'", "'d' || {k} || '@x e@x,' || chr(9) || 'f@x'", "NULL", "''")


@query(f"""SELECT c_custkey AS k, {by_key(KEY, "'a' || {k} || '@x,b' || {k} || '@x,c@x'", "'d' || {k} || '@x,e@x,f@x'", "''", "'g' || {k} || '@x'")} AS ids FROM customer""")
def str9_referenced_ids(spark, sf_dir):
    df = customers(spark, sf_dir, irt=_ANSWERED, refs=_REFERRED)
    return df.select("k", F.array_join(M.referenced_ids(F.col("irt"), F.col("refs")), ",").alias("ids"))


#: A header block of each conversation row, folded once, behind which its text isn't looked at.
_BLOCK = "'From: ' || role || chr(13) || chr(10) || 'Subject: turn ' || turn || chr(13) || chr(10) || chr(9) || ' of ' || conv_id || chr(13) || chr(10) || 'no header' || chr(10) || 'X-Turn:' || turn || chr(10) || chr(10) || text"


@query("""SELECT conv_id, turn, k, n AS name, CASE k WHEN 1 THEN role WHEN 2 THEN 'turn ' || turn || ' of ' || conv_id ELSE CAST(turn AS VARCHAR) END AS value
  FROM conversations, (VALUES (1, 'From'), (2, 'Subject'), (3, 'X-Turn')) v(k, n)""")
def str10_header_block(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", M.headers(F.expr(_BLOCK)).alias("h"))
    return own.select("conv_id", "turn", F.posexplode("h").alias("k", "x")).select("conv_id", "turn", (F.col("k") + 1).alias("k"), "x.name", "x.value")


#: Two hops of each customer's message, the second folded and in another zone.
_HOPS = """'Received: from relay' || c_custkey || '.test (relay' || c_custkey || '.test [192.0.2.' || c_custkey % 250 || '])' || chr(10) || chr(9) || 'by inbox.test with ESMTPS id a9; Mon, 3 Mar 2025 18:21:00 +0100' || chr(10)
  || 'Received: from [198.51.100.' || c_custkey % 200 || '] by relay' || c_custkey || '.test with SMTP id b7; Mon, 3 Mar 2025 17:20:' || lpad(CAST(c_custkey % 60 AS {0}), 2, '0') || ' +0000' || chr(10) || 'Subject: x'"""


@query("""SELECT c_custkey, k, CASE k WHEN 1 THEN '198.51.100.' || c_custkey % 200 ELSE '192.0.2.' || c_custkey % 250 END AS ip, CASE k WHEN 1 THEN 'relay' || c_custkey || '.test' ELSE 'inbox.test' END AS server,
  CASE k WHEN 1 THEN '2025-03-03 17:20:' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') ELSE '2025-03-03 17:21:00' END AS stamp, CASE k WHEN 2 THEN CAST(60 - c_custkey % 60 AS INTEGER) END AS delay FROM customer, (VALUES (1), (2)) v(k)""")
def str11_received_hops(spark, sf_dir):
    own = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", M.hops(M.headers(F.expr(_HOPS.format("STRING")))).alias("p"))
    path = own.select("c_custkey", F.posexplode(F.arrays_zip(F.col("p"), M.with_delays(F.col("p")).alias("d"))).alias("k", "z"))
    hop = path.select("c_custkey", (F.col("k") + 1).alias("k"), F.col("z").getField("p").alias("p"), F.col("z").getField("d").cast("int").alias("delay"))
    return hop.select("c_custkey", "k", F.col("p.from_ip").alias("ip"), F.col("p.by").alias("server"), F.date_format("p.time", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "delay")


_SAID = by_key("c_custkey % 3", "'pass'", "'fail'", "'neutral'")
_VERDICTS = by_key(
    KEY,
    f"'Authentication-Results: a; spf=' || {_SAID} || '; dkim=fail' || chr(10) || 'Authentication-Results: b; dmarc=fail'",
    f"'Authentication-Results: a; none' || chr(10) || 'Authentication-Results: b; dkim=fail; dkim=' || {_SAID}",
    f"'Received-SPF: ' || upper({_SAID}) || ' (said so)'",
    "'Subject: spf=' || c_name",
    f"'Authentication-Results: a; DMARC = ' || {_SAID} || chr(10) || 'Received-SPF: softfail'",
)


@query(f"""SELECT c_custkey AS k, {by_key(KEY, _SAID, "NULL", _SAID, "NULL", "'softfail'")} AS spf, {by_key(KEY, "'fail'", f"CASE WHEN {_SAID} = 'pass' THEN 'pass' ELSE 'fail' END", "NULL", "NULL", "NULL")} AS dkim,
  {by_key(KEY, "NULL", "NULL", "NULL", "NULL", _SAID)} AS dmarc FROM customer""")
def str12_auth_verdicts(spark, sf_dir):
    return customers(spark, sf_dir, raw=_VERDICTS).select("k", M.authentication(M.headers(F.col("raw"))).alias("a")).select("k", "a.*")


@query(f"SELECT page_id, {HTML_TEXT} AS content FROM pages")
def str13_html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_to_text(F.col("html")).alias("content"))


@query("SELECT doc_id, text AS content FROM documents")
def str14_rtf_to_text(spark, sf_dir):
    """Each text as RTF, with characters beyond ASCII by number and in the code page, groups that aren't shown and line ends."""
    from mailquarry.extract.rtf import rtf_text

    def char(c: str, k: int) -> str:
        if c in "\\{}":
            return "\\" + c
        if c == "\n":
            return "\\par\n"
        if c == "\t":
            return "\\tab "
        if c < " " or ord(c) > 126:
            return f"\\'{ord(c):02x}" if 160 <= ord(c) < 256 and k % 2 else "".join(f"\\u{u - 65536 if u > 32767 else u}?" for u in struct.unpack(f"<{len(c.encode('utf-16-le')) // 2}H", c.encode("utf-16-le")))
        return c

    def read(i: int, t: str) -> str:
        body = "".join(char(c, i) for c in t)
        return rtf_text(("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}{\\*\\generator x}{\\pict 00ff}\\f0 " + body + "}").encode("ascii"))

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(reading("content", read), "doc_id long, content string")


#: What is put behind a page, by page_id modulo their number: a fragment, what is left of it, and whether something was blocked.
_RISKS = [
    ("<p onclick=\"x()\">a</p>", "<p >a</p>", False),
    ("<a href='vbscript:f'>b</a><a href=\"https://out.test/\" ping=\"https://t.test\">c</a>", "<a href=\"#\">b</a><a href=\"https://out.test/\" >c</a>", False),
    ("<img src=\"https://out.test/i.png\"><img src=\"cid:A1\">", "<img src=\"\" data-pl-blocked=\"1\"><img src=\"cid:A1\">", True),
    ("<td style=\"background:url('//out.test/b')\">d</td>", "<td style=\"background:url()\">d</td>", True),
    ("<applet code=x>e</applet><frame src=f><noscript>g</noscript>h", "h", False),
    ("<svg><image xlink:href=\"http://out.test/s\"/></svg>", "<svg><image xlink:href=\"\"/></svg>", True),
    ("<a href=\"data:text/html,x\">i</a><img srcset=\"http://out.test/1 1x\">", "<a href=\"#\">i</a><img  data-pl-blocked=\"1\">", True),
    ("<b style='background:image-set(\"http://out.test/z\" 1x)'>j</b>", "<b style='background:none'>j</b>", True),
]


def _by_page(k: int) -> str:
    text = lambda x: x if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"
    return f"CASE page_id % {len(_RISKS)} " + " ".join(f"WHEN {i} THEN {text(r[k])}" for i, r in enumerate(_RISKS)) + " END"


@query(f"SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'), '<meta [a-z]+=\"[^\"]*\">', '', 'g') || {_by_page(1)} AS clean, {_by_page(2)} AS blocked FROM pages")
def str15_sanitise(spark, sf_dir):
    html = F.concat("html", F.expr(_by_page(0).replace("''", "\\'")))
    return table(spark, sf_dir, "pages").select("page_id", X.sanitise(html).alias("clean"), X.has_remote(html).alias("blocked"))


@query("""SELECT page_id, '<img src="' || CASE WHEN page_id % 5 < 3 THEN 'https://shown.test/' || (page_id % 5) ELSE '' END || '"><img src="' || CASE page_id % 2 WHEN 0 THEN 'https://shown.test/logo' ELSE 'none.png' END || '">' || html AS shown FROM pages""")
def str16_inline_images(spark, sf_dir):
    names = F.map_from_entries(F.array(*(F.struct(F.lit(k), F.lit(f"https://shown.test/{v}")) for k, v in [("a0", "0"), ("a1", "1"), ("a2@host", "2"), ("logo one.png", "logo")])))
    own = F.concat(F.lit('<img src="cid:A'), (F.col("page_id") % 5).cast("string"), F.lit('@host"><img src="'), F.when(F.col("page_id") % 2 == 0, "Logo%20one.png").otherwise("none.png"), F.lit('">'), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", X.inline_images(own, names).alias("shown"))


#: How a text is written, by doc_id modulo their number: with a byte order mark, in UTF-8, in UTF-16 without a mark, in Windows-1252.
_WRITTEN = [("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-8", b""), ("utf-16-le", b""), ("cp1252", b"")]


@query("SELECT doc_id, text AS content FROM documents")
def str17_charset(spark, sf_dir):
    from mailquarry.extract.plain import decode

    def coded(i: int, text: str) -> bytes:
        name, mark = _WRITTEN[i % len(_WRITTEN)]
        if name == "cp1252" or name == "utf-16-le" and not mark:
            try:
                text.encode("cp1252" if name == "cp1252" else "latin-1")
            except UnicodeEncodeError:
                name = "utf-8"  # what Windows-1252 can't write, and what has no zeros to be known by
        return mark + text.encode(name)

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(reading("content", lambda i, t: decode(coded(i, t))), "doc_id long, content string")


_NORM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t\\x{00a0}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, trim({_NORM}) AS clean FROM documents")
def str18_normalise_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalise(F.col("text")).alias("clean"))


@query("SELECT doc_id, text AS decoded FROM documents")
def str19_encoded_words(spark, sf_dir):
    """Each text in encoded words of 40 characters, by turns in both codings and two character sets."""
    from mailquarry.extract.mime import decode_words

    def coded(part: str, k: int) -> str:
        charset = "iso-8859-1" if all(ord(c) < 256 for c in part) and k % 3 == 0 else "utf-8"
        data = part.encode(charset)
        return f"=?{charset}?B?{base64.b64encode(data).decode()}?=" if k % 2 else f"=?{charset}?q?{''.join(f'={b:02X}' for b in data)}?="

    def decoded(_, t: str) -> str:
        return decode_words(" ".join(coded(t[k : k + 40], k // 40) for k in range(0, len(t), 40)))

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(reading("decoded", decoded), "doc_id long, decoded string")


_FOUR = "lpad(CAST(c_custkey % 10000 AS {0}), 4, '0')"
_TWO = "lpad(CAST(c_custkey % 100 AS {0}), 2, '0')"
_VALUES = by_key(KEY, f"'be68-5390.0754 ' || {_FOUR}", f"'4000 0012 3456 ' || {_FOUR}", f"'2 91 11 33 063 217 ' || {_TWO}", f"'07 81 22 43 ' || {_TWO}", f"'+33 6 44 51 09 ' || {_TWO}")
_HIDDEN = by_key(KEY, f"'BE68 **** **** ' || {_FOUR}", f"'**** **** **** ' || {_FOUR}", f"'2 ** ** ** *** *** ' || {_TWO}", f"'07 ** ** ** ' || {_TWO}", f"'+3364 ** ** ** ' || {_TWO}")


@query(f"SELECT c_custkey AS k, {_HIDDEN.format('VARCHAR')} AS masked FROM customer")
def str20_masks(spark, sf_dir):
    own = customers(spark, sf_dir, kind=by_key(KEY, "1", "2", "4", "8", "8"), value=_VALUES.format("STRING"))
    return own.select("k", S.masked(F.col("kind"), F.col("value")).alias("masked"))


_WANTED = by_key(KEY, "'a/b:c?' || {k} || '.eml'", "'   '", "NULL", "'name' || {k} || '. .'", "repeat('long ', 40) || {k}")


@query(f"""SELECT c_custkey AS k, {by_key(KEY, "'a_b_c_' || {k} || '.eml'", "'message'", "'message'", "'name' || {k}", "trim(repeat('long ', 24))")} AS safe FROM customer""")
def str21_file_name(spark, sf_dir):
    from mailquarry.operators.labels import file_name

    return customers(spark, sf_dir, name=_WANTED).select("k", file_name(F.col("name")).alias("safe"))


@query("SELECT page_id, lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\\.[^./\\\\]+$')) AS ext FROM pages")
def str22_extension(spark, sf_dir):
    from mailquarry.operators.labels import extension

    return table(spark, sf_dir, "pages").select("page_id", extension(F.substring_index(F.substring_index("url", "?", 1), "#", 1)).alias("ext"))


_PATHS = by_key(KEY, "'C:' || chr(92) || 'Mail' || chr(92) || 'x' || {k}", "'c:/MAIL'", "'C:/Mailing/' || {k}", "'D:/Mail/' || {k}", "'c:' || chr(92) || 'mail/' || c_name")


@query(f"""SELECT c_custkey AS k, {by_key(KEY, "true", "true", "false", "false", "true")} AS below FROM customer""")
def str23_path_below(spark, sf_dir):
    from mailquarry.sources.discovery import is_under

    return customers(spark, sf_dir, path=_PATHS).select("k", is_under(F.col("path"), "C:\\Mail\\").alias("below"))


# --- dates ------------------------------------------------------------------------------------------------------

_DAY = "day(o_orderdate) || ' ' || substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(o_orderdate) - 2 AS INTEGER), 3)"
_CLOCK = "' 10:' || lpad(CAST(o_orderkey % 60 AS {0}), 2, '0')"
_STAMPS = by_key("o_orderkey", f"'Tue, ' || {_DAY} || 'uary ' || year(o_orderdate) || {_CLOCK} || ':05 +0200 (CEST)'", f"{_DAY} || ' ' || year(o_orderdate) || {_CLOCK} || ' EST'", f"{_DAY} || ' ' || year(o_orderdate) || {_CLOCK} || ':59 -0130'",
                 f"{_DAY} || ' ' || substr(CAST(year(o_orderdate) AS {{0}}), 3, 2) || {_CLOCK} || ' XYZ'", "'31 Feb 2024 10:00 GMT'", "'junk ' || o_orderkey", "NULL")
_AT = "strftime(CAST(o_orderdate AS DATE) + to_minutes(600 + o_orderkey % 60 + ({0})) + to_seconds({1}), '%Y-%m-%d %H:%M:%S')"


@query(f"SELECT o_orderkey, {by_key('o_orderkey', _AT.format('-120', 5), _AT.format('300', 0), _AT.format('90', 59), _AT.format('0', 0), 'NULL', 'NULL', 'NULL')} AS stamp FROM orders")
def dat1_header_dates(spark, sf_dir):
    said = F.expr(_STAMPS.format("STRING"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(D.parse_date(said), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN epoch(l_shipdate) < epoch(o_orderdate) - 300 THEN 1 ELSE 0 END
  + CASE WHEN abs(epoch(o_orderdate) - epoch(l_shipdate)) > 7200 THEN 4 ELSE 0 END
  + CASE WHEN greatest(epoch(l_shipdate), epoch(o_orderdate)) > epoch(TIMESTAMP '1998-06-01') + 86400 THEN 16 ELSE 0 END
  + CASE WHEN least(l_shipdate, o_orderdate) < TIMESTAMP '1995-01-01' THEN 32 ELSE 0 END AS INTEGER) AS flags FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def dat2_date_flags(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    none = F.lit(None).cast("timestamp")
    ship, ordered = F.col("l_shipdate").cast("timestamp"), F.col("o_orderdate").cast("timestamp")
    flags = D.date_flags(ship, ordered, none, none, ship, F.array().cast("array<timestamp>"), F.lit("1998-06-01 00:00:00").cast("timestamp"))
    return li.select("l_orderkey", "l_linenumber", flags.alias("flags"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%d %H:%M:%S') AS back FROM events")
def dat3_milliseconds(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", ms.alias("ms"), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss").alias("back"))


@query("""SELECT event_id, ts >= TIMESTAMP '2024-01-15 00:00:00' AS in_utc, epoch_us(ts) // 1000 >= epoch_ms(TIMESTAMP '2024-01-14 23:00:00') AS in_paris, epoch_us(ts) // 1000 >= epoch_ms(TIMESTAMP '2024-01-15 05:00:00') AS in_new_york FROM events""")
def dat4_day_bounds(spark, sf_dir):
    day = datetime(2024, 1, 15).date()
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    own = [(ms >= D.day_start_ms(day, z)).alias(n) for n, z in (("in_utc", "UTC"), ("in_paris", "Europe/Paris"), ("in_new_york", "America/New_York"))]
    return table(spark, sf_dir, "events").select("event_id", *own)


# --- validation -------------------------------------------------------------------------------------------------

#: German account numbers; 131400 are the letters DE and two zeros, as numbers. By turns the right check digits, others, and a digit short.
_ACCOUNT = "'37040044' || lpad(CAST(c_custkey % 1000000 AS STRING), 10, '0')"
_REST = f"CAST({_ACCOUNT} || '131400' AS DECIMAL(38, 0)) % 97"
_CHECK = f"lpad(CAST(98 - {_REST} AS STRING), 2, '0')"
_IBANS = by_key(KEY, f"'de' || {_CHECK} || ' ' || {_ACCOUNT}", f"'DE' || lpad(CAST((99 - {_REST}) % 97 AS STRING), 2, '0') || {_ACCOUNT}", f"'DE' || {_CHECK} || substr({_ACCOUNT}, 2)", "NULL")


@query(f"""SELECT c_custkey AS k, {by_key(KEY, "true", "false", "false", "false")} AS ok FROM customer""")
def val1_iban(spark, sf_dir):
    return customers(spark, sf_dir, value=_IBANS).select("k", S.is_iban(F.col("value")).alias("ok"))


_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INTEGER) WHEN CAST(d[i] AS INTEGER) > 4 THEN 2 * CAST(d[i] AS INTEGER) - 9 ELSE 2 * CAST(d[i] AS INTEGER) END)) % 10 = 0"


@query(f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b\\d{{16}}\\b')) AS d FROM documents)
  SELECT doc_id, d, {_LUHN} AND (d[1] = '4' OR d[1:2] BETWEEN '51' AND '55' OR d[1:4] BETWEEN '2221' AND '2720' OR d[1:4] = '6011' OR d[1:2] = '65' OR d[1:3] BETWEEN '644' AND '649' OR d[1:3] BETWEEN '300' AND '305'
  OR d[1:2] IN ('36', '38', '39', '62') OR d[1:4] BETWEEN '3528' AND '3589') AND NOT regexp_matches(d, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') AS ok FROM r""")
def val2_card(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b\d{16}\b"), F.lit(0))).alias("d"))
    return runs.select("doc_id", "d", S.is_card(F.col("d")).alias("ok"))


#: Numbers of persons born in 1985, by turns with the right key, written apart, with a wrong key, in Corsica (2A counts as 19), too short.
_NIRS = by_key(KEY, "n || lpad(CAST(97 - CAST(n AS BIGINT) % 97 AS STRING), 2, '0')", "substr(n, 1, 1) || ' ' || substr(n, 2, 6) || '-' || substr(n, 8) || ' ' || lpad(CAST(97 - CAST(n AS BIGINT) % 97 AS STRING), 2, '0')",
               "n || lpad(CAST((98 - CAST(n AS BIGINT) % 97) % 97 AS STRING), 2, '0')", "'185052A' || substr(n, 8) || lpad(CAST(97 - CAST('1850519' || substr(n, 8) AS BIGINT) % 97 AS STRING), 2, '0')", "substr(n, 1, 13)")


@query(f"""SELECT c_custkey AS k, {by_key(KEY, "true", "true", "false", "true", "false")} AS ok FROM customer""")
def val3_nir(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", F.expr("'1850578' || lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0') AS n"))
    return own.select(F.col("c_custkey").alias("k"), S.is_nir(F.expr(_NIRS)).alias("ok"))


@query()
def val4_sensitive_scan(spark, sf_dir):
    return S.scan(fixture_messages(spark, sf_dir).select("id", F.col("body").alias("text")))


@query(f"WITH {MSG} SELECT id, substr(body, 11, 7) AS shown FROM msg")
def val5_reveal(spark, sf_dir):
    return fixture_messages(spark, sf_dir).select("id", S.reveal(F.col("body"), F.lit(10), F.lit(7)).alias("shown"))


@query("SELECT page_id, sha256(html) AS hash FROM pages")
def hsh1_attachment_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("hash"))
