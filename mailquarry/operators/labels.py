"""Labels, kinds and formats of result rows, and their CSV form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailquarry.functions import sensitive

#: Labels of the bits, in the order in which they are shown.
SPOOF_LABELS = [(1, "Reply-To différent"), (2, "Return-Path différent"), (4, "Nom affiché trompeur"), (32, "Nom d'un correspondant habituel"), (8, "Domaine ressemblant"), (16, "Authentification en échec")]
DATE_LABELS = [(1, "Reçu avant envoi"), (2, "Modifié avant création"), (64, "Modifié avant réception"), (4, "En-tête Date décalé"), (8, "Serveurs à rebours"), (16, "Date future"), (32, "Date avant 1995")]
SENSITIVE_LABELS = list(sensitive.LABELS.items())

#: Message classes by their beginnings, in order.
KINDS = [
    ("IPM.SCHEDULE.MEETING", "Réunion"),
    ("IPM.APPOINTMENT", "Rendez-vous"),
    ("IPM.CONTACT", "Contact"),
    ("IPM.DISTLIST", "Contact"),
    ("IPM.TASK", "Tâche"),
    ("IPM.STICKYNOTE", "Note"),
    ("IPM.ACTIVITY", "Journal"),
    ("REPORT.", "Accusé"),
]

#: Extensions that run code when opened.
DANGEROUS = """.exe .com .scr .pif .bat .cmd .ps1 .psm1 .vbs .vbe .js .jse .wsf .wsh .hta .msi .msp .lnk .reg .jar .cpl .dll .sys .inf .scf .url
.appx .msix .application .gadget .iso .img .vhd .vhdx .chm .docm .xlsm .pptm .xlam .settingcontent-ms .app .command .tool .terminal .pkg .mpkg .dmg
.scpt .scptd .applescript .workflow .webloc .inetloc .fileloc .dylib .kext .prefpane .plugin .mobileconfig .sh .bash .zsh .csh .ksh .run .desktop
.appimage .deb .rpm .so .py .pl .rb""".split()


def flag_labels(flags: Column, labels: list[tuple[int, str]]) -> Column:
    return F.concat_ws(", ", *(F.when(flags.bitwiseAND(bit) != 0, F.lit(text)) for bit, text in labels))


def item_kind(cls: Column) -> Column:
    c = F.upper(cls)
    out = F.when(F.coalesce(c, F.lit("")) == "", "Message")
    for start, kind in KINDS:
        out = out.when(F.startswith(c, F.lit(start)), kind)
    return out.when(F.contains(c, F.lit("SMIME")), "Chiffré").otherwise("Message")


def shown_sender(name: Column, email: Column) -> Column:
    """The name unless it is missing or empty."""
    return F.when(F.length(name) > 0, name).otherwise(email)


def recipient(name: Column, email: Column) -> Column:
    """'Name <address>', or just one if the other is missing or the same but for case."""
    n, e = F.coalesce(name, F.lit("")), F.coalesce(email, F.lit(""))
    return F.when(n == "", e).when((e == "") | (F.lower(n) == F.lower(e)), n).otherwise(F.concat(n, F.lit(" <"), e, F.lit(">")))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.[^./\\]+$", 0))


def is_dangerous(name: Column) -> Column:
    return extension(name).isin(DANGEROUS)


def size_text(b: Column) -> Column:
    """A size in o, Ko, Mo or Go; empty if it isn't positive."""
    short = lambda x, form: F.regexp_replace(F.regexp_replace(F.format_string(form, x), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    kb = b / 1024
    return (
        F.when(F.coalesce(b, F.lit(0)) <= 0, "")
        .when(b < 1024, F.concat(b.cast("string"), F.lit(" o")))
        .when(kb < 1024, F.concat(short(kb, "%.1f"), F.lit(" Ko")))
        .when(kb < 1024 * 1024, F.concat(short(kb / 1024, "%.1f"), F.lit(" Mo")))
        .otherwise(F.concat(short(kb / 1024 / 1024, "%.2f"), F.lit(" Go")))
    )


def file_name(c: Column) -> Column:
    """A name that every file system takes, at most 120 characters."""
    out = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f<>:\x22/\\|?*]", "_"))
    out = F.regexp_replace(F.substring(out, 1, 120), r"[. ]+$", "")
    return F.when(out == "", "message").otherwise(out)


# --- CSV --------------------------------------------------------------------------------------------------

#: Headings of the result export.
HEADINGS = (
    "Date;Expéditeur;Adresse expéditeur;Destinataires;Objet;Boîte;Dossier;Type;Taille (octets);Pièces jointes;Noms des pièces jointes;Doublon;Id interne;Date d'envoi;Cc;Cci;"
    "Message-ID;Conversation;Lu;Suivi;Importance;Fichier source;SPF;DKIM;DMARC;Reply-To;Return-Path;Indices d'usurpation;Anomalies de dates;Données sensibles;Fil;Messages du fil"
)
BOM = "﻿"


def csv_cell(c: Column) -> Column:
    """Quoted, in one line, and harmless for a spreadsheet: what would start a formula gets an apostrophe."""
    s = F.translate(c, "\r\n", "  ")
    s = F.when(F.rlike(s, F.lit(r"^[=+\-@\t]")), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def csv_quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(zone: str = "UTC") -> Column:
    """A result row as a line of the export."""
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    text = lambda name: csv_cell(F.col(name))
    time = lambda name: plain(F.date_format(F.from_utc_timestamp(F.timestamp_millis(F.col(name)), zone), "yyyy-MM-dd HH:mm:ss"))
    cells = [
        time("date"), text("sender_name"), text("sender_email"), text("to_text"), text("subject"), text("mailbox"), text("folder_path"), csv_cell(item_kind(F.col("msg_class"))),
        plain(F.col("size")), plain(F.col("att_count")), text("att_names"), F.when(F.col("dup_of").isNotNull(), "oui").otherwise(""), plain(F.col("id")), time("sent_date"), text("cc_text"),
        text("bcc_text"), text("message_id"), text("conversation_topic"), F.when(F.col("is_read"), "lu").when(~F.col("is_read"), "non lu").otherwise(""),
        F.when(F.col("flag_status") == 2, "à suivre").when(F.col("flag_status") == 1, "terminé").otherwise(""),
        F.when(F.col("importance") == 2, "haute").when(F.col("importance") == 0, "basse").otherwise("normale"), text("source_name"),
        plain(F.col("auth_spf")), plain(F.col("auth_dkim")), plain(F.col("auth_dmarc")), text("reply_to"), text("return_path"),
        csv_cell(flag_labels(F.col("spoof_flags"), SPOOF_LABELS)), csv_cell(flag_labels(F.col("date_flags"), DATE_LABELS)), csv_cell(flag_labels(F.col("sens_flags"), SENSITIVE_LABELS)),
        plain(F.col("thread_id")), F.when(F.col("thread_count") > 1, F.col("thread_count").cast("string")).otherwise(""),
    ]
    return F.concat_ws(";", *cells)
