from datetime import UTC, datetime

import duckdb

from mailquarry.operators import store
from mailquarry.sinks.csv import export_results
from mailquarry.sinks.eml import eml_bytes, write_eml
from mailquarry.sources import discovery, msg
from mailquarry.sources.case import MESSAGES, TABLES
from mailquarry.streaming.ingest import ingest, ingested
from mailquarry.sinks.msgfile import compound, message_tree


def write(folder, name, subject, **more):
    values = {0x0037: subject, 0x0042: "Jean Martin", 0x0C1F: "jean@x.fr", 0x1000: f"corps {subject}", 0x1035: f"<{subject}@x>", 0x0E06: datetime(2025, 10, 7, tzinfo=UTC), **more}
    (folder / name).write_bytes(compound(message_tree(values, [(1, "Bob", "b@y.fr")], [("n.txt", b"joint")])))


def test_message_files_as_rows(spark, tmp_path):
    write(tmp_path, "1.msg", "un")
    write(tmp_path, "2.MSG", "deux")
    (tmp_path / "bad.msg").write_bytes(b"no message")
    (tmp_path / "note.txt").write_bytes(b"x")
    rows = {r.file_path.rsplit("/", 1)[1]: r for r in msg.read_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"1.msg", "2.MSG", "bad.msg"}
    assert rows["bad.msg"].error and rows["bad.msg"].subject is None
    r = rows["1.msg"]
    assert (r.subject, r.sender_email, r.message_id, r.date_ms, r.error) == ("un", "jean@x.fr", "<un@x>", 1759795200000, None)
    assert [(x.kind, x.email) for x in r.recipients] == [(1, "b@y.fr")] and [(a.idx_path, a.name) for a in r.attachments] == [("0", "n.txt")]
    assert msg.attachment_rows(msg.read_folder(spark, str(tmp_path))).filter("name = 'n.txt'").count() == 2


def test_ingest_resumes(spark, tmp_path):
    inbox, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    inbox.mkdir()
    for k in range(7):
        write(inbox, f"{k}.msg", f"m{k}")
    assert ingest(spark, str(inbox), target, mark, files_per_batch=3) == 3
    assert ingest(spark, str(inbox), target, mark, files_per_batch=3) == 0
    write(inbox, "new.msg", "m7")
    assert ingest(spark, str(inbox), target, mark) == 1
    subjects = [r.subject for r in ingested(spark, target).select("subject").collect()]
    assert sorted(subjects) == [f"m{k}" for k in range(8)]


def test_discovery_and_relocation(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "a.pst").write_bytes(b"12345")
    (tmp_path / "new" / "b.pst").write_bytes(b"1")
    assert {r.path.rsplit("/", 1)[1]: r.size for r in discovery.files_below(spark, str(tmp_path / "new")).collect()} == {"a.pst": 5, "b.pst": 1}
    sources = spark.createDataFrame([(1, f"{tmp_path}/old/a.pst", 5), (2, f"{tmp_path}/OLD/b.pst", 9), (3, f"{tmp_path}/old/c.pst", 1), (4, "/else/d.pst", 1)], "id long, path string, size long")
    got = {r.id: r.outcome for r in discovery.relocate(sources, discovery.files_below(spark, str(tmp_path / "new")), f"{tmp_path}/old", f"{tmp_path}/new").collect()}
    assert got == {1: "relocated", 2: "size_mismatch", 3: "not_found"}
    assert discovery.infer_relocation("/old/case/x/a.pst", "/new/place/x/a.pst") == ("/old/case", "/new/place")


def test_csv_export(spark, tmp_path):
    row = {"date": 0, "sender_name": "=cmd", "subject": 'a"b\nc', "id": 7, "size": 5, "att_count": 0, "flag_status": 2, "importance": 1, "thread_count": 3, "thread_id": 7, "spoof_flags": 17, "date_flags": 0, "sens_flags": 5, "is_read": True}
    df = spark.createDataFrame([tuple(row.get(f.name) for f in MESSAGES.fields)], MESSAGES)
    from pyspark.sql import functions as F

    df = df.withColumn("mailbox", F.lit("box")).withColumn("folder_path", F.lit("a/b")).withColumn("source_name", F.lit("s"))
    export_results(df, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    data = part.read_bytes()
    head, line = data.decode("utf-8").splitlines()
    assert data.startswith(b"\xef\xbb\xbfDate;") and head.count(";") == line.count(";") == 31
    cells = line.split(";")
    assert cells[:3] == ["1970-01-01 00:00:00", '"\'=cmd"', ""] and cells[4] == '"a""b c"' and cells[18:21] == ["lu", "à suivre", "normale"]
    assert cells[27] == '"Reply-To différent, Authentification en échec"' and cells[29] == '"IBAN, N° de sécurité sociale"' and cells[30:] == ["7", "3"]


def test_message_files_are_made_and_read_in_one_step(spark):
    """Message files that are made for their reader pass through no second Python process."""
    from mailquarry.plans.queries_formats import making
    from mailquarry.plans.queries_formats import msg as write_msg

    made = making(".msg", lambda i, t: b"no message" if i == 7 else write_msg(i, t))
    docs = spark.createDataFrame([(i, None if i == 3 else f"text {i}") for i in range(30)], "doc_id long, text string")
    df = msg.parse_files(docs, lambda batches: (b.select(["name", "data"]) for b in made(batches)))
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = {r.file_path: r for r in df.collect()}
    assert set(rows) == {f"{i}.msg" for i in range(30)} and rows["7.msg"].error and rows["7.msg"].attachments is None
    for i in set(range(30)) - {7}:
        r = rows[f"{i}.msg"]
        assert r.subject == f"subject {i}" and [(a.idx_path, a.embedded) for a in r.attachments] == [("0", False), ("1", True), ("1/0", False)]
        assert bytes(r.attachments[0].data) == (b"" if i == 3 else f"text {i}".encode()) and r.body == ("" if i == 3 else f"text {i}\n") + f"inner {i}\n"


def test_message_files_have_their_whole_texts(spark, tmp_path):
    """Bodies, references and embedded messages of any length and number, in files whose table of sectors goes beyond the header."""
    from mailquarry.plans.catalogue import ORACLES, QUERIES

    texts = ["x" * 1_000_000 + "end", "é😀" * 700_000 + "end", "a b\n" * 3_000_000 + "end", "short", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["src6_message_files"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    same = [a == b for a, b in zip(got, sorted(db.sql(ORACLES["src6_message_files"]).fetchall()), strict=True)]
    assert same == [True] * 5

    refs = " ".join(f"<{k}@x>" for k in range(2000))
    inner = [(f"{k}.msg", message_tree({0x1000: f"inner {k}"}, [], [], 24)) for k in range(30)]
    row = msg.message_row("m", compound(message_tree({0x1000: "outer", 0x1039: refs}, [], inner)))
    assert row["refs"] == refs and row["body"] == "outer\n" + "\n".join(f"\ninner {k}" for k in range(30))


def test_batches_of_messages_end_by_size():
    import pyarrow as pa

    schema = pa.schema([("file_path", pa.string()), ("body", pa.string())])
    rows = [{"file_path": str(k), "body": "x" * (3_000_000 if k in (5, 6) else 1), "attachments": [{"data": bytes(3_000_000)}] if k == 8 else []} for k in range(520)] + [{"file_path": "520", "error": "e"}]
    batches = list(msg.arrow_batches(iter(rows), schema))
    assert [b.num_rows for b in batches] == [6, 2, 250, 250, 13]
    assert [p for b in batches for p in b["file_path"].to_pylist()] == [str(k) for k in range(521)]


def test_eml(spark, tmp_path):
    from email import message_from_bytes, policy

    inner = eml_bytes({"subject": "dedans", "body": "x"})
    data = eml_bytes({"subject": "é\nx", "sender_name": 'A "B"', "sender_email": "a@b.fr", "date_ms": 0, "body": "texte", "html": "<p>t</p>", "attachments": [{"name": "n.bin", "data": b"\0\1"}, {"name": "m.eml", "data": inner}]})
    m = message_from_bytes(data, policy=policy.default)
    assert m["Subject"] == "é x" and m["From"].addresses[0].addr_spec == "a@b.fr"
    assert [a.get_filename() for a in m.iter_attachments()] == ["n.bin", "m.eml"]
    rows = spark.createDataFrame([(1, "a", "b"), (2, None, None)], "id long, subject string, body string")
    out = write_eml(rows, str(tmp_path / "eml")).collect()
    assert sorted(r.id for r in out) == [1, 2] and (tmp_path / "eml" / "1.eml").stat().st_size == next(r.bytes for r in out if r.id == 1)


def test_merge_and_maintenance(spark):
    old = spark.createDataFrame([(1, "s1", 10, 40, None), (2, "s2", 20, 1, None), (3, "s3", 30, 0, None)], "id long, subject string, size long, spoof_flags int, error string")
    new = spark.createDataFrame([(1, None, 0, 3, None), (2, "n2", 5, 8, "bad")], "id long, subject string, size long, spoof_flags int, error string")
    got = {r.id: tuple(r)[1:] for r in store.merge_messages(old, new).collect()}
    assert got == {1: ("s1", 10, 43, None), 2: ("s2", 20, 1, "bad"), 3: ("s3", 30, 0, None)}
    assert len(MESSAGES.fields) == 46 and set(TABLES) >= {"messages", "attachments", "folders", "sources", "mailboxes", "sensitive", "lookalikes", "meta"}
    small = spark.createDataFrame([(1, "x")], "id long, subject string")
    assert [f.name for f in store.migrate(small, 1).schema] == [f.name for f in MESSAGES.fields]
    import pytest

    with pytest.raises(ValueError):
        store.migrate(small, 4)
    boxes = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "id long, name string")
    assert {r.id: r.into for r in store.merge_mailboxes(boxes).collect()} == {1: 1, 2: 1, 3: 3}
    assert [r.id for r in store.prune_mailboxes(boxes, spark.createDataFrame([(9, 3)], "id long, mailbox_id long")).collect()] == [3]
