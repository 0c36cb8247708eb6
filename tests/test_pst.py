import random
from datetime import UTC, datetime

import pytest
from mailquarry.extract.limits import Encrypted
from mailquarry.extract.pst import Store
from mailquarry.sinks.pstfile import Box, Mail, store, write_store
from mailquarry.sources import pst, storefile

T = datetime(2025, 10, 7, 8, tzinfo=UTC)
TABLE = bytes(random.Random(1).sample(range(256), 256))


def tree(n=3):
    inner = Mail({0x0037: "Inner", 0x1000: "deep body"}, [], [({0x3707: "leaf.txt", 0x3701: b"leaf"}, None)])
    big = Mail({0x0037: "\x01\x04RE: Objet", 0x0042: "Ann", 0x0C1F: "ann@x.fr", 0x1000: "corps é " * 5000, 0x0E06: T, 0x0E07: 1, 0x0071: bytes(range(30)), 0x0E08: 77, 0x001A: "IPM.Note", 0x1035: "<id@x>"},
               [{0x0C15: 1, 0x3001: "Bob", 0x39FE: "bob@y.fr"}, {0x0C15: 3, 0x3001: "Eve"}], [({0x3707: "a.bin", 0x3701: bytes(20000)}, None), ({0x3707: "in.msg"}, inner)])
    return [Box("Inbox", [big] + [Mail({0x0037: f"m{k}", 0x1000: f"b{k}", 0x0E06: T}) for k in range(n)], [Box("A/B", [Mail({0x0037: "sub"})])]), Box("Sent")]


@pytest.mark.parametrize("table", [None, TABLE])
@pytest.mark.parametrize("n", [3, 1200])
def test_store(table, n):
    data = store(tree(n), table)
    s = Store(data, table)
    folders = list(s.folders())
    assert [(f.path, f.depth) for f in folders] == [("Inbox", 0), ("Inbox/A∕B", 1), ("Sent", 0)]
    listed = s.listing(folders[0].nid)
    assert [r.clean(0x0037) for _, r in listed] == ["RE: Objet"] + [f"m{k}" for k in range(n)]
    assert listed[0][1].number(0x0E08) == 77 and listed[0][1].time(0x0E06) == T and listed[1][1].number(0x0E08) is None
    m = s.message(listed[0][0])
    assert (m.subject, m.sender_email, m.date, m.is_read, m.message_id) == ("RE: Objet", "ann@x.fr", T, True, "<id@x>") and m.body == "corps é " * 5000
    assert [(r.kind, r.name, r.email) for r in m.recipients] == [(1, "Bob", "bob@y.fr"), (3, "Eve", None)]
    assert [(a.name, len(a.data or b"")) for a in m.attachments] == [("a.bin", 20000), ("in.msg", 0)]
    inner = m.attachments[1].message
    assert (inner.subject, inner.body, [(a.name, a.data) for a in inner.attachments]) == ("Inner", "deep body", [("leaf.txt", b"leaf")])
    assert s.message(listed[-1][0]).body == f"b{n - 1}" and s.listing(folders[2].nid) == []


def test_refused():
    with pytest.raises(Encrypted):
        list(Store(store(tree(), TABLE)).folders())
    with pytest.raises(ValueError):
        Store(b"no store")
    old = bytearray(store(tree()))
    old[10] = 14
    with pytest.raises(ValueError):
        Store(bytes(old))


def test_rows(spark):
    files = spark.createDataFrame([("a.pst", bytearray(store(tree()))), ("bad.pst", bytearray(b"x")), ("none.pst", None)], "path string, content binary")
    folders = pst.read_folders(files).collect()
    assert [(r.path, r.error is None) for r in folders if r.file_path == "a.pst"] == [("Inbox", True), ("Inbox/A∕B", True), ("Sent", True)]
    assert {r.file_path for r in folders if r.error} == {"bad.pst", "none.pst"}
    listing = [r for r in pst.list_messages(files).collect() if not r.error]
    assert len(listing) == 5 and {r.folder for r in listing} == {"Inbox", "Inbox/A∕B"} and listing[0].is_read and not listing[0].has_att
    messages = [r for r in pst.read_messages(files).collect() if not r.error]
    assert [r.subject for r in messages] == ["RE: Objet", "m0", "m1", "m2", "sub"] and [a.idx_path for a in messages[0].attachments] == ["0", "1", "1/0"]


class Counting:
    """A store in memory that counts what is read."""

    def __init__(self, data):
        self.data, self.sizes = data, []

    def read(self, at, size):
        self.sizes.append(size)
        return self.data[at : at + size]


def test_only_what_is_asked_for_is_read():
    fat = Mail({0x0037: "fat", 0x1000: "b" * 400_000}, [], [({0x3707: "a.bin", 0x3701: bytes(900_000)}, None)])
    source = Counting(store([Box("In", [fat] + [Mail({0x0037: f"m{k}", 0x1000: "x" * 3000}) for k in range(3000)])]))
    s = Store(source)
    first = next(nid for nid, _ in s.scan() if nid & 0x1F == 4)
    source.sizes.clear()
    assert s.message(first, want=frozenset()).subject == "fat" and sum(source.sizes) < 30_000
    assert s.message(first, want=frozenset({"recipients"})).attachments == [] and sum(source.sizes) < 30_000
    m = s.message(first, want=frozenset({"body"}))
    assert len(m.body) == 400_000 and m.attachments[0].data is None and sum(source.sizes) < 900_000
    assert len(s.message(first).attachments[0].data) == 900_000
    assert sum(source.sizes) < 0.2 * len(source.data)


def test_spans_cover_every_node_once():
    s = Store(store(tree(4000)))
    whole = list(s.scan())
    assert len(whole) > 4000
    for nodes in (1, 10, 400, 10**9):
        spans = s.spans(nodes)
        assert [x for low, high, _ in spans for x in s.scan(low, high)] == whole
        assert nodes < 10**9 or len(spans) == 1
    assert len(s.spans(400)) >= 10
    known = {}
    folders = {s.path_of(up, known) for nid, up in whole if nid & 0x1F == 4}
    assert folders == {"Inbox", "Inbox/A∕B"}


def test_listing_in_slices():
    s = Store(store(tree(3000)))
    inbox = next(s.folders()).nid
    per = s.contents(inbox)
    assert sum(per) == 3001 and len(per) > 3
    sliced = [(nid, row.clean(0x0037)) for k in range(len(per)) for nid, row in s.rows(inbox, k, k + 1)]
    assert sliced == [(nid, row.clean(0x0037)) for nid, row in s.listing(inbox)]


def test_data_source(spark, tmp_path):
    """A store of over 2 GB (most of it a hole), an encoded one and damaged ones, each read by several tasks."""
    folder = tmp_path / "all stores"
    (folder / "below").mkdir(parents=True)
    write_store(f"{folder}/big.pst", tree(900), gap=3 << 30)
    write_store(f"{folder}/below/small.PST", tree(2))
    (folder / "bad.pst").write_bytes(b"no store")
    (folder / "cut.ost").write_bytes(store(tree(5))[:3000])
    (folder / "note.txt").write_bytes(b"x")
    assert (folder / "big.pst").stat().st_size > 3 << 30
    for path in (str(folder), f"file://{folder}"):
        rows = storefile.read_stores(spark, path, nodes=200)
        assert rows.rdd.getNumPartitions() > 4
        got = rows.collect()
        assert {r.file_path.rsplit("/", 1)[1] for r in got if r.error} == {"bad.pst", "cut.ost"}
        big = [r for r in got if "/big.pst#" in r.file_path]
        assert sorted(r.subject for r in big) == sorted(["RE: Objet", "sub", *(f"m{k}" for k in range(900))])
        assert {r.folder for r in big} == {"Inbox", "Inbox/A∕B"} and next(r for r in big if r.subject == "RE: Objet").body.startswith("corps é ")
        assert len([r for r in got if "small.PST" in r.file_path]) == 4
    listed = storefile.read_stores(spark, f"{folder}/big.pst", "listing", "nid long, folder string, subject string", nodes=100)
    assert listed.rdd.getNumPartitions() > 4
    assert sorted(r.subject for r in listed.collect()) == sorted(r.subject for r in big)
    assert [r.path for r in storefile.read_stores(spark, f"{folder}/big.pst", "folders").collect()] == ["Inbox", "Inbox/A∕B", "Sent"]
    with pytest.raises(Exception, match="rows must be one of"):
        storefile.read_stores(spark, str(folder), "nothing", "x int").collect()


def test_encoded_data_source(spark, tmp_path):
    write_store(f"{tmp_path}/coded.pst", tree(300), TABLE)
    got = storefile.read_stores(spark, f"{tmp_path}/coded.pst", columns="subject string, body string", table=TABLE, nodes=100)
    assert got.rdd.getNumPartitions() > 1 and len([r for r in got.collect() if r.body]) == 301
    refused = storefile.read_stores(spark, f"{tmp_path}/coded.pst").collect()
    assert refused and all("Encrypted" in r.error for r in refused)
    with pytest.raises(ValueError, match="each of 256 bytes"):
        Store(store(tree()), bytes(256))
