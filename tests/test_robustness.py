"""Input that must not end a job, and sinks and corrections that must not lose or lock values."""

from datetime import datetime

from pyspark.sql import functions as F

from billspark.functions.markup import pieces, plain_text
from billspark.operators.links import _anchors
from billspark.operators.overrides import apply_overrides, checked_values
from billspark.sources.messages import parse_messages
from billspark.sources.tables import archive_ocr, read_archive, write_bills


def test_damaged_messages(spark):
    raw = [
        b"From: Jos\xe9 <a@b.cl>\r\nSubject: =?utf-8?B?A?=\r\nDate: Tue, 3 Feb 2026 01:00:00 +0200\r\n\r\nhola",
        b"From: =?nope?Q?a=E9?=\r\nDate: x\r\nContent-Type: text/html; charset=nope\r\n\r\n<![foo[<p>hola",
        b"",
        None,
    ]
    df = spark.createDataFrame([("m", i, c) for i, c in enumerate(raw)], "mailbox_id string, msg_seq long, content binary")
    rows = {r.msg_seq: r for r in parse_messages(df).collect()}
    assert rows[0].from_addr == "José <a@b.cl>" and rows[0].subject == "=?utf-8?B?A?="
    assert rows[0].received_ts == datetime(2026, 2, 2, 23, 0)
    assert rows[1].from_addr == "aé" and rows[1].received_ts is None and "hola" in rows[1].body
    assert rows[2].body == rows[3].body == ""
    assert all(r.parse_error is None for r in rows.values())


def test_markup_of_any_quality():
    for broken in ("<![foo[", "<a href='x", "<!--", "<script>", "</", "<" * 2000, '<a b="' * 500):
        assert all(kind in ("text", "open", "close") for kind, _, _ in pieces(broken))
    assert plain_text("a &amp;lt; b<p>c</p><!-- no --><br>d") == "a < b\nc\nd"


def test_labels_of_anchors():
    page = (
        '<td>before <a href="http://a">own</a> <a href="http://b"></a> after</td>'
        '<td>left <a href="http://c"></a></td><p><a href="http://d"></a><a href="http://e"><img alt="seen"></a>'
        '</p><iframe src="http://f"></iframe><a href="#" data-url=" http://g ">x</a>'
    )
    assert _anchors(page) == [
        ("http://a", "own", "link"),
        ("http://b", "after", "link"),
        ("http://c", "left", "link"),
        ("http://d", "", "link"),
        ("http://e", "seen", "link"),
        ("http://f", "", "embed"),
        ("http://g", "x", "link"),
    ]


def test_overrides_refuse_and_do_not_lock(spark):
    accounts = spark.createDataFrame([(1, "water")], "account_id long, service_type string")
    asked = [
        ([1], "folio", "00012345"), ([1], "total_amount", "12345678901234567"), ([1], "subtotal", "abc"),
        ([1], "nonsense", "1"), ([1, 2], "folio", "1"), ([3], "folio", "1"), ([1], "consumption", "12.50"),
    ]
    requests = spark.createDataFrame(
        [(t, a, None, v, datetime(2026, 1, 1)) for t, a, v in asked],
        "targets array<long>, attr string, suffix string, value string, ts timestamp",
    )
    checked = checked_values(requests, accounts)
    assert [r.reason for r in checked.collect()].count(None) == 3
    assert {r.reason for r in checked.collect()} == {
        None, "unreadable value", "unknown attribute", "not one account", "unknown account",
    }
    held = checked.filter("reason is null").drop("reason")
    raw = spark.createDataFrame([(1, "subtotal", "abc", datetime(2026, 1, 1))], held.schema)
    state = spark.createDataFrame([(1, "water", 100)], "account_id long, service_type string, subtotal long")
    row = apply_overrides(state, held.unionByName(raw)).first()
    assert (row.folio, row.total_amount, row.consumption, row.subtotal) == ("00012345", 12345678901234567, 12.5, 100)
    assert row.confidence.get("folio") == 100.0 and row.confidence.get("subtotal") != 100.0


def test_bills_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "bills")
    schema = "document_key string, service_type string, emission_date string, billing_period_start string, total_amount long"
    first = [("k", "gas", "01-02-2026", None, 1), ("k", "gas", "03-02-2026", None, 2)]
    write_bills(spark.createDataFrame(first, schema), path)
    write_bills(spark.createDataFrame([("k", "gas", "01-05-2026", None, 3), ("l", "gas", "01-05-2026", None, 4)], schema), path)
    stored = sorted((r.document_key, r.total_amount) for r in spark.read.parquet(path).collect())
    assert stored == [("k", 2), ("l", 4)]


def test_archive_keeps_other_mailboxes(spark, tmp_path):
    path = str(tmp_path / "archive")
    schema = "mailbox_id string, stem string, json string, mtime timestamp"
    archive_ocr(spark.createDataFrame([("m1", "s", "old", datetime(2026, 1, 1))], schema), path, "1")
    archive_ocr(spark.createDataFrame([("m2", "s", "x", datetime(2026, 1, 2)), ("m1", "s", "new", datetime(2026, 1, 3))], schema), path, "2")
    assert sorted((r.mailbox_id, r.json) for r in read_archive(spark, path).collect()) == [("m1", "new"), ("m2", "x")]
    since = F.lit(datetime(2026, 1, 3))
    assert [r.mailbox_id for r in read_archive(spark, path, since).collect()] == ["m1"]
