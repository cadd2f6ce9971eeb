"""Headers, dates, tiers, mailboxes and MIME bodies."""

import mailbox
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from tripledger.functions import mail as M
from tripledger.functions.html import html_to_text
from tripledger.functions.mime import settled, text_parts
from tripledger.operators.extraction import booking_mails, classified, readable
from tripledger.sources.mailbox import scan_headers, scan_messages, with_bodies

DATES = [
    "Tue, 5 Mar 2024 08:15:00 -0700", "5 Mar 2024 08:15 +0530", "Tue, 05 Mar 2024 08:15:59 GMT", "1 Jan 99 00:00:00 EST",
    "1 January 2001 10:00:00 +0000 (UTC)", "31 Dec 2023 23:59:59 -0000", "31 Dec 2023 23:59:59", "30 Feb 2023 10:00:00 +0000",
    "not a date", "  padded  ", "", "1 Feb 2023 25:00:00 +0000", "Mon, 1 Foo 2023 10:00:00 +0000",
]


def _expected(text):
    if not text.strip():
        return None
    try:
        return parsedate_to_datetime(text).isoformat()
    except Exception:
        return text.strip()


def test_mail_dates(spark):
    df = spark.createDataFrame([(d,) for d in DATES], "d string")
    found = {r["d"]: r["x"] for r in df.select("d", M.mail_date(F.col("d")).alias("x")).collect()}
    assert found == {d: _expected(d) for d in DATES}


def test_sender_domain(spark):
    rows = {
        'A <a@Ex.COM>': "ex.com", '"x@y.com via" <r@delta.com>': "y.com", " No At ": "no at", "": "",
    }
    df = spark.createDataFrame([(k,) for k in rows], "f string")
    assert {r[0]: r[1] for r in df.select("f", M.sender_domain(F.col("f"))).collect()} == rows


@pytest.mark.parametrize(
    "sender, subject, expected",
    [
        ("a@delta.com", "hi", 1), ("a@ifly.alaskaair.com", "hi", 1), ("a@naacp.org", "hi", 1),
        ("a@expedia.com", "hi", None), ("a@expedia.com", "Your Itinerary", 2), ("a@mail.expedia.co", "United receipt", 2),
        ("a@mail.expedia.co", "United seats", None), ("a@mail.kayak.net", "hi", 2), ("a@google.com", "hi", 2),
        ("a@mail.google.com", "hi", None), ("a@example.org", "Delta receipt", 1), ("a@example.org", "receipt", None),
        ("a@example.org", "Delta", None),
    ],
)
def test_tier(spark, sender, subject, expected):
    df = spark.createDataFrame([(sender, subject)], "from_hdr string, subject string")
    assert classified(df).first()["extraction_tier"] == expected


def test_work_mail_and_short_body(spark):
    rows = [
        (1, "sprint standup jira in one body"), (2, "sprint standup, seat and passenger too"), (3, "too short"),
        (4, "OKR OKR OKR and nothing else at all"),
    ]
    df = spark.createDataFrame(rows, "id int, body string").withColumns(
        {"from_hdr": F.lit("a@expedia.com"), "subject": F.lit("receipt")}
    )
    assert sorted(r["id"] for r in readable(booking_mails(df)).collect()) == [2, 4]


MBOX = (
    "From one Mon Jan  1 00:00:00 2024\nFrom: A <a@delta.com>\nsubject: first\n folded line\nSubject: second\n"
    "Date: 1 Jan 2024 00:00:00 +0000\n\nplain body\n\nSubject: not a header\n>From quoted\n\n"
    "From two Mon Jan  1 00:00:00 2024\nFrom: b@united.com\nSubject: =?utf-8?q?caf=C3=A9?=\n"
    'Content-Type: multipart/mixed; boundary="x"\n\npreamble\n--x\nContent-Type: text/plain; charset=iso-8859-1\n'
    "Content-Transfer-Encoding: quoted-printable\n\ncaf=E9 one\n--x\nContent-Type: text/html\n\n<p>never</p>\n"
    "--x\nContent-Type: text/plain\n\ntwo\n--x\nContent-Type: text/plain\nContent-Disposition: ATTACHMENT\n\nno\n--x--\n\n"
    "From three Mon Jan  1 00:00:00 2024\nFrom: c@aa.com\nContent-Type: text/html; charset=utf-8\n\n"
    "<style>p{}</style><p>Tom &amp; J&eacute;r&#244;me</p><td>a</td>b<br>c<br/>d\n\n"
    "From four Mon Jan  1 00:00:00 2024\nFrom: d@aa.com\nContent-Type: text/plain; charset=latin-1\n\nnaïve latin body here\n\n"
    "From five Mon Jan  1 00:00:00 2024\nFrom: e@aa.com\nContent-Type: application/pdf\n\nraw payload\n\n"
    "From six Mon Jan  1 00:00:00 2024\n\nbody without headers\n\nsecond paragraph\n"
)


@pytest.fixture(scope="module")
def box(tmp_path_factory):
    path = tmp_path_factory.mktemp("mail") / "gmail-sent.mbox"
    path.write_bytes(MBOX.encode("latin-1"))
    return str(path)


def test_scan_equals_standard_mailbox(spark, box):
    found = scan_headers(spark, box).collect()
    expected = [tuple(str(m.get(h, "")) for h in ("From", "Subject", "Date")) for m in mailbox.mbox(box)]
    assert sorted((r["from_hdr"], r["subject"], r["date_hdr"]) for r in found) == sorted(expected)
    assert {r["source_file"] for r in found} == {"gmail-sent.mbox"}


def test_bodies(spark, box):
    found = {r["from_hdr"]: r for r in with_bodies(scan_messages(spark, box)).collect()}
    text = {k: r["body"].strip() for k, r in found.items()}
    assert text["A <a@delta.com>"] == "plain body\n\nSubject: not a header\n>From quoted"
    assert text["b@united.com"] == "café one\ntwo"
    assert text["c@aa.com"] == "Tom & Jérôme ab c d".replace("b c d", "bc d")
    assert text["d@aa.com"] == "naïve latin body here"
    assert text["e@aa.com"] == "raw payload"
    assert text[""] == "body without headers\n\nsecond paragraph"
    assert {r["error"] for r in found.values()} == {None}


def test_bad_mail_is_reported_not_fatal(spark):
    row = "headers string, body_raw string, message binary, source_file string"
    head = "Content-Type: text/plain; charset=no-such-set"
    df = spark.createDataFrame([(head, "x", f"{head}\n\nhello".encode(), "f")], row)
    found = with_bodies(df).first()
    assert found["body"] is None and found["error"].startswith("LookupError")


def test_scan_splits_files(spark, tmp_path):
    many = "".join(f"From x\nSubject: s{i}\n\nbody {i} {'y' * 200}\n\n" for i in range(2000))
    (tmp_path / "big.mbox").write_text(many)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = scan_headers(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 8
        assert sorted(r["subject"] for r in df.collect()) == sorted(f"s{i}" for i in range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_html(spark):
    pages = [
        "<html><head><script>var a = '<p>';</script></head><p>one</p><div>two</div><!-- no <b>x</b> -->three</html>",
        "<br>a<br/>b<td>c</td>d &lt;tag&gt; &amp;lt; &quot;q&quot;",
    ]
    df = spark.createDataFrame([(p,) for p in pages], "h string")
    assert [r[0] for r in df.select(html_to_text(F.col("h"))).collect()] == ["one two three", "a bcd <tag> &lt; \"q\""]
    assert settled("&lt;b&gt; &amp;amp; &eacute;&#8364;&unknown; a&b") == "&lt;b&gt; &amp;amp; é€&unknown; a&b"


def test_multipart_without_text_is_blank():
    assert text_parts(b'Content-Type: multipart/mixed; boundary="x"\n\n--x\nContent-Type: image/png\n\nzz\n--x--\n') == []
