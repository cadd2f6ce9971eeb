"""Files in, files out: the steps end to end over a small corpus folder."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from tests.test_mail import MBOX
from tripledger.operators.extraction import CANDIDATE_SCHEMA
from tripledger.plans import fixtures as D
from tripledger.plans import runs
from tripledger.sources.files import existing, list_files
from tripledger.sources.tables import csv_profile, decimals_to_double, read_csv_text
from tripledger.sources.writers import register_table, to_schema, write_candidates

CHAT = 'who,text\n"me","flight to\nthe ""gate"" now"\n\n"you","nothing"\n'
TRIP = (
    "From x\nFrom: trips@kayak.com\nSubject: trip\nDate: 1 Mar 2024 10:00:00 +0000\n\n"
    "Confirmation code: QWE123. SEA-SFO on 2024-03-05 and 2024-03-09, AS 12, $80\n\n"
)


def _corpus(folder: Path) -> str:
    (folder / "deep").mkdir(parents=True)
    (folder / "gmail-sent.mbox").write_bytes(MBOX.encode("latin-1"))
    (folder / "deep" / "work-sent.mbox").write_text(TRIP + TRIP + "From y\nFrom: a@example.org\nSubject: hi\n\nno\n")
    (folder / "imessage.csv").write_bytes(CHAT.encode() + b'"bad \xff byte","plane"\n')
    (folder / "contacts.csv").write_text("name,phone\na,1\nb,2\n")
    (folder / "old.TAR.GZ").write_text("x")
    return str(folder)


def _lines(path):
    return [json.loads(line) for part in Path(path).glob("part-*") for line in part.read_text().splitlines()]


def test_listing_and_missing_files(spark, tmp_path):
    root = _corpus(tmp_path / "c")
    found = {r["path"].rsplit("/", 1)[1]: (r["format"], r["size_bytes"]) for r in list_files(spark, root).collect()}
    assert found["old.TAR.GZ"] == ("gzip", 1) and found["work-sent.mbox"][0] == "mbox" and len(found) == 5
    paths = existing(spark, root, ["work-sent.mbox", "workspace-sent.mbox"])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["work-sent.mbox"]


def test_csv(spark, tmp_path):
    root = _corpus(tmp_path / "c")
    chat = read_csv_text(spark, f"{root}/imessage.csv")
    assert [f.dataType.simpleString() for f in chat.schema] == ["string", "string"]
    rows = [tuple(r) for r in chat.collect()]
    assert ("me", 'flight to\nthe "gate" now') in rows and len(rows) == 3
    assert tuple(csv_profile(read_csv_text(spark, f"{root}/contacts.csv")).first()) == (["name", "phone"], 2)


def test_inventory_run(spark, tmp_path):
    root, report = _corpus(tmp_path / "c"), str(tmp_path / "report")
    runs.inventory(spark, root, report, "now", "imessage.csv", "contacts.csv")
    files = {r["path"].rsplit("/", 1)[1]: r for r in _lines(f"{report}/file_inventory")}
    assert files["gmail-sent.mbox"]["total_messages"] == 6 and files["work-sent.mbox"]["relevant_count"] == 2
    assert files["imessage.csv"]["total_messages"] == 3 and files["contacts.csv"]["total_messages"] == 2
    assert files["old.TAR.GZ"]["total_messages"] is None
    words = {r["keyword"]: r["n"] for r in _lines(f"{report}/chat_analysis")}
    assert (words["flight"], words["gate"], words["plane"], words["landed"]) == (1, 1, 1, 0)
    assert {r["sender_domain"]: r["mails"] for r in _lines(f"{report}/sender_pattern_catalog")}["kayak.com"] == 2


def test_extraction_run(spark, tmp_path):
    root, out, report = _corpus(tmp_path / "c"), str(tmp_path / "out"), str(tmp_path / "report")
    assert runs.extraction(spark, root, out, report, "now", ["gmail-sent.mbox", "work-sent.mbox", "absent.mbox"])
    rows = spark.read.parquet(out)
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in CANDIDATE_SCHEMA]
    legs = rows.where("source_file = 'work-sent.mbox'").collect()
    assert {(r["origin"], r["dest"], r["date_iso"][:10], r["confirmation_code"]) for r in legs} == {
        ("SEA", "SFO", "2024-03-05", "QWE123"), ("SFO", "SEA", "2024-03-09", "QWE123"),
    }
    stats = {r["source_file"]: r for r in _lines(f"{report}/files")}
    assert stats["work-sent.mbox"]["records_extracted"] == 4 and stats["work-sent.mbox"]["signal_emails"] == 2
    assert stats["work-sent.mbox"]["header_filtered"] == 1 and stats["gmail-sent.mbox"]["errors"] == 0
    (totals,) = _lines(f"{report}/totals")
    assert totals["total_emails"] == 9 and totals["records_extracted"] == sum(r["records_extracted"] for r in stats.values())
    (ids,) = _lines(f"{report}/ids")
    assert ids["duplicate_ids"] == ids["records"] - ids["unique_ids"] >= 2
    assert not runs.extraction(spark, root, str(tmp_path / "o2"), str(tmp_path / "r2"), "now", names=["none.mbox"])
    assert not (tmp_path / "o2").exists() and _lines(f"{tmp_path}/r2/ids")[0]["records"] == 0


def test_nothing_written_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], CANDIDATE_SCHEMA)
    assert write_candidates(none, str(tmp_path / "none")) is False
    assert not (tmp_path / "none").exists()
    partial = spark.createDataFrame([("a", "1.5")], "flight_id string, base_fare string")
    row = to_schema(partial, CANDIDATE_SCHEMA).first()
    assert row["base_fare"] == 1.5 and row["origin"] is None and len(row) == 29


def test_reconciliation_run_and_table(spark, sf_dir, tmp_path):
    register = D.register(spark, sf_dir)
    out, report = str(tmp_path / "out"), str(tmp_path / "report")
    stored = runs.reconciliation(D.booking_candidates(spark, sf_dir), register, out, report, "now")
    counts = {r["dedup_status"]: r["n"] for r in _lines(f"{report}/classification")}
    assert sum(counts.values()) == stored.count() == register.count()
    assert len(_lines(f"{report}/near_match_details")) == counts["near_match"]
    assert len(_lines(f"{report}/duplicate_details")) == counts["exact_duplicate"] > 20
    register_table(spark, "run_rows", out)
    try:
        assert spark.table("run_rows").count() == stored.count()
    finally:
        spark.sql("DROP TABLE run_rows")


def test_seeding_run(spark, sf_dir, tmp_path):
    check = runs.seeding(D.bookings(spark, sf_dir), "ord", str(tmp_path / "seed"), "now")
    assert check.first()["ok"]
    stored = decimals_to_double(spark.read.parquet(str(tmp_path / "seed")))
    assert dict(stored.dtypes)["total_paid"] == "double"
    assert stored.select("flight_id").distinct().count() == stored.count()


def test_files_of_one_name_stay_apart(spark, tmp_path):
    root = tmp_path / "c"
    for folder, mails in (("a b+c", 1), ("d", 3)):
        (root / folder).mkdir(parents=True)
        (root / folder / "All mail.mbox").write_text(TRIP * mails)
        (root / folder / "chat.csv").write_text("who,text\n" + "me,flight\n" * mails)
    report = str(tmp_path / "report")
    runs.inventory(spark, str(root), report, "now", "chat.csv", "none.csv")
    counts = {tuple(r["path"].rsplit("/", 2)[1:]): r["total_messages"] for r in _lines(f"{report}/file_inventory")}
    assert counts == {("a b+c", "All mail.mbox"): 1, ("d", "All mail.mbox"): 3, ("a b+c", "chat.csv"): 1, ("d", "chat.csv"): 3}
    words = _lines(f"{report}/chat_analysis")
    assert sorted(r["n"] for r in words if r["keyword"] == "flight") == [1, 3]
