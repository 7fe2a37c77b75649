import csv
import datetime as dt
import glob
import gzip
import hashlib
import json

import pytest

from trafficloom.operators.categorize import CategoryRules
from trafficloom.operators.domains import domain_traffic
from trafficloom.operators.rollup import client_minute, domain_minute, minute_totals
from trafficloom.plans import archive, export, report
from trafficloom.schema import ANOMALY
from trafficloom.sources import dimensions

T0 = dt.datetime(2024, 5, 1, 12)
DAY = (dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 2))


@pytest.fixture
def events(make_events):
    return make_events(
        [
            {"id": 3 - i, "timestamp": T0 + dt.timedelta(minutes=i), "user": u, "branch": b, "url": 'http://x/?a="b",c'}
            for i, (u, b) in enumerate([("=cmd", "a"), ("bob", "b"), (None, "a")])
        ]
    )


def _csv(pattern, opener=open):
    found = []
    for path in sorted(glob.glob(pattern)):
        with opener(path, "rt", newline="") as file:
            found += list(csv.DictReader(file))
    return found


def test_csv_export_in_order_of_time_with_manifest(spark, events, tmp_path):
    out = str(tmp_path / "out")
    info = export.write_csv_with_manifest(export.export_rows(events, *DAY), out).first()
    found = _csv(f"{out}/part-*.csv")
    assert [r["id"] for r in found] == ["3", "2", "1"]
    assert [r["user"] for r in found] == ["'=cmd", "bob", ""]
    assert found[2]["url"] == 'http://x/?a="b",c'
    assert found[0]["timestamp"] == "2024-05-01T12:00:00.000000+00:00"
    assert list(found[0]) == export.resolve_columns()
    parts = {r.path.split("/")[-1]: (r.size_bytes, r.checksum_sha256) for r in export.manifest(spark, out).collect()}
    for path in glob.glob(f"{out}/part-*"):
        content = open(path, "rb").read()
        assert parts[path.split("/")[-1]] == (len(content), hashlib.sha256(content).hexdigest())
    assert (info.row_count, info.part_count) == (3, len(parts))
    assert info.size_bytes == sum(size for size, _ in parts.values())


def test_json_export_keeps_values(events, tmp_path):
    export.write_json(events, str(tmp_path / "out"), ["user", "id"])
    found = [json.loads(line) for p in sorted(glob.glob(f"{tmp_path}/out/part-*")) for line in open(p)]
    assert found == [{"user": "=cmd", "id": 3}, {"user": "bob", "id": 2}, {"user": None, "id": 1}]


def test_export_columns_are_checked():
    assert export.resolve_columns(["url", "id"]) == ["url", "id"]
    for bad in ([], ["id", "password"]):
        with pytest.raises(ValueError):
            export.resolve_columns(bad)


def test_recent_export_is_newest_first(events):
    assert [r.id for r in export.recent_rows(events, *DAY, limit=2).collect()] == [1, 2]


def test_archive_run_watermarks_and_pruning(spark, events, tmp_path):
    out, now = str(tmp_path / "archive"), T0 + dt.timedelta(days=10)
    branches = spark.createDataFrame([("a",), ("b",)], "branch string")
    runs = spark.createDataFrame([("a", T0 - dt.timedelta(days=1)), ("gone", T0)], "branch string, archived_until timestamp_ntz")
    assert archive.is_due(branches, runs, now).first().due
    after = archive.run_archive(events, branches, runs, now, out)
    # Branch a reaches back to its last run; branch b only takes the last week, which holds nothing.
    files = f"{out}/run_date=2024-05-11/archive_branch=*/*.csv.gz"
    assert sorted(r["id"] for r in _csv(files, gzip.open)) == ["1", "3"]
    assert {r.branch: r.archived_until for r in after.collect()} == {"a": now, "b": now, "gone": T0}
    assert not archive.is_due(branches, after, now).first().due
    assert archive.is_due(branches, after, now + dt.timedelta(days=7)).first().due
    archive.run_archive(events, branches, runs, now, out)
    assert len(_csv(files, gzip.open)) == 2
    assert archive.prune_archives(spark, out, 30, now) == []
    assert archive.prune_archives(spark, out, 30, now + dt.timedelta(days=31)) == ["2024-05-11"]


def test_watermark_merge_keeps_the_earlier(spark):
    runs = spark.createDataFrame([("a", T0), ("b", T0 + dt.timedelta(1)), ("c", T0)], "branch string, archived_until timestamp_ntz")
    got = {r.branch: r.archived_until for r in archive.merge_watermarks(runs, "b", "a").collect()}
    assert got == {"a": T0, "c": T0}


def test_overrides_round_trip_and_report_bad_rows(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("domain,category,note\n Slack.com ,gaming,x\n,news,\nbad.com,newz,\nslack.com,news,\n")
    applied, errors = dimensions.load_overrides(spark, str(path))
    assert [tuple(r) for r in applied.collect()] == [("slack.com", "news")]
    assert [tuple(r)[1:] for r in errors.orderBy("row_number").collect()] == [
        (2, None, "news", "missing_domain"), (3, "bad.com", "newz", "unknown_category"),
    ]
    current = spark.createDataFrame([("slack.com", "other"), ("a.com", "news")], "domain string, category string")
    merged = dimensions.merge_overrides(current, applied)
    export.write_overrides(merged, str(tmp_path / "out"))
    again, none = dimensions.load_overrides(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in again.collect()} == {("slack.com", "news"), ("a.com", "news")}
    assert none.count() == 0
    path.write_text("host,category\nx,news\n")
    with pytest.raises(ValueError):
        dimensions.load_overrides(spark, str(path))


def test_blocklist_folders(spark, tmp_path):
    for folder, text in (("games", "g.example\n\ng.example\n"), ("arjel", " bet.example \n"), ("unmapped", "u.example\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "domains").write_text(text)
    got = {(r.domain, r.label, r.priority) for r in dimensions.load_blocklist(spark, str(tmp_path)).collect()}
    assert got == {("g.example", "gaming", 2), ("bet.example", "gambling", 1)}


def test_hostname_file(spark, tmp_path, monkeypatch):
    from trafficloom.operators import categorize

    (tmp_path / "hosts.csv").write_text(
        "hostname,category\nIntra.example,work_tools\nnews.intra.example,news\nexample,other\nlocal,gaming\n"
    )
    rules = CategoryRules(hostnames=dimensions.load_hostnames(spark, str(tmp_path / "hosts.csv")))
    names = ["a.intra.example", "x.NEWS.intra.example", "b.example", "local", "notintra.examples", None]
    frame = spark.createDataFrame([(n,) for n in names], "domain string")
    want = dict(zip(names, ["work_tools", "news", "other", "gaming", "uncategorized", "uncategorized"]))
    assert {r.domain: r.category for r in categorize.categorize(frame, rules).collect()} == want
    # A list above the broadcast bound takes the shuffle path and gives the same.
    monkeypatch.setattr(categorize, "MAX_BROADCAST_HOSTS", 2)
    assert {r.domain: r.category for r in categorize.categorize(frame, rules).collect()} == want


def test_sensitive_list_and_defaults(spark):
    frame = spark.createDataFrame([(" gambling, ,nope,news ",), ("",), (None,)], "raw string")
    got = [r.labels for r in frame.select(dimensions.parse_sensitive("raw").alias("labels")).collect()]
    assert got == [["gambling", "news"], [], []]
    branches = spark.createDataFrame([("a",), ("b",)], "branch string")
    settings = spark.createDataFrame(
        [("a", ["news"], 0, 5, None)],
        "branch string, sensitive_categories array<string>, non_work_minutes int, byte_quota bigint, uncategorized_threshold int",
    )
    got = {r.branch: tuple(r)[1:] for r in dimensions.thresholds(branches, settings).collect()}
    assert got == {"a": (["news"], 0, 5, None), "b": ([], 120, None, None)}


def test_domain_traffic_file(events, tmp_path):
    export.write_domain_traffic(domain_traffic(events, DAY[0], "a"), str(tmp_path / "out"))
    assert "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/out/part-*"))) == "2\texample.org\n"


def test_period_report_and_schedule(spark, events):
    found = spark.createDataFrame([(T0, "k", "t", "d", "high", None, None, b, {}) for b in ("a", "b")], ANOMALY)
    sections = report.period_report(
        minute_totals(events), domain_minute(events), client_minute(events), None, found, CategoryRules(), *DAY, branch="a"
    )
    assert set(sections) == {"summary", "top_domains", "top_blocked", "by_category", "anomalies"}
    assert sections["summary"].first().total_requests == 2
    assert sections["top_blocked"].count() == 0 and sections["anomalies"].count() == 1
    assert report.report_window("off", T0) is None
    assert report.report_window("daily", T0) == (T0 - dt.timedelta(days=1), T0)
    assert report.report_window("weekly", T0, T0 - dt.timedelta(days=6)) is None
    assert report.report_window("weekly", T0, T0 - dt.timedelta(days=8)) == (T0 - dt.timedelta(days=8), T0)
