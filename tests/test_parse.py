import datetime as dt
import ipaddress
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from trafficloom.functions.network import add_domain, is_ip
from trafficloom.operators.parse import parse_access_log, parse_lines, parse_quality
from trafficloom.sources.access_log import read_branch_files, read_lines

FULL = "1709294402.750 318 172.20.7.91 TCP_MEM_HIT/206 73311 HEAD https://Files.Harbour.example/tide.bin?d=3 mira PARENT_HIT/10.9.8.7 application/zip"
GOOD = "1704067200.125 45 10.0.0.5 TCP_MISS/200 907 POST http://Tide.example/log mira HIER_DIRECT/172.20.7.91 text/html"


def _parse(spark, *lines):
    return parse_access_log(spark.createDataFrame([(line, "b1") for line in lines], "value string, branch string"))


def _one(spark, line):
    rows = _parse(spark, line)[0].collect()
    assert len(rows) == 1, line
    return rows[0]


def test_full_line(spark):
    wanted = {
        "content_type": "application/zip",
        "peer": "10.9.8.7",
        "hierarchy": "PARENT_HIT",
        "user": "mira",
        "domain": "files.harbour.example",
        "method": "HEAD",
        "bytes": 73_311,
        "status_code": 206,
        "action": "TCP_MEM_HIT",
        "blocked": False,
        "branch": "b1",
        "client_ip": "172.20.7.91",
        "duration_ms": 318,
        "timestamp": dt.datetime(2024, 3, 1, 12, 0, 2, 750_000),
    }
    row = _one(spark, FULL).asDict()
    assert {name: row[name] for name in wanted} == wanted


def test_dashes_become_null(spark):
    row = _one(spark, "1704067200 1 10.0.0.5 TCP_DENIED/407 0 CONNECT Bank.example:443 - HIER_NONE/- -")
    assert (row.user, row.peer, row.content_type, row.hierarchy) == (None, None, None, "HIER_NONE")
    assert row.domain == "Bank.example" and row.blocked


def test_defaults_for_bad_numbers(spark):
    row = _one(spark, "1704067200 x 10.0.0.5 TCP_MISS 1_000 GET - - - text/css")
    assert (row.duration_ms, row.status_code, row.bytes, row.domain, row.hierarchy) == (0, 0, 1000, None, None)


def test_status_makes_blocked(spark):
    assert _one(spark, GOOD.replace("TCP_MISS/200", "TCP_MISS/403")).blocked
    assert _one(spark, GOOD.replace("TCP_MISS/200", "TCP_DENIED_REPLY/200")).blocked


@pytest.mark.parametrize("tail", ["text/html; charset=UTF-8", "text/html;  two  spaces", "a\tb", "x \u00a0 y"])
def test_last_field_keeps_inner_whitespace(spark, tail):
    line = GOOD.replace("text/html", tail).replace(" 45 ", "     45 ")
    assert _one(spark, line).content_type == tail


@pytest.mark.parametrize("gap", ["\t", "\x0b", "\u00a0", "\u2003", "\x1c", " \r "])
def test_any_whitespace_separates(spark, gap):
    row = _one(spark, GOOD.replace(" ", gap) + "\r")
    assert row.content_type == "text/html" and row.bytes == 907


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("too few fields", "field_count"),
        (GOOD.replace("1704067200.125", "soon"), "timestamp"),
        (GOOD.replace("1704067200.125", "nan"), "timestamp"),
        (GOOD.replace("1704067200.125", "inf"), "timestamp"),
        (GOOD.replace("1704067200.125", "1e300"), "timestamp"),
        (GOOD.replace("1704067200.125", "1.5d"), "timestamp"),
        (GOOD.replace("10.0.0.5", "10.0.0.999"), "client_ip"),
        (GOOD.replace("10.0.0.5", "010.0.0.9"), "client_ip"),
        (GOOD.replace("http://Tide.example/log", "http://ti de.example/log"), "field_count"),
    ],
)
def test_rejects_keep_the_line(spark, line, reason):
    good, rejects = _parse(spark, line)
    assert good.count() == 0
    assert [(r.reject_reason, r.line, r.branch) for r in rejects.collect()] == [(reason, line, "b1")]


def test_blank_lines_are_skipped(spark):
    assert parse_lines(spark.createDataFrame([("  \t",), ("",)], "value string").withColumn("branch", F.lit("b"))).count() == 0


def test_overlong_fields_are_cut(spark):
    host, user, kind = "a" * 300 + ".com", "u" * 300, "t" * 200
    row = _one(spark, GOOD.replace("Tide.example", host).replace("mira", user).replace("text/html", kind))
    assert (len(row.domain), len(row.user), len(row.content_type)) == (255, 255, 128)
    assert host in row.url


def test_times_round_like_python(spark):
    texts = ["1704067200.1234565", "1704067200.9999995", "0.0000005", "-1.25", "253402300799.5", "17e8", ".5"]
    rows = _parse(spark, *[GOOD.replace("1704067200.125", t) for t in texts])[0].collect()
    want = [dt.datetime.fromtimestamp(float(t), dt.timezone.utc).replace(tzinfo=None) for t in texts]
    assert sorted(r.timestamp for r in rows) == sorted(want)


ADDRESSES = [
    "1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "01.2.3.4", "1.2.3.4.5", "", "::", "::1", "1::", ":::", "1::2::3",
    "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:2:3:4::5:6:7:8",
    "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "::ffff:10.0.0.1", "::ffff:10.0.0.256", "1:2:3:4:5:6:1.2.3.4",
    "1:2:3:4:5:6:7:1.2.3.4", "12345::", "g::", "1:2:3:4:5:6:7:8:9", ":1", "1:", "::1.2.3.4", "1.2.3.4::", "2001:DB8::aB",
]


def test_addresses_agree_with_the_standard_library(spark):
    def valid(text):
        try:
            ipaddress.ip_address(text)
            return True
        except ValueError:
            return False

    frame = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")
    got = {r.ip: r.ok for r in frame.select("ip", is_ip(F.col("ip")).alias("ok")).collect()}
    assert got == {a: valid(a) for a in ADDRESSES}


TARGETS = [
    "http://Example.COM/x", "https://user:pw@host.example:8443/p?q#f", "ftp://a_b.example/", "http://[2001:DB8::1]:80/",
    "http://[::1/path", "http://host]/", "http://[1.2.3.4]/", "http:///nohost", "http://?q", "http://a@b@c.example/",
    "1http://x.example/", "http:x://y.example/", "http://exa|mple/", "http://h.example:notaport/", "http://-bad.example/",
    "svn+ssh://h.example", "://x", "http://h\u00fc.example/", "http://x.example?u=http://y.example",
]


def test_url_hosts_agree_with_the_standard_library(spark):
    import re

    def expected(url):
        try:
            host = urlsplit(url).hostname
        except ValueError:
            return None
        return host if host and re.match(r"^[A-Za-z0-9]([A-Za-z0-9.\-:_\[\]]*[A-Za-z0-9\]])?$", host) else None

    frame = spark.createDataFrame([(u, "GET") for u in TARGETS], "url string, method string")
    got = {r.url: r.domain for r in add_domain(frame, "url", "method").collect()}
    assert got == {u: expected(u) for u in TARGETS}


@pytest.mark.parametrize(
    ("target", "domain"),
    [("Host.example:443", "Host.example"), ("host.example", "host.example"), ("a:b:443", "a:b"), ("\x16\x03:1", None), (":443", None)],
)
def test_tunnel_targets(spark, target, domain):
    frame = spark.createDataFrame([(target, "CONNECT")], "url string, method string")
    assert add_domain(frame, "url", "method").first().domain == domain


def test_quality_and_alarm(spark):
    lines = spark.createDataFrame([(GOOD, "a"), ("bad", "a"), (GOOD, "b")], "value string, branch string")
    branches = spark.createDataFrame([("a",), ("b",), ("idle",)], "branch string")
    got = {r.branch: (r.lines_seen, r.lines_parsed, r.failure_rate, r.alarm) for r in parse_quality(lines, branches).collect()}
    assert got == {"a": (2, 1, 0.5, True), "b": (1, 1, 0.0, False), "idle": (0, 0, None, False)}


def test_only_line_feeds_end_records(spark, tmp_path):
    folder = tmp_path / "branch=site one"
    folder.mkdir()
    (folder / "access.log").write_bytes((GOOD + "\r\n" + GOOD.replace("/log ", "/log\rb ")).encode())
    lines = read_lines(spark, str(tmp_path))
    assert lines.count() == 2
    assert {r.branch for r in lines.collect()} == {"site one"}
    good, rejects = parse_access_log(lines)
    assert (good.count(), rejects.count()) == (1, 1)


def test_start_policy_skips_old_files(spark, tmp_path):
    import os

    folder = tmp_path / "branch=x"
    folder.mkdir()
    for name, when in (("old.log", 1_600_000_000), ("new.log", 1_700_000_000)):
        (folder / name).write_text(GOOD + "\n")
        os.utime(folder / name, (when, when))
    assert read_lines(spark, str(tmp_path), dt.datetime(2023, 1, 1)).count() == 1


def test_fan_in_of_named_paths(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.log").write_text(GOOD + "\n")
    lines = read_branch_files(spark, {n: str(tmp_path / f"{n}.log") for n in ("one", "two")})
    assert {r.branch for r in lines.collect()} == {"one", "two"}
