import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trafficloom.fixed_values import CATEGORIES, STARTER_HOSTNAMES
from trafficloom.functions.skew import lookup_join
from trafficloom.functions.text import escape_formula
from trafficloom.functions.timeparts import resolve_range
from trafficloom.operators import anomalies, clients, domains, filters, markers, monitors, rollup, traffic
from trafficloom.operators.categorize import CategoryRules, blocklist_hits, categorize
from trafficloom.operators.events import events_in_domains
from trafficloom.operators.sessions import time_spent, time_spent_by_category

T0 = dt.datetime(2024, 5, 1, 12)
DAY = (dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 2))


def at(minutes=0, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def _category(spark, rules, *names):
    frame = spark.createDataFrame([(n,) for n in names], "domain string")
    return {r.domain: r.category for r in categorize(frame, rules).collect()}


def test_category_tiers(spark):
    rules = CategoryRules(
        overrides=spark.createDataFrame([("slack.com", "gaming"), ("github.com", "uncategorized")], "domain string, category string"),
        blocklist=spark.createDataFrame(
            [("listed.example", "news", 7), ("listed.example", "adult_content", 0), ("com", "shopping", 6), ("amazon.com", "news", 7)],
            "domain string, label string, priority int",
        ),
    )
    assert _category(
        spark, rules, "aws.amazon.com", "x.AWS.amazon.com", "amazon.com", "notyoutube.com", "www.youtube.com", "Slack.com",
        "slack.com", "github.com", "deep.sub.listed.example", "lucky.bet", "a.xxx", "my-casino.example", "newsgame.example",
        "plain.example", "", None, "com",
    ) == {
        "aws.amazon.com": "work_tools", "x.AWS.amazon.com": "work_tools", "amazon.com": "shopping",
        "notyoutube.com": "uncategorized", "www.youtube.com": "video_streaming", "Slack.com": "work_tools",
        "slack.com": "gaming", "github.com": "uncategorized", "deep.sub.listed.example": "adult_content",
        "lucky.bet": "gambling", "a.xxx": "adult_content", "my-casino.example": "gambling", "newsgame.example": "gaming",
        "plain.example": "uncategorized", "": "uncategorized", None: "uncategorized", "com": "uncategorized",
    }


def test_host_list_is_valid():
    assert {c for _, c in STARTER_HOSTNAMES} <= set(CATEGORIES)
    assert len({h for h, _ in STARTER_HOSTNAMES}) == len(STARTER_HOSTNAMES)


def test_blocklist_with_one_parent_of_most_domains(spark):
    names = spark.range(500).select(F.concat(F.lit("n"), "id", F.lit(".hot.example")).alias("domain"))
    names = names.unionByName(spark.createDataFrame([("cold.other",), ("miss.example",)], "domain string"))
    listed = spark.createDataFrame([("hot.example", "gaming", 2), ("cold.other", "news", 7)], "domain string, label string, priority int")
    got = blocklist_hits(names, listed).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"gaming": 500, "news": 1}


@pytest.mark.parametrize("hot_keys", [1, 3, 100])
def test_lookup_join_is_exact_under_skew(spark, hot_keys):
    rng = random.Random(7)
    keys = [rng.choice(["hot"] * 50 + ["absent"] * 30 + [f"k{i}" for i in range(40)] + [None, ""]) for _ in range(3000)]
    fact = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, key string")
    dim = spark.createDataFrame([("hot", 1), ("", 2)] + [(f"k{i}", 10 + i) for i in range(0, 40, 2)], "key string, value int")
    got = lookup_join(fact, dim, "key", [F.col("id")], hot_keys=hot_keys)
    table = dict(dim.collect())
    assert {r.id: r.value for r in got.collect()} == {i: table.get(k) for i, k in enumerate(keys)}
    assert got.count() == len(keys)


def test_lookup_join_spreads_the_hot_key(spark):
    fact = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), "id")).otherwise("hot").alias("key"))
    dim = spark.createDataFrame([("hot", 1), ("k10", 2)], "key string, value int")
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = lookup_join(fact, dim, "key", [F.col("id")], hot_keys=1)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        found = joined.groupBy("value").count().collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(sizes) == 4 and max(sizes) < 1500
    assert {r.value: r["count"] for r in found} == {1: 3600, 2: 1, None: 399}


def test_rollups(make_events):
    events = make_events(
        [
            {"timestamp": at(0, 5), "action": "TCP_MEM_HIT", "user": "ann"},
            {"timestamp": at(0, 59), "action": "TCP_MISS"},
            {"timestamp": at(0, 30), "action": "TCP_REFRESH_MODIFIED", "domain": None},
            {"timestamp": at(0, 10), "blocked": True},
            {"timestamp": at(1, 0), "action": "TCP_HIT_MISS", "branch": "two"},
        ]
    )
    totals = {(r.bucket_ts, r.branch): tuple(r)[2:] for r in rollup.minute_totals(events).collect()}
    assert totals == {(at(0), "default"): (4, 1, 3, 400, 1, 1), (at(1), "two"): (1, 0, 1, 100, 1, 0)}
    assert rollup.domain_minute(events).agg(F.sum("request_count")).first()[0] == 4
    assert rollup.client_minute(events).count() == 3


def _brute_sessions(times, gap):
    times = sorted(times)
    micros = lambda d: d.days * 86_400_000_000 + d.seconds * 1_000_000 + d.microseconds
    total, count, start, end = 0, 0, times[0], times[0]
    for t in times[1:]:
        if t - end > gap:
            total, count, start = total + micros(end - start), count + 1, t
        end = t
    return (total + micros(end - start)) // 1_000_000, count + 1


def test_sessions_match_brute_force(make_events):
    rng = random.Random(3)
    rows, by_key = [], defaultdict(list)
    for _ in range(1500):
        client, domain = f"10.0.0.{rng.randint(1, 3)}", rng.choice(["a.com", "a.com", "a.com", "b.com", None])
        when = DAY[0] + dt.timedelta(microseconds=rng.choice([rng.randrange(86_400_000_000), rng.randrange(48) * 1_800_000_000]))
        rows.append({"timestamp": when, "client_ip": client, "domain": domain})
        if domain:
            by_key[client, domain].append(when)
    got = {(r.client_ip, r.domain): (r.total_seconds, r.session_count) for r in time_spent(make_events(rows), *DAY).collect()}
    assert got == {k: _brute_sessions(v, dt.timedelta(minutes=30)) for k, v in by_key.items()}


def test_session_gap_is_inclusive(make_events):
    exact = make_events([{"timestamp": at(m)} for m in (0, 30)])
    over = make_events([{"timestamp": at(0)}, {"timestamp": at(30, 1)}])
    five = make_events([{"timestamp": at(m)} for m in (0, 5, 120, 125)])
    result = [tuple(time_spent(e, *DAY).first())[2:] for e in (exact, over, five)]
    assert result == [(1800, 1), (0, 2), (600, 2)]


def test_time_spent_by_category(spark, make_events):
    events = make_events([{"timestamp": at(m), "domain": d} for d in ("youtube.com", "vimeo.com") for m in (0, 10)])
    got = time_spent_by_category(time_spent(events, *DAY, client_ip="10.0.0.1"), CategoryRules()).collect()
    assert [(r.category, r.total_seconds, r.session_count) for r in got] == [("video_streaming", 1200, 2)]


def test_summary_over_both_grains_and_empty(spark, make_events):
    events = make_events([{"timestamp": at(0), "user": "a"}, {"timestamp": at(200), "client_ip": "10.0.0.2"}])
    minutes = rollup.client_minute(events)
    recent, old = minutes.where(F.col("bucket_ts") >= F.lit(at(60))), rollup.client_hourly(minutes.where(F.col("bucket_ts") < F.lit(at(60))))
    rows = clients.client_bucket_rows(recent, old, *DAY)
    got = traffic.summary(rollup.minute_totals(events), rows, *DAY).first()
    assert tuple(got) == (2, 0, 2, 2, 1)
    later = (dt.datetime(2030, 1, 1), dt.datetime(2030, 1, 2))
    empty = clients.client_bucket_rows(recent, old, *later)
    assert tuple(traffic.summary(rollup.minute_totals(events), empty, *later).first()) == (0, 0, 0, 0, 0)
    assert traffic.cache_efficiency(rollup.minute_totals(events), *later).first().hit_ratio is None


def test_partial_hours_overlap(spark):
    hours = spark.createDataFrame([(at(0),), (at(60),), (at(120),)], "bucket_ts timestamp_ntz").withColumn("branch", F.lit("b"))
    got = filters.hours_overlapping(hours, at(30), at(90)).orderBy("bucket_ts").collect()
    assert [r.bucket_ts for r in got] == [at(0), at(60)]


def test_client_summary_names_the_latest_user(make_events):
    events = make_events([{"timestamp": at(0), "user": "zoe"}, {"timestamp": at(5), "user": "adam", "branch": "two"}, {"timestamp": at(9), "client_ip": "10.0.0.9"}])
    rows = clients.client_bucket_rows(rollup.client_minute(events), None, *DAY)
    got = {r.client_ip: (r.user, r.branch, r.total_requests) for r in clients.client_summary(rows).collect()}
    assert got == {"10.0.0.1": ("adam", "two", 2), "10.0.0.9": (None, "default", 1)}


def test_domain_without_traffic_has_zeros(make_events):
    got = domains.domain_summary(make_events([{"timestamp": at(0)}]), *DAY, CategoryRules(), domain="nowhere.bet").first()
    assert tuple(got) == ("nowhere.bet", 0, 0, 0, 0, "gambling")


def test_unknown_sort_falls_back_and_pages_are_checked(make_events):
    events = make_events([{"timestamp": at(0), "client_ip": f"10.0.0.{i % 3}"} for i in range(6)])
    rows = clients.client_bucket_rows(rollup.client_minute(events), None, *DAY)
    assert [r.client_ip for r in clients.list_clients(rows, "no_such", limit=2, offset=1).collect()] == ["10.0.0.1", "10.0.0.2"]
    for limit, offset in ((0, 0), (1001, 0), (5, -1)):
        with pytest.raises(ValueError):
            filters.page(rows, limit, offset)


def test_empty_domain_set_selects_nothing(spark, make_events):
    events = make_events([{"timestamp": at(0)}])
    assert events_in_domains(events, spark.createDataFrame([], "domain string")).count() == 0


def test_range_resolution():
    now = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
    assert resolve_range(now=now).since == dt.datetime(2024, 1, 1)
    aware = dt.datetime(2024, 1, 1, 5, tzinfo=dt.timezone(dt.timedelta(hours=5)))
    assert resolve_range(from_ts=aware, to_ts=dt.datetime(2024, 1, 1, 1)).since == dt.datetime(2024, 1, 1)
    for bad in ({"preset": "2h"}, {"from_ts": aware}, {"from_ts": now, "to_ts": now}):
        with pytest.raises(ValueError):
            resolve_range(**bad)


def test_percent_change_is_null_for_zero(spark):
    frame = spark.createDataFrame([(5, 0), (6, 4)], "now int, before int")
    got = [r.change for r in frame.select(traffic.percent_change(F.col("now"), F.col("before")).alias("change")).collect()]
    assert got == [None, 50.0]


def test_formula_escape(spark):
    values = ["=1", "+1", "-1", "@x", "\tx", "\rx", "x=1", "", None]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.e for r in frame.select(escape_formula(F.col("v")).alias("e")).collect()]
    assert got == ["'=1", "'+1", "'-1", "'@x", "'\tx", "'\rx", "x=1", "", None]


# ----- detectors -----------------------------------------------------------


def _minutes(spark, n, total, branch="default"):
    rows = [(at(-i), branch, total) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "bucket_ts timestamp_ntz, branch string, total_requests bigint")


@pytest.mark.parametrize(("n", "current", "found"), [(6, 40, True), (6, 30, False), (4, 100, False)])
def test_traffic_spike(spark, make_events, n, current, found):
    window = make_events([{"timestamp": at(0, i)} for i in range(current)])
    got = anomalies.traffic_spike(window, _minutes(spark, n, 10)).collect()
    assert [r.params for r in got] == ([{"current": "40", "baseline": "10", "windows": "6"}] if found else [])


def test_spike_baseline_is_per_branch(spark, make_events):
    window = make_events([{"timestamp": at(0, i % 60), "branch": b} for b in ("one", "two") for i in range(40)])
    history = _minutes(spark, 6, 10, "one").unionByName(_minutes(spark, 6, 1000, "two"))
    assert [r.branch for r in anomalies.traffic_spike(window, history).collect()] == ["one"]


def test_stray_old_event_does_not_reset_history(spark, make_events):
    """One event a day old must not make the whole history look newer than the window."""
    window = make_events([{"timestamp": at(-1440), "blocked": True}, {"timestamp": at(0), "blocked": True, "domain": "seen.example"}])
    history = make_events([{"timestamp": at(-300), "domain": "seen.example"}, {"timestamp": at(-300)}])
    assert anomalies.new_blocked_domains(window, history).count() == 0


def test_new_blocked_domain_means_never_seen(make_events):
    window = make_events([{"timestamp": at(0), "blocked": True, "domain": d} for d in ("fresh.example", "seen.example")])
    history = make_events([{"timestamp": at(-90), "domain": "seen.example"}, {"timestamp": at(-90), "domain": "fresh.example", "branch": "other"}])
    assert [r.domain for r in anomalies.new_blocked_domains(window, history.unionByName(window)).collect()] == ["fresh.example"]


def test_client_blocked_ratio(make_events):
    rows = [{"timestamp": at(0, i), "blocked": i < 5} for i in range(9)] + [{"timestamp": at(0), "client_ip": "10.0.0.2", "blocked": True}] * 4
    got = anomalies.client_blocked_ratio(make_events(rows)).collect()
    assert [(r.client_ip, r.severity, r.params["ratio"]) for r in got] == [("10.0.0.1", "high", "56")]


def test_sensitive_visit(spark, make_events):
    settings = spark.createDataFrame([("default", ["gambling"]), ("off", [])], "branch string, sensitive_categories array<string>")
    window = make_events([{"timestamp": at(0), "domain": d, "branch": b} for d in ("new.bet", "old.bet", "github.com") for b in ("default", "off")])
    history = make_events([{"timestamp": at(-90), "domain": "old.bet"}])
    got = anomalies.sensitive_visits(window, history, settings, CategoryRules()).collect()
    assert [(r.branch, r.domain, r.params["category"]) for r in got] == [("default", "new.bet", "gambling")]


def test_detector_registry(spark, make_events):
    assert anomalies.detector() is anomalies.detect_none
    with pytest.raises(ValueError):
        anomalies.detector("other")


def test_alert_selection(spark):
    frame = spark.createDataFrame([(s,) for s in ("low", "medium", "high", "critical")], "severity string")
    assert {r.severity for r in anomalies.select_alerts(frame).collect()} == {"high", "critical"}
    assert anomalies.select_alerts(frame, "low").count() == 4


def _no_anomalies(spark):
    return spark.createDataFrame([], "generated_at timestamp_ntz, title string, client_ip string, domain string, branch string")


def test_quota_severity_and_cooldown(spark):
    usage = spark.createDataFrame(
        [(at(0), "b", f"c{i}", n) for i, n in enumerate((99, 100, 200))] + [(at(-3000), "b", "c0", 500)],
        "bucket_ts timestamp_ntz, branch string, client_ip string, total_bytes bigint",
    )
    settings = spark.createDataFrame([("b", 100), ("zero", 0), ("none", None)], "branch string, byte_quota bigint")
    got = monitors.byte_quota(usage, settings, _no_anomalies(spark), at(60)).collect()
    assert {(r.client_ip, r.severity) for r in got} == {("c1", "high"), ("c2", "critical")}
    flagged = spark.createDataFrame(
        [(at(-60), "Client exceeded daily data quota", "c1", None, "b"), (at(-2000), "Client exceeded daily data quota", "c2", None, "b")],
        _no_anomalies(spark).schema,
    )
    assert [r.client_ip for r in monitors.byte_quota(usage, settings, flagged, at(60)).collect()] == ["c2"]


def test_non_work_minutes_counts_each_minute_once(spark):
    rows = [(at(i), "10.0.0.1", c, "b") for i in range(3) for c in ("gaming", "news", "work_tools")]
    usage = spark.createDataFrame(rows, "bucket_ts timestamp_ntz, client_ip string, category string, branch string")
    for limit, found in ((3, 1), (4, 0), (0, 0)):
        settings = spark.createDataFrame([("b", limit)], "branch string, non_work_minutes int")
        assert monitors.non_work_time(usage, settings, _no_anomalies(spark), at(60)).count() == found


def test_markers_take_the_nearest_point_and_worst_severity(spark):
    points = spark.createDataFrame([(at(m),) for m in (0, 1, 5)], "bucket_ts timestamp_ntz")
    rows = [(at(0, 20), "A", "low"), (at(0, 25), "B", "high"), (at(0, 30), "tie goes to 0", "critical"), (at(2, 59), "C", "low"), (at(30), "far", "critical")]
    found = spark.createDataFrame(rows, "generated_at timestamp_ntz, title string, severity string")
    got = {r.bucket_ts: r.title for r in markers.snap_to_series(found, points).collect()}
    assert got == {at(0): "tie goes to 0", at(1): "C"}


def test_all_known_hosts_are_built_in(spark):
    assert len(STARTER_HOSTNAMES) == 304
    named = {"sub.kaspersky-labs.com": "work_tools", "my.gov.uz": "work_tools", "youtube.googleapis.com": "video_streaming",
             "storage.googleapis.com": "work_tools", "quora.com": "other", "msn.com": "news", "unheard.example": "uncategorized"}
    df = spark.createDataFrame([(d,) for d in named], "domain string")
    assert {r.domain: r.category for r in categorize(df, CategoryRules()).collect()} == named
