import datetime as dt

import pytest
from pyspark.sql import functions as F

from trafficloom.operators.categorize import CategoryRules
from trafficloom.operators.clients import client_bucket_rows
from trafficloom.operators.rollup import (
    client_category_minute,
    client_domain_seen,
    client_minute,
    domain_minute,
    domain_seen,
    minute_totals,
)
from trafficloom.plans.branches import relabel_branch
from trafficloom.plans.retention import run_retention
from trafficloom.plans.store import LogStore
from trafficloom.schema import (
    CLIENT_CATEGORY_MINUTE,
    CLIENT_DOMAIN_SEEN,
    CLIENT_HOURLY,
    CLIENT_MINUTE,
    DOMAIN_MINUTE,
    DOMAIN_SEEN,
    MINUTE_TOTALS,
    RAW_EVENTS,
)
from trafficloom.streaming.feed import start_feed, watermarked_minutes
from trafficloom.streaming.ingest import Ingest
from trafficloom.streaming.progress import lag_signals, progress_rows
from trafficloom.sources.access_log import stream_lines

T0 = dt.datetime(2024, 5, 1, 12)


def at(minutes=0, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def rows(frame, *columns):
    return sorted(frame.select(*columns).collect(), key=repr)


def _add(store, batch, events, ingest="main"):
    store.write_events(batch, events, ingest)
    store.write_rollups(batch, CategoryRules(), ingest)
    store.merge_seen(batch, ingest)
    store.commit(batch, ingest)


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "store"))


@pytest.fixture
def batches(make_events):
    return [
        make_events([{"timestamp": at(m, s), "branch": b, "user": u} for m in (0, 1) for s in (0, 30) for b, u in (("a", None), ("b", "x"))]),
        make_events([{"timestamp": at(1, 45), "branch": "a"}, {"timestamp": at(60 * 15), "branch": "b", "domain": None}]),
    ]


def _same_as_direct(store, events):
    for spec, build in (
        (MINUTE_TOTALS, minute_totals), (DOMAIN_MINUTE, domain_minute), (CLIENT_MINUTE, client_minute),
        (CLIENT_CATEGORY_MINUTE, lambda e: client_category_minute(e, CategoryRules())),
    ):
        columns = [*spec.keys, *spec.measures]
        assert rows(store.rollup(spec), *columns) == rows(build(events), *columns), spec.name
    for spec, build in ((CLIENT_DOMAIN_SEEN, client_domain_seen), (DOMAIN_SEEN, domain_seen)):
        # Stored per date; the first of them is what counts.
        first = store.rollup(spec).groupBy(*spec.keys).agg(F.min("first_seen").alias("first_seen"))
        assert rows(first, *spec.keys, "first_seen") == rows(build(events), *spec.keys, "first_seen"), spec.name


def test_other_time_zones_are_refused(spark, tmp_path):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        with pytest.raises(ValueError):
            LogStore(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_partials_add_up_over_batches(store, batches):
    for n, events in enumerate(batches):
        _add(store, n, events)
    everything = batches[0].unionByName(batches[1])
    assert store.events().count() == everything.count()
    _same_as_direct(store, everything)


def test_unmerged_partials_give_the_same_sums(store, batches):
    for n, events in enumerate(batches):
        _add(store, n, events)
    sums = [F.sum(m) for m in MINUTE_TOTALS.measures]
    partials = store.rollup(MINUTE_TOTALS, merge=False)
    assert partials.agg(*sums).first() == store.rollup(MINUTE_TOTALS).agg(*sums).first()
    assert partials.count() > store.rollup(MINUTE_TOTALS).count()


def test_repeated_batch_changes_nothing(store, batches):
    for n in (0, 1, 1, 0):
        _add(store, n, batches[n])
    _same_as_direct(store, batches[0].unionByName(batches[1]))


def test_uncommitted_batch_is_invisible(store, batches):
    _add(store, 0, batches[0])
    store.write_events(1, batches[1])
    store.write_rollups(1, CategoryRules())
    assert store.events().count() == batches[0].count()
    _same_as_direct(store, batches[0])
    store.commit(1)
    _same_as_direct(store, batches[0].unionByName(batches[1]))


def test_folds_and_vacuum_keep_every_row(store, batches, make_events):
    everything = batches[0].unionByName(batches[1])
    for n, events in enumerate(batches):
        _add(store, n, events)
    for name in (RAW_EVENTS, MINUTE_TOTALS.name, DOMAIN_MINUTE.name, CLIENT_CATEGORY_MINUTE.name, CLIENT_MINUTE.name):
        store.fold(name, [T0.date()])
    _same_as_direct(store, everything)
    late = make_events([{"timestamp": at(0, 1), "branch": "a"}])
    _add(store, 2, late)
    everything = everything.unionByName(late)
    _same_as_direct(store, everything)
    store.fold(RAW_EVENTS, [T0.date()])
    store.fold(MINUTE_TOTALS.name, store.dates(MINUTE_TOTALS.name))
    assert store.vacuum() > 0
    _same_as_direct(store, everything)
    assert store.events().count() == everything.count()


def _client_sums(store, since=dt.datetime(2020, 1, 1), until=dt.datetime(2030, 1, 1)):
    merged = client_bucket_rows(store.rollup(CLIENT_MINUTE), store.rollup(CLIENT_HOURLY), since, until)
    return rows(merged.groupBy("client_ip", "branch", "user").agg(F.sum("request_count").alias("n"), F.sum("total_bytes").alias("b")), "client_ip", "branch", "user", "n", "b")


def test_hourly_rollup_never_doubles_or_loses(store, batches, make_events):
    for n, events in enumerate(batches):
        _add(store, n, events)
    before = _client_sums(store)
    store.roll_up_hours(at(1))
    assert _client_sums(store) == before
    assert store.rollup(CLIENT_MINUTE).where(F.col("bucket_ts") < F.lit(at(1))).count() == 0
    # A late event lands before the cutoff: visible at once, moved by the next run, counted once.
    _add(store, 2, make_events([{"timestamp": at(0, 10), "branch": "a"}]))
    late = _client_sums(store)
    assert sum(r.n for r in late) == sum(r.n for r in before) + 1
    store.fold(CLIENT_MINUTE.name, [T0.date()])
    assert _client_sums(store) == late
    store.roll_up_hours(at(60 * 24))
    assert _client_sums(store) == late
    store.fold(CLIENT_HOURLY.name, store.dates(CLIENT_HOURLY.name))
    store.vacuum()
    assert _client_sums(store) == late
    assert store.rollup(CLIENT_MINUTE).count() == 0
    # An earlier cutoff finds nothing left to move.
    store.roll_up_hours(at(0))
    assert _client_sums(store) == late


def test_retention_drops_old_rows_and_warns(spark, store, make_events):
    now = dt.datetime(2024, 6, 1, 12)
    days = [40, 30, 29]
    _add(store, 0, make_events([{"timestamp": now - dt.timedelta(days=d, minutes=m), "branch": "a"} for d in days for m in (-30, 30)]))
    branches = spark.createDataFrame([("a",), ("b",)], "branch string")
    runs = spark.createDataFrame([("b", now)], "branch string, archived_until timestamp_ntz")
    sums = _client_sums(store)
    for _ in range(2):
        warning = run_retention(store, branches, runs, now)
        assert [r.branch for r in warning.collect()] == ["a"]
        left = sorted((now - r.timestamp).total_seconds() / 86400 for r in store.events().collect())
        assert len(left) == 3 and left[-1] <= 30
        assert store.rollup(MINUTE_TOTALS).agg(F.sum("total_requests")).first()[0] == 6
        assert _client_sums(store) == sums
    store.vacuum()
    assert store.events().count() == 3


def test_relabel_moves_tables_without_conflicts(store, batches):
    _add(store, 0, batches[0])
    plan = {r.table_name: (r.moving, r.conflicts) for r in relabel_branch(store, "a", "b").collect()}
    assert plan["raw_events"] == (4, 0) and plan["minute_totals"] == (2, 2) and plan["client_minute"] == (2, 0)
    assert store.events().where("branch = 'a'").count() == 4
    relabel_branch(store, "a", "b", dry_run=False)
    assert store.events().where("branch = 'b'").count() == 8
    assert {r.branch for r in store.rollup(CLIENT_MINUTE).collect()} == {"b"}
    assert {r.branch for r in store.rollup(MINUTE_TOTALS).collect()} == {"a", "b"}


def test_monitors_store_findings_once(spark, store, make_events):
    from trafficloom.plans.monitoring import run_monitors

    _add(store, 0, make_events([{"timestamp": at(m), "domain": "plain.example", "branch": "a", "bytes": 60} for m in range(3)]))
    settings = spark.createDataFrame(
        [("a", 0, 100, 3)], "branch string, non_work_minutes int, byte_quota bigint, uncategorized_threshold int"
    )
    for when in (at(10), at(70)):
        run_monitors(store, settings, CategoryRules(), when)
        found = sorted((r.kind, r.generated_at, r.severity) for r in store.anomalies().collect())
        assert found == [("byte_quota", at(10), "high"), ("uncategorized_domain", at(10), "low")]


def test_a_repeated_monitor_run_keeps_its_findings_and_adds_late_ones(spark, store, make_events):
    from trafficloom.plans.monitoring import run_monitors

    settings = spark.createDataFrame(
        [("a", 0, 100, 3)], "branch string, non_work_minutes int, byte_quota bigint, uncategorized_threshold int"
    )
    _add(store, 0, make_events([{"timestamp": at(m), "domain": "plain.example", "branch": "a", "bytes": 60} for m in range(3)]))
    run_monitors(store, settings, CategoryRules(), at(10))
    late = [{"timestamp": at(m), "domain": "late.example", "client_ip": "10.0.0.9", "branch": "a", "bytes": 90} for m in range(3)]
    _add(store, 1, make_events(late))
    for _ in range(2):
        run_monitors(store, settings, CategoryRules(), at(10))
        found = sorted((r.kind, r.client_ip or r.domain) for r in store.anomalies().collect())
        assert found == [
            ("byte_quota", "10.0.0.1"), ("byte_quota", "10.0.0.9"),
            ("uncategorized_domain", "late.example"), ("uncategorized_domain", "plain.example"),
        ]


def test_ingests_are_numbered_apart_and_replays_change_nothing(spark, store):
    """A, B, A, then a replay of A's batches, also after upkeep has removed what it can."""
    lines = spark.createDataFrame([(_line(at(1)).strip(), "a")], "value string, branch string")
    one, two = Ingest(store, ingest="one"), Ingest(store, ingest="two")
    one.flush(lines, 0)
    two.flush(lines, 0)
    one.flush(lines, 1)
    for _ in range(2):
        one.flush(lines.limit(0), 0)
        one.flush(lines, 1)
        assert store.events().count() == 3
        assert store.rollup(MINUTE_TOTALS).agg(F.sum("total_requests")).first()[0] == 3
        assert [tuple(r) for r in store.quality().collect()] == [("a", 3, 3)]
        store.fold(RAW_EVENTS, store.dates(RAW_EVENTS))
        store.fold(MINUTE_TOTALS.name, store.dates(MINUTE_TOTALS.name))
        assert store.vacuum() > 0
        assert store.marks() == {"one": 1, "two": 0}
    two.flush(lines, 1)
    assert store.events().count() == 4
    with pytest.raises(ValueError):
        Ingest(store, ingest="not/a/name").flush(lines, 0)


def test_an_unfinished_fold_does_not_count(store, batches):
    for n, events in enumerate(batches):
        _add(store, n, events)
    store._save_folds, keep = (lambda done: None), store._save_folds
    for name in (RAW_EVENTS, MINUTE_TOTALS.name):
        store.fold(name, [T0.date()])
    store.roll_up_hours(at(60 * 24))
    everything = batches[0].unionByName(batches[1])
    assert store.events().count() == everything.count()
    _same_as_direct(store, everything)
    store._save_folds = keep
    for name in (RAW_EVENTS, MINUTE_TOTALS.name):
        store.fold(name, [T0.date()])
    store.vacuum()
    assert store.events().count() == everything.count()
    _same_as_direct(store, everything)


def test_rollups_come_from_one_scan_and_two_shuffles(make_events):
    from trafficloom.operators.rollup import all_rollups

    events = make_events([{"timestamp": at(m), "domain": d, "user": u} for m in range(3) for d in ("a.example", "", None) for u in ("x", None)])
    plan = all_rollups(events, CategoryRules())._jdf.queryExecution().sparkPlan().toString()
    full = all_rollups(events, CategoryRules())._jdf.queryExecution().executedPlan().toString()
    assert full.count("Exchange hashpartitioning") == 2 and plan.count("Expand") == 1
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") - plan.count("__host") <= 1 + plan.count("BroadcastHashJoin")


def test_first_visits_are_read_from_few_files(store, make_events):
    """Files opened do not grow with the number of batches but with its logarithm."""
    everything = None
    for n in range(34):
        events = make_events([{"timestamp": at(n), "client_ip": f"10.0.0.{n % 3}", "domain": "a.example", "branch": "a"}])
        everything = events if everything is None else everything.unionByName(events)
        store.write_partials(n, CLIENT_DOMAIN_SEEN, client_domain_seen(events))
        store.write_partials(n, DOMAIN_SEEN, domain_seen(events))
        store.merge_seen(n)
        store.commit(n)
    files = lambda: _opened(store.first_visits(DOMAIN_SEEN, everything))
    assert files() == 4  # two merged runs of 16 batches and two single batches
    first = store.first_visits(CLIENT_DOMAIN_SEEN).groupBy("client_ip").agg(F.min("first_seen").alias("t"))
    assert rows(first, "client_ip", "t") == [(f"10.0.0.{k}", at(k)) for k in range(3)]
    store.vacuum()
    assert files() == 4
    assert rows(store.first_visits(DOMAIN_SEEN).agg(F.min("first_seen").alias("t")), "t") == [(at(0),)]
    other = make_events([{"timestamp": at(0), "domain": "elsewhere.example"}])
    assert store.first_visits(DOMAIN_SEEN, other).count() == 0


def test_first_visits_survive_skipped_numbers(store, make_events):
    mark = -1
    for n in (3, 5, 40, 41, 300):
        events = make_events([{"timestamp": at(n), "domain": f"d{n}.example", "branch": "a"}])
        store.write_partials(n, DOMAIN_SEEN, domain_seen(events))
        store.merge_skipped(mark, n)
        store.merge_seen(n)
        store.commit(n)
        mark = n
        store.vacuum()
    assert sorted(r.domain for r in store.first_visits(DOMAIN_SEEN).collect()) == sorted(f"d{n}.example" for n in (3, 5, 40, 41, 300))


def _opened(frame):
    """Number of files that a frame's scans read, after partition pruning."""
    frame.collect()
    return len({r["f"] for r in frame.select(F.input_file_name().alias("f")).collect()})


def test_archive_of_a_store_moves_its_watermarks(spark, store, make_events, tmp_path):
    from trafficloom.plans.archive import RUNS, archive_store

    _add(store, 0, make_events([{"timestamp": at(m), "branch": b} for m in range(2) for b in ("a", "b")]))
    branches = spark.createDataFrame([("a",), ("b",)], "branch string")
    out = str(tmp_path / "archive")
    assert archive_store(store, branches, at(60), out)
    assert not archive_store(store, branches, at(61), out)
    assert {r.archived_until for r in store.state("archive_runs", RUNS).collect()} == {at(60)}
    assert archive_store(store, branches, at(60 * 24 * 8), out)
    assert spark.read.option("header", True).csv(out).where("run_date = '2024-05-01'").count() == 4


# ----- streaming -----------------------------------------------------------


def _line(when, domain="example.org", ip="10.0.0.1", action="TCP_MISS/200", user="-"):
    seconds = (when - dt.datetime(1970, 1, 1)).total_seconds()
    return f"{seconds:.3f} 5 {ip} {action} 100 GET http://{domain}/ {user} HIER_DIRECT/1.2.3.4 text/html\n"


def _land(folder, branch, name, lines):
    (folder / f"branch={branch}").mkdir(parents=True, exist_ok=True)
    (folder / f"branch={branch}" / name).write_text("".join(lines))


def _run(spark, store, logs, checkpoint, **options):
    ingest = Ingest(store, **options)
    query = ingest.start(stream_lines(spark, str(logs), max_files_per_trigger=1), str(checkpoint), available_now=True)
    query.awaitTermination()
    return ingest, query


def test_stream_equals_batch_and_resumes(spark, store, tmp_path):
    from trafficloom.operators.parse import parse_access_log
    from trafficloom.sources.access_log import read_lines

    logs, checkpoint = tmp_path / "logs", tmp_path / "checkpoint"
    _land(logs, "a", "1.log", [_line(at(m)) for m in range(5)] + ["broken\n"])
    _land(logs, "b", "1.log", [_line(at(m), user="x") for m in range(3)])
    _, query = _run(spark, store, logs, checkpoint)
    _land(logs, "a", "2.log", [_line(at(2), ip="10.0.0.2")])
    _run(spark, store, logs, checkpoint)
    direct, rejects = parse_access_log(read_lines(spark, str(logs)))
    _same_as_direct(store, direct)
    assert rows(store.events(), "id", "timestamp", "branch") == rows(direct, "id", "timestamp", "branch")
    assert [(r.branch, r.line) for r in store.rejects().collect()] == [("a", "broken")]
    assert {r.branch: (r.lines_seen, r.lines_parsed) for r in store.quality().collect()} == {"a": (7, 6), "b": (3, 3)}
    assert rejects.count() == 1
    signals = lag_signals(progress_rows(spark, query.recentProgress)).collect()
    assert sum(s.input_rows for s in signals) >= 9


def test_streams_may_run_at_the_same_time(spark, store, tmp_path):
    queries = []
    for name in ("a", "b", "c"):
        for k in range(2):
            _land(tmp_path / f"logs-{name}", name, f"{k}.log", [_line(at(m), ip=f"10.0.{k}.{m}") for m in range(5)])
        lines = stream_lines(spark, str(tmp_path / f"logs-{name}"), max_files_per_trigger=1)
        queries.append(Ingest(store).start(lines, str(tmp_path / f"checkpoint-{name}"), available_now=True))
    for query in queries:
        query.awaitTermination()
    assert sorted(store.marks().values()) == [1, 1, 1] and store.events().count() == 30
    found = store.rollup(MINUTE_TOTALS).groupBy("branch").agg(F.sum("total_requests").alias("n"))
    assert rows(found, "branch", "n") == [("a", 10), ("b", 10), ("c", 10)]
    assert {(r.branch, r.lines_seen) for r in store.quality().collect()} == {("a", 10), ("b", 10), ("c", 10)}


def test_failed_batch_is_retried_with_the_same_events(spark, store, tmp_path):
    logs, checkpoint = tmp_path / "logs", tmp_path / "checkpoint"
    _land(logs, "a", "1.log", [_line(at(m)) for m in range(4)])

    class Breaks(Ingest):
        def flush(self, lines, batch_id, ingest=None):
            self.store.commit, keep = self._refuse, self.store.commit
            try:
                super().flush(lines, batch_id, ingest)
            finally:
                self.store.commit = keep

        @staticmethod
        def _refuse(batch, ingest):
            raise RuntimeError("no commit today")

    query = Breaks(store).start(stream_lines(spark, str(logs)), str(checkpoint), available_now=True)
    with pytest.raises(Exception):
        query.awaitTermination()
    assert store.marks() == {} and store.events().count() == 0
    _run(spark, store, logs, checkpoint)
    assert store.events().count() == 4
    assert store.rollup(MINUTE_TOTALS).agg(F.sum("total_requests")).first()[0] == 4


def test_detection_sees_only_earlier_batches(spark, store, tmp_path):
    logs, checkpoint = tmp_path / "logs", tmp_path / "checkpoint"
    settings = spark.createDataFrame([("a", ["gambling"])], "branch string, sensitive_categories array<string>")
    options = {"settings": settings, "detector_name": "statistical"}
    _land(logs, "a", "1.log", [_line(at(m), "seen.bet") for m in range(6)])
    _run(spark, store, logs, checkpoint, **options)
    _land(logs, "a", "2.log", [_line(at(10, i), d, action="TCP_DENIED/403") for i in range(4) for d in ("seen.bet", "new.bet")])
    _run(spark, store, logs, checkpoint, **options)
    found = {(r.kind, r.domain) for r in store.anomalies().where(F.col("generated_at") > F.lit(at(9))).collect()}
    assert found == {
        ("traffic_spike", None), ("new_blocked_domain", "new.bet"),
        ("sensitive_category_visit", "new.bet"), ("client_blocked_ratio", None),
    }


def test_broken_detector_does_not_break_the_flush(spark, store, tmp_path):
    logs = tmp_path / "logs"
    _land(logs, "a", "1.log", [_line(at(0))])
    ingest = Ingest(store)
    ingest.detect = lambda data: 1 / 0
    ingest.start(stream_lines(spark, str(logs)), str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert store.events().count() == 1


def test_live_feed(spark, tmp_path):
    logs = tmp_path / "logs"
    _land(logs, "a", "1.log", [_line(at(0))])
    _land(logs, "b", "1.log", [_line(at(0))])
    feed = start_feed(stream_lines(spark, str(logs)), str(tmp_path / "feed"), str(tmp_path / "cp"), branch="a", available_now=True)
    feed.awaitTermination()
    assert [r.branch for r in spark.read.parquet(str(tmp_path / "feed")).collect()] == ["a"]


def test_watermarked_minutes_close_old_windows(spark, tmp_path):
    from trafficloom.operators.parse import parse_access_log

    logs = tmp_path / "logs"
    _land(logs, "a", "1.log", [_line(at(0)), _line(at(0, 30)), _line(at(30))])
    events, _ = parse_access_log(stream_lines(spark, str(logs)))
    query = (
        watermarked_minutes(events).writeStream.format("memory").queryName("closed").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [(r.bucket_ts, r.total_requests) for r in spark.table("closed").collect()] == [(at(0), 2)]
