"""Longer sums, distinct counts, renames, newest events, the lag log and the feed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trafficloom.operators.anomalies import carried_minutes, outside_carried
from trafficloom.operators.categorize import CategoryRules
from trafficloom.operators.distinct import count_sets, id_sets, number_new
from trafficloom.operators.events import Position, events_after, newest, next_position
from trafficloom.operators.rollup import client_minute, domain_minute
from trafficloom.plans.branches import relabel_branch
from trafficloom.plans.store import BLOCK, DAY, HOUR, MINUTE, LogStore, cut_range
from trafficloom.schema import CLIENT_MINUTE, DOMAIN_MINUTE, RAW_EVENTS
from trafficloom.streaming.progress import ProgressLog

T0 = dt.datetime(2024, 5, 1)


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "store"))


def _moments(seed, days, n):
    dice = random.Random(seed)
    return [T0 + dt.timedelta(minutes=dice.randrange(days * 1440), seconds=dice.randrange(60)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_cut_ranges_cover_every_minute_once(seed):
    dice = random.Random(seed)
    since = T0 + dt.timedelta(seconds=dice.randrange(40 * 86400))
    until = since + dt.timedelta(seconds=dice.randrange(1, 40 * 86400))
    days = [since.date() + dt.timedelta(days=k) for k in range((until.date() - since.date()).days + 1)]
    closed = [d for d in days if dice.random() < 0.9]
    blocks = {dt.date(1970, 1, 1) + dt.timedelta(days=16 * k) for k in range(1230, 1250) if dice.random() < 0.7}
    spans = cut_range(since, until, closed, blocks)
    covered = []
    for length, a, b, dates in spans:
        # Only the dates that a span names are read; a block stands for its sixteen.
        read = {d + dt.timedelta(days=k) for d in dates for k in range(16 if length == BLOCK else 1)}
        minutes = (a + dt.timedelta(minutes=k) for k in range(int((b - a).total_seconds()) // 60))
        covered += [m for m in minutes if m.date() in read]
    first = since.replace(second=0)
    wanted = [first + dt.timedelta(minutes=k) for k in range(int((until - since).total_seconds()) // 60 + 3)]
    assert sorted(covered) == [m for m in wanted if since <= m <= until and m.date() in set(closed)]
    for length, a, b, _ in spans:
        assert (a - dt.datetime(1970, 1, 1)).total_seconds() % length == 0 and (b - dt.datetime(1970, 1, 1)).total_seconds() % length == 0
    assert sum(1 for s in spans if s[0] == MINUTE) <= 4 and {s[0] for s in spans} <= {MINUTE, HOUR, DAY, BLOCK}


def test_long_ranges_read_longer_sums_and_late_rows(store, make_events):
    early = make_events([{"timestamp": t, "domain": f"d{k % 3}.example"} for k, t in enumerate(_moments(1, 22, 150))])
    late = make_events([{"timestamp": t, "domain": "late.example"} for t in _moments(2, 22, 20)])
    store.write_partials(0, DOMAIN_MINUTE, domain_minute(early))
    store.commit(0)
    store.fold_levels(DOMAIN_MINUTE, store.dates(DOMAIN_MINUTE.name)[:-1])
    store.vacuum()
    every = domain_minute(early)

    def check():
        for since, until in ((T0, T0 + dt.timedelta(days=60)), (T0 + dt.timedelta(hours=31, seconds=7), T0 + dt.timedelta(days=20, minutes=400))):
            inside = F.col("bucket_ts").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz"))
            total = [F.sum("request_count").alias("n"), F.sum("total_bytes").alias("b")]
            direct = every.where(inside).groupBy("domain").agg(*total)
            found = store.rollup_range(DOMAIN_MINUTE, since, until)
            assert sorted(map(tuple, found.groupBy("domain").agg(*total).collect())) == sorted(map(tuple, direct.collect()))
        return found

    assert check().count() < every.count() * 0.7
    store.write_partials(1, DOMAIN_MINUTE, domain_minute(late))
    store.commit(1)
    every = every.unionByName(domain_minute(late))
    check()
    # Folding a date again writes its longer sums again, and those of its block.
    store.fold(DOMAIN_MINUTE.name, store.dates(DOMAIN_MINUTE.name)[3:6])
    check()
    with pytest.raises(ValueError):
        store.fold_levels(CLIENT_MINUTE, store.dates(DOMAIN_MINUTE.name))
    # Dates that age out take their part of every sum with them.
    gone = T0.date() + dt.timedelta(days=4)
    store.drop_dates(DOMAIN_MINUTE.name, gone)
    every = every.where(F.col("bucket_ts") >= F.lit(dt.datetime.combine(gone, dt.time())).cast("timestamp_ntz"))
    check()


def test_distinct_counts_from_sets_are_exact(spark, store, make_events):
    def batch(number, seed, clients):
        found = [{"timestamp": t, "client_ip": f"10.0.0.{k % clients}", "user": f"u{k % 7}" if k % 3 else None, "branch": "ab"[k % 2]}
                 for k, t in enumerate(_moments(seed, 3, 120))]
        events = make_events(found)
        store.write_partials(number, CLIENT_MINUTE, client_minute(events))
        store.commit(number)
        return events

    def check(events):
        whole, cut = (T0, T0 + dt.timedelta(days=9)), (T0 + dt.timedelta(minutes=200), T0 + dt.timedelta(days=2, minutes=77))
        for (since, until), branches in ((whole, [None]), (cut, ["a"])):
            for branch in branches:
                minute = F.date_trunc("minute", F.col("timestamp").cast("timestamp")).cast("timestamp_ntz")
                rows = events.where(minute.between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))
                rows = rows if branch is None else rows.where(F.col("branch") == branch)
                expected = rows.agg(F.count_distinct("client_ip"), F.count_distinct("user")).first()
                assert {r.kind: r.n for r in store.active_counts(since, until, branch).collect()} == dict(zip(("client", "user"), expected))

    events = batch(0, 3, 40)
    check(events)
    store.fold_clients(store.dates(CLIENT_MINUTE.name)[:-1])
    check(events)
    events = events.unionByName(batch(1, 4, 90))
    check(events)
    # What came late gets into the sets before the minutes are folded.
    store.fold(CLIENT_MINUTE.name, store.dates(CLIENT_MINUTE.name))
    store.vacuum()
    check(events)
    ids = store.client_ids().groupBy("kind").agg(F.count_distinct("value").alias("v"), F.count_distinct("id").alias("i"), F.max("id").alias("m")).collect()
    assert all(r.v == r.i == r.m + 1 for r in ids)


def test_numbers_go_on_without_gaps(spark):
    known = spark.createDataFrame([("client", "a", 0), ("client", "b", 1)], "kind string, value string, id bigint")
    values = spark.createDataFrame([("client", v) for v in ["a", "c", "c", None, "d"]] + [("user", "a")], "kind string, value string")
    new = sorted(map(tuple, number_new(values, known, {"client": 2}).collect()))
    assert [(k, v) for k, v, _ in new] == [("client", "c"), ("client", "d"), ("user", "a")]
    assert sorted(i for k, _, i in new if k == "client") == [2, 3] and new[-1][2] == 0
    sets = id_sets(spark.createDataFrame([("x", 0), ("x", 0), ("x", 40_000), ("y", 5)], "k string, id bigint"), "k")
    assert sorted(map(tuple, count_sets(sets.unionByName(sets), "k").collect())) == [("x", 2), ("y", 1)]


def test_renames_hold_for_what_was_stored(store, make_events):
    def add(batch, branch):
        events = make_events([{"timestamp": T0 + dt.timedelta(minutes=batch), "branch": branch}])
        store.write_events(batch, events)
        store.write_rollups(batch, CategoryRules())
        store.commit(batch)

    def files():
        return {str(p): p.stat().st_mtime_ns for t in (RAW_EVENTS, "rollups") for p in __import__("pathlib").Path(store.path(t) if t == RAW_EVENTS else f"{store.root}/rollups").rglob("*.parquet")}

    add(0, "a")
    before = files()
    relabel_branch(store, "a", "b", dry_run=False)
    relabel_branch(store, "b", "c", dry_run=False)
    assert files() == before
    add(1, "a")
    names = lambda: sorted(r.branch for r in store.events().collect())
    assert names() == ["a", "c"] == sorted(r.branch for r in store.rollup(DOMAIN_MINUTE).collect())
    store.fold(RAW_EVENTS, store.dates(RAW_EVENTS))
    store.vacuum()
    assert names() == ["a", "c"]


def test_newest_and_positions(make_events):
    events = make_events([{"id": k, "timestamp": T0 + dt.timedelta(seconds=20 * (k // 3))} for k in range(60)])
    for n in (2, 7, 59, 100):
        assert sorted(r.id for r in newest(events, n).collect()) == list(range(max(0, 60 - n), 60))
    seen, position = [], None
    while (page := events_after(events, position, 25)).count():
        seen += [r.id for r in page.collect()]
        position = next_position(page)
    assert seen == list(range(59, -1, -1))
    assert next_position(events.limit(0)) is None
    assert events_after(events, Position(T0, 1), 5).collect()[0].id == 0


def test_newest_events_of_a_store_read_late_dates_only(store, make_events):
    rows = [{"id": k, "timestamp": T0 + dt.timedelta(hours=6 * k), "branch": "ab"[k % 2], "blocked": k % 3 == 0} for k in range(40)]
    store.write_events(0, make_events(rows))
    store.write_rollups(0, CategoryRules())
    store.commit(0)
    assert sorted(r.id for r in store.newest_events(3).collect()) == [37, 38, 39]
    assert sorted(r.id for r in store.newest_events(4, branch="a").collect()) == [32, 34, 36, 38]
    assert sorted(r.id for r in store.newest_events(3, blocked_only=True).collect()) == [33, 36, 39]
    assert store.newest_events(500).count() == 40
    assert len({r.event_date for r in store.newest_events(3).select("event_date").collect()}) <= 2


def test_carried_minutes_answer_like_all_minutes(spark):
    dice = random.Random(9)
    minutes = sorted({T0 + dt.timedelta(minutes=dice.randrange(3000)) for _ in range(300)})
    rows = spark.createDataFrame([("a", m, 1 + k) for k, m in enumerate(minutes)], "branch string, bucket_ts timestamp_ntz, total_requests bigint")
    carried = carried_minutes(rows)
    kept = {r.bucket_ts: r.total_requests for r in carried.collect()}
    for back in (0, 17, 59):
        start = minutes[-1] - dt.timedelta(minutes=back)
        wanted = [m for m in minutes if m + dt.timedelta(minutes=1) <= start][-10:]
        assert [m for m in sorted(kept) if m + dt.timedelta(minutes=1) <= start][-10:] == wanted
    assert len(kept) < len(minutes)
    window = lambda t: spark.createDataFrame([("a", t)], "branch string, timestamp timestamp_ntz")
    assert outside_carried(window(minutes[-1]), carried).count() == 0
    assert outside_carried(window(minutes[-1] - dt.timedelta(hours=3)), carried).count() == 1


def test_every_progress_report_is_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(105):
        (tmp_path / "in" / f"{k}.txt").write_text("line\n" * (1 + k % 3))
    log = ProgressLog(spark, str(tmp_path / "progress"))
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert len(query.recentProgress) <= 100
        for _ in range(300):
            rows = log.rows().where("input_rows > 0")
            if rows.count() == 105:
                break
            __import__("time").sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert rows.agg(F.sum("input_rows")).first()[0] == 210 and rows.select("batch_id").distinct().count() == 105
    assert log.drop_before(dt.datetime(2000, 1, 1)) == 0 and log.drop_before(dt.datetime(2100, 1, 1)) >= 105


def test_full_feed_batches_are_dealt_over_lanes(spark):
    """Every row has one lane; whole batches are spread, and only what is left of a branch in a task is in lane 0."""
    from trafficloom.streaming.feed import _dealer

    rows = spark.range(5_000).selectExpr("id", "if(id % 7 = 0, null, 'busy') AS branch").repartition(3)
    dealt = rows.mapInArrow(_dealer(20, 8), "id bigint, branch string, lane int")
    counts = {(r.branch, r.lane): r["count"] for r in dealt.groupBy("branch", "lane").count().collect()}
    assert sorted(r.id for r in dealt.collect()) == list(range(5_000))
    assert all(n % 20 == 0 for (_, lane), n in counts.items() if lane > 0)
    assert all(n < 3 * 20 for (_, lane), n in counts.items() if lane == 0)
    busy = [n for (branch, _), n in counts.items() if branch == "busy"]
    assert max(busy) <= sum(busy) / 8 + 3 * 20
