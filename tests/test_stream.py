"""The forward run as a stateful stream, against a plain walk over its events."""

import itertools
import random

import pytest

from panelforge.sources import versions
from panelforge.streaming import forward_run
from panelforge.streaming.forward_run import Progress, walk

EVENTS = "protocol string, event_id string, kind string, trade_date string, ts timestamp"


def event(protocol, n, kind, day, at):
    return (protocol, f"{protocol}-{n}", kind, day, at)


def ms(day, hour=12):
    return forward_run.end_of_day(day) - (24 - hour) * 3_600_000


def told(events, through=1e18):
    """Log rows (event_type, day, reason) of (kind, day, ms) events, and the state."""
    state = Progress()
    out, _ = walk("p", state, [(at, f"{i:03d}", kind, day) for i, (kind, day, at) in enumerate(events)], through)
    return [r[2:5] for r in out], state


def calendar(*days):
    return [("calendar", d, 0) for d in days]


def test_activation_and_what_is_due():
    days = calendar("20240101", "20240103", "20240104", "20240105", "20240108")
    out, state = told([*days, ("data", "20240101", 1), ("check", "20240102", ms("20240102"))], ms("20240102"))
    assert out == [("forward_tracking_activated", "20240103", "active"), ("due_check", "20240102", "not_due_yet")] and state.next_signal() == "20240105"
    out, state = told([*days, ("data", "20240103", 1), ("check", "20240103", ms("20240103"))], ms("20240103"))  # not the week's last day
    assert state.activation == "20240104" and state.next_signal() == "20240105" and out[-1] == ("due_check", "20240103", "not_due_yet")
    out, state = told([*calendar("20240105", "20240108"), ("data", "20240104", 1), ("check", "20240105", ms("20240105"))], ms("20240105"))  # bars of a day that isn't open
    assert state.activation is None and out == [("activation_pending", "20240105", "pending_data_update"), ("due_check", "20240105", "no_eligible_signal_date")]
    out, state = told([*calendar("20240111", "20240112", "20240115"), ("data", "20240110", 1), ("check", "20240110", ms("20240110"))], ms("20240110"))
    assert state.activation is None and not any(r[0] == "signal" for r in out)


def test_signals_missed_cycles_and_no_making_up():
    days = calendar(*(f"202401{d:02d}" for d in (2, 3, 4, 5, 8, 9, 10, 11, 12, 15, 16, 17, 18, 19)))
    looks = [("check", "20240102", ms("20240102")), ("data", "20240104", ms("20240104")), ("check", "20240105", ms("20240105")), ("data", "20240105", ms("20240105", 13)), ("check", "20240105", ms("20240105", 14)), ("check", "20240105", ms("20240105", 15)),
             ("check", "20240108", ms("20240108")), ("data", "20240112", ms("20240115")), ("check", "20240116", ms("20240116")), ("data", "20240119", ms("20240119")), ("check", "20240119", ms("20240119", 13))]
    out, state = told([*days, ("data", "20240102", 1), *looks], ms("20240119", 20))
    assert out == [
        ("forward_tracking_activated", "20240103", "active"), ("due_check", "20240102", "not_due_yet"), ("due_check", "20240105", "daily_bar_not_ready"), ("due_check", "20240105", "signal_due"), ("signal", "20240105", "generated"),
        ("due_check", "20240105", "signal_already_generated"), ("due_check", "20240108", "not_due_yet"), ("missed_signal_cycle", "20240112", "missed_signal_cycle"), ("due_check", "20240116", "not_due_yet"), ("due_check", "20240119", "signal_due"), ("signal", "20240119", "generated")]
    assert state.last == "20240119" and state.next_signal() is None


def made_up(protocols=3):
    """Events of several weeks: calendars, bars that are late now and then, looks, some of them repeated."""
    pick, out = random.Random(1), []
    days = [f"202401{d:02d}" for d in range(1, 32) if d % 7 not in (6, 0)]
    for p in (f"p{i}" for i in range(protocols)):
        n = itertools.count()
        out += [event(p, next(n), "calendar", d, "2024-01-01 00:00:00") for d in days]
        for d in days:
            at = f"2024-01-{d[6:]}"
            if pick.random() < 0.8:
                out.append(event(p, next(n), "data", d, f"{at} {pick.randint(10, 16)}:00:00"))
            for _ in range(pick.randint(0, 2)):
                out.append(event(p, next(n), "check", d, f"{at} {pick.randint(10, 20)}:30:00"))
    out += [event(p, "end", "calendar", "20240101", "2024-02-20 00:00:00") for p in ("p0", "p1", "p2")] + [event("later", 0, "calendar", "20240101", "2024-03-01 00:00:00")]
    return out


def plainly(events):
    """The log of all events but the last days', each protocol by itself, in order of time."""
    from datetime import datetime, timezone

    at = lambda t: int(datetime.fromisoformat(t).replace(tzinfo=timezone.utc).timestamp() * 1000)
    out = set()
    for p in {e[0] for e in events}:
        rows, _ = walk(p, Progress(), [(at(e[4]), e[1], e[2], e[3]) for e in set(events) if e[0] == p], at("2024-02-01 00:00:00"))
        out |= set(rows)
    return out


@pytest.mark.parametrize("files", [1, 4])
def test_the_log_does_not_depend_on_arrival(spark, tmp_path, files):
    """Shuffled within two days and repeated, in one run or in several that each go on from the last."""
    events = made_up()
    pick = random.Random(files)
    arrived = sorted(events, key=lambda e: (e[4][:10] + e[4][11:13] if files == 1 else f"{int(e[4][8:10]) // 2 if e[4] < '2024-02' else 99:02d}{pick.random():.6f}"))
    arrived += [e for e in arrived if e[4] < "2024-02" and pick.random() < 0.0] if files == 1 else []
    repeated = [x for e in arrived for x in ([e, e] if pick.random() < 0.2 else [e])]
    log = versions.Table(spark, f"{tmp_path}/log", ["event_id"], forward_run.LOG)
    size = -(-len(repeated) // files)
    for i in range(files):
        spark.createDataFrame([(*e[:4], e[4]) for e in repeated[i * size : (i + 1) * size]], EVENTS.replace("timestamp", "string")).selectExpr("protocol", "event_id", "kind", "trade_date", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        forward_run.run(stream, log, f"{tmp_path}/mark").awaitTermination(300)
    want = plainly(events)
    got = [tuple(r) for r in log.read().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r[2] for r in want} >= {"signal", "missed_signal_cycle", "due_check", "forward_tracking_activated"}


def test_work_grows_with_the_events(spark, tmp_path):
    """Thousands of events of one protocol, some repeated in a later run: as the plain walk says, and soon."""
    import time

    pick, days = random.Random(3), [f"202401{d:02d}" for d in range(1, 29)]
    events = [event("p0", 0, "calendar", "20240101", "2024-01-01 00:00:00")]
    for n in range(1, 12_001):
        d = n * len(days) // 12_001
        kind = pick.choice(["calendar", "data", "check", "check"])
        events.append(event("p0", n, kind, days[min(d + (n % 8 if kind == "calendar" else 0), 27)], f"2024-01-{d + 1:02d} {n % 24:02d}:{pick.randrange(60):02d}:00"))
    end = [event("p0", "end", "calendar", "20240101", "2024-02-20 00:00:00"), event("later", 0, "calendar", "20240101", "2024-03-01 00:00:00")]
    log = versions.Table(spark, f"{tmp_path}/log", ["event_id"], forward_run.LOG)
    start = time.time()
    for some in (events[:9_000], events[8_700:9_000] + events[9_000:] + end):  # those that come again are taken or wait
        spark.createDataFrame(some, EVENTS.replace("timestamp", "string")).selectExpr("protocol", "event_id", "kind", "trade_date", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        forward_run.run(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), log, f"{tmp_path}/mark").awaitTermination(100)
        assert time.time() - start < 100
    assert {tuple(r) for r in log.read().collect()} == plainly([*events, *end])
