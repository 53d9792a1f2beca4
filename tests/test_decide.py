"""The decision machine: the model's cases one by one, then properties over random commands."""

from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.operators.decide import Machine, Seat, decide

T0 = datetime(2026, 9, 1, 10)


def run(*commands, timed=True):
    """Outcomes of (command, hold) or a time at which timers fire."""
    m, out = Machine(Seat(), timed=timed), []
    for c in commands:
        if isinstance(c, datetime):
            out += [x[1:3] for x in m.due(c)]
        else:
            name, hold, *rest = c
            got = m.apply(name, hold, "booking-1", "why", rest[0] if rest else T0)
            out.append(got[:2] if got else None)
    return out, m


def test_cases():
    hold1, hold2, release1 = ("HoldSeat", "h1"), ("HoldSeat", "h2"), ("ReleaseSeatHold", "h1")
    held, refused, again = ("event", "SeatHeld"), ("reply", "SeatUnavailable"), ("reply", "SeatHeld")
    freed, still = ("event", "SeatHoldReleased"), ("reply", "SeatHoldReleased")
    ended = ("event", "SeatHoldExpired")
    assert run(hold1)[0] == [held] and run(hold1)[1].seat.timers == [(T0, "h1")]
    assert run(hold1, hold2)[0] == [held, refused]
    assert run(hold1, hold1)[0] == [held, again] and len(run(hold1, hold1)[1].seat.timers) == 1
    assert run(hold1, release1)[0] == [held, freed]
    assert run(hold1, release1, release1)[0] == [held, freed, still]
    assert run(hold1, release1, hold2)[0] == [held, freed, held] and run(hold1, release1, hold2)[1].seat.version == 3
    assert run(hold1, T0)[0] == [held, ended] and not run(hold1, T0)[1].held
    assert run(hold1, release1, T0)[0] == [held, freed]
    assert run(hold1, release1, ("HoldSeat", "h2", T0 + timedelta(hours=1)), T0)[0] == [held, freed, held]
    assert run(("SeatHeld", "h1"))[0] == [None]
    assert run(("HoldSeat", "h1", None))[1].seat.timers == [(datetime(1970, 1, 1), "h1")]


def test_an_old_timer_ends_a_new_hold_of_the_same_id():
    out, m = run(("HoldSeat", "h1"), ("ReleaseSeatHold", "h1"), ("HoldSeat", "h1", T0 + timedelta(hours=1)), T0)
    assert out[-1] == ("event", "SeatHoldExpired") and not m.held


def test_said_again_gives_what_was_stored():
    m = Machine(Seat())
    m.apply("HoldSeat", "h1", "booking-1", "", T0)
    assert m.apply("HoldSeat", "h1", "booking-2", "", T0 + timedelta(days=1)) == ("reply", "SeatHeld", "h1", "booking-1", "", T0)


commands = st.lists(st.tuples(st.sampled_from(["HoldSeat", "ReleaseSeatHold"]), st.sampled_from(["a", "b", "c"]), st.integers(0, 5)), max_size=40)


@settings(max_examples=200, deadline=None)
@given(commands)
def test_versions_are_gapless_and_one_hold_lives(found):
    m, versions, now = Machine(Seat()), [], T0
    for name, hold, hours in found:
        now += timedelta(hours=1)
        for _ in m.due(now):
            versions.append(m.seat.version)
        got = m.apply(name, hold, "b", "", now + timedelta(hours=hours))
        if got[0] == "event":
            versions.append(m.seat.version)
        assert m.held == bool(m.seat.hold)
    assert versions == list(range(1, len(versions) + 1))


@settings(max_examples=100, deadline=None)
@given(commands)
def test_replaying_answered_commands_appends_nothing_new_for_a_live_hold(found):
    m = Machine(Seat(), timed=False)
    for name, hold, _ in found:
        m.apply(name, hold, "b", "", T0)
        before = m.seat.version
        assert m.apply(name, hold, "b", "", T0)[0] == "reply"
        assert m.seat.version == before


def test_long_stream_crosses_batches(spark):
    rows = [("s", i, T0 + timedelta(seconds=i), "HoldSeat" if i % 2 == 0 else "ReleaseSeatHold", f"h{i // 2}", "b", "", None) for i in range(25_000)]
    df = spark.createDataFrame(rows, "stream_id string, event_id long, ts timestamp_ntz, command string, hold_id string, booking_id string, reason string, expires_at timestamp_ntz")
    last = decide(df).orderBy("event_id", ascending=False).first()
    assert last.version == 25_000 and decide(df).filter("kind = 'event'").count() == 25_000
    assert decide(df.limit(0)).count() == 0


def test_race(spark):
    """Commands of one snapshot: one wins each round; with no retries left the losers have a conflict."""
    from tidelog.operators.decide import race

    rows = [("s", i, T0, c, h, f"b{i}", "", None) for i, (c, h) in enumerate([("ReleaseSeatHold", "h0"), ("HoldSeat", "h1"), ("HoldSeat", "h2"), ("HoldSeat", "h1"), ("ReleaseSeatHold", "h9"), ("Other", "h")])]
    commands = spark.createDataFrame(rows, "stream_id string, event_id long, ts timestamp_ntz, command string, hold_id string, booking_id string, reason string, expires_at timestamp_ntz")
    state = spark.createDataFrame([("x", "held", "h", "b", None, 3, None)], "stream_id string, status string, hold_id string, booking_id string, expires_at timestamp, version int, error string")
    got = {r.event_id: (r.kind, r.type, r.version, r.attempts, r.error) for r in race(commands, state).collect()}
    assert got == {0: ("reply", "SeatHoldReleased", 0, 1, None), 1: ("event", "SeatHeld", 1, 1, None), 2: ("reply", "SeatUnavailable", 1, 2, None), 3: ("reply", "SeatHeld", 1, 2, None), 4: ("reply", "SeatHoldReleased", 0, 1, None)}
    lost = {r.event_id: (r.kind, r.attempts, r.error) for r in race(commands, state, retries=0).collect()}
    assert lost[2] == lost[3] == (None, 1, "version conflict") and lost[1][0] == "event"
    broken = state.selectExpr("'s' as stream_id", "status", "hold_id", "booking_id", "expires_at", "version", "'v1: malformed' as error")
    assert {r.error for r in race(commands, broken).collect()} == {"v1: malformed"}
