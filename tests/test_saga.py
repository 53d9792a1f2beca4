"""Booking sagas: properties over random events, and the command line."""

from datetime import datetime

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog import __main__ as cli
from tidelog.operators import saga

EVENTS = [done for _, done, _ in saga.STEPS] + [*saga.REFUSALS, "SeatHoldExpired", "SeatConfirmFailed", *saga.CONFIRMED]
STREAMS = st.lists(st.one_of(st.sampled_from(EVENTS).map(lambda e: (e, "")), st.tuples(st.just("StepTimedOut"), st.builds(lambda s, n: f"{s}/{n}", st.sampled_from([x[0] for x in saga.STEPS]), st.integers(1, 6)))), max_size=25)


@given(STREAMS)
def test_an_event_again_asks_for_nothing(events):
    s = saga.Saga()
    s.on("BookingRequested")
    for e in events:
        s.on(*e)
        assert s.on(*e) == []


@given(STREAMS)
def test_only_steps_that_were_asked_for_are_undone_and_once(events):
    s = saga.Saga()
    asked = [c for e in [("BookingRequested", ""), *events] for c in s.on(*e)]
    for ask, _, undo in saga.STEPS:
        assert asked.count(undo) <= 1
        if undo in asked:
            assert asked.index(ask) < asked.index(undo)
    if "ConfirmSeatHold" in asked and s.status == "confirmed":
        assert not {x[2] for x in saga.STEPS} & set(asked)


def test_sagas_do_not_mix(spark):
    rows = [(s, i, 0, e, None) for s in ("a", "b", "c") for i, e in enumerate(["BookingRequested", "SeatHeld", *(["RoomUnavailable"] if s == "b" else ["RoomReserved"])])]
    events = spark.createDataFrame(rows, "saga_id string, event_id long, ts int, type string, token string")
    got = {}
    for r in saga.run(events).orderBy("saga_id", "n").collect():
        got.setdefault(r.saga_id, []).append(r.command)
    assert got == {"a": ["HoldSeat", "ReserveRoom", "CapturePayment"], "b": ["HoldSeat", "ReserveRoom", "ReleaseSeatHold"], "c": ["HoldSeat", "ReserveRoom", "CapturePayment"]}
    assert saga.run(events.limit(0)).count() == 0


def test_a_charge_is_never_repeated_blind(spark):
    requests = spark.createDataFrame([("p1", "s"), ("p1", "s"), ("p2", "s"), ("p3", "s")], "payment_id string, step string")
    attempts = spark.createDataFrame([("p2/s", "p2", "pending", None), ("p3/s", "p3", "succeeded", "r3")], "idempotency_key string, payment_id string, status string, provider_ref string")
    new, judged = saga.charge(requests, attempts)
    assert [(r.idempotency_key, r.status) for r in new.collect()] == [("p1/s", "pending")]
    assert {r.idempotency_key: r.action for r in judged.collect()} == {"p1/s": "charge", "p2/s": "ask", "p3/s": "reply"}
    answers = spark.createDataFrame([("p2/s", True, "r2")], "idempotency_key string, charged boolean, ref string")
    assert {r.idempotency_key: (r.status, r.provider_ref) for r in saga.reconcile(attempts, answers).collect()} == {"p2/s": ("succeeded", "r2"), "p3/s": ("succeeded", "r3")}


def test_overdue(spark):
    at = datetime(2026, 9, 1, 10)
    asked = spark.createDataFrame([("a", "HoldSeat", 1, at), ("b", "HoldSeat", 1, at)], "saga_id string, step string, attempt int, at timestamp")
    replies = spark.createDataFrame([("b", "HoldSeat", at.replace(second=30))], "saga_id string, step string, at timestamp")
    late = lambda s: [r.saga_id for r in saga.overdue(asked, replies, F.lit(at.replace(second=s))).collect()]
    assert late(29) == [] and late(30) == ["a"]


def test_chains_of_any_length_have_roots(spark):
    """A chain of over a hundred, a tree, a missing cause, a circle and what hangs on it."""
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000, None), (1001, 1000), (1002, 1000), (1003, 1001), (2000, 1999), (2001, 2000), (3000, 3002), (3001, 3000), (3002, 3001), (3003, 3002), (4000, 4000)]
    found = saga.causation_roots(spark.createDataFrame(rows[::-1], "event_id long, causation_id long"))
    assert found.dtypes == [("event_id", "bigint"), ("root", "bigint"), ("depth", "int")]
    assert sorted(tuple(r) for r in found.collect()) == [(i, 0, i) for i in range(300)] + [(1000, 1000, 0), (1001, 1000, 1), (1002, 1000, 1), (1003, 1000, 2)]
    assert saga.causation_roots(spark.createDataFrame([], "event_id long, causation_id long")).count() == 0


def test_roots_of_over_a_million_messages(spark):
    n = 1_200_000
    messages = spark.range(n).select(F.col("id").alias("event_id"), F.when(F.col("id") % 6 > 0, F.col("id") - 1).alias("causation_id"))
    found = saga.causation_roots(messages).agg(F.count("*"), F.count_if(F.expr("root <> event_id - event_id % 6 OR depth <> event_id % 6"))).first()
    assert tuple(found) == (n, 0)


def test_command_line(spark, tmp_path, capsys):
    assert cli.main([]) == 2 and "Queries:" in capsys.readouterr().out
    assert cli.main(["streams_distinct", "/root/testdata/sf0.001"]) == 0 and "seat-" in capsys.readouterr().out
    assert cli.main(["streams_distinct", "/root/testdata/sf0.001", f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 15
