"""Operators one by one on small inputs, and the shapes of their plans."""

import re
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import codec, envelope, scalars, wire
from tidelog.operators import eventlog, fold, projection, queues
from tidelog.plans import queries
from tidelog.schemas import type_name
from tidelog.sources.registry import Registry, default_registry, ensure_backward, one_level

NOW = datetime(2026, 9, 1)
FOLDER = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


EVENT = "array<struct<type:string,data:string>>"


def appended(spark, log, batches):
    log = spark.createDataFrame(log, "stream_id string, version int")
    rows = spark.createDataFrame(batches, f"batch_id long, stream_id string, expected_version int, events {EVENT}")
    accepted, refused = eventlog.append(log, rows)
    return sorted((r.batch_id, r.version) for r in accepted.collect()), {r.batch_id: r.error for r in refused.collect()}


def test_append(spark):
    one = [("t", "x")]
    got, refused = appended(
        spark,
        [("a", 1), ("a", 2)],
        [(1, "b", 0, one * 3), (2, "b", 0, one), (3, "a", 2, one), (4, "a", 1, one * 2), (5, "c", 0, []), (6, "d", 7, one), *[(10 + i, "e", 0, one) for i in range(8)]],
    )
    assert set(refused) == {2, 4, *range(11, 18)} and set(refused.values()) == {"version conflict"}
    assert got == [(1, 1), (1, 2), (1, 3), (3, 3), (6, 8), (10, 1)]
    batches = spark.createDataFrame([("a",), ("b",), ("a",)], "stream_id string")
    assert eventlog.load(batches.withColumn("version", F.lit(1)), "nobody").count() == 0
    assert [r.stream_id for r in eventlog.streams(batches).collect()] == ["a", "b"]


def test_a_refused_batch_stands_in_nobodys_way(spark):
    got, refused = appended(spark, [("a", 1), ("a", 2)], [(1, "a", 1, [("t", "x")] * 2), (2, "a", 2, [("t", "x")])])
    assert got == [(2, 3)] and set(refused) == {1}


def test_a_free_version_below_the_head_can_be_taken(spark):
    got, refused = appended(spark, [("g", 1), ("g", 8)], [(1, "g", 2, [("t", "x")]), (2, "g", 5, [("t", "x")] * 3), (3, "g", 3, [("t", "x")] * 4), (4, "g", 0, [("t", "x")])])
    assert got == [(1, 3), (3, 4), (3, 5), (3, 6), (3, 7)] and set(refused) == {2, 4}


def test_an_invalid_event_refuses_its_batch_before_any_write(spark):
    got, refused = appended(spark, [], [(1, "a", 0, [("t", "x"), ("", "x")]), (2, "a", 0, [("t", "")]), (3, "a", 0, [("t", None)]), (4, "a", 0, [("t", "x")])])
    assert got == [(4, 1)] and refused == {1: "event 1: no type", 2: "event 0: no data", 3: "event 0: no data"}


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 4)), max_size=40))
def test_ranges_are_a_set_of_versions(asked):
    ranges, brute = eventlog._Taken(), set()
    for first, size in asked:
        new = set(range(first, first + size))
        free = not new & brute
        assert ranges.claim(first, first + size - 1) == free
        brute |= new if free else set()
        assert {v for a, b in zip(ranges.first, ranges.last, strict=True) for v in range(a, b + 1)} == brute
        assert all(b + 1 < a for b, a in zip(ranges.last, ranges.first[1:], strict=False))


def test_append_seat_encodes(spark):
    message = "struct<message:string,hold_id:string,booking_id:string,seat_id:string,reason:string,expires_at:timestamp>"
    rows = [(1, "s", 0, [("SeatHeld", "h", "b", "s", "", NOW)], "flow"), (2, "s", 1, [("NoSuchMessage", "h", "b", "s", "", None)], "flow")]
    batches = spark.createDataFrame(rows, f"batch_id long, stream_id string, expected_version int, events array<{message}>, correlation_id string")
    accepted, refused = eventlog.append_seat(spark.createDataFrame([], "stream_id string, version int"), batches)
    (row,) = accepted.collect()
    assert (row.version, row.event.type, row.event.meta) == (1, type_name("SeatHeld"), '{"correlation_id":"flow"}')
    assert row.event.data == '{"hold_id":"h","booking_id":"b","seat_id":"s","expires_at":"2026-09-01T00:00:00Z"}'
    assert [(r.batch_id, r.error) for r in refused.collect()] == [(2, "event 0: no data")]


def seat_log(spark, *events):
    rows = [("s", i + 1, type_name(kind), data, '{"correlation_id":"saga-1"}') for i, (kind, data) in enumerate(events)]
    return spark.createDataFrame(rows, "stream_id string, version int, type string, data string, meta string")


HELD = ("SeatHeld", '{"hold_id":"h1","booking_id":"b1","seat_id":"s","expires_at":"2026-09-01T10:00:00Z"}')


@pytest.mark.parametrize("how", [fold.fold, fold.fold_ordered])
def test_fold(spark, how):
    state = lambda *e: how(seat_log(spark, *e)).first()
    s = state(HELD)
    assert (s.status, s.hold_id, s.booking_id, s.version, s.expires_at.hour, s.error) == ("held", "h1", "b1", 1, 10, None)
    s = state(HELD, ("SeatHoldReleased", '{"hold_id":"h1"}'))
    assert (s.status, s.hold_id, s.booking_id, s.expires_at, s.version) == ("free", "", "", None, 2)
    s = state(("HoldSeat", "{}"), HELD)
    assert (s.error, s.status, s.hold_id, s.version) == ("unknown event", None, None, None)
    assert state(("SeatHeld", '{"hold_id":')).error == "v1: malformed"
    assert state(HELD, ("SeatHeld", '{"colour":"red"}'), ("SeatHeld", "{"), HELD).error == "v2: unknown field colour"
    assert state(("HoldSeat", "{}"), ("SeatPainted", "{}")).error == "v2: unknown type"
    assert state(("SeatHeld", '{"hold_id":"h1"}')).expires_at == datetime(1970, 1, 1)


def test_view_guard(spark):
    view = spark.createDataFrame([("s", "held", "new", "b", None, 9)], "seat_id string, status string, hold_id string, booking_id string, expires_at timestamp, version int")
    log = seat_log(spark, HELD)
    told = spark.createDataFrame([("s",), ("nobody",), ("",)], "subject string")
    assert projection.project(view, log, told).first().hold_id == "new"
    once = projection.project(view.limit(0), log, told)
    assert once.collect() == projection.project(once, log, told).collect() == projection.rebuild(log).collect()
    assert once.first().version == 1


def test_rebuild_is_whole_or_fails(spark, tmp_path):
    log = seat_log(spark, HELD, ("SeatHeld", '{"hold_id":'))
    with pytest.raises(Exception, match="cannot fold s: v2: malformed"):
        projection.rebuild(log).collect()
    with pytest.raises(Exception, match="cannot fold"):
        projection.rebuild_into(log, str(tmp_path))
    good, bad = projection.split(fold.fold(log))
    assert good.count() == 0 and [(r.stream_id, r.error) for r in bad.collect()] == [("s", "v2: malformed")]
    told = spark.createDataFrame([("s",)], "subject string")
    assert projection.project(good, log, told).count() == 0
    assert [r.error_class for r in projection.notification_errors(log, told).collect()] == ["transient"]
    path = projection.rebuild_into(seat_log(spark, HELD), str(tmp_path))
    assert spark.read.parquet(path).first().hold_id == "h1"


def test_prefix_is_a_pattern(spark):
    view = spark.createDataFrame([("seat-BA_17", "held"), ("seat-BAx17", "held"), ("seat-BA_18", "free")], "seat_id string, status string")
    assert [r.seat_id for r in projection.held_seats(view, "seat-BA_1").collect()] == ["seat-BA_17", "seat-BAx17"]


def test_prunes(spark):
    rows = [(1, NOW - timedelta(days=30)), (2, NOW - timedelta(days=7)), (3, NOW), (4, None)]
    box = spark.createDataFrame(rows, "id long, published_at timestamp_ntz")
    as_of = F.lit(NOW).cast("timestamp_ntz")
    assert [r.id for r in queues.prune_outbox(box, as_of).orderBy("id").collect()] == [2, 3, 4]
    fired = box.withColumnRenamed("published_at", "fired_at")
    assert [r.id for r in queues.prune_timers(fired, as_of).orderBy("id").collect()] == [3, 4]
    seen = box.filter("id < 4").select(F.lit("c").alias("consumer"), F.lit("s").alias("source"), F.col("id").cast("string").alias("event_id"), F.col("published_at").alias("handled_at"))
    left = queues.prune_inbox(seen, as_of)
    assert {r.event_id for r in left.collect()} == {"2", "3"}
    assert {r.event_id for r in queues.unseen(seen, left).collect()} == {"1"}


def test_status(spark):
    assert one(spark, scalars.parse_status(F.lit("held"))) == "held"
    for bad in ("unknown", None):
        with pytest.raises(Exception, match="unknown status"):
            one(spark, scalars.parse_status(F.lit(bad).cast("string")))
    assert one(spark, scalars.refusal_reason(F.lit("held"))) == "seat is held"


def test_framing(spark):
    framed = one(spark, scalars.frame(F.lit(258), F.encode(F.lit("body"), "UTF-8")))
    assert bytes(framed) == b"\x00\x00\x00\x01\x02\x00body"
    for raw, error in ((b"\x01\x00\x00\x01\x02\x00b", "bad frame"), (b"\x00\x00", "bad frame"), (b"\x00\x00\x00\x00\x07\x00", None)):
        found = one(spark, scalars.unframe(F.lit(raw)))
        assert found.error == error and (error or (found.schema_id, bytes(found.body)) == (7, b""))


def test_new_id(spark):
    ids = [one(spark, scalars.new_id(F.lit(NOW + timedelta(hours=h)), F.lit(f"k{h}"))) for h in range(4)]
    assert ids == sorted(ids) and len(set(ids)) == 4
    assert all(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", x) for x in ids)


def test_envelope(spark):
    full = envelope.render(**{a: F.lit(a) for a in [*envelope.MANDATORY, *envelope.OPTIONAL]})
    assert len(one(spark, full)) == 9
    bare = envelope.render(**{a: F.lit(a) for a in envelope.MANDATORY}, subject=F.lit(""))
    assert len(one(spark, bare)) == 5 and one(spark, envelope.parse(bare)).error is None
    for missing in ("ce_specversion", "ce_id", "ce_source", "ce_type"):
        got = one(spark, envelope.parse(F.map_filter(full, lambda k, _: k != missing)))  # noqa: B023
        assert got.error == f"missing attribute {missing}"
    old = F.transform_values(full, lambda k, v: F.when(k == "ce_specversion", "0.3").otherwise(v))
    assert one(spark, envelope.parse(old)).error == "unsupported ce_specversion 0.3"


def test_codec(spark):
    data = codec.encode("SeatHeld", hold_id=F.lit("h"), booking_id=F.lit(""), seat_id=F.lit("s"), expires_at=F.lit("2026-09-01 10:00:00.25").cast("timestamp"))
    assert one(spark, data) == '{"hold_id":"h","seat_id":"s","expires_at":"2026-09-01T10:00:00.250Z"}'
    back = one(spark, codec.decode(F.lit(type_name("SeatHeld")), data))
    assert (back.hold_id, back.booking_id, back.expires_at.microsecond, back.error) == ("h", "", 250_000, None)
    decode = lambda kind, text: one(spark, codec.decode(F.lit(kind), F.lit(text))).error
    assert decode("no.such.Type", "{}") == "unknown type"
    assert decode(type_name("SeatHeld"), '{"hold_id"') == "malformed"
    assert decode(type_name("SeatHeld"), '{"reason":"x"}') == "unknown field reason"


def test_delivery(spark):
    rows = [("t", 0, i, e, n) for i, (e, n) in enumerate([(None, 0), ("malformed", 9), ("down", 2), ("down", 5), ("unknown event", 7)])]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, error string, failures int")
    attempts, outcome = queues.settle(F.col("error"), F.col("failures"))
    got = [(r.a, r.o) for r in df.select("offset", attempts.alias("a"), outcome.alias("o")).orderBy("offset").collect()]
    assert got == [(1, "done"), (1, "dlq"), (3, "done"), (5, "dlq"), (5, "dlq")]
    gated = queues.stall_gate(df.union(df.withColumn("partition", F.lit(1))), (F.col("partition") == 0) & (F.col("offset") == 2))
    assert sorted((r.partition, r.offset) for r in gated.collect()) == [(0, 0), (0, 1), *[(1, i) for i in range(5)]]


def test_enqueue_ids_do_not_meet(spark):
    message = "array<struct<topic:string,key:string,payload:binary>>"
    few, many = [("t", "k", b"x")] * 2, [("t", "k", b"x")] * 3000
    batches = spark.createDataFrame([(1, many), (2, few), (3, [("t", "k", b"x"), ("t", "", b"x")]), (4, [])], f"batch long, messages {message}")
    rows, refused = queues.enqueue(batches, first_id=7)
    ids = [r.id for r in rows.orderBy("batch", "at").collect()]
    assert len(ids) == 3002 == len(set(ids)) and ids == sorted(ids) and min(ids) >= 7
    assert [(r.batch, r.error) for r in refused.collect()] == [(3, "message 1: no key")]


def test_drain_goes_on_until_a_batch_is_not_full(spark):
    box = spark.createDataFrame([(i, None if i % 2 else NOW) for i in range(20)], "id long, published_at timestamp_ntz")
    as_of, sent = F.lit(NOW).cast("timestamp_ntz"), []
    after, count, failure = queues.drain(box, lambda b: sent.append([r.id for r in b.collect()]), as_of, limit=4)
    assert sent == [[1, 3, 5, 7], [9, 11, 13, 15], [17, 19]] and count == 10 and failure is None
    assert after.filter("published_at is null").count() == 0

    def down(batch):
        if batch.first().id > 1:
            raise ConnectionError("down")

    after, count, failure = queues.drain(box, down, as_of, limit=4)
    assert count == 4 and str(failure) == "down"
    assert [r.id for r in after.filter("published_at is null").orderBy("id").collect()] == [9, 11, 13, 15, 17, 19]


def test_one_failing_timer_leaves_the_others(spark):
    log = seat_log(spark, HELD).unionByName(seat_log(spark, ("SeatHeld", "{")).withColumn("stream_id", F.lit("broken")))
    timers = spark.createDataFrame([(1, "broken", "h1"), (2, "s", "h1"), (3, "s", "old"), (4, "nobody", "h1")], "id long, subject string, token string").withColumns({"fire_at": F.lit(NOW), "fired_at": F.lit(None).cast("timestamp")})
    found = queues.fire(timers, fold.fold(log), F.lit(NOW))
    assert {r.id: (r.outcome, r.version) for r in found.collect()} == {1: ("failed", None), 2: ("expired", 2), 3: ("stale", None), 4: ("stale", None)}
    assert queues.fire(timers, fold.fold(log), F.lit(NOW), limit=2).count() == 2
    after = queues.mark_fired(timers, found.filter("outcome <> 'failed'"), F.lit(NOW))
    assert [r.id for r in after.filter("fired_at is null").collect()] == [1]


def test_offsets_never_go_back(spark):
    settled = spark.createDataFrame([("t", 0, 4), ("t", 1, 9)], "topic string, partition int, offset long")
    earlier = spark.createDataFrame([("t", 0, 8), ("t", 2, 1)], "topic string, partition int, next_offset long")
    assert {r.partition: r.next_offset for r in queues.committed_offsets(settled, earlier).collect()} == {0: 8, 1: 10, 2: 1}


def test_wire_bytes(spark):
    """Byte by byte as the format's rules give them."""
    held = wire.encode("SeatHeld", hold_id=F.lit("h"), booking_id=F.lit("b" * 200), seat_id=F.lit(""), expires_at=F.lit("1970-01-01 00:05:00.000001").cast("timestamp"))
    raw = bytes(one(spark, held))
    assert raw == b"\x0a\x01h" + b"\x12\xc8\x01" + b"b" * 200 + b"\x22\x06" + b"\x08\xac\x02" + b"\x10\xe8\x07"
    read = lambda b: one(spark, wire.decode("SeatHeld", F.lit(b)))
    back = read(raw)
    assert (back.hold_id, len(back.booking_id), back.seat_id, back.expires_at.minute, back.expires_at.microsecond, back.error) == ("h", 200, "", 5, 1, None)
    assert read(b"\x3a\x01z\x0a\x01a\x0a\x01b\x48\x05").hold_id == "b"  # other fields are skipped, the last counts
    assert {read(b).error for b in (b"\x0a\x05h", b"\x0a", b"\x0f\x01", b"\x0a\x01\xff")} == {"malformed"}


def test_compatibility_level():
    assert one_level([("NONE", None), ("BACKWARD", None)]) == "BACKWARD"
    with pytest.raises(RuntimeError, match="first"):
        one_level([("BACKWARD", None), (None, "first"), (None, "second")])
    ensure_backward(lambda level: [(level, None)], lambda: [("BACKWARD", None)])
    with pytest.raises(RuntimeError, match="is NONE"):
        ensure_backward(lambda level: [(level, None)], lambda: [("NONE", None)])


def test_registry():
    known = default_registry()
    subject = f"inventory.events-{type_name('SeatHeld')}"
    assert known.lookup(subject) == 3
    with pytest.raises(KeyError):
        Registry().lookup(subject)
    assert known.register(subject, {1: "hold_id string", 2: "booking_id string", 9: "note string"}) == 7
    with pytest.raises(ValueError, match="field 1 changes"):
        known.register(subject, {1: "hold_id int"})


def test_plans(spark):
    log = spark.read.parquet(f"{FOLDER}/events.parquet")
    pushed = plan(log.filter("event_id = 7").select("ts"))
    assert "EqualTo(event_id,7)" in pushed and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in pushed
    for name, user in (("stream_load", 7), ("availability_point", 11)):
        assert f"EqualTo(user_id,{user})" in plan(queries.QUERIES[name](spark, FOLDER)), name
    box = log.selectExpr("event_id as id", "if(event_id % 2 = 0, ts, null) as published_at")
    assert "TakeOrderedAndProject" in plan(queues.claim_pending(box))
    assert "partial_max_by" in plan(fold.fold(seat_log(spark, HELD)))
    assert "partial_min" in plan(queues.next_due(log.selectExpr("ts as fire_at", "cast(null as timestamp) as fired_at")))
