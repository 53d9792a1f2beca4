"""The service as streams: restarts, repeats, deadlines, the view and dead letters."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.config import ConsumerConfig
from tidelog.plans.streamed import stream_commands
from tidelog.schemas import AVAILABILITY
from tidelog.sources.sinks import to_files
from tidelog.sources.tables import file_stream
from tidelog.streaming import scheduler, service

SCHEMA = "stream_id string, ce_id string, source string, ts timestamp, command string, hold_id string, booking_id string, reason string, expires_at timestamp, correlation_id string"
T0 = datetime(2026, 9, 1, 10)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def command(ce, hours, name, hold, stream="s", expires=1):
    at = T0 + timedelta(hours=hours)
    return (stream, ce, "/booking", at, name, hold, "b1", "why", at + timedelta(hours=expires), f"saga-{hold}")


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = file_stream(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema)
    to_files(service.seat_service(source), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(service.OUT).parquet(f"{folder}/out").collect()


def test_restart_repeat_and_deadline(rocks, tmp_path):
    out = feed(rocks, tmp_path, [command("c1", 0, "HoldSeat", "h1", expires=100), command("c2", 0.1, "HoldSeat", "h2")])
    assert {(r.kind, r.type) for r in out} == {("event", "SeatHeld"), ("reply", "SeatUnavailable")}
    out = feed(rocks, tmp_path, [command("c1", 0, "HoldSeat", "h1"), command("c3", 0.5, "ReleaseSeatHold", "h1")])  # another process, the first command again
    assert sorted((r.type, r.version) for r in out if r.kind == "event") == [("SeatHeld", 1), ("SeatHoldReleased", 2)]
    assert len(out) == 3
    out = feed(rocks, tmp_path, [command("c4", 1, "HoldSeat", "h4", expires=1)])
    out = feed(rocks, tmp_path, [command("z", 50, "HoldSeat", "hz", stream="other")])  # time passes elsewhere
    ended = [r for r in out if r.type == "SeatHoldExpired"]
    assert [(r.stream_id, r.hold_id, r.version, r.correlation_id, r.causation_id) for r in ended] == [("s", "h4", 4, "saga-h4", "")]


def test_view_is_kept_batch_by_batch(rocks, tmp_path):
    feed(rocks, tmp_path, [command("c1", 0, "HoldSeat", "h1", expires=1000)])
    feed(rocks, tmp_path, [command("c2", 1, "ReleaseSeatHold", "h1")])
    view = {"at": None}

    def read():
        return rocks.read.schema(AVAILABILITY).parquet(view["at"]) if view["at"] else rocks.createDataFrame([], AVAILABILITY)

    def write(df, number):
        path = f"{tmp_path}/view-{number}"
        df.write.mode("overwrite").parquet(path)
        view["at"] = path

    def fold(batch):
        held = F.col("last.type") == "SeatHeld"
        rows = batch.filter("kind = 'event'").groupBy("stream_id").agg(F.max_by(F.struct("type", "hold_id", "booking_id", "expires_at", "version"), "version").alias("last"))
        return rows.select(F.col("stream_id").alias("seat_id"), F.when(held, "held").otherwise("free").alias("status"), F.when(held, F.col("last.hold_id")).otherwise("").alias("hold_id"), F.when(held, F.col("last.booking_id")).otherwise("").alias("booking_id"), F.when(held, F.col("last.expires_at")).alias("expires_at"), "last.version")

    events = file_stream(rocks, f"{tmp_path}/out", service.OUT, max_files=1)
    service.keep_view(events, read, write, fold, f"{tmp_path}/view-checkpoint").awaitTermination()
    row = read().first()
    assert (row.status, row.hold_id, row.version) == ("free", "", 2)


def test_failures_go_to_dead_letters(rocks, tmp_path):
    rows = [("t", f"k{i}", bytearray(b"v"), {"ce_id": str(i)}, 0, i) for i in range(6)]
    schema = "topic string, key string, value binary, headers map<string,string>, partition int, offset long"
    rocks.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/records")
    done, dead = [], []
    handle = lambda df: df.withColumn("error", F.when(F.col("offset") == 1, "malformed").when(F.col("offset") == 2, "down")).withColumn("failures", F.when(F.col("offset") == 2, 3).otherwise(0))
    q = service.route(file_stream(rocks, f"{tmp_path}/records", rocks.createDataFrame([], schema).schema), handle, lambda df, _: done.extend(df.collect()), lambda df, _: dead.extend(df.collect()), f"{tmp_path}/checkpoint")
    q.awaitTermination()
    assert {r.offset for r in done} == {0, 2, 3, 4, 5}
    assert [(r.topic, r.key, r.headers["dlq_offset"], r.headers["dlq_error"], r.headers["ce_id"]) for r in dead] == [("t.dlq", "k1", "1", "malformed", "1")]


def test_without_dead_letters_a_partition_stalls(rocks, tmp_path):
    """What comes before the failure is done, later records of its partition are not, other partitions go on; then the batch comes again."""
    rows = [("t", f"k{i}", bytearray(b"v"), {"ce_id": str(i)}, i % 2, i) for i in range(6)]
    schema = "topic string, key string, value binary, headers map<string,string>, partition int, offset long"
    rocks.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/records")
    source = lambda: file_stream(rocks, f"{tmp_path}/records", rocks.createDataFrame([], schema).schema)
    broken = {"now": True}

    def handle(df):
        return df.withColumn("error", F.when((F.col("offset") == 2) & F.lit(broken["now"]), "malformed")).withColumn("failures", F.lit(0))

    def refuse(df, _):
        raise OSError("no broker")

    for dead, config, why in ((None, ConsumerConfig(), "no dead letters"), (refuse, ConsumerConfig(), "no broker"), (refuse, ConsumerConfig(dead_letters=False), "no dead letters")):
        done = []
        with pytest.raises(Exception, match=why):
            service.route(source(), handle, lambda df, _, done=done: done.extend(df.collect()), dead, f"{tmp_path}/checkpoint", config).awaitTermination()
        assert {r.offset for r in done} == {0, 1, 3, 5}
    broken["now"], done = False, []
    service.route(source(), handle, lambda df, _: done.extend(df.collect()), None, f"{tmp_path}/checkpoint").awaitTermination()
    assert {r.offset for r in done} == set(range(6))


def test_unknown_commands_go_to_dead_letters(rocks, tmp_path):
    out = feed(rocks, tmp_path, [command("c1", 0, "PaintSeat", "h1"), command("c2", 0.1, "HoldSeat", "h1")])
    assert sorted((r.kind, r.type) for r in out) == [("error", "PaintSeat"), ("event", "SeatHeld")]
    (dead,) = service.dead_letters(rocks.read.schema(service.OUT).parquet(f"{tmp_path}/out"), "inventory.commands").collect()
    assert (dead.topic, dead.key, dead.headers["ce_id"], dead.headers["ce_type"], dead.headers["dlq_error"]) == ("inventory.commands.dlq", "s", "c1", "PaintSeat", "unknown command")


def test_commands_seen_are_forgotten_after_the_retention(rocks, tmp_path):
    """The same id is dropped within the retention and is new once time has passed it."""

    def run(rows):
        rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = file_stream(rocks, f"{tmp_path}/in", rocks.createDataFrame([], SCHEMA).schema)
        to_files(service.seat_service(source, retention=timedelta(hours=6)), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        return [r.causation_id for r in rocks.read.schema(service.OUT).parquet(f"{tmp_path}/out").collect() if r.stream_id == "s" and r.kind == "reply"]

    assert run([command("c1", 0, "ReleaseSeatHold", "h1"), command("c2", 5, "ReleaseSeatHold", "h1")]) == ["c1", "c2"]
    assert run([command("c1", 5.5, "ReleaseSeatHold", "h1")]) == ["c1", "c2"]
    run([command("z", 9, "HoldSeat", "hz", stream="other")])  # the watermark passes c1's retention, not c2's
    assert sorted(run([command("c1", 9, "ReleaseSeatHold", "h1"), command("c2", 9, "ReleaseSeatHold", "h1")])) == ["c1", "c1", "c2"]


def test_run_all_stops_the_others_and_raises(rocks, tmp_path):
    rate = rocks.readStream.format("rate").option("rowsPerSecond", 5).load()

    def fail(batch, number):
        raise ValueError("one loop fails")

    good = rate.writeStream.foreachBatch(lambda b, n: None).option("checkpointLocation", f"{tmp_path}/a").trigger(processingTime="100 milliseconds").start()
    bad = rate.writeStream.foreachBatch(fail).option("checkpointLocation", f"{tmp_path}/b").trigger(processingTime="100 milliseconds").start()
    with pytest.raises(Exception, match="one loop fails"):
        service.run_all([good, bad])
    assert not good.isActive and not bad.isActive


def test_scheduler_loop():
    """Failures of any part are told and do not end the loop; sleeps are clamped; pruning is hourly."""
    now, slept, told, pruned = {"t": 0.0}, [], [], []
    ticks = iter([3, ValueError("tick"), 2, 0])
    waits = iter([0.5, None, ValueError("next"), 0.0001])

    def take(it):
        x = next(it)
        if isinstance(x, Exception):
            raise x
        return x

    def sleep(s):
        slept.append(s)
        now["t"] += 1300

    fired = scheduler.run(lambda: take(ticks), lambda: take(waits), lambda: pruned.append(now["t"]), lambda: len(slept) == 4, lambda what, e: told.append((what, str(e))), clock=lambda: now["t"], sleep=sleep)
    assert fired == 5 and slept == [0.5, 1.0, 1.0, 0.005] and told == [("tick", "tick"), ("next", "next")] and pruned == [3900.0]


def test_dedup_within_retention(rocks, tmp_path):
    schema = "consumer string, source string, event_id string, ts timestamp"
    rocks.createDataFrame([("c", "s", "1", T0), ("c", "s", "1", T0), ("d", "s", "1", T0), ("c", "t", "1", T0)], schema).write.parquet(f"{tmp_path}/in")
    out = service.first_deliveries(file_stream(rocks, f"{tmp_path}/in", rocks.createDataFrame([], schema).schema))
    to_files(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert rocks.read.parquet(f"{tmp_path}/out").count() == 3


def test_stream_agrees_with_batch(rocks, tmp_path):
    from tidelog.operators.decide import decide
    from tidelog.sources.tables import commands

    folder = "/root/testdata/sf0.001"
    rows = stream_commands(rocks, folder).collect()
    out = feed(rocks, tmp_path, rows)
    want = decide(commands(rocks, folder), timed=True, until_end=False).select("stream_id", "kind", "type", "hold_id", "version").collect()
    key = lambda r: (r.stream_id, r.kind, r.type, r.hold_id, r.version)
    got = {key(r) for r in out}
    assert {key(r) for r in want} <= got
    assert {k[2] for k in got - {key(r) for r in want}} <= {"SeatHoldExpired"}  # those that only the watermark ends
