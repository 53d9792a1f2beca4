"""The seat service as streaming queries.

Deduplication, folding, decisions and timers live in one stateful operator keyed
by stream, so a stream has one owner in a batch, conflicts cannot arise, and a
batch's effects are committed together by its checkpoint. Outgoing rows are
tagged by kind: event, reply or timer.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import ConsumerConfig
from ..operators.decide import Machine, Seat
from ..operators.projection import guarded_upsert
from ..operators.queues import dead_letter, settle, stall_gate

_KINDS = {"string": T.StringType(), "timestamp": T.TimestampType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "long": T.LongType()}


def _struct(columns: str) -> T.StructType:
    """A schema from "name type, ..."; unlike a DDL string it needs no session, which workers have not."""
    return T.StructType([T.StructField(n, _KINDS[t]) for n, t in (x.split() for x in columns.split(", "))])


OUT = _struct("stream_id string, ce_id string, kind string, type string, hold_id string, booking_id string, reason string, expires_at timestamp, version int, correlation_id string, causation_id string")
_STATE = _struct("version int, held boolean, hold_id string, booking_id string, expires_us long, correlation_id string")
_TIMER = _struct("fire_us long, token string")
_SEEN = _struct("source string, ce_id string")
_AT = _struct("seen_us long")
_NEXT = _struct("prune_us long")

#: How long a stream remembers which commands it has seen.
RETENTION = timedelta(days=7)

_EPOCH = datetime(1970, 1, 1)


def _naive(time: datetime | None) -> datetime | None:
    """UTC without a zone, whichever form the worker was given."""
    return time.astimezone(timezone.utc).replace(tzinfo=None) if time is not None and time.tzinfo is not None else time


def _micros(time: datetime | None) -> int | None:
    return None if time is None else (time - _EPOCH) // timedelta(microseconds=1)


def _time(micros: int | None) -> datetime | None:
    return None if micros is None else _EPOCH + timedelta(microseconds=micros)


class SeatProcessor(StatefulProcessor):
    """Commands in, events and replies out, for one stream.

    Commands seen are forgotten after a retention, in event time: a timer wakes the
    stream once a retention has passed and takes out what is older, so the state of
    a stream follows its recent commands, not its history.
    """

    def __init__(self, retention: timedelta = RETENTION):
        self.retention_us = retention // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seat", _STATE)
        self.timers = handle.getListState("timers", _TIMER)
        self.seen = handle.getMapState("inbox", _SEEN, _AT)
        self.next = handle.getValueState("prune", _NEXT)

    def _machine(self) -> tuple[Machine, str]:
        value = self.state.get() if self.state.exists() else (0, False, "", "", None, "")
        pending = sorted((_time(t[0]), t[1]) for t in self.timers.get()) if self.timers.exists() else []
        self.before = list(pending)
        return Machine(Seat(value[0], value[2], value[3], _time(value[4]), pending), held=value[1]), value[5]

    def _save(self, machine: Machine, correlation: str) -> None:
        seat = machine.seat
        self.state.update((seat.version, machine.held, seat.hold, seat.booking, _micros(seat.deadline), correlation))
        if sorted(seat.timers) != self.before:
            self.timers.clear()
            for fire_at, token in seat.timers:
                self.timers.appendValue((_micros(fire_at), token))

    def _remember(self, source: str, ce_id: str, at_us: int) -> None:
        self.seen.updateValue((source, ce_id), (at_us,))
        if not self.next.exists():
            wake = at_us + self.retention_us
            self.next.update((wake,))
            self.handle.registerTimer(wake // 1000)

    def _forget(self, now_us: int) -> None:
        """Takes out what is older than the retention, and wakes again when the oldest of the rest will be."""
        if not self.next.exists() or self.next.get()[0] // 1000 * 1000 > now_us:
            return
        self.next.clear()
        left, old = None, []
        for key, (at_us,) in self.seen.iterator():
            if at_us + self.retention_us <= now_us:
                old.append(tuple(key))
            else:
                left = at_us if left is None else min(left, at_us)
        for key in old:
            self.seen.removeKey(key)
        if left is not None:
            self.next.update((left + self.retention_us,))
            self.handle.registerTimer((left + self.retention_us) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        machine, correlation = self._machine()
        for r in sorted(rows, key=lambda r: (r.ts, r.ce_id)):
            if self.seen.containsKey((r.source, r.ce_id)):
                continue
            self._remember(r.source, r.ce_id, _micros(_naive(r.ts)))
            for _, *out in machine.due(_naive(r.ts)):  # deadlines that this batch has passed come first
                yield self._row(key[0], out, machine.seat.version, correlation, "")
            before = len(machine.seat.timers)
            out = machine.apply(r.command, r.hold_id, r.booking_id, r.reason, _naive(r.expires_at))
            if out is None:
                yield self._row(key[0], ("error", r.command, r.hold_id, r.booking_id, "unknown command", None), machine.seat.version, r.correlation_id, r.ce_id)
                continue
            if out[0] == "event":
                correlation = r.correlation_id
            if len(machine.seat.timers) > before:
                self.handle.registerTimer(_micros(_naive(r.expires_at) or _EPOCH) // 1000)
            yield self._row(key[0], out, machine.seat.version, r.correlation_id, r.ce_id)
        self._save(machine, correlation)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        machine, correlation = self._machine()
        now_us = (expiredTimerInfo.getExpiryTimeInMs() + 1) * 1000 - 1
        for _, *out in machine.due(_time(now_us)):
            yield self._row(key[0], out, machine.seat.version, correlation, "")
        self._save(machine, correlation)
        self._forget(now_us)

    @staticmethod
    def _row(stream: str, out: tuple | list, version: int, correlation: str, causation: str) -> Row:
        kind, name, hold, booking, reason, deadline = out
        return Row(stream_id=stream, ce_id=f"{stream}/{version}/{kind}/{causation}", kind=kind, type=name, hold_id=hold, booking_id=booking, reason=reason, expires_at=deadline, version=version, correlation_id=correlation, causation_id=causation)


def seat_service(commands: DataFrame, lateness: str = "1 hour", retention: timedelta = RETENTION) -> DataFrame:
    """Events, replies and errors of a stream of commands: stream_id, ce_id, source, ts (timestamp), command, hold_id, booking_id, reason, expires_at, correlation_id.

    A command that comes again within the retention does nothing; retention should
    be longer than lateness, since older commands are dropped before they arrive.
    """
    return commands.withWatermark("ts", lateness).groupBy("stream_id").transformWithState(SeatProcessor(retention), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def dead_letters(out: DataFrame, topic: str, prefix: str = "dlq_") -> DataFrame:
    """The error rows of the service as dead letters: the command's key and id, and why it could not be applied."""
    bad = out.filter("kind = 'error'")
    headers = F.create_map(F.lit("ce_id"), F.col("causation_id"), F.lit("ce_type"), F.col("type"), F.lit("ce_subject"), F.col("stream_id"), F.lit(f"{prefix}topic"), F.lit(topic), F.lit(f"{prefix}error"), F.col("reason"))
    payload = F.encode(F.to_json(F.struct("hold_id", "booking_id")), "UTF-8")
    return bad.select(F.lit(f"{topic}.dlq").alias("topic"), F.col("stream_id").alias("key"), payload.alias("payload"), headers.alias("headers"))


def first_deliveries(deliveries: DataFrame, retention: str = "7 days") -> DataFrame:
    """A stream without repeated inbox keys inside the retention window."""
    return deliveries.withWatermark("ts", retention).dropDuplicatesWithinWatermark(["consumer", "source", "event_id"])


def _started(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    """Runs all there is and ends, or with `every` goes on in batches that far apart."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def keep_view(events: DataFrame, read_view: Callable[[], DataFrame], write_view: Callable[[DataFrame, int], None], fold_new: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Maintains a view batch by batch with the version guard; a repeated batch changes nothing."""

    def step(batch: DataFrame, number: int) -> None:
        write_view(guarded_upsert(read_view(), fold_new(batch)), number)

    return _started(events.writeStream.foreachBatch(step), checkpoint, every)


class Unsettled(RuntimeError):
    """Records that could be neither handled nor dead-lettered; the batch is not committed, so it comes again."""


def route(records: DataFrame, handle: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int], None] | None, checkpoint: str, config: ConsumerConfig = ConsumerConfig(), every: str | None = None) -> StreamingQuery:
    """Handles each batch of records and sends failures to dead letters: `handle` adds error and failures.

    Without dead letters (dead is None, or config says so) a failure is unsettled:
    its partition stalls there. What comes before it is done, other partitions go
    on, and the query fails with Unsettled, so that the batch comes again when it
    is restarted; consumers drop what they have seen. The same holds if `dead`
    raises.
    """

    def step(batch: DataFrame, number: int) -> None:
        found = handle(batch)
        attempts, outcome = settle(F.col("error"), F.col("failures"), config.max_attempts)
        judged = found.withColumn("attempts", attempts).withColumn("outcome", outcome).persist()
        failed = F.col("outcome") == "dlq"
        try:
            if dead is None or not config.dead_letters:
                why = "no dead letters are kept" if judged.filter(failed).head() else ""
            else:
                try:
                    dead(dead_letter(judged.filter(failed), F.col("error"), config.dead_letter_prefix), number)
                    why = ""
                except Exception as e:  # noqa: BLE001
                    why = f"dead letters: {e}"
            settled = stall_gate(judged, failed) if why else judged
            done(settled.filter("outcome = 'done'"), number)
            if why:
                raise Unsettled(why)
        finally:
            judged.unpersist()

    return _started(records.writeStream.foreachBatch(step), checkpoint, every)


def run_all(queries: list[StreamingQuery], poll_s: float = 0.2) -> None:
    """Waits until one query ends, then stops the others; the failure of any is raised."""
    try:
        while all(q.isActive for q in queries):
            time.sleep(poll_s)
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
    for q in queries:
        if q.exception() is not None:
            raise q.exception()
