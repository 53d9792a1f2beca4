"""The decision state machine over ordered commands.

Commands of a stream are sorted in its partition and flow through one task in
Arrow batches; only the running state is kept, so a stream of any length takes
constant memory (with deadlines: one entry for each pending timer).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = "stream_id string, event_id long, at timestamp_ntz, kind string, type string, hold_id string, booking_id string, reason string, expires_at timestamp_ntz, version int"
_COLUMNS = [x.split()[0] for x in OUTPUT.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.timestamp("us"), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.timestamp("us"), pa.int32()]


class Seat:
    """One stream's state; each method returns (kind, type, hold, booking, reason, deadline) or None."""

    __slots__ = ("booking", "deadline", "hold", "timers", "version")

    def __init__(self, version: int = 0, hold: str = "", booking: str = "", deadline: datetime | None = None, timers: list | None = None):
        self.version, self.hold, self.booking, self.deadline, self.timers = version, hold, booking, deadline, timers or []

    def request(self, hold: str, booking: str, deadline: datetime | None, held: bool) -> tuple:
        if held and self.hold == hold:  # said again, with what was stored
            return "reply", "SeatHeld", hold, self.booking, "", self.deadline
        if held:
            return "reply", "SeatUnavailable", hold, booking, "seat is held", None
        self.version, self.hold, self.booking, self.deadline = self.version + 1, hold, booking, deadline
        return "event", "SeatHeld", hold, booking, "", deadline

    def release(self, hold: str, booking: str, reason: str, held: bool) -> tuple:
        if not held or self.hold != hold:
            return "reply", "SeatHoldReleased", hold, booking, reason, None
        self._free()
        return "event", "SeatHoldReleased", hold, booking, reason, None

    def expire(self, token: str, held: bool) -> tuple | None:
        """Timers are never cancelled and know a hold by its id alone, so an old timer can end a new hold of the same id."""
        if not held or self.hold != token:
            return None
        out = ("event", "SeatHoldExpired", self.hold, self.booking, "", None)
        self._free()
        return out

    def _free(self) -> None:
        self.version, self.hold, self.booking, self.deadline = self.version + 1, "", "", None


class Machine:
    """Applies commands and, if asked, the timers that are due before each of them."""

    def __init__(self, seat: Seat, held: bool = False, timed: bool = True):
        self.seat, self.held, self.timed = seat, held, timed

    def due(self, now: datetime | None) -> Iterator[tuple]:
        """What the timers up to now (all of them if null) make happen, with their times."""
        timers = self.seat.timers
        while timers and (now is None or timers[0][0] <= now):
            fire_at, token = heapq.heappop(timers)
            out = self.seat.expire(token, self.held)
            if out:
                self.held = False
                yield (fire_at, *out)

    def apply(self, command: str, hold: str, booking: str, reason: str, deadline: datetime | None) -> tuple | None:
        if command == "HoldSeat":
            out = self.seat.request(hold, booking, deadline, self.held)
            if out[0] == "event":
                self.held = True
                if self.timed:
                    heapq.heappush(self.seat.timers, (deadline or datetime(1970, 1, 1), hold))
            return out
        if command == "ReleaseSeatHold":
            out = self.seat.release(hold, booking, reason, self.held)
            self.held = self.held and out[0] != "event"
            return out
        return None


def decide(commands: DataFrame, timed: bool = False, until_end: bool = False) -> DataFrame:
    """What each command makes happen, in order.

    commands: stream_id, event_id, ts, command, hold_id, booking_id, reason,
    expires_at; the order in a stream is (ts, event_id). timed: deadlines end
    holds, before commands of the same instant. until_end: timers still pending
    after the last command fire too. Unknown commands give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, machine = None, Machine(Seat(), timed=timed)
        for batch in batches:
            rows: list[tuple] = []
            for s, event_id, ts, command, hold, booking, reason, expires in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != stream:
                    if until_end and stream is not None:
                        rows += [(stream, None, at, *out, machine.seat.version) for at, *out in machine.due(None)]
                    stream, machine = s, Machine(Seat(), timed=timed)
                if timed:
                    rows += [(s, None, at, *out, machine.seat.version) for at, *out in machine.due(ts)]
                out = machine.apply(command, hold, booking, reason, expires)
                if out:
                    rows.append((s, event_id, ts, *out, machine.seat.version))
            yield _batch(rows)
        if until_end and stream is not None:
            yield _batch([(stream, None, at, *out, machine.seat.version) for at, *out in machine.due(None)])

    read = commands.select("stream_id", "event_id", "ts", "command", "hold_id", "booking_id", "reason", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))
    return read.repartition("stream_id").sortWithinPartitions("stream_id", "ts", "event_id").mapInArrow(run, OUTPUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _KINDS, strict=True)], _COLUMNS)


RACE = "stream_id string, event_id long, kind string, type string, hold_id string, booking_id string, reason string, expires_at timestamp_ntz, version int, attempts int, error string"
_RACE_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.timestamp("us"), pa.int32(), pa.int32(), pa.string()]
#: How often a command that lost a race is decided again.
CONFLICT_RETRIES = 3


def race(commands: DataFrame, state: DataFrame, retries: int = CONFLICT_RETRIES) -> DataFrame:
    """What becomes of commands that all load their stream at once and append what they decide.

    state is a fold: what all commands of a stream load first. In each round every
    command left is decided on the same state. One that changes nothing is done; of
    the others the first to arrive appends its event, and the rest meet a version
    conflict, load the new state and decide again, `retries` times at most. A
    command that lost every round has error "version conflict". A stream in error
    has the error of its fold on every command. Unknown commands give no row.

    One pass: the states of all rounds are known before a later command needs them,
    so a task keeps retries + 2 states of one stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, rounds = None, []
        for batch in batches:
            rows = []
            for s, event_id, command, hold, booking, reason, expires, status, held, owner, until, version, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != stream:  # the state that each round begins with
                    stream, rounds = s, [Machine(Seat(version or 0, held or "", owner or "", until), status == "held", timed=False)]
                if error is not None:
                    rows.append((s, event_id, None, None, hold, booking, None, None, None, 1, error))
                    continue
                for n in range(retries + 1):
                    before = rounds[n]
                    seat = before.seat
                    now = Machine(Seat(seat.version, seat.hold, seat.booking, seat.deadline), before.held, timed=False)
                    out = now.apply(command, hold, booking, reason, expires)
                    if out is None:
                        break
                    if out[0] == "reply" or n + 1 == len(rounds):
                        if out[0] == "event":
                            rounds.append(now)
                        rows.append((s, event_id, *out, now.seat.version, n + 1, None))
                        break
                else:
                    rows.append((s, event_id, None, None, hold, booking, None, None, None, retries + 1, "version conflict"))
            columns = list(zip(*rows, strict=True)) or [[] for _ in _RACE_KINDS]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _RACE_KINDS, strict=True)], [x.split()[0] for x in RACE.split(", ")])

    now = state.select("stream_id", "status", F.col("hold_id").alias("s_hold"), F.col("booking_id").alias("s_booking"), F.col("expires_at").cast("timestamp_ntz").alias("s_expires"), "version", "error")
    read = commands.select("stream_id", "event_id", "ts", "command", "hold_id", "booking_id", "reason", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))
    met = read.join(now, "stream_id", "left").repartition("stream_id").sortWithinPartitions("stream_id", "ts", "event_id")
    return met.select("stream_id", "event_id", "command", "hold_id", "booking_id", "reason", "expires_at", "status", "s_hold", "s_booking", "s_expires", "version", "error").mapInArrow(run, RACE)
