"""Booking sagas: steps, their inverses, timeouts, payments charged once, and the view of bookings.

The model names these but has no code for them; what they do is taken from its
tables of steps and compensations. A saga reserves a seat, a room and a payment,
one after the other, then confirms. A step that fails undoes what was done, the
last first. `Saga.on` is a pure function of the state and one event; `run` feeds
it the events of all sagas in order, in Arrow batches, with one saga's state in
memory.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The steps in order: what asks for each, what says that it is done, and what undoes it.
STEPS = (("HoldSeat", "SeatHeld", "ReleaseSeatHold"), ("ReserveRoom", "RoomReserved", "CancelRoom"), ("CapturePayment", "PaymentCaptured", "RefundPayment"))
#: Events that say a step could not be done, and the step.
REFUSALS = {"SeatUnavailable": 0, "RoomUnavailable": 1, "PaymentDeclined": 2}
CONFIRM = ("ConfirmSeatHold", "ConfirmRoom")
CONFIRMED = ("SeatConfirmed", "RoomConfirmed")
#: How often a step is asked for before it is given up, and how long an answer may take.
STEP_ATTEMPTS = 5
STEP_TIMEOUT_S = 30

_DONE = {done: i for i, (_, done, _) in enumerate(STEPS)}


class Saga:
    """State of one saga. done: steps known to be done and not undone; undone: steps whose inverse was asked for or that undid themselves."""

    __slots__ = ("attempts", "confirmed", "done", "seen", "status", "step", "undone")

    def __init__(self):
        self.status, self.step, self.attempts = "new", -1, 0
        self.done: set[int] = set()
        self.undone: set[int] = set()
        self.confirmed: set[str] = set()
        self.seen: set[tuple] = set()

    def on(self, event: str, token: str = "") -> list[str]:
        """The commands that event makes necessary; none the second time it comes. token tells timeouts of one step apart: step and attempt."""
        key = (event, token if event == "StepTimedOut" else "")
        if key in self.seen:
            return []
        self.seen.add(key)
        if event == "BookingRequested" and self.status == "new":
            self.status = "running"
            return self._ask(0)
        if event in _DONE:
            return self._step_done(_DONE[event])
        if event in REFUSALS and self.status == "running" and self.step == REFUSALS[event]:
            return self._undo()
        if event == "SeatHoldExpired" and self.status in ("running", "confirming") and 0 in self.done:
            self.done.discard(0)
            self.undone.add(0)  # the seat let go of itself
            return self._undo()
        if event == "SeatConfirmFailed" and self.status == "confirming":
            self.done.discard(0)
            self.undone.add(0)
            return self._undo()
        if event in CONFIRMED and self.status == "confirming":
            self.confirmed.add(event)
            if len(self.confirmed) == len(CONFIRMED):
                self.status = "confirmed"
        if event == "StepTimedOut" and self.status == "running" and token == self.token():
            if self.attempts < STEP_ATTEMPTS:
                return self._ask(self.step)
            return self._undo()
        return []

    def token(self) -> str:
        """What a timeout must carry to count: a timer of an answered step or an earlier attempt is stale."""
        return f"{STEPS[self.step][0]}/{self.attempts}" if self.status == "running" else ""

    def _ask(self, step: int) -> list[str]:
        self.attempts = self.attempts + 1 if step == self.step else 1
        self.step = step
        return [STEPS[step][0]]

    def _step_done(self, step: int) -> list[str]:
        if self.status == "running" and step == self.step:
            self.done.add(step)
            if step + 1 < len(STEPS):
                return self._ask(step + 1)
            self.status = "confirming"
            return list(CONFIRM)
        if self.status == "rejected" and step <= self.step and step not in self.done | self.undone:
            self.undone.add(step)  # it came after the saga gave the step up
            return [STEPS[step][2]]
        return []

    def _undo(self) -> list[str]:
        self.status = "rejected"
        steps = sorted(self.done, reverse=True)
        self.undone |= self.done
        self.done.clear()
        return [STEPS[s][2] for s in steps]


RUN = "saga_id string, event_id long, n int, command string, status string"


def run(events: DataFrame) -> DataFrame:
    """The commands of each saga, in order: saga_id, event_id (that caused it), n (of the saga's commands, from 1), command and status after the event.

    events: saga_id, event_id, ts, type and token; the order is (ts, event_id).
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, saga, n = None, Saga(), 0
        for batch in batches:
            rows = []
            for s, event_id, kind, token in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != name:
                    name, saga, n = s, Saga(), 0
                for command in saga.on(kind, token or ""):
                    n += 1
                    rows.append((s, event_id, n, command, saga.status))
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(5)]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in RUN.split(", ")])

    ordered = events.repartition("saga_id").sortWithinPartitions("saga_id", "ts", "event_id")
    return ordered.select("saga_id", "event_id", "type", "token").mapInArrow(decide, RUN)


def overdue(dispatched: DataFrame, replies: DataFrame, as_of: Column, timeout_s: int = STEP_TIMEOUT_S) -> DataFrame:
    """Dispatches (saga_id, step, attempt, at) that no reply (saga_id, step, at) has answered in time: with fire_at, due at as_of."""
    fire_at = F.col("at") + F.make_dt_interval(secs=F.lit(timeout_s))
    first = replies.groupBy("saga_id", "step").agg(F.min("at").alias("_answered"))
    late = dispatched.withColumn("fire_at", fire_at).join(first, ["saga_id", "step"], "left")
    return late.filter((F.col("fire_at") <= as_of) & (F.col("_answered").isNull() | (F.col("_answered") > F.col("fire_at")))).drop("_answered")


# payments


def attempt_key(payment_id: Column, step: Column) -> Column:
    """Derived from the command, so that a repeated command has the same key."""
    return F.concat(payment_id, F.lit("/"), step)


def charge(requests: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New attempts (pending) to write before the provider is called, and what to do with each key that was asked for.

    requests: payment_id and step; attempts: idempotency_key, payment_id, status,
    provider_ref. action: charge (the key is new), ask (pending from before: the
    provider is asked about the key, never charged blind) or reply (settled; its
    status and reference are the answer).
    """
    keys = requests.select(attempt_key(F.col("payment_id"), F.col("step")).alias("idempotency_key"), "payment_id").distinct()
    met = keys.join(attempts.select("idempotency_key", "status", "provider_ref"), "idempotency_key", "left")
    action = F.when(F.col("status").isNull(), "charge").when(F.col("status") == "pending", "ask").otherwise("reply")
    judged = met.withColumn("action", action)
    none = F.lit(None).cast("string")
    new = judged.filter("action = 'charge'").select("idempotency_key", "payment_id", F.lit("pending").alias("status"), none.alias("provider_ref"))
    return new, judged.select("idempotency_key", "payment_id", "action", "status", "provider_ref")


def reconcile(attempts: DataFrame, provider: DataFrame) -> DataFrame:
    """attempts after the provider (idempotency_key, charged, ref) was asked about pending ones; a key it does not know stays pending, safe to charge under the same key."""
    known = provider.select("idempotency_key", "charged", "ref")
    met = attempts.join(known, "idempotency_key", "left")
    answered = (F.col("status") == "pending") & F.col("charged").isNotNull()
    status = F.when(answered, F.when(F.col("charged"), "succeeded").otherwise("failed")).otherwise(F.col("status"))
    return met.select("idempotency_key", "payment_id", status.alias("status"), F.when(answered, F.col("ref")).otherwise(F.col("provider_ref")).alias("provider_ref"))


# the view

_OUTCOMES = {"BookingConfirmed": "confirmed", "BookingRejected": "rejected"}


def bookings_view(events: DataFrame) -> DataFrame:
    """booking_id, status, seat, room, payment and version of each booking's events (booking_id, version, type): two-phase aggregates.

    A resource is held once its event came, and released once a later one says so.
    """
    resources = {"seat": (("SeatHeld",), ("SeatHoldReleased", "SeatHoldExpired")), "room": (("RoomReserved",), ("RoomCancelled",)), "payment": (("PaymentCaptured",), ("PaymentRefunded",))}
    kind = F.col("type")
    has = []
    for name, (gained, lost) in resources.items():
        last = F.max_by(F.when(kind.isin(*gained), "held").when(kind.isin(*lost), "released"), F.when(kind.isin(*gained, *lost), F.col("version")))
        has.append(F.coalesce(last, F.lit("none")).alias(name))
    outcome = F.max_by(kind, F.when(kind.isin(*_OUTCOMES), F.col("version"))).alias("outcome")
    found = events.groupBy("booking_id").agg(outcome, *has, F.max("version").alias("version"))
    status = F.lit("pending")
    for event, text in _OUTCOMES.items():
        status = F.when(F.col("outcome") == event, text).otherwise(status)
    return found.select("booking_id", status.alias("status"), *resources, "version")


# lineage


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the folder that the session names for checkpoints. Where it names none, in a temporary one if all runs on this machine, else an error."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def causation_roots(messages: DataFrame) -> DataFrame:
    """event_id, root and depth of messages (event_id, causation_id): each looks up its cause, then its cause's cause, and so twice as far a round.

    Chains of any length and number: a chain of n takes about log2(n) rounds, and
    what has met its root is not moved again. A message whose cause is not in the
    table has no row, nor has one in a circle, which is what is left once a round
    brings no message to its end.
    """
    cause = F.col("causation_id")
    root = F.when(cause.isNull(), F.col("event_id"))
    reach = _cut(messages.select("event_id", root.alias("root"), cause.alias("up"), F.when(cause.isNull(), 0).otherwise(1).alias("depth")))
    left, before = reach.filter("up IS NOT NULL").select("event_id").distinct().count(), None
    while left and left != before:
        met = reach.select(F.col("event_id").alias("_at"), F.col("root").alias("_root"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        moved = reach.filter("up IS NOT NULL").join(met, F.col("up") == F.col("_at"))
        moved = moved.select("event_id", F.col("_root").alias("root"), F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"))
        reach = _cut(reach.filter("up IS NULL").unionByName(moved))
        left, before = reach.filter("up IS NOT NULL").select("event_id").distinct().count(), left
    return reach.filter("up IS NULL").select("event_id", "root", "depth")
