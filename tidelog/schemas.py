"""The data model: one explicit schema for each table and each message."""

from __future__ import annotations

from pyspark.sql import types as T

#: Prefix of every message type's full name; a deployment sets its own.
NAMESPACE = "inventory.v1"

_S, _L, _I, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _table(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in columns])


EVENT_LOG = _table(("global_seq", _L, False), ("stream_id", _S, False), ("version", _I, False), ("type", _S, False), ("data", _S, False), ("meta", _S, False), ("recorded_at", _TS, False))
OUTBOX = _table(("id", _L, False), ("topic", _S, False), ("key", _S, False), ("payload", T.BinaryType(), False), ("headers", T.MapType(_S, _S), False), ("published_at", _TS, True))
INBOX = _table(("consumer", _S, False), ("source", _S, False), ("event_id", _S, False), ("handled_at", _TS, False))
TIMERS = _table(("id", _L, False), ("fire_at", _TS, False), ("subject", _S, False), ("token", _S, False), ("fired_at", _TS, True))
AVAILABILITY = _table(("seat_id", _S, False), ("status", _S, False), ("hold_id", _S, False), ("booking_id", _S, False), ("expires_at", _TS, True), ("version", _I, False))
RECORD = _table(("topic", _S, False), ("key", _S, True), ("value", T.BinaryType(), True), ("headers", T.MapType(_S, _S), True), ("partition", _I, False), ("offset", _L, False))
META = _table(("trace_id", _S, True), ("correlation_id", _S, True), ("causation_id", _S, True))

#: The fields of each message. The first two are commands; the last is a reply only and never enters a log.
MESSAGES = {
    "HoldSeat": ("hold_id", "booking_id", "seat_id", "expires_at"),
    "ReleaseSeatHold": ("hold_id", "booking_id", "seat_id", "reason"),
    "SeatHeld": ("hold_id", "booking_id", "seat_id", "expires_at"),
    "SeatHoldReleased": ("hold_id", "booking_id", "seat_id", "reason"),
    "SeatHoldExpired": ("hold_id", "booking_id", "seat_id"),
    "SeatUnavailable": ("hold_id", "booking_id", "seat_id", "reason"),
}
COMMANDS = ("HoldSeat", "ReleaseSeatHold")
EVENTS = ("SeatHeld", "SeatHoldReleased", "SeatHoldExpired")


def payload_schema(message: str) -> T.StructType:
    return T.StructType([T.StructField(f, _TS if f == "expires_at" else _S) for f in MESSAGES[message]])


def type_name(message: str, namespace: str = NAMESPACE) -> str:
    return f"{namespace}.{message}"
