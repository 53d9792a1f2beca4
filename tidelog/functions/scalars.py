"""Scalar column functions, all of them Catalyst built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subject_name(topic: Column, type_name: Column) -> Column:
    """The registry subject of a type on a topic."""
    return F.concat_ws("-", topic, type_name)


def dlq_topic(topic: Column) -> Column:
    return F.concat(topic, F.lit(".dlq"))


def refusal_reason(status: Column) -> Column:
    return F.concat(F.lit("seat is "), status)


def parse_status(status: Column) -> Column:
    """free or held; anything else is an error, never a free seat."""
    return F.when(status.isin("free", "held"), status).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce(status, F.lit("null")))))


def deadline(status: Column, expires_at: Column) -> Column:
    """A held seat's deadline; a message without one has the epoch, a free seat none."""
    return F.when(status == "held", F.coalesce(expires_at, F.to_timestamp(F.lit("1970-01-01 00:00:00"))))


def backoff_ms(base_ms: Column | int, attempt: Column) -> tuple[Column, Column]:
    """Bounds of the wait before the next attempt: at least the first, below the second."""
    low = F.lit(base_ms) * F.pow(F.lit(2.0), attempt - 1)
    return low.cast("long"), (low * 2).cast("long")


def sleep_ms(until_ms: Column, floor_ms: int = 5, ceiling_ms: int = 1000) -> Column:
    """How long a scheduler sleeps when its next timer is until_ms away; null (none) sleeps longest."""
    return F.when(until_ms.isNull(), ceiling_ms).otherwise(F.least(F.greatest(until_ms, F.lit(floor_ms)), F.lit(ceiling_ms)))


def frame(schema_id: Column, body: Column) -> Column:
    """Registry framing: a zero byte, the id as four big-endian bytes, a zero index, the body."""
    return F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(schema_id.cast("long")), 8, "0"), F.lit("00"), F.hex(body)))


def unframe(value: Column) -> Column:
    """schema_id, body and error of a framed value."""
    text = F.hex(value)
    good = (F.length(text) >= 12) & F.startswith(text, F.lit("00")) & (F.substring(text, 11, 2) == "00")
    error = F.when(F.coalesce(~good, F.lit(True)), "bad frame")
    return F.struct(F.when(good, F.conv(F.substring(text, 3, 8), 16, 10).cast("int")).alias("schema_id"), F.when(good, F.unhex(F.substr(text, F.lit(13)))).alias("body"), error.alias("error"))


def new_id(time: Column, key: Column) -> Column:
    """A version 7 UUID: milliseconds of time first, so ids sort by it; the rest is a hash of key, so a repeated task gives the same id."""
    stamp = F.lpad(F.hex(F.unix_millis(time.cast("timestamp"))), 12, "0")
    rest = F.sha2(F.encode(key, "UTF-8"), 256)
    variant = F.substring(F.lit("89ab"), 1, 4)
    turn = (F.conv(F.substring(rest, 4, 1), 16, 10).cast("int") % 4) + 1
    return F.lower(F.concat_ws("-", F.substring(stamp, 1, 8), F.substring(stamp, 9, 4), F.concat(F.lit("7"), F.substring(rest, 1, 3)), F.concat(F.substr(variant, turn, F.lit(1)), F.substring(rest, 5, 3)), F.substring(rest, 8, 12)))
