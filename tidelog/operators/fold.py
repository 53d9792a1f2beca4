"""Folding streams into seat state.

Every event overwrites all of the state but the version, which counts events.
So a fold is the last event by version and a count, two-phase aggregates that
combine before the shuffle; `fold_ordered` keeps the general ordered form.

A stream fails if any of its events cannot be decoded, whatever comes last: its
error is that of the first such event by version. A stream whose events can all
be decoded fails if one is a message that is no event. A failed stream has its
error and nothing of a state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import decode
from ..functions.scalars import deadline
from ..schemas import EVENTS, NAMESPACE, type_name

UNKNOWN_EVENT = "unknown event"


def is_event(kind: Column, namespace: str = NAMESPACE) -> Column:
    return kind.isin(*[type_name(e, namespace) for e in EVENTS])


def event_error(kind: Column, data: Column, namespace: str = NAMESPACE) -> Column:
    """Why an event cannot be decoded; null if it can."""
    return decode(kind, data, namespace)["error"]


def _state(last: Column, version: Column, broken: Column, unknown: Column, namespace: str) -> list[Column]:
    """broken: the first decoding error as v<version>: <error>, or null; unknown: how many events are none."""
    error = F.coalesce(broken, F.when(unknown > 0, UNKNOWN_EVENT))
    fine = error.isNull()
    held = last["type"] == type_name("SeatHeld", namespace)
    message = decode(last["type"], last["data"], namespace)
    status = F.when(held, "held").otherwise("free")
    text = lambda f: F.when(fine, F.when(held, message[f]).otherwise(F.lit("")))
    return [
        F.when(fine, status).alias("status"),
        text("hold_id").alias("hold_id"),
        text("booking_id").alias("booking_id"),
        F.when(fine, deadline(status, message["expires_at"])).alias("expires_at"),
        F.when(fine, version.cast("int")).alias("version"),
        error.alias("error"),
    ]


def _at(version: Column, error: Column) -> Column:
    return F.concat(F.lit("v"), version.cast("string"), F.lit(": "), error)


def fold(log: DataFrame, namespace: str = NAMESPACE, with_meta: bool = False) -> DataFrame:
    """stream_id, status, hold_id, booking_id, expires_at, version and error of each stream; last_meta if asked."""
    unknown = (~is_event(F.col("type"), namespace)).cast("int")
    error = event_error(F.col("type"), F.col("data"), namespace)
    broken = F.min(F.when(error.isNotNull(), F.struct(F.col("version"), error.alias("error"))))
    last = F.struct("type", "data", *(["meta"] if with_meta else []))
    found = log.groupBy("stream_id").agg(F.max_by(last, F.col("version")).alias("last"), F.count("*").alias("n"), F.sum(unknown).alias("unknown"), broken.alias("broken"))
    meta = [F.col("last.meta").alias("last_meta")] if with_meta else []
    why = F.when(F.col("broken").isNotNull(), _at(F.col("broken.version"), F.col("broken.error")))
    return found.select("stream_id", *_state(F.col("last"), F.col("n"), why, F.col("unknown"), namespace), *meta)


def fold_ordered(log: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """The same by applying one event after the other in version order; a stream is one row on the way, so it must fit in memory."""
    error = event_error(F.col("type"), F.col("data"), namespace)
    events = F.array_sort(F.collect_list(F.struct("version", "type", "data", error.alias("error"))))
    start = F.struct(F.lit("").alias("type"), F.lit("{}").alias("data"), F.lit(0).alias("n"), F.lit(0).alias("unknown"), F.lit(None).cast("string").alias("broken"))
    step = lambda s, e: F.struct(
        e["type"].alias("type"), e["data"].alias("data"), (s["n"] + 1).alias("n"), (s["unknown"] + (~is_event(e["type"], namespace)).cast("int")).alias("unknown"),
        F.coalesce(s["broken"], _at(e["version"], e["error"])).alias("broken"),
    )
    found = log.groupBy("stream_id").agg(F.aggregate(events, start, step).alias("s"))
    return found.select("stream_id", *_state(F.col("s"), F.col("s.n"), F.col("s.broken"), F.col("s.unknown"), namespace))
