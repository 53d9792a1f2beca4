"""The append-only log: loading, enumerating, appending with optimistic concurrency."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import encode_by_type, encode_meta
from ..functions.envelope import validate_event
from ..schemas import MESSAGES, NAMESPACE

CONFLICT = "version conflict"


def load(log: DataFrame, stream_id: str) -> DataFrame:
    """One stream in version order; an unknown stream has no rows."""
    return log.filter(F.col("stream_id") == stream_id).orderBy("version")


def streams(log: DataFrame) -> DataFrame:
    return log.select("stream_id").distinct().orderBy("stream_id")


def assign_versions(batches: DataFrame) -> DataFrame:
    """From stream_id, expected_version and events (an array): one row an event with its version and its place in the batch."""
    return batches.select("stream_id", "expected_version", F.posexplode("events").alias("at", "event")).withColumn("version", (F.col("expected_version") + F.col("at") + 1).cast("int"))


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows of one event each (stream_id, expected_version) with the versions that their order in the stream gives.

    Rows are sorted in their partition and counted as they pass, so no stream is
    held in one row or in memory.
    """
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy(*order))
    return rows.withColumn("version", (F.col("expected_version") + place).cast("int"))


def detect_conflicts(candidates: DataFrame, arrival: list[Column], taken: DataFrame | None = None) -> DataFrame:
    """candidates with `conflict`: the version was taken before, in the log (taken: stream_id, version) or by an earlier candidate.

    A gap is no conflict, and a version below the head that no event has is free.
    Rows of one stream and version are compared by arrival; the window is by both,
    so a busy stream is spread over its versions.
    """
    first = F.row_number().over(Window.partitionBy("stream_id", "version").orderBy(*arrival)) == 1
    marked = candidates.withColumn("conflict", ~first)
    if taken is None:
        return marked
    there = taken.select("stream_id", "version").distinct().withColumn("_taken", F.lit(True))
    return marked.join(there, ["stream_id", "version"], "left").withColumn("conflict", F.col("conflict") | F.col("_taken").isNotNull()).drop("_taken")


class _Taken:
    """The versions of a stream as disjoint ranges: one range, unless the stream has gaps."""

    def __init__(self):
        self.first: list[int] = []
        self.last: list[int] = []

    def claim(self, first: int, last: int) -> bool:
        """Takes first to last, unless one of them is taken."""
        at = bisect_right(self.first, last)
        if at and self.last[at - 1] >= first:
            return False
        if at and self.last[at - 1] == first - 1:
            self.last[at - 1] = last
            if at < len(self.first) and self.first[at] == last + 1:
                self.last[at - 1] = self.last.pop(at)
                self.first.pop(at)
        elif at < len(self.first) and self.first[at] == last + 1:
            self.first[at] = first
        else:
            self.first.insert(at, first)
            self.last.insert(at, last)
        return True


def _accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of the log come first in each stream (their batch is null), then batches in order of arrival."""
    stream, taken = None, _Taken()
    for rows in batches:
        number, refused = [], []
        for s, batch, first, last in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if s != stream:
                stream, taken = s, _Taken()
            free = taken.claim(first, last)
            if batch is not None:
                number.append(batch)
                refused.append(not free)
        yield pa.RecordBatch.from_arrays([pa.array(number, rows.schema.field(1).type), pa.array(refused, pa.bool_())], ["batch", "refused"])


def append(log: DataFrame, batches: DataFrame, batch: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """Accepted rows (batch, stream_id, event, version), and refused batches with why (batch, error).

    batches: batch_id (unique and not null, in order of arrival), stream_id,
    expected_version and events (an array of structs with type and data). Each
    batch is decided after all that came before it in its stream: it is refused
    whole if the log or an accepted batch has one of its versions, so a refused
    batch stands in nobody's way. An event without type or data refuses its batch
    before anything else. An empty batch changes nothing; a gap is let through.

    Only numbers are sorted by stream: a stream without gaps is one range of
    versions, and the ranges are all that a task keeps of a stream.
    """
    bad = F.filter(F.transform("events", lambda e, i: F.struct(i.alias("at"), validate_event(e["type"], e["data"]).alias("error"))), lambda x: x["error"].isNotNull())
    judged = batches.withColumn("_bad", F.try_element_at(bad, F.lit(1)))
    invalid = judged.filter("_bad is not null").select(batch, F.concat(F.lit("event "), F.col("_bad.at"), F.lit(": "), F.col("_bad.error")).alias("error"))
    good = judged.filter("_bad is null and size(events) > 0").drop("_bad")

    touched = log.select("stream_id", F.col("version").cast("long").alias("version")).join(good.select("stream_id").distinct(), "stream_id", "left_semi")
    heads = touched.groupBy("stream_id").agg(F.min("version").alias("low"), F.max("version").alias("high"), F.count("*").alias("n"))
    whole = F.col("n") == F.col("high") - F.col("low") + 1
    gapless = heads.filter(whole).select("stream_id", F.col("low").alias("first"), F.col("high").alias("last"))
    gappy = touched.join(heads.filter(~whole).select("stream_id"), "stream_id", "left_semi").select("stream_id", F.col("version").alias("first"), F.col("version").alias("last"))
    kind = batches.schema[batch].dataType
    there = gapless.unionByName(gappy).withColumn("batch", F.lit(None).cast(kind))
    expected = F.col("expected_version").cast("long")
    asked = good.select("stream_id", F.col(batch).alias("batch"), (expected + 1).alias("first"), (expected + F.size("events")).alias("last"))
    both = there.select("stream_id", "batch", "first", "last").unionByName(asked)
    ordered = both.repartition("stream_id").sortWithinPartitions("stream_id", F.col("batch").asc_nulls_first(), "first")
    decided = ordered.mapInArrow(_accept, f"batch {kind.simpleString()}, refused boolean")

    lost = decided.filter("refused").select(F.col("batch").alias(batch), F.lit(CONFLICT).alias("error"))
    won = decided.filter("not refused").select(F.col("batch").alias(batch))
    rows = good.join(won, batch, "left_semi").select(batch, "stream_id", "expected_version", F.posexplode("events").alias("at", "event"))
    accepted = rows.withColumn("version", (F.col("expected_version") + F.col("at") + 1).cast("int")).drop("at", "expected_version")
    return accepted, invalid.unionByName(lost)


def encode_batches(batches: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """batches whose events are messages (message, its short name, and its fields) with events as type, data and meta instead.

    correlation_id and causation_id of the batch, if there, become each event's meta.
    """
    names = sorted({f for fields in MESSAGES.values() for f in fields})
    given = [f.name for f in batches.schema["events"].dataType.elementType.fields]
    link = [F.col(c) if c in batches.columns else F.lit(None).cast("string") for c in ("correlation_id", "causation_id")]

    def stored(m: Column) -> Column:
        data = encode_by_type(m["message"], {n: m[n] for n in names if n in given})
        return F.struct(F.concat(F.lit(f"{namespace}."), m["message"]).alias("type"), data.alias("data"), encode_meta(*link).alias("meta"))

    return batches.withColumn("events", F.transform("events", stored))


def append_seat(log: DataFrame, batches: DataFrame, batch: str = "batch_id", namespace: str = NAMESPACE) -> tuple[DataFrame, DataFrame]:
    """append of messages that are encoded first; a message that cannot be encoded has no data, which refuses its batch."""
    return append(log, encode_batches(batches, namespace), batch)
