"""Inbox, outbox and timers: claims, deduplication, pruning. Every clock reading is the argument as_of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ConsumerConfig, QueueConfig
from ..functions.envelope import validate_message

#: Batch sizes and retentions unless a caller gives others.
QUEUE = QueueConfig()
CONSUMER = ConsumerConfig()

INBOX_KEY = ["consumer", "source", "event_id"]


def _ago(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


# inbox


def first_deliveries(deliveries: DataFrame, arrival: list[str]) -> DataFrame:
    """One row for each inbox key, the first to arrive; the aggregate combines before the shuffle."""
    rest = [c for c in deliveries.columns if c not in INBOX_KEY]
    found = deliveries.groupBy(*INBOX_KEY).agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("first"))
    return found.select(*INBOX_KEY, *[F.col(f"first.{c}").alias(c) for c in rest])


def unseen(deliveries: DataFrame, inbox: DataFrame) -> DataFrame:
    """Deliveries whose key the inbox does not hold."""
    return deliveries.join(inbox.select(*INBOX_KEY), INBOX_KEY, "left_anti")


def mark_consumed(inbox: DataFrame, deliveries: DataFrame, as_of: Column) -> DataFrame:
    """The inbox with the new keys added."""
    new = unseen(deliveries, inbox).select(*INBOX_KEY).distinct().withColumn("handled_at", as_of)
    return inbox.unionByName(new)


def prune_inbox(inbox: DataFrame, as_of: Column, days: int = QUEUE.retention_days) -> DataFrame:
    """Without keys handled before as_of less days; those are new again."""
    return inbox.filter(~(F.col("handled_at") < _ago(as_of, days)))


# outbox


def claim_pending(outbox: DataFrame, limit: int = QUEUE.batch) -> DataFrame:
    """The oldest unpublished rows by id: by flag, never by cursor, so a low id that commits late is not lost."""
    return outbox.filter(F.col("published_at").isNull()).orderBy("id").limit(limit)


def mark_published(outbox: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """The outbox after the rows with these ids (a column id) were published."""
    done = ids.select("id").distinct().withColumn("_done", F.lit(True))
    return outbox.join(done, "id", "left").withColumn("published_at", F.when(F.col("_done"), as_of).otherwise(F.col("published_at"))).drop("_done")


def prune_outbox(outbox: DataFrame, as_of: Column, days: int = QUEUE.retention_days) -> DataFrame:
    """Without rows published before as_of less days; pending rows always stay."""
    return outbox.filter(F.col("published_at").isNull() | ~(F.col("published_at") < _ago(as_of, days)))


def drain(outbox: DataFrame, publish: Callable[[DataFrame], None], as_of: Column, limit: int = QUEUE.batch) -> tuple[DataFrame, int, Exception | None]:
    """Claims and publishes batch after batch until one is not full. Returns the outbox after it, how many rows went out, and what stopped it, if anything.

    If publish raises, the rows of its batch stay pending, to be claimed again:
    delivery is at least once. Inside one call the outbox does not change, so a
    batch is the next `limit` pending ids; all that the driver keeps is the last.
    """
    last, count, failure = None, 0, None
    while True:
        left = outbox if last is None else outbox.filter(F.col("id") > last)
        batch = claim_pending(left, limit)
        end = batch.agg(F.max("id").alias("id"), F.count("*").alias("n")).first()
        if not end["n"]:
            break
        try:
            publish(batch)
        except Exception as e:  # noqa: BLE001  whatever the publisher's reason, the rows are still claimable
            failure = e
            break
        last, count = end["id"], count + end["n"]
        if end["n"] < limit:
            break
    done = F.lit(False) if last is None else F.col("published_at").isNull() & (F.col("id") <= last)
    return outbox.withColumn("published_at", F.when(done, as_of).otherwise(F.col("published_at"))), count, failure


def enqueue(batches: DataFrame, batch: str = "batch", first_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """Outbox rows (id, batch, at, message), and refused batches with why (batch, error).

    batches: batch (a number, unique, in the order of calls) and messages (an array
    of structs with topic, key and payload). A message without one of them refuses
    its whole batch. Ids rise with the batch, then with the place in it: an id is
    the batch's number times the length of the longest batch, plus the place, so
    ids differ without a global numbering. What follows begins at first_id, above
    all earlier ids.
    """
    bad = F.filter(F.transform("messages", lambda m, i: F.struct(i.alias("at"), validate_message(m["topic"], m["key"], m["payload"]).alias("error"))), lambda x: x["error"].isNotNull())
    judged = batches.withColumn("_bad", F.try_element_at(bad, F.lit(1)))
    refused = judged.filter("_bad is not null").select(batch, F.concat(F.lit("message "), F.col("_bad.at"), F.lit(": "), F.col("_bad.error")).alias("error"))
    step = max(1, batches.agg(F.max(F.size("messages"))).first()[0] or 1)
    rows = judged.filter("_bad is null").select(F.col(batch).cast("long").alias(batch), F.posexplode("messages").alias("at", "message"))
    return rows.select((F.lit(first_id) + F.col(batch) * F.lit(step) + F.col("at")).alias("id"), batch, "at", "message"), refused


# timers


def due(timers: DataFrame, as_of: Column, limit: int = QUEUE.batch) -> DataFrame:
    """Pending timers at or before as_of, the earliest first, ties by id."""
    return timers.filter(F.col("fired_at").isNull() & (F.col("fire_at") <= as_of)).orderBy("fire_at", "id").limit(limit)


def next_due(timers: DataFrame) -> DataFrame:
    """The earliest pending time; null if none is pending."""
    return timers.filter(F.col("fired_at").isNull()).agg(F.min("fire_at").alias("fire_at"))


def mark_fired(timers: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """timers after a claim of these ids: only pending ones change. claimed says which did."""
    asked = ids.select("id").distinct().withColumn("_asked", F.lit(True))
    claimed = F.coalesce("_asked", F.lit(False)) & F.col("fired_at").isNull()
    return timers.join(asked, "id", "left").withColumn("claimed", claimed).withColumn("fired_at", F.when(F.col("claimed"), as_of).otherwise(F.col("fired_at"))).drop("_asked")


def prune_timers(timers: DataFrame, as_of: Column, days: int = QUEUE.retention_days) -> DataFrame:
    """Without timers fired at or before as_of less days; pending ones always stay."""
    return timers.filter(F.col("fired_at").isNull() | ~(F.col("fired_at") <= _ago(as_of, days)))


def fence(timers: DataFrame, state: DataFrame) -> DataFrame:
    """Timers whose token is the live hold of their subject: those that expire something. state is a fold."""
    live = state.filter("status = 'held'").select(F.col("stream_id").alias("subject"), F.col("hold_id").alias("token"), "booking_id", "version")
    return timers.join(live, ["subject", "token"])


def fire(timers: DataFrame, state: DataFrame, as_of: Column, limit: int = QUEUE.batch) -> DataFrame:
    """One pass over the due timers: id, subject, token, outcome and version (of the event that follows) of at most `limit` of them.

    outcome: expired (the token is the live hold, which ends), stale (nothing to
    end, but the timer has fired) or failed (its stream cannot be folded: the
    timer stays pending and the others fire all the same). state is a fold; a
    subject without a stream is stale. `mark_fired` takes those that are not
    failed.
    """
    now = state.select(F.col("stream_id").alias("subject"), "status", "hold_id", F.col("version").alias("at"), "error")
    live = (F.col("status") == "held") & (F.col("hold_id") == F.col("token"))
    outcome = F.when(F.col("error").isNotNull(), "failed").when(live, "expired").otherwise("stale")
    met = due(timers, as_of, limit).join(now, "subject", "left")
    return met.select("id", "subject", "token", outcome.alias("outcome"), F.when(outcome == "expired", F.col("at") + 1).alias("version"))


# delivery


def stall_gate(records: DataFrame, unsettled: Column) -> DataFrame:
    """Records that may be settled in a poll: those before their partition's first unsettled one.

    A minimum by partition, combined before the shuffle, and a join of one row a
    partition.
    """
    first = records.filter(unsettled).groupBy("topic", "partition").agg(F.min("offset").alias("_stop"))
    gated = records.join(first, ["topic", "partition"], "left")
    return gated.filter(F.col("_stop").isNull() | (F.col("offset") < F.col("_stop"))).drop("_stop")


def committed_offsets(settled: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """The next offset of each partition: one past the highest settled, and never less than earlier (topic, partition, next_offset) says."""
    new = settled.select("topic", "partition", (F.col("offset") + 1).alias("next_offset"))
    both = new if earlier is None else new.unionByName(earlier.select("topic", "partition", "next_offset"))
    return both.groupBy("topic", "partition").agg(F.max("next_offset").alias("next_offset"))


def error_class(error: Column) -> Column:
    """permanent for a bad envelope, an undecodable payload and what is no command; transient for the rest."""
    permanent = F.startswith(error, F.lit("missing attribute")) | F.startswith(error, F.lit("unsupported")) | F.startswith(error, F.lit("unknown")) | (error == "malformed")
    return F.when(error.isNull(), None).when(permanent & (error != "unknown event"), "permanent").otherwise("transient")


def settle(error: Column, failures: Column, max_attempts: int = CONSUMER.max_attempts) -> tuple[Column, Column]:
    """attempts and outcome (done or dlq): permanent errors are not retried, transient ones up to max_attempts."""
    permanent = error_class(error) == "permanent"
    attempts = F.when(error.isNull(), 1).when(permanent, 1).otherwise(F.least(failures + 1, F.lit(max_attempts)))
    outcome = F.when(error.isNull(), "done").when(permanent | (failures >= max_attempts), "dlq").otherwise("done")
    return attempts, outcome


def dead_letter(records: DataFrame, error: Column, prefix: str = "dlq_") -> DataFrame:
    """Records as dead letters: same key and payload, original headers, and where they came from."""
    origin = F.create_map(F.lit(f"{prefix}topic"), F.col("topic"), F.lit(f"{prefix}partition"), F.col("partition").cast("string"), F.lit(f"{prefix}offset"), F.col("offset").cast("string"), F.lit(f"{prefix}error"), error)
    kept = F.map_filter(F.col("headers"), lambda k, _: ~k.isin(*[f"{prefix}{x}" for x in ("topic", "partition", "offset", "error")]))
    return records.select(F.concat("topic", F.lit(".dlq")).alias("topic"), "key", F.col("value").alias("payload"), F.map_concat(kept, origin).alias("headers"))
