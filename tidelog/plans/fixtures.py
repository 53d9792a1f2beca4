"""Inputs that the queries share: the log, inbox, outbox, timers and records that the table events stands for, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.envelope import render
from ..schemas import NAMESPACE, type_name
from ..sources.tables import table

AS_OF = "2024-01-16 00:00:00"
NAMES = {"click": "SeatHeld", "view": "SeatHeld", "signup": "SeatHeld", "purchase": "SeatHoldReleased", "error": "SeatHoldExpired"}


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def short_type(kind) -> F.Column:
    out = F.lit(None).cast("string")
    for event_type, name in NAMES.items():
        out = F.when(kind == event_type, name).otherwise(out)
    return out


def log(spark: SparkSession, d: str, user: int | None = None) -> DataFrame:
    """The events of each user as the stream of a seat; with user, that stream alone, which the scan knows."""
    name = short_type(F.col("event_type"))
    held = name == "SeatHeld"
    stream = F.concat(F.lit("seat-"), F.col("user_id").cast("string"))
    fields = {
        "hold_id": F.concat(F.lit("hold-"), (F.col("k") % 3).cast("string")),
        "booking_id": F.concat(F.lit("booking-"), F.col("user_id").cast("string")),
        "seat_id": stream,
        "reason": F.when(name == "SeatHoldReleased", "payment failed"),
        "expires_at": F.when(held, F.date_trunc("second", F.col("ts").cast("timestamp")) + F.expr("INTERVAL 12 HOURS")),
    }
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events(spark, d) if user is None else events(spark, d).filter(F.col("user_id") == user)
    return rows.select(
        F.col("event_id").alias("global_seq"),
        stream.alias("stream_id"),
        F.row_number().over(order).cast("int").alias("version"),
        F.concat(F.lit(f"{NAMESPACE}."), name).alias("type"),
        codec.encode_by_type(name, fields).alias("data"),
        codec.encode_meta(F.concat(F.lit("saga-"), F.col("user_id").cast("string")), F.concat(F.lit("ce-"), F.col("event_id").cast("string"))).alias("meta"),
        F.col("ts").alias("recorded_at"),
    )


LOG_SQL = f"""
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
named AS (
  SELECT *, CASE event_type WHEN 'purchase' THEN 'SeatHoldReleased' WHEN 'error' THEN 'SeatHoldExpired' WHEN 'click' THEN 'SeatHeld' WHEN 'view' THEN 'SeatHeld' WHEN 'signup' THEN 'SeatHeld' END AS name,
         'seat-' || user_id AS stream_id, 'hold-' || (k % 3) AS hold_id, 'booking-' || user_id AS booking_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS version,
         date_trunc('second', ts) + INTERVAL 12 HOUR AS expires_at FROM e),
log AS (
  SELECT event_id AS global_seq, stream_id, version, '{NAMESPACE}.' || name AS type,
         CASE name WHEN 'SeatHeld' THEN '{{"hold_id":"' || hold_id || '","booking_id":"' || booking_id || '","seat_id":"' || stream_id || '","expires_at":"' || strftime(expires_at, '%Y-%m-%dT%H:%M:%SZ') || '"}}'
                   WHEN 'SeatHoldReleased' THEN '{{"hold_id":"' || hold_id || '","booking_id":"' || booking_id || '","seat_id":"' || stream_id || '","reason":"payment failed"}}'
                   ELSE '{{"hold_id":"' || hold_id || '","booking_id":"' || booking_id || '","seat_id":"' || stream_id || '"}}' END AS data,
         '{{"correlation_id":"saga-' || user_id || '","causation_id":"ce-' || event_id || '"}}' AS meta, ts AS recorded_at,
         name, hold_id, booking_id, expires_at FROM named)
"""

FOLD_SQL = """
last AS (SELECT *, count(*) OVER (PARTITION BY stream_id)::INT AS n, row_number() OVER (PARTITION BY stream_id ORDER BY version DESC) AS back FROM log),
state AS (
  SELECT stream_id, CASE WHEN name = 'SeatHeld' THEN 'held' ELSE 'free' END AS status, CASE WHEN name = 'SeatHeld' THEN hold_id ELSE '' END AS hold_id,
         CASE WHEN name = 'SeatHeld' THEN booking_id ELSE '' END AS booking_id, CASE WHEN name = 'SeatHeld' THEN expires_at END AS expires_at, n AS version, meta AS last_meta
  FROM last WHERE back = 1)
"""


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Each event delivered to two consumers, and those with an even k twice."""
    twice = events(spark, d).select("event_id", "ts", "k", F.explode(F.when(F.col("k") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("attempt"))
    both = twice.select("*", F.explode(F.array(F.lit("inventory"), F.lit("projection"))).alias("consumer"))
    return both.select("consumer", F.lit("/booking").alias("source"), F.concat(F.lit("ce-"), (F.col("event_id") % 5000).cast("string")).alias("event_id"), F.col("event_id").alias("offset"), "attempt", "ts")


DELIVERIES_SQL = """
deliveries AS (
  SELECT consumer, '/booking' AS source, 'ce-' || (event_id % 5000) AS event_id, event_id AS "offset", attempt, ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
       (SELECT unnest([0, 1]) AS attempt), (SELECT unnest(['inventory', 'projection']) AS consumer)
  WHERE attempt = 0 OR k % 2 = 0)
"""


def inbox(spark: SparkSession, d: str) -> DataFrame:
    """Keys that were handled before, when their event was recorded."""
    return events(spark, d).filter("event_id % 3 = 0").select(F.lit("inventory").alias("consumer"), F.lit("/booking").alias("source"), F.concat(F.lit("ce-"), (F.col("event_id") % 5000).cast("string")).alias("event_id"), F.col("ts").alias("handled_at"))


INBOX_SQL = "inbox AS (SELECT 'inventory' AS consumer, '/booking' AS source, 'ce-' || (event_id % 5000) AS event_id, ts AS handled_at FROM events WHERE event_id % 3 = 0)"


def outbox(spark: SparkSession, d: str) -> DataFrame:
    """Messages, of which those with k % 4 = 0 are pending."""
    return events(spark, d).select(F.col("event_id").alias("id"), F.lit("inventory.events").alias("topic"), F.concat(F.lit("seat-"), F.col("user_id").cast("string")).alias("key"), F.encode("props", "UTF-8").alias("payload"), F.when(F.col("k") % 4 != 0, F.col("ts")).alias("published_at"))


OUTBOX_SQL = "outbox AS (SELECT event_id AS id, 'inventory.events' AS topic, 'seat-' || user_id AS key, props AS payload, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 4 <> 0 THEN ts END AS published_at FROM events)"


def timers(spark: SparkSession, d: str) -> DataFrame:
    """A timer for each hold; those with k % 5 = 0 have fired."""
    k = F.col("k")
    return events(spark, d).filter("event_type in ('click', 'signup')").select(F.col("event_id").alias("id"), F.expr("ts + interval 12 hours").alias("fire_at"), F.concat(F.lit("seat-"), F.col("user_id").cast("string")).alias("subject"), F.concat(F.lit("hold-"), (k % 3).cast("string")).alias("token"), F.when(k % 5 == 0, F.expr("ts + interval 13 hours")).alias("fired_at"))


TIMERS_SQL = """timers AS (
  SELECT event_id AS id, ts + INTERVAL 12 HOUR AS fire_at, 'seat-' || user_id AS subject, 'hold-' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS token,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 5 = 0 THEN ts + INTERVAL 13 HOUR END AS fired_at
  FROM events WHERE event_type IN ('click', 'signup'))"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """Transport records; an error event has a broken envelope, one way or another, and some commands fail for a time."""
    k = F.col("k")
    kind = F.when(F.col("event_type") == "purchase", "ReleaseSeatHold").when(F.col("event_type") == "view", "SeatHeld").otherwise("HoldSeat")
    bad = F.col("event_type") == "error"
    headers = render(
        id=F.when(bad & (k % 4 == 1), "").otherwise(F.concat(F.lit("ce-"), F.col("event_id").cast("string"))),
        source=F.when(bad & (k % 4 == 2), "").otherwise("/booking"),
        type=F.when(bad & (k % 4 == 3), "").otherwise(F.concat(F.lit(f"{NAMESPACE}."), kind)),
        subject=F.concat(F.lit("seat-"), F.col("user_id").cast("string")),
        correlation_id=F.when(k % 2 == 0, F.concat(F.lit("saga-"), F.col("user_id").cast("string"))),
        causation_id=F.lit(None).cast("string"),
        traceparent=F.lit(None).cast("string"),
    )
    broken = bad & (k % 4 == 0)
    return events(spark, d).select(
        F.lit("inventory.commands").alias("topic"),
        F.concat(F.lit("seat-"), F.col("user_id").cast("string")).alias("key"),
        F.encode("props", "UTF-8").alias("value"),
        F.when(broken, F.map_filter(headers, lambda h, _: h != "ce_specversion")).otherwise(headers).alias("headers"),
        (F.col("user_id") % 6).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        (k % 8).alias("failures"),
        kind.alias("kind"),
    )


RECORDS_SQL = f"""
r0 AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type = 'error' AS bad,
         CASE event_type WHEN 'purchase' THEN 'ReleaseSeatHold' WHEN 'view' THEN 'SeatHeld' ELSE 'HoldSeat' END AS kind FROM events),
records AS (
  SELECT 'inventory.commands' AS topic, 'seat-' || user_id AS key, props AS value, (user_id % 6)::INT AS partition, event_id AS "offset", k % 8 AS failures, kind,
         CASE WHEN bad AND k % 4 = 0 THEN '' ELSE '1.0' END AS specversion,
         CASE WHEN bad AND k % 4 = 1 THEN '' ELSE 'ce-' || event_id END AS id,
         CASE WHEN bad AND k % 4 = 2 THEN '' ELSE '/booking' END AS source,
         CASE WHEN bad AND k % 4 = 3 THEN '' ELSE '{NAMESPACE}.' || kind END AS type,
         'seat-' || user_id AS subject, CASE WHEN k % 2 = 0 THEN 'saga-' || user_id ELSE '' END AS correlation_id FROM r0),
parsed AS (
  SELECT *, CASE WHEN specversion = '' THEN 'missing attribute ce_specversion' WHEN id = '' THEN 'missing attribute ce_id'
                 WHEN source = '' THEN 'missing attribute ce_source' WHEN type = '' THEN 'missing attribute ce_type' END AS parse_error,
         'ce_id=' || id || ';ce_source=' || source || CASE WHEN specversion <> '' THEN ';ce_specversion=1.0' ELSE '' END || ';ce_subject=' || subject || ';ce_type=' || type || ';content-type=application/protobuf' AS rest,
         CASE WHEN correlation_id <> '' THEN 'ce_correlationid=' || correlation_id || ';' ELSE '' END AS front FROM records)
"""

HELD_TYPE = type_name("SeatHeld")
