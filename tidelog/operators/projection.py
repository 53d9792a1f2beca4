"""The availability view: rebuilt from the log, updated with a version guard, browsed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import NAMESPACE
from .fold import fold

COLUMNS = ("status", "hold_id", "booking_id", "expires_at", "version")


def split(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a fold: rows of the view, and the streams that failed (stream_id, error)."""
    return state.filter("error is null").select(F.col("stream_id").alias("seat_id"), *COLUMNS), state.filter("error is not null").select("stream_id", "error")


def rebuild(log: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """One row for each seat that has a stream. A stream that cannot be folded fails the rebuild: a view is whole or not written.

    `split(fold(log))` gives the good rows and the failed streams apart.
    """
    state = fold(log, namespace)
    why = F.concat(F.lit("cannot fold "), F.col("stream_id"), F.lit(": "), F.col("error"))
    whole = F.when(F.col("error").isNull(), True).otherwise(F.raise_error(why).cast("boolean"))
    return state.filter(whole).select(F.col("stream_id").alias("seat_id"), *COLUMNS)


def rebuild_into(log: DataFrame, folder: str, namespace: str = NAMESPACE) -> str:
    """Writes a rebuild to a new place in folder and returns it, once it is whole; what readers had stays until they are told of the new place."""
    path = f"{folder}/view-{uuid.uuid4().hex}"
    rebuild(log, namespace).write.parquet(path)
    return path


def guarded_upsert(view: DataFrame, new: DataFrame) -> DataFrame:
    """The view after new rows: a row changes only to a higher version, so late and repeated updates do nothing.

    One aggregate over both, combined before the shuffle; equal versions keep the old row.
    """
    both = view.select("seat_id", F.struct(*COLUMNS).alias("row"), F.lit(1).alias("old")).unionByName(new.select("seat_id", F.struct(*COLUMNS).alias("row"), F.lit(0).alias("old")))
    return both.groupBy("seat_id").agg(F.max_by("row", F.struct(F.col("row.version"), F.col("old"))).alias("row")).select("seat_id", *[F.col(f"row.{c}").alias(c) for c in COLUMNS])


def project(view: DataFrame, log: DataFrame, notifications: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """The view after notifications (a column subject): their streams are folded anew, payloads are never read.

    A stream that cannot be folded keeps its old row; `notification_errors` names it.
    """
    return guarded_upsert(view, split(fold(_touched(log, notifications), namespace))[0])


def notification_errors(log: DataFrame, notifications: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """subject, error and class of notifications that cannot be applied: no subject is permanent, a stream that fails to fold is tried again."""
    missing = notifications.filter("subject is null or subject = ''").select("subject", F.lit("missing attribute ce_subject").alias("error"), F.lit("permanent").alias("error_class"))
    failed = split(fold(_touched(log, notifications), namespace))[1]
    return missing.unionByName(failed.select(F.col("stream_id").alias("subject"), "error", F.lit("transient").alias("error_class")))


def _touched(log: DataFrame, notifications: DataFrame) -> DataFrame:
    told = notifications.select(F.col("subject").alias("stream_id")).filter("stream_id <> ''").distinct()
    return log.join(told, "stream_id", "left_semi")


def availability(view: DataFrame, seat_id: str) -> DataFrame:
    return view.filter(F.col("seat_id") == seat_id)


def held_seats(view: DataFrame, prefix: str) -> DataFrame:
    """Held seats whose id is like prefix%; % and _ in the prefix are wildcards too."""
    return view.filter((F.col("status") == "held") & F.col("seat_id").like(f"{prefix}%")).select("seat_id").orderBy("seat_id")
