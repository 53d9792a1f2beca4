"""Queries that run a stream to its end and read what it wrote."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import to_files
from ..sources.tables import commands, file_stream
from ..streaming.service import OUT, seat_service


def work_folder(spark: SparkSession) -> str:
    """A new folder in the one that the session names for checkpoints. Where it names none, a temporary one if all runs on this machine, else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{shared or tempfile.mkdtemp(prefix='stream-')}/stream-{uuid.uuid4().hex}"


def stream_commands(spark: SparkSession, d: str) -> DataFrame:
    """The commands as a stream adds to them what a transport would: ids, a source, a flow."""
    number = F.col("event_id").cast("string")
    return commands(spark, d).select(
        "stream_id", F.concat(F.lit("ce-"), number).alias("ce_id"), F.lit("/booking").alias("source"), F.col("ts").cast("timestamp").alias("ts"), "command", "hold_id", "booking_id", "reason",
        F.col("expires_at").cast("timestamp").alias("expires_at"), F.concat(F.lit("saga-"), "stream_id").alias("correlation_id"),
    )


def service_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the service makes of all commands. The stream has a session of its own, so the caller's settings stay."""
    folder = work_folder(spark)
    rows = stream_commands(spark, d)
    rows.write.parquet(f"{folder}/in")
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = seat_service(file_stream(own, f"{folder}/in", rows.schema))
    to_files(out, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out")
