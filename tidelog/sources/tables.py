"""The tables a session reads: parquet with explicit columns, or a stream of the same schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 100) -> DataFrame:
    """A stream over a folder of parquet files, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topics: str, max_records: int = 100_000) -> DataFrame:
    """Records of a broker in the RECORD schema. Needs Spark's Kafka connector on the class path, which is not shipped here and so is untested."""
    from ..functions.envelope import from_record_headers

    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("includeHeaders", "true").option("maxOffsetsPerTrigger", max_records).load()
    return raw.select("topic", F.col("key").cast("string").alias("key"), "value", from_record_headers(F.col("headers")).alias("headers"), "partition", "offset")


def commands(spark: SparkSession, folder: str) -> DataFrame:
    """Seat commands derived from the table events, with a hold deadline of twelve hours."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type").isin("click", "signup"), "HoldSeat").when(F.col("event_type") == "purchase", "ReleaseSeatHold")
    return (
        table(spark, folder, "events")
        .filter(F.col("event_type").isin("click", "signup", "purchase"))
        .select(
            F.concat(F.lit("seat-"), F.col("user_id").cast("string")).alias("stream_id"),
            "event_id",
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            kind.alias("command"),
            F.concat(F.lit("hold-"), (k % 3).cast("string")).alias("hold_id"),
            F.concat(F.lit("booking-"), F.col("event_id").cast("string")).alias("booking_id"),
            F.when(kind == "ReleaseSeatHold", "payment failed").otherwise("").alias("reason"),
            F.when(kind == "HoldSeat", F.expr("cast(ts as timestamp_ntz) + interval 12 hours")).alias("expires_at"),
        )
    )
