"""Where messages go: a file sink with the same columns as the broker sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.envelope import to_record_headers


def records(messages: DataFrame) -> DataFrame:
    """Messages (topic, key, payload, headers) in the columns that the broker sink takes."""
    return messages.select("topic", "key", F.col("payload").alias("value"), to_record_headers(F.col("headers")).alias("headers"))


def _trigger(every: str | None) -> dict:
    """All there is and then the end, or batches `every` so often."""
    return {"processingTime": every} if every else {"availableNow": True}


def to_files(messages: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """At-least-once delivery is what a reader of these files must expect of any sink; the checkpoint marks what was published."""
    return messages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


def to_kafka(messages: DataFrame, servers: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Needs Spark's Kafka connector on the class path, which is not shipped here and so is untested."""
    out = records(messages).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return out.option("includeHeaders", "true").option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()
