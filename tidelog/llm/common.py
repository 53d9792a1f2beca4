"""Pieces that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 100_000


#: Rows that go to a Python worker at once, so that a batch of long texts stays small.
BATCH_ROWS = "1000"


def lean(spark: SparkSession) -> None:
    """Bounds Arrow batches in a session that says nothing of them; a size that was set, even to the default, stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. Where it names none, a temporary one if all runs on this machine, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by reliable files in the shared folder."""
    lean(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Joins a right side that was cut before: broadcast if its row count is small, else shuffled (AQE splits hot keys)."""
    small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if small else right, on, how)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8; null as empty."""
    for x in column:
        value = x.as_buffer() if x.is_valid else None
        yield value.to_pybytes() if value is not None else b""


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about most bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(text)).fill_null(0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def block_count(docs: DataFrame, text: str, block_bytes: int) -> int:
    """Blocks needed so that one holds about block_bytes of text: a scan that returns one row."""
    lean(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text) + 64).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // block_bytes))


def block_of(blocks: int, *columns: str) -> Column:
    """A row's block by hash of some columns: name the text beside the id, so that rows without an id, or with one and the same, are spread."""
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("long")


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """crc32 of the decimal id, the split the contracts name."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(mod)) == F.lit(remainder)
