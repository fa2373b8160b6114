"""Incremental ingest of responses as a stream of files.

The source pipeline has no event time; what it has is append and resume. A
stream of response files is deduplicated by key and appended exactly once: the
keys that have been seen are keyed state of the stream, kept in RocksDB beside
the checkpoint and recovered from it, so a batch costs what it brings and the
table that grows is never read again. The file sink commits a batch's files by
its number, so a batch that is run again after a loss replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.scans import batch_results

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def response_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parsed batch responses as they arrive, at most max_files new files a batch."""
    reader = spark.readStream
    return batch_results((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).text(path))


def state_session(spark: SparkSession) -> SparkSession:
    """A session whose keyed state lies on disk; a stream's session is that of its source."""
    own = spark.newSession()
    own.conf.set(_PROVIDER, _ROCKSDB)
    return own


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("custom_id",), within: str | None = None, time: str | None = None) -> StreamingQuery:
    """Append responses whose key is new: the first of each key stays, over all batches and restarts.

    With an event time column, keys are forgotten after the span within, which
    bounds the state; without one every key is remembered. Of several rows of one
    key in one batch any may stay. The table at path is what
    ``spark.read.parquet(path)`` shows; files of batches that were not committed
    are not part of it.
    """
    if (within is None) != (time is None):
        raise ValueError("within and time go together")
    fresh = stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys)) if within else stream.dropDuplicates(list(keys))
    return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
