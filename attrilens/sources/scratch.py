"""Folders for files that one stage writes and another reads."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names for checkpoints, removed when the application ends.

    Without one a temporary folder serves, on a local master only.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{named or tempfile.mkdtemp(prefix='attrilens-files-')}/files-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may have ended and its folder gone
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(remove)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
