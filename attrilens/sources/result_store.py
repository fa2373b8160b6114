"""Results kept by key, and appends that several jobs make to one table.

Both publish by a rename that fails where the target exists: rows are written
aside first, under a name that readers pass over, so a job that is lost half way
leaves nothing that counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """A folder of the cluster's file system, as the driver sees it."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm, conf = path.rstrip("/"), spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._fs = self._at("").getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if self.has("") else []

    def put(self, name: str, text: str) -> None:
        out = self._fs.create(self._at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def publish(self, aside: str, name: str) -> bool:
        """Rename a folder; False where another one has the name already."""
        kinds = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self._gateway.new_array(kinds, 1)
        none[0] = kinds.NONE
        try:
            self._context.rename(self._at(aside), self._at(name), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName() and not self.has(name):
                raise
            return False
        return True

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def source_key(spark: SparkSession, paths: list[str], **parameters) -> str:
    """SHA-1 over path, time and size of every source file and over the parameters; a row a file, no content read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", F.col("modificationTime").cast("string").alias("time"), "length")
    of = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("path", "time", "length"))).alias("files"), F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters")))
    return files.agg(F.sha1(of)).first()[0]


def load_or_compute(spark: SparkSession, base: str, name: str, key: str, compute: Callable[[], DataFrame], meta: dict | None = None) -> tuple[DataFrame, bool]:
    """The result kept under name and key, computed and kept where there is none; and whether it was there.

    A result counts with its marker only, which is written before the rename; of
    two jobs that compute the same, the first to rename is kept.
    """
    folder, at = Folder(spark, base), f"{name}__{key}"
    there = folder.has(f"{at}/_READY")
    if not there:
        aside = f"_aside-{uuid.uuid4().hex}"
        compute().write.parquet(f"{base}/{aside}/rows")
        folder.put(f"{aside}/meta.json", json.dumps({"name": name, "key": key} | (meta or {}), sort_keys=True))
        folder.put(f"{aside}/_READY", "")
        if folder.has(at) and not folder.has(f"{at}/_READY"):
            folder.drop(at)  # what something else left there half made
        if not folder.publish(aside, at):
            folder.drop(aside)
    return spark.read.parquet(f"{base}/{at}/rows"), there


def _commits(folder: Folder) -> list[str]:
    return [x for x in folder.names() if x.startswith("commit=")]


def appended(spark: SparkSession, base: str) -> DataFrame | None:
    """K3: the rows of all commits, or None before the first."""
    folder = Folder(spark, base)
    found = _commits(folder)
    return spark.read.parquet(*[f"{base}/{x}" for x in found]) if found else None


def append_once(work: DataFrame, base: str, keys: list[str], process: Callable[[DataFrame], DataFrame], most_tries: int = 100) -> int:
    """K2, K3: process the work whose keys are not in the table and append it as one commit; the number of tries.

    Commits are numbered, and a commit knows all before it: if another job takes
    its number first, the rows that job appended are left out and the rest is
    tried under the next number. So each key is appended once, whatever the
    number of jobs at a time. Work is processed once.
    """
    spark = work.sparkSession
    folder = Folder(spark, base)
    seen = _commits(folder)
    todo = work.dropDuplicates(keys)
    if seen:
        todo = todo.join(spark.read.parquet(*[f"{base}/{x}" for x in seen]).select(*keys), keys, "left_anti")
    aside = f"_aside-{uuid.uuid4().hex}"
    rows = process(todo)
    rows.write.parquet(f"{base}/{aside}")
    for tries in range(1, most_tries + 1):
        if folder.publish(aside, f"commit={len(seen):08d}"):
            return tries
        new = [x for x in _commits(folder) if x not in seen]
        kept = spark.read.schema(rows.schema).parquet(f"{base}/{aside}").join(spark.read.parquet(*[f"{base}/{x}" for x in new]).select(*keys), keys, "left_anti")
        seen, old, aside = seen + new, aside, f"_aside-{uuid.uuid4().hex}"
        kept.write.parquet(f"{base}/{aside}")
        folder.drop(old)
    folder.drop(aside)
    raise RuntimeError(f"{base}: no free commit in {most_tries} tries")
