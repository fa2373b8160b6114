"""Shared plumbing: table access, Arrow row batches, checkpoints, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; set one only where none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="attrilens-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a compressed table in the shared checkpoint folder, removed when the application ends."""
    return stored_for_now(df)[0]


def stored_for_now(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The same, and a function that removes the table before."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    sc = spark.sparkContext

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may have ended and its folder gone
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path), remove


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return ["" if v is None else v for v in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of about max_bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.nbytes <= max_bytes:
            yield batch
            continue
        k = batch.schema.get_field_index(column)
        start = size = 0
        for i, v in enumerate(batch.column(k)):
            n = 0 if not v.is_valid else v.as_buffer().size
            if i > start and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow form of a DDL schema; on the driver only."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow of a function from one record batch to a dict of columns."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def hashed_below(rows: DataFrame, limit: int, *columns: str) -> DataFrame:
    """Rows (h, columns) with the least hashes of the columns: limit of them and six deviations more, at any size of table."""
    n = rows.count()
    share = 1.0 if n <= limit else min(1.0, (limit + 6 * limit**0.5 + 36) / n)
    hashed = rows.select(F.xxhash64(*columns).alias("h"), *columns)
    return hashed.where(F.col("h") <= F.lit(int((2 * share - 1) * (2**63 - 1)))) if share < 1 else hashed


def least_hashed(rows: DataFrame, limit: int, measure: Callable[[str], object], schema: str, column: str) -> list:
    """measure(text) of the distinct rows with the least hashes, at most limit of them.

    Rows below a bound on the hash are measured in Arrow batches, and their
    number is cut on the driver.
    """
    near = hashed_below(rows, limit, *rows.columns).dropDuplicates(["h"]).select("h", "text")
    found = arrow_map(near, lambda b: {"h": b.column(0), column: [measure(t) for t in strings(b.column(1))]}, f"h long, {schema}")
    return [r[column] for r in sorted(found.collect(), key=lambda r: r["h"])[:limit]]


def free_name(base: str, taken: list[str]) -> str:
    """base, with as many underscores before it as make it new among the taken names (whatever their case)."""
    used = {x.lower() for x in taken}
    while base.lower() in used:
        base = "_" + base
    return base


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the least node.

    Large-star and small-star rounds: each node hands its neighbours to the
    least of them, so paths shorten geometrically. Only minima are grouped, no
    neighbour list is gathered, and each round ends in a reliable checkpoint.
    """
    e = cut(edges.where("a <> b").select("a", "b").distinct())
    before = None
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = cut(small.distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components: no fixed point")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
