"""CSV with line ends inside fields, read by splits of a file, from bytes that need cleaning.

A split begins at a line, but not every line begins a record: it may lie inside
a quoted field. Read from outside or from inside of quotes, a split ends outside
or inside; a first pass notes both ends for each split, and these two-valued
functions are chained along each file. With its true start known, a split gives
its whole records in place; only the pieces of records that cross a border are
brought together. A task reads many small splits, and what is known of splits is
joined to their lines, so tasks and what each is sent grow with the input.

NUL bytes go before bytes are decoded, and bad UTF-8 becomes the replacement
character. Quotes open a field only at its start, as in the common CSV reader;
an open quote at the end of a file ends there, without the last line end.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

#: What a task reads at least, if that leaves some tasks for each core.
TASK_BYTES = 32 << 20

#: A field that opens with a quote up to its closing one, and the rest of a quoted field up to its closing quote.
_OPENING = re.compile(rb'"(?:[^"]|"")*+"(?!")')
_CLOSING = re.compile(rb'(?:[^"]|"")*+"(?!")')


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether quotes are open after a line that starts inside or outside of them."""
    if b'"' not in line:
        return inside
    at = 0
    if inside:
        closed = _CLOSING.match(line)
        if not closed:
            return True
        at = line.find(b",", closed.end()) + 1
        if not at:
            return False
    while True:
        if line[at : at + 1] == b'"':
            closed = _OPENING.match(line, at)
            if not closed:
                return True
            at = closed.end()
        at = line.find(b",", at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str, split_bytes: int | None) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    if split_bytes:
        splits = lines.rdd.getNumPartitions()
        lines = lines.coalesce(min(splits, max(4 * spark.sparkContext.defaultParallelism, splits * split_bytes // TASK_BYTES)) or 1)
    return lines


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows that follow each other with one key."""
    for batch in batches:
        new = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in key:
            new |= pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield tuple(batch.column(c)[a].as_py() for c in key), batch.slice(a, b - a)


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, from_outside, from_inside, closes) of each split: whether quotes are open at its end, and whether quotes open at its start are ever closed."""
    out = []
    for key, runs in itertools.groupby(_runs(batches, ["path", "block"]), lambda r: r[0]):
        outside, inside, closes = False, True, False
        for _, rows in runs:
            for line in rows.column("line").drop_null().to_pylist():
                line = line.replace(b"\0", b"")
                outside, inside = ends_inside(line, outside), ends_inside(line, inside)
                closes = closes or not inside
        out.append((*key, outside, inside, closes))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["path", "block", "from_outside", "from_inside", "closes"])


def _states(ends: DataFrame) -> DataFrame:
    """(path, block, starts, ends, begun) of all splits: whether they start and end inside quotes, and how many records before cross a border; a row a split, without text."""
    # Each split keeps the state, turns it, or sets it; the last that set it and the turns since decide.
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    sets = F.col("from_outside") == F.col("from_inside")
    turned = ends.withColumn("turns", F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int")).over(upto))
    last = F.last(F.when(sets, F.struct("from_outside", "turns")), ignorenulls=True).over(before)
    state = turned.select(*ends.columns, last.alias("set"), F.coalesce(F.max("turns").over(before), F.lit(0)).alias("now"))
    odd = (F.col("now") - F.coalesce("set.turns", F.lit(0))) % 2 == 1
    known = state.withColumn("starts", F.coalesce("set.from_outside", F.lit(False)) != odd)
    known = known.withColumn("ends", F.when(F.col("starts"), F.col("from_inside")).otherwise(F.col("from_outside")))
    # A split that ends inside begins a record there, unless one goes through it.
    begins = F.col("ends") & (~F.col("starts") | F.col("closes"))
    return known.select("path", "block", "starts", "ends", F.coalesce(F.sum(begins.cast("long")).over(before), F.lit(0)).alias("begun"))


_ROW = "path string, block long, no long, part string, record_no long, fields array<string>"
_ROW_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string())]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROW_TYPES)], names=["path", "block", "no", "part", "record_no", "fields"])


def _text_lines(rows: pa.RecordBatch) -> Iterator[str]:
    data = b"\n".join(rows.column("line").to_pylist()) + b"\n"
    return io.StringIO(data.replace(b"\0", b"").decode("utf-8", errors="replace"), newline="\n")


def _records(whole: bool, batch_rows: int = 2000):
    """mapInArrow function: fields of the whole records of each split, or of the pieces that cross its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        out: list[tuple] = []
        for key, runs in itertools.groupby(_runs(batches, ["path", "block", "starts", "ends", "begun"]), lambda r: r[0]):
            path, block, starts, ends, begun = key
            lines = itertools.chain.from_iterable(_text_lines(rows) for _, rows in runs)
            # An opening quote before the first line stands for one in a split before.
            found = enumerate(csv.reader(itertools.chain(['"'], lines) if starts else lines))
            held = next(found, None)
            for after in itertools.chain(found, [None]):
                no, fields = held
                first, last = starts and no == 0, ends and after is None
                if whole and not first and not last and fields:
                    out.append((path, block, no, "whole", None, fields))
                elif not whole and (first or last):
                    out.append((path, block, no, "through" if first and last else "head" if first else "tail", begun + (not first), fields))
                held = after
                if len(out) >= batch_rows:
                    yield _packed(out)
                    out.clear()
        if out:
            yield _packed(out)

    return run


def _joined(pieces: DataFrame) -> DataFrame:
    """Fields of the records whose pieces lie in several splits."""
    whole = pieces.groupBy("path", "record_no").agg(F.array_sort(F.collect_list(F.struct("block", "no", "part", "fields"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                tail, *rest = r["p"]
                cut = tail["fields"][-1] + "".join(x["fields"][0] for x in rest)
                if not rest or rest[-1]["part"] == "through":  # the file ends there
                    cut = cut.removesuffix("\n").removesuffix("\r")
                rows.append((r["path"], tail["block"], tail["no"], "whole", r["record_no"], [*tail["fields"][:-1], cut, *(rest[-1]["fields"][1:] if rest else [])]))
            if rows:
                yield _packed(rows)

    return whole.mapInArrow(run, _ROW)


def records(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(path, block, no, fields): every record of the files, header included; block and no give its order in its file."""
    folder = scratch.folder(spark)
    if split_bytes:
        spark = spark.newSession()
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    lines = _lines(spark, path, split_bytes)
    # Lines without quotes change nothing.
    quoted = lines.select(F.when(F.contains("value", F.lit('"')), F.col("value").cast("binary")).alias("line"), "path", "block")
    ends = quoted.mapInArrow(_split_ends, "path string, block long, from_outside boolean, from_inside boolean, closes boolean")
    _states(ends).write.parquet(folder)
    states = spark.read.parquet(folder)
    # Sent to all executors whatever its size, for lines keep their order only so: a row for each split that the driver has listed itself.
    known = lines.join(F.broadcast(states), ["path", "block"]).select(F.col("value").cast("binary").alias("line"), "path", "block", "starts", "ends", "begun")
    whole, pieces = (known.mapInArrow(_records(x), _ROW) for x in (True, False))
    return whole.union(_joined(pieces)).select("path", "block", "no", "fields")


def read(spark: SparkSession, path: str, split_bytes: int | None = None, blank_as_null: bool = True, columns: list[str] | None = None) -> DataFrame:
    """The files' rows as strings, named by their header, which all files share, or by columns where they have none; short rows end in nulls."""
    found = records(spark, path, split_bytes)
    if columns is None:
        heads = found.where("block = 0 and no = 0").select("fields").distinct().limit(2).collect()
        if len(heads) != 1:
            raise ValueError(f"files of different headers in {path}" if heads else f"no header in {path}")
        columns, found = heads[0]["fields"], found.where("block > 0 or no > 0")
    value = lambda k: F.nullif(F.get("fields", F.lit(k)), F.lit("")) if blank_as_null else F.get("fields", F.lit(k))
    return found.select(*[value(k).alias(name) for k, name in enumerate(columns)])
