"""Vector caches as ``.npz`` archives (arrays hashes and embeddings) or JSON objects, as a Spark data source.

    spark.dataSource.register(VectorFiles)
    spark.read.format("vectors").load(path)
    df.write.format("vectors").option("kind", "npz").mode("append").save(path)

The reader plans row ranges of an archive as partitions from its array headers
alone, and a task seeks to its range; a compressed archive is read through up to
it. A JSON cache is parsed entry by entry from a window of text. Tasks write
files of at most ``rows_per_file`` rows aside; the commit moves them into place,
so a failed or repeated task leaves nothing behind. Paths may be of any file
system that pyarrow opens.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS_PER_PARTITION, ROWS_PER_FILE, ROWS_PER_BATCH = 50_000, 50_000, 1024
#: Characters of a JSON cache read at once.
WINDOW = 1 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """Cache files of a path (a file or a folder), without those still being written."""
    system, at = _open(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [at]
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".npz", ".json")) and not f.base_name.startswith(("_", ".")))


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    stop: int


def _header(archive: zipfile.ZipFile, name: str):
    """An array of the archive, opened at its first item: stream, number of rows, shape of a row, type."""
    stream = archive.open(f"{name}.npy")
    version = np.lib.format.read_magic(stream)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if fortran and len(shape) > 1:
        raise ValueError(f"{name}: columns first")
    return stream, shape[0], shape[1:], kind


def _rows(archive: zipfile.ZipFile, name: str, start: int, stop: int) -> Iterator[np.ndarray]:
    stream, _, rest, kind = _header(archive, name)
    width = kind.itemsize * int(np.prod(rest, dtype=np.int64))
    stream.seek(start * width, io.SEEK_CUR)
    for at in range(start, stop, ROWS_PER_BATCH):
        n = min(ROWS_PER_BATCH, stop - at)
        yield np.frombuffer(stream.read(n * width), kind).reshape(n, *rest)


def _batch(hashes: list[str], vectors: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int32)
    values = np.concatenate(vectors).astype(np.float32) if len(vectors) else np.zeros(0, np.float32)
    return pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["hash", "embedding"])


def _json_entries(stream) -> Iterator[tuple[str, list[float]]]:
    """Entries of one JSON object of arrays, from a window of its text."""
    decoder, text, at, more = json.JSONDecoder(), "", 0, True

    def fill() -> bool:
        nonlocal text, at, more
        got = stream.read(WINDOW)
        more = bool(got)
        text, at = text[at:] + got, 0
        return more

    def skip(chars: str) -> str:
        """The next character that is none of these, left in place."""
        nonlocal at
        while True:
            while at < len(text) and text[at] in chars:
                at += 1
            if at < len(text) or not fill():
                return text[at : at + 1]

    def value():
        nonlocal at
        while True:
            try:
                out, end = decoder.raw_decode(text, at)
                if end < len(text) or not more:  # a number could go on behind the window, an array or string not
                    at = end
                    return out
            except json.JSONDecodeError:
                if not more:
                    raise
            fill()

    space = " \t\r\n"
    if skip(space) != "{":
        raise ValueError("not a JSON object")
    at += 1
    while skip(space + ",") not in ("}", ""):
        key = value()
        skip(space + ":")
        yield key, value()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.rows = int(options.get("rows_per_partition", ROWS_PER_PARTITION))

    def partitions(self) -> list[Rows]:
        out = []
        system, _ = _open(self.path)
        for path in _files(self.path):
            if path.endswith(".json"):
                out.append(Rows(path, 0, -1))
                continue
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                n, m = (_header(archive, x)[1] for x in ("hashes", "embeddings"))
            if n != m:
                raise ValueError(f"{path}: {n} hashes, {m} embeddings")
            out += [Rows(path, a, min(n, a + self.rows)) for a in range(0, n, self.rows)]
        return out or [Rows("", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, _ = _open(self.path)
        with system.open_input_file(part.path) as f:
            if part.path.endswith(".json"):
                hashes, vectors = [], []
                for key, vector in _json_entries(io.TextIOWrapper(f, encoding="utf-8")):
                    hashes.append(key)
                    vectors.append(np.asarray(vector, np.float32))
                    if len(hashes) == ROWS_PER_BATCH:
                        yield _batch(hashes, vectors)
                        hashes, vectors = [], []
                if hashes:
                    yield _batch(hashes, vectors)
                return
            with zipfile.ZipFile(f) as archive:
                for hashes, vectors in zip(_rows(archive, "hashes", part.start, part.stop), _rows(archive, "embeddings", part.start, part.stop)):
                    yield _batch([str(h) for h in hashes.tolist()], list(vectors))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    """Files are written under a folder of this job's own and moved by the commit."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "npz"), overwrite
        self.rows, self.job = int(options.get("rows_per_file", ROWS_PER_FILE)), uuid.uuid4().hex
        if self.kind not in ("npz", "json"):
            raise ValueError(f"kind {self.kind}: npz or json")

    def _aside(self) -> tuple[fs.FileSystem, str, str]:
        system, at = _open(self.path)
        return system, at, f"{at}/_temporary-{self.job}"

    def write(self, rows: Iterator) -> Written:
        system, _, aside = self._aside()
        system.create_dir(aside, recursive=True)
        files, held = [], {}

        def flush() -> None:
            if not held:
                return
            name = f"part-{uuid.uuid4().hex}.{self.kind}"
            with system.open_output_stream(f"{aside}/{name}") as f:
                if self.kind == "json":
                    f.write(json.dumps({h: [float(x) for x in v] for h, v in held.items()}).encode())
                else:
                    if len({len(v) for v in held.values()}) > 1:
                        raise ValueError("an archive holds vectors of one length")
                    out = io.BytesIO()
                    np.savez(out, hashes=np.array(list(held), dtype=str), embeddings=np.array(list(held.values()), np.float32))
                    f.write(out.getbuffer())
            files.append(name)
            held.clear()

        for r in rows:
            held[r["hash"]] = r["embedding"]
            if len(held) >= self.rows:
                flush()
        flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, at, aside = self._aside()
        old = _files(self.path) if self.overwrite else []
        for m in messages:
            for name in m.files if m else ():
                system.move(f"{aside}/{name}", f"{at}/{name}")
        for path in old:
            system.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What tasks wrote aside goes, that of failed attempts too."""
        system, _, aside = self._aside()
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return "hash string, embedding array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)
