"""The first and the last lines of text files, without reading what is between them.

Spark's text reader takes files from end to end. Detection needs twenty lines of a file and a tail a few more, so here
each file is opened by the task that has it in its list, read in pieces from the edge that is asked for, and left as soon
as there is enough. What is read depends on the lines that are wanted, not on the length of the files. Stores have to be
known to Arrow's file systems; for others use :func:`lodeglass.sources.lines.read_lines`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.functions.text import UNICODE_SPACE

#: Bytes that are read at once; backwards, each further piece is twice as long.
PIECE = 1 << 16
#: Lines that are sent on at once.
_ROWS = 1000
_COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")


def _files(spark: SparkSession, path: str, source: Column | None) -> DataFrame:
    """Files as rows; their content is not read."""
    files = spark.read.format("binaryFile").load(path)
    source = F.col("_metadata.file_path") if source is None else source
    return files.select(source.alias("source_id"), "path")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _forward(path: str) -> Iterator[tuple[int, bytes]]:
    """Lines from the start with their byte offsets, read as they are asked for; compressed files are unpacked."""
    store, name = _opened(path)
    with store.open_input_stream(name) as stream:
        at, rest = 0, []
        while piece := stream.read(PIECE):
            rest.append(piece)
            if b"\n" not in piece:
                continue
            *whole, last = b"".join(rest).split(b"\n")
            rest = [last]
            for line in whole:
                yield at, line
                at += len(line) + 1
        if last := b"".join(rest):
            yield at, last


def _last(path: str, n: int) -> list[tuple[int, bytes]]:
    """The last ``n`` lines with their byte offsets, in order; of compressed files by going through them."""
    if path.endswith(_COMPRESSED):
        kept: list[tuple[int, bytes]] = []
        for line in _forward(path):
            kept.append(line)
            if len(kept) >= 2 * n + _ROWS:
                del kept[:-n]
        return kept[-n:]
    store, name = _opened(path)
    with store.open_input_file(name) as file:
        end = file.size()
        start, step, pieces, breaks = end, PIECE, [], 0
        # one more line feed than lines, as the last line may end in one
        while start > 0 and breaks <= n:
            low = max(0, start - step)
            file.seek(low)
            pieces.append(file.read(start - low))
            breaks += pieces[-1].count(b"\n")
            start, step = low, 2 * step
    lines = b"".join(reversed(pieces)).split(b"\n")
    if lines and not lines[-1]:
        lines.pop()
    found, at = [], start
    for line in lines:
        found.append((at, line))
        at += len(line) + 1
    return found[-n:]


def _sent(source: str, lines: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(lines), _ROWS):
        part = lines[low : low + _ROWS]
        yield pa.RecordBatch.from_pydict(
            {
                "source_id": pa.array([source] * len(part), pa.string()),
                "line_no": pa.array([at for at, _ in part], pa.int64()),
                "value": pa.array([line.decode("utf-8", "replace") for _, line in part], pa.string()),
            }
        )


def _each(files: DataFrame, lines_of) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _sent(row["source_id"], lines_of(row["path"]))

    return files.mapInArrow(read, "source_id string, line_no long, value string")


def first_lines(spark: SparkSession, path: str, n: int, source: Column | None = None) -> DataFrame:
    """``source_id, line_no, value`` of the first ``n`` lines of every file, and of the first line after them that is not
    blank if those have fewer that are not: all lines that :func:`lodeglass.operators.detect.detect_format` looks at.

    A source is a file, and ``line_no`` a byte offset, which orders its lines.
    """

    def lines_of(name: str) -> list[tuple[int, bytes]]:
        kept = []
        for at, line in _forward(name):
            if len(kept) < n:
                kept.append((at, line))
            elif line.decode("utf-8", "replace").strip(UNICODE_SPACE):
                kept.append((at, line))
                break
        return kept

    return _each(_files(spark, path, source), lines_of)


def last_lines(spark: SparkSession, path: str, n: int, source: Column | None = None) -> DataFrame:
    """``source_id, line_no, value`` of the last ``n`` lines of every file, read backwards from its end; see
    :func:`first_lines` for the columns."""
    if n <= 0:
        raise ValueError("n has to be positive")
    return _each(_files(spark, path, source), lambda name: _last(name, n))
