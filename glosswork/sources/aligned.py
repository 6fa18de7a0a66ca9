"""Two aligned text files as one source of numbered line pairs: ``spark.read.format("moses")``.

Options: ``source`` and ``target`` name the files, ``blockBytes`` the size of the byte ranges.  Lines end at LF, one CR before it is dropped, a byte order mark
at the start too; rows go up to the end of the shorter file.  A first pass counts the line ends of each range (``mode=count``
gives them as rows); from these a task knows which lines start in its range of the source, where the same
lines are in the target, and reads both side by side: no shuffle, no join.  ``blocks`` hands the counts over, ``from`` and ``to`` bound the
lines, and ranges without any of them are not read.  Without ``blocks`` the planner itself counts.

:class:`AlignedFiles` does both passes on the executors.  Files in a store that only Spark reads are read by sources.moses instead.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK_BYTES, MOST_BLOCKS = 64 << 20, 50_000
BATCH_LINES, BATCH_BYTES, CHUNK = 10_000, 4 << 20, 1 << 20
PAIR_SCHEMA, COUNT_SCHEMA = "line_no bigint, source_raw string, target_raw string", "side int, block int, ends bigint, open boolean"
BOM = b"\xef\xbb\xbf"


def local_path(path: str) -> str:
    return urlparse(path).path if path.startswith("file:") else path


def blocks_of(size: int, block_bytes: int) -> int:
    return max(1, -(-size // block_bytes))


def count_ends(path: str, block: int, block_bytes: int) -> tuple[int, bool]:
    """(line ends in the byte range, whether a line without an end is behind its last byte, the file's)."""
    ends, left, last = 0, block_bytes, b"\n"
    with open(path, "rb") as f:
        size = os.fstat(f.fileno()).st_size
        f.seek(block * block_bytes)
        while left and (chunk := f.read(min(CHUNK, left))):
            ends += chunk.count(b"\n")
            left -= len(chunk)
            last = chunk[-1:]
    return ends, (block + 1) * block_bytes >= size and last != b"\n"


class Side:
    """One file by its counted ranges: ``before[b]`` line ends lie before range ``b``."""

    def __init__(self, path: str, ends: list[int], open_end: bool, block_bytes: int):
        self.path, self.block_bytes, self.before = path, block_bytes, [0]
        for n in ends:
            self.before.append(self.before[-1] + n)
        self.lines = self.before[-1] + open_end

    def starts(self, block: int) -> tuple[int, int]:
        """The lines that start in a range, as [first, last)."""
        return self.before[block] + (block > 0), self.before[block + 1] + 1

    def place(self, line: int) -> tuple[int, int]:
        """(offset of a range, line ends to pass from there) to get to a line."""
        block = max(0, bisect_left(self.before, line) - 1)
        return block * self.block_bytes, line - self.before[block]


class LinesPartition(InputPartition):
    def __init__(self, first: int, last: int, source: tuple, target: tuple):
        self.first, self.last, self.source, self.target = first, last, source, target


class BlockPartition(InputPartition):
    def __init__(self, side: int, block: int, path: str, block_bytes: int):
        self.side, self.block, self.path, self.block_bytes = side, block, path, block_bytes


class CountReader(DataSourceReader):
    def __init__(self, paths: list[str], block_bytes: int):
        self.paths, self.block_bytes = paths, block_bytes

    def partitions(self) -> list[InputPartition]:
        return [BlockPartition(i, b, p, self.block_bytes) for i, p in enumerate(self.paths) for b in range(blocks_of(os.path.getsize(p), self.block_bytes))]

    def read(self, partition: BlockPartition):
        yield (partition.side, partition.block, *count_ends(partition.path, partition.block, partition.block_bytes))


class PairReader(DataSourceReader):
    def __init__(self, paths: list[str], block_bytes: int, counts: list | None, first: int, last: int | None):
        self.paths, self.block_bytes, self.counts, self.first, self.last = paths, block_bytes, counts, first, last

    def partitions(self) -> list[InputPartition]:
        counts = self.counts
        if counts is None:
            counts = []
            for p in self.paths:
                found = [count_ends(p, b, self.block_bytes) for b in range(blocks_of(os.path.getsize(p), self.block_bytes))]
                counts.append([[n for n, _ in found], found[-1][1]])
        source, target = (Side(p, *c, self.block_bytes) for p, c in zip(self.paths, counts, strict=True))
        end = min(source.lines, target.lines)
        end = end if self.last is None else min(end, self.last)
        out = []
        for block in range(len(source.before) - 1):
            a, b = source.starts(block)
            a, b = max(a, self.first), min(b, end)
            if a < b:
                out.append(LinesPartition(a, b, (source.path, *source.place(a)), (target.path, *target.place(a))))
        return out

    def read(self, partition: LinesPartition | None):
        if partition is None:  # no range has any of the lines
            return

        def lines(path: str, offset: int, skip: int):
            with open(path, "rb") as f:
                f.seek(offset)
                for _ in range(skip):
                    f.readline()
                if offset == 0 and skip == 0 and f.read(len(BOM)) != BOM:
                    f.seek(0)
                while True:
                    line = f.readline()
                    line = line[:-1] if line.endswith(b"\n") else line
                    yield line[:-1] if line.endswith(b"\r") else line

        names, first, left, right, size = ["line_no", "source_raw", "target_raw"], partition.first, [], [], 0

        def batch():
            texts = [pa.array([x.decode("utf-8", "replace") for x in side], pa.string()) for side in (left, right)]
            return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(left)), pa.int64()), *texts], names=names)

        sides = zip(lines(*partition.source), lines(*partition.target))
        for _, (a, b) in zip(range(partition.first, partition.last), sides):
            left.append(a)
            right.append(b)
            size += len(a) + len(b)
            if len(left) >= BATCH_LINES or size >= BATCH_BYTES:
                yield batch()
                first, left, right, size = first + len(left), [], [], 0
        if left:
            yield batch()


class MosesDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "moses"

    def schema(self) -> str:
        return COUNT_SCHEMA if self.options.get("mode") == "count" else PAIR_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        paths = [local_path(self.options[k]) for k in ("source", "target")]
        block_bytes = int(self.options.get("blockBytes", BLOCK_BYTES))
        if self.options.get("mode") == "count":
            return CountReader(paths, block_bytes)
        counts = self.options.get("blocks")
        last = self.options.get("to")
        return PairReader(paths, block_bytes, json.loads(counts) if counts else None, int(self.options.get("from", 0)), int(last) if last is not None else None)


class AlignedFiles:
    """Two files counted once: their lengths in lines, and any range of their lines."""

    def __init__(self, spark: SparkSession, source: str, target: str, block_bytes: int | None = None):
        spark.dataSource.register(MosesDataSource)
        size = max(os.path.getsize(local_path(p)) for p in (source, target))
        # Ranges grow with the files, so that their number, which passes the planner, stays bounded.
        self.spark, self.paths, self.block_bytes = spark, (source, target), block_bytes or max(BLOCK_BYTES, size // MOST_BLOCKS + 1)
        found = self._read().option("mode", "count").load().orderBy("side", "block").collect()
        self.counts = [[[r["ends"] for r in found if r["side"] == i], next(r["open"] for r in reversed(found) if r["side"] == i)] for i in (0, 1)]
        self.lengths = tuple(sum(ends) + is_open for ends, is_open in self.counts)

    def _read(self):
        return self.spark.read.format("moses").option("source", self.paths[0]).option("target", self.paths[1]).option("blockBytes", str(self.block_bytes))

    def lines(self, first: int = 0, last: int | None = None) -> DataFrame:
        """line_no, source_raw, target_raw of the lines from ``first`` to before ``last``, at most to the shorter file's end."""
        read = self._read().option("blocks", json.dumps(self.counts)).option("from", str(first))
        return (read if last is None else read.option("to", str(last))).load()


class NumberedFiles:
    """As :class:`AlignedFiles` for files that only Spark reads: lines are numbered by block and joined."""

    def __init__(self, spark: SparkSession, source: str, target: str):
        from glosswork.sources.moses import misalignment, read_lines

        self.source, self.target = read_lines(spark, source), read_lines(spark, target)
        self.lengths = tuple(misalignment(self.source, self.target).first())[:2]

    def lines(self, first: int = 0, last: int | None = None) -> DataFrame:
        from glosswork.sources.moses import zip_lines

        both = zip_lines(self.source, self.target).where(F.col("line_no") >= first)
        return both if last is None else both.where(F.col("line_no") < last)


def aligned_files(spark: SparkSession, source: str, target: str) -> AlignedFiles | NumberedFiles:
    """The reader for where the files are."""
    return (AlignedFiles if all(urlparse(p).scheme in ("", "file") for p in (source, target)) else NumberedFiles)(spark, source, target)
