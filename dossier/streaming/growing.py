"""A streaming source for growing text files: it knows how far each file was read, in bytes, and reads only what came after.

`spark.readStream.format("growing_lines")` gives (path, offset, line): every complete line of every file below `path`, once, with
the place where it begins. An offset of the stream is the end of the last complete line of each file, so a line that is still
being written waits, and a restart from a checkpoint goes on where the last committed batch ended. Files are known by their
whole path. Appended bytes are read in pieces of PIECE bytes by many tasks; a piece begins after the first line end behind
its start and reads on to the end of its last line. Files are opened through pyarrow's file systems, so a folder may lie
on any store that they know.

Defined results: a file that has become shorter than what was read, or is gone, stops the stream with its path; empty files and
files without a line end give no rows; `\\r` before a line end stays out of the line; bytes that aren't UTF-8 are replaced.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PIECE, TAIL = 32 << 20, 64 << 10
SCHEMA = "path string, offset long, line string"


def file_system(path: str):
    """pyarrow's file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if urlparse(path).scheme:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def last_line_end(open_file, start: int, size: int) -> int:
    """The place after the last line end in [start, size), or start; reads backwards, TAIL bytes at a time."""
    end = size
    while end > start:
        begin = max(start, end - TAIL)
        open_file.seek(begin)
        at = open_file.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return start


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int
    first: bool  # begins at a line


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.suffix = options.get("suffix", "")
        self.piece = int(options.get("piece", PIECE))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, folder = file_system(self.folder)
        found = {}
        for info in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and info.path.endswith(self.suffix) and not info.base_name.startswith((".", "_")):
                start = self.known.get(info.path, 0)
                if info.size < start:
                    raise ValueError(f"{info.path} has become shorter: {info.size} bytes, {start} were read")
                if info.size > start:
                    with system.open_input_file(info.path) as f:
                        found[info.path] = last_line_end(f, start, info.size)
                elif start:
                    found[info.path] = start
        for path in self.known.keys() - found.keys():
            raise ValueError(f"{path} is gone; {self.known[path]} bytes of it were read")
        self.known = {p: n for p, n in found.items() if n}
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.known = {**after, **self.known}  # after a restart
        pieces = []
        for path, stop in sorted(after.items()):
            begin = before.get(path, 0)
            if stop < begin:
                raise ValueError(f"{path} has become shorter: {stop} bytes, {begin} were read")
            cuts = [*range(begin, stop, self.piece), stop]
            pieces += [Piece(path, a, b, a == begin) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pieces

    def read(self, piece: Piece) -> Iterator[tuple[str, int, str]]:
        system, _ = file_system(self.folder)
        with system.open_input_file(piece.path) as f:
            at = piece.start
            f.seek(at)
            data = f.read(piece.end - at)
            if not piece.first:  # the piece before reads this one's first, broken line
                f.seek(at - 1)
                if f.read(1) != b"\n":
                    cut = data.find(b"\n") + 1
                    if not cut:
                        return
                    at, data = at + cut, data[cut:]
            parts = [data]
            f.seek(piece.end)
            while parts[-1][-1:] not in (b"\n", b""):  # read on to the end of the last line
                more = f.read(TAIL)
                cut = more.find(b"\n") + 1
                parts.append(more[: cut or len(more)])
            data = b"".join(parts)
        for raw in data.split(b"\n")[:-1]:
            yield piece.path, at, raw.removesuffix(b"\r").decode("utf-8", "replace")
            at += len(raw) + 1

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Options: path (a folder), suffix of the files, piece (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def growing_lines(spark: SparkSession, folder: str, suffix: str = "", piece: int = PIECE) -> DataFrame:
    """A streaming table (path, offset, line) of the files below a folder."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("suffix", suffix).option("piece", piece).load(folder)


def csv_rows(lines: DataFrame, schema: str) -> DataFrame:
    """path, offset and the columns of CSV lines; each file's first line is its header."""
    rows = lines.where("offset > 0 and trim(line) <> ''")
    return rows.select("path", "offset", F.from_csv("line", schema).alias("r")).select("path", "offset", "r.*")


class Idle(TimeoutError):
    """No new line and no end marker for longer than allowed."""


def follow(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, marker: str | None = None, idle: float = 1800.0,
           every: float = 10.0, clock=time.monotonic, sleep=time.sleep) -> int:
    """Append the rows of growing CSV files to a Parquet table until a line begins with the marker; the number of lines read.

    Each poll is one run of the stream over what was appended. Without a new line for `idle` seconds it fails with Idle; a
    call after that, or after a crash, goes on from the checkpoint. Without a marker one poll is all."""
    total, last = 0, clock()
    while True:
        lines = growing_lines(spark, folder)
        is_end = F.col("line").startswith(marker) if marker is not None else F.lit(False)
        seen = lines.observe("followed", F.count("*").alias("n"), F.coalesce(F.max(is_end), F.lit(False)).alias("ended"))
        query = (
            csv_rows(seen.where(~is_end), schema).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        metrics = [p.observedMetrics["followed"] for p in query.recentProgress if "followed" in p.observedMetrics]
        n, ended = sum(m["n"] for m in metrics), any(m["ended"] for m in metrics)
        total += n
        if ended or marker is None:
            return total
        if n:
            last = clock()
        elif clock() - last > idle:
            raise Idle(f"no new line below {folder} for {idle:g} seconds, and none begins with {marker!r}")
        sleep(every)
