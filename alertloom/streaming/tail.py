"""A stream source that tails one growing text file in byte ranges.

An offset is a byte position after a line's end, with the file's identity and a fingerprint of its head. The driver looks only at the
file's size, its head and the bytes around a cut; a batch is planned as ranges, and each range's lines are read by the task
that has it, one at a time, from the path that all executors must see (a shared mount, or one machine).
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD = 256
RANGE = 16 << 20
_STEP = 1 << 16


def identity(path: str) -> dict:
    """Device and inode, and length and SHA-256 of the first bytes."""
    stat = os.stat(path)
    with open(path, "rb") as f:
        head = f.read(HEAD)
    return {"file": f"{stat.st_dev}-{stat.st_ino}", "head": f"{len(head)}:{hashlib.sha256(head).hexdigest()}"}


def resume(path: str, offset: dict) -> int:
    """Where to go on: the start if the file is another one, has shrunk, or its head has changed."""
    size = os.path.getsize(path)
    at = int(offset.get("at", 0))
    if at == 0 or at > size or offset.get("file") != identity(path)["file"]:
        return 0
    length, _, digest = str(offset.get("head", "0:")).partition(":")
    with open(path, "rb") as f:
        head = f.read(int(length))
    return at if hashlib.sha256(head).hexdigest() == digest else 0


def line_end(path: str, at: int, limit: int | None = None) -> int:
    """The end of the last whole line after ``at``, within ``limit`` bytes if a line ends there, else of the first line after; ``at`` if none ends."""
    with open(path, "rb") as f:
        size = f.seek(0, os.SEEK_END)
        target = size if limit is None else min(size, at + limit)
        low = target
        while low > at:
            high, low = low, max(at, low - _STEP)
            f.seek(low)
            found = f.read(high - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
        f.seek(target)  # the line at ``at`` is longer than the limit
        while block := f.read(_STEP):
            found = block.find(b"\n")
            if found >= 0:
                return f.tell() - len(block) + found + 1
    return at


@dataclass
class LineRange(InputPartition):
    """The lines that begin in [start, end) of a file; ``first`` is where the batch begins, which is a line's begin."""

    path: str
    first: int
    start: int
    end: int


def lines(part: LineRange) -> Iterator[str]:
    """The lines of a range, blank ones left out; one line is in memory at a time."""
    with open(part.path, "rb") as f:
        f.seek(part.start)
        if part.start > part.first:
            f.seek(part.start - 1)
            f.readline()  # the rest of a line that began before
        at = f.tell()
        while at < part.end:
            line = f.readline()
            at += len(line)
            if line.strip():
                yield line.rstrip(b"\r\n").decode("utf-8", "replace")


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, size: int = RANGE, limit: int | None = None, progress: str | None = None):
        if limit is not None and progress is None:
            raise ValueError("bytesPerTrigger needs a progress file: the engine does not tell a restarted source where it is")
        self.path, self.size, self.limit, self.progress = path, size, limit, progress
        self.told: dict | None = None

    def initialOffset(self) -> dict:
        return {"at": 0, "file": "", "head": ""}

    def _from(self) -> dict:
        """The last offset that was told or committed."""
        if self.told is None and self.progress and os.path.exists(self.progress):
            with open(self.progress) as f:
                self.told = json.load(f)
        return self.told or self.initialOffset()

    def latestOffset(self) -> dict:
        if not os.path.exists(self.path):
            return self._from()
        at = resume(self.path, self._from())
        self.told = {"at": line_end(self.path, at, self.limit)} | identity(self.path)
        if self.told["at"] == at and at == self._from()["at"] == 0:
            self.told = None
            return self.initialOffset()
        return self.told

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        """Ranges of ``size`` bytes; none if the file that the batch was planned on is gone."""
        self.told = self.told or end
        if not os.path.exists(self.path) or resume(self.path, end) != int(end["at"]):
            return []
        first = resume(self.path, start)
        first = first if first <= int(end["at"]) else 0
        return [LineRange(self.path, first, at, min(at + self.size, int(end["at"]))) for at in range(first, int(end["at"]), self.size)]

    def read(self, partition: LineRange) -> Iterator[tuple]:
        return ((x,) for x in lines(partition))

    def commit(self, end: dict) -> None:
        if self.progress:
            with open(self.progress + ".new", "w") as f:
                json.dump(end, f)
            os.replace(self.progress + ".new", self.progress)


class TailSource(DataSource):
    """spark.readStream.format("tail").load(path) after spark.dataSource.register(TailSource).

    Options: rangeBytes (of a task, 16 MB), and bytesPerTrigger with progress, a file beside the checkpoint that keeps the last committed
    offset. A file that is rotated, has shrunk or changed its head is read from its start; lines of the old one that no batch
    had read yet are not found again.
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        limit = self.options.get("bytesPerTrigger")
        return _Reader(self.options["path"], int(self.options.get("rangeBytes", RANGE)), int(limit) if limit else None, self.options.get("progress"))
