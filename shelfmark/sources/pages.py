"""Pages by address as a stream: lists of addresses that grow, read by ranges of bytes, fetched in tasks.

An offset is the number of bytes of each list that are done, always at the end of a line, and Spark keeps it in the query's
checkpoint. So a query that stops goes on with the next line, and a batch that runs again reads the same lines. The driver
looks at sizes and at the last bytes of lists alone; each task reads a range of ``slice`` bytes and fetches its addresses.

Lists only grow: a list shorter than its offset is an error, lines before an offset aren't read again, and a last line counts
when its end is written. Lines that don't start with http are passed over. An address that is listed twice is fetched twice;
a failure is a row's error. New lists may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .matrices import _open

PAGE = "url string, title string, text string, date string, error string"
#: (list, byte) is where the address's line begins
LISTED = f"list string, byte long, {PAGE}"
TAIL = 1 << 16


def page(fetch: Callable[[str], dict], url: str) -> tuple[str, str, str, str, str]:
    """PAGE of an address."""
    try:
        got = fetch(url)
        return url, got.get("title", ""), got.get("text", ""), got.get("date", ""), ""
    except Exception as e:  # noqa: BLE001
        return url, "", "", "", f"{type(e).__name__}: {e}"[:300]


@dataclass
class Lines(InputPartition):
    """The lines of a list that begin in [start, stop); its lines are whole up to ``end``."""

    name: str
    start: int
    stop: int
    end: int


def last_line_end(fs: pafs.FileSystem, name: str, size: int) -> int:
    """Where the last whole line of a file ends."""
    with fs.open_input_file(name) as f:
        while size > 0:
            at = max(0, size - TAIL)
            found = f.read_at(size - at, at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            size = at
    return 0


def lines(fs: pafs.FileSystem, own: Lines) -> Iterator[tuple[int, str]]:
    """(byte, line) of a range. A line belongs to the range in which it begins, and is read to its end."""
    with fs.open_input_file(own.name) as f:
        at = max(0, own.start - 1)  # a line begins at ``start`` if the byte before ends one
        data = f.read_at(own.stop - at, at)
        while not data.endswith(b"\n") and at + len(data) < own.end:
            more = f.read_at(min(4096, own.end - at - len(data)), at + len(data))
            data += more[: more.find(b"\n") + 1] or more
    if own.start > 0:
        first = data.find(b"\n") + 1
        at, data = (at + first, data[first:]) if first else (at, b"")
    for line in data.split(b"\n")[:-1]:
        yield at, line.decode("utf-8", "replace").strip()
        at += len(line) + 1


class Pages(DataSource):
    """Options: path, a list or a folder of lists; slice, bytes of a list to a task. A subclass has the fetcher."""

    fetch: Callable[[str], dict]

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return LISTED

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageReader(self.options["path"], int(self.options.get("slice", 4096)), type(self).fetch)


class PageReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int, fetch: Callable[[str], dict]):
        self.path, self.size, self.fetch = path, max(1, size), fetch

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            return {}
        files = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
        return {x.path: last_line_end(fs, x.path, x.size) for x in sorted(files, key=lambda x: x.path)}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        if gone := [name for name, at in start.items() if end.get(name, 0) < at]:
            raise ValueError(f"lists that are shorter than what was read of them: {gone}")
        return [Lines(name, at, min(at + self.size, stop), stop) for name, stop in end.items() for at in range(start.get(name, 0), stop, self.size)]

    def read(self, partition: Lines) -> Iterator[tuple]:
        fs, _ = _open(self.path)
        for at, url in lines(fs, partition):
            if url.startswith("http"):
                yield partition.name, at, *page(self.fetch, url)


def pages(spark: SparkSession, path: str, fetch: Callable[[str], dict], slice_bytes: int = 4096) -> DataFrame:
    """A stream of LISTED from the lists of addresses below a path."""
    own = type("ListedPages", (Pages,), {"fetch": staticmethod(fetch), "__module__": "__main__"})
    spark.dataSource.register(own)
    return spark.readStream.format(Pages.name()).options(path=path, slice=slice_bytes).load()
