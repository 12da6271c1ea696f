"""A catalogue that comes in pages, as a data source: a task for each saved page, retries, pushed filters.

A page is a JSON object whose `results` are rows. Pages lie as files below a folder that all executors
reach; nothing is fetched over a network. Options: `path`; `tries` and `wait` (seconds, doubling) for
pages that can't be read at once. Filters on single columns by equality, lists of values and null are
applied before rows become Spark's, where `spark.sql.python.filterPushdown.enabled` is set.

A file may hold many pages, one to a line. Large files are dealt to several tasks, each of which reads
the lines that begin in its range of bytes, a piece at a time; no task holds more than a piece, a page
and a batch of rows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.conversion import LocalDataToArrowConversion
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull
from pyspark.sql.types import StructType

from lexspan import stored

NAME = "saved_pages"
#: Rows of a catalogue.
CATALOGUE = "id long, title string, language string, text string"
#: Bytes of a file for a task, and of a piece that is read at once; characters that complete a batch of rows.
RANGE, PIECE, BATCH = 1 << 25, 1 << 20, 1 << 22


@dataclass
class Page(InputPartition):
    """The pages whose lines begin in bytes start to end of a file."""

    name: str  # in the file system of the reader's path
    start: int
    end: int


def retried(read: Callable[[], bytes], tries: int, wait: float) -> bytes:
    """What `read` gives, asked again after a wait that doubles; the last failure is raised."""
    for k in range(tries):
        try:
            return read()
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("tries must be 1 or more")


def lines(read: Callable[[int], bytes], start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in bytes start to end of a file; read(at): a piece of it, empty at its end."""
    at, begun, parts = max(start - 1, 0), start == 0, []  # the byte before the range may end a line
    while piece := read(at):
        *ended, rest = piece.replace(b"\r", b"\n").split(b"\n")
        for x in ended:
            if begun:
                yield b"".join([*parts, x])
            at += len(x) + 1
            begun, parts = True, []
            if at >= end:
                return
        parts += [rest] * begun
        at += len(rest)
    if begun:
        yield b"".join(parts)


def batches(rows: Iterable[tuple], schema: StructType):
    """Rows as Arrow batches that end by their characters, as texts can be long, or by their number."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if size >= BATCH or len(held) >= stored.ARROW_ROWS:
            yield from LocalDataToArrowConversion.convert(held, schema, False).to_batches()
            held, size = [], 0
    if held:
        yield from LocalDataToArrowConversion.convert(held, schema, False).to_batches()


def passes(filters: list[Filter]) -> Callable[[dict], bool]:
    """Whether a row passes filters as SQL has them: comparisons with null pass nothing."""

    def one(f: Filter) -> Callable[[dict], bool]:
        (column,) = f.attribute
        if isinstance(f, EqualTo):
            return lambda r: f.value is not None and r.get(column) == f.value
        if isinstance(f, EqualNullSafe):
            return lambda r: r.get(column) == f.value
        if isinstance(f, In):
            return lambda r: r.get(column) is not None and r.get(column) in f.value
        if isinstance(f, IsNull):
            return lambda r: r.get(column) is None
        return lambda r: r.get(column) is not None

    tests = [one(f) for f in filters]
    return lambda row: all(t(row) for t in tests)


class PagesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options, self.filters = [f.name for f in schema.fields], dict(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull)) and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Page]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.options["path"])
        found = store.get_file_info(fs.FileSelector(top, recursive=True))
        found = sorted((f.path, f.size) for f in found if f.is_file and f.size and not f.base_name.startswith((".", "_")))
        return [Page(p, k, min(k + RANGE, size)) for p, size in found for k in range(0, size, RANGE)]

    def read(self, partition: Page) -> Iterator[tuple]:
        from pyarrow import fs

        tries, wait, opened = int(self.options.get("tries", 3)), float(self.options.get("wait", 1.0)), []

        def piece(at: int) -> bytes:
            try:
                if not opened:
                    store, _ = fs.FileSystem.from_uri(self.options["path"])
                    opened.append(store.open_input_file(partition.name))
                return opened[0].read_at(PIECE, at)
            except OSError:
                opened.clear()  # and it is opened anew
                raise

        passing = passes(self.filters)
        for line in lines(lambda at: retried(lambda: piece(at), tries, wait), partition.start, partition.end):
            for row in json.loads(line.decode("utf-8")).get("results") or [] if line.strip() else []:
                if passing(row):
                    yield tuple(row.get(n) for n in self.names)


class BatchesReader(PagesReader):
    """PagesReader for Spark, which would gather rows by their number alone."""

    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.schema = schema

    def read(self, partition: Page) -> Iterator:
        return batches(super().read(partition), self.schema)


class SavedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return CATALOGUE

    def reader(self, schema: StructType) -> PagesReader:
        return BatchesReader(schema, self.options)


def read_pages(spark: SparkSession, path: str, tries: int = 3, wait: float = 1.0, schema: str = CATALOGUE) -> DataFrame:
    """The rows of all saved pages below a path."""
    spark.dataSource.register(SavedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).schema(schema).option("tries", tries).option("wait", wait).option("path", path).load()
