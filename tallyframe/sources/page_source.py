"""Paged records as a data source for batches and streams: one partition per run of pages, offsets that are page names.

``register(spark)``, then ``spark.read.format("record_pages").load(folder)`` or ``readStream``. A row is one
record as JSON text with its page and its place there; ``records_of`` parses it to the caller's schema in the JVM.

Options: ``records`` (field that holds a page's list, ``studies``), ``pattern`` (page names, ``page=*.json``), ``meta`` (folder of
sidecars with the pages' names, whose ``retrieved_at_utc`` is shown), ``pagesPerTask`` (16), ``pagesPerBatch`` (none; a stream's batch).

A page that is no JSON object with such a list gives one row without a place and without a record, so that screening sends it to
quarantine. Pages are read by pyarrow's file systems, so a folder may be local, on HDFS or in an object store. A stream takes pages in the order of their names
and never reads a page again that a batch before has read; a page that comes later under a smaller name is not seen, so writers number
pages upwards.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

PAGE = "raw_page_reference"
SCHEMA = f"{PAGE} string, raw_ordinal long, retrieved_at_utc string, record string"
_ARROW = pa.schema([(PAGE, pa.string()), ("raw_ordinal", pa.int64()), ("retrieved_at_utc", pa.string()), ("record", pa.string())])
#: Filters on the page's name that choose pages before any is opened.
_TESTS = {
    EqualTo: lambda name, v: name == v, In: lambda name, v: name in v, GreaterThan: lambda name, v: name > v,
    GreaterThanOrEqual: lambda name, v: name >= v, LessThan: lambda name, v: name < v, LessThanOrEqual: lambda name, v: name <= v,
}


class Pages(InputPartition):
    def __init__(self, names: Sequence[str]):
        self.names = list(names)


class _Folder:
    """What batch and stream share: the folder's pages, and the rows of some of them."""

    def __init__(self, options: dict):
        self.path, self.meta = options["path"], options.get("meta")
        self.records, self.pattern = options.get("records", "studies"), options.get("pattern", "page=*.json")
        self.per_task = int(options.get("pagespertask", 16))

    def _opened(self, folder: str) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("/") else fs.FileSystem.from_uri(f"file:{folder}")

    def names(self, after: str = "") -> list[str]:
        from pyarrow import fs

        files, root = self._opened(self.path)
        found = files.get_file_info(fs.FileSelector(root))
        return sorted(f.base_name for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern) and f.base_name > after)

    def dealt(self, names: Sequence[str]) -> list[Pages]:
        return [Pages(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)]

    def _text(self, folder: str, name: str) -> bytes | None:
        files, root = self._opened(folder)
        try:
            with files.open_input_stream(f"{root}/{name}") as source:
                return source.read()
        except FileNotFoundError:
            return None

    def rows(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        for name in partition.names:
            retrieved = None
            if self.meta and (sidecar := self._text(self.meta, name)) is not None:
                retrieved = _field(sidecar, "retrieved_at_utc", str)
            if (page := self._text(self.path, name)) is None:
                raise FileNotFoundError(f"page {name} was listed and is gone")
            listed = _field(page, self.records, list)
            texts = [None] if listed is None else [json.dumps(r, ensure_ascii=False) for r in listed]
            places = [None] if listed is None else list(range(len(texts)))
            yield pa.RecordBatch.from_pydict({PAGE: [name] * len(texts), "raw_ordinal": places, "retrieved_at_utc": [retrieved] * len(texts), "record": texts}, schema=_ARROW)


def _field(text: bytes, name: str, kind: type):
    """A field of a JSON object if it is of that kind, else None."""
    try:
        value = json.loads(text)
    except ValueError:
        return None
    found = value.get(name) if isinstance(value, dict) else None
    return found if isinstance(found, kind) else None


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.chosen = _Folder(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and tuple(f.attribute) == (PAGE,):
                self.chosen.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        names = [n for n in self.folder.names() if all(_TESTS[type(f)](n, f.value) for f in self.chosen)]
        return self.folder.dealt(names) or [Pages([])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)


class PageStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.most, self.upto = _Folder(options), int(options.get("pagesperbatch", 0)), None

    def initialOffset(self) -> dict:
        return {"page": ""}

    def latestOffset(self) -> dict:
        """The newest page, or where batches are bounded the last that fits behind the offset before."""
        names = self.folder.names(self.upto or "")
        if names:
            self.upto = names[min(self.most, len(names)) - 1 if self.most else -1]
        return {"page": self.upto or ""}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # after a restart Spark plans the last batch again before it asks for the newest offset, which tells where this stream is
        self.upto = max(self.upto or "", end["page"])
        return self.folder.dealt([n for n in self.folder.names(start["page"]) if n <= end["page"]])

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageStreamReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the source known, and let filters reach its readers, which it needs."""
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of(rows: DataFrame, schema: StructType) -> DataFrame:
    """``record`` parsed to a struct, NULL where it is no object."""
    return rows.withColumn("record", F.from_json("record", schema))
