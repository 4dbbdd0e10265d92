"""Landed pages of list interfaces as a data source: ``spark.read.format("landed_pages")`` and ``readStream``.

Layout: ``<path>/<source>/page-<n>.json``, each ``{"data": {"list": [{...}, ...]}}``. Every page file is a partition of its own; filters on
``source`` and ``page`` choose the files before any is opened. A page that can't be read gives one row with an ``error``, and
:func:`by_source` takes all pages of that source out, and no other. The stream's offset is the last page of each source.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "source string, page int, place int, raw_id string, name string, race_date string, location string, body string, error string"
#: Columns of a listed entry and the keys that interfaces use for them.
KEYS = {"raw_id": ("id", "raceId"), "name": ("name", "raceName", "title"), "race_date": ("raceDate", "date", "raceTime"), "location": ("location", "raceAddress", "city")}
PAGE = re.compile(r"page-(\d+)\.json$")


class Page(InputPartition):
    def __init__(self, path: str, source: str, page: int):
        self.path, self.source, self.page = path, source, page


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int, str]]:
    """``(source, page, file)`` of all landed pages, in order."""
    from pyarrow import fs

    store, root = _store(path)
    found = []
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        hit = PAGE.search(info.path)
        if hit and info.type == fs.FileType.File:
            found.append((info.path.rsplit("/", 2)[-2], int(hit[1]), info.path))
    return sorted(found)


def rows(root: str, part: Page) -> Iterator[tuple]:
    """Entries of one page, or one row with the error."""
    try:
        store, _ = _store(root)
        with store.open_input_stream(part.path) as f:
            entries = json.loads(f.read().decode("utf-8"))["data"]["list"]
        if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
            raise TypeError("the list holds no entries")
        pick = lambda e, keys: next((str(e[k]) for k in keys if e.get(k) not in (None, "")), None)
        out = [(part.source, part.page, k, *(pick(e, keys) for keys in KEYS.values()), json.dumps(e, ensure_ascii=False, sort_keys=True), None) for k, e in enumerate(entries)]
    except Exception as e:  # noqa: BLE001 a page's failure is data here
        out = [(part.source, part.page, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300])]
    yield from out


class PageReader(DataSourceReader):
    TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b}

    def __init__(self, path: str):
        self.path = path
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the comparisons of source and page, which choose files; gives back the rest."""
        for f in filters:
            if type(f) in self.TESTS and f.attribute in (("source",), ("page",)):
                self.tests.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [Page(file, source, page) for source, page, file in listed(self.path) if all(self.TESTS[k](source if name == "source" else page, value) for k, name, value in self.tests)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        return rows(self.path, partition) if partition else iter(())  # without any page there is no partition


class PageStream(DataSourceStreamReader):
    """Pages of a source land in order, so the last page of each source says what was read."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        last: dict[str, int] = {}
        for source, page, _ in listed(self.path):
            last[source] = max(page, last.get(source, page))
        return last

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Page(file, source, page) for source, page, file in listed(self.path) if start.get(source, -1) < page <= end.get(source, -1)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        return rows(self.path, partition) if partition else iter(())


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if not (path := self.options.get("path")):
            raise ValueError("landed_pages needs a path")
        return path

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self._path())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(self._path())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets it push filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPages)


def by_source(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, failed sources)``: a source with a broken page gives no rows but its errors."""
    failed = pages.where("error is not null").groupBy("source").agg(F.count("*").alias("n_failed"), F.min_by("error", "page").alias("error"))
    return pages.where("error is null").join(F.broadcast(failed.select("source")) if failed.count() <= 10_000 else failed.select("source"), "source", "left_anti"), failed
