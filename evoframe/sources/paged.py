"""A JSON service that answers page by page, as a Spark data source.

One small request finds how many records there are; each page is then a partition of its
own, so pages are fetched by all tasks and a lost task costs its page again. The columns
wanted are asked for where the service can send only some (option ``only``).

    spark.dataSource.register(PagedSource)
    spark.read.format("paged_json").schema("molecule_chembl_id string, pchembl_value double").options(
        url=..., query="target_chembl_id=CHEMBL279&standard_type=IC50", records="activities").load()

Options: ``url``; ``query``, further parameters, URL-encoded; ``records`` and ``total``, the
names under which an answer holds its records and their number in all, dotted where they are
nested; ``limit``, ``offset`` and ``only``, the names of these parameters; ``page`` (1000)
records a request; ``most`` records in all; ``tries`` (4) for a request that fails for a
reason that may pass, waiting ``backoff`` (2) seconds at first and twice as long each time;
``pause`` (0.2) seconds between the requests of a task; ``timeout`` (120) seconds.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from http.client import HTTPException

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

#: Answers after which a request is tried again.
PASSING = (429, 500, 502, 503, 504)
_KINDS = {StringType: str, DoubleType: float, FloatType: float, LongType: int, IntegerType: int, BooleanType: bool}


def get_json(url: str, timeout: float = 120, tries: int = 4, backoff: float = 2.0):
    """The answer to one request, tried again after refusals and broken connections that may pass."""
    for attempt in range(1, tries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return json.load(answer)
        except (urllib.error.URLError, HTTPException, ConnectionError, TimeoutError) as refused:
            code = getattr(refused, "code", None)
            if attempt == tries or (code is not None and code not in PASSING):
                raise RuntimeError(f"{url} failed after {attempt} of {tries} tries: {refused}; try later, or fetch fewer records") from refused
        time.sleep(backoff * 2 ** (attempt - 1))
    raise ValueError("a request needs one try at least")


def _at(answer, path: str):
    for name in path.split("."):
        answer = answer[name]
    return answer


@dataclass
class Page(InputPartition):
    """The records from ``start`` on, ``count`` of them."""

    start: int
    count: int


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        for field in schema:
            if type(field.dataType) not in _KINDS:
                raise ValueError(f"column {field.name} is of no plain type")
        self.fields = [(f.name, _KINDS[type(f.dataType)]) for f in schema]
        self.options = {k.lower(): v for k, v in options.items()}
        if "url" not in self.options:
            raise ValueError("a paged source needs the option url")
        self.page = int(self.options.get("page", 1000))
        if self.page < 1:
            raise ValueError("a page holds one record at least")

    def _ask(self, start: int, count: int):
        given = self.options.get
        wanted = urllib.parse.parse_qsl(given("query", ""))
        wanted += [(given("limit", "limit"), count), (given("offset", "offset"), start)]
        if given("only"):
            wanted.append((given("only"), ",".join(name for name, _ in self.fields)))
        url = f"{given('url')}?{urllib.parse.urlencode(wanted)}"
        return get_json(url, float(given("timeout", 120)), int(given("tries", 4)), float(given("backoff", 2.0)))

    def partitions(self) -> list[Page]:
        total = int(_at(self._ask(0, 1), self.options.get("total", "page_meta.total_count")))
        if "most" in self.options:
            total = min(total, int(self.options["most"]))
        return [Page(at, min(self.page, total - at)) for at in range(0, total, self.page)] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        at, end = partition.start, partition.start + partition.count
        while at < end:  # a service may send fewer records than it is asked for
            if at > partition.start:
                time.sleep(float(self.options.get("pause", 0.2)))
            records = _at(self._ask(at, end - at), self.options.get("records", "records"))[: end - at]
            if not records:
                return
            for record in records:
                yield tuple(None if record.get(name) is None else kind(record[name]) for name, kind in self.fields)
            at += len(records)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self):
        raise ValueError("a paged source is read with the schema of the columns wanted")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)
