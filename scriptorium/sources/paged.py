"""Paged listings as Spark data sources: offsets are partitions of a batch read, continuation tokens the offsets of a stream.

`register_pages` gives a listing a name. `spark.read.format(name)` reads all pages of a query that tells its total, each page in a task of its own.
`spark.readStream.format(name)` follows the tokens that answers name; how far it came is in the query's checkpoint, so a read that
was broken off goes on at its token and what it has written isn't fetched again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .fetch import Fetcher, with_retry

PAGE, ITEM = "offset long, body string", "token string, item string"


class OffsetReader(DataSourceReader):
    """A partition for each page: the first answer tells the total."""

    def __init__(self, ask: Callable[[dict], str], total: Callable[[str], int], page: int, start: str, size: str):
        self.ask, self.total, self.page, self.start, self.size = ask, total, page, start, size

    def partitions(self) -> list[InputPartition]:
        first = self.ask({self.start: 1, self.size: self.page})
        return [InputPartition(offset) for offset in range(1, max(1, self.total(first)) + 1, self.page)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield partition.value, self.ask({self.start: partition.value, self.size: self.page})


class TokenReader(SimpleDataSourceStreamReader):
    """A micro-batch for each page. An offset is what to ask for next, as JSON; null once an answer names nothing more."""

    def __init__(self, ask: Callable[[dict], str], token: Callable[[dict], dict | None], items: Callable[[dict], list]):
        self.ask, self.token, self.items = ask, token, items

    def initialOffset(self) -> dict:
        return {"next": "{}"}

    def answered(self, start: dict) -> tuple[list[tuple], dict]:
        payload = json.loads(self.ask(json.loads(start["next"])))
        more = self.token(payload)
        rows = [(start["next"], json.dumps(x, sort_keys=True)) for x in self.items(payload)]
        return rows, {"next": None if more is None else json.dumps(more, sort_keys=True)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["next"] is None:
            return iter([]), start
        rows, end = self.answered(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start != end and start["next"] is not None:
            rows, start = self.answered(start)
            yield from rows


def register_pages(
    spark: SparkSession, name: str, fetch: Fetcher, url: str, params: dict | None = None, total: Callable[[str], int] | None = None, token: Callable[[dict], dict | None] | None = None,
    items: Callable[[dict], list] | None = None, page: int = 100, start: str = "startRecord", size: str = "maximumRecords", tries: int = 5, wait: Callable[[int], float] = lambda i: min(2.0**i, 30.0),
) -> str:
    """Register a listing under a name; with `total` for batch reads of PAGE, with `token` and `items` for streams of ITEM."""
    fixed = dict(params or {})

    def ask(more: dict) -> str:
        return with_retry(fetch, url, {**fixed, **more}, tries, wait)[1]

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGE if total is not None else ITEM

        def reader(self, schema) -> DataSourceReader:
            return OffsetReader(ask, total, page, start, size)

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return TokenReader(ask, token, items)

    spark.dataSource.register(Pages)
    return name
