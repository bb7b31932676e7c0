"""Listings of a remote tree, page by page, as a Spark data source. What fetches a page is given by the caller."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: fetch(path or None, page token or None) -> {files: [{name, bytes, date}], directories: [path], next: token or None}
Fetch = Callable[[str | None, str | None], dict[str, Any]]
SCHEMA = "nome string, bytes bigint, data string"


def listing(fetch: Fetch, path: str | None = None) -> Iterator[tuple[str, int, str]]:
    """Every file below a path: all pages of a folder, then its folders."""
    waiting = [path]
    while waiting:
        here, token = waiting.pop(), None
        while True:
            page = fetch(here, token)
            for f in page.get("files", ()):
                yield f["name"], int(f.get("bytes") or 0), f.get("date") or ""
            waiting += page.get("directories", ())
            token = page.get("next")
            if not token:
                break


class TreeReader(DataSourceReader):
    """One task per top folder."""

    def __init__(self, fetch: Fetch) -> None:
        self.fetch = fetch

    def partitions(self) -> list[InputPartition]:
        tops, token = [None], None
        while True:
            page = self.fetch(None, token)
            tops += page.get("directories", ())
            token = page.get("next")
            if not token:
                return [InputPartition(t) for t in tops]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        if partition.value is not None:
            yield from listing(self.fetch, partition.value)
            return
        token = None
        while True:  # the files of the root itself
            page = self.fetch(None, token)
            for f in page.get("files", ()):
                yield f["name"], int(f.get("bytes") or 0), f.get("date") or ""
            token = page.get("next")
            if not token:
                break


def tree_source(fetch: Fetch, name: str = "tree") -> type[DataSource]:
    """A data source class to register with spark.dataSource.register(); then spark.read.format(name).load()."""

    class Tree(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: Any) -> DataSourceReader:
            return TreeReader(fetch)

    return Tree


def call_body(method: str, arguments: dict[str, Any], number: int = 1) -> str:
    """The body of a JSON-RPC tool call."""
    return json.dumps({"jsonrpc": "2.0", "id": number, "method": "tools/call", "params": {"name": method, "arguments": arguments}}, ensure_ascii=False)


def event_data(stream: Column) -> Column:
    """array<string>: the data of each event of a server-sent stream, its lines put together."""
    events = F.split(F.regexp_replace(stream, "\r\n?", "\n"), "\n\n+")
    lines = F.transform(events, lambda e: F.array_join(F.regexp_extract_all(e, F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n"))
    return F.filter(lines, lambda d: d != "")
