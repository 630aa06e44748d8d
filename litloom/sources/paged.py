"""A paged service as a Python data source: one partition for each window, replies cached by window.

``fetch`` is the path of an importable function (window, page) -> list of records, empty after the last
page, so that tests and offline runs replay recorded pages.
"""

from __future__ import annotations

import importlib
import json
import time
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedSource(DataSource):
    """Options: fetch (``module:function``), windows (comma-separated), cache (a shared folder, may be
    empty), pause (seconds between pages), tries, back_off (seconds before the second try, doubled after
    each).  An OSError with a number ``after`` waits so many seconds instead."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "window string, page int, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(w) for w in self.options.get("windows", "").split(",") if w]

    def read(self, partition: InputPartition):
        window = partition.value
        cache = Path(self.options["cache"], f"{window}.jsonl") if self.options.get("cache") else None
        if cache and cache.exists():
            for line in cache.read_text().splitlines():
                yield tuple(json.loads(line))
            return
        module, name = self.options["fetch"].split(":")
        fetch, rows, page = getattr(importlib.import_module(module), name), [], 0
        while records := self._retried(fetch, window, page):
            rows += [(window, page, json.dumps(r)) for r in records]
            page += 1
            time.sleep(float(self.options.get("pause", 0)))
        if cache:
            cache.parent.mkdir(parents=True, exist_ok=True)
            part = cache.with_suffix(".part")
            part.write_text("".join(json.dumps(r) + "\n" for r in rows))
            part.rename(cache)  # a lost executor leaves no half window behind
        yield from rows

    def _retried(self, fetch, window: str, page: int):
        tries = int(self.options.get("tries", 6))
        for attempt in range(tries):
            try:
                return fetch(window, page)
            except OSError as e:
                if attempt + 1 == tries:
                    raise
                after = getattr(e, "after", None)  # what a busy host asks for
                time.sleep(min(60.0, 2.0**attempt * float(self.options.get("back_off", 1))) if after is None else after)
