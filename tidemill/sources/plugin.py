"""Crawler plug-ins as a Python data source, for batches and for streams.

    spark.read.format("tidemill_crawl").option("module", "demo_crawler").load()
    spark.readStream.format("tidemill_crawl").option("path", "/plugins/demo_crawler.py").load()

A batch plug-in is a module with partitions(options) -> list of tasks and fetch(task, options) -> iterable of rows in the
order of SCHEMA. A stream's plug-in is a file on the driver (or, with option code, its text) with latest(options) -> number of items there are by now, tasks(start, end,
options) -> list of tasks for the items from start to before end, and fetch. Tasks run on executors, each by itself, so a lost
one is fetched again.
"""

from __future__ import annotations

import functools
import hashlib
import importlib
import types

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "uuid string, informant string, title string, content string, pub_time string"


class CrawlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemill_crawl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CrawlReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CrawlStream(dict(self.options))


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _module(self):
        return importlib.import_module(self.options["module"])

    def partitions(self):
        return [InputPartition(task) for task in self._module().partitions(self.options)]

    def read(self, partition):
        yield from (tuple(row) for row in self._module().fetch(partition.value, self.options))


@functools.lru_cache(16)
def loaded(source: str) -> types.ModuleType:
    """The plug-in that this text is."""
    module = types.ModuleType(f"plugin_{hashlib.sha256(source.encode()).hexdigest()[:16]}")
    exec(compile(source, module.__name__, "exec"), module.__dict__)
    return module


class CrawlTask(InputPartition):
    """A task and the text of the plug-in that planned it, so that the executor runs the same version."""

    def __init__(self, task, source: str):
        self.task, self.source = task, source


class CrawlStream(DataSourceStreamReader):
    """Offsets count a plug-in's items. The file is read anew for each micro-batch and loaded anew where its text has changed;
    a text that can't be loaded is passed over, and the last one that could goes on."""

    def __init__(self, options: dict):
        self.options, self.good, self.seen = options, None, 0

    def _source(self) -> str:
        if "code" in self.options:
            return self.options["code"]
        with open(self.options["path"], encoding="utf-8") as file:
            source = file.read()
        try:
            loaded(source)
            self.good = source
        except Exception:  # noqa: BLE001 - whatever a plug-in does while it is loaded
            if self.good is None:
                raise
        return self.good

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        self.seen = max(self.seen, int(loaded(self._source()).latest(self.options)))
        return {"at": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        source = self._source()
        self.seen = max(self.seen, end["at"])
        return [CrawlTask(task, source) for task in loaded(source).tasks(start["at"], end["at"], self.options)] if start["at"] < end["at"] else []

    def read(self, partition: CrawlTask):
        yield from (tuple(row) for row in loaded(partition.source).fetch(partition.task, self.options))

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CrawlSource)
