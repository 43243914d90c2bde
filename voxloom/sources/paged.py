"""A Spark data source over anything that is fetched page by page, such as a hub of datasets, shard by shard."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxloom.streaming.ingest import with_retries

#: (shard, shards, cursor) -> (rows of the next page, cursor behind it), or None at the end
Pages = Callable[[int, int, int], tuple[list[tuple], int] | None]


class Shard(InputPartition):
    def __init__(self, shard: int, shards: int, start: int):
        super().__init__(shard)
        self.shard, self.shards, self.start = shard, shards, start


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.pages = options["pages"]
        self.shards = int(options.get("shards", "1"))
        start = int(options.get("start", "0"))
        #: Each shard goes on from its own cursor, as far as the option names them (a JSON list)
        own = json.loads(options.get("cursors", "[]"))
        self.cursors = [own[i] if i < len(own) and own[i] is not None else start for i in range(self.shards)]
        self.pause = float(options.get("pause", "45"))

    def partitions(self) -> list[Shard]:
        return [Shard(i, self.shards, self.cursors[i]) for i in range(self.shards)]

    def read(self, partition: Shard) -> Iterator[tuple]:
        module, _, name = self.pages.partition(":")
        fetch: Pages = getattr(importlib.import_module(module), name)
        cursor = partition.start
        while (page := with_retries(lambda: fetch(partition.shard, partition.shards, cursor), first_s=self.pause)) is not None:
            rows, cursor = page
            yield from rows


class PagedSource(DataSource):
    """``format("paged")`` with the options ``pages`` (module:function), ``shards``, ``start`` (of all shards) or ``cursors`` (one
    for each), and a schema. Each shard is a partition; slow-down errors of the source are waited out."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("give the schema of the pages")

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
