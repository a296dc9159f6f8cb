"""A data source for fetched pages: `spark.read.format("pages")` over (url, html) that a fetcher yields.

Crawlers are outside; what they fetch comes in through this hook. The fetcher is a picklable callable that
takes a list of urls, the part of one task, and yields (url, html); urls are dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetcher = Callable[[list[str]], Iterable[tuple[str, str]]]


def read_pages(spark: SparkSession, urls: list[str], fetch: Fetcher, parts: int = 8) -> DataFrame:
    """(url, html) of urls, fetched in `parts` tasks."""

    class Part(InputPartition):
        def __init__(self, urls: list[str]):
            self.urls = urls

    class Reader(DataSourceReader):
        def partitions(self):
            return [Part(urls[k::parts]) for k in range(min(parts, len(urls)) or 1)]

        def read(self, partition):
            yield from fetch(partition.urls)

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return "pages"

        def schema(self):
            return "url string, html string"

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Pages)
    return spark.read.format("pages").load()
