"""Connectors as data sources: whatever can list documents becomes a table that Spark reads in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source string, collection_id string, doc_id string, title string, kind string, submitted_at string, url string"
#: The sources that can be named; each needs a client that fetches a page.
NAMES = ("regulations_gov", "gov_uk", "cppa_admt", "eu_have_your_say", "nist_airmf", "nitrd_ai_rfi", "connecticut_eregulations", "oregon_admin_orders", "pa_dep_ecomment", "utah_bulletin", "virginia_townhall", "washington_register")

Page = Callable[[str, int], list[dict]]


def connector(name: str, list_page: Page, pages: Callable[[str], int]) -> type[DataSource]:
    """A data source of one service. ``pages`` says how many pages a collection has, ``list_page`` fetches one; the
    network stays behind these two, and each page is a partition that can be read again."""
    if name not in NAMES:
        raise ValueError(f"unknown connector {name}")

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.collection = options["collection"]

        def partitions(self):
            return [InputPartition(k) for k in range(pages(self.collection))]

        def read(self, partition) -> Iterator[tuple]:
            for row in list_page(self.collection, partition.value):
                yield (name, self.collection, *(row.get(c) for c in ("doc_id", "title", "kind", "submitted_at", "url")))

    class Connector(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options)

    return Connector


def read(spark: SparkSession, kind: type[DataSource], collection: str):
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).option("collection", collection).load()
