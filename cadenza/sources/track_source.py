"""Track metadata as a Spark data source: ``spark.read.format("tracks")`` with one partition an address."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cadenza.sources.ingest import normalise, run_metadata_tool


class AddressPartition(InputPartition):
    """One address and its place among them."""

    def __init__(self, place: int, url: str):
        super().__init__(place)
        self.place, self.url = place, url


class TrackReader(DataSourceReader):
    def __init__(self, urls: list[str], fetch: Callable[[str], str]):
        self.urls, self.fetch = urls, fetch

    def partitions(self) -> list[AddressPartition]:
        return [AddressPartition(i, u) for i, u in enumerate(self.urls)]

    def read(self, partition: AddressPartition | None) -> Iterator[tuple]:
        if partition is None:  # as Spark asks where there are no addresses
            return
        for n, line in enumerate(self.fetch(partition.url).splitlines()):
            yield partition.place, partition.url, n, line


def track_source(fetch: Callable[[str], str] = run_metadata_tool) -> type[DataSource]:
    """A data source named ``tracks`` whose addresses (option ``urls``, a JSON list) fetch turns into JSON lines, on the executors.

    Columns: place (of the address), url, n (of the line), value. As Spark
    takes partitions for a limit one after another, ``limit(1)`` asks the first
    address alone, if that has a line.
    """

    class TrackSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tracks"

        def schema(self) -> str:
            return "place int, url string, n long, value string"

        def reader(self, schema) -> TrackReader:
            return TrackReader(json.loads(self.options.get("urls", "[]")), fetch)

    return TrackSource


def tracks_of(spark: SparkSession, urls: list[str], fetch: Callable[[str], str] = run_metadata_tool) -> DataFrame:
    """Normalised tracks of addresses by the data source; line is (place, n), so that the addresses' order is kept."""
    spark.dataSource.register(track_source(fetch))
    lines = spark.read.format("tracks").option("urls", json.dumps(list(urls))).load()
    return normalise(lines.select(F.struct("place", "n").alias("line"), "value"))
