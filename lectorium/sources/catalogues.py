"""A catalogue of hits as a Python data source that answers from saved feeds."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema


class CatalogueSource(DataSource):
    """``spark.read.format("catalogue").option("hits", json_lines)``: each line a hit; missing keys are null.

    ``option("partitions", n)`` deals the lines to that many readers. Filters stay with
    Spark: a scan with pushed ones is used again for queries that lack them.
    """

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return schema.HIT

    def reader(self, schema) -> DataSourceReader:
        return CatalogueReader(self.options)


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.lines = options.get("hits", "").splitlines()
        self.parts = int(options.get("partitions", "1"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = [c.split()[0] for c in schema.HIT.split(", ")]
        for line in self.lines[partition.value :: self.parts]:
            hit = json.loads(line)
            yield tuple(hit.get(k) for k in names)
