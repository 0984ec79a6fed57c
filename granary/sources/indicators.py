"""Indicator series as a data source: JSON files in a folder, one for each country and indicator.

``spark.read.format("indicators").load(folder)`` gives (country_iso3, indicator, year, value).  A file
is named ``<country>.<indicator>.json`` and holds ``{"2020": 22.7, "2021": null, ...}``; blank and missing
values are no rows.  Each file is a partition of its own.  Filters on country and indicator leave files
out before anything is read, filters on the year leave values out where they are read, and all files if
no year can pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "country_iso3 string, indicator string, year int, value double"
FIRST, LAST = -10_000, 10_000  # years that are years


@dataclass
class File(InputPartition):
    """One country's values of one indicator."""

    path: str
    country: str
    indicator: str


class IndicatorReader(DataSourceReader):
    """Reads the files that pushed filters leave."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.allowed: dict[str, set | None] = {"country_iso3": None, "indicator": None}
        self.first, self.last = FIRST, LAST

    def _narrow(self, column: str, values: set) -> None:
        held = self.allowed[column]
        self.allowed[column] = values if held is None else held & values

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 - the data source interface's name
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if column in self.allowed and isinstance(f, EqualTo) and value is not None:
                self._narrow(column, {value})
            elif column in self.allowed and isinstance(f, In):
                self._narrow(column, set(f.value))
            elif column == "year" and value is not None and isinstance(f, EqualTo):
                self.first, self.last = max(self.first, value), min(self.last, value)
            elif column == "year" and isinstance(f, In):
                self.first, self.last = max(self.first, min(f.value)), min(self.last, max(f.value))
                yield f  # only its ends are looked at here
            elif column == "year" and value is not None and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            elif column == "year" and value is not None and isinstance(f, LessThan | LessThanOrEqual):
                self.last = min(self.last, value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[File]:
        from pyarrow import fs

        if self.first > self.last:
            return []
        files, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        out = []
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            parts = info.base_name.split(".")
            if len(parts) < 3 or parts[-1] != "json":
                continue
            country, indicator = parts[0], ".".join(parts[1:-1])
            if all(a is None or v in a for a, v in ((self.allowed["country_iso3"], country), (self.allowed["indicator"], indicator))):
                out.append(File(info.path, country, indicator))
        return sorted(out, key=lambda f: f.path)

    def read(self, partition: File) -> Iterator[tuple]:
        from pyarrow import fs

        files = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
        with files.open_input_stream(partition.path) as f:
            values = json.loads(f.read())
        for year, value in values.items():
            if value is not None and str(value).strip() and self.first <= int(year) <= self.last:
                yield partition.country, partition.indicator, int(year), float(value)


class Indicators(DataSource):
    """The format ``indicators``."""

    @classmethod
    def name(cls) -> str:
        return "indicators"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IndicatorReader:
        return IndicatorReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Indicators)
