"""The paged history of an API as a data source: one partition for each kind, year and month.

Years and months are asked for when the read is planned; each month's answer is
fetched by a task of its own. A month whose answer can't be fetched gives a row
with its error and stops nothing else; ``records`` checks the answers' shape. A
partition that is read again after a lost executor fetches its month again.
"""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .payload import api_records

SCHEMA = "kind string, year int, month int, content string, error string"


def from_folder(base: str, kind: str, year: int | None, month: int | None) -> list[int] | str:
    """Answers stored below base/kind=/year=/month=: years of a kind, months of a year, or the text of a month's files."""
    import pyarrow.fs

    fs, root = pyarrow.fs.FileSystem.from_uri(base if "://" in base else f"file://{base.removeprefix('file:')}")
    path = f"{root}/kind={kind}" + (f"/year={year}" if year is not None else "") + (f"/month={month}" if month is not None else "")
    entries = sorted(fs.get_file_info(pyarrow.fs.FileSelector(path)), key=lambda e: e.base_name)
    if month is None:
        return sorted(int(e.base_name.split("=")[1]) for e in entries if "=" in e.base_name)
    parts = [fs.open_input_stream(e.path).read() for e in entries if not e.base_name.startswith(("_", "."))]
    return b"".join(parts).decode()


def _client(options: dict[str, str]) -> Callable:
    """The function that asks: ``client`` names another one as module:function."""
    named = options.get("client")
    if not named:
        return from_folder
    module, _, function = named.partition(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class Month(InputPartition):
    kind: str
    year: int
    month: int


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[Month]:
        ask, base = _client(self.options), self.options["path"]
        kinds = [k.strip() for k in self.options["kinds"].split(",")]
        return [Month(k, y, m) for k in kinds for y in ask(base, k, None, None) for m in ask(base, k, y, None)]

    def read(self, partition: Month | None) -> Iterator[tuple]:
        if partition is None:  # a history without months
            return
        where = (partition.kind, partition.year, partition.month)
        try:
            content, error = _client(self.options)(self.options["path"], *where), None
        except Exception as e:  # whatever a client raises belongs to its month
            content, error = None, f"{type(e).__name__}: {e}"
        yield (*where, content, error)


class History(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)


# the planner's and the workers' Python may not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def answers(spark: SparkSession, base: str, kinds: list[str], client: str | None = None) -> DataFrame:
    """(kind, year, month, content, error) of all months of the kinds."""
    spark.dataSource.register(History)
    reader = spark.read.format("paged_history").option("kinds", ",".join(kinds))
    return (reader.option("client", client) if client else reader).load(base)


def records(months: DataFrame, key: str = "aaData") -> DataFrame:
    """(kind, year, month, record, error): the objects of each answer; a month of another shape, or one that failed, is one row with its error."""
    where = F.struct("kind", "year", "month")
    good = api_records(months.filter("error is null").select(where.alias("path"), F.coalesce("content", F.lit("")).alias("content")), key)
    bad = months.filter("error is not null").select(where.alias("path"), F.lit(None).cast("map<string,string>").alias("record"), "error")
    return good.unionByName(bad).select("path.kind", "path.year", "path.month", "record", "error")
