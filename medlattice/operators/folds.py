"""Operations whose next step depends on what was decided before: streamed folds over sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS = 2000


def in_order(rows: DataFrame, key: list[str], order: list[Column], values: list[str], fold: Callable[[Iterator[tuple]], Iterable[tuple]], made: str) -> DataFrame:
    """(key..., made) of a fold over each group's ``values`` in order.

    Groups are dealt by key and sorted within their partition, and a task reads
    them as a stream: what is held of a group is what its fold holds. Equal
    orders are told apart by the values, so results don't depend on how rows
    were dealt. ``made`` is the DDL of what the fold yields.
    """
    kinds = T.StructType([rows.schema[k] for k in key] + T._parse_datatype_string(made).fields)
    arrow, n = to_arrow_schema(kinds), len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        groups = groupby(each, key=itemgetter(*range(n)) if n > 1 else lambda r: (r[0],))
        out = (k + tuple(line) for k, group in groups for line in fold(r[n:] for r in group))
        while chunk := list(islice(out, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in chunk], f.type) for i, f in enumerate(arrow)], schema=arrow)

    by = [F.col(f"`{k}`") for k in key]
    named = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    dealt = rows.select(*by, *[F.col(f"`{v}`") for v in values], *named).repartition(*by)
    orderly = [v for v in values if not isinstance(rows.schema[v].dataType, T.MapType)]
    sorted_rows = dealt.sortWithinPartitions(*by, *[f"_o{i}" for i in range(len(order))], *orderly)
    return sorted_rows.select(*by, *values).mapInArrow(run, kinds)
