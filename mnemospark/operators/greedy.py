"""Choices that depend on the ones before: a fold over each group's rows in their order."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold(df: DataFrame, group: str, order: list[str], size: str, step: Callable, column: str) -> DataFrame:
    """df with one more column. step: (sizes, state) to (values, state), for the next rows of one group; state None at
    its start.

    Groups are dealt to tasks and sorted there; rows pass in batches and only the state of one group is held, so a
    group may be of any size. Ties of the order should be broken by the caller, for a defined result.
    """
    name, kind = column.split(" ")
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(column).fields])
    at, by = df.columns.index(size), df.columns.index(group)
    numbers = pa.int64() if kind == "long" else pa.bool_()

    def rows(batches):
        now, state = None, None
        for b in batches:
            groups, sizes, out, start = b.column(by).to_pylist(), b.column(at).to_pylist(), [], 0
            while start < len(groups):
                end = start
                while end < len(groups) and groups[end] == groups[start]:
                    end += 1
                if now is None or now[0] != groups[start]:
                    state = None
                now = (groups[start],)
                values, state = step([0 if n is None else n for n in sizes[start:end]], state)
                out += values
                start = end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, numbers)], names=[*b.schema.names, name])

    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(rows, schema)
