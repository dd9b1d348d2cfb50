"""Ordered folds: steps whose decision depends on what the rows before were merged to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], fields: list[str], out: T.StructType, step: Callable, dealt: bool = False) -> DataFrame:
    """Adds the columns `out` to each row: `step(state, row) -> (state, values)`, in `order` within `keys`, state None at first.

    Rows stream through sorted partitions, so memory is one batch and one state however long a group is. `row` is a
    dict of `fields`. One shuffle on the keys; with `dealt` none where df already lies together by some of them, nor a
    sort where it is in order.
    """
    kinds = [to_arrow_type(f.dataType) for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in fields]
            made: tuple[list, ...] = tuple([] for _ in kinds)
            for key, *row in zip(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in keys), strict=True), *cols, strict=True):
                if key != last:
                    state, last = None, key
                state, values = step(state, dict(zip(fields, row, strict=True)))
                for col, v in zip(made, values, strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], [*b.schema.names, *out.names])

    if dealt:  # a window asks for its rows together and in order, and moves or sorts them only if they are not
        ordered = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, *out.fields])).drop("_at")
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInArrow(run, T.StructType([*df.schema.fields, *out.fields]))


def runs(df: DataFrame, keys: list[str], order: list[str], fields: list[str], joins: Callable) -> DataFrame:
    """Adds `run` (long, from 0 within keys): `joins(head, row)` gives the grown head, or None where the row starts a run."""

    def step(state, row):
        grown = None if state is None else joins(state[1], row)
        number = 0 if state is None else state[0] + (grown is None)
        return (number, row if grown is None else grown), (number,)

    return sorted_fold(df, keys, order, fields, T.StructType().add("run", T.LongType()), step)


def labels(n: Column, edges: Column) -> Column:
    """Component label (the least member) of each of the nodes 0 .. n - 1, given (a, b) edges: one fold over the edges."""
    zero = F.sequence(F.lit(0), n - 1)

    def join(own: Column, e: Column) -> Column:
        a, b = F.get(own, e["a"]), F.get(own, e["b"])
        return F.transform(own, lambda x: F.when(x == F.greatest(a, b), F.least(a, b)).otherwise(x))

    return F.aggregate(edges, zero, join)
