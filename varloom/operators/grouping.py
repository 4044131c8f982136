"""Ordered work on small groups (reads, islands): whole groups come as columns, many at a time, without a call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

#: Rows that are handled at once, at least; a longer group comes whole.
ROWS = 50_000


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row has another key than the one before it."""
    n = table.num_rows
    out = np.ones(n, bool)
    if n > 1:
        parts = [pa.compute.not_equal(table[k].slice(1), table[k].slice(0, n - 1)) for k in keys]
        out[1:] = np.asarray(pa.compute.fill_null(reduce(pa.compute.or_, parts), True).combine_chunks())
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of whole groups, each row's group from 0) of batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    count, wanted = 0, ROWS
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        opens = starts(table, keys)
        cut = int(np.flatnonzero(opens)[-1])
        if cut:
            yield table.slice(0, cut), np.cumsum(opens[:cut]) - 1
            table, wanted = table.slice(cut), ROWS
        else:
            wanted = 2 * count
        held, count = table.to_batches(), table.num_rows
    if count:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.cumsum(starts(table, keys)) - 1


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema) -> DataFrame:
    """What ``fn`` makes of the rows of whole groups, which come in ``order`` with their group's number.

    One shuffle by key and a sort; each task streams through its groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, keys):
            yield from fn(table, group).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def codes(table: pa.Table, name: str) -> np.ndarray:
    """Numbers that tell a column's values apart."""
    return table[name].combine_chunks().dictionary_encode().indices.to_numpy() if table.num_rows else np.zeros(0, np.int64)


def map_rows(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``fn`` makes of each group's rows, which come in ``order``: for folds of a few rows that depend on their own results."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    arrow = pa.schema([(n, kinds[part.split()[1]]) for n, part in zip(names, schema.split(", "), strict=True)])

    def run(table: pa.Table, group: np.ndarray) -> pa.Table:
        rows = table.to_pylist()
        cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(rows)]
        out = [row for lo, hi in zip(cuts, cuts[1:], strict=False) for row in fn(rows[lo:hi])]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)

    return map_groups(df, keys, order, run, schema)
