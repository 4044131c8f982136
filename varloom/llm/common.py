"""What several operators share: grouped Arrow streams, connected components, joins with hot keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.cluster import materialize

#: The words of all contracts.
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot if it has more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000


def trim() -> None:
    """Give freed memory back to the system: a worker serves the tasks of many stages, and would else keep each one's peak."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def quoted(name: str) -> str:
    """A column's name as an expression names it."""
    return "`" + name.replace("`", "``") + "`"


def beside(docs: DataFrame, wanted: str, *added: str) -> tuple[DataFrame, list[T.StructField], list[str]]:
    """For mapInArrow that keeps a caller's columns, whatever their names: (rows, fields, names).

    ``rows`` has all columns of ``docs`` but those ``added`` under numbered names, and the ``wanted`` one once more as _t; fields and
    names are those of the kept columns, numbered and own.
    """
    kept = [f for f in docs.schema if f.name not in added]
    rows = docs.select(*(F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(kept)), F.col(quoted(wanted)).alias("_t"))
    return rows, [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)], [f.name for f in kept]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def int64(array: pa.Array) -> np.ndarray:
    return np.asarray(array.cast(pa.int64()).fill_null(0)) if array.null_count else np.asarray(array, dtype=np.int64)


def lists(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column of numbers without nulls."""
    offsets = np.asarray(array.offsets, dtype=np.int64)
    values = array.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return values.to_numpy(zero_copy_only=False), offsets - offsets[0]


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def grouped_stream(
    keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None]
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over partitions sorted by integer ``keys``: calls ``fn`` once per group of equal keys.

    Holds one group at a time; callers bound the groups' sizes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [int64(column(batch, k)) for k in keys]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                key = tuple(int(c[lo]) for c in cols)
                if held and key != held_key:
                    if (out := fn(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held_key = key
                held.append(batch.slice(lo, hi - lo))
        if held and (out := fn(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def by_group(df: DataFrame, keys: list[str], fn: Callable, schema: str, *order: str) -> DataFrame:
    """``fn`` (a function of one group's Arrow table, by ``order`` if there is one) over every group of ``keys``."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(grouped_stream(keys, fn), schema)


def lookup(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of ``big`` with ``small``, which has one row per key, when a few keys of ``big`` may hold most rows.

    Keys with more than 1/HOT_SHARE of the rows are fewer than HOT_SHARE, so their rows of ``small`` are
    broadcast; all other rows are joined by shuffling, where no key is hot.
    """
    total = F.broadcast(big.agg((F.count(F.lit(1)) / HOT_SHARE).alias("_least")))
    hot = (
        big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(total, F.col("_n") > F.col("_least")).drop("_n", "_least")
    )
    known = small.join(F.broadcast(hot.select(*keys)), keys, "left_semi").withColumn("_hot", F.lit(True))
    rest = [c for c in small.columns if c not in keys]
    marked = big.join(F.broadcast(known), keys, "left")
    is_hot = F.col("_hot").isNotNull()
    done = marked.filter(is_hot).select(*big.columns, *rest)
    left = marked.filter(~is_hot).select(*big.columns)
    return done.unionByName(left.join(small, keys, "left").select(*big.columns, *rest))


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node that has an edge.

    Labels fall to the smallest neighbour's and then to their label's label, until nothing changes; each
    round is a table in the shared folder.  ``edges`` may be any forest of the links, another one each time that it is computed, so
    both directions come from one row.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(edges.select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct(), folder, f"{name}-edges")
    labels = materialize(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")),
        folder,
        f"{name}-0",
    )
    step = 0
    while True:
        step += 1
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        low = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.least("component", F.coalesce("m", "component")).alias("to"), F.col("component").alias("was")
        )
        # a label may be that of most nodes
        low = materialize(low, folder, f"{name}-low-{step}")
        up = labels.select(F.col("node").alias("to"), F.col("component").alias("top"))
        new = lookup(low, up, ["to"]).select(
            "node", F.least("to", F.coalesce("top", "to")).alias("component"), "was"
        )
        new = materialize(new, folder, f"{name}-{step}")
        if not new.filter(F.col("component") != F.col("was")).limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_rest(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor
