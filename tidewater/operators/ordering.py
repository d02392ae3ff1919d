"""Dense positions, running totals, predecessors and folds within large groups.

A window over a whole log partition is one task for it, however large.  Here a partition
is cut into blocks of the order column; totals of the blocks, a table smaller by the size
of a block, carry over from one block to the next, and the windows run within blocks.

Where the next state depends on the last, ``folded`` streams the rows of a key, sorted, past a
state of constant size: nothing is gathered, however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

#: Values of the order column in a block.
BLOCK = 1 << 20


def _blocks(df: DataFrame, order: str, block: float) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / block).cast("long"))


def _carried(blocked: DataFrame, keys: Sequence[str], total: Column, merge) -> DataFrame:
    """For each block what the blocks before it amount to."""
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, "_block").agg(total.alias("_total"))
    return totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"), merge("_total").over(before).alias("_carried"))


def _joined(blocked: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return blocked.join(carried, same).drop("_b", *(f"_k{i}" for i in range(len(keys))))


def position(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], name: str, block: int = BLOCK) -> DataFrame:
    """Adds the 0-based dense position of each row by ``order`` within ``keys``; of several
    order columns the first is cut into blocks."""
    order = [order] if isinstance(order, str) else list(order)
    blocked = _blocks(df, order[0], block)
    carried = _carried(blocked, keys, F.count("*"), F.sum)
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)).cast("long") - 1
    return _joined(blocked, carried, keys).withColumn(name, F.coalesce("_carried", F.lit(0)) + inside).drop("_block", "_carried")


def running(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, merge="sum", block: float = BLOCK) -> DataFrame:
    """Adds the running sum, maximum or minimum of ``value`` by ``order``, the row included."""
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[merge]
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}[merge]
    blocked = _blocks(df, order, block).withColumn("_value", value)
    carried = _carried(blocked, keys, fold("_value"), fold)
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return _joined(blocked, carried, keys).withColumn(name, both(F.col("_carried"), fold("_value").over(inside))).drop("_block", "_carried", "_value")


def lagged(df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str], block: float = BLOCK) -> DataFrame:
    """Adds for each column the value that the row before has, under a name of its own; null for
    the first of a key."""
    blocked = _blocks(df, order, block)
    row = F.struct(*(F.col(c).alias(n) for c, n in columns.items()))
    last = blocked.groupBy(*keys, "_block").agg(F.max_by(row, order).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))
    carried = last.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"), before.alias("_carried"))
    own = F.lag(row).over(Window.partitionBy(*keys, "_block").orderBy(order))
    both = _joined(blocked, carried, keys).withColumn("_row_before", F.coalesce(own, F.col("_carried")))
    return both.withColumns({n: F.col("_row_before").getField(n) for n in columns.values()}).drop("_block", "_carried", "_row_before")


def islands(df: DataFrame, keys: Sequence[str], order: str, starts: Column, name: str, block: float = BLOCK) -> DataFrame:
    """Adds the number of rows so far, by ``order`` within ``keys``, for which ``starts`` holds."""
    return running(df, keys, order, starts.cast("long"), name, "sum", block)


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of a key in one task, in order, for a function over the task's rows.

    They are dealt by a hash of the key: where a join below deals by the key itself, Spark takes
    an equal repartition for done, and adaptive execution, which doesn't see what the function
    needs, may then cut the join's large partitions or read its rows where they were written."""
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], start: Callable, step: Callable, added: str) -> DataFrame:
    """Adds the columns ``added`` (a schema), which ``step(state, *values)`` gives with the next
    state for every row of a key in order; ``start(*values)`` gives the state before the first.
    ``values`` are those of ``columns``.  The state must not grow with the rows."""
    extra = T.StructType.fromDDL(added)
    schema = T.StructType([*df.schema.fields, *extra.fields])
    n, types = len(keys), to_arrow_schema(extra).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in [*keys, *columns]), strict=True):
                if row[:n] != key:
                    key, state = row[:n], start(*row[n:])
                state, values = step(state, *row[n:])
                out.append(values)
            new = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *extra.names])

    return dealt(df, keys, order).mapInArrow(run, schema)
