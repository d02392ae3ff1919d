"""Helpers shared by the text operators: shared storage, null-safe text, Arrow mapping."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.storage import shared_dir


#: The tables that were written and not deleted yet, and the paths of those that somebody holds.
_PATHS: set[str] = set()
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut,
    and a lost executor costs only the tasks it ran, never the stages before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS.add(path)
    _WRITTEN[table] = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    _PATHS.discard(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing will read again."""
    for table in tables:
        if path := _WRITTEN.pop(table, None):
            _delete(table.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end what was written within it, but for the tables put into the list."""
    before, kept = set(_PATHS), []
    yield kept
    for path in _PATHS - before - {_WRITTEN.get(t) for t in kept}:
        _delete(spark, path)


def field(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema[name].dataType, True)


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Bytes of a batch that an operator's function sees at once.
SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes at most, so that what a worker holds
    doesn't depend on how long the texts are.  What Arrow keeps of batches that are done goes
    back, since a worker that waits for its next task counts too."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def map_batches(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict[str, object]],
    added: list[T.StructField],
    keep: list[str],
) -> DataFrame:
    """Each Arrow batch of ``df`` through ``fn``, which gives the ``added`` columns;
    the columns named in ``keep`` pass unchanged."""
    schema = T.StructType([field(df, k) for k in keep] + added)
    names = [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = fn(batch)
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays(columns + [out[n] for n in names], keep + names)

    return df.mapInArrow(run, schema)
