"""Arrow batches in, Arrow batches out: rows keep their key column untouched, nulls included."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


#: Rows that are taken out of a batch at once, and at most in a batch: whole texts are long, and a batch of the default
#: 10,000 stands in memory on both sides.
ROWS, BATCH_ROWS = 1024, 2048
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """The rows themselves, in a session whose Arrow batches have at most BATCH_ROWS rows."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_SETTING)) <= BATCH_ROWS:
        conf.set(_SETTING, str(BATCH_ROWS))
    return df


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, ROWS):
        yield batch.slice(a, ROWS)


def map_texts(df: DataFrame, key: str, text: str | Column, function: Callable, columns: str, *, worker: Callable | None = None) -> DataFrame:
    """(key, *columns) for each row.

    ``function(texts)``, or ``function(worker(), texts)``, gets the list of a batch's
    texts as UTF-8 bytes, None among them, and returns one list or array for each of ``columns`` (DDL).
    ``worker`` makes what a task needs once, such as tables read from a file.
    """
    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)
    kept = bounded(df).select(F.col(f"`{key}`").alias("_key"), (F.col(f"`{text}`") if isinstance(text, str) else text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (worker(),) if worker else ()
        for batch in batches:
            for part in parts(batch):
                out = function(*own, part.column("_text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_key"), *(pa.array(x, _ARROW[k]) for x, k in zip(out, kinds, strict=True))], ["_key", *names])

    return kept.mapInArrow(run, f"_key {kept.schema['_key'].dataType.simpleString()}, {columns}").withColumnRenamed("_key", key)


def filter_texts(df: DataFrame, text: str, function: Callable, *, worker: Callable | None = None) -> DataFrame:
    """The rows, all columns as they are, for whose texts the function's booleans are true. Nothing is joined or dealt anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (worker(),) if worker else ()
        for batch in batches:
            for part in parts(batch):
                yield part.filter(pa.array(function(*own, part.column(text).cast(pa.binary()).to_pylist()), pa.bool_()))

    return bounded(df).mapInArrow(run, df.schema)
