"""Helpers shared by the operators: Arrow mapping over whole texts, and tables in the shared folder."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from cartulary.tables import discard, fresh_path, kept, leave, shared_folder, stored  # noqa: F401  (for the operators)

#: Rows, and bytes of text, that a Python worker turns into Python strings at once (one text at least), and rows that reach it at once where
#: the session leaves that open.
ROWS, BYTES, BATCH_ROWS = 256, 16 << 20, 1024
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def col(name: str) -> Column:
    """A column by its exact name, whatever signs the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has, case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it on a path of its own."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), ROOT]))
    # whole texts are wide rows: Spark's own default of 10000 of them would be held twice, in the JVM and the worker; a number that was chosen stays
    if BATCHES not in spark.conf.getAll:
        spark.conf.set(BATCHES, str(BATCH_ROWS))


BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tidied(run: Callable) -> Callable:
    """run, a function of Arrow batches, that gives its free memory back at the end of each task; workers outlive tasks."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def pieces_of(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ROWS rows and BYTES bytes in its text column, or of one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(at + ROWS, max(at + 1, int(np.searchsorted(ends, before + BYTES, side="right"))), batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def map_texts(df: DataFrame, text: str, keep: Sequence[str | tuple[str, Column]], fields: Sequence[tuple[str, DataType]], factory: Callable, *args) -> DataFrame:
    """Columns `keep` as they are, then `fields` computed from each whole text.

    keep: names, or (name, expression) pairs. factory(*args), called once a task,
    gives a function from a list of texts (None where null) to one Arrow array for each field.
    A kept column whose name, case aside, is that of a field gives way to the field. Memory in
    the worker is bounded by ROWS texts, or BYTES of them, or one text, and their results; no text is cut.
    """
    workers_import(df.sparkSession)
    taken = {n.lower() for n, _ in fields}
    named = [(k, col(k)) if isinstance(k, str) else k for k in keep]
    picked = df.select(*(c.alias(n) for n, c in named if n.lower() not in taken), col(text).cast("string").alias("__text"))
    names = [*picked.columns[:-1], *(n for n, _ in fields)]
    schema = StructType([*picked.schema.fields[:-1], *(StructField(n, t) for n, t in fields)])

    def run(batches):
        compute = factory(*args)
        for batch in batches:
            for part in pieces_of(batch, batch.num_columns - 1):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *compute(part.column(part.num_columns - 1).to_pylist())], names=names)

    return picked.mapInArrow(tidied(run), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
