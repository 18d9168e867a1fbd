"""Sums of arrays over all rows, added up in a tree of tasks, and means that do not depend on how the rows are dealt to tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

FAN, ROWS = 32, 1024  # sums that one task or the driver adds up; rows worked on at a time


def steady_mean(column: str, scale: int = 10_000) -> Column:
    """The mean of a group in whatever order its rows come: numbers of up to four decimals are added as whole numbers and
    divided once. A group with any other number, or too large a sum, has the plain mean."""
    c = F.col(column).cast("double")
    whole = F.when(F.abs(c) < 1e9, F.rint(c * scale).cast("long"))
    plain = F.count_if(whole / scale == c) == F.count(c)
    return F.coalesce(F.when(plain, F.try_sum(whole) / (F.count(c) * scale)), F.avg(c))


def in_table_order(table: DataFrame, key: str, *columns: str) -> DataFrame:
    """Columns of a table read from files, laid out by a key and in each task in the order in which the files, by name, hold
    the rows. Doubles of a group are then added in that one order, however the files are cut into tasks, and a mean at a limit
    falls where one thread that reads the files in turn has it."""
    rows = table.select(key, *columns, "_metadata.file_path", "_metadata.row_index")
    return rows.repartition(key).sortWithinPartitions("file_path", "row_index").drop("file_path", "row_index")


def vectors(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of part(batch) over all batches, flat; empty without rows. Only arrays of that size leave a task."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                found = part(b.slice(at, ROWS))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, np.float64).tobytes()], pa.binary())], names=["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for s in b.column(0):
                found = np.frombuffer(s.as_py())
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    ship(rows.sparkSession)
    left, n = rows.mapInArrow(first, "sums binary"), rows.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        left = left.repartition(n).mapInArrow(added, "sums binary")
    found = [np.frombuffer(r.sums) for r in left.collect()]
    return np.sum(found, axis=0) if found else np.zeros(0)
