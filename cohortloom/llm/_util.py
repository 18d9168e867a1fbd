"""Helpers of the subpackage: written tables, bounded broadcasts, and lean Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ..session import scratch_path, shared_dir, ship


__all__ = ["documents", "dropped", "free", "held", "mapped", "ranked", "ship", "small_side", "text_hash", "written"]


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df once as a table in the shared folder (by values of a column) and read it back: cuts lineage and survives
    lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*([by] if by else [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame, only: str = "") -> None:
    """Delete written tables, or their folder `only`, that later ones have replaced, and hint that shuffle files of ended
    jobs can go, which else stay until the driver happens to collect its garbage."""
    shared = shared_dir(spark)
    for folder in {f.split("/part-")[0] for table in tables for f in table.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        root = fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(shared)).toString()
        if folder.endswith(only) and fs.makeQualified(place).toString().startswith(root):
            fs.delete(place, True)
    for _ in range(2):  # what the first round frees can hold what the second finds
        gc.collect()
        spark._jvm.System.gc()


#: Bytes of a table of numbers that may be broadcast, as its rows lie in memory: 8 a column and 64 for the row and its place.
BROADCAST_BYTES = 64 << 20


def small_side(table: DataFrame, more: Column | None = None) -> DataFrame:
    """A written table of numbers (and arrays of `more` bytes), marked for broadcast if its measured size is within the
    bound; else Spark shuffles both sides."""
    size = table.agg(F.sum(F.lit(64 + 8 * len(table.columns)).cast("long") + (F.lit(0) if more is None else more))).first()[0]
    return F.broadcast(table) if (size or 0) <= BROADCAST_BYTES else table


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_hash(text: Column) -> Column:
    """Tells texts apart among the rows that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: Bytes of rows sent to a Python worker at a time; a longer row goes alone.
BATCH_BYTES = 4 << 20
_held: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What a Python worker keeps between tasks for one operator; that of all others is let go."""
    for other in [k for k in _held if k != owner]:
        del _held[other]
    return _held.setdefault(owner, {})


def _lean() -> None:
    """Give memory that earlier tasks of this worker have freed back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, run: Callable, schema: object) -> DataFrame:
    """df.mapInArrow with batches bounded by bytes: ten thousand long texts at once would fill both sides of the pipe."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name) == f"{64 << 20}b":  # the default, not chosen by the user
        conf.set(name, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        yield from run(batches)

    return df.mapInArrow(lean, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
