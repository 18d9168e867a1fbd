"""feature tables that were written shard by shard, merged behind a gate on their columns.

A root holds `data/kind=<kind>/shard=<shard>/` with parquet files and `columns/shard=<shard>/` with JSON lines
(kind, columns). The gate reads the small column files, or the footers of the data files where a root has none, as one
distributed table; no shard is opened by the driver and the data of shards that are left out is not read. Shards have
names: a null or empty one cannot be told from Spark's default partition and is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import scratch

BROADCAST_SHARDS = 1 << 20  # names of a few bytes
COLUMNS = "shard string, kind string, columns array<string>"


class Mismatch(ValueError):
    """Shards differ in their columns."""


def write_part(df: DataFrame, root: str, kind: str, shard: str = "shard") -> None:
    """Add the shards of df, which all have df's columns, and their column files. One task writes a shard's file, as a shard
    is one recording's or one subject's table."""
    name = F.col(shard).cast("string")
    sure = F.when(F.length(name) > 0, name).otherwise(F.raise_error(F.lit("a shard has no name")))
    shards = scratch(df.select(*[c for c in df.columns if c not in (shard, "shard")], sure.alias("shard")), "part")
    names = [c for c in shards.columns if c != "shard"]
    told = shards.select("shard").distinct().select("shard", F.lit(kind).alias("kind"), F.array(*map(F.lit, names)).alias("columns"))
    shards.repartition("shard").write.mode("append").partitionBy("shard").parquet(f"{root}/data/kind={kind}")
    told.repartition("shard").write.mode("append").partitionBy("shard").json(f"{root}/columns")


def column_files(spark: SparkSession, root: str) -> DataFrame:
    """(shard, kind, columns) from the column files."""
    return spark.read.schema(COLUMNS).json(f"{root}/columns").select("shard", "kind", "columns")


def _named(part: str) -> Column:
    """A folder's value in a path as Spark writes it: %XX for what a name may not hold, + for itself."""
    return F.url_decode(F.replace(F.regexp_extract("path", f"/{part}=([^/]+)/", 1), F.lit("+"), F.lit("%2B")))


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs, parquet

    for b in batches:
        names = []
        for uri in b.column(0).to_pylist():
            scheme, rest = uri.split(":", 1)
            store, path = fs.FileSystem.from_uri(f"{scheme}:{quote(rest if rest.startswith('//') else '//' + rest)}")
            with store.open_input_file(path) as f:
                names.append(parquet.ParquetFile(f).schema_arrow.names)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.list_(pa.string()))], names=["path", "columns"])


def footer_columns(spark: SparkSession, root: str) -> DataFrame:
    """(shard, kind, columns) from the footers of all data files: tasks open a file and read its footer alone. A shard of
    several files has the columns that any of them has. Needs a store that pyarrow can open."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/data").select("path")
    told = files.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_footers, "path string, columns array<string>")
    return told.select(_named("shard").alias("shard"), _named("kind").alias("kind"), "columns").groupBy("shard", "kind").agg(
        F.array_distinct(F.flatten(F.collect_list("columns"))).alias("columns"))


def gate(columns: DataFrame, by: str = "first", kinds: tuple[str, ...] = ()) -> DataFrame:
    """(shard, reasons) of columns(shard, kind, columns): what keeps a shard out, nothing if it agrees.

    A kind's columns are those of its first shard by name, or with by="most" those that most shards have (of equals the
    least). Their order does not matter. A shard without one of `kinds` is kept out too. A null list has no columns.
    """
    if by not in ("first", "most"):
        raise ValueError(f"unknown reference: {by}")
    have = columns.select("shard", "kind", F.array_sort(F.array_distinct(F.coalesce("columns", F.array().cast("array<string>")))).alias("have"))
    if by == "first":
        want = have.groupBy("kind").agg(F.min_by("have", "shard").alias("want"))
    else:
        counts = have.groupBy("kind", "have").agg(F.count(F.lit(1)).alias("n"))
        want = counts.groupBy("kind").agg(F.min(F.struct(-F.col("n"), "have")).alias("m")).select("kind", F.col("m.have").alias("want"))
    told = lambda label, a, b: F.when(F.size(F.array_except(a, b)) > 0, F.concat("kind", F.lit(f" {label} "), F.array_join(F.array_except(a, b), ", ")))
    each = have.join(want, "kind").select("shard", "kind", F.array(told("lacks", "want", "have"), told("adds", "have", "want")).alias("told"))
    found = each.groupBy("shard").agg(F.flatten(F.collect_list("told")).alias("told"), F.collect_set("kind").alias("kinds"))
    absent = F.transform(F.array_except(F.array(*map(F.lit, kinds)).cast("array<string>"), F.col("kinds")), lambda k: F.concat(k, F.lit(" is absent")))
    return found.select("shard", F.array_sort(F.array_compact(F.concat("told", absent))).alias("reasons"))


def merged(spark: SparkSession, root: str, kind: str, mismatch: str = "fail", by: str = "first", kinds: tuple[str, ...] = (), columns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of one kind of all shards that pass the gate, with their shard, and the record (shard, reasons) of those left
    out. mismatch="fail" raises Mismatch if there is any; it is also raised if none is left. A shard that differs in one
    kind is left out of all kinds. `columns` takes the place of the column files, such as footer_columns."""
    if mismatch not in ("fail", "exclude"):
        raise ValueError(f"unknown policy: {mismatch}")
    told = scratch(column_files(spark, root) if columns is None else columns, "columns")
    seen = scratch(gate(told, by, kinds), "gate")
    good, out = seen.filter(F.size("reasons") == 0), seen.filter(F.size("reasons") > 0)
    kept = told.filter(F.col("kind") == kind).join(good, "shard", "left_semi").select("shard")
    one = kept.agg(F.min("shard")).first()[0]
    if (mismatch == "fail" and not out.isEmpty()) or one is None:
        some = [f"{r.shard}: {'; '.join(r.reasons)}" for r in out.orderBy("shard").take(5)]
        raise Mismatch(f"{out.count()} of {seen.count()} shards differ. {' | '.join(some)}")
    place = f"{root}/data/kind={kind}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(place).select("path")
    first = files.filter(_named("shard") == one).agg(F.min("path")).first()[0]
    schema = spark.read.parquet(first).schema.add("shard", StringType())
    small = kept.count() <= BROADCAST_SHARDS
    return spark.read.schema(schema).parquet(place).join(F.broadcast(kept) if small else kept, "shard", "left_semi"), out
