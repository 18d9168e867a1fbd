"""Sources and sinks (S1-S12). All paths go through Spark's readers and writers, so any store that Spark reads works."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, sep: str | None = None) -> DataFrame:
    """A CSV with a header, all columns as text (no inference). Without `sep` the header tells: ; or tab or comma."""
    if sep is None:
        first = path if isinstance(path, str) else path[0]
        head = (spark.read.text(first).first() or [""])[0]
        sep = max((";", "\t", ","), key=head.count)
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False)
    return df if columns is None else df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def renamed(df: DataFrame, names: dict[str, str], defaults: dict[str, object], source: str) -> DataFrame:
    """Columns under their schema names, defaults for absent ones, and the source tag; columns without a name are dropped."""
    cols = [F.col(f"`{a}`").alias(b) for a, b in names.items() if a in df.columns]
    have = {b for a, b in names.items() if a in df.columns}
    return df.select(*cols, *[F.lit(v).cast("string").alias(c) for c, v in defaults.items() if c not in have], F.lit(source).alias("source_dataset"))


def two_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both lists in one table."""
    return a.unionByName(b, allowMissingColumns=True)


def table(spark: SparkSession, path: str, where: Column | None = None, subjects: DataFrame | None = None, key: str = "subject") -> DataFrame:
    """A parquet or CSV table by its path's ending, with pushed-down rows and an optional subject semi join."""
    df = csv(spark, path) if path.rstrip("/").endswith((".csv", ".tsv")) else spark.read.parquet(path)
    df = df if where is None else df.filter(where)
    return df if subjects is None else df.join(subjects.select(key).distinct(), key, "left_semi")


def entities(path: Column) -> dict[str, Column]:
    """Sub, ses, task, run, acq and proc of a path, NULL where absent."""
    return {e: F.nullif(F.regexp_extract(path, rf"(?:^|[_/]){e}-([A-Za-z0-9]+)", 1), F.lit("")) for e in ("sub", "ses", "task", "run", "acq", "proc")}


def shards(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """S3: (path, sub, ses, condition) of the files below sub-*/ses-*/eeg/<condition>/."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path")
    e = entities(F.col("path"))
    return files.select("path", e["sub"].alias("sub"), e["ses"].alias("ses"),
        F.nullif(F.regexp_extract("path", r"/eeg/([^/]+)/[^/]+$", 1), F.lit("")).alias("condition"))


def sidecars(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON sidecars in all folders below root; group them by model_key."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", "true").json(root)


def failure_shards(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """The union of failure CSVs under one schema; empty files add nothing."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(paths)


def record_headers(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(path, t, record_id, recorded_at) from latin-1 record files with NULs, by pattern. A file is a record, or with
    `separator` holds records that each end with it."""
    text = F.decode("content", "ISO-8859-1")
    files = spark.read.format("binaryFile").load(path)
    if separator is not None:
        parts = F.split(text, re.escape(separator))
        text = F.explode(F.slice(parts, F.lit(1), F.size(parts) - 1))
    raw = files.select("path", text.alias("t")).withColumn("t", F.regexp_replace("t", "\u0000", ""))
    return header_fields(raw, "t")


#: A record's body may hold any character: these are written as two, so that none ends a record or is dropped.
ESCAPE, ESCAPED = "\u001b", {"\u001b": "0", "\u001e": "1", "\u0000": "2"}


def escaped(text: Column) -> Column:
    """Text without record separators (U+001E) and NULs."""
    for c, mark in ESCAPED.items():
        text = F.replace(text, F.lit(c), F.lit(ESCAPE + mark))
    return text


def unescaped(text: Column) -> Column:
    """The text that `escaped` was given."""
    for c, mark in reversed(ESCAPED.items()):
        text = F.replace(text, F.lit(ESCAPE + mark), F.lit(c))
    return text


def header_fields(df: DataFrame, text: str) -> DataFrame:
    """Record number, date and time in a text."""
    find = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    stamp = F.concat_ws(" ", find(r"(\d{4}[-/]\d{2}[-/]\d{2})"), find(r"(\d{2}:\d{2}:\d{2})"))
    return df.withColumn("record_id", find(r"(?i)\b(?:id|no)\s*[:=]?\s*(\d+)")).withColumn("recorded_at",
        F.try_to_timestamp(F.regexp_replace(stamp, "/", "-"), F.lit("yyyy-MM-dd HH:mm:ss")))


def write_tables(df: DataFrame, root: str, by: tuple[str, ...] = ("model_key", "condition"), text: bool = False) -> None:
    """One parquet folder for each value of `by`, and the same as CSV on request (arrays as JSON)."""
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{root}/parquet")
    if text:
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").partitionBy(*by).option("header", "true").csv(f"{root}/csv")


def store(spark: SparkSession, path: str):
    """The file system of a path, by Spark's own settings, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def write_shards(df: DataFrame, root: str) -> None:
    """Rows by sub, ses and condition in the folders that `shards` finds: one write, whose folders are then renamed."""
    draft = f"{root}/draft"
    df.write.partitionBy("sub", "ses", "condition").parquet(draft)
    fs, make = store(df.sparkSession, root)
    folders = lambda p: [f.getPath() for f in fs.listStatus(p) if f.isDirectory()]
    value = lambda p: p.getName().split("=", 1)[1]
    for sub in folders(make(draft)):
        for ses in folders(sub):
            place = f"{root}/sub-{value(sub)}/ses-{value(ses)}/eeg"
            fs.mkdirs(make(place))
            for condition in folders(ses):
                fs.rename(condition, make(f"{place}/{value(condition)}"))
    fs.delete(make(draft), True)


def participants(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each participant (the least by all columns), in order."""
    w = Window.partitionBy(key).orderBy(*columns)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(key, *columns).orderBy(key)


def write_participants(df: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """As tab-separated text with n/a for missing values."""
    participants(df, key, columns).write.mode("overwrite").option("header", "true").option("sep", "\t").option("nullValue", "n/a").csv(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not incoming, and the new rows. NULL keys match each other."""
    n = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return old.join(n, on, "left_anti").unionByName(new, allowMissingColumns=True)


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], recency: str, order: list[str]) -> DataFrame:
    """Of all rows of a key the last by recency (new before old on ties), sorted."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(recency).desc_nulls_last(), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new").orderBy(*order)


def removed_summary(df: DataFrame, reason: str, source: str) -> DataFrame:
    """(kind, value, n): removed rows in all, by reason and by source."""
    rows = df.filter(F.col(reason).isNotNull())
    kinds = F.array(F.struct(F.lit("all").alias("kind"), F.lit("all").alias("value")),
        F.struct(F.lit("reason").alias("kind"), F.col(reason).alias("value")), F.struct(F.lit("source").alias("kind"), F.col(source).alias("value")))
    return rows.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))


def write_removed(df: DataFrame, path: str, reason: str) -> None:
    """The removed rows as JSON lines."""
    df.filter(F.col(reason).isNotNull()).write.mode("overwrite").json(path)
