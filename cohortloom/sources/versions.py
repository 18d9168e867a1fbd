"""Tables that are replaced as a whole (S10, S11): a new version is written beside the old ones and one rename makes it the
current one, so a failure at any point leaves the version before it.

A table is a folder with a folder of data for each version and one small manifest for each, numbered upwards, that names
it. Readers follow the manifest of the largest number. Two writers cannot both make the same number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .tables import last_wins, store, upserted


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, make = store(spark, path)
    folder = make(f"{path}/manifests")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()) if fs.exists(folder) else []


def _folder(spark: SparkSession, path: str, number: int) -> str:
    return f"{path}/{spark.read.text(f'{path}/manifests/{number:012d}').first()[0]}"


def version(spark: SparkSession, path: str) -> int:
    """The current version's number, 0 if there is none."""
    return max(_manifests(spark, path), default=0)


def current(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The current version, or that of number `at`. The rows stay the same while newer versions are made."""
    number = version(spark, path) if at is None else at
    if not number:
        raise ValueError(f"no version of {path}")
    return spark.read.parquet(_folder(spark, path, number))


def _commit(spark: SparkSession, path: str, folder: str, number: int) -> None:
    fs, make = store(spark, path)
    draft, final = make(f"{path}/draft-{uuid.uuid4().hex}"), make(f"{path}/manifests/{number:012d}")
    out = fs.create(draft, False)
    out.write(bytearray(folder.encode()))
    out.close()
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"version {number} of {path} was made meanwhile")


def replace_table(df: DataFrame, path: str, after: int | None = None) -> int:
    """Make df the current version and return its number; df may read the table itself. `after` is the version that df was
    made from: if another one has been made since, nothing changes and Conflict is raised."""
    spark = df.sparkSession
    before = version(spark, path) if after is None else after
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    _commit(spark, path, folder, before + 1)
    return before + 1


def upsert_table(new: DataFrame, path: str, keys: list[str]) -> int:
    """Replace the rows of incoming keys, or make the table if there is none."""
    spark = new.sparkSession
    before = version(spark, path)
    return replace_table(upserted(current(spark, path, before), new, keys) if before else new, path, before)


def upsert_latest(new: DataFrame, path: str, keys: list[str], recency: str, order: list[str]) -> int:
    """Of old and incoming rows of a key the last by recency."""
    spark = new.sparkSession
    before = version(spark, path)
    old = current(spark, path, before) if before else new.limit(0)
    return replace_table(last_wins(old, new, keys, recency, order), path, before)


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the last `keep` versions and data that no manifest names; returns the versions deleted. Not to be run
    while a writer is at work."""
    fs, make = store(spark, path)
    numbers = _manifests(spark, path)
    gone, kept = numbers[: max(0, len(numbers) - keep)], numbers[max(0, len(numbers) - keep) :]
    live = {_folder(spark, path, n).rsplit("/", 1)[1] for n in kept}
    for n in gone:
        fs.delete(make(f"{path}/manifests/{n:012d}"), False)
    for f in fs.listStatus(make(path)):
        name = f.getPath().getName()
        if name.startswith(("data-", "draft-")) and name not in live:
            fs.delete(f.getPath(), True)
    return len(gone)
