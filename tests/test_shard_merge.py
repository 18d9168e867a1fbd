import uuid

import pytest
from pyspark.sql import functions as F

from cohortloom.sources import shard_merge as SM


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def columns(spark, rows):
    return spark.createDataFrame(rows, "shard string, kind string, columns array<string>")


def reasons(df):
    return {r.shard: r.reasons for r in df.collect()}


def test_gate_by_first_and_by_most(spark):
    c = columns(spark, [("a", "x", ["p", "q"]), ("b", "x", ["q", "r", "r"]), ("c", "x", ["r", "q"]), ("d", "x", None), ("c", "y", ["z"])])
    assert reasons(SM.gate(c)) == {"a": [], "b": ["x adds r", "x lacks p"], "c": ["x adds r", "x lacks p"], "d": ["x lacks p, q"]}
    assert reasons(SM.gate(c, "most")) == {"a": ["x adds p", "x lacks r"], "b": [], "c": [], "d": ["x lacks q, r"]}
    assert reasons(SM.gate(c.limit(0))) == {}
    need = reasons(SM.gate(c, "most", ("x", "y")))
    assert need["b"] == ["y is absent"] and need["c"] == []
    with pytest.raises(ValueError):
        SM.gate(c, "last")


def lay_out(spark, root):
    """Three shards of one schema, with odd names and columns in another order, and one of another; two of them in two kinds."""
    make = lambda rows, cols: spark.createDataFrame(rows, cols)
    SM.write_part(make([("s 1/a+b%", 1.0, "u"), ("s 1/a+b%", 2.0, None), ("t=é", 3.0, "v")], "rec string, v double, w string"), root, "feat", "rec")
    SM.write_part(make([("z", "k", 4.0)], "shard string, w string, v double"), root, "feat")
    SM.write_part(make([("y", "k", 5.0)], "shard string, w string, u double"), root, "feat")
    SM.write_part(make([("z", 1), ("y", 2)], "shard string, n long"), root, "note")


def test_merge_excludes_and_records(spark, root):
    lay_out(spark, root)
    with pytest.raises(SM.Mismatch, match="1 of 4 shards differ. y: feat adds u; feat lacks v"):
        SM.merged(spark, root, "feat")
    for told in (None, SM.footer_columns(spark, root)):
        rows, out = SM.merged(spark, root, "feat", "exclude", columns=told)
        assert sorted((r.shard, r.v, r.w) for r in rows.collect() if r.w) == [("s 1/a+b%", 1.0, "u"), ("t=é", 3.0, "v"), ("z", 4.0, "k")]
        assert rows.count() == 4 and reasons(out) == {"y": ["feat adds u", "feat lacks v"]}
        rows, _ = SM.merged(spark, root, "note", "exclude", columns=told)
        assert [(r.shard, r.n) for r in rows.collect()] == [("z", 1)]  # y is left out of every kind


def test_footers_tell_what_column_files_tell(spark, root):
    lay_out(spark, root)
    plain = lambda df: sorted((r.shard, r.kind, sorted(r.columns)) for r in df.collect())
    assert plain(SM.footer_columns(spark, root)) == plain(SM.column_files(spark, root))


def test_nothing_left_and_nameless_shards(spark, root):
    lay_out(spark, root)
    with pytest.raises(SM.Mismatch):
        SM.merged(spark, root, "feat", "exclude", kinds=("feat", "other"))
    with pytest.raises(ValueError):
        SM.merged(spark, root, "feat", "skip")
    with pytest.raises(Exception, match="a shard has no name"):
        SM.write_part(spark.range(2).select(F.lit("").alias("shard"), "id"), root, "feat")


def test_data_of_excluded_shards_is_not_read(spark, root):
    """A file of an excluded shard that cannot be read does no harm."""
    lay_out(spark, root)
    told = SM.column_files(spark, root)
    (path,) = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/data/kind=feat").select("path").collect() if "shard=y" in r.path]
    local = path.split(":", 1)[1].replace("//", "/")
    crc = local.rsplit("/", 1)
    open(local, "wb").write(b"not parquet")
    open(f"{crc[0]}/.{crc[1]}.crc", "wb").close()
    rows, _ = SM.merged(spark, root, "feat", "exclude", columns=told)
    assert rows.count() == 4
