from collections import Counter

import pytest

from . import brute

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark):
    """Each stage's decision on the small table, and the packed tokens of what is left."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).cache()
    extra = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "12 !", "en", "s", 4), (90003, "only here token = f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "en", "s", 9)], docs.schema)
    docs = docs.unionByName(extra)
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "secret_scans", "packing"]
    named = stages["language_id"](spark, docs, "")
    rows = {r.doc_id: r for r in named.collect()}
    assert set(rows) == {r.doc_id for r in docs.collect()} - {90001, 90002} and named.columns == docs.columns
    exact = stages["exact_dedup"](spark, named, "").collect()
    last = {}
    for d, r in rows.items():
        last[brute.ascii_lower(r.text)] = max(d, last.get(brute.ascii_lower(r.text), -1))
    assert {r.doc_id for r in exact} == set(last.values())
    kept = spark.createDataFrame(exact, docs.schema)
    near = stages["near_dedup"](spark, kept, "").collect()
    assert {r.doc_id for r in near} == {c for _, _, c in brute.jaccard([(r.doc_id, r.text) for r in exact])}
    clean = stages["secret_scans"](spark, spark.createDataFrame(near, docs.schema), "").collect()
    assert {r.doc_id for r in clean} == {r.doc_id for r in near}
    assert {r.doc_id: r.text for r in clean}[90003] == "only here <secret>"
    packed = stages["packing"](spark, spark.createDataFrame(clean, docs.schema), "").collect()
    tokens, length = {}, Counter()
    for r in packed:
        tokens[r.doc_id] = r.doc_tokens
        length[r.doc_id] += r.length
    assert tokens == length and set(tokens) == {r.doc_id for r in clean}


WIDE = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _text string, own_id long, live string, row string"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.123, "kept", f"{n}", 7, "l", "r") for n, (i, t) in enumerate(rows)], WIDE)


def test_dedup_decides_by_row(spark):
    """Null ids, ids with several texts, copies within and across ids."""
    stages = dict(pipeline.STAGES)
    docs = wide(spark, [(1, "x"), (1, "y"), (5, "x"), (7, "A"), (7, "a"), (None, "x"), (None, "c"), (None, "C"), (None, None), (8, "z"), (8, "z")])
    got = stages["exact_dedup"](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text).lower()) for r in got.collect()) == [("1", "y"), ("5", "x"), ("7", "a"), ("8", "z"), ("None", "c"), ("None", "none")]
    many = " ".join(f"w{i}" for i in range(60))
    docs = wide(spark, [(5, many), (5, "q r s t u v"), (3, many + " end"), (4, "Q r s t u v"), (None, many + " more"), (None, "1 2 3 4 5"), (None, "1 2 3 4 5"), (9, ""), (9, ""), (2, None)])
    near = stages["near_dedup"](spark, docs, "")
    assert near.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "")[:9]) for r in near.collect()) == [("2", ""), ("3", "w0 w1 w2 "), ("4", "Q r s t u"), ("9", ""), ("9", ""), ("None", "1 2 3 4 5")]


def test_redaction_by_row(spark):
    key = "sk_9aF3kLm2QpXz7RtYv8BnWc4D"
    docs = wide(spark, [(None, f"plain words {key} here"), (3, f"other {key}x9 there"), (3, "plain words which tell whatever comes along the way"), (4, None), (5, "")])
    got = {r._text: r.text for r in dict(pipeline.STAGES)["secret_scans"](spark, docs, "").collect()}
    assert got == {"0": "plain words <secret> here", "1": "other <secret> there", "2": "plain words which tell whatever comes along the way", "3": None, "4": ""}


def test_clashing_columns_empty_tables_and_long_texts(spark):
    stages = dict(pipeline.STAGES)
    long = "the and of with that which these words " * 50_000
    docs = wide(spark, [(1, long), (2, "the and of"), (3, None), (4, "")])
    for rows, want in ((docs, {"0", "1"}), (docs.limit(0), set())):
        learned = rows
        for name, stage in pipeline.STAGES[:-1]:
            learned = stage(spark, learned, "")
            assert learned.schema == docs.schema, name
            learned = spark.createDataFrame(learned.collect(), learned.schema)
        out = learned.collect()
        assert {r._text for r in out} == want and all(r.score == 0.123 and r.lang_pred == "kept" and r.own_id == 7 for r in out)
        packed = stages["packing"](spark, learned, "").collect()
        assert {str(r.doc_id - 1) for r in packed} == want
