import random

from pyspark.sql import functions as F

from cohortloom.llm.jaccard import jaccard_components

from . import brute

SCHEMA = "doc_id long, text string, n string, k string, component_id int"


def run(spark, docs):
    rows = [(d, t, "x", None, 1) for d, t in docs]
    return sorted((tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()), key=str if any(d is None for d, _ in docs) else None)


def corpus(seed):
    """Families of edited copies around the threshold, shared passages, exact copies, short, empty and null texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    passage = " ".join(word() for _ in range(40))
    docs = [(900 + i, t) for i, t in enumerate(["", None, "   ", "One", "one", "two words", "Two\twords", "a b c d", "a b c d e", "A b C d e"])]
    for f in range(4):
        base = [word() for _ in range(r.choice([8, 30, 60, 120]))]
        for i in range(40):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w = w[: len(w) - r.randrange(4)]
            docs.append((f * 100 + i, " ".join(w).upper() if r.random() < 0.2 else " ".join(w)))
    docs += [(2000 + i, " ".join(word() for _ in range(r.choice([5, 60]))) + " " + passage) for i in range(15)]
    r.shuffle(docs)
    return docs


def test_matches_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        assert run(spark, docs) == brute.jaccard(docs)


def test_sparse_chain(spark):
    """Neighbours link, ends do not: the component comes from paths."""
    r = random.Random(5)
    w = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(12):
        docs.append((i, " ".join(w)))
        w[r.randrange(100)] = f"new{i}"
        w[r.randrange(100)] = f"newer{i}"
    assert run(spark, docs) == brute.jaccard(docs)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_components(empty).count() == 0
    out = run(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f")])
    assert out == [(3, 2, 3), (5, 2, 3), (5, 2, 3)]
    rows = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "z")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in jaccard_components(rows).collect()))) == ["(4, 1, 4)", "(None, 1, 4)", "(None, 1, None)"]


def test_long_text(spark):
    text = " ".join(str(i) for i in range(60_000))
    out = jaccard_components(spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.component_id for r in out] == [1, 1] and out[0].n_shingles == 59_996


def test_few_words_alone(spark):
    """A table, slice or run of rows that holds two, three or four words in all."""
    for n in range(7):
        docs = [(1, " ".join("abcdefg"[:n]))]
        assert run(spark, docs) == brute.jaccard(docs)
    long = " ".join(str(i) for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, "one two three"), (3, "One two  three")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == {1: (199_996, 1), 2: (1, 2), 3: (1, 2)}


def test_one_row_for_each_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = jaccard_components(docs)
    want = brute.jaccard([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(tuple(r) for r in out.collect()) == want
    assert out.filter(F.col("component_id") > F.col("doc_id")).count() == 0


def test_one_id_with_two_texts(spark):
    many, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    out = run(spark, [(5, many), (5, other), (3, many + " x"), (4, other + " x"), (None, other + " y")])
    assert sorted(map(str, out)) == sorted(map(str, [(5, 56, 3), (5, 56, 4), (3, 57, 3), (4, 57, 4), (None, 57, 4)]))


def test_frequent_shingles_of_one_size(spark):
    """Rows beyond the first two of a shingle and a size do not meet it elsewhere, and no link is lost."""
    r = random.Random(9)
    passage = [f"p{i}" for i in range(30)]
    docs = []
    for i in range(400):
        w = list(passage)
        for _ in range(r.choice([0, 1, 1, 2, 4])):
            w[r.randrange(30)] = f"x{i}"
        docs.append((i, " ".join(w)))
    assert run(spark, docs) == brute.jaccard(docs)
