"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets form a class; classes are compared. A prefix test first drops classes that cannot
reach the threshold with any other. The rest are partitioned into groups of similar documents (least class sharing a
rare shingle, by size band); each group stores its token union with counts. A class opens a group only if its overlap
with that union reaches what the threshold needs. An opened group is first compared through its hub, the member with
the largest overlap with the union; only pairs still in different components are then compared directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._graph import components
from ._util import documents, mapped, small_side, text_hash, written

#: Overlap o links sizes n and m when o / (n + m - o) >= 0.8, which is 9 o >= 4 (n + m).
K = 5
ROWS, OFTEN = 1 << 20, 64  # prefix rows that a task looks at together, and rows of one shingle among them that are thinned


def need(n):
    """Least overlap with any linked set: 0.8 n, rounded up."""
    return (4 * n + 4) // 5


def slack(n):
    """Matches asked of two prefixes that are this much longer than the plain prefix."""
    return (n + 9) // 10


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set: two sums of differently mixed fingerprints."""
    one = np.fromiter((_text.mix(s, 3).sum(dtype=np.uint64) for s in sets), np.uint64, len(sets))
    two = np.fromiter((_text.mix(s, 4).sum(dtype=np.uint64) for s in sets), np.uint64, len(sets))
    return one.view(np.int64), two.view(np.int64)


def set_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n, k1, k2): size and name of each document's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(_text.shingle_sets(b.column(2), K))
            k1, k2 = _keys(sets)
            cols = [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "n", "k1", "k2"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return mapped(rows, run, "doc_id long, text_hash long, n long, k1 long, k2 long")


def _known(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which rows of distinct (t, k) need not meet the rows of their shingle elsewhere: those beyond the first two of a
    frequent shingle and one size. They are each other's neighbours, and the two stand for them."""
    out = np.zeros(len(t), bool)
    names, counts = np.unique(t, return_counts=True)
    often = names[counts > OFTEN]
    if len(often):
        at = np.flatnonzero(np.isin(t, often))
        at = at[np.lexsort((n[at], t[at]))]
        first = np.concatenate([[True], (t[at][1:] != t[at][:-1]) | (n[at][1:] != n[at][:-1])])
        start = np.flatnonzero(first)
        out[at] = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at)))) >= 2
    return out


def _prefixes(docs: DataFrame) -> DataFrame:
    """(t, n, k): the least need-based prefix of each set, `slack` longer, in fingerprint order. t is null where a neighbour
    is known already. Copies within a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, met = [], 0, set()

        def out() -> pa.RecordBatch:
            t, n, k = (np.concatenate([h[i] for h in held]) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(t, mask=_known(t, n)), pa.array(n), pa.array(k)], names=["t", "n", "k"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                sets = list(_text.shingle_sets(b.column(0).slice(at, 256), K))
                k1, _ = _keys(sets)
                for s, k in zip(sets, k1.tolist(), strict=True):
                    if len(s) and k not in met:
                        met.add(k)
                        part = s[: min(len(s), len(s) - need(len(s)) + slack(len(s)))].view(np.int64)
                        held.append((part, np.full(len(part), len(s), np.int32), np.full(len(part), k, np.int64)))
                        size += len(part)
                if size > ROWS:
                    yield out()
                    held, size, met = [], 0, set()
        if held:
            yield out()

    return mapped(docs.select("text"), run, "t long, n int, k long")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (t, n, k), null t first. Count for each k the shingles that another set of fitting size has too.

    Fitting sizes are next to each other within a shingle, so each row looks only at the rows beside it and a shingle
    held by any number of documents is read as a stream.
    """
    t0, n0, k0, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def counted(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        names, where, c = np.unique(k, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(n[where]), pa.array(c.astype(np.int64))], names=["k", "n", "c"])

    for b in batches:
        if b.column(0).null_count:
            known = b.filter(b.column(0).is_null())
            yield counted(known.column(2).to_numpy(), known.column(1).to_numpy().astype(np.int64))
            b = b.filter(b.column(0).is_valid())
        t, n, k = (np.concatenate([old, b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, old in enumerate((t0, n0, k0)))
        if not len(t):
            continue
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        t, n, k = t[fresh], n[fresh], k[fresh]
        beside = (t[1:] == t[:-1]) & (5 * n[:-1] >= 4 * n[1:])
        hit = np.zeros(len(t), bool)
        hit[1:] |= beside
        hit[:-1] |= beside
        hit[: len(seen)] |= seen
        if hit[:-1].any():
            yield counted(k[:-1][hit[:-1]], n[:-1][hit[:-1]])
        t0, n0, k0, seen = t[-1:], n[-1:], k[-1:], hit[-1:]
    if len(seen) and seen[0]:
        yield counted(k0, n0)


def _full_sets(rows: DataFrame) -> DataFrame:
    """(x, n, ts) for rows (x, k1, text); rows whose text is not the named set are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = list(_text.shingle_sets(part.column(2), K))
                same = _keys(sets)[0] == part.column(1).to_numpy(zero_copy_only=False)
                kept = [s.view(np.int64) for s, y in zip(sets, same, strict=True) if y]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(same)), pa.array([len(s) for s in kept], pa.int64()), pa.array(kept, pa.list_(pa.int64()))], names=["x", "n", "ts"])

    return mapped(rows, run, "x long, n long, ts array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Keep pairs(a, b) whose exact overlap reaches the threshold."""
    a = sets.select(F.col("x").alias("a"), F.col("n").alias("na"), F.col("ts").alias("ta"))
    b = sets.select(F.col("x").alias("b"), F.col("n").alias("nb"), F.col("ts").alias("tb"))
    both = pairs.join(a, "a").join(b, "b")
    return both.filter(9 * F.size(F.array_intersect("ta", "tb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def _links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between classes (x, n, k1, doc_id, text_hash): enough of them to connect whatever the full set of links connects."""
    rows = _prefixes(docs).repartition(F.coalesce("t", "k")).sortWithinPartitions("t", "n", "k")
    shared = mapped(rows, _neighbours, "k long, n long, c long")
    alive = shared.groupBy("k").agg(F.sum("c").alias("c"), F.max("n").alias("n")).filter("c >= ((4 * n + 4) div 5 + 9) div 10").select("k")
    held = small_side(written(classes.join(alive, classes.k1 == alive.k, "left_semi").select("x", "k1", F.col("doc_id").alias("id"), "text_hash"), "held"))
    texts = docs.join(held, docs["doc_id"].eqNullSafe(F.col("id")) & (text_hash(docs["text"]) == F.col("text_hash"))).select("x", "k1", "text")
    full = written(_full_sets(texts).dropDuplicates(["x"]), "sets")

    # Shingles of one class only are in no overlap; what is left must still reach the need.
    tokens = full.select("x", "n", F.explode("ts").alias("t"))
    common = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    asked = F.floor((4 * F.col("n") + 4) / 5)
    sets = written(
        tokens.join(common, "t").groupBy("x", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s")).filter(F.size("s") >= asked)
        .select("x", "n", F.col("s.t").alias("ts")), "shared")
    prefix = sets.select("x", "n", F.size("ts").alias("s"), F.posexplode(F.slice("ts", F.lit(1), (F.size("ts") - asked + 1).cast("int"))).alias("i", "t"))

    # Groups: the least class that shares a prefix shingle, by bands of size.
    lists = prefix.groupBy("t").agg(F.min("x").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    prefix = prefix.join(lists, "t")
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(1.05)).cast("long")
    group = F.concat_ws(":", F.min("least"), F.first(band)).alias("g")
    member = written(prefix.groupBy("x").agg(group, F.first("n").alias("n")), "groups")
    prefix = written(prefix.select("x", "t", "s", "i").join(member, "x"), "prefix")
    span = member.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))

    # The matrix: each group's token union, with the number of members that hold the token.
    owned = sets.select("x", F.explode("ts").alias("t")).join(member, "x")
    matrix = owned.groupBy("g", "t").agg(F.count(F.lit(1)).alias("m"))
    seen = prefix.select("t", F.col("g").alias("h")).distinct()
    query = prefix.join(seen, "t").select("x", "n", "g", "h").distinct().join(span.withColumnRenamed("g", "h"), "h")
    query = query.filter((5 * F.col("n") >= 4 * F.col("lo")) & (5 * F.col("hi") >= 4 * F.col("n")))
    spread = query.join(owned.select("x", "t"), "x").join(matrix.withColumnRenamed("g", "h"), ["h", "t"])
    other = F.col("m") - (F.col("g") == F.col("h")).cast("int")
    bound = written(spread.groupBy("x", "h", "g", "n", "lo").agg(F.count_if(other > 0).alias("o"), F.sum("m").alias("w")), "bound")
    opened = bound.filter(9 * F.col("o") >= 4 * (F.col("n") + F.greatest("lo", asked))).select("x", "h")
    hubs = bound.filter("g = h").groupBy("h").agg(F.max(F.struct("w", (-F.col("x")).alias("x"))).alias("hub")).select("h", (-F.col("hub.x")).alias("b"))
    star = opened.join(hubs, "h").filter("x <> b").select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b")).distinct()
    links = written(_verified(star, sets), "links")

    # What the hubs left apart: pairs across components in opened groups on a common prefix shingle. After their first
    # common shingle, at places i and j in the common order, both must still hold enough shingles.
    comp = components(links)
    apart = prefix.join(comp, F.col("x") == comp.node, "left").select("x", "n", "g", "t", "s", "i", F.coalesce("component", "x").alias("c"))
    apart = written(apart.join(opened.select("x").distinct(), "x", "left_semi"), "apart")
    mixed = apart.groupBy("t", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("t").agg(F.max(F.struct("m", "c")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    one = apart.join(mixed.select("t", F.col("top.c").alias("major")), "t").filter("c <> major").join(opened.withColumnRenamed("h", "gy"), "x")
    two = apart.select("t", F.col("x").alias("y"), F.col("n").alias("ny"), F.col("g").alias("gy"), F.col("c").alias("cy"), F.col("s").alias("sy"), F.col("i").alias("j"))
    able = "c <> cy and (cy = major or x < y) and 5 * n >= 4 * ny and 5 * ny >= 4 * n and 9 * least(s - i, sy - j) >= 4 * (n + ny)"
    pairs = one.join(two, ["t", "gy"]).filter(able).select("x", "y", "g").distinct()
    pairs = pairs.join(opened.select(F.col("x").alias("y"), F.col("h").alias("g")), ["y", "g"], "left_semi")
    rest = _verified(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), sets)
    return links.unionByName(rest)


def _component_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_hash, n, first) for each row of docs(doc_id, text); first(none, doc_id, row) is the component's row
    with the least id, or without an id if none has one. Rows without a shingle have a null first."""
    table = written(set_table(docs).withColumn("row", F.monotonically_increasing_id()), "set-table")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_hash"))
    classes = table.filter("n > 0").groupBy("k1", "k2").agg(first.alias("first"), F.max("n").alias("n"))
    classes = written(classes.withColumn("x", F.monotonically_increasing_id()), "classes")
    comp = written(components(_links(classes.select("x", "n", "k1", "first.doc_id", "first.text_hash"), docs)), "component")
    least = comp.join(classes, comp.node == classes.x).groupBy("component").agg(F.min("first").alias("least"))
    linked = comp.join(least, "component").select(F.col("node").alias("x"), "least")
    named = classes.join(linked, "x", "left").select("k1", "k2", F.coalesce("least", "first").alias("first"))
    full = table.filter("n > 0").join(named, ["k1", "k2"]).select("row", "doc_id", "text_hash", "n", "first")
    return full.unionByName(table.filter("n = 0").select("row", "doc_id", "text_hash", "n"), allowMissingColumns=True)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Links: Jaccard similarity of the 5-word shingle sets of 0.8 or more. Null and empty texts have no shingle and link
    with nothing. Rows without an id take part like others; component_id is null if no row of the component has an id.
    Rows that repeat an id with different texts are rows of their own; repeated rows give repeated rows. Other columns
    are ignored, an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return _component_rows(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keepers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, kept) for every row: of each component one row is kept, with the least id, rows without an id last."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _component_rows(docs).select("doc_id", "text_hash", ((F.col("n") == 0) | (F.col("row") == F.col("first.row"))).alias("kept"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir))


SQL: dict[str, str] = {}
