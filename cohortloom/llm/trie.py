"""Conversation prefix trie: union-find over sorted neighbours.

A conversation is its sequence of turns; a trie node is a distinct sequence of first turns. Conversations are sorted by
their sequences, so those below a node are neighbours, and the number of leading turns that two neighbours share is an
edge between them. Within a block of sorted conversations edges are taken deepest first: each merges two components of a
union-find and makes, or joins, the node at its depth. A block's forest is then contracted: only nodes that hold its first
or last conversation can go on in another block. Contracted forests of adjacent blocks are merged across their boundaries
by groups, in as many rounds as it takes, until one is left.

A turn is known by 128 bits of a SHA-256. A conversation's row holds 32 characters and a word count for each of its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import mapped, ship, written

WIDTH = 32  # characters of a turn's name
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 50_000  # of a block of sorted conversations
PART_BYTES, FAN = 64 << 20, 64  # of a partition of sorted conversations; contracted forests merged in one round
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "struct<me:string,conv_id:long,n_convs:long,n_children:long,n_leaves:long,saved:long,words:long>"
ROWS = (
    "kind int, part long, block long, me string, up string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    f"saved_tokens long, ends_sha256 string, ids string, head array<{NODE}>, tail array<{NODE}>"
)
CLOSED, ENDS, FOREST = 0, 1, 2
COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_node = pa.struct([("me", pa.string()), *((c, pa.int64()) for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved", "words"))])
_arrow = pa.schema(
    [("kind", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("me", pa.string()), ("up", pa.string()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", *COUNTS)),
     ("ends_sha256", pa.string()), ("ids", pa.string()), ("head", pa.list_(_node)), ("tail", pa.list_(_node))])


def turn_lists(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns (key, words) by turn, null first; null roles and texts are empty.

    Turns that share a number follow in the order of their role and key. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, WIDTH)
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), key.alias("key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def spliced(lists: DataFrame, head_id: Column, length: Column, longest: int) -> DataFrame:
    """Every conversation with its first `length` turns (at most `longest`) taken from conversation `head_id`; all if that
    has fewer, none if there is no such conversation."""
    heads = lists.select(F.col("conv_id").alias("_head"), F.slice("turns", 1, longest).alias("_first"))
    named = lists.withColumn("_head", head_id).withColumn("_n", length).join(heads, "_head", "left")
    none = F.slice("turns", 1, 0)
    first = F.slice(F.coalesce("_first", none), F.lit(1), F.col("_n"))
    rest = F.when(F.size("turns") > F.col("_n"), F.slice("turns", F.col("_n") + 1, F.greatest(F.size("turns") - F.col("_n"), F.lit(0)))).otherwise(none)
    return named.select("conv_id", F.concat(first, rest).alias("turns"))


class _Node:
    __slots__ = ("child", "conv", "depth", "ends", "item", "kids", "leaves", "me", "n", "parent", "same", "saved")

    def __init__(self, depth: int, item: int, conv: int, n: int = 1) -> None:
        self.depth, self.item, self.conv, self.n = depth, item, conv, n
        self.kids = self.leaves = self.saved = 0
        self.ends, self.parent, self.child, self.same, self.me = None, None, None, None, None


def shared_turns(a: str, b: str) -> int:
    """Leading turns that two sequences share."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if not high or a[:WIDTH] != b[:WIDTH]:
        return 0
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * WIDTH] == b[: mid * WIDTH] else (low, mid - 1)
    return low


def forest(items: list[tuple[str, int, list[int]]]) -> tuple[list[_Node], list[_Node], list[_Node]]:
    """The trie of sorted items (sequence, conv_id, words of each turn): all nodes, and those that hold the first and the last
    item, from the root on."""
    m = len(items)
    size = [len(s) // WIDTH for s, _, _ in items]
    shared = [0, *(shared_turns(items[i - 1][0], items[i][0]) for i in range(1, m))]
    tops = [_Node(size[i], i, items[i][1]) for i in range(m)]
    own, group, done = list(tops), list(range(m)), []
    for node in tops:
        node.ends = [node.conv]

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    def close(node: _Node) -> None:
        if not node.kids:
            node.leaves = 1
        if node.depth:
            node.saved += (node.n - 1) * items[node.item][2][node.depth - 1]
        done.append(node)

    def lifted(node: _Node, depth: int) -> _Node:
        """The node above at this depth; those between have one child each."""
        while node.depth > depth:
            close(node)
            above = _Node(node.depth - 1, node.item, node.conv, node.n)
            above.kids, above.leaves, above.saved, above.child = 1, node.leaves, node.saved, node
            node.parent = above
            node = above
        return node

    for i in sorted(range(1, m), key=lambda i: -shared[i]):  # neighbours from left to right among edges of one depth
        left, right = find(i - 1), find(i)
        a, b = lifted(tops[left], shared[i]), lifted(tops[right], shared[i])
        a.n, a.conv, a.kids, a.leaves, a.saved = a.n + b.n, min(a.conv, b.conv), a.kids + b.kids, a.leaves + b.leaves, a.saved + b.saved
        if b.child is not None:
            b.child.parent = a
        else:  # a copy of what a ends with
            a.ends += b.ends
        b.same = a
        tops[left], group[right] = a, left
    root = lifted(tops[find(0)], 0)
    close(root)

    def path(node: _Node) -> list[_Node]:
        while node.same is not None:
            node = node.same
        out = []
        while node is not None:
            out.append(node)
            node = node.parent
        return out[::-1]

    return done, path(own[0]), path(own[-1])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_arrow)


def _named(path: list[_Node], sequence: str) -> None:
    """Names of the nodes on a path: hashes of their sequences."""
    digest = hashlib.sha256()
    for node in path:
        if node.depth:
            digest.update(sequence[(node.depth - 1) * WIDTH : node.depth * WIDTH].encode())
        node.me = digest.hexdigest()[:WIDTH]


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _block(items: list[tuple[str, int, list[int]]], part: int, block: int) -> Iterator[pa.RecordBatch]:
    nodes, head, tail = forest(items)
    _named(head, items[0][0])
    _named(tail, items[-1][0])
    at = {"part": part, "block": block}
    rows: list[dict] = []
    for x in nodes:
        if x.me is None:
            up = x.parent
            rows.append({
                "kind": CLOSED, **at, "up": up.me, "conv_id": x.conv, "depth": x.depth, "parent_conv_id": up.conv if up.me is None else None, "n_convs": x.n, "n_children": x.kids, "n_leaves": x.leaves,
                "saved_tokens": x.saved, "ends_sha256": hashlib.sha256(_joined(x.ends).encode()).hexdigest() if x.ends else NO_ENDS})
        elif x.ends:
            rows.append({"kind": ENDS, **at, "me": x.me, "ids": _joined(x.ends)})
        if len(rows) == 5000:
            yield _batch(rows)
            rows = []
    both = sum(a is b for a, b in zip(head, tail, strict=False))
    told = lambda x: {"me": x.me, "conv_id": x.conv, "n_convs": x.n, "n_children": x.kids, "n_leaves": x.leaves, "saved": x.saved, "words": items[x.item][2][x.depth - 1] if x.depth else 0}
    rows.append({"kind": FOREST, **at, "depth": both, "head": [told(x) for x in head], "tail": [told(x) for x in tail[both:]]})
    yield _batch(rows)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One contracted forest for each block of rows (sequence, conv_id, words), which come sorted."""
    from pyspark import TaskContext

    part, block, items, held = TaskContext.get().partitionId(), 0, [], 0
    for b in batches:
        for sequence, conv, words in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if items and (held > BLOCK_BYTES or len(items) >= BLOCK_ROWS):
                yield from _block(items, part, block)
                block, items, held = block + 1, [], 0
            items.append((sequence, conv, words))
            held += len(sequence)
    if items:
        yield from _block(items, part, block)


class _Open:
    """A contracted forest: the nodes that hold its first (head) and its last conversation (tail), from the root on. The
    first `both` nodes are the same ones."""

    def __init__(self, head: list[dict], rest: list[dict], both: int) -> None:
        self.head, self.both, self.tail = head, both, head[:both] + rest

    def joined(self, right: _Open) -> Iterator[tuple[int, list[dict]]]:
        """Take the forest to the right in; (depth, path) of each node that is complete now."""
        a, b = self.tail, right.head
        same = 0
        while same < min(len(a), len(b)) and a[same]["me"] == b[same]["me"]:
            same += 1
        ended = not a[same - 1]["n_children"] or not b[same - 1]["n_children"]  # one side took the deepest for a leaf, or both did
        words = 0
        for d in range(same - 1, -1, -1):
            x, y = a[d], b[d]
            words += x["words"]
            x["conv_id"] = min(x["conv_id"], y["conv_id"])
            x["n_convs"] += y["n_convs"]
            x["n_children"] += y["n_children"] - (d < same - 1)
            x["n_leaves"] += y["n_leaves"] - ended
            x["saved"] += y["saved"] + words
            if d >= self.both and d >= right.both:
                yield d, a
        for d in range(max(same, self.both), len(a)):
            yield d, a
        for d in range(max(same, right.both), len(b)):
            yield d, b
        self.tail = a[: min(same, right.both)] + right.tail[min(same, right.both) :]
        self.both = min(self.both, same, right.both)


def _merged(forests: DataFrame, last: bool) -> DataFrame:
    """Contracted forests (part, block, head, tail) merged by groups of FAN parts; the last round closes every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, rows = None, None, []

        def closed(found: Iterator[tuple[int, list[dict]]]) -> None:
            for d, path in found:
                x = path[d]
                rows.append({
                    "kind": CLOSED, "part": -1 - now, "me": x["me"], "up": path[d - 1]["me"] if d else None, "conv_id": x["conv_id"], "depth": d, "n_convs": x["n_convs"], "n_children": x["n_children"],
                    "n_leaves": x["n_leaves"], "saved_tokens": x["saved"]})

        def ended() -> None:
            if last:
                closed((d, open_.head) for d in range(len(open_.head)))
                closed((d, open_.tail) for d in range(open_.both, len(open_.tail)))
            else:
                rows.append({"kind": FOREST, "part": now, "block": 0, "depth": open_.both, "head": open_.head, "tail": open_.tail[open_.both :]})

        for b in batches:
            for i in range(b.num_rows):  # one at a time: a forest may be long
                group, head, rest, both = (b.column(j)[i].as_py() for j in range(4))
                if open_ is not None and group != now:
                    ended()
                    open_ = None
                now, found = group, _Open(head, rest, both)
                if open_ is None:
                    open_ = found
                else:
                    closed(open_.joined(found))
                if len(rows) >= 1000:
                    yield _batch(rows)
                    rows = []
        if open_ is not None:
            ended()
            yield _batch(rows)

    group = F.floor(F.col("part") / FAN).cast("long")
    dealt = forests.select(group.alias("group"), "head", "tail", "depth", "part", "block").repartition("group").sortWithinPartitions("group", "part", "block")
    return mapped(dealt.drop("part", "block"), run, ROWS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(me, ends_sha256) of rows (me, ids) that come sorted: ids run through the hash, none are kept."""
    now, digest = None, None
    for b in batches:
        out = []
        for me, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if me != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = me, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], names=["me", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["me", "ends_sha256"])


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row for each trie node of convs(conv_id, turns array<struct<key, words>>): conv_id (its least member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations without a turn are members of the root. conv_id is unique; equal sequences are members of the same nodes.
    An empty table gives an empty result, without a root.
    """
    spark = convs.sparkSession
    plain = convs.select(F.array_join(F.col("turns.key"), "").alias("sequence"), "conv_id", F.col("turns.words").alias("words"))
    rows = written(plain, "sequences")
    size = rows.agg(F.sum(F.length("sequence") + 64)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    dealt = rows.repartitionByRange(parts, "sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    made = written(mapped(dealt, _forests, ROWS), "forests", "kind")
    kind = lambda table, k: table.filter(F.col("kind") == k)
    forests = kind(made, FOREST)
    parts, opened = (forests.agg(F.max("part")).first()[0] or 0) + 1, None
    while True:
        merged = written(_merged(forests, parts <= FAN), "merged", "kind")
        opened = kind(merged, CLOSED) if opened is None else opened.unionByName(kind(merged, CLOSED))
        if parts <= FAN:
            break
        parts, forests = -(-parts // FAN), kind(merged, FOREST)
    ends = mapped(kind(made, ENDS).select("me", "ids", "part", "block").repartition("me").sortWithinPartitions("me", "part", "block").select("me", "ids"), _hashed, "me string, ends_sha256 string")
    names = written(opened.select(F.col("me").alias("up"), F.col("conv_id").alias("up_conv")), "names")
    opened = opened.drop("ends_sha256").join(ends, "me", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    keys = ("part", "up", "conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256")
    nodes = kind(made, CLOSED).select(*keys).unionByName(opened.select(*keys))
    # A node that many blocks share may have any number of children: each part asks for it once.
    asked = nodes.filter("up is not null").select("part", "up").distinct()
    told = asked.join(names, "up")
    return nodes.join(told, ["part", "up"], "left").select("conv_id", "depth", F.coalesce("parent_conv_id", "up_conv").alias("parent_conv_id"), *COUNTS, "ends_sha256")


def op11_prefix_trie(spark, sf_dir):
    lists = turn_lists(ship(spark).read.parquet(f"{sf_dir}/conversations.parquet"))
    length = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    return prefix_trie(spliced(lists, F.col("conv_id") - F.col("conv_id") % 20, length, 3))


# CRC-32 bit by bit: each character is mixed in, then eight steps (-1) shift it out.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, e: CASE WHEN e >= 0 THEN xor(acc, e) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295)"""
SQL = {
    "op11_prefix_trie": rf"""
WITH lists AS (
    SELECT conv_id, list([md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::VARCHAR] ORDER BY turn NULLS FIRST) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
    FROM (SELECT *, {_CRC} % 4 AS h FROM lists) a LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 20),
prefixes AS (SELECT conv_id, len(turns) AS n, d, list_transform(turns[1:d], lambda t: t[1])::VARCHAR AS path, list_transform(turns[1:d - 1], lambda t: t[1])::VARCHAR AS above, CASE WHEN d > 0 THEN turns[d][2]::BIGINT ELSE 0 END AS words
    FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, path, any_value(CASE WHEN d > 0 THEN above END) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM prefixes GROUP BY d, path),
kids AS (SELECT d - 1 AS d, above AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, path)),
below AS (SELECT DISTINCT p.d, p.path, q.d AS dd, q.path AS sub FROM prefixes p JOIN prefixes q ON p.conv_id = q.conv_id AND q.d >= p.d),
sums AS (SELECT b.d, b.path, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves, sum(c.saved)::BIGINT AS saved_tokens FROM below b JOIN counted c ON c.d = b.dd AND c.path = b.sub GROUP BY 1, 2)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (d, path) LEFT JOIN counted p ON p.d = c.d - 1 AND p.path = c.above"""
}
