import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from cohortloom.llm import trie

from . import brute

SCHEMA = "conv_id long, turn long, role string, text string, depth int, turns string, _head string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute_trie(convs):
    """convs: {conv_id: list of turns} -> the nodes' rows."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(brute.WORD.findall(p[-1][1])) for p in below if p)
        leaf = [p for p in below if not any(q[:-1] == p for q in members if q)]
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(ids), len(path), parent, len(ids), sum(q[:-1] == path for q in members if q), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def query(spark, rows, tmp_path):
    of(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r[c] for c in NAMES) for r in trie.op11_prefix_trie(spark, str(tmp_path)).collect()), key=str)


def random_rows(seed, convs, turns=5, words="ab"):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"][: 1 + r.random().__lt__(0.2)]), " ".join(r.choice(words) for _ in range(r.randrange(3)))) for c in range(convs) for t in range(r.randrange(1, turns))]


@pytest.mark.parametrize("block, parts", [(50_000, 4), (3, 4), (1, 3), (7, 1)])
def test_trie_is_brute_force(spark, tmp_path, monkeypatch, block, parts):
    """Nodes within a block, across blocks and across partitions."""
    monkeypatch.setattr(trie, "BLOCK_ROWS", block)
    monkeypatch.setattr(trie, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for seed in range(2):
            rows = random_rows(seed, 130)
            assert query(spark, rows, tmp_path) == brute_trie(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_trie_odd_rows(spark, tmp_path):
    """Nulls, turnless conversations, repeated rows, a missing head, one long conversation, many copies of one."""
    rows = [(0, None, None, None), (0, 1, "user", "a b"), (0, 1, "user", "a b"), (None, 1, "user", "x"), (3, 2, None, ""), (21, 0, "user", None), (25, 0, "user", "a"), (41, 5, "user", "É é")]
    rows += [(60, t, "user", f"turn {t}") for t in range(3000)] + [(c, t, "user", "copy " * (t + 1)) for c in range(100, 160) for t in range(6)]
    convs = rebuilt(rows)
    assert any(not t for t in convs.values())
    short = [r for r in rows if r[0] != 60]
    assert query(spark, short, tmp_path) == brute_trie(rebuilt(short))
    got = query(spark, rows, tmp_path)
    assert max(r[1] for r in got) == 3000 and len(got) == len({tuple(t[:d]) for t in convs.values() for d in range(len(t) + 1)})
    assert query(spark, [], tmp_path) == []


def test_trie_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((tuple(r[c] for c in NAMES) for r in trie.op11_prefix_trie(spark, sf).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert got == sorted(con.sql(f"SELECT {', '.join(NAMES)} FROM ({trie.SQL['op11_prefix_trie']})").fetchall(), key=str)
