"""Secret scans by corpus-wide ownership frequency.

Candidates are found in each text; their hashes are counted over the whole corpus by distinct repositories and owners.
A value that many owners or repositories hold is an example that was copied around; a value that one owner holds and
that looks live (by its characters' spread, runs and classes, no word list) adds a span of kind `live`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import documents, free, mapped, small_side, text_hash, written

#: Fixed patterns of the base kinds, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
MANY_OWNERS, MANY_REPOS, HOT = 2, 10, 1e-4
#: A live value's characters: bits of entropy at least, share of neighbours that are equal or follow each other at most, and
#: changes between letters and digits at least.
BITS, IN_ORDER, CHANGES = 2.5, 0.35, 2
CANDIDATE = "array<struct<hash:binary,start:long,stop:long,live:boolean>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, value) of the base kinds, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def looks_live(value: str) -> bool:
    """Whether the characters are as in a random key: spread over BITS or more, few neighbours that are equal or follow each
    other (xxxx, 1234, abcd), and letters and digits that take turns, as they do not in words with a number behind."""
    n = len(value)
    if n < 2 or -sum(c / n * math.log2(c / n) for c in Counter(value).values()) < BITS:
        return False
    if sum(0 <= ord(b) - ord(a) <= 1 for a, b in zip(value, value[1:], strict=False)) > IN_ORDER * (n - 1):
        return False
    classes = [c.isdigit() for c in value if c.isalnum()]
    return sum(a != b for a, b in zip(classes, classes[1:], strict=False)) >= CHANGES


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], []]
        for t in b.column(1):
            text = t.as_py() or ""
            spans = base_spans(text)
            values = {(end - len(v), end): v for _, _, end, v in spans}
            for m in OPAQUE.finditer(text):
                values.setdefault((m.start(), m.end()), m[0])
            cols[0].append([sum(s[1] == k for s in spans) for k in range(3)])
            cols[1].append([{"start": s, "kind": k, "stop": e} for s, k, e, _ in spans])
            cols[2].append([{"hash": hashlib.sha256(v.encode()).digest()[:16], "start": s, "stop": e, "live": looks_live(v)} for (s, e), v in sorted(values.items())])
        spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
        found = pa.list_(pa.struct([("hash", pa.binary()), ("start", pa.int64()), ("stop", pa.int64()), ("live", pa.bool_())]))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array([c[k] for c in cols[0]], pa.int64()) for k in range(3)), pa.array(cols[1], spans), pa.array(cols[2], found), *(b.column(i) for i in (2, 3, 4))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base", "found", "repo", "owner", "text_hash"])


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repos, rows) of found(hash, repo, owner); each step is summed within tasks before it is shuffled."""
    once = found.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("rows"))
    by_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("rows").alias("rows"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repos"), F.sum("rows").alias("rows"))


def _judged(found: DataFrame) -> DataFrame:
    """(row, start, stop, example) of the candidates of found(row, repo, owner, hash, start, stop, live) that look live.

    Hashes that hold a share of HOT or more of all candidates, 1 / HOT of them at most, are looked up in a broadcast
    table; only rarer ones are shuffled, so no widely copied value meets in one task.
    """
    example = (F.col("owners") >= MANY_OWNERS) | (F.col("repos") >= MANY_REPOS)
    held = written(ownership(found.select("hash", "repo", "owner")).select("hash", "rows", example.alias("example")), "held")
    total = held.agg(F.sum("rows")).first()[0] or 0
    often = F.col("rows") >= max(2.0, HOT * total)
    live = found.filter("live").select("row", "hash", "start", "stop")
    hot = F.broadcast(held.filter(often).select("hash", "example"))
    rare = live.join(hot, "hash", "left_anti").join(held.filter(~often).select("hash", "example"), "hash")
    return live.join(hot, "hash").unionByName(rare).drop("hash")


def scan_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, n_assign, n_access, n_hex, n_example, base and live (spans)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (repo_col, owner_col)]
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), names[0].alias("repo"), names[1].alias("owner"), text_hash(text).alias("text_hash"))
    span = "array<struct<start:long,kind:int,stop:long>>"
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base {span}, found {CANDIDATE}, repo string, owner string, text_hash long"
    scanned = written(mapped(rows, _scan, schema).withColumn("row", F.monotonically_increasing_id()), "scanned")
    found = scanned.select("row", "repo", "owner", F.explode("found").alias("f")).select("row", "repo", "owner", "f.*")
    live = _judged(found).groupBy("row").agg(
        F.collect_list(F.when(~F.col("example"), F.struct("start", F.lit(3).alias("kind"), "stop"))).alias("live"), F.count_if("example").alias("n_example"))
    return scanned.join(live, "row", "left").select(
        "doc_id", "text_hash", "n_assign", "n_access", "n_hex", F.coalesce("n_example", F.lit(0)).alias("n_example"), "base",
        F.sort_array(F.coalesce("live", F.array().cast(span))).alias("live"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    Positions count code points, ends are exclusive. Null texts are empty; null repositories and owners count as the
    empty name. Repeated rows give repeated rows, an empty table an empty result; other columns are ignored.
    """
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"], s["stop"])
    return scan_rows(docs, id_col, text_col, repo_col, owner_col).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.array_join(F.transform("base", name), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(F.sort_array(F.concat("base", "live")), name), ",").alias("spans"),
        F.size("live").cast("long").alias("n_live"), "n_example")


MARK = "<secret>"


def masked(text: str | None, live: list[tuple[int, int]]) -> str | None:
    """The text with every base span and the given ones replaced by MARK; overlapping spans become one mark."""
    spans = sorted([(s, e) for s, _, e, _ in base_spans(text or "")] + live)
    if not spans:
        return text
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], MARK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """docs with every base span and every live span of the text replaced by MARK; no row is dropped, no column changes.

    A row is known by its id and text, so rows that repeat an id, or have none, get the spans of their own text. A null
    text stays null. Repeated rows stay repeated, an empty table gives an empty result.
    """
    spans = scan_rows(docs, id_col, text_col, **names).filter(F.size("live") > 0)
    live, own, key = free(docs, "live"), free(docs, "own_id"), free(docs, "own_hash")
    places = F.transform("live", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    table = written(spans.groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(key)).agg(F.first(places).alias(live)), "live")
    table = small_side(table, F.size(live) * 24)
    wide = docs.join(table, docs[id_col].eqNullSafe(F.col(own)) & (text_hash(docs[text_col]) == F.col(key)), "left").select(*docs.columns, live)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[(x["start"], x["stop"]) for x in row or []] for row in b.column(b.num_columns - 1).to_pylist()]
            texts = pa.array([masked(t.as_py(), spans) for t, spans in zip(b.column(at), found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else b.column(i) for i in range(b.num_columns - 1)], names=b.schema.names[:-1])

    return mapped(wide, run, docs.schema)


def op5_secrets(spark, sf_dir):
    return secrets(documents(spark, sf_dir))


SQL: dict[str, str] = {}
