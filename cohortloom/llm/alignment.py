"""Cross-tokenizer alignment by whitespace-token anchors.

A text is tokenised whole by two vocabularies, and the tokens' bytes are held against it. Where tokens of both begin with
the space mark, the ends before them are compared; where they are the same byte, they cut the text into windows of token
ids. A window's groups and links follow from its ids alone, so they are worked out once for each distinct pair of id tuples
and remembered.

How often an id pair is linked is counted over the corpus. Texts are tokenised once: blocks of texts keep which windows
each text holds and send their distinct pairs with counts, which Spark adds up; the totals go back to the blocks by a
join, and each block sums them for its texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pack import packed, unpacked
from ._util import documents, held, mapped, written
from .bpe import WORDS_APART, binaries, bytes_of, coded, spread, word_starts

BLOCK = 4 << 20  # bytes of text of a block
REMEMBERED = 500_000  # windows that a worker carries on to its next block
MARK = b"\xff\xff\xff\xff"  # between the two id tuples of a window; no id is that large
BODY, NONE = -1, b""


class Vocabulary:
    """`encode` gives a text's ids, after a space that is put before it, and the bytes that they spell, `together` the same for
    each of several texts; `pieces` the bytes of each id."""

    def __init__(self, encode: Callable[[str], tuple[np.ndarray, bytes]], pieces: list[bytes], together: Callable | None = None) -> None:
        self.encode, self.pieces = encode, pieces
        self.together = together or (lambda texts: list(map(encode, texts)))
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.marked = np.array([p[:1] == b" " for p in pieces])


def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library. Special tokens' strings are plain text. Where the ids follow the
    order of the merges, as ranks do, tiktoken gives the same ids faster."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    words = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    whole = Tokenizer.from_file(path)
    pieces = [NONE] * whole.get_vocab_size()
    for p, i in words.items():
        pieces[i] = p
    together = None
    if all(model["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(merges)):
        ranks = {p: i for p, i in words.items() if i < 256 + len(merges)}
        plain = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        ids_of, spelled = lambda text: plain.encode_ordinary(" " + text), plain.decode_bytes
        if public_tokenizers.PATTERN == WORDS_APART:
            size = np.array([len(p) for p in pieces], np.int64)
            together = lambda texts: by_words(plain, size, texts) or list(map(encode, texts))
    else:
        whole.encode_special_tokens = True
        ids_of, spelled = lambda text: whole.encode(" " + text, add_special_tokens=False).ids, lambda ids: b"".join(map(pieces.__getitem__, ids))

    def encode(text: str) -> tuple[np.ndarray, bytes]:
        ids = ids_of(text)
        return np.array(ids, np.uint32), spelled(ids)

    return Vocabulary(encode, pieces, together)


SEGMENT = re.compile(" +[^ ]*")
SEGMENT_BYTES = 48 << 20  # of remembered segments, as they lie in memory
TOGETHER = 8 << 20  # bytes of texts whose words are told apart at once


def by_words(plain, size: np.ndarray, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
    """Ids and bytes of each text after a space: each distinct word of WORDS_APART is merged once. Nothing for large texts and
    for words that their ids do not spell."""
    whole = [b" " + text.encode() for text in texts]
    data, off = np.frombuffer(b"".join(whole), np.uint8), np.cumsum([0, *map(len, whole)])
    if not len(data) or len(data) > TOGETHER:
        return []
    begin = word_starts(data, off)
    words, which = coded([binaries(np.diff(begin, append=len(data)), data)])
    cuts, body = bytes_of(words)
    # Words of a space and another character stand apart when they are joined; those that may be white space go alone.
    second = body[np.minimum(cuts[:-1] + 1, len(body) - 1)]
    joint = (np.diff(cuts) > 1) & (body[cuts[:-1]] == 32) & (second > 32) & ~np.isin(second, [0xC2, 0xE1, 0xE2, 0xE3])
    order = np.concatenate([np.flatnonzero(joint), np.flatnonzero(~joint)])
    listed = words.take(pa.array(order))
    cuts, body = bytes_of(listed)
    n, raw = int(joint.sum()), body.tobytes()
    parts = [plain.encode_ordinary(raw[: cuts[n]].decode()), *(plain.encode_ordinary(w.decode()) for w in listed.slice(n).to_pylist())]
    ids = np.array(list(chain.from_iterable(parts)), np.uint32)
    ends = np.concatenate([[0], np.cumsum(size[ids])])
    first = np.searchsorted(ends, cuts)
    if plain.decode_bytes(ids.tolist()) != raw or not np.array_equal(ends[first], cuts):
        return []
    start, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    start[order], count[order] = first[:-1], np.diff(first)
    own = spread(start[which], count[which], ids)
    at = np.concatenate([[0], np.cumsum(count[which])])[np.searchsorted(begin, off)].tolist()
    return [(own[i:j], x) for i, j, x in zip(at, at[1:], whole, strict=False)]


class Segments(dict):
    """The ids of segments, each some spaces and what follows up to the next space. `odd` holds those whose ids do not spell
    them, with the bytes that they spell."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], lone: int, pieces: list[bytes]) -> None:
        self.encode, self.lone, self.pieces, self.held = encode, lone, pieces, 0
        self.odd: dict[str, bytes] = {}
        self.size = np.array([len(p) for p in pieces], np.int64)

    def ids_of(self, segments: list[str]) -> list[bytes]:
        found = list(map(self.get, segments))
        if None in found:
            new = [i for i, ids in enumerate(found) if ids is None]
            self.learn(list({segments[i] for i in new}))
            for i in new:
                found[i] = self[segments[i]]
        return found

    def forget(self) -> None:
        if self.held > SEGMENT_BYTES:
            self.clear()
            self.odd.clear()
            self.held = 0

    def learn(self, new: list[str]) -> None:
        lists = self.encode([s[1:] for s in new])
        lists = [[self.lone] if s == " " else ids for s, ids in zip(new, lists, strict=True)]  # the model puts the first space itself, but not before nothing
        every = list(chain.from_iterable(lists))
        raw, spelled = array("I", every).tobytes(), b"".join(map(self.pieces.__getitem__, every))
        cuts = np.concatenate([[0], np.cumsum([len(ids) for ids in lists])]).astype(int)
        at = (4 * cuts).tolist()
        self.update(zip(new, [raw[i:j] for i, j in zip(at, at[1:], strict=False)], strict=True))
        self.held += 250 * len(new) + len(raw)
        ends, own = np.concatenate([[0], np.cumsum(self.size[every])])[cuts], "".join(new)
        if not (own.isascii() and spelled == own.encode() and (np.diff(ends) == [len(s) for s in new]).all()):
            for s, i, j in zip(new, ends.tolist(), ends[1:].tolist(), strict=False):
                if spelled[i:j] != s.encode():
                    self.odd[s] = spelled[i:j]


def sentence_pieces(path: str) -> Vocabulary:
    """A sentencepiece BPE model, which puts the space before a text itself. Where no piece goes on after a space that follows
    something else, merges end before spaces and a text's ids are those of its segments, most of which are known already."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    apart = not any(re.search("[^▁]▁", n) for n in names)
    known = Segments(lambda texts: model.encode(texts, num_threads=1), model.piece_to_id("▁"), pieces)

    def encode(text: str) -> tuple[np.ndarray, bytes]:
        if not apart or not text or "▁" in text:  # a mark in the text is a space to the model
            ids = model.encode(text)
            return np.array(ids, np.uint32), b"".join(map(pieces.__getitem__, ids))
        known.forget()
        segments = SEGMENT.findall(" " + text)
        ids = np.frombuffer(b"".join(known.ids_of(segments)), np.uint32)
        if not known.odd or known.odd.keys().isdisjoint(segments):
            return ids, (" " + text).encode()
        return ids, b"".join([known.odd[s] if s in known.odd else s.encode() for s in segments])

    return Vocabulary(encode, pieces)


LOADERS = {"byte_level": byte_level, "sentence_pieces": sentence_pieces}


class Windows(dict):
    """The place of each window by its ids; its groups, their number and its links by that place."""

    def __init__(self, a: Vocabulary, b: Vocabulary) -> None:
        self.a, self.b = a, b
        # Each id as it stands within and at the end of its side of a group.
        self.names = [f"{i}{end}" for v, ends in ((a, ",|"), (b, ",;")) for end in ends for i in range(len(v.pieces))]
        self.texts: list[str] = []
        self.groups, self.starts, self.links = array("q"), array("q", [0]), array("q")

    def places(self, keys: list[bytes]) -> list[int]:
        found = list(map(self.get, keys))
        if None in found:
            new = [i for i, place in enumerate(found) if place is None]
            self.learn(list({keys[i] for i in new}))
            for i in new:
                found[i] = self[keys[i]]
        return found

    def learn(self, new: list[bytes]) -> None:
        """Work new windows out, all at once: laid end to end, both sides have the same bytes, and each end of a token of either
        side closes one link, each end of both a group."""
        ids = np.frombuffer(b"".join(new), np.uint32)
        mark = np.flatnonzero(ids == 0xFFFFFFFF)
        size = np.array([len(k) // 4 for k in new])
        window = np.repeat(np.arange(len(new)), size)
        place = np.arange(len(ids)) - mark[window]
        a, b = ids[place < 0].astype(np.int64), ids[place > 0].astype(np.int64)
        own_a, own_b = window[place < 0], window[place > 0]
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        in_a, in_b = np.zeros(end_a[-1] + 1, bool), np.zeros(end_a[-1] + 1, bool)
        in_a[end_a], in_b[end_b] = True, True
        ends = np.flatnonzero(in_a | in_b)
        i, j = (np.cumsum(x)[ends] - x[ends] for x in (in_a, in_b))
        both = in_a & in_b
        group = np.cumsum(both) - both
        close_a, close_b = both[end_a], both[end_b]
        width_a, width_b = len(self.a.pieces), len(self.b.pieces)
        names = np.concatenate([a + width_a * close_a, 2 * width_a + b + width_b * close_b])
        order = np.argsort(np.concatenate([2 * group[end_a], 2 * group[end_b] + 1]), kind="stable")
        parts = list(map(self.names.__getitem__, names[order].tolist()))
        cuts = np.concatenate([[0], np.cumsum(size - 1)]).tolist()
        first = len(self.texts)
        self.texts += ["".join(parts[s:e])[:-1] for s, e in zip(cuts, cuts[1:], strict=False)]
        self.groups.frombytes(np.bincount(own_a[i[both[ends]]], minlength=len(new)).astype(np.int64).tobytes())
        self.starts.frombytes((len(self.links) + np.cumsum(np.bincount(own_a[i], minlength=len(new)))).astype(np.int64).tobytes())
        self.links.frombytes((a[i] << 32 | b[j]).tobytes())
        self.update(zip(new, range(first, first + len(new)), strict=True))


def window_keys(a: np.ndarray, b: np.ndarray, va: Vocabulary, vb: Vocabulary) -> list[bytes]:
    """The windows of one text by its ids (uint32): a window starts where tokens of both begin with a space at the same byte."""
    size_a, size_b = va.size[a], vb.size[b]
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    shared = np.zeros(int(start_a[-1] + size_a[-1]), np.int8)
    shared[start_a[va.marked[a]]] = 1
    shared[start_b[vb.marked[b]]] += 1
    shared[0] = 2
    at_a, at_b = np.flatnonzero(shared[start_a] == 2), np.flatnonzero(shared[start_b] == 2)
    cut_a, cut_b = ((at * 4).tolist() for at in (at_a, at_b))
    raw_a, raw_b = a.tobytes(), b.tobytes()
    return [raw_a[s:e] + MARK + raw_b[t:u] for s, e, t, u in zip(cut_a, [*cut_a[1:], len(raw_a)], cut_b, [*cut_b[1:], len(raw_b)], strict=True)]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


class _Block:
    """The texts of one block and the windows that they hold."""

    def __init__(self, windows: Windows) -> None:
        self.windows, self.bytes, self.ids = windows, 0, []
        self.rows: list[tuple[int, int, str]] = []
        self.found: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ids: pa.Array, texts: list[str], firsts: list[tuple[np.ndarray, bytes]]) -> None:
        """Texts with what `a` makes of them."""
        w, read, keys = self.windows, [], []
        self.ids.append(ids)
        for text, (a, first), (b, second) in zip(texts, firsts, w.b.together(texts), strict=True):
            self.bytes += len(text)
            whole = b" " + text.encode()
            own = window_keys(a, b, w.a, w.b) if text and first == whole and second == whole else []
            read.append((len(a), len(b), len(own)))
            keys += own
        places, at = w.places(keys), 0  # new windows of all these texts are worked out together
        for n_a, n_b, n in read:
            own = places[at : at + n]
            at += n
            found, times = np.unique(np.array(own, np.int64), return_counts=True)
            self.rows.append((n_a, n_b, hashlib.sha256(";".join(map(w.texts.__getitem__, own)).encode()).hexdigest()) if n else (0, 0, ""))
            self.found.append(found.astype(np.int32))
            self.times.append(times.astype(np.int32))

    def batch(self, block: int) -> pa.RecordBatch:
        """(block, body, codes, counts): the texts' rows and windows, and the distinct pairs with their links in this block."""
        w = self.windows
        starts, links, groups = (np.array(x, np.int64) for x in (w.starts, w.links, w.groups))  # copies: these grow on
        found, where = np.unique(np.concatenate(self.found), return_inverse=True)
        each = np.concatenate(self.times)
        times = np.bincount(where, each, len(found)).astype(np.int64)
        size = starts[found + 1] - starts[found]
        text = np.concatenate([[0], np.cumsum([len(f) for f in self.found])])
        n_groups, n_links = _sums(each * groups[found][where], text), _sums(each * size[where], text)
        inner = np.concatenate([[0], np.cumsum(size)])
        own = links[np.arange(inner[-1]) + np.repeat(starts[found] - inner[:-1], size)]
        codes, pair = np.unique(own, return_inverse=True)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, pair, np.repeat(times, size))
        n_a, n_b, shas = (pa.array(c) for c in zip(*self.rows, strict=True))
        cols = [pa.chunked_array(self.ids).combine_chunks(), n_a, n_b, pa.array(n_groups), pa.array(n_links), shas]
        sink = pa.BufferOutputStream()
        table = pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(table)
        body = packed(np.diff(text).astype(np.int32), where.astype(np.int32), each, size.astype(np.int32), pair.astype(np.int32))
        rows = sink.getvalue().to_pybytes()
        long = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([rows], pa.binary()), pa.array([body], pa.binary()), pa.array([codes], long), pa.array([counts], long)], names=["block", "rows", "body", "codes", "counts"])


def _blocks(docs: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, kept = TaskContext.get().partitionId() << 32, held("alignment")
        for kind, path in (a, b):
            if path not in kept:
                kept[path] = LOADERS[kind](path)
        if kept.get("of") != (a, b):
            kept["of"], kept["windows"] = (a, b), Windows(kept[a[1]], kept[b[1]])
        block = _Block(kept["windows"])
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            firsts = kept[a[1]].together(texts)
            for at in range(0, batch.num_rows, 64):
                block.add(batch.column(0).slice(at, 64), texts[at : at + 64], firsts[at : at + 64])
                if block.bytes >= BLOCK:
                    yield block.batch(number)
                    number += 1
                    if len(kept["windows"]) > REMEMBERED:
                        kept["windows"] = Windows(kept[a[1]], kept[b[1]])
                    block = _Block(kept["windows"])
        if block.rows:
            yield block.batch(number)
            if len(kept["windows"]) > REMEMBERED:
                kept["windows"] = Windows(kept[a[1]], kept[b[1]])

    return mapped(docs, run, "block long, rows binary, body binary, codes array<long>, counts array<long>")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's texts with the totals of their links; rows come by block, the texts first and then its pairs in order."""
    rows = body = None
    n, best = [], []

    def out() -> pa.RecordBatch:
        held_, where, times, size, pair = unpacked(body)
        table = pa.ipc.open_stream(rows).read_all().combine_chunks()
        window = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        text = np.concatenate([[0], np.cumsum(held_, dtype=np.int64)])
        sums = [_sums(times * _sums(np.concatenate(x)[pair] if len(pair) else np.zeros(0, np.int64), window)[where], text) for x in (n, best)]
        cols = [table.column(c).combine_chunks() if isinstance(table.column(c), pa.ChunkedArray) else table.column(c) for c in table.column_names]
        return pa.RecordBatch.from_arrays([*cols[:5], pa.array(sums[1]), pa.array(sums[0]), cols[5]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    for batch in batches:
        code = batch.column(0).to_numpy()
        at = 0
        for start in [*np.flatnonzero(code == BODY).tolist(), len(code)]:
            if start > at:
                n.append(batch.column(1).slice(at, start - at).to_numpy())
                best.append(batch.column(2).slice(at, start - at).to_numpy())
            if start < len(code):
                if rows is not None:
                    yield out()
                rows, body, n, best = batch.column(3)[start].as_py(), batch.column(4)[start].as_py(), [], []
            at = start + 1
    if rows is not None:
        yield out()


def aligned(docs: DataFrame, a: tuple[str, str], b: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables. Texts: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs. Pairs: a_id,
    b_id, n and best (no other id of `a` is linked with b_id more often).

    `a` and `b` are (loader, path). A text that is null or empty, or whose tokens do not spell it after a space, has no
    tokens and zeros. Repeated rows give repeated rows and count each; other columns are ignored; an empty table gives
    empty tables.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    made = written(_blocks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), a, b), "blocks")
    asked = made.select("block", F.explode(F.arrays_zip("codes", "counts")).alias("p")).select("block", F.col("p.codes").alias("code"), F.col("p.counts").alias("c"))
    pairs = written(asked.groupBy("code").agg(F.sum("c").alias("n")), "pairs").withColumn("b_id", F.col("code").bitwiseAND(0xFFFFFFFF))
    most = pairs.groupBy("b_id").agg(F.max("n").alias("most"))
    judged = pairs.join(most, "b_id").select("code", "n", (F.col("n") == F.col("most")).alias("best"), F.shiftright("code", 32).alias("a_id"), "b_id")
    answers = asked.select("block", "code").join(judged.select("code", "n", F.col("best").cast("long").alias("best")), "code")
    none = F.lit(None)
    both = answers.select("block", "code", "n", "best", none.cast("binary").alias("rows"), none.cast("binary").alias("body")).unionByName(
        made.select("block", F.lit(BODY).cast("long").alias("code"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("best"), "rows", "body"))
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    dealt = both.repartition("block").sortWithinPartitions("block", "code").drop("block")
    return mapped(dealt, _told, schema), judged.select("a_id", "b_id", "n", "best")


def given() -> tuple[tuple[str, str], tuple[str, str]]:
    import public_tokenizers

    return ("byte_level", public_tokenizers.path("byte_bpe_50k.json")), ("sentence_pieces", public_tokenizers.path("piece_bpe_32k.model"))


def op12_alignment(spark, sf_dir):
    return aligned(documents(spark, sf_dir), *given())[0]


SQL: dict[str, str] = {}
