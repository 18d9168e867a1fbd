"""Byte-level BPE encoding and decoding.

Texts are cut into blocks and split by the tokenizer's pattern. Each block sends its distinct words to the places that
their fingerprints name; there each distinct word of the corpus is folded once, by Spark higher-order functions that apply
ranked merges to its bytes against a literal rank map, and its ids go back to the blocks that asked. Blocks look their
words up, and decoding concatenates the ids' byte pieces. Only words of more than LONGEST bytes are folded in the block
that holds them, by the same rule with a heap, as the fold takes a step for each byte.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._pack import packed, unpacked
from ._util import documents, mapped

BUCKETS, LONGEST, PLACES, NONE = 8192, 64, 1 << 16, (1 << 31) - 1
BLOCK, PLACE, WINDOW = 6 << 20, 6 << 20, 1 << 20  # bytes of a block and, on average, of a place; characters looked at together
GROUP = 1 << 17  # words whose ids are laid out together
#: With this pattern words begin where kinds of characters change, so arrays of kinds tell them for many texts at once, and
#: a long text can be cut before a space that stands alone; with any other pattern a text is split as a whole.
WORDS_APART = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 bytes and their rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: maps from piece (a character for each byte) to rank, dealt by CRC-32 so that a lookup
    reads a few entries."""
    dealt: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        name = piece.decode("latin-1")
        dealt[zlib.crc32(name.encode()) % BUCKETS][name] = rank
    return F.from_json(F.lit(json.dumps(dealt)), "array<map<string,int>>")


def fold_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Add ids (array<int>) to words(word binary), in Spark expressions only.

    A word with a rank is its own id; in others each step merges the leftmost adjacent pair of least rank, so a word of n
    bytes takes n - 1 steps at most. The ranks of all pairs are kept (null beside the edges), times PLACES so that adding
    the place leaves the least of them leftmost: a step looks up those of the new part only. A null or empty word has no
    ids; a word has fewer than PLACES bytes.
    """
    def bound(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def ids(table: Column, text: Column) -> Column:
        def rank(piece: Column) -> Column:
            return F.try_element_at(F.get(table, (F.crc32(piece.cast("binary")) % BUCKETS).cast("int")), piece)

        def scaled(piece: Column) -> Column:
            return rank(piece).cast("long") * PLACES

        def joined(acc: Column, at: Column) -> Column:
            parts, seen = acc["parts"], acc["seen"]

            def put(new: Column) -> Column:
                left, right = scaled(F.concat(F.get(parts, at - 2), new)), scaled(F.concat(new, F.get(parts, at + 1)))
                return F.struct(
                    F.concat(F.slice(parts, F.lit(1), at - 1), F.array(new), F.slice(parts, at + 2, F.size(parts))).alias("parts"),
                    F.concat(F.slice(seen, F.lit(1), at - 2), F.array(left, right), F.slice(seen, at + 2, F.size(seen))).alias("seen"),
                )

            return bound(F.concat(F.get(parts, at - 1), F.get(parts, at)), put)

        def merged(acc: Column) -> Column:
            best = F.array_min(F.transform(acc["seen"], lambda r, i: r + i))
            return bound(best, lambda b: F.when(b.isNull(), acc).otherwise(bound((b % PLACES).cast("int") + 1, lambda at: joined(acc, at))))

        edge, none, steps = F.array(F.lit(None).cast("string")), F.array(F.lit(None).cast("long")), F.sequence(F.lit(1), F.length(text) - 1)
        seen = F.concat(none, F.transform(steps, lambda i: scaled(F.substring(text, i, F.lit(2)))), none)
        start = F.struct(F.concat(edge, F.split(text, ""), edge).alias("parts"), seen.alias("seen"))
        folded = F.aggregate(steps, start, lambda acc, _: merged(acc), lambda acc: F.filter(acc["parts"], lambda p: p.isNotNull()))
        return bound(rank(text), lambda own: F.when(own.isNotNull(), F.array(own)).when(F.length(text) < 2, F.array().cast("array<int>")).otherwise(F.transform(folded, rank)))

    text = F.decode(F.coalesce(F.col("word"), F.lit(b"")), "ISO-8859-1")
    return words.withColumn("ids", bound(_rank_map(ranks), lambda table: bound(text, lambda x: ids(table, x))))


def fold_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold for one word. Pairs wait in a heap, so a long word takes n log n steps."""
    if word in ranks:
        return [ranks[word]]
    if len(word) <= LONGEST:
        get, cuts = ranks.get, list(range(len(word) + 1))
        seen = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while seen:
            best = min(seen)
            if best == NONE:
                break
            i = seen.index(best)
            del cuts[i + 1], seen[i]
            if i < len(seen):
                seen[i] = get(word[cuts[i] : cuts[i + 2]], NONE)
            if i:
                seen[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], NONE)
        return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
    parts = [word[i : i + 1] for i in range(len(word))]
    import heapq

    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := ranks.get(a + b)) is not None]
    heapq.heapify(heap)
    alive: list[bytes | None] = list(parts)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if alive[i] != a or j >= len(parts) or alive[j] != b:
            continue
        alive[i], alive[j] = a + b, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else len(parts)
            if left >= 0 and right < len(parts) and (r := ranks.get(alive[left] + alive[right])) is not None:
                heapq.heappush(heap, (r, left, alive[left], alive[right]))
    return [ranks[p] for p in alive if p is not None]


@functools.cache
def _kinds() -> np.ndarray:
    """By code point, as tiktoken sees them: 0 white space, 1 letter, 2 number, 3 other."""
    import tiktoken

    kinds, every = np.full(0x110000, 3, np.uint8), "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for kind, name in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        plain = tiktoken.Encoding("kind", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        kinds[np.frombuffer(bytes(plain.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = kind
    return kinds


def word_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the words of WORDS_APART begin in the bytes of texts, which themselves begin at off[:-1]."""
    first, at = off[:-1][off[:-1] < off[1:]], None
    codes = data
    if len(data) and data.max() >= 128:
        at = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        first = np.searchsorted(at, first)
    n, kind = len(codes), _kinds().take(codes)
    head = np.zeros(n + 1, bool)
    head[first] = head[n] = True
    space, starts = kind == 0, np.ones(n, bool)
    starts[1:] = (kind[1:] != kind[:-1]) & ((codes[:-1] != 32) | space[1:])
    starts[:-1] |= space[:-1] & ~space[1:] & ~head[1:n]  # the last of a run of white space before other characters
    starts[first] = True
    quote = np.flatnonzero((codes == 39) & starts)
    quote = quote[~head[quote + 1]]
    one, two = codes.take(quote + 1), codes.take(quote + 2, mode="clip")
    short = np.isin(one, list(b"stmd"))
    more = ~head.take(quote + 2, mode="clip") & (((two == ord("e")) & np.isin(one, list(b"rv"))) | ((one == ord("l")) & (two == ord("l"))))
    for which, size in ((quote[short], 2), (quote[more & ~short], 3)):
        starts[which + 1] = False
        starts[which[which + size < n] + size] = True
    return np.flatnonzero(starts) if at is None else at[starts]


def _stretches(text: str) -> Iterator[str]:
    """The text in stretches of WINDOW characters that can be split alone: the next begins with a lone space."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        while end < len(text):
            end = text.find(" ", end)
            if end < 0 or (end + 1 < len(text) and not text[end - 1].isspace() and not text[end + 1].isspace()):
                break
            end += 1
        if end < 0:
            end = len(text)
        yield text[at:end]
        at = end


def binaries(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """Values of these sizes that lie behind one another."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def coded(parts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of arrays, as they were met, and which of them each value is."""
    found = pa.chunked_array(parts, pa.binary()).dictionary_encode().unify_dictionaries()
    if not found.num_chunks:
        return pa.array([], pa.binary()), np.zeros(0, np.int32)
    return found.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in found.chunks])


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of binary values."""
    if not len(values):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return off.astype(np.int64), np.frombuffer(values.buffers()[2] or b"", np.uint8)


class Words:
    """The words of texts. The distinct ones of LONGEST bytes at most lie in `off` and `body`, ordered by place (`cuts`)
    and then as they were met; longer ones follow in `long`. `which` tells the place of each word of the texts in these,
    `counts` the words of each text."""

    def __init__(self, texts: pa.ChunkedArray, pattern: str, places: int) -> None:
        parts, self.counts = [], np.zeros(len(texts), np.int64)
        for at, end, data, off in _text.chunks(texts):
            if pattern != WORDS_APART:
                import regex

                for row in range(end - at):
                    found = regex.findall(pattern, data[off[row] : off[row + 1]].tobytes().decode())
                    self.counts[at + row] = len(found)
                    parts.append(pa.array([w.encode() for w in found], pa.binary()))
                continue
            whole = [(data, off)]
            if end - at == 1 and len(data) > 4 * WINDOW:
                whole = ((np.frombuffer(x, np.uint8), np.array([0, len(x)])) for x in map(str.encode, _stretches(data.tobytes().decode())))
            for body, ends in whole:
                starts = word_starts(body, ends)
                self.counts[at:end] += np.diff(np.searchsorted(starts, ends))
                parts.append(binaries(np.diff(starts, append=len(body)), body))
        words, which = coded(parts)
        off, body = bytes_of(words)
        short = np.flatnonzero(np.diff(off) <= LONGEST)
        place = (_text.word_hashes(body[: off[-1]], off[short], off[short + 1]) % np.uint64(places)).astype(np.int64)
        order = short[np.argsort(place, kind="stable")]
        self.cuts = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=places))])
        self.off, self.body = bytes_of(words.take(pa.array(order)))
        late = np.flatnonzero(np.diff(off) > LONGEST)
        self.long = words.take(pa.array(late)).to_pylist()
        rank = np.zeros(len(words), np.int32)
        rank[np.concatenate([order, late])] = np.arange(len(words), dtype=np.int32)
        self.which = rank[which]

    def of(self, place: int) -> np.ndarray:
        return self.body[self.off[self.cuts[place]] : self.off[self.cuts[place + 1]]]


def _blocks(docs: DataFrame, made, schema: str) -> DataFrame:
    """made(block, rows, texts) of the blocks of docs(doc_id, text). Each scan of a table cuts the same blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for at, end, data, _ in _text.chunks(b.column(1)):
                if rows and held + len(data) > BLOCK:
                    yield from made(block, pa.Table.from_batches(rows))
                    block, rows, held = block + 1, [], 0
                rows.append(b.slice(at, end - at))
                held += len(data)
        if rows:
            yield from made(block, pa.Table.from_batches(rows))

    return mapped(docs.select("doc_id", "text"), run, schema)


def _asked(docs: DataFrame, pattern: str, places: int) -> DataFrame:
    """(place, block, words): each block's distinct words by place."""

    def made(block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        met = Words(rows.column("text"), pattern, places)
        size, some = np.diff(met.off).astype(np.uint8), np.flatnonzero(np.diff(met.cuts)).tolist()
        for i in range(0, len(some), 256):
            part = some[i : i + 256]
            blobs = [packed(size[met.cuts[p] : met.cuts[p + 1]], met.of(p)) for p in part]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([block] * len(part)), pa.array(blobs)], names=["place", "block", "words"])

    return _blocks(docs, made, "place long, block long, words binary")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each place its distinct words, one a row, then a row for each block: which of them it asked for."""
    held, now = [], None
    names = ["place", "block", "word", "asked", "check"]

    def out() -> Iterator[pa.RecordBatch]:
        asked = [(block, *unpacked(blob)) for block, blob in held]
        words, which = coded([binaries(size, body) for _, size, body in asked])
        for i in range(0, len(words), 4096):
            part = words.slice(i, 4096)
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(now, pa.int64()), n), pa.nulls(n, pa.int64()), part, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=names)
        ends = np.cumsum([0, *(len(size) for _, size, _ in asked)]).tolist()
        for i in range(0, len(asked), 64):
            part = asked[i : i + 64]
            blobs = [packed(which[a:b]) for a, b in zip(ends[i : i + 64], ends[i + 1 : i + 65], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(now, pa.int64()), len(part)), pa.array([x for x, _, _ in part], pa.int64()), pa.nulls(len(part), pa.binary()), pa.array(blobs, pa.binary()), pa.array([zlib.crc32(x) for _, _, x in part], pa.int64())], names=names)

    for batch in batches:
        for place, block, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held and place != now:
                yield from out()
                held = []
            now = place
            held.append((block, blob))
    if held:
        yield from out()


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, blob, check): the ids of the words that each block asked for, from rows in the order of _distinct."""
    size, flat, now, asking = [], [], None, False
    for batch in batches:
        place, asks = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        lens = pa.compute.list_value_length(batch.column(3)).fill_null(0).to_numpy(zero_copy_only=False)
        values, ends = batch.column(3).flatten().to_numpy(zero_copy_only=False), np.cumsum(lens)
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (asks[1:] != asks[:-1])]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(place)], strict=True):
            if not asks[a]:
                if place[a] != now or asking:
                    size, flat = [], []
                size.append(lens[a:b])
                flat.append(values[ends[a] - lens[a] : ends[b - 1]])
            else:
                if len(size) > 1:
                    size, flat = [np.concatenate(size)], [np.concatenate(flat)]
                starts, blobs = np.cumsum(size[0]) - size[0], []
                for i in range(a, b):
                    at = unpacked(batch.column(2)[i].as_py())[0]
                    n = size[0][at].astype(np.int64)
                    blobs.append(packed(n.astype(np.uint8), spread(starts[at], n, flat[0]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(0).slice(a, b - a), pa.array(blobs, pa.binary()), batch.column(4).slice(a, b - a)], names=["block", "place", "blob", "check"])
            now, asking = place[a], bool(asks[a])


def spread(starts: np.ndarray, n: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The n values of flat from each start on, behind one another."""
    return flat[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())]


def word_ids(docs: DataFrame, ranks: dict[bytes, int], pattern: str, places: int) -> DataFrame:
    """(block, place, blob, check) for the blocks of docs: every distinct word of the corpus is folded once."""
    dealt = _asked(docs, pattern, places).repartition("place").sortWithinPartitions("place", "block")
    words = mapped(dealt, _distinct, "place long, block long, word binary, asked binary, check long")
    folded = fold_words(words, ranks).select("place", "block", "asked", "ids", "check")
    return mapped(folded, _told, "block long, place long, blob binary, check long")


def encoded(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes[, ids]) for each row of docs(doc_id, text).

    A null text is empty and has no tokens. Special tokens are ordinary text. Repeated rows give repeated rows, an empty
    table an empty result; other columns are ignored. docs is read twice and must give the same rows in the same order,
    as a table does; if it does not, the job stops.
    """
    docs = docs.select("doc_id", "text")
    ranks = read_ranks(path)
    places = int(max(64, (docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // PLACE))
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def kept(block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
            w.write_table(rows.combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1]), pa.array([sink.getvalue().to_pybytes()]), pa.array([None], pa.int64())], names=["block", "place", "blob", "check"])

    def finished(rows: pa.Table, answers: list[tuple[int, bytes, int]], pieces: pa.Array) -> Iterator[pa.RecordBatch]:
        met = Words(rows.column("text"), pattern, places)
        if [p for p, _, _ in answers] != np.flatnonzero(np.diff(met.cuts)).tolist() or any(zlib.crc32(met.of(p)) != check for p, _, check in answers):
            raise ValueError("the table changed between two reads")
        told = [unpacked(blob) for _, blob, _ in answers] + [(np.array([len(x)]), np.array(x)) for x in (fold_word(w, sent.value) for w in met.long)]
        n = np.concatenate([np.zeros(0, np.int64), *(x.astype(np.int64) for x, _ in told)])
        flat, starts = np.concatenate([np.zeros(0, "<u4"), *(x.astype("<u4") for _, x in told)]), np.cumsum(n) - n
        ends, at = np.concatenate([[0], np.cumsum(met.counts)]), 0
        while at < len(met.counts):
            upto = max(at + 1, min(at + 256, int(np.searchsorted(ends, ends[at] + GROUP, "right")) - 1))
            sums, whole = [(hashlib.sha256(), hashlib.sha256()) for _ in range(upto - at)], []
            tokens, size = np.zeros(upto - at, np.int64), np.zeros(upto - at, np.int64)
            for a in range(ends[at], ends[upto], GROUP):
                which = met.which[a : min(a + GROUP, ends[upto])]
                ids = spread(starts[which], n[which], flat)
                off, back = bytes_of(pieces.take(pa.array(ids)))
                cut = np.concatenate([[0], np.cumsum(n[which])])[np.clip(ends[at : upto + 1] - a, 0, len(which))]
                for (one, two), i, j, k, m in zip(sums, cut.tolist(), cut[1:].tolist(), off[cut].tolist(), off[cut[1:]].tolist(), strict=False):
                    one.update(ids[i:j])
                    two.update(back[k:m])
                tokens, size = tokens + np.diff(cut), size + np.diff(off[cut])
                whole += [ids] * keep_ids
            hashed = [pa.array([x.hexdigest() for x in y]) for y in zip(*sums, strict=True)]
            arrays = [rows.column(0).slice(at, upto - at).combine_chunks(), pa.array(tokens), *hashed, pa.array(size)]
            if keep_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tokens)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, "<u4"), *whole]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "ids"][: len(arrays)])
            at = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = [b""] * (max(sent.value.values(), default=-1) + 1)
        for piece, i in sent.value.items():
            listed[i] = piece
        rows, answers, pieces = None, [], pa.array(listed, pa.binary())
        for batch in batches:
            for i in range(batch.num_rows):
                place, blob = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if place < 0:
                    if rows is not None:
                        yield from finished(rows, answers, pieces)
                    rows, answers = pa.ipc.open_stream(blob).read_all(), []
                else:
                    answers.append((place, blob, batch.column(3)[i].as_py()))
        if rows is not None:
            yield from finished(rows, answers, pieces)

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = _blocks(docs, kept, "block long, place long, blob binary, check long").unionByName(word_ids(docs, ranks, pattern, places))
    dealt = both.repartition("block").sortWithinPartitions("block", "place")
    return mapped(dealt, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" + (", ids array<int>" if keep_ids else ""))


def decoded(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Add text_bytes (binary) to rows(ids array<int>): the pieces of the ids, concatenated. A null has null bytes."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    hexed = F.from_json(F.lit(json.dumps([p.hex() for p in pieces])), "array<string>")
    return rows.withColumn("text_bytes", F.unhex(F.array_join(F.transform("ids", lambda i: F.get(hexed, i)), "")))


def op1_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return encoded(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


SQL: dict[str, str] = {}
