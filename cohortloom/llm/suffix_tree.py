"""Language-model scoring with a probabilistic suffix tree.

Symbols are a text's words (A-Z lower-cased) and one end; a context is any run of symbols before one, from a start mark on.
The root is the add-one unigram distribution. A context of d symbols is retained when the one of d - 1 symbols that it
ends with is, when it occurs twice or more in training and when its next-symbol distribution diverges from that shorter
context's: the training symbols after it gain `gain` nats or more. Its distribution takes `discount` off each count of two
or more, drops single counts and gives what is left to the shorter context's, so each adds up to one. A symbol is scored
by the longest retained context before it. Nothing bounds the depth but that no longer context is retained.

The tree is never gathered. Texts are cut into blocks. For each depth a block sends fingerprints of its distinct n-grams
with their counts, and sums over its occurrences of each context, to the places that their fingerprints name; a place adds
up what all blocks sent and answers each with the total counts and with which contexts stay. Every n-gram comes once from
a block, so no place is hot, and only n-grams whose shorter ones recur are sent. What is sent follows from a block's texts
and state and goes straight into the shuffle; only texts, states and answers are written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._pack import packed, unpacked
from ._util import documents, dropped, mapped, scratch_path, written

GAIN, DISCOUNT = 10.0, 0.75
BLOCK, PLACE = 6 << 20, 6 << 20  # bytes of text of a block and, on average, of a place
START, END = np.uint64(0x5B1D7A3C9E84F2), np.uint64(0x9E3779B97F4A7C)  # fingerprints of the start mark and the end
STEP = np.uint64(0xA0761D6478BD642F)
UNUSED = np.uint64(8)  # fingerprints of n-grams keep 56 bits
STATE, TEXTS = 0, 2
FEW = 16  # a block whose open positions are fewer than one in so many symbols looks at these only
ROWS = "kind byte, block long, n long, blob binary, more binary"
QUESTIONS = "block long, place long, n long, blob binary, more binary"


def training(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def _sums(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys and each weight's sums."""
    names, where = np.unique(keys, return_inverse=True)
    return names, [np.bincount(where, w, len(names)) for w in weights]


class _Block:
    """One block's symbols, which stay the same, and what is known of them so far."""

    def __init__(self, fixed: list[np.ndarray], rows: bytes, state: list[np.ndarray] | None = None) -> None:
        words, self.symbols, self.size = fixed
        self.words = np.cumsum(words, dtype=np.uint64)  # fingerprints at first, then names
        self.rows = rows
        if state is None:
            none, zero = np.zeros(0, np.int64), np.zeros(len(self.size))
            state = [np.array([0]), none, none, zero, zero, np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, bool)]
        self.level, self.count, self.known, self.base, self.score, at, self.p, self.c, self.asked = state
        self.at = np.cumsum(at, dtype=np.int32)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)

    def load(self) -> None:
        """What the symbols' rows tell, for each symbol, or where few are left (from the second level on), when it is asked for."""
        self.learns = pa.ipc.open_stream(self.rows).read_all().column("train").fill_null(False).to_numpy(zero_copy_only=False)
        self.row = self.mixed = None
        self.named = _text.mix(self.words, 9)
        if self.level[0] < 2 or FEW * len(self.at) >= len(self.symbols):
            self.row = np.repeat(np.arange(len(self.size)), self.size)
            self.mixed = self.named[self.symbols]

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1 if self.row is None else self.row[at]

    def place_of(self, at: np.ndarray) -> np.ndarray:
        """Symbols before these in their rows, with the start mark."""
        return at - self.first[self.row_of(at)]

    def train_of(self, at: np.ndarray) -> np.ndarray:
        return self.learns[self.row_of(at)]

    def fixed(self) -> bytes:
        return packed(np.diff(self.words, prepend=np.uint64(0)), self.symbols, self.size)

    def state(self) -> bytes:
        return packed(self.level, self.count, self.known, self.base, self.score, np.diff(self.at, prepend=np.int32(0)), self.p, self.c.astype(np.int32), self.asked)

    def prints(self, at: np.ndarray, first: int, last: int) -> np.ndarray:
        """Fingerprints of the symbols from `last` to `first` places before each position."""
        total = np.zeros(len(at), np.uint64)
        for k in range(last, first - 1, -1):
            total = total * STEP + (self.named[self.symbols[at - k]] if self.mixed is None else self.mixed[at - k])
        return _text.mix(total, 20 + last - first) >> UNUSED

    def done(self, at: np.ndarray, p: np.ndarray) -> None:
        """These positions have their last probability."""
        self.score = self.score + np.bincount(self.row_of(at), np.log10(p), len(self.size))

    def words_known(self, counts: np.ndarray, names: np.ndarray, room: float) -> None:
        """Base scores from the counts of words, whose names now stand for their fingerprints; which positions have a context
        that may stay."""
        self.count, self.words = counts.astype(np.int64), names
        self.mixed = _text.mix(names, 9)[self.symbols]
        at = np.flatnonzero(self.place_of(np.arange(len(self.symbols))) > 0)
        c = self.count[self.symbols[at]]
        p = (c + 1) / room
        self.known = np.bincount(self.row_of(at), c > 0, len(self.size)).astype(np.int64)
        self.base = np.bincount(self.row_of(at), np.log10(p), len(self.size))
        alive = self.count[self.symbols[at - 1]] >= 2
        self.done(at[~alive], p[~alive])
        self.at, self.c = at[alive].astype(np.int32), np.zeros(int(alive.sum()), np.int32)
        self.asked = c[alive] >= 2
        self.level = np.array([1])

    def probability(self, room: float) -> np.ndarray:
        """What the contexts so far give each position; while there are none it follows from the counts."""
        return self.p.astype(np.float64) if self.level[0] > 2 else (self.count[self.symbols[self.at]] + 1) / room

    def answered(self, counts: np.ndarray, size: np.ndarray, left: np.ndarray, room: float, deepest: int | None, discount: float) -> None:
        """Take the answers on the n-grams asked and on the contexts one symbol shorter (none at the first level)."""
        d = int(self.level[0])
        c = np.zeros(len(self.at), np.int64)
        if self.asked.any():
            c[self.asked] = counts[np.unique(self.prints(self.at[self.asked].astype(np.int64), 0, d), return_inverse=True)[1]]
        at, p = self.at.astype(np.int64), self.probability(room)
        if d > 1:
            where = np.unique(self.prints(at, 1, d - 1), return_inverse=True)[1] if len(at) else np.zeros(0, np.int64)
            n, left = size[where], left[where]
            kept = left >= 0
            p = np.where(kept, np.where(self.c >= 2, self.c - discount, 0.0) / np.maximum(n, 1) + left * p, p)
            before = np.full(len(self.symbols), -1, np.int64)  # of the context that is one longer, where it is known
            before[at] = self.c
            go = kept & (self.place_of(at) >= d) & (before[at - 1] != 0) & (before[at - 1] != 1)
            if deepest is not None and d > deepest:
                go[:] = False
            self.done(at[~go], p[~go])
            at, p, c = at[go], p[go], c[go]
        self.at, self.c = at.astype(np.int32), c
        self.asked = (c >= 2) & (self.place_of(at) > d)
        self.level = np.array([d + 1])
        if d > 1:
            self.p, self.count = p.astype(np.float32), np.zeros(0, np.int64)

    def questions(self, places: int, room: float, discount: float) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(place, n, n-grams, contexts) for the next exchange."""
        d, at = int(self.level[0]), self.at.astype(np.int64)
        if d == 0:
            grams, (g,) = self.words, (np.bincount(self.symbols, self.learns[self.row], len(self.words)),)
        else:
            asked = at[self.asked]
            grams, (g,) = _sums(self.prints(asked, 0, d), self.train_of(asked))
        contexts, sums = np.zeros(0, np.uint64), [np.zeros(0)] * 4
        if d > 1 and len(at):
            train = self.train_of(at)
            seen = train & (self.c >= 2)
            c, p = np.maximum(self.c, 1), self.probability(room)
            contexts, sums = _sums(self.prints(at, 1, d - 1), train, seen, np.where(seen, 1 - discount / c, 0), np.where(seen, np.log(np.maximum(c - discount, 0.1) / p), 0))
        cuts = [self._cuts(x, places) for x in (grams, contexts)]
        for place in np.union1d(*[np.flatnonzero(np.diff(x)) for x in cuts]).tolist():
            a, b = (slice(x[place], x[place + 1]) for x in cuts)
            first = packed(np.diff(grams[a], prepend=np.uint64(0)), g[a].astype(np.int32))
            second = packed(np.diff(contexts[b], prepend=np.uint64(0)), sums[0][b].astype(np.int32), sums[1][b].astype(np.int32), sums[2][b].astype(np.float32), sums[3][b].astype(np.float32))
            yield place, a.stop - a.start, first, second

    @staticmethod
    def _cuts(keys: np.ndarray, places: int) -> np.ndarray:
        """Where each place's part of sorted keys begins: places take equal stretches of the fingerprints."""
        return np.searchsorted(keys, np.array([(i << 56) // places for i in range(places)], np.uint64)).tolist() + [len(keys)]

    def asks(self, block: int, places: int, room: float, discount: float) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            place, n, first, second = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([block] * len(held)), pa.array(place), pa.array(n), pa.array(first, pa.binary()), pa.array(second, pa.binary())], names=["block", "place", "n", "blob", "more"])

        for row in self.questions(places, room, discount):
            held.append(row)
            if len(held) == 256:
                yield out()
                held = []
        if held:
            yield out()

    def kept(self, block: int) -> Iterator[pa.RecordBatch]:
        """The block's state, and its texts while they may still change."""
        if self.level[0] <= 1:
            yield _row(TEXTS, block, 0, self.fixed(), self.rows)
        yield _row(STATE, block, len(self.at), self.state(), None)


def _row(kind: int, block: int, n: int, blob: bytes, more: bytes | None) -> pa.RecordBatch:
    cols = [pa.array([kind], pa.int8()), pa.array([block]), pa.array([n]), pa.array([blob], pa.binary()), pa.array([more], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "block", "n", "blob", "more"])


def _first(docs: DataFrame) -> DataFrame:
    """The blocks of docs(doc_id, text, train)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, rows, parts, sizes, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for part in rows:
                    w.write_batch(part)
            words, symbols = np.unique(np.concatenate(parts), return_inverse=True)
            return _row(TEXTS, block, 0, packed(np.diff(words, prepend=np.uint64(0)), symbols.astype(np.int32), np.concatenate(sizes)), sink.getvalue().to_pybytes())

        for b in batches:
            for at, end, data, off in _text.chunks(b.column(1)):
                low = _text.lowered(data)
                starts, ends, row = _text.word_bounds(low, off)
                n = end - at
                size = np.bincount(row, minlength=n) + 2
                seq, head = np.empty(int(size.sum()), np.uint64), np.concatenate([[0], np.cumsum(size)])
                inner = np.ones(len(seq), bool)
                inner[head[:-1]] = inner[head[1:] - 1] = False
                seq[head[:-1]], seq[head[1:] - 1] = START, END
                seq[inner] = _text.word_hashes(low, starts, ends) >> UNUSED
                if rows and held + len(data) > BLOCK:
                    yield out()
                    block, rows, parts, sizes, held = block + 1, [], [], [], 0
                rows.append(b.slice(at, n).select(["doc_id", "train"]))
                parts.append(seq)
                sizes.append(size.astype(np.int32))
                held += len(data)
        if rows:
            yield out()

    return mapped(docs.select("doc_id", "text", "train"), run, ROWS)


def _questions(texts: DataFrame, states: DataFrame | None, places: int, room: float, discount: float) -> DataFrame:
    """What the blocks send to the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, fixed, rows, state = (batch.column(j)[i].as_py() for j in range(4))
                block = _Block(unpacked(fixed), rows, None if state is None else unpacked(state))
                block.load()
                yield from block.asks(name, places, room, discount)

    return mapped(_beside(texts, states), run, QUESTIONS)


ANSWERS = "block long, place long, n long, blob binary, more binary, total long, names long, kept long"


def _answers(questions: DataFrame, gain: float, first: bool) -> DataFrame:
    """Each place's sums: for every question the n-grams' counts and each context's size and the share left to the shorter
    context, -1 if it does not stay. At the first level each word gets a name of its own, its place in the order of
    fingerprints. total and names: the place's symbols and distinct ones, at the
    first level; kept: the contexts that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def out() -> Iterator[pa.RecordBatch]:
            grams, contexts = ([unpacked(r[i]) for r in held] for i in (2, 3))
            keys, where = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in grams]), return_inverse=True)
            c = np.bincount(where, np.concatenate([g[1] for g in grams]), len(keys)).astype(np.int64)
            own = keys != START
            stats = [int(c[own].sum()), int((c[own] > 0).sum())]
            counts, rank = c[where], (where + (now << 32)).astype(np.uint64)
            names, of = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in contexts]), return_inverse=True)
            n, seen, mass, gained = (np.bincount(of, np.concatenate([x[i] for x in contexts]), len(names)) for i in range(1, 5))
            left = 1 - mass / np.maximum(n, 1)
            gains = gained - seen * np.log(np.maximum(n, 1)) + (n - seen) * np.log(np.maximum(left, 1e-300))
            stay = (n >= 2) & (gains >= gain)
            left = np.where(stay, left, -1).astype(np.float32)[of]
            n, a, b = n.astype(np.int64)[of], 0, 0
            for i, (block, size, _, _) in enumerate(held):
                g, x = len(grams[i][0]), len(contexts[i][0])
                told = packed(counts[a : a + g], rank[a : a + g]) if first else packed(counts[a : a + g])
                cols = [block, now, size, told, packed(n[b : b + x], left[b : b + x]), *([0, 0, 0] if i else [*stats, int(stay.sum())])]
                a, b = a + g, b + x
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in cols], names=["block", "place", "n", "blob", "more", "total", "names", "kept"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and row[1] != now:
                    yield from out()
                    held = []
                now = row[1]
                held.append((row[0], row[2], row[3], row[4]))
        if held:
            yield from out()

    dealt = questions.repartition("place").sortWithinPartitions("place", "block")
    return mapped(dealt, run, ANSWERS)


def _steps(texts: DataFrame, states: DataFrame | None, answers: DataFrame, room: float, deepest: int | None, discount: float) -> DataFrame:
    """The blocks after the answers. Texts and states (from the first level on) lie in buckets by block and stay where they
    are; only answers are shuffled to them, those of a block as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, fixed, rows, state = (batch.column(j)[i].as_py() for j in range(4))
                told = sorted(batch.column(4)[i].as_py() or [], key=lambda x: x["place"])
                block = _Block(unpacked(fixed), rows, None if state is None else unpacked(state))
                block.load()
                grams, contexts = [unpacked(x["blob"]) for x in told], [unpacked(x["more"]) for x in told]
                del told
                joined = [np.concatenate(x) if x else np.zeros(0) for x in ([g[0] for g in grams], [c[0] for c in contexts], [c[1] for c in contexts])]
                if block.level[0] == 0:
                    block.words_known(joined[0], np.concatenate([g[1] for g in grams]), room)
                else:
                    block.answered(*joined, room, deepest, discount)
                del grams, contexts, joined
                yield from block.kept(name)

    told = answers.groupBy("block").agg(F.collect_list(F.struct("place", "blob", "more")).alias("told"))
    return mapped(_beside(texts, states).join(told.hint("shuffle_hash"), "block", "left"), run, ROWS)


def _beside(texts: DataFrame, states: DataFrame | None) -> DataFrame:
    """(block, fixed, rows, state): each block's texts with its state."""
    own = texts.select("block", F.col("blob").alias("fixed"), F.col("more").alias("rows"))
    if states is None:
        return own.withColumn("state", F.lit(None).cast("binary"))
    return own.join(states.select("block", F.col("blob").alias("state")).hint("shuffle_hash"), "block")


def scored(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, gain: float = GAIN, discount: float = DISCOUNT, deepest: int | None = None
) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where `train` holds. A null text is empty: its one token is the end. Without training rows both
    scores are 0, the logarithm of 1 / 1. Repeated rows give repeated rows, an empty table an empty result; other columns
    are ignored. `deepest` bounds the contexts' length if it is given.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (training(F.col(id_col)) if train is None else train).alias("train"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    places = int(max(64, size // PLACE))
    spark, kind_of = docs.sparkSession, lambda table, kind: table.filter(F.col("kind") == kind)
    buckets = int(min(50_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (4 * BLOCK))))  # fewer than a shuffle makes would be dealt anew
    names: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        """Rows written once to the shared folder, by kind and in buckets by block: a join by block moves none of them."""
        path, table = scratch_path(spark, name), f"blocks_{uuid.uuid4().hex}"
        df.write.partitionBy("kind").bucketBy(buckets, "block").format("parquet").option("path", path).saveAsTable(table)
        names.append(table)
        return spark.table(table)

    table, total, room, level, texts = kept(_first(docs), "level-0"), 0, 1.0, 0, None
    while True:
        if level < 2:  # texts stay as they are once words have names
            before, texts = texts, kind_of(table, TEXTS)
            dropped(spark, *([before] if level else []))
        states = kind_of(table, STATE) if level else None
        answers = written(_answers(_questions(texts, states, places, room, discount), gain, not level), f"answers-{level}")
        dropped(spark)  # the questions' shuffle
        if not level:
            told = answers.agg(F.sum("total").alias("n"), F.sum("names").alias("v")).first()
            total, room = told.n or 0, float((told.n or 0) + (told.v or 0) + 1)
        after = kept(_steps(texts, states, answers, room, deepest, discount), f"level-{level + 1}")
        dropped(spark, answers)
        dropped(spark, table, only=f"/kind={STATE}")
        table, level = after, level + 1
        if not (kind_of(table, STATE).agg(F.sum("n")).first()[0] or 0):
            texts = kind_of(table, TEXTS) if level == 1 else texts
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, fixed, rows, state = (batch.column(j)[i].as_py() for j in range(4))
                block, told = _Block(unpacked(fixed), rows, unpacked(state)), pa.ipc.open_stream(rows).read_all().combine_chunks()
                cols = [told.column("doc_id").combine_chunks(), told.column("train").combine_chunks(), *map(pa.array, (block.size.astype(np.int64) - 1, block.known, block.base, block.score))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    schema = f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double"
    whole = written(mapped(_beside(texts, kind_of(table, STATE)), run, schema), "scores")
    dropped(spark, texts, table)
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    held_out = ~F.coalesce("train", F.lit(False))
    return whole.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op10_suffix_tree(spark, sf_dir):
    return scored(documents(spark, sf_dir))


SQL = {}
