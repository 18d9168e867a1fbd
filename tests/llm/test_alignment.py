import hashlib
import random
from collections import Counter

import pytest

from cohortloom.llm import alignment

SCHEMA = "doc_id long, text string, block long, code string, n int"
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def tokens(text):
    """Byte ranges and ids by the libraries that the vocabularies are made for."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    if not hasattr(tokens, "a"):
        (_, a), (_, b) = alignment.given()
        tokens.a, tokens.b, tokens.bytes = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b), alignment.byte_level(a).pieces
        tokens.a.encode_special_tokens = True
        assert ByteLevel().decode([tokens.a.id_to_token(1000)]).encode() == tokens.bytes[1000]
    a = tokens.a.encode(" " + text, add_special_tokens=False).ids
    b = tokens.b.encode(text)
    bytes_a = [tokens.bytes[i] for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if tokens.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [tokens.b.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (a, bytes_a, b, bytes_b) if text and b"".join(bytes_a) == whole == b"".join(bytes_b) else None


def ranges(ids, parts):
    at, out = 0, []
    for i, p in zip(ids, parts, strict=True):
        out.append((i, at, at + len(p)))
        at += len(p)
    return out


def brute(rows):
    linked, found = Counter(), []
    for doc, text in rows:
        got = tokens(text or "")
        if got is None:
            found.append((doc, None))
            continue
        a, b = ranges(*got[:2]), ranges(*got[2:])
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, last = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(x[0]) for x in side if last <= x[1] < e) for side in (a, b)))
            last = e
        linked.update(links)
        found.append((doc, (len(a), len(b), groups, links)))
    most = {}
    for (_, y), n in linked.items():
        most[y] = max(most.get(y, 0), n)
    return [
        (d, 0, 0, 0, 0, 0, 0, "") if f is None else
        (d, f[0], f[1], len(f[2]), len(f[3]), sum(linked[p] == most[p[1]] for p in f[3]), sum(linked[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest())
        for d, f in found]


def hostile(seed, n):
    r = random.Random(seed)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "0", "9", "é", "漢", "😀", "é", "'s", "▁", "<|endoftext|>", "<s>", "​", "\x85", "the", " cat", "\x00", "　", "<0x41>", "ﬁ"]
    return ["".join(r.choice(alphabet[: r.choice([8, len(alphabet)])]) for _ in range(r.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("block", [4 << 20, 300])
def test_alignment_is_brute_force(spark, monkeypatch, block):
    """Odd rows, hostile and plain texts; one block and many, with the memory of windows emptied in between."""
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "REMEMBERED", 100 if block == 300 else 400_000)
    rows = [(1, None), (2, ""), (3, " "), (4, "one two"), (4, "one two"), (None, "one two"), (5, "The licence, and the licensee's licences."), (6, "x" * 700), (7, "unspaced漢字" * 40)]
    rows += [(10 + i, t) for i, t in enumerate(hostile(2, 300))]
    texts, pairs = alignment.aligned(spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA).repartition(3), *alignment.given())
    got = sorted((tuple(x[c] for c in NAMES) for x in texts.collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert got == want
    assert 150 < sum(bool(w[1]) for w in want) < len(want) and len({w[5] == w[4] for w in want}) == 2
    assert sum(r.n for r in pairs.collect()) == sum(w[4] for w in want)


def test_alignment_empty_and_long(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert alignment.aligned(none, *alignment.given())[0].count() == 0
    long = spark.createDataFrame([(1, "lorem ipsum dolor " * 60_000, 0, "", 0)], SCHEMA)
    got = alignment.aligned(long, *alignment.given())[0].first()
    assert got.n_links >= got.n_groups > 150_000


def test_ids_are_those_of_the_libraries():
    """tiktoken on the file's own ranks gives the ids of the tokenizers library, segments those of a whole text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    (_, a), (_, b) = alignment.given()
    whole, pieces = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
    whole.encode_special_tokens = True
    one, two = alignment.byte_level(a), alignment.sentence_pieces(b)
    for text in [*hostile(5, 2000), " ", "  ", "a ", "a  b   c ", " a", "x" * 300 + " " + "y" * 80, "\n \n  ", "a\u00a0b \u3000c"]:
        assert one.encode(text)[0].tolist() == whole.encode(" " + text, add_special_tokens=False).ids
        assert two.encode(text)[0].tolist() == pieces.encode(text), text


def test_known_segments_are_looked_up_once_and_keep_ids_only():
    """Segments whose ids spell something else keep that beside; the others keep no spelling."""
    met = []
    known = alignment.Segments(lambda texts: met.extend(texts) or [[0] * len(t) for t in texts], 1, [b"a", b" "])
    assert known.ids_of([" a", " ab", " a"]) == [bytes(4), bytes(8), bytes(4)]
    assert known.ids_of([" ab", " "]) == [bytes(8), b"\1\0\0\0"]
    assert sorted(met) == ["", "a", "ab"] and known.odd == {" a": b"a", " ab": b"aa"} and " " in known


def test_texts_together_are_as_alone():
    import time

    import numpy as np

    a, _ = alignment.given()
    v, r = alignment.LOADERS[a[0]](a[1]), random.Random(6)
    kinds = ["a", "s", "'", " ", " ", "  ", "\n", "1", "é", "Â", "日", "か", ".", "\x1c", "　", "\xa0", "😀", "the", "ll", "՘", "꟎"]
    texts = ["", *("".join(r.choice(kinds) for _ in range(r.randrange(40))) for _ in range(300))]
    alone = v.encode
    for text, (ids, spelled) in zip(texts, v.together(texts), strict=True):
        want, back = alone(text)
        assert np.array_equal(ids, want) and spelled == back
    words = "the words of many texts recur and are merged once ".split()
    texts = [" ".join(r.choices(words, k=2000)) for _ in range(300)]
    v.together(texts[:2])
    took = []
    for run in (lambda: [alone(t) for t in texts], lambda: v.together(texts)):
        began = time.process_time()
        run()
        took.append(time.process_time() - began)
    assert took[1] < took[0]
