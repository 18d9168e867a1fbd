import hashlib
import random

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from cohortloom.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "  a", " a  b\n\nc ", "a b", "it's  x's 'll", "a\x1cb", "\n", "a\n", "tab\tx 12é3 ½²", "don't 'S 's\n's", "<|endoftext|>", "日本 語", "a" * 5000, " ".join(["word"] * 3000)]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def theirs(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts_match_the_library(spark, ranks, theirs):
    rows = [(i, t, "clash", 1) for i, t in enumerate([*ODD, None, "dup", "dup"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = bpe.encoded(df, PATH, P.PATTERN, keep_ids=True)
    assert got.count() == len(rows)
    for r in bpe.decoded(got, ranks).collect():
        text = rows[r.doc_id][1] or ""
        ids = theirs.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.text_bytes) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encoded(df.limit(0), PATH, P.PATTERN).count() == 0


def test_folds_agree(spark, ranks, theirs):
    r = random.Random(1)
    words = ["".join(r.choice("abcdeéü ") for _ in range(r.choice([1, 2, 5, 9, 30, 200, 3000]))) for _ in range(40)]
    for w in words:
        assert bpe.fold_word(w.encode(), ranks) == theirs._encode_single_piece(w)
    short = [w for w in words if len(w) < 40]
    df = spark.createDataFrame([(w.encode(),) for w in short] + [(None,), (b"",)], "word binary")
    for row in bpe.fold_words(df, ranks).collect():
        assert row.ids == (theirs._encode_single_piece(row.word) if row.word else [])


def test_words_begin_where_the_pattern_says():
    regex, r = pytest.importorskip("regex"), random.Random(3)
    kinds = ["a", "s", "t", "re", "ve", "ll", "l", "d", "'", "'", " ", " ", "\n", "1", "½", "é", "日", ".", "\x1c", "　", "\xa0", "S", "😀", "́"]
    for _ in range(500):
        texts = ["".join(r.choice(kinds) for _ in range(r.randrange(25))).encode() for _ in range(r.randrange(1, 6))]
        off, want = np.cumsum([0, *map(len, texts)]), []
        for at, text in zip(off.tolist(), texts, strict=False):
            sizes = [len(w.encode()) for w in regex.findall(bpe.WORDS_APART, text.decode())]
            want += (at + np.cumsum([0, *sizes])[:-1]).tolist()
        assert bpe.word_starts(np.frombuffer(b"".join(texts), np.uint8), off).tolist() == want


def test_long_texts_are_cut_and_joined(ranks, theirs, monkeypatch):
    pa, r = pytest.importorskip("pyarrow"), random.Random(4)
    text = " ".join(r.choice(["the", "it's", "é\n\nx", "", "a" * 70, "12", "!?"]) for _ in range(2000))
    for window, texts in ((50, [text]), (1 << 20, [text, None, "", text[:99]])):
        monkeypatch.setattr(bpe, "WINDOW", window)
        met = bpe.Words(pa.chunked_array([texts]), bpe.WORDS_APART, 7)
        ends = met.off.tolist()
        words = [met.body[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)] + met.long
        assert met.cuts[-1] == len(ends) - 1 and all(len(w) > bpe.LONGEST for w in met.long)
        cut, at = [words[i] for i in met.which], 0
        for own, n in zip(texts, met.counts.tolist(), strict=True):
            assert b"".join(cut[at : at + n]).decode() == (own or "")
            assert [i for w in cut[at : at + n] for i in bpe.fold_word(w, ranks)] == theirs.encode_ordinary(own or "")
            at += n


def test_new_letters_are_what_the_library_takes_them_for(ranks, theirs):
    pa = pytest.importorskip("pyarrow")
    text = "".join(f"a{c}1{c}. {c}{c}b\n{c}'s" for c in map(chr, [0x558, 0x58B, 0x88F, 0xC5C, 0x208F, 0xA7CE, 0xAB6C, 0x107BB]))
    met = bpe.Words(pa.chunked_array([[text]]), bpe.WORDS_APART, 7)
    ends = met.off.tolist()
    words = [met.body[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
    assert [i for w in met.which for i in bpe.fold_word(words[w], ranks)] == theirs.encode_ordinary(text)
