import random

import numpy as np
import pytest

from cohortloom.llm import webp
from cohortloom.llm.webp import Writer


def put_code(out, lengths, symbol):
    """Canonical code of a symbol, first bit first."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return
    code = last = 0
    for n, s in used:
        code <<= n - last
        if s == symbol:
            out.put(int(format(code, f"0{n}b")[::-1], 2), n)
            return
        code, last = code + 1, n


def write_lengths(out, lengths):
    """A code as plain lengths, each in four bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        out.put(1 | 1 << 2 | used[0] << 3, 11)
        return
    out.put(0, 1)
    out.put(15, 4)
    for s in webp.LENGTH_ORDER:
        out.put(4 if s < 16 else 0, 3)
    out.put(0, 1)
    for n in lengths:
        out.put(int(format(n, "04b")[::-1], 2), 4)


def code_for(symbols, size):
    """Uneven lengths for the symbols: 1, 2, 3, ... and the last twice."""
    s = sorted(symbols)
    lengths = [0] * size
    if len(s) <= 12:
        for i, x in enumerate(s):
            lengths[x] = min(i + 1, max(1, len(s) - 1))
        return lengths
    k = (len(s) - 1).bit_length()
    long = 2 * len(s) - (1 << k)
    for i, x in enumerate(s):
        lengths[x] = k if i < long else k - 1
    return lengths


def write_pixels(out, p, width, main, cache_bits=0, references=False):
    events, cache = [], [None] * (1 << cache_bits if cache_bits else 0)
    i = 0
    while i < len(p):
        slot = (webp.CACHE_HASH * int(p[i]) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        n = 0
        if references and i >= width:
            while i + n < len(p) and n < 20 and p[i + n] == p[i + n - width]:
                n += 1
        step = 1
        if n >= 3:
            events.append(("copy", n))
            step = n
        elif cache_bits and cache[slot] == int(p[i]):
            events.append(("cache", slot))
        else:
            events.append(("pixel", int(p[i])))
        for j in range(i, i + step):
            if cache_bits:
                cache[(webp.CACHE_HASH * int(p[j]) & 0xFFFFFFFF) >> (32 - cache_bits)] = int(p[j])
        i += step
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)

    def prefix(v):
        v -= 1
        if v < 4:
            return v, 0, 0
        top = v.bit_length() - 1
        half = (v >> (top - 1)) & 1
        return 2 * top + half, top - 1, v - ((2 + half) << (top - 1))

    size = 280 + (1 << cache_bits if cache_bits else 0)
    green, red, blue, alpha, far = ({0} for _ in range(5))
    for kind, v in events:
        if kind == "pixel":
            green.add(v >> 8 & 255), red.add(v >> 16 & 255), blue.add(v & 255), alpha.add(v >> 24)
        elif kind == "copy":
            green.add(256 + prefix(v)[0]), far.add(0)
        else:
            green.add(280 + v)
    codes = [code_for(s, n) for s, n in ((green, size), (red, 256), (blue, 256), (alpha, 256), (far, 40))]
    for c in codes:
        write_lengths(out, c)
    for kind, v in events:
        if kind == "pixel":
            for c, s in zip(codes, (v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24), strict=False):
                put_code(out, c, s)
        elif kind == "copy":
            s, bits, extra = prefix(v)
            put_code(out, codes[0], 256 + s)
            out.put(extra, bits)
            put_code(out, codes[4], 0)  # distance code 1: the pixel above
        else:
            put_code(out, codes[0], 280 + v)


def file_of(width, height, transforms, p, inner, **how):
    out = Writer()
    out.put(width - 1, 14), out.put(height - 1, 14), out.put(1, 1), out.put(0, 3)
    for t in transforms:
        out.put(1, 1)
        t(out)
    out.put(0, 1)
    write_pixels(out, p, inner, True, **how)
    data = b"\x2f" + out.value.to_bytes(-(-out.n // 8) + 8, "little")
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
    return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk


def picture(width, height, seed, few=False):
    r = np.random.default_rng(seed)
    p = r.integers(0, 1 << 32, width * height, dtype=np.uint64).astype(np.uint32)
    if few:
        p = p[: 6][r.integers(0, 6, width * height)]
        p[width * 2 : width * 3] = p[width : width * 2]
    return p


def as_pixels(p, width, height):
    return np.stack([(p >> np.uint32(s)) & np.uint32(255) for s in (16, 8, 0, 24)], axis=-1).astype(np.uint8).reshape(height, width, 4)


@pytest.mark.parametrize("how", [{}, {"cache_bits": 4}, {"references": True}, {"cache_bits": 3, "references": True}])
def test_codes_cache_and_references(how):
    for few in (False, True):
        p = picture(21, 9, 1, few)
        w, h, got = webp.decode(file_of(21, 9, [], p, 21, **how))
        assert (w, h) == (21, 9) and (got == as_pixels(p, 21, 9)).all()


def test_subtract_green_and_cross_colour():
    p = picture(13, 7, 2)
    c = webp._split(p)
    g2r, g2b, r2b = 37, -20, 90
    signed = lambda a: ((a + 128) & 255) - 128
    f = c.copy()
    f[:, 1] = (c[:, 1] - (g2r * signed(c[:, 2]) >> 5)) & 255
    f[:, 3] = (c[:, 3] - (g2b * signed(c[:, 2]) >> 5) - (r2b * signed(c[:, 1]) >> 5)) & 255
    f[:, [1, 3]] = (f[:, [1, 3]] - f[:, 2:3]) & 255
    table = np.full(4 * 2, 255 << 24 | (r2b & 255) << 16 | (g2b & 255) << 8 | (g2r & 255), np.uint32)

    def cross(out):
        out.put(webp.CROSS, 2), out.put(0, 3)
        write_pixels(out, table, 4, False)

    got = webp.decode(file_of(13, 7, [cross, lambda out: out.put(webp.GREEN, 2)], webp._join(f), 13))[2]
    assert (got == as_pixels(p, 13, 7)).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    w, h = 11, 6
    p = picture(w, h, 3 + mode)
    c = webp._split(p)
    f = c.copy()
    for i in range(w * h):
        x, y = i % w, i // w
        if i == 0:
            guess = np.array([255, 0, 0, 0])
        elif y == 0:
            guess = c[i - 1]
        elif x == 0:
            guess = c[i - w]
        else:
            guess = webp.predicted(mode, c[i - 1], c[i - w], c[i - w - 1], c[i - w + 1])
        f[i] = (c[i] - guess) & 255
    modes = np.full(3 * 2, 255 << 24 | mode << 8, np.uint32)

    def predictor(out):
        out.put(webp.PREDICTOR, 2), out.put(0, 3)
        write_pixels(out, modes, 3, False)

    assert (webp.decode(file_of(w, h, [predictor], webp._join(f), w))[2] == as_pixels(p, w, h)).all()


@pytest.mark.parametrize("size", [2, 4, 6, 40])
def test_palette(size):
    w, h = 19, 5
    r = np.random.default_rng(size)
    colours = r.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)
    index = r.integers(0, size, (h, w))
    n = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
    each, bits = 1 << n, 8 >> n
    inner = -(-w >> n)
    padded = np.zeros((h, inner * each), int)
    padded[:, :w] = index
    packed = sum(padded[:, i::each] << (i * bits) for i in range(each)).reshape(-1)
    steps = webp._split(colours)
    steps[1:] = (steps[1:] - steps[:-1]) & 255

    def palette(out):
        out.put(webp.PALETTE, 2), out.put(size - 1, 8)
        write_pixels(out, webp._join(steps), size, False)

    got = webp.decode(file_of(w, h, [palette], (packed.astype(np.uint32) << np.uint32(8)) | np.uint32(255 << 24), inner))[2]
    assert (got == as_pixels(colours[index.reshape(-1)], w, h)).all()


def texts_like(seed, n):
    r = random.Random(seed)
    words = ["the", "and", "of", "in", "ation", "pre", "ing", "\n", "é", "日本"]
    return " ".join("".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(n)).encode()


def test_round_trip_of_payloads():
    """Every chain of transforms over many kinds of bytes; together the files use every tool."""
    r = random.Random(1)
    seen = set()
    payloads = [bytes(r.randrange(k) for _ in range(64 * n)) for n in (1, 3, 40) for k in (1, 2, 3, 40, 256)]
    payloads += [texts_like(seed, n) for seed in range(3) for n in (5, 60, 700)] + [texts_like(9, 300) * 5, b"| | |\n" * 900, b"ab" * (1 << 20), texts_like(7, 90_000)]
    for raw in payloads:
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        width = 16
        pixels = np.frombuffer(payload, np.uint8).reshape(-1, width, 4)
        file, tools = webp.stored(payload)
        assert webp.decode(file)[2].tobytes()[: len(payload)] == payload
        seen.update(tools)
        if len(payload) < 60_000:
            for chain in (*webp.CHAINS, (), (webp.CROSS,), (webp.PREDICTOR,), (webp.GREEN,)):
                file, tools = webp.encode(pixels, chain)
                assert webp.decode(file)[2].tobytes() == payload
                seen.update(tools)
    assert seen == {"palette", "predictor1", "predictor2", "cross", "green", "copies", "cache", "plain"}
    with pytest.raises(ValueError):
        webp.decode(b"RIFF0000WEBPVP8 " + bytes(20))


def test_fast_and_general_transforms_agree():
    """Running sums against the pixel-by-pixel predictor, and one tile against many."""
    r = np.random.default_rng(2)
    for w, h in ((16, 40), (5, 9), (1, 7), (600, 3)):
        p = r.integers(0, 1 << 32, w * h, np.uint32)
        for mode in (1, 2):
            tiles = np.full(-(-w >> 2) * -(-h >> 2), mode << 8, np.uint32)
            slow = tiles.copy()
            if len(slow) > 1:
                slow[-1] = 0  # the last tile has another mode, so all goes pixel by pixel
                got, want = webp._undo_predictor(p, w, h, 2, slow), webp._undo_predictor(p, w, h, 2, tiles)
                y = (h - 1) >> 2 << 2
                assert (got[: y * w] == want[: y * w]).all()
        one = np.array([0xFF000000 | 0x00F3117F], np.uint32)
        if w <= 16 and h <= 16:
            assert (webp._undo_cross(p, w, h, 4, one) == webp._undo_cross(p, w, h, 2, np.repeat(one, -(-w >> 2) * -(-h >> 2)))).all()


def test_codes_are_complete():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 256, 344):
        for _ in range(20):
            counts = np.zeros(400, np.int64)
            counts[r.choice(400, n, replace=False)] = np.floor(np.exp(r.uniform(0, 12, n)))
            lengths = webp.code_lengths(counts)
            assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= 10
            if n > 1:
                assert (1 << (10 - lengths[lengths > 0])).sum() == 1024


def test_media_rows(spark):
    import hashlib
    import zlib

    texts = ["", None, "é" * 33, "x" * 64, "same", "same", "long " * 30_000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, feature int")
    rows = {r.doc_id: r for r in webp.media(df, keep_file=True).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
    assert rows[4].media_sha256 == rows[5].media_sha256 and rows[4].feature == rows[5].feature
    assert webp.media(df.limit(0)).count() == 0


def test_long_payloads_become_several_images(spark):
    r = np.random.default_rng(5)
    texts = ["a" * 500, "".join(map(chr, r.integers(32, 0x500, 700))), None, "x" * 64, "y" * 128, "z" * 129]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x.doc_id: x for x in webp.media(df, keep_file=True, image_bytes=128).collect()}
    whole = {x.doc_id: x for x in webp.media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        files = webp.split_files(bytes(rows[i].media))
        assert len(files) == -(-len(payload) // 128) and rows[i].media_bytes == len(rows[i].media)
        parts = [webp.decode(f)[2].tobytes()[:128] for f in files]
        assert b"".join(parts)[: len(payload)] == payload
        assert rows[i].feature.split(";", 1)[1] == whole[i].feature.split(";", 1)[1]
        assert (rows[i].payload_sha256, rows[i].tail_crc32, rows[i].payload_bytes) == (whole[i].payload_sha256, whole[i].tail_crc32, whole[i].payload_bytes)
    assert list(webp.images(b"q" * 128)) == [webp.stored(b"q" * 128)]
    for bad in (0, 100):
        with pytest.raises(ValueError):
            list(webp.images(b"q" * 128, bad))
    with pytest.raises(ValueError):
        webp.split_files(webp.stored(b"q" * 64)[0] + b"RIFF")


def test_stretches_are_looked_for_where_fours_recur(monkeypatch):
    """Sorting the fours tells that too few recur; the search for stretches, which used to run on every image, is left out."""
    r = np.random.default_rng(4)
    lone, again = r.integers(0, 256, 64 * 50, np.uint8).tobytes(), r.integers(0, 256, 64 * 5, np.uint8).tobytes() * 10
    assert "copies" in webp.stored(again)[1]
    few = np.frombuffer(lone + lone[:32], np.uint32)
    assert 0 < sum(n for _, n, _ in webp.matches(few)) <= 4 * webp.repeats(few)
    calls = []
    monkeypatch.setattr(webp, "matches", lambda p: calls.append(len(p)) or [])
    assert webp.decode(webp.stored(lone)[0])[2].tobytes() == lone and not calls
    webp.stored(again)
    assert calls


@pytest.mark.parametrize("span", [64, 200, 1 << 18])
def test_windows_of_a_file_of_any_size(monkeypatch, span):
    monkeypatch.setattr(webp, "SPAN", span)
    r = np.random.default_rng(5)
    parts = [r.integers(0, 256, 64 * 20, np.uint8).tobytes(), b"some words and more " * 64, r.choice(np.frombuffer(b"abcd  ef", np.uint8), 6400).tobytes()]
    for payload in (*parts, b"".join(parts), b"".join(parts) * 2):
        payload = payload.ljust(-(-len(payload) // 64) * 64, b"\0")
        assert webp.decode(webp.stored(payload)[0])[2].tobytes()[: len(payload)] == payload
