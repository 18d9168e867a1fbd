"""License scans by fuzzy short-notice search.

Texts are reduced to their words, lower-cased and one space apart. A notice of which k edits are allowed is cut into k + 1
pieces: within k edits at least one of them stands unchanged, so exact search for the pieces finds every candidate. Around
each, the regex library's bounded-error matching looks for the whole notice with at most k edits and tells where it stands
and how many edits it took. Of overlapping places of one notice the one with the fewest edits, then the first, is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._util import documents, mapped

#: Fixed phrases and labels of the base result.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices with labels of their own; one edit (a byte inserted, removed or replaced) is allowed for each ten bytes.
NOTICES = {
    "apache-notice": "licensed under the apache license version",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-notice": "licensed under cc by",
    "gpl-grant": "this program is free software you can redistribute it and or modify",
    "gpl-notice": "licensed under the gnu general public license version",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy",
    "mit-notice": "released under the mit license",
    "no-warranty": "provided as is without warranty of any kind",
    "reserved": "all rights reserved",
}
BYTES_FOR_EDIT = 10
REMEMBERED = 20_000  # stretches whose match a scan remembers
SPAN = "struct<label:string,start:long,stop:long,edits:long>"
_span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int64())])
WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
GAP, END = 32, 10


class Notice:
    def __init__(self, label: str, words: str, edits: int | None = None) -> None:
        self.label, self.text = label, words.encode()
        self.edits = len(self.text) // BYTES_FOR_EDIT if edits is None else edits
        cuts = np.linspace(0, len(self.text), self.edits + 2).astype(int).tolist()
        self.pieces = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.match = regex.compile(b"(?b)(?:" + regex.escape(self.text) + b"){e<=%d}" % self.edits)
        self.seen: dict[bytes, tuple[int, int, int] | None] = {}

    def best(self, stretch: bytes) -> tuple[int, int, int] | None:
        """(start, stop, edits) of the best match in a stretch; stretches recur, as notices are copied."""
        if stretch not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            m = self.match.search(stretch)
            self.seen[stretch] = m and (m.start(), m.end(), sum(m.fuzzy_counts))
        return self.seen[stretch]

    def found(self, words: bytes) -> list[tuple[int, int, int]]:
        """(start, stop, edits) in rows of words that end with END; places do not overlap."""
        tried, hits = set(), []
        for offset, piece in self.pieces:
            for p in places(words, piece):
                if p - offset not in tried:
                    tried.add(p - offset)
                    low, high = max(0, p - offset - self.edits), min(len(words), p - offset + len(self.text) + self.edits)
                    low = max(low, words.rfind(b"\n", low, p) + 1)
                    end = words.find(b"\n", p, high)
                    high = high if end < 0 else end
                    m = self.best(words[low:high])
                    if m:
                        hits.append((m[2], low + m[0], low + m[1]))
        return kept(hits)


def kept(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, stop, edits) of hits(edits, start, stop), best first, that overlap with none before them; sorted by place."""
    out: list[tuple[int, int, int]] = []
    group: list[tuple[int, int, int]] = []
    end = -1

    def settle() -> None:
        own: list[tuple[int, int, int]] = []
        for edits, start, stop in sorted(set(group)):
            if all(stop <= s or e <= start for s, e, _ in own):
                own.append((start, stop, edits))
        out.extend(sorted(own))

    for hit in sorted(hits, key=lambda h: h[1:]):  # hits that no chain of overlaps joins are settled apart
        if group and hit[1] >= end:
            settle()
            group = []
            end = -1
        group.append(hit)
        end = max(end, hit[2])
    settle()
    return out


def places(words: bytes, part: bytes) -> Iterator[int]:
    p = words.find(part)
    while p >= 0:
        yield p
        p = words.find(part, p + 1)


class Chunk:
    """The words of a run of rows: one space apart, each row ended by a line end."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        low, n = _text.lowered(data), len(off) - 1
        self.data, self.off, self.lead = data, off, None
        word = WORD[low]
        before = np.concatenate([[False], word[:-1]]) if len(word) else word
        full = off[:-1] < off[1:]
        before[off[:-1][full]] = False
        self.starts = np.flatnonzero(word & ~before)
        self.first = np.searchsorted(self.starts, off)
        self.at = np.flatnonzero(word | before)  # a gap keeps its first byte
        row = np.searchsorted(off, self.at, "right") - 1
        self.rows = np.searchsorted(self.at, off) + np.arange(n + 1)  # where each row begins among the words
        out = np.full(len(self.at) + n, END, np.uint8)
        out[np.arange(len(self.at)) + row] = np.where(word[self.at], low[self.at], GAP)
        self.words = out.tobytes()

    def row(self, p: int) -> int:
        return int(np.searchsorted(self.rows, p, "right")) - 1

    def word(self, p: int, row: int) -> int:
        """The number in its row of the word that begins at p."""
        return int(np.searchsorted(self.starts, self.at[p - row]) - self.first[row])

    def characters(self, p: int, q: int, row: int) -> tuple[int, int]:
        """The code points of the row that words[p:q] come from."""
        if self.lead is None:
            self.lead = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        before = int(self.lead[self.off[row]])
        return int(self.lead[self.at[p - row] + 1]) - before - 1, int(self.lead[self.at[q - 1 - row] + 1]) - before


def _scan(notices: Sequence[tuple[str, str]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = [Notice(label, text) for label, text in notices]
    phrases = [(p.encode(), label) for p, label in PHRASES.items()]
    for b in batches:
        for at, end, data, off in _text.chunks(b.column(1)):
            chunk, n = Chunk(data, off), end - at
            words = chunk.words
            base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            spans: list[list[tuple]] = [[] for _ in range(n)]
            score = [0.0] * n
            for phrase, label in phrases:
                for p in places(words, phrase):
                    after = words[p + len(phrase)]
                    if after in (GAP, END) and (p == 0 or words[p - 1] in (GAP, END)):
                        row = chunk.row(p)
                        base[row].append((chunk.word(p, row), label))
                        score[row] = 1.0
            for notice in made:
                for start, stop, edits in notice.found(words):
                    row = chunk.row(start)
                    start, stop = start + (words[start] == GAP), stop - (words[stop - 1] == GAP)
                    spans[row].append((*chunk.characters(start, stop, row), notice.label, edits))
                    score[row] = max(score[row], 1 - edits / len(notice.text))
            labels = [sorted({x[1] for x in row}) for row in base]
            more = [sorted({*own, *(s[2] for s in row)}) for own, row in zip(labels, spans, strict=True)]
            listed = [[{"label": s[2], "start": s[0], "stop": s[1], "edits": s[3]} for s in sorted(row)] for row in spans]
            cols = [
                b.column(0).slice(at, n), pa.array(np.diff(chunk.first)), pa.array([len(x) for x in base], pa.int64()), pa.array([min(x)[0] if x else None for x in base], pa.int64()),
                pa.array([max(x)[0] if x else None for x in base], pa.int64()), pa.array(labels, pa.list_(pa.string())), pa.array(more, pa.list_(pa.string())), pa.array(score, pa.float64()), pa.array(listed, pa.list_(_span))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label,
    start, stop in code points, edits) of the notices found.

    notices: label -> words, lower-case and one space apart. The score is 1 if a base phrase is found, else the best share of
    a notice's bytes that needed no edit, 0 without any. A null text is empty. Repeated rows give repeated rows, an empty
    table an empty result; other columns are ignored.
    """
    kind, listed = docs.schema[id_col].dataType.simpleString(), sorted(notices.items())
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<{SPAN}>"
    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), lambda batches: _scan(listed, batches), schema)


def op13_licenses(spark, sf_dir):
    span = lambda s: F.concat_ws(":", s["label"], s["start"], s["stop"], s["edits"])
    found = licenses(documents(spark, sf_dir))
    return found.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ","), "spans": F.array_join(F.transform("spans", span), ",")})


SQL: dict[str, str] = {}
