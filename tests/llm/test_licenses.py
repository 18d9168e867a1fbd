import random
import re

from cohortloom.llm import license_scan
from cohortloom.llm.license_scan import NOTICES, PHRASES

from . import brute

SCHEMA = "doc_id long, text string, label string, spans int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def least_edits(notice, words):
    """Fewest edits of bytes between the notice and any part of the words."""
    row = [0] * (len(words) + 1)
    for i, c in enumerate(notice, 1):
        new = [i]
        for j, d in enumerate(words, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute_row(text):
    words = WORD.findall(brute.ascii_lower(text or ""))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base = sorted({x[1] for x in found})
    near = {k: e for k, n in NOTICES.items() if (e := least_edits(n.encode(), " ".join(words).encode())) <= len(n) // 10}
    score = 1.0 if base else max([1 - e / len(NOTICES[k]) for k, e in near.items()], default=0.0)
    return len(words), len(found), min(found)[0] if found else None, max(found)[0] if found else None, base, sorted({*base, *near}), score


def mutated(r, text):
    out = list(text)
    for _ in range(r.randrange(9)):
        at = r.randrange(len(out))
        out[at : at + r.randrange(2)] = r.choice(["", "x", " ", "E", "-", "é", "\n"])
    return "".join(out)


def rows():
    r = random.Random(4)
    given = [None, "", "license", "MIT License", "The MIT-License; gnu  General\nPublic license, and CC BY-NC. cc by cc by", "mit licenses", "commit license", "ÉMIT License", "mit licenseÉ", "all rights reserved" * 3]
    for _ in range(250):
        near = [mutated(r, r.choice([*NOTICES.values(), *PHRASES])) for _ in range(r.randrange(1, 3))]
        given.append(" ".join([r.choice(["", "Some é words;", "x"]), *near, r.choice(["", "and more", "license"])]))
    return [(i, t) for i, t in enumerate(given)] + [(3, "MIT License"), (None, "mit licence released under the mit licence")]


def test_scan_is_brute_force(spark):
    given = rows()
    got = license_scan.licenses(spark.createDataFrame([(*r, "x", 1) for r in given], SCHEMA)).collect()
    key = lambda x: repr(x)
    mine = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got]
    want = [(d, *(round(x, 9) if isinstance(x, float) else x for x in brute_row(t))) for d, t in given]
    assert sorted(mine, key=key) == sorted(want, key=key)
    assert sum(len(r.labels) > len(r.base_labels) for r in got) > 60
    texts = {}
    for d, t in given:
        texts.setdefault(d, t)
    for r in got:
        for s in r.spans:  # a span holds its notice within the edits that it tells
            words = " ".join(WORD.findall(brute.ascii_lower(texts[r.doc_id][s.start : s.stop])))
            assert least_edits(NOTICES[s.label].encode(), words.encode()) <= s.edits <= len(NOTICES[s.label]) // 10


def test_every_place_is_found(spark):
    """Notices that recur in a long text, over several chunks of rows; places of one notice do not overlap."""
    text = "lorem ipsum. Released under the MIT Licence! " * 40_000
    got = license_scan.licenses(spark.createDataFrame([(1, text, "", 0), (2, "x", "", 0)], SCHEMA)).orderBy("doc_id").collect()
    assert len(got[0].spans) == 40_000 and got[1].spans == [] and got[0].n_words == 280_000
    for s in got[0].spans[:: 4_000]:
        assert text[s.start : s.stop] == "Released under the MIT Licence" and s.edits == 1
    assert license_scan.licenses(spark.createDataFrame([], SCHEMA)).count() == 0
