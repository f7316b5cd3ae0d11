"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ampliskew.llm import spelling
from ampliskew.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_counts(rows, one_in):
    seen = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda c: c[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if one_in and h % one_in == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            seen[w] += 1
    return seen


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def brute(seen, least=6, min_n=5, times=5):
    words = {w: n for w, n in seen.items() if len(w) >= least and n >= min_n}
    out, form = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= times * n else None
        out[w] = (form[w], n, len(near), words.get(form[w]))
    for w in words:
        r = w
        while form[r]:
            r = form[r]
        f, n, near, m = out[w]
        out[w] = (w, f, r, n, near, m)
    return sorted(out.values())


def cloud(r, n):
    """Words that are near each other, of few letters and lengths."""
    base = ["".join(r.choice("abß") for _ in range(r.randint(6, 9))) for _ in range(n // 8)]
    out = set()
    for w in base:
        for _ in range(8):
            i = r.randrange(len(w))
            out.add(r.choice([w[:i] + r.choice("abß") + w[i:], w[:i] + w[i + 1:], w[:i] + r.choice("abß") + w[i + 1:]]))
    return sorted(w for w in out if len(w) >= 6)


@pytest.mark.parametrize("queries", [1024, 7])
def test_near_words(monkeypatch, queries):
    monkeypatch.setattr(spelling, "QUERIES", queries)
    r = random.Random(3)
    for n in (8, 40, 400):
        words = cloud(r, n)
        counts = np.asarray([r.randint(1, 4) for _ in words])
        place, near, best = spelling.near_words(words, counts)
        got = {words[p]: (k, words[b]) for p, k, b in zip(place, near, best)}
        want = {}
        for w in words:
            x = [v for v in words if one_edit(w, v)]
            if x:
                want[w] = (len(x), min(x, key=lambda v: (-counts[words.index(v)], v)))
        assert got == want


@pytest.mark.parametrize("shard,long", [(8192, 64), (4, 64), (4, 8), (8192, 7)])
def test_variants(spark, docs, monkeypatch, shard, long):
    """Ties, repeated rows, null and empty texts, long words; shards cut by halves and by length give the same."""
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "LONG", long)
    r = random.Random(5)
    words = cloud(r, 300)
    rows = [(1, None), (2, ""), (3, "?! 12"), (None, "Straße straße STRAßE strasse×÷ " * 3), (7, "x" * 3000 + " " + ("x" * 3000 + "y ") * 30), (7, "x" * 3000)]
    rows += [(10 + i, " ".join(f"{w}, " * r.choice([1, 5, 5, 6, 30, 160, 900]) for w in r.sample(words, 30))) for i in range(8)]
    rows += [rows[-1]] * 5 + [(4, ("x" * 3000 + " ") * 5)]
    for one_in in (0, 3):
        got = sorted(tuple(x) for x in spelling.spelling_variants(docs(rows), one_in=one_in).collect())
        assert got == brute(brute_counts(rows, one_in))
    assert len({w[2] for w in got if w[1]}) > 1 and any(w[2] != w[1] for w in got if w[1])


def test_variants_of_the_table(spark):
    d = table(spark, SF, "documents")
    rows = [(x.doc_id, x.text) for x in d.collect()]
    got = sorted(tuple(x) for x in spelling.spelling_variants(d, one_in=199).collect())
    assert got == brute(brute_counts(rows, 199)) and any(w[1] for w in got)


def test_variants_of_nothing(docs):
    assert spelling.spelling_variants(docs([])).collect() == [] and spelling.spelling_variants(docs([(1, None)])).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs([]), min_letters=5)
