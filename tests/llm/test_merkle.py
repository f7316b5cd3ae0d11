"""The Merkle manifest against plain Python."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ampliskew.llm import merkle
from ampliskew.llm.common import table

SF = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    out = []
    for f in FIELDS:
        v = row[f]
        if v is not None and f == "text" and lower:
            v = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in v)
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return digest(*out)


def climb(nodes):
    """Root and, for each leaf, the list of (left, right) siblings."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, j in enumerate(at):
            a = j // 16 * 16
            paths[i].append(("".join(nodes[a:j]), "".join(nodes[j + 1:a + 16])))
            at[i] = j // 16
        nodes = [digest(*nodes[a:a + 16]) for a in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = climb([x[2] for x in by[s]])
    root, up = climb([trees[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, above in zip(sources, up):
        for (_, _, leaf, r), path in zip(by[s], trees[s][1]):
            path = path + above
            folded = leaf_of(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            for a, z in path:
                folded = digest(a, folded, z)
            out.append((r["doc_id"], leaf, trees[s][0], root, digest(*(a + z for a, z in path)), folded, folded == root))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in merkle.manifest(df)[0].collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4096, 4097, 5000])
def test_places_are_those_of_the_log(n):
    leaves = [sha256(str(i).encode()).digest() for i in range(n)]
    log, nodes, level = merkle.append_log(leaves, merkle.height(n)), leaves, 0
    while True:
        for j in {0, len(nodes) // 2, len(nodes) - 1} | set(range(min(len(nodes), 40))):
            at = merkle.place(level, j, n)
            assert log[32 * at:32 * at + 32] == nodes[j]
        if len(nodes) == 1:
            break
        nodes, level = [merkle.parent(nodes[a:a + 16]) for a in range(0, len(nodes), 16)], level + 1
    assert level == merkle.height(n) and log[-32:] == nodes[0] and merkle.place(level, 0, n) == len(log) // 32 - 1
    root, want = climb([x.hex() for x in leaves])
    for i in {0, n // 3, n - 1}:
        path = merkle.siblings(log, i, n, level)
        assert [(a.decode(), z.decode()) for a, z in zip(path[::2], path[1::2])] == want[i]
        assert merkle.fold(leaves[i], path).hex() == root


def odd_rows():
    r = random.Random(2)
    rows = [(i, f"s{r.choice('aaaaaabBé')}", "en", i, f"Text {i}") for i in range(700)]
    rows += [(i, f"only{i}", None, None, "ABC") for i in range(40)] + [(7, None, "", 1, None), (None, None, None, None, None), (None, "sa", "x", 3, ""), (3, "sa", "y", 3, "Tie"), (3, "sa", "x", 3, "Tie"), (3, "sa", "x", 3, "Tie"), (9, "", "z", -1, "Ä" * 9000)]
    return [dict(zip(FIELDS, x)) for x in rows]


@pytest.mark.parametrize("levels", [3, 1])
def test_manifest(spark, monkeypatch, levels):
    """Null ids, sources and texts, ties, repeated rows, a hot source; trees of one run and of several tiers of runs."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "RUN", 16**levels)
    rows = odd_rows()
    df = spark.createDataFrame([tuple(x[f] for f in FIELDS) for x in rows], "doc_id long, source string, lang string, n_chars long, text string")
    odd = df.withColumns({c: F.lit(1) for c in ("g", "i", "total", "digest", "leaf", "a.b c", "log")})
    got = result(odd.repartition(7))
    assert got == brute(rows) and {x[6] for x in got} == {True, False}


def test_manifest_of_the_table(spark):
    d = table(spark, SF, "documents")
    assert result(d) == brute([r.asDict() for r in d.collect()])


def test_manifest_of_nothing(spark):
    d = table(spark, SF, "documents").limit(0)
    rows, inner, outer = merkle.manifest(d)
    assert rows.collect() == [] and all(t.count() == 0 for t in inner + outer)


def test_logs_hold_every_node_once(spark):
    _, inner, outer = merkle.manifest(table(spark, SF, "documents"))
    for t in inner + outer:
        for r in t.collect():
            nodes, n = 0, r.n
            for _ in range(merkle.height(r.total) + 1):
                nodes, n = nodes + n, -(-n // 16)
            assert len(r.log) == 32 * nodes and r["first"] == 0
