"""Tokenizers, fingerprints, windows and the pipeline against the libraries and plain Python."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from ampliskew.llm import components, contamination, pieces, simhash, token_files
from ampliskew.llm.common import table

from test_near_copies import brute_least

SF = "/root/testdata/sf0.001"
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  a", "a  b ", " \n\n x", "\t<s> </s> <unk> <0x0A>", "a b ﬁ", " ▁ a", "\n", "a\n", "\na", "a \n b", "x" * 3000, "é日本語 😀 \x00 q", "a\n\nb", "▁", "▁\n▁", "\n ", "▁▁x\n▁y", "x <|endoftext|> y", "it's a don't", "1 2,3 4.", "a\tb", "a b", "a b", "a b"]


def texts(n=60):
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT {n}").fetchall()]


def test_pieces_equal_the_library(docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = list(enumerate(ODD + texts())) + [(None, "null id")]
    got = pieces.piece_tokens(docs(rows), PIECES).collect()
    want = [(i, lib.encode(t or ""), lib.decode(lib.encode(t or ""))) for i, t in rows]
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    digest = {r.doc_id: r for r in pieces.piece_digests(pieces.piece_tokens(docs(rows), PIECES)).collect()}
    for i, ids, back in want:
        assert (digest[i].n_tokens, digest[i].ids_sha256, digest[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert pieces.piece_tokens(docs([]), PIECES).count() == 0


def test_agenda_in_both_forms():
    enc, r = pieces.MergeEncoder(PIECES), random.Random(4)
    for n in (1, 5, pieces.SHORT, pieces.SHORT + 1, 4000):
        t = "".join(r.choice("abcdehtion,éß日") for _ in range(n))
        assert enc.agenda(pieces.SPACE + t) == enc.lib.encode(t)


def test_token_files(spark, docs):
    lib = Tokenizer.from_file(BYTES)
    rows = [(100 - i, t) for i, t in enumerate(ODD + texts())] + [(None, "null id"), (50, "same id")]
    folder = token_files.token_files(docs(rows), BYTES, partition_bytes=40_000)
    got = [tuple(r) for r in token_files.read_token_files(spark, folder).orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    start = 0
    for g in got:
        assert g[1] == start and 4 * g[2] == len(g[3])
        start += g[2]
    want = sorted((i, tuple(lib.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows if i is not None)
    assert sorted((g[0], tuple(np.frombuffer(g[3], "<u4").tolist())) for g in got if g[0] is not None) == want
    crc = {r.start: r.ids_crc32 for r in token_files.token_digests(token_files.read_token_files(spark, folder)).collect()}
    assert all(crc[g[1]] == zlib.crc32(g[3]) for g in got)
    assert token_files.read_token_files(spark, token_files.token_files(docs([]), BYTES)).count() == 0


def test_variable_length_coding():
    r = np.random.default_rng(7)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        x = (r.integers(0, 2**32, n, dtype="u8") >> r.integers(0, 32, n, dtype="u8")).astype("u4")
        assert (token_files.unpacked(*token_files.packed(x), n) == x).all()
    with pytest.raises(ValueError):
        list(token_files.blocks(memoryview(b"\0" * 100)))


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[root(a)] = root(b)
    return [root(i) for i in range(len(prints))]


def test_near_duplicates(docs):
    rows = list(enumerate(texts(150))) + [(900, None), (901, ""), (902, "One two"), (903, "one  TWO"), (None, "one two"), (5, "x" * 50000)]
    rows += [(1000 + i, t + " end" * (i % 2)) for i, t in rows[:40]]
    prints = [brute_print(t) for _, t in rows]
    root = groups(prints)
    least = {g: min((i for (i, _), h in zip(rows, root) if h == g and i is not None), default=None) for g in root}
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs(rows)).collect()), key=repr)
    assert got == sorted(((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, root)), key=repr)
    kept = simhash.one_of_each(docs(rows))
    assert kept.count() == len(set(root)) and kept.columns == docs(rows).columns
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.one_of_each(docs([])).count() == 0


def test_links_connect_all_pairs_within_radius(spark):
    """A dense cloud of values and many shards: the forest joins exactly what pairs within the radius join."""
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(30)]
    values = {v ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) & (2**64 - 1) for v in base for _ in range(20)}
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).view("i8")),) for v in values], "fingerprint long")
    edges = simhash.links(df)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in map(tuple, edges.collect()))
    label = {r.node: r.component for r in components.components(edges).collect()}
    root = groups(values)
    signed = [int(np.uint64(v).view("i8")) for v in values]
    mine = [label.get(s, s) for s in signed]
    assert len(set(zip(mine, root))) == len(set(mine)) == len(set(root))


def test_components_of_a_long_path(spark):
    df = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components.components(df.union(df.selectExpr("b", "b"))).collect()} == {0}
    assert components.components(df.limit(0)).count() == 0


def test_contamination(spark, docs):
    w = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(w)), (10, "Short ITEM"), (2, None), (3, "..."), (4, " ".join(w[20:]))], "item_id long, text string")
    rows = [(1, "x y " + ", ".join(w[3:20]).upper() + " z"), (2, " ".join(w[:12])), (3, None), (4, ""), (5, "a short-item b"), (6, "pad " * 500 + "short item"), (None, " ".join(w[20:33])), (1, "clean"), (7, "!a " + " ".join(w[:13]) + "; b c")]
    got = sorted((tuple(r)[:6] for r in contamination.contamination(docs(rows), items).collect()), key=repr)
    sha = lambda *i: hashlib.sha256(",".join(i).encode()).hexdigest()
    want = [(1, 20, 17, 1, sha("1"), True), (2, 12, 0, 0, sha(), False), (3, 0, 0, 0, sha(), False), (4, 0, 0, 0, sha(), False), (5, 4, 2, 1, sha("10"), True), (6, 502, 2, 1, sha("10"), False), (None, 13, 13, 2, sha("1", "4"), True), (1, 1, 0, 0, sha(), False), (7, 16, 13, 1, sha("1"), True)]
    assert got == sorted(want, key=repr)
    kept = contamination.decontaminate(docs(rows), items)
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for t in (rows[1][1], None, "", rows[5][1], "clean")) and kept.columns == docs(rows).columns
    cut = {r.text for r in contamination.decontaminate(docs(rows), items, "spans").collect()}
    assert {"x y z", "a b", "!a b c", "clean", rows[5][1]} <= cut
    assert contamination.contamination(docs(rows), items.limit(0)).where("contaminated").count() == 0 and contamination.contamination(docs([]), items).count() == 0
    limit, contamination.BROADCAST_WINDOWS = contamination.BROADCAST_WINDOWS, -1
    try:
        assert sorted((tuple(r)[:6] for r in contamination.contamination(docs(rows), items).collect()), key=repr) == got
    finally:
        contamination.BROADCAST_WINDOWS = limit


@pytest.mark.parametrize("name", ["op2_url_filter", "op4_decontamination", "op5_license_scan", "op8_line_dedup", "op9_warc", "op11_spelling_variants", "op12_ngram_join", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline(spark):
    """Each stage against its rule in plain Python, on the rows it was given."""
    docs = table(spark, SF, "documents")
    benchmark = table(spark, SF, "benchmark")
    rows = {r.doc_id: r for r in docs.collect()}
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == corpus_pipeline.STAGES[-1][0]:
            break
        assert out.columns == docs.columns
        path = f"{spark.conf.get('spark.checkpoint.dir', 'file:/tmp')}/test-{random.getrandbits(60):x}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        steps.append({r.doc_id: r for r in docs.collect()})
        assert all(r.n_chars == len(r.text) for r in steps[-1].values())
    quality, lined, single, clean = steps
    assert set(quality) < set(rows) and all(len(r.text.split()) >= 50 for r in quality.values()) and set(lined) == set(quality)
    assert sum(r.n_chars for r in lined.values()) <= sum(r.n_chars for r in quality.values())
    assert set(single) == {i for i, least in zip(sorted(lined), brute_least([(i, lined[i].text) for i in sorted(lined)])) if i == least} < set(lined)
    bad = {r.doc_id for r in contamination.contamination(spark.createDataFrame(list(single.values())), benchmark).where("contaminated").collect()}
    assert set(clean) == set(single) - bad
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert {(r.doc_id, r.n_tokens) for r in out.collect()} == {(i, len(lib.encode(r.text))) for i, r in clean.items()}
