"""Packed k-mers against plain Python."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ampliskew.functions.words import Rolled, spelled
from ampliskew.operators import kmers as km

SEQS = [None, "", "A", "ACGT", "ACGTN", "NNNN", "GGGGGGGGGG", "ACGT" * 20 + "N" + "TTTT" * 5, "acgT", "ACRYGT", "C" * 30, "T" * 31, "ACGTRN" * 12]


def brute(ks, w=30):
    """(place, scope, k, word) to its count."""
    out = Counter()
    for i, s in enumerate(SEQS):
        for scope, text in (("all", s), ("head", (s or "")[:w]), ("tail", (s or "")[-w:])):
            for k in ks:
                for a in range(len(text or "") - k + 1):
                    if "N" not in text[a:a + k]:
                        out[i, scope, k, text[a:a + k]] += 1
    return out


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(list(enumerate(SEQS)), "seq_id int, sequence string").withColumn("n", F.lit(1))


def test_long_words_equal_slices(catalog):
    got = {(r.seq_id, r.scope, r.k, r.kmer): r.n for r in km.kmers_long(catalog).collect()}
    assert got == dict(brute(range(1, 9))) and km.kmers_long(catalog.limit(0)).count() == 0
    few = {(r.seq_id, r.scope, r.k, r.kmer): r.n for r in km.kmers_long(catalog, (5, 2), ["tail"], w=7).collect()}
    assert few == {k: n for k, n in brute((2, 5), 7).items() if k[1] == "tail"}


def test_table_equals_counted_rows(catalog):
    columns = ["scope", "k", "kmer", "df", "total_count"]
    rows = lambda d: sorted(map(tuple, d.select(columns).collect()))
    assert rows(km.kmer_table(catalog)) == rows(km.kmer_df(km.kmers_long(catalog))) == rows(km.kmer_table(catalog.repartition(5)))
    assert km.kmer_table(catalog.limit(0)).count() == 0


def test_slices_of_batches_and_nulls_with_bytes():
    whole = pa.array(SEQS)
    for a in (1, 4, 12):
        owner, word, n, odd = Rolled(whole.slice(a)).counted(3, "all")
        assert sum(n) + sum(odd.values()) == sum(v for (i, s, k, _), v in brute([3]).items() if i >= a and s == "all")
    hidden = pa.StringArray.from_buffers(2, pa.py_buffer(np.asarray([0, 4, 8], "i4")), pa.py_buffer(b"ACGTCCCC"), pa.py_buffer(b"\x02"))
    owner, word, n, odd = Rolled(hidden).counted(4, "all")
    assert owner.tolist() == [1] and spelled(4)[int(word[0])].as_py() == "CCCC"


@pytest.mark.parametrize("pairs", [2000, 3])
def test_sample_sums_equal_joined_words(spark, catalog, monkeypatch, pairs):
    monkeypatch.setattr(km, "PAIRS", pairs)
    ab = spark.createDataFrame([(s, i, i * 7 % 5 + 1) for i in range(len(SEQS)) for s in ("a", "b", "c") if (i + ord(s)) % 3] + [("none", 0, 4)], "sample_id string, seq_id int, count long")
    totals = ab.groupBy("sample_id").agg(F.sum("count").alias("total"))
    vocab = km.select_vocab(km.kmer_table(catalog), 1, 50)
    plain = vocab.where(~F.col("kmer").rlike("[^ACGT]"))
    rows = lambda d: sorted(map(tuple, d.select("sample_id", "scope", "k", "kmer", "sum_count", "norm_per_read").collect()))
    for v in (plain, vocab, plain.limit(0)):
        assert rows(km.sample_kmer_sums(ab, catalog, v, totals)) == rows(km.sample_kmer_norm(ab, km.kmers_long(catalog), v, totals))
