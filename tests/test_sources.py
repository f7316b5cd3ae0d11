"""Readers, sinks and read filters on small files."""

import gzip

import pytest

from pyspark.sql import functions as F

from ampliskew.operators import abundance as ab
from ampliskew.operators import reads as rd
from ampliskew.sources import fastq, manifest, tables


def record(name, seq, qual=None):
    return f"@{name}\n{seq}\n+\n{qual or 'I' * len(seq)}\n"


def test_fastq_smoke(spark, tmp_path):
    (tmp_path / "H12.fastq").write_text("".join(record(f"r{i}", s) for i, s in enumerate(["ACGTACGTACGT", "acgtacgtacgt", "ACGTACGTTCGT"])))
    with gzip.open(tmp_path / "H16.fq.gz", "wt") as f:
        f.write("".join(record(f"r{i}", s) for i, s in enumerate(["TTTTCCCCAAAA", "TTTTCCCCAAAA", "GGGGAAAACCCC"])) + "@broken\nACG\n")
    with pytest.raises(Exception, match="truncated FASTQ record"):
        fastq.read_fastq(spark, str(tmp_path)).count()
    reads = fastq.read_fastq(spark, str(tmp_path), strict=False)
    d = ab.dereplicate(reads).groupBy("sample_id").agg(F.sum("count").alias("n"), F.count("*").alias("u")).orderBy("sample_id").collect()
    assert [(r.sample_id, r.n, r.u) for r in d] == [("H12", 3, 2), ("H16", 3, 2)]
    assert fastq.read_fastq(spark, str(tmp_path / "H12.fastq"), max_reads=2).count() == 2


def test_fastq_ranges_lose_nothing(spark, tmp_path):
    quals = ["@" * 30, "+" * 30, "I" * 30]
    (tmp_path / "x.fastq").write_text("".join(record(f"r{i}", "ACGTTGCAAC" * 3, quals[i % 3]) for i in range(200)))
    for size in (17, 100, 1001):
        assert fastq.read_fastq(spark, str(tmp_path / "x.fastq"), range_bytes=size).select("header").distinct().count() == 200


def test_fasta_and_table_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">id1 text\nacg\nTT\n>id2\nGGG\n")
    rows = {r.seq_id: r.sequence for r in tables.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows == {"id1": "ACGTT", "id2": "GGG"}
    d = spark.createDataFrame([("a", 1), ("b", 2)], "seq_id string, n int")
    tables.write_table(d, str(tmp_path / "t"), ["n", "seq_id"])
    assert sorted((r.n, r.seq_id) for r in tables.read_table(spark, str(tmp_path / "t")).collect()) == [("1", "a"), ("2", "b")]
    tables.write_partitioned(d, str(tmp_path / "p"), ["seq_id"])
    assert (tmp_path / "p" / "seq_id=a").exists()
    tables.write_fasta(d.withColumn("sequence", F.lit("ACG")), str(tmp_path / "f"))
    assert tables.read_fasta(spark, str(tmp_path / "f")).count() == 2


def test_ordered_files_are_sorted_by_name(spark, tmp_path):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{i * 7919 % 1000:03d}", i % 7, "" if i % 11 == 0 else f"v{i}") for i in range(1500)] + [("hot", 1, "same")] * 5
    d = spark.createDataFrame(rows, "k string, n int, v string").repartition(4)
    key = lambda r: (r[0] is not None, r[0] or "", r[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would make one file
    for most in (0, 100):
        path = tmp_path / f"o{most}"
        ranges = tables.write_ordered(d, str(path), ["k", "n"], rows_per_file=most).collect()
        lines = [x for f in sorted(path.glob("part-*")) for x in gzip.open(f, "rt").read().splitlines()]
        got = [(a or None, int(b), "" if c == '""' else c) for a, b, c in (x.split("\t") for x in lines)]
        assert list(map(key, got)) == sorted(map(key, rows)) and sorted(got, key=repr) == sorted(rows, key=repr)
        assert sum(r.n for r in ranges) == len(rows) and [r.file for r in ranges] == sorted(f.name for f in path.glob("part-*")) and len(ranges) > 1
        assert all(key(a.last) <= key(b.first) for a, b in zip(ranges, ranges[1:])) and (not most or max(r.n for r in ranges) <= most)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tables.write_ordered(d.limit(0), str(tmp_path / "none"), ["k"]).count() == 0
    with pytest.raises(ValueError, match="not among"):
        tables.write_ordered(d, str(tmp_path / "x"), ["z"])


def test_manifest_prefixes(spark):
    s = spark.createDataFrame([("H1", "MP1"), ("H12", "MP12"), ("H3", "MP3")], "file_id string, sample_name string")
    f = spark.createDataFrame([("/r/H1.fastq", 10, 1, "raw"), ("/r/H12.fastq", 10, 1, "raw"), ("/t/H12.fq", 10, 1, "trimmed")], "path string, size long, depth int, source_dir string")
    m = {r.file_id: r for r in manifest.build_manifest(s, f).collect()}
    # the first folder with any candidate wins, and H1* also matches H12: one candidate there, so the status is OK
    assert (m["H1"].status, m["H1"].n_matches, m["H1"].fastq_path, m["H1"].source_dir) == ("OK", 1, "/t/H12.fq", "trimmed")
    assert (m["H12"].status, m["H12"].match_rule, m["H3"].status) == ("OK", "exact_file_id", "MISSING")


def test_trim(spark):
    r = spark.createDataFrame([("s", 1, "TTACGTACCCCCGGGGGCCTTAAGG", "I" * 25), ("s", 2, "A" * 25, "I" * 20 + "#" * 5), ("s", 3, "ACGTACNCC" + "G" * 10, "I" * 19)], "sample_id string, read_no int, seq string, qual string")
    p = spark.createDataFrame([("s", "ACGTAC", "CTTAAGG")], "sample_id string, forward_primer_5to3 string, reverse_primer_5to3 string")
    out = {x.read_no: x for x in rd.trim_filter_reads(r, p, 0.0, min_q=20, max_n=0).collect()}
    assert set(out) == {1, 2} and out[2].seq == "A" * 20 and not out[2].cut_5p
    assert out[1].seq.startswith("CCCCGGGGG") and out[1].cut_5p


def test_validate(spark):
    s = spark.createDataFrame([("H12", "12S", "YES"), ("H12", "16S", "NoPCR"), ("", "x", "?")], "file_id string, locus string, pcr string")
    assert sorted(r.problem for r in tables.validate_samples(s).collect()) == ["duplicate file_id", "empty file_id", "unexpected locus", "unrecognized pcr"]


def test_unlisted_folder_comes_last(spark):
    samples = spark.createDataFrame([("H1", "S1"), ("H2", "S2")], "file_id string, sample_name string")
    files = spark.createDataFrame([("/x/other/H1.fq", 10, 2, "other"), ("/x/trimmed/H1.fq", 10, 2, "trimmed"), ("/x/other/H2.fq", 10, 2, "other")], "path string, size long, depth int, source_dir string")
    got = {r.file_id: r.fastq_path for r in manifest.build_manifest(samples, files).collect()}
    assert got == {"H1": "/x/trimmed/H1.fq", "H2": "/x/other/H2.fq"}
