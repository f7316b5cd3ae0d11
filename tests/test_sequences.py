"""Sequence functions against brute force on short strings, edge cases included."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from ampliskew.functions import arrow
from ampliskew.functions import seq as sq
from ampliskew.operators import features as ft

random.seed(7)
SEQS = ["", "A", "AC", "N", "ACGTACGT", "AAAAAAAA", "NNNNNN", "ACACACACAC", "GGGTGGGTGGGTGGG", "ACGACGACGACGT", "GAATTCGAATTC"]
SEQS += ["".join(random.choice("ACGT" if i % 3 else "AACGTN") for _ in range(n)) for i, n in enumerate([5, 19, 20, 21, 40, 61, 63, 64, 65, 66, 90, 300, 600])]


def column(spark, f):
    d = spark.createDataFrame([(i, s) for i, s in enumerate(SEQS)], "i int, s string")
    return [r.v for r in d.select("i", f("s").alias("v")).orderBy("i").collect()]


def lz(s):
    n, parts, start = len(s), 0, 0
    if n < 2:
        return 2 * n
    for e in range(1, n + 1):
        if s[start:e] not in s[:e - 1]:
            parts, start = parts + 1, e
    return parts + (start < n)


def test_lz76(spark):
    assert column(spark, arrow.lz76) == [lz(s) for s in SEQS]


def test_palindromes(spark):
    comp = {"A": "T", "T": "A", "C": "G", "G": "C", "N": "N"}

    def brute(s):
        found = [e - b for b in range(len(s)) for e in range(b + 2, len(s) + 1, 2) if s[b:e] == "".join(comp[x] for x in reversed(s[b:e]))] if len(s) < 400 else None
        return found and (sum(x >= 6 for x in found), sum(x >= 8 for x in found), sum(x >= 10 for x in found), max(found)) or (None if found is None else (0, 0, 0, 0))

    for got, s in zip(column(spark, arrow.palindromes), SEQS):
        want = brute(s)
        assert want is None or tuple(got) == want, s


def test_dust(spark):
    def brute(s):
        if len(s) < 3:
            return 0.0
        w = min(64, len(s))
        score = lambda x: sum(c * (c - 1) / 2 for c in {t: sum(x[i:i + 3] == t for i in range(len(x) - 2)) for t in {x[i:i + 3] for i in range(len(x) - 2)} if "N" not in t}.values())
        return max(score(s[i:i + w]) for i in range(len(s) - w + 1)) / w

    for got, s in zip(column(spark, arrow.dust), SEQS):
        assert math.isclose(got, brute(s)), s


def test_tandem_and_alternation(spark):
    def reps(s, u):
        best = 1
        for i in range(len(s)):
            m, r = s[i:i + u], 1
            while len(m) == u and "N" not in m and s[i + r * u:i + (r + 1) * u] == m:
                r += 1
            best = max(best, r)
        return best

    def density(s):
        cov = set()
        for u, least in ((1, 4), (2, 3), (3, 3)):
            for i in range(len(s)):
                m, r = s[i:i + u], 1
                while len(m) == u and (u == 1 or "N" not in m) and s[i + r * u:i + (r + 1) * u] == m:
                    r += 1
                if r >= least:
                    cov |= set(range(i, i + r * u))
        return len(cov) / len(s) if s else 0.0

    def alt(s):
        k = ["R" if x in "AG" else "Y" if x in "CT" else None for x in s]
        return max([j - i for i in range(len(s)) for j in range(i + 1, min(len(s), i + 40) + 1) if None not in k[i:j] and all(a != b for a, b in zip(k[i:j], k[i + 1:j]))] or [0])

    assert column(spark, lambda s: sq.max_tandem(s, 2)) == [reps(s, 2) for s in SEQS]
    assert column(spark, lambda s: sq.max_tandem(s, 3)) == [reps(s, 3) for s in SEQS]
    assert all(math.isclose(a, density(s)) for a, s in zip(column(spark, sq.tandem_density), SEQS))
    assert column(spark, sq.alternating_max) == [alt(s) for s in SEQS]


def test_tm_window_is_max_of_windows(spark):
    tm20 = column(spark, lambda s: sq.tm_window_max(s, 20))
    wins = [(i, s[j:j + 20]) for i, s in enumerate(SEQS) for j in range(max(1, len(s) - 19))]
    d = spark.createDataFrame(wins, "i int, s string").groupBy("i").agg(F.max(sq.tm_nn("s")).alias("m"))
    want = {r.i: r.m for r in d.collect()}
    assert all(abs(tm20[i] - want[i]) < 1e-6 for i in want)


def test_zones(spark):
    d = spark.createDataFrame([("x", "GGGGGGGGGGAAAAAAAAAAAAAAAAAAAAAAAAAGCGCGCGCGC"), ("y", "A" * 9)], "seq_id string, sequence string")
    z = ft.enrichment_zones(d, ["GC"], [10], [0.9]).orderBy("start").collect()
    assert [(r.seq_id, r.start, r.end, r.midpoint) for r in z] == [("x", 1, 11, 6.0), ("x", 35, 45, 40.0)]


def test_revcomp_is_its_own_inverse(spark):
    assert column(spark, lambda s: sq.revcomp(sq.revcomp(s))) == SEQS


def test_structure_and_window(spark):
    r = spark.createDataFrame([("((..))(.)",), ("",)], "s string").select(sq.structure_stats("s").alias("v")).collect()
    assert tuple(r[0].v) == (6 / 9, 3, 2, 2) and tuple(r[1].v) == (0.0, 0, 0, 0)


def test_core_row_width(spark):
    d = spark.createDataFrame([(str(i), s) for i, s in enumerate(SEQS) if s], "seq_id string, sequence string")
    out = ft.core_features(d)
    assert out.count() == len(SEQS) - 1 and sum(c.startswith("feat_") for c in out.columns) > 120


def test_arrow_functions_take_null(spark):
    from ampliskew.functions import arrow
    df = spark.createDataFrame([(None, "AC"), ("ACGTACGTAA", "AC"), ("", None)], "s string, p string")
    z = arrow.zones(["AC"], [5], [0.5])
    got = df.select(arrow.lz76("s"), arrow.dust("s"), arrow.zlib_ratio("s"), arrow.palindromes("s").n6, arrow.primer_sites("s", "p", F.lit(0), F.lit(5)).mm, arrow.best_site("s", "p").mm, z("s")).collect()
    assert list(got[0]) == [None] * 7 and got[1][0] is not None and got[1][5] == 0


def test_lz76_automaton_counts_the_same(monkeypatch):
    import random
    from ampliskew.functions import arrow
    r = random.Random(2)
    texts = ["", "A", "AB", "ABABABAB", "AAAA"] + ["".join(r.choice("ACGT"[:r.randint(1, 4)]) for _ in range(r.randint(2, 80))) for _ in range(300)]
    texts += ["".join(r.choice(["ACG", "TTACG", "G"]) for _ in range(60)) for _ in range(60)]
    want = [arrow.lz76_count(t) for t in texts]
    monkeypatch.setattr(arrow, "LONG_TEXT", 2)
    assert [arrow.lz76_count(t) for t in texts] == want
    monkeypatch.undo()
    assert arrow.lz76_count("".join(r.choice("ACGT") for _ in range(100_000))) > 5000


def test_primer_sites_equal_brute_force(spark):
    import random
    from ampliskew.functions import arrow
    r = random.Random(4)
    seqs = [None, "", "AC", "ACGTNRé"] + ["".join(r.choice("ACGTN") for _ in range(r.randint(1, 40))) for _ in range(80)]
    rows = [(i, s, p, lo, lo + r.randint(0, 12)) for i, s in enumerate(seqs) for p in ("ACGTY", "NNW", "GATTACAGATTACA") for lo in (0, 3)] + [(999, "ACGT", None, 0, 1), (998, "ACGT", "", 0, 1)]

    def best(s, p, lo=0, hi=10**6):
        at = [(sum(x not in "ACGT" or x not in sq.IUPAC[y] for x, y in zip(s[i:], p)), i) for i in range(len(s) - len(p) + 1) if lo <= i <= hi]
        return min(at, default=None)

    df = spark.createDataFrame(rows, "i int, s string, p string, lo int, hi int")
    got = df.select("i", "s", "p", "lo", "hi", arrow.primer_sites("s", "p", "lo", "hi").alias("a"), arrow.best_site("s", "p").alias("b")).collect()
    for x in got:
        if x.s is None or not x.p:
            assert tuple(x.b) == (None, None)
            continue
        any_, end = best(x.s, x.p), best(x.s, x.p, x.lo, x.hi)
        assert tuple(x.a) == (any_ or (len(x.p), -1)) + (end or (len(x.p), -1)) and tuple(x.b) == (any_ or (None, None))


def test_zones_of_a_batch_are_those_of_each_sequence(monkeypatch):
    """F8: sequences are scanned together, and no zone crosses from one into the next."""
    import random
    import pyarrow as pa
    from ampliskew.functions import arrow
    monkeypatch.setattr(arrow, "ZONE_LETTERS", 150)
    r = random.Random(3)
    texts = [None, "", "GG", "G" * 40, "C" * 40] + ["".join(r.choice("ACGTGGN") for _ in range(r.randint(1, 90))) for _ in range(60)]
    motifs, windows, shares = ["G", "GC"], [5, 10], [0.5, 0.8]

    def plain(x):
        out = []
        for m, letters in enumerate(motifs):
            for w in windows:
                for t, share in enumerate(shares):
                    hits = [i for i in range(len(x) - w + 1) if sum(c in letters for c in x[i:i + w]) >= w * share]
                    zones = []
                    for i in hits:
                        if zones and i - zones[-1][1] <= w:
                            zones[-1][1] = i
                        else:
                            zones.append([i, i])
                    out += [(m, w, t, a + 1, b + w) for a, b in zones]
        return out

    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts)], ["seq_id", "s"])
    got = [tuple(row.values()) for b in arrow.zone_rows(motifs, windows, shares)([batch]) for row in b.to_pylist()]
    assert sorted(got) == sorted((str(i), *z) for i, x in enumerate(texts) for z in plain(x or ""))


def test_zone_totals_are_summed_zones(spark):
    """F8: totals by sequence straight from the scan, without a shuffle of zones."""
    d = spark.createDataFrame([("x", "GGGGGGGGGGAAAAAAAAAAAAAAAAAAAAAAAAAGCGCGCGCGC"), ("y", "A" * 9), ("z", "acgtacgtgg" * 7), ("n", None)], "seq_id string, sequence string")
    key = ["seq_id", "motif", "window", "threshold"]
    want, got = (sorted(map(tuple, z.select(*key, "num_zones", "total_length").collect())) for z in (ft.zone_summary(ft.enrichment_zones(d)), ft.zone_totals(d)))
    assert got == want and len(got) > 50


def test_scans_of_a_batch_equal_expressions(spark):
    """all letters of a batch are scanned at once, with the results of the expressions and functions of one text."""
    r = np.random.default_rng(7)
    texts = ["".join(r.choice(list("ACGTN"), r.integers(0, 120), p=[.3, .2, .2, .25, .05])) for _ in range(150)]
    texts += ["".join(r.choice(list("AT"), r.integers(0, 90))) for _ in range(60)] + ["AT" * 1500, "A" * 2100, "ACGT" * 600 + "N" + "ACG" * 40, "ACGRYKACé\nAAAA\n\n\n\n\n", "N" * 30, "AN" * 30, "é" * 70, "", None, "A", "AC", "ACA" * 7, "acgt"]
    s = F.col("sequence")
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, sequence string").coalesce(1)
    x = F.col("x")
    got = d.withColumn("x", arrow.scans(*arrow.SCANS)(s))
    runs = sq.runs(s)
    want = {"direp": sq.max_tandem(s, 2), "trirep": sq.max_tandem(s, 3), "tandem_density": sq.tandem_density(s), "end_complement": sq.end_complement(s), "alternating": sq.alternating_max(s),
            "gc_w20": sq.window_max(s, 20, sq.gc_share), "dust": arrow.dust(s), **{f"pal_{k}": arrow.palindromes(s)[k] for k in ("n6", "n8", "n10", "max_len")},
            "run_max": sq.longest(runs), "n_runs": F.size(runs), "run_ge4": sq.n_at_least(runs, 4), "run_ge5": sq.n_at_least(runs, 5), "run_ge6": sq.n_at_least(runs, 6),
            **{f"run{b}_max": sq.longest(F.regexp_extract_all(s, F.lit(f"{b}+"), F.lit(0))) for b in "ACGT"}}
    a = got.orderBy("i").select("x.*").collect()
    b = d.orderBy("i").select(*[v.alias(k) for k, v in want.items()]).collect()
    for k in want:
        for text, p, q in zip(texts, a, b):
            assert p[k] == q[k] or k in ("tandem_density", "end_complement", "gc_w20", "dust") and p[k] is not None and abs(p[k] - q[k]) < 1e-12, (k, text, p[k], q[k])
    assert set(want) == {f for n in arrow.SCANS for f in arrow.SCANS[n][0]}
    plan = d.select(*[v.alias(k) for k, v in ft.complexity("sequence").items()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("scan(sequence") == plan.split("ArrowEvalPython", 1)[1].split("\n", 1)[0].count("scan(sequence") == 1


def test_melting_windows_of_a_batch(spark):
    """windows of all sequences at once, N left out, against every window on its own."""
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("ACGTN"), r.integers(0, 60), p=[.25, .2, .2, .25, .1])) for _ in range(60)] + ["N" * 25 + "ACGT", "N" * 40, "", "A", None, "ACGT" * 30]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string").coalesce(1)
    windows = F.when(F.length("s") < 20, F.array("s")).otherwise(sq.windows("s", 20))
    one = F.when(F.length("s") > 0, F.array_max(F.transform(windows, sq.tm_nn))).otherwise(F.when(F.col("s").isNotNull(), 0.0))
    for x in d.select("s", sq.tm_window_max("s", 20).alias("got"), one.alias("want")).collect():
        assert x.got == x.want or abs(x.got - x.want) < 1e-9, x
