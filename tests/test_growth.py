"""Steps whose cost must not grow faster than their input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ampliskew.operators import bias
from ampliskew.operators import evaluate as ev
from ampliskew.operators import tables as tb


def test_reference_is_merged_in_pieces(spark, monkeypatch):
    """a reference is never broadcast, and its pieces give what it gives whole."""
    r = np.random.default_rng(1)
    ref = spark.createDataFrame([(f"c{i}", "".join(r.choice(list("ACGT"), 40))) for i in range(3)], "contig string, sequence string")
    depth = spark.createDataFrame([(f, f"c{c}", p, int(r.integers(6, 30))) for f in ("y", "n") for c in range(3) for p in range(1, 41)], "file_id string, contig string, pos int, depth int")
    pairs = spark.createDataFrame([("p", "y", "n")], "pair_id string, yes_file_id string, no_file_id string")
    whole = bias.kmer_depth_ratio(ref, depth, pairs)
    assert "SortMergeJoin [contig" in whole._jdf.queryExecution().executedPlan().toString()
    want = whole.toPandas().sort_values(["k", "kmer"]).reset_index(drop=True)
    assert want.n.sum() == 3 * (38 + 37)
    monkeypatch.setattr(bias, "PIECE", 7)
    pd.testing.assert_frame_equal(bias.kmer_depth_ratio(ref, depth, pairs).toPandas().sort_values(["k", "kmer"]).reset_index(drop=True), want)


def test_metrics_store_sums_only(spark, monkeypatch):
    """Rows are ranked in slices and none is stored; ranks are those of the whole group."""
    r = np.random.default_rng(2)
    n = 3000
    p = pd.DataFrame({"g": np.where(np.arange(n) % 5 == 0, "small", "hot"), "y_true": np.round(r.normal(size=n), 1), "y_pred": np.round(r.normal(size=n), 3)})
    stored, keep = [], ev.keep
    monkeypatch.setattr(ev, "keep", lambda df: stored.append(keep(df)) or stored[-1])
    got = ev.regression_metrics(spark.createDataFrame(p).repartition(4), ["g"]).toPandas().set_index("g")
    assert all(s.count() < n // 10 for s in stored)
    for g, s in p.groupby("g"):
        assert got.n[g] == len(s) and np.isclose(got.spearman[g], s.y_true.rank().corr(s.y_pred.rank())) and np.isclose(got.pearson[g], s.y_true.corr(s.y_pred))
        assert np.isclose(got.mae[g], (s.y_true - s.y_pred).abs().mean()) and np.isclose(got.sign_acc[g], ((s.y_true >= 0) == (s.y_pred >= 0)).mean())


def test_scatter_sample_sorts_few_rows(spark):
    """F16: the smallest hashes of a group, without positions for all rows."""
    from hashlib import md5

    ids = [f"r{i}" for i in range(2000)]
    df = spark.createDataFrame([("a", x, 1.0, 2.0) for x in ids], "g string, row_id string, y_true double, y_pred double")
    out = tb.scatter_sample(df, ["g"], 20)
    want = sorted(ids, key=lambda x: (md5(f"1|{x}".encode()).hexdigest()[:8], md5(x.encode()).hexdigest(), x))[:20]
    assert sorted(out.toPandas().row_id) == sorted(want)


def test_vocabulary_cap_is_in_the_sql():
    """the query's vocabulary has at most 4000 words a length, and so has its SQL."""
    import __spark_entry__ as entry

    assert "<= 4000" in entry.oracle_sql()["g07_region_kmers_vocab"]


def test_region_words_are_added_up_by_task(spark):
    """one line a word and region, equal to the words of every sequence counted together; no row for each of them."""
    from pyspark.sql import functions as F

    from ampliskew.operators import kmers as km

    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("ACGTN"), n, p=[0.3, 0.3, 0.2, 0.15, 0.05])) for n in (0, 5, 20, 31, 45, 60, 61, 64, 68, 90, 200)] + ["ACGRYACGTACGTTTAC" * 6]
    df = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(texts)] + [("none", None)], "seq_id string, sequence string")
    for strict, long in ((True, km.region_kmers_strict(df)), (False, km.region_kmers_segment(df))):
        want = long.groupBy("k", "region", "kmer").agg(F.count(F.lit(1)).alias("n_seqs"), F.sum("x").cast("long").alias("x"))
        assert sorted(km.region_kmer_table(df, strict=strict).collect()) == sorted(want.collect())


def test_word_summaries_in_batches(spark):
    """the same summaries as the column expressions, which take time by windows and sorts of texts."""
    from ampliskew.functions import seq as sq
    from ampliskew.operators import features as ft

    texts = ["", "A", "ACG", "NNNN", "ACGTACGTAC", "AAAAAAAAAAAAAAAAAAAAGN" * 5, "ACGRYACGTACGTTTAC" * 6, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, sequence string")
    got = {r.i: r for r in ft.kmer_summaries(df).collect()}
    for k in (1, 3, 8):
        for i, s in df.select("i", sq.count_summary(sq.word_counts(sq.kmers("sequence", k))).alias("s")).collect():
            for f in ("distinct", "entropy", "gini", "top10cov"):
                assert np.isclose(got[i][f"feat_k{k}_{f}"], s[f]), (k, i, f)


def test_near_dedup_links_fingerprints(spark, tmp_path):
    """the stage named after SimHash drops what fingerprints link, then what shingle sets link."""
    import corpus_pipeline as cp

    long = " ".join(f"w{i}" for i in range(400))
    rows = [(1, "one two"), (2, "ONE  two"), (3, long), (4, long + " end"), (5, "else entirely"), (6, None), (7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    called, one = [], cp.one_of_each
    cp.one_of_each = lambda *a, **k: called.append(1) or one(*a, **k)
    try:
        left = cp.near_dedup(spark, spark.read.parquet(f"{tmp_path}/d"), "")
        assert called and sorted(r.doc_id for r in left.collect()) == [1, 3, 5, 6]
    finally:
        cp.one_of_each = one


def test_trees_are_walked_once_for_equal_rows(spark):
    """rows of one cell between thresholds are one line; table and rows give the same."""
    from ampliskew.operators import dataset as ds
    from ampliskew.operators import models as md
    r = np.random.default_rng(6)
    p = pd.DataFrame({"a": np.round(r.normal(size=400), 1), "b": r.integers(0, 3, 400).astype(float)})
    p["y"], p["w"] = p.a * p.b, 1.0
    few = ds.assemble(spark.createDataFrame(p), ["a", "b"], "no_kmer")
    model = md.fit_rf(few, 5, 4)
    many = ds.assemble(spark.createDataFrame(pd.concat([p] * 20)).withColumn("id", F.monotonically_increasing_id()), ["a", "b"], "no_kmer")
    lines, base = md.tree_contributions(model, many, [], counted=True)
    rows, _ = md.tree_contributions(model, model.transform(many), ["id", "prediction"])
    got = lines.toPandas()
    assert len(got) <= 32 * 3 and got.n.sum() == 8000 and rows.count() == 8000
    assert max(abs(sum(x.contrib) + base - x.prediction) for x in rows.collect()) < 1e-6
    a, b = (md.contribution_table(x, ["a", "b"]).toPandas().set_index("feature").sort_index() for x in (lines, rows))
    pd.testing.assert_frame_equal(a, b)
    values = pd.DataFrame([x.contrib for x in rows.collect()], columns=["a", "b"]).abs()
    assert np.allclose(a.mean_abs_shap, values.mean()) and np.allclose(a.sd_abs_shap, values.std(ddof=0))


def test_top_bias_orders_ties_only(spark, monkeypatch):
    """rows of largest |y|, ties at the cut by hash; rows below the cut are neither stored nor sorted."""
    from hashlib import md5
    from ampliskew.operators import dataset as ds
    r = np.random.default_rng(7)
    n = 4000
    p = pd.DataFrame({"g": np.where(np.arange(n) % 4 == 0, "few", "hot"), "row_id": [f"r{i}" for i in range(n)], "y": np.clip(np.round(r.normal(size=n) * 4, 1), -6, 6), "seq_id": "s"})
    p.loc[5, "y"] = None
    p = pd.concat([p, pd.DataFrame({"g": ["null"] * 2, "row_id": ["a", "b"], "y": [None, None], "seq_id": "s"})])
    stored, keep = [], ds.keep
    monkeypatch.setattr(ds, "keep", lambda df: stored.append(keep(df)) or stored[-1])
    for frac in (0.02, 0.5):
        stored.clear()
        got = {x.row_id for x in ds.topbias(spark.createDataFrame(p).withColumn("y", F.nanvl("y", F.lit(None))), ["g"], frac, "row_id").collect()}
        want = set()
        for _, s in p.groupby("g"):
            s = s.assign(a=s.y.abs().fillna(-1), m=[md5(x.encode()).hexdigest() for x in s.row_id]).sort_values(["a", "m"], ascending=[False, True])
            want |= set(s.row_id[:max(1, int(np.ceil(len(s) * frac)))])
        assert got == want
        assert frac > 0.1 or all(s.count() < n // 3 for s in stored)


def test_groups_need_no_ranks(spark):
    """the groups of the metrics table without the metrics."""
    p = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("b", None, 1.0), ("c", 0.0, 0.0), (None, 1.0, 1.0)], "g string, y_true double, y_pred double")
    got = ev.scored_groups(p, ["g"])
    assert sorted(map(str, got.collect())) == sorted(map(str, ev.regression_metrics(p, ["g"]).select("g").collect()))
    assert "mapInArrow" not in got._jdf.queryExecution().toString().replace("MapInArrow", "mapInArrow")


def test_vectors_are_made_once_a_sequence(spark, monkeypatch):
    """variants are assembled for sequences, not for every row of the training table."""
    import __spark_entry__ as entry
    from ampliskew.operators import dataset as ds
    seen, assemble = [], ds.assemble
    monkeypatch.setattr(ds, "assemble", lambda df, *a: seen.append(df) or assemble(df, *a))
    entry.queries()["i06_assemble_variants"](spark, "/root/testdata/sf0.001")
    sequences = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert len(seen) == 6 and all(d.count() <= sequences for d in seen)


def test_pair_bootstrap_stores_points_only(spark, monkeypatch):
    """no copy of the rows is stored, only distinct points; sizes still count every row."""
    p = pd.DataFrame({"g": "a", "pair_id": [f"p{i % 4}" for i in range(2000)], "y_true": [float(i % 7) for i in range(2000)], "y_pred": [float(i % 5) for i in range(2000)]})
    p.loc[3, "y_true"] = np.nan
    d = spark.createDataFrame(p).withColumn("y_true", F.nanvl("y_true", F.lit(None)))
    stored, keep = [], ev.keep
    monkeypatch.setattr(ev, "keep", lambda df: stored.append(keep(df)) or stored[-1])
    got = ev.bootstrap_pairs(d, ["g"], B=20).collect()[0]
    assert (got.n_test, got.n_pairs, got.n_boot) == (2000, 4, 20)
    assert stored and all(s.count() <= 4 * 35 for s in stored)


def test_metrics_of_few_and_many_values(spark, monkeypatch):
    """Ranks of few values of y are broadcast and rows are dealt once; many values give the same. Names are not shuffled with rows."""
    r = np.random.default_rng(8)
    n = 2000
    p = pd.DataFrame({"g": np.where(np.arange(n) % 5 == 0, None, "hot"), "y_true": np.round(r.normal(size=n), 1), "y_pred": np.round(r.normal(size=n), 2), "c": r.integers(1, 4, n)})
    d, dealt = spark.createDataFrame(p).repartition(4), []
    by_range = type(d).repartitionByRange
    monkeypatch.setattr(type(d), "repartitionByRange", lambda self, *a: dealt.append((self.columns, a)) or by_range(self, *a))
    few = ev.regression_metrics(d, ["g"], "c").toPandas()
    rows = [x for x in dealt if "p" in x[0]]
    assert len(rows) == 1 and "g" not in rows[0][0]
    monkeypatch.setattr(ev, "RANKED", 3)
    dealt.clear()
    many = ev.regression_metrics(d, ["g"], "c").toPandas()
    assert len([x for x in dealt if "p" in x[0]]) == 2
    few, many = (x.assign(g=x.g.fillna("-")).sort_values("g").reset_index(drop=True) for x in (few, many))
    pd.testing.assert_frame_equal(few, many)
    for g, s in p.assign(g=p.g.fillna("-")).groupby("g"):
        s = s.loc[s.index.repeat(s.c)]
        assert np.isclose(few.set_index("g").spearman[g], s.y_true.rank().corr(s.y_pred.rank()))


def test_totals_are_stored_once(spark, monkeypatch):
    """Both sides of the pairs read the stored totals, so counts are added up once."""
    stored, keep = [], bias.keep
    monkeypatch.setattr(bias, "keep", lambda df: stored.append(keep(df)) or stored[-1])
    ab = spark.createDataFrame([("y", "s1", 3), ("n", "s1", 1), ("n", "s2", 4)], "sample_id string, seq_id string, count long")
    pairs = spark.createDataFrame([("p", "x", 2, "l", "y", "n")], "pair_id string, species string, n_individuals int, locus string, yes_file_id string, no_file_id string")
    got = {r.seq_id: (r.count_yes, r.count_no, r.total_yes, r.total_no) for r in bias.paired_log2fc(ab, pairs).collect()}
    assert got == {"s1": (3, 1, 3, 5), "s2": (0, 4, 3, 5)} and [s.count() for s in stored] == [2]


def test_resplit_sorts_edge_bins_only(spark, monkeypatch):
    """positions in hash order without sorting a dataset; the same split as with all rows in order."""
    from hashlib import md5
    from ampliskew.operators import dataset as ds
    monkeypatch.setattr(ds, "ordered_positions", None)
    p = [(g, f"{g}{i}") for g, n in (("a", 1000), ("b", 3), ("c", 2), ("d", 14)) for i in range(n)] + [(None, "x")]
    for val, test, least in ((0.1, 0.1, 1), (0.3, 0.25, 0), (0.5, 0.5, 1)):
        got = {(r.g, r.row_id): r.split for r in ds.resplit(spark.createDataFrame(p, "g string, row_id string"), ["g"], "row_id", val, test, least, least).collect()}
        want = {}
        for g in "abcd":
            own = sorted((x for k, x in p if k == g), key=lambda x: (md5(f"1|{x}".encode()).hexdigest()[:8], md5(x.encode()).hexdigest(), x))
            n = len(own)
            nv, nt = max(least, round(n * val)), max(least, round(n * test))
            if n - nv - nt < 1:
                nv = nt = least
            want |= {(g, x): "test" if n - i - 1 < nt else "val" if n - i - 1 < nt + nv else "train" for i, x in enumerate(own) if n >= 1 + 2 * least}
        assert got == want


def test_overviews_count_values_once(spark, monkeypatch):
    """counts of values are stored and repeated, never the rows."""
    r = np.random.default_rng(9)
    n = 3000
    p = pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, "a", "b"), "split": np.where(np.arange(n) % 4 == 0, "test", "train"), "pair_id": [f"p{i % 5}" for i in range(n)],
                      "seq_id": [f"s{i % 700}" for i in range(n)], "y": np.round(r.normal(size=n), 1)})
    stored, keep = [], tb.keep
    monkeypatch.setattr(tb, "keep", lambda df: stored.append(keep(df)) or stored[-1])
    d = spark.createDataFrame(p)
    got = tb.dataset_overview(d, ["g", "split"]).toPandas().set_index(["g", "split"])
    assert len(stored) == 1 and stored[0].count() < n // 2
    for k, s in p.groupby(["g", "split"]):
        o = got.loc[k]
        assert (o.n_rows, o.n_pairs, o.n_sequences) == (len(s), s.pair_id.nunique(), s.seq_id.nunique())
        assert np.allclose([o.y_mean, o.y_sd, o.frac_nonneg, o.q10, o.q50, o.q95], [s.y.mean(), s.y.std(), (s.y >= 0).mean(), *s.y.quantile([0.1, 0.5, 0.95])])
    counted, cumulate = [], tb.cumulate
    monkeypatch.setattr(tb, "cumulate", lambda h, *a: counted.append(h) or cumulate(h, *a))
    q = tb.y_quantiles(d, ["g"]).toPandas().set_index(["g", "split"])
    plan = counted[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")  # repeated after values are counted
    for g, s in p.groupby("g"):
        assert q.n[g, "all"] == len(s) and np.isclose(q.q25[g, "all"], s.y.quantile(0.25)) and np.isclose(q.min_abs_y[g, "all"], s.y.abs().min())


def test_bootstrap_points_travel_packed(spark):
    """a task's points come as a few blobs of three numbers a point, and rows drawn one by one give the same totals."""
    r = np.random.default_rng(2)
    p = pd.DataFrame({"g": np.where(np.arange(6000) % 3 == 0, "a", "b"), "y_true": np.round(r.normal(size=6000), 1), "y_pred": np.round(r.normal(size=6000), 1)})
    points = ev._points(spark.createDataFrame(p).repartition(4), ["g"], None)
    blobs = ev._packed(points, ["g"]).toPandas()
    want = p.groupby(["g", "y_true", "y_pred"]).size()
    assert len(blobs) <= 2 * 8 < len(want) and blobs.blob.map(len).sum() < 30 * len(want) + 2000 * len(blobs)
    for g, own in blobs.groupby("g"):
        u, y, q, c, sums = ev._unpacked(list(own.blob))
        assert not u.any() and list(want[g].index) == list(zip(y.tolist(), q.tolist())) and (want[g].to_numpy() == c).all() and np.allclose(sums[:, 2], c * (y - q) ** 2)
        w = ev._drawn_rows(ev._rng(1, g), u, c, 200)
        assert c.max() > 1 and (w.sum(1) == c.sum()).all() and np.allclose(w.mean(0).mean(), c.mean()) and abs(np.corrcoef(w.mean(0), c)[0, 1]) > 0.9


def test_kmer_statistics_from_sequences(spark, monkeypatch):
    """moments added up where rows meet their sequence equal those of rows joined to words; only sums are shuffled after the join."""
    from ampliskew.operators import kmers as km
    from ampliskew.operators import stats as st
    r = np.random.default_rng(5)
    seqs = ["".join(r.choice(list("ACGT"), 40)) for _ in range(30)] + ["ACGNNACGRACGT", "AC", "", None]
    c = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(seqs)], "seq_id string, sequence string")
    rows = [(f"p{j}", f"s{i}", int(r.integers(0, 4)), int(r.integers(0, 4)), float(r.normal()) if i % 9 else None) for i in range(len(seqs) + 2) for j in range(3)]
    t = spark.createDataFrame(rows, "pair_id string, seq_id string, count_yes long, count_no long, log2fc double").repartition(4)
    k = km.kmers_long(c, [2], ["all"]).select("seq_id", F.col("kmer").alias("feature"), F.col("n").cast("double").alias("x"))
    order = ["pair_id", "feature"]
    want = st.sparse_kmer_stats(t, k).toPandas().sort_values(order, ignore_index=True)
    for held in (st.HELD_SUMS, 1):
        monkeypatch.setattr(st, "HELD_SUMS", held)
        got = st.sequence_kmer_stats(t, c, 2).toPandas().sort_values(order, ignore_index=True)
        assert {"GR", "RA"} <= set(got.feature)
        pd.testing.assert_frame_equal(got, want)


def test_models_of_the_same_rows_share_ranks(spark, monkeypatch):
    """a value of y is ranked and broadcast once for all models of the same rows; groups that differ in one row keep their own."""
    r = np.random.default_rng(9)
    rows = pd.DataFrame({"y_true": np.round(r.normal(size=500), 1)})
    p = pd.concat([rows.assign(model=m, y_pred=np.round(rows.y_true * a + r.normal(size=500), 2)) for m, a in (("a", 1.0), ("b", 0.5), ("c", 0.0))], ignore_index=True)
    p.loc[len(p) - 1, "y_true"] += 0.1
    ranked, cumulate = [], ev.cumulate
    monkeypatch.setattr(ev, "cumulate", lambda h, *a: ranked.append(h.count()) or cumulate(h, *a))
    n = p[p.model != "b"].groupby(["model", "y_true"]).ngroups
    monkeypatch.setattr(ev, "RANKED", n + 3)
    few = ev.regression_metrics(spark.createDataFrame(p), ["model"]).toPandas().sort_values("model", ignore_index=True)
    assert ranked == [n]
    monkeypatch.setattr(ev, "RANKED", n + 2)
    many = ev.regression_metrics(spark.createDataFrame(p), ["model"]).toPandas().sort_values("model", ignore_index=True)
    assert ranked == [n]
    pd.testing.assert_frame_equal(few, many)
    for m, x in p.groupby("model"):
        assert np.isclose(few[few.model == m].spearman.iloc[0], x.y_true.rank().corr(x.y_pred.rank()))


def test_forest_broadcasts_hold_what_rows_need(spark, monkeypatch):
    """levels broadcast features and cuts alone, and drop each broadcast when it is done."""
    from pyspark import SparkContext
    from ampliskew.operators import dataset as ds
    from ampliskew.operators import forests as fo
    r = np.random.default_rng(1)
    p = pd.DataFrame({"g": "a", "row_id": [f"r{i}" for i in range(300)], "a": r.normal(size=300), "y": r.normal(size=300), "w": 1.0, "split": "train"})
    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, x: sent.append((x, broadcast(self, x))) or sent[-1][1])
    forest = fo.fit_forests(ds.assemble(spark.createDataFrame(p), ["a"], "no_kmer"), ["g"], {"all": [0]}, trees=3, depth=3)
    assert len(sent) == 3 and all(x.value is None and x.cover is None for x, _ in sent) and forest.cover[0, :, 0].min() > 0
    assert all(b._jbroadcast is None or not b._jbroadcast.isValid() for _, b in sent)


def test_lines_behind_the_pairs_are_counted_once(spark, monkeypatch):
    """whatever reads the training rows reads stored counts, and both sides of a pair meet where their sequence lies."""
    from ampliskew.plans import fixtures as fx
    seen, raw = spark.sparkContext.accumulator(0), fx.Tables.raw

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def watched(self, name):
        d = raw(self, name)
        return d.select("l_suppkey", "l_partkey", "l_quantity").mapInArrow(passed, d.select("l_suppkey", "l_partkey", "l_quantity").schema) if name == "lineitem" else d

    monkeypatch.setattr(fx.Tables, "raw", watched)
    t = fx.Tables(spark, "/root/testdata/sf0.001").training
    assert t.count() == t.where("count_yes + count_no > 0").count() > 0
    assert seen.value == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    t.collect()
    assert "hashpartitioning(pair_id" not in t._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_large_pairs_are_permuted_whole(spark, monkeypatch):
    """a pair of many blocks takes every permutation alike, and ranks come from few stored lines without names."""
    from itertools import permutations

    y, p, total = 10.0 ** np.arange(5), 7.0 ** np.arange(5), 0.0
    for i in range(3):
        for j in range(3):
            total = total + np.asarray(ev._permuted(y[2 * i:2 * i + 2], p[2 * j:2 * j + 2], 5, 2, i, j, 3000, (1, 9)))
    sums, times = np.unique(total, return_counts=True)
    assert sorted(sums) == sorted(float(np.asarray(q) @ p) for q in permutations(y)) and times.min() > 8 and times.max() < 50
    rows = [(g, f"p{i % 2}", f"{g}{i}", float(i // 3), float(i // 3)) for g in ("a", None) for i in range(60)]
    d = spark.createDataFrame(rows, "g string, pair_id string, row_id string, y_true double, y_pred double").repartition(4)
    stored, keep = [], ev.keep
    monkeypatch.setattr(ev, "keep", lambda df: stored.append(keep(df)) or stored[-1])
    monkeypatch.setattr(ev, "PERMUTED_ROWS", 7)
    got = ev.permutation_null(d, ["g"], 100).toPandas()
    assert not any({"row_id", "y", "p"} & set(s.columns) for s in stored)
    for _, own in got.assign(g=got.g.fillna("-")).groupby("g"):  # rows in the order of p: a shuffle in parts keeps some of it
        assert len(own) == 100 and abs(own.perm_spearman.mean()) < 0.07 and 0.09 < own.perm_spearman.std() < 0.18
    monkeypatch.setattr(ev, "PERMUTED_ROWS", 1 << 20)
    whole = ev.permutation_null(d, ["g"], 100).toPandas()
    assert abs(whole.perm_spearman.std() - got.perm_spearman.std()) < 0.05
    flat = ev.permutation_null(d.withColumn("y_true", F.lit(0.3)), ["g"], 3).toPandas()
    assert len(flat) == 6 and flat.perm_spearman.isna().all()


@pytest.mark.parametrize("hot", [False, True])
def test_large_groups_are_resampled_exactly(spark, monkeypatch, hot):
    """replicates of groups cut into slices equal repeated rows, also where one value fills several slices; small groups stay as they were."""
    from tests.test_statistics import brute_metrics

    monkeypatch.setattr(ev, "CELLS", 100)
    monkeypatch.setattr(ev, "STEPS", 8)
    r = np.random.default_rng(4)
    g = np.where(np.arange(670) < 640, "big", "small")
    p = pd.DataFrame({"g": g, "y_true": np.round(r.normal(size=670), 1), "y_pred": np.round(r.normal(size=670), 2), "pair_id": [f"p{i % 6}" for i in range(670)]})
    if hot:
        p.loc[::3, "y_true"], p.loc[1::3, "y_pred"] = 0.5, -0.25
    p.loc[5, "g"] = None
    p = pd.concat([p, p.iloc[:50]], ignore_index=True)
    d = spark.createDataFrame(p).repartition(4)
    code = {x.g: x.c for x in d.select("g", ev._code(["g"]).alias("c")).distinct().collect()}
    got = ev._replicates(ev._points(d, ["g"], "pair_id"), ["g"], 12, 3, ev._drawn_units).toPandas()
    assert len(got) == 36
    own = p[p.g == "big"]
    for b in range(1, 13):
        times = np.bincount(ev._rng(3, code["big"], b).integers(0, 6, 6), minlength=6)
        rows = own.loc[own.index.repeat(times[own.pair_id.str[1:].astype(int)])]
        x = got[(got.g == "big") & (got.b == b)].iloc[0]
        assert np.allclose([x.r2, x.rmse, x.mae, x.spearman], brute_metrics(rows), atol=1e-9)
    alone = ev._replicates(ev._points(d.withColumn("k", F.concat_ws("|", "y_true", "y_pred")), ["g"], "k"), ["g"], 3, 3, ev._drawn_rows).toPandas()
    for x in alone[alone.g == "big"].itertuples():  # strata of equal rows: every draw is the rows themselves
        assert np.allclose([x.r2, x.rmse, x.mae, x.spearman], brute_metrics(own), atol=1e-9)
    if not hot:
        monkeypatch.setattr(ev, "STEPS", 150)
        sliced = ev._replicates(ev._points(d, ["g"], None), ["g"], 300, 3, ev._drawn_rows).toPandas()
        monkeypatch.setattr(ev, "CELLS", 1 << 20)
        whole = ev._replicates(ev._points(d, ["g"], None), ["g"], 300, 3, ev._drawn_rows).toPandas()
        a, b = (x[x.g == "big"].set_index("b") for x in (sliced, whole))
        for m in ("rmse", "spearman"):
            assert a[m].nunique() == 300 and abs(a[m].mean() - b[m].mean()) < 0.3 * b[m].std() and 0.8 < a[m].std() / b[m].std() < 1.25
        pd.testing.assert_frame_equal(*(x[x.g == "small"].sort_values("b").reset_index(drop=True) for x in (sliced, whole)))


def test_words_of_vectors_are_never_broadcast(spark):
    """words of a small catalogue are merged with its rows, and vectors made once serve all variants."""
    from ampliskew.operators import dataset as ds
    rows = spark.createDataFrame([(f"s{i}", float(i)) for i in range(20)], "seq_id string, a double")
    words = spark.createDataFrame([(f"s{i}", f, float(i % 3 + 1)) for i in range(15) for f in ("k1_head30_A", "k2_head30_AC", "k2_tail30_GC")], "seq_id string, feature string, x double")
    vocab = ["k2_head30_AC", "k1_head30_A", "k2_tail30_GC"]
    once = ds.with_kmer_vectors(rows, words, vocab)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    for variant in ("no_kmer", "kmer_only_k2", "kmer_only_all", "all"):
        a, b = (x.orderBy("seq_id").collect() for x in (ds.assemble(rows, ["a"], variant, words, vocab), ds.assemble(once, ["a"], variant, "kmers", vocab)))
        assert len(a) == 20 and [(r.seq_id, r.features.toArray().tolist()) for r in a] == [(r.seq_id, r.features.toArray().tolist()) for r in b]


def test_motifs_are_counted_by_batch(spark):
    """motifs of all sequences of a batch at once, N, other letters, overlaps, nulls and zeros included."""
    from ampliskew.operators import kmers as km
    r = np.random.default_rng(6)
    texts = ["".join(r.choice(list("ACGTN"), r.integers(0, 40), p=[.4, .3, .1, .1, .1])) for _ in range(700)] + ["AAAAAAA", "RAAAAé", "ACG", "", None]
    motifs = {"global": ["AAAA", "AAAAA", "ACAC", "NACA", "CCCC", "AAA"], "head": ["ACCA"]}
    rows = [(f"s{i}", x, x and x[:9], "ACGT") for i, x in enumerate(texts)]
    d = spark.createDataFrame(rows, "seq_id string, sequence string, head string, mid1 string")
    cat = spark.createDataFrame([(k, m, 7) for k, v in motifs.items() for m in v] + [("other", "ACGT", 1)], "region string, motif string, n int")
    out = km.motif_features(d, cat)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    times = lambda x, m: sum(x.startswith(m, i) for i in range(len(x))) if len(m) in (4, 5) else 0
    want = {(s, k, m): times((x.upper() if k == "global" else x[:9]) if x else "", m) for s, x, *_ in rows for k, v in motifs.items() for m in v}
    got = out.collect()
    assert len(got) == len(want) and {tuple(x)[:3]: x["count"] for x in got} == want and all(x.present == (x["count"] > 0) for x in got)


def test_windows_of_depth_are_not_shuffled(spark):
    """positions are dealt once by contig and piece; their windows are summed and meet the reference where they are."""
    ref = spark.createDataFrame([("c", "ACGT" * 10)], "contig string, sequence string")
    depth = spark.createDataFrame([(f, "c", p, 9) for f in ("y", "n") for p in range(1, 41)], "file_id string, contig string, pos int, depth int")
    pairs = spark.createDataFrame([("p", "y", "n")], "pair_id string, yes_file_id string, no_file_id string")
    plan = bias.kmer_depth_ratio(ref, depth, pairs)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert not any("start" in x for x in dealt) and sum("REPARTITION_BY_COL" in x for x in dealt) == 1
