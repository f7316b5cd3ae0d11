"""Ranks, quantiles, tails, tests, resampling and attributions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ampliskew.functions import ranks, special
from ampliskew.operators import dataset as ds
from ampliskew.operators import evaluate as ev
from ampliskew.operators import models as md
from ampliskew.operators import stats as st


def frame(n=400, seed=3):
    r = np.random.default_rng(seed)
    p = pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, "a", "hot"), "id": [f"r{i}" for i in range(n)], "x": np.round(r.normal(size=n), 1), "y": np.round(r.normal(size=n), 2)})
    p.loc[5:60, "x"] = 0.0
    return p


def test_average_ranks_and_quantiles(spark):
    p = frame()
    got = ranks.average_ranks(spark.createDataFrame(p), ["g"], {"x": "rx"}).toPandas().set_index("id").rx
    want = p.set_index("id").groupby("g").x.rank()
    assert (got.sort_index() == want.sort_index()).all()
    q = ranks.exact_quantiles(spark.createDataFrame(p), ["g"], "x", {"a": 0.1, "m": 0.5, "z": 1.0}).toPandas().set_index("g")
    for g, s in p.groupby("g").x:
        assert np.allclose(q.loc[g, ["a", "m", "z"]].astype(float), s.quantile([0.1, 0.5, 1.0]))


def test_ordered_positions_are_a_permutation(spark):
    p = ranks.ordered_positions(spark.createDataFrame(frame()), ["g"], "x", "id", "pos").toPandas()
    for _, s in p.groupby("g"):
        s = s.sort_values("pos")
        assert list(s.pos) == list(range(1, len(s) + 1)) and (np.diff(s.x) <= 0).all()


def test_tails():
    assert np.allclose(special.t_two_sided(np.array([2.228138852, 0.0, 12.7062]), np.array([10, 5, 1])), [0.05, 1.0, 0.05], atol=1e-6)


def test_spearman_matches_pandas(spark):
    p = frame()
    out = st.rank_corr(spark.createDataFrame(p).withColumn("feature", F.lit("f")), ["g", "feature"]).toPandas().set_index("g")
    for g, s in p.groupby("g"):
        assert math.isclose(out.loc[g, "spearman"], s.x.rank().corr(s.y.rank()), abs_tol=1e-9)


def test_mann_whitney_by_pairs(spark):
    p = frame()
    out = st.mw_shift(spark.createDataFrame(p), ["g"], ["x"]).where("contrast = 'pos_vs_neg'").toPandas().set_index("g")
    for g, s in p.groupby("g"):
        a, b = s.x[s.y > 0].to_numpy(), s.x[s.y < 0].to_numpy()
        d = np.sign(a[:, None] - b[None, :]).mean()
        assert math.isclose(out.loc[g, "cliff_delta"], d, abs_tol=1e-9) and math.isclose(out.loc[g, "median_a"], np.median(a)) and 0 <= out.loc[g, "p"] <= 1


def test_sparse_equals_dense(spark):
    rows = [("p1", f"s{i}", (i * 7) % 5, (i * 3) % 4, math.sin(i), i % 3) for i in range(40)]
    t = spark.createDataFrame(rows, "pair_id string, seq_id string, count_yes long, count_no long, log2fc double, x long")
    k = t.where("x > 0").select("seq_id", F.lit("k").alias("feature"), F.col("x").cast("double").alias("x"))
    dense = st.features_long(t, ["x"])
    a, b = st.sparse_kmer_stats(t, k).collect()[0], st.weighted_corr(dense).collect()[0]
    assert math.isclose(a.pearson_corr, b.pearson_corr, abs_tol=1e-9) and abs(a.pearson_corr) <= 1


def predictions():
    p = frame().rename(columns={"x": "y_true", "id": "row_id"})
    p["y_pred"], p["pair_id"] = p.y_true * 0.8 + p.y * 0.1, ["p%d" % (i % 7) for i in range(len(p))]
    p.loc[p.index[::5], "y_true"] = 1.0  # ties
    return p


def brute_metrics(p):
    y, q = p.y_true, p.y_pred
    return [1 - ((y - q) ** 2).sum() / ((y - y.mean()) ** 2).sum(), math.sqrt(((y - q) ** 2).mean()), (y - q).abs().mean(), np.corrcoef(y.rank(), q.rank())[0, 1]]


def test_replicates_equal_repeated_rows(spark):
    """A replicate's weights give what its rows give when they are written out."""
    p = predictions()
    d = spark.createDataFrame(p)
    for unit, draw in ((None, ev._drawn_rows), ("pair_id", ev._drawn_units), ("g", ev._drawn_rows)):
        got = ev._replicates(ev._points(d, ["g"], unit), ["g"], 260, 3, draw).toPandas()
        assert len(got) == 520 and sorted(got[got.g == "a"].b) == list(range(1, 261))
        for g, own in p.groupby("g"):
            own = own.assign(u=own[unit] if unit else "0").groupby(["u", "y_true", "y_pred"]).size().rename("c").reset_index().sort_values(["u", "y_true", "y_pred"])
            u = np.unique(own.u, return_inverse=True)[1]
            w = draw(ev._rng(3, g, 1), u, own.c.to_numpy(), 10)
            assert (w.sum(1) == own.c.sum()).all() or unit == "pair_id"
            for b in range(10):
                want = brute_metrics(own.loc[own.index.repeat(w[b])])
                row = got[(got.g == g) & (got.b == 251 + b)].iloc[0]
                assert np.allclose([row.r2, row.rmse, row.mae, row.spearman], want, atol=1e-9)


def test_bootstrap_means_and_large_groups(spark, monkeypatch):
    p = predictions()
    d = spark.createDataFrame(p)
    full = {r.g: r for r in ev.bootstrap_rows(d, ["g"], 600).collect()}
    for g, own in p.groupby("g"):
        want = brute_metrics(own)
        r = full[g]
        assert r.n_boot == 600 and r.spearman_ci_low < r.spearman_boot_mean < r.spearman_ci_high
        assert abs(r.rmse_boot_mean - want[1]) < 3 * r.rmse_boot_sd and abs(r.spearman_boot_mean - want[3]) < 3 * r.spearman_boot_sd
    again = {r.g: r for r in ev.bootstrap_rows(d.repartition(5), ["g"], 600).collect()}
    assert all(np.allclose(again[g][1:], full[g][1:], atol=1e-9) for g in full)
    monkeypatch.setattr(ev, "CELLS", 1 << 6)
    monkeypatch.setattr(ev, "STEPS", 64)
    cut = {r.g: r for r in ev.bootstrap_rows(d, ["g"], 600).collect()}
    for g, r in full.items():
        assert abs(cut[g].rmse_boot_mean - r.rmse_boot_mean) < r.rmse_boot_sd and abs(cut[g].spearman_boot_mean - r.spearman_boot_mean) < r.spearman_boot_sd
    for f in (ev.bootstrap_pairs, ev.bootstrap_stratified):
        for r in f(d, ["g"], 12).collect():
            assert r.n_boot == 12 and r.spearman_ci_low <= r.spearman_boot_mean <= r.spearman_ci_high


def test_permutations_keep_ranks_inside_pairs(spark, monkeypatch):
    p = predictions()
    d = spark.createDataFrame(p)
    null = ev.permutation_null(d, ["g"], 40).toPandas()
    assert len(null) == 80 and null.perm_spearman.abs().max() < 0.5
    for g, own in p.groupby("g"):
        assert abs(null[null.g == g].perm_spearman.mean()) < 4 * null[null.g == g].perm_spearman.std() / math.sqrt(40) + 0.1
    alone = ev.permutation_null(d, ["g"], 2, within="row_id").toPandas().set_index("g").perm_spearman
    for g, own in p.groupby("g"):  # pairs of one row can't be shuffled
        assert np.allclose(alone[g], brute_metrics(own)[3])
    monkeypatch.setattr(ev, "PERMUTED_ROWS", 10)
    assert ev.permutation_null(d, ["g"], 40).toPandas().perm_spearman.abs().max() < 0.6


def test_contributions_add_up(spark):
    p = frame()
    d = ds.assemble(spark.createDataFrame(p).withColumn("w", F.lit(1.0)).withColumn("z", F.col("x") * F.col("y")), ["x", "z"], "no_kmer")
    for model in (md.fit_rf(d, 3, 3), md.fit_gbt(d.withColumn("split", F.when(F.col("g") == "a", "val").otherwise("train")), 3, 3)):
        c, base = md.tree_contributions(model, model.transform(d), ["id", "prediction"])
        err = [abs(sum(r.contrib) + base - r.prediction) for r in c.collect()]
        assert max(err) < 1e-6


def test_splits_do_not_depend_on_partitioning(spark):
    d = spark.createDataFrame(frame())
    a = {r.id: r.split for r in ds.split_by_hash(d.repartition(7), "id").collect()}
    assert a == {r.id: r.split for r in ds.split_by_hash(d.coalesce(1), "id").collect()} and set(a.values()) == {"train", "val", "test"}


@pytest.mark.parametrize("rows", [ranks.TASK_ROWS, 10])
def test_ranks_of_narrow_tiny_and_tied_values(spark, monkeypatch, rows):
    """In whole groups and in cells. Cells follow the data's scale: no cell holds more than a small share of any of these groups."""
    monkeypatch.setattr(ranks, "TASK_ROWS", rows)
    r = np.random.default_rng(1)
    n = 4000
    values = {"tiny": r.uniform(0, 1e-9, n), "times": 1.7e9 + r.integers(0, 1_000_000, n), "negative": -np.exp(r.normal(size=n) * 20), "unit": r.uniform(size=n), "tied": np.where(np.arange(n) % 10 < 9, 1.0, r.normal(size=n))}
    p = pd.concat([pd.DataFrame({"g": k, "id": [f"{k}{i}" for i in range(n)], "x": v}) for k, v in values.items()])
    df = spark.createDataFrame(p)
    got = ranks.average_ranks(df, ["g"], {"x": "rx"}).toPandas().set_index("id").rx.sort_index()
    assert (got == p.set_index("id").groupby("g").x.rank().sort_index()).all()
    pos = ranks.ordered_positions(df, ["g"], "x", "id", "pos").toPandas()
    for _, s in pos.groupby("g"):
        s = s.sort_values("pos")
        assert list(s.pos) == list(range(1, n + 1)) and (np.diff(s.x) <= 0).all()
    cell, part = ranks.value_cells("x")
    most = df.select("g", "x").distinct().groupBy("g", cell.alias("a"), part.alias("b")).count().groupBy("g").agg(F.max("count").alias("m")).toPandas().set_index("g").m
    assert (most <= n // 100).all()


def test_cells_are_monotone(spark):
    x = sorted([0.0, -0.0, 1.0, -1.0, 1e300, -1e300, 5e-324, -5e-324, float("inf"), float("-inf"), 2.0, np.nextafter(2.0, 0), np.nextafter(2.0, 3), 1.7e9, 1.7e9 + 1, 0.1, 0.1 + 1e-9])
    a, b = ranks.value_cells("x")
    got = [tuple(r) for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", a, b).orderBy("i").select("*").collect()]
    assert [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_kmer_only_keeps_rows_without_words(spark):
    df = spark.createDataFrame([("s1", 1.0), ("s2", 2.0)], "seq_id string, y double")
    k = spark.createDataFrame([("s1", "k2_head30_AC", 3.0)], "seq_id string, feature string, x double")
    for variant in ("kmer_only_all", "kmer_only_k2", "all"):
        got = {r.seq_id: r.features for r in ds.assemble(df, [], variant, k, ["k2_head30_AC", "k2_tail30_GC"]).collect()}
        assert got["s1"].toArray().tolist() == [3.0, 0.0] and got["s2"].toArray().tolist() == [0.0, 0.0]
        assert got["s2"].numNonzeros() == 0


def test_fused_statistics_equal_separate_ones(spark):
    p = frame().rename(columns={"y": "log2fc", "g": "pair_id"})
    p["feature"], p["count_yes"], p["count_no"], p["w"] = "f", np.arange(len(p)) % 7, np.arange(len(p)) % 5, 1.0 + np.arange(len(p)) % 3
    long = spark.createDataFrame(p)
    pairs = spark.createDataFrame([("a", "s", 1, "12S", "y", "n"), ("hot", "s", 1, "16S", "y", "n")], "pair_id string, species string, n_individuals int, locus string, yes_file_id string, no_file_id string")
    one = st.joint_rank(st.pair_statistics(long), None, pairs).toPandas()
    two = st.joint_rank(st.weighted_corr(long), st.weighted_shift(long, pairs), pairs).toPandas()
    key = ["group_type", "group_value", "feature"]
    pd.testing.assert_frame_equal(one.sort_values(key).reset_index(drop=True), two.sort_values(key).reset_index(drop=True))


@pytest.mark.parametrize("bound,rows_a_task", [(100_000, 10**6), (0, 10**6), (0, 100)])
def test_join_facts_keeps_rows(spark, monkeypatch, bound, rows_a_task):
    """Broadcast, plain and salted."""
    from ampliskew.functions import joins
    monkeypatch.setattr(joins, "FACTS", bound)
    monkeypatch.setattr(joins, "TASK_ROWS", rows_a_task)
    rows = spark.range(1000).select((F.col("id") % 3).alias("s"), "id")
    facts = spark.createDataFrame([(0, "a"), (1, "b")], "s long, v string")
    got = {(r.id, r.v) for r in joins.join_facts(rows, facts, "s", "id").collect()}
    assert got == {(i, "ab"[i % 3]) for i in range(1000) if i % 3 < 2}
    assert joins.join_facts(rows, facts, "s", "id", "left").count() == 1000



def test_capped_rows_are_those_of_smallest_hash(spark):
    """Strata below, at and above their cap, a cap of nothing, uncapped splits, and many rows inside one hash bin."""
    from hashlib import md5
    rows = [(g, split, f"{g}{split}{i}") for g, n in (("a", 5), ("b", 40), ("hot", 900)) for split in ("train", "val", "test") for i in range(n)] + [("b", "train", "bval0")] * 3
    df = spark.createDataFrame(rows, "g string, split string, id string")
    caps = {"train": 40, "val": 0}
    key = lambda i: (md5(f"1|{i}".encode()).hexdigest()[:8], md5(i.encode()).hexdigest(), i)
    want = []
    for g in ("a", "b", "hot"):
        for split in ("train", "val", "test"):
            own = sorted((i for a, b, i in rows if (a, b) == (g, split)), key=key)
            want += [(g, split, i) for i in own[:caps.get(split, len(own))]]
    got = sorted(map(tuple, ds.cap_rows(df, ["g"], caps, "id").collect()))
    assert got == sorted(want) and ds.cap_rows(df.limit(0), ["g"], caps, "id").count() == 0
    assert ds.cap_rows(df, ["g"], {}, "id").count() == len(rows)


def test_metrics_of_whole_and_cut_groups(spark, monkeypatch):
    p = predictions()
    d = spark.createDataFrame(p)
    whole = ev.regression_metrics(d, ["g"]).orderBy("g").toPandas()
    for (g, own), (_, row) in zip(p.groupby("g"), whole.iterrows()):
        assert np.allclose([row.r2, row.rmse, row.mae, row.spearman], brute_metrics(own))
    monkeypatch.setattr(ranks, "TASK_ROWS", 10)
    pd.testing.assert_frame_equal(ev.regression_metrics(d, ["g"]).orderBy("g").toPandas(), whole)
