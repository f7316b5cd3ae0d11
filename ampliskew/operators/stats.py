"""Feature statistics (H01-H25). Long tables hold one row per (row, feature): keys, feature, x, y and weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_facts
from ..functions.cols import c, finite, number, ratio
from ..functions.ranks import average_ranks, cumulate, exact_quantiles, histogram_quantiles, top_per_group
from ..functions.special import corr_p, normal_two_sided
from ..functions.words import Rolled, spelled
from ..session import keep

PAIR_META = ["pair_id", "species", "n_individuals", "locus", "yes_file_id", "no_file_id"]


def features_long(training: DataFrame, features: list[str], keep: list[str] | None = None, min_weight: float = 1.0) -> DataFrame:
    """One row per feature value that parses as a number; weight = count_yes + count_no."""
    keep = keep or [x for x in training.columns if x not in features]
    w = F.col("count_yes") + F.col("count_no")
    wide = training.where(w >= min_weight).select(*keep, *[number(x).alias(x) for x in features])
    return wide.unpivot(keep, features, "feature", "x").where(F.col("x").isNotNull()).withColumn("w", (F.col("count_yes") + F.col("count_no")).cast("double"))


def weighted_corr(long: DataFrame, y: str = "log2fc") -> DataFrame:
    """Weighted Pearson per pair and feature from moments (one map-side combined groupBy); 0 without variance."""
    m = long.groupBy("pair_id", "feature").agg(*_corr_moments(y))
    return m.select("pair_id", "feature", "n", "w_sum", _moment_corr("w_sum", "_x", "_xx", "_y", "_yy", "_xy").alias("pearson_corr"))


def _corr_moments(y: str) -> list[Column]:
    w, x, yy = F.col("w"), F.col("x"), F.col(y)
    return [F.count(F.lit(1)).alias("n"), F.sum(w).alias("w_sum"), F.sum(w * yy).alias("_y"), F.sum(w * yy * yy).alias("_yy"),
            F.sum(w * x).alias("_x"), F.sum(w * x * x).alias("_xx"), F.sum(w * x * yy).alias("_xy")]


def _moment_corr(w, sx, sxx, sy, syy, sxy) -> Column:
    w, sx, sxx, sy, syy, sxy = (F.col(v) for v in (w, sx, sxx, sy, syy, sxy))
    mx, my = sx / w, sy / w
    vx, vy = sxx / w - mx * mx, syy / w - my * my
    return F.when((vx > 0) & (vy > 0), (sxy / w - mx * my) / F.sqrt(vx * vy)).otherwise(0.0)


def _sign_cons(frac: Column) -> Column:
    return 2 * F.abs(frac - 0.5)


def _corr_aggs():
    r = F.col("pearson_corr")
    return [F.count(r).alias("n_pairs_corr"), F.avg(F.abs(r)).alias("mean_abs_corr"), F.median(F.abs(r)).alias("median_abs_corr"),
            F.try_divide(F.count(F.when(r > 0, 1)), F.count(r)).alias("frac_pos_corr")]


def meta_corr(corr: DataFrame) -> DataFrame:
    """Per feature over pairs. Groups hold one row per pair, so the exact median is small."""
    m = corr.groupBy("feature").agg(*_corr_aggs())
    return m.withColumn("stability_score", F.col("mean_abs_corr") * _sign_cons(F.col("frac_pos_corr"))).withColumnRenamed("n_pairs_corr", "n_pairs")


def top_features(meta: DataFrame, by: str = "stability_score", n: int = 200, min_pairs: int = 1) -> DataFrame:
    """H04."""
    return meta.where(F.col("n_pairs") >= min_pairs).orderBy(F.desc(by), "feature").limit(n)


def weighted_shift(long: DataFrame, pairs: DataFrame, min_count: int = 1) -> DataFrame:
    """Weighted mean and population deviation of a feature on either side, difference and effect size."""
    m = long.groupBy("pair_id", "feature").agg(*_side_moments("count_yes", "y", min_count), *_side_moments("count_no", "n", min_count))
    return _shift_columns(m.fillna(0.0, ["wy", "wn"]), pairs)


def _side_moments(cnt: str, p: str, min_count: int) -> list[Column]:
    w = F.when(F.col(cnt) >= min_count, F.col(cnt).cast("double"))
    return [F.sum(w).alias(f"w{p}"), F.sum(w * F.col("x")).alias(f"_s{p}"), F.sum(w * F.col("x") * F.col("x")).alias(f"_q{p}"), F.count(w).alias(f"n{p}_rows")]


def pair_statistics(long: DataFrame, y: str = "log2fc", min_count: int = 1) -> DataFrame:
    """H02 and H05 together: the moments of both come from one scan and one groupBy."""
    m = long.groupBy("pair_id", "feature").agg(*_corr_moments(y), *_side_moments("count_yes", "y", min_count), *_side_moments("count_no", "n", min_count))
    m = m.withColumn("pearson_corr", _moment_corr("w_sum", "_x", "_xx", "_y", "_yy", "_xy")).drop("_x", "_xx", "_y", "_yy", "_xy")
    return _shift_columns(m.fillna(0.0, ["wy", "wn"]), None)


def _shift_columns(m: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """wy, _sy, _qy, wn, _sn, _qn -> means, deviations, delta and effect_d (NULL where a side is empty)."""
    m = m.withColumns({"mean_yes": ratio("_sy", "wy"), "mean_no": ratio("_sn", "wn")})
    var = lambda p, mean: F.greatest(ratio(f"_q{p}", f"w{p}") - F.col(mean) * F.col(mean), F.lit(0.0))
    m = m.withColumns({"_vy": F.when(F.col("wy") > 0, var("y", "mean_yes")), "_vn": F.when(F.col("wn") > 0, var("n", "mean_no"))})
    pooled = F.sqrt((F.col("_vy") + F.col("_vn")) / 2)
    m = m.withColumns({"delta_yes_minus_no": F.col("mean_yes") - F.col("mean_no"), "sd_yes": F.sqrt("_vy"), "sd_no": F.sqrt("_vn"), "_p": pooled})
    m = m.withColumn("effect_d", F.when(F.col("_p") > 0, F.col("delta_yes_minus_no") / F.col("_p")))
    m = m.drop("_sy", "_qy", "_sn", "_qn", "_vy", "_vn", "_p")
    return m.join(pairs.select(*PAIR_META), "pair_id", "left") if pairs is not None else m


def _shift_aggs():
    d, e = F.col("delta_yes_minus_no"), F.col("effect_d")
    return [F.count(d).alias("n_pairs_shift"), F.median(d).alias("median_delta"), F.avg(F.abs(d)).alias("mean_abs_delta"),
            F.try_divide(F.count(F.when(d > 0, 1)), F.count(d)).alias("frac_pos_delta"), F.median(F.abs(e)).alias("median_abs_effect_d")]


def meta_shift(shift: DataFrame) -> DataFrame:
    """H06."""
    return shift.where(F.col("delta_yes_minus_no").isNotNull()).groupBy("feature").agg(*_shift_aggs()).withColumnRenamed("n_pairs_shift", "n_pairs")


def infer_delta(df: DataFrame) -> DataFrame:
    """Delta and effect from whichever columns a table brings."""
    have = lambda names: [number(x) for x in names if x in df.columns]
    delta = have(["delta_yes_minus_no", "delta", "delta_yes_no"])
    if {"mean_yes", "mean_no"} <= set(df.columns):
        delta.append(number("mean_yes") - number("mean_no"))
    eff = have(["effect_d", "cohen_d", "d"])
    none = F.lit(None).cast("double")
    return df.withColumns({"delta_yes_minus_no": F.coalesce(*delta, none), "effect_d": F.coalesce(*eff, none)})


def joint_rank(corr: DataFrame, shift: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """Correlation and shift summaries per feature, overall and per locus, ranked by the stable joint score.

    Without ``shift`` the first table holds both (``pair_statistics``); two tables are summed up in one groupBy too.
    """
    none = F.lit(None).cast("double")
    parts = ["pair_id", "feature", "pearson_corr", "delta_yes_minus_no", "effect_d"]
    if shift is None:
        both = infer_delta(corr).select(*parts)
    else:
        both = (corr.select("pair_id", "feature", "pearson_corr").withColumns({"delta_yes_minus_no": none, "effect_d": none})
                .unionByName(infer_delta(shift).select("pair_id", "feature", none.alias("pearson_corr"), "delta_yes_minus_no", "effect_d")))
    both = both.withColumns({"pearson_corr": finite("pearson_corr"), "effect_d": F.when(F.col("delta_yes_minus_no").isNotNull(), F.col("effect_d"))})
    both = join_facts(both, pairs.select("pair_id", "locus"), "pair_id", "feature")
    sets = [["feature"], ["locus", "feature"]]
    j = both.groupingSets([[F.col(x) for x in s] for s in sets], F.col("locus"), F.col("feature")).agg(*_corr_aggs(), *_shift_aggs(), F.grouping("locus").alias("_g"))
    j = (j.where("n_pairs_corr > 0 AND n_pairs_shift > 0").withColumn("group_type", F.when(F.col("_g") == 1, "ALL").otherwise("locus"))
         .withColumn("group_value", F.when(F.col("_g") == 1, "ALL").otherwise(F.coalesce("locus", F.lit("ALL")))).drop("_g", "locus"))
    j = j.withColumns({"sign_cons_corr": _sign_cons(F.col("frac_pos_corr")), "sign_cons_delta": _sign_cons(F.col("frac_pos_delta"))})
    j = j.withColumns({"stability_corr": F.col("mean_abs_corr") * F.col("sign_cons_corr"), "joint_strength": F.col("mean_abs_corr") * F.col("mean_abs_delta"),
                       "joint_stable": F.col("mean_abs_corr") * F.col("sign_cons_corr") * F.col("mean_abs_delta") * F.col("sign_cons_delta")})
    w = Window.partitionBy("group_type", "group_value").orderBy(F.desc(F.round("joint_stable", 12)), "feature")
    return j.withColumn("rank", F.row_number().over(w))


def sparse_kmer_stats(training: DataFrame, kmers: DataFrame) -> DataFrame:
    """Correlation and shift of k-mer counts with the zeros left implicit.

    Feature moments come from the rows where the k-mer occurs, base moments from all rows of the pair; together
    they equal the statistics on the dense table. ``kmers``: seq_id, feature, x.
    """
    t = training.select("pair_id", "seq_id", F.col("log2fc").alias("y"), F.col("count_yes").cast("double").alias("cy"),
                        F.col("count_no").cast("double").alias("cn")).withColumn("w", F.col("cy") + F.col("cn")).where("w > 0")
    w, y, x = F.col("w"), F.col("y"), F.col("x")
    base = t.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_points"), F.sum(w).alias("w_sum"), F.sum(w * y).alias("_y"), F.sum(w * y * y).alias("_yy"),
                                    F.sum("cy").alias("wy"), F.sum("cn").alias("wn"))
    f = t.join(kmers.select("seq_id", "feature", "x"), "seq_id").groupBy("pair_id", "feature").agg(
        F.sum(w * x).alias("_x"), F.sum(w * x * x).alias("_xx"), F.sum(w * x * y).alias("_xy"), F.sum(F.col("cy") * x).alias("_sy"),
        F.sum(F.col("cy") * x * x).alias("_qy"), F.sum(F.col("cn") * x).alias("_sn"), F.sum(F.col("cn") * x * x).alias("_qn"))
    return _sparse_columns(f, base)


def _sparse_columns(f: DataFrame, base: DataFrame) -> DataFrame:
    j = join_facts(f, base, "pair_id", "feature").withColumn("pearson_corr", _moment_corr("w_sum", "_x", "_xx", "_y", "_yy", "_xy")).drop("_x", "_xx", "_y", "_yy", "_xy")
    return _shift_columns(j, None)


#: Rows whose words are added up together, and sums that a task holds before it hands them on.
TOGETHER, HELD_SUMS = 2000, 8_000_000


def sequence_kmer_stats(training: DataFrame, catalog: DataFrame, k: int, scope: str = "all", seq: str = "sequence", w: int = 30) -> DataFrame:
    """H09 straight from sequences: ``sparse_kmer_stats`` of their words of length ``k``. ``catalog``: one row a sequence.

    Rows meet their sequence, not its words: a batch's sequences are cut once and each task adds up moments of all (pair,
    word), so neither words nor rows by word are shuffled, and the moments of all rows of a pair come from the same pass.
    """
    cy, cn = F.col("count_yes").cast("double"), F.col("count_no").cast("double")
    t = training.where(cy + cn > 0).where("pair_id IS NOT NULL").select("pair_id", "seq_id", F.coalesce(F.col("log2fc").cast("double"), F.lit(0.0)).alias("y"), cy.alias("cy"), cn.alias("cn"))
    src = t.join(catalog.select("seq_id", F.col(seq).alias("_s")), "seq_id", "left").select("pair_id", "_s", "y", "cy", "cn")
    sums, size = [f"a{i}" for i in range(7)], 4**k
    kind = src.schema["pair_id"].dataType.simpleString()
    base_of, word_of = ["w_sum", "_y", "_yy", "wy", "wn"], ["_x", "_xx", "_xy", "_sy", "_qy", "_sn", "_qn"]

    def out(bases, held, odd, pair_type):
        lines = [(p, None, v) for p, v in bases.items()] + [(p, x, v) for (p, x), v in odd.items()]
        for p, v in held.items():
            at = np.flatnonzero(v[0])
            lines += zip([p] * len(at), spelled(k).take(pa.array(at)).to_pylist(), v[:, at].T)
        values = np.stack([v for *_, v in lines]) if lines else np.zeros((0, 8))
        return pa.RecordBatch.from_arrays([pa.array([p for p, *_ in lines], pair_type), pa.array([x for _, x, _ in lines], pa.string()), pa.array(values[:, 0].astype("i8")),
                                           *(pa.array(values[:, i]) for i in range(1, 8))], ["pair_id", "feature", "n", *sums])

    def run(batches):
        bases, held, odd, pair_type = {}, {}, {}, None
        for whole in batches:
            pair_type = whole.schema.field(0).type
            for a in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(a, TOGETHER)
                pairs, texts = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
                names, pair = pairs.dictionary.to_pylist(), pairs.indices.to_numpy().astype("i8")
                y, cy, cn = (b.column(i).to_numpy() for i in (2, 3, 4))
                total = cy + cn
                zero = np.zeros(len(y))
                by_pair = np.stack([np.bincount(pair, v, len(names)) for v in (np.ones(len(y)), total, total * y, total * y * y, cy, cn, zero, zero)], 1)
                owner, word, times, others = Rolled(texts.dictionary, w).counted(k, scope)
                rare = sorted({x for _, x in others})
                if rare:
                    owner, word, times = (np.append(v, z) for v, z in ((owner, [o for o, _ in others]), (word, [size + rare.index(x) for _, x in others]), (times, list(others.values()))))
                    order = np.argsort(owner, kind="stable")
                    owner, word, times = owner[order], word[order], times[order]
                length = np.bincount(owner, minlength=len(texts.dictionary) + 1)
                row = texts.indices.fill_null(len(texts.dictionary)).to_numpy()  # without a sequence: no words
                many, width = length[row], size + len(rare)
                at = np.arange(many.sum()) + np.repeat((np.cumsum(length) - length)[row] - (np.cumsum(many) - many), many)
                cell, x = np.repeat(pair, many) * width + word[at], times[at].astype("f8")
                add = lambda v: np.bincount(cell, v, len(names) * width)
                wx, yx, nx = (np.repeat(v, many) * x for v in (total, cy, cn))
                got = np.stack([np.bincount(cell, minlength=len(names) * width), add(wx), add(wx * x), add(wx * np.repeat(y, many)), add(yx), add(yx * x), add(nx), add(nx * x)]).reshape(8, len(names), width)
                for i, p in enumerate(names):
                    bases[p] = bases[p] + by_pair[i] if p in bases else by_pair[i]
                    held[p] = held[p] + got[:, i, :size] if p in held else got[:, i, :size].copy()
                    for j in np.flatnonzero(got[0, i, size:]).tolist():
                        odd[p, rare[j]] = odd.get((p, rare[j]), 0.0) + got[:, i, size + j]
                if (len(held) * size + len(odd)) * 8 > HELD_SUMS:
                    yield out(bases, held, odd, pair_type)
                    bases, held, odd = {}, {}, {}
        if pair_type is not None:
            yield out(bases, held, odd, pair_type)

    lines = src.mapInArrow(run, f"pair_id {kind}, feature string, n long, {', '.join(f'{x} double' for x in sums)}")
    lines = keep(lines.groupBy("pair_id", "feature").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in sums]))
    base = lines.where("feature IS NULL").select("pair_id", F.col("n").alias("n_points"), *[F.col(x).alias(z) for x, z in zip(sums, base_of)])
    return _sparse_columns(lines.where("feature IS NOT NULL").select("pair_id", "feature", *[F.col(x).alias(z) for x, z in zip(sums, word_of)]), base)


def merge_stats(a: DataFrame, b: DataFrame, prefer: str = "second", include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Union of two tables by (pair_id, feature); on both, the preferred one stays."""
    first, second = (0, 1) if prefer == "first" else (1, 0)
    u = a.withColumn("_o", F.lit(first)).unionByName(b.withColumn("_o", F.lit(second)), allowMissingColumns=True)
    if include:
        u = u.where(F.col("feature").rlike(include))
    if exclude:
        u = u.where(~F.col("feature").rlike(exclude))
    return top_per_group(u, ["pair_id", "feature"], ["_o"], 1).drop("_o")


def feature_type(f="feature") -> Column:
    """H11."""
    f = c(f)
    return F.when(f.rlike("^k[0-9]+_"), "kmer").when(f.startswith("feat_pr_"), "primer").when(f.startswith("feat_"), "seq_global").otherwise("other")


def feature_group(f="feature") -> Column:
    f = c(f)
    return F.when(f.startswith("feat_pr_") | f.startswith("primer_"), "primer").when(
        f.startswith("kmer_") | f.startswith("km_") | f.contains("kmer"), "kmer").otherwise("nonprimer")


def feature_category(f="feature") -> Column:
    """Finer classes, first match wins."""
    f, low = c(f), F.lower(c(f))
    has = lambda words: low.rlike("|".join(words))
    return (F.when(f.startswith("feat_pr_") | f.startswith("primer_"), "primer")
            .when(f.rlike("^k[1-8]_(head30|tail30|mid[0-9]+)_[ACGT]{1,8}$"), "kmer").when(low.contains("gc"), "gc")
            .when(has(["entropy", "dust", "lz", "lingcomp"]), "complexity").when(f.startswith("feat_di_") | has(["cpg", "upa"]) | f.startswith("feat_p"), "composition")
            .when(has(["run", "tandem", "rep", "pal_"]), "repeats_pal").when(has(["mfe", "hairpin", "stem", "loop", "tm"]), "structure_tm")
            .when(has(["g4", "zdna"]), "alt_struct").otherwise("other"))


def type_counts(joint: DataFrame) -> DataFrame:
    return joint.groupBy("group_type", "group_value", feature_type().alias("feature_type")).agg(F.count(F.lit(1)).alias("n_features"))


def export_top(joint: DataFrame, n: int, kinds=("kmer", "primer", "seq_global", "other")) -> DataFrame:
    """First n features per group and type by rank."""
    j = joint.withColumn("feature_type", feature_type()).where(F.col("feature_type").isin(*kinds))
    return top_per_group(j, ["group_type", "group_value", "feature_type"], ["rank", "feature"], n)


def merge_features(tables: list[DataFrame], keys=("seq_id", "marker")) -> DataFrame:
    """Full outer merge of feature tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, list(keys), "full")
    return out


def feature_qc(df: DataFrame, features: list[str], keys=("threshold_label",)) -> DataFrame:
    """Features whose every non-blank value is a number, per threshold."""
    ok = [(F.count(number(f)) == F.count(F.nullif(F.col(f).cast("string"), F.lit("")))).cast("int").alias(f) for f in features]
    return df.groupBy(*keys).agg(*ok).select(*keys, sum((F.col(f) for f in features), F.lit(0)).alias("n_numeric_features"))


def species_features(df: DataFrame, features: list[str], weight: str = "relative_abundance_renorm") -> DataFrame:
    """Weighted mean per species and sample; rows without a value leave the weight too."""
    by = ["threshold_label", "sample_id", "marker", "group_name", "species_label"]
    w = F.col(weight)
    aggs = [ratio(F.sum(w * number(f)), F.sum(F.when(number(f).isNotNull(), w))).alias(f) for f in features]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sequences_in_species"), F.sum("count").alias("species_total_count_retained"), *aggs)


def haplotype_rank(df: DataFrame) -> DataFrame:
    """Position by share inside sample and threshold, dominant and tail flags."""
    from ..functions.ranks import ordered_positions
    f = df.where((F.col("sample_type") == "intra_mix") & (F.lower("is_core_analysis") == "yes"))
    r = ordered_positions(f, ["threshold_label", "sample_id"], "relative_abundance_renorm", "seq_id", "dominant_rank")
    return r.withColumns({"dominant_flag": (F.col("dominant_rank") == 1).cast("int"), "tail_flag": (F.col("dominant_rank") > 1).cast("int")})


def tail_vs_dom() -> Column:
    """H17."""
    return F.when(F.col("dominant_flag") == 1, F.col("relative_abundance_renorm")).otherwise(-F.col("relative_abundance_renorm"))


def rank_corr(long: DataFrame, keys: list[str], x: str = "x", y: str = "y", min_n: int = 3) -> DataFrame:
    """keys, n, Spearman (average ranks) and Pearson over rows with both values; NULL when a side is constant."""
    d = long.select(*keys, finite(x).alias("x"), finite(y).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    r = average_ranks(keep(d), keys, {"x": "rx", "y": "ry"})
    varies = lambda v: F.min(v) < F.max(v)
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(varies("x") & varies("y"), F.corr("rx", "ry")).alias("spearman"),
                                F.when(varies("x") & varies("y"), F.corr("x", "y")).alias("pearson")).where(F.col("n") >= min_n)


def univariate_stats(long: DataFrame, keys: list[str], min_n: int = 6) -> DataFrame:
    """Spearman and standardised OLS slope per feature with BH correction inside the stratum.

    On z-scores the slope is the Pearson correlation; a constant side gives slope 0.
    """
    s = rank_corr(long, [*keys, "feature"], min_n=min_n)
    s = s.withColumn("std_beta", F.coalesce("pearson", F.lit(0.0)))
    s = s.select(*keys, "feature", "n", F.col("spearman").alias("spearman_rho"), corr_p("spearman", "n").alias("spearman_p"), "std_beta",
                 corr_p("pearson", "n").alias("beta_p"), (F.col("std_beta") * F.col("std_beta")).alias("r2"))
    return bh_fdr(bh_fdr(s, "spearman_p", keys, "spearman_fdr", null_as_one=True), "beta_p", keys, "beta_fdr", null_as_one=True)


def bh_fdr(df: DataFrame, p: str, keys: list[str], out: str = "q", null_as_one: bool = False) -> DataFrame:
    """Benjamini-Hochberg inside ``keys``; a stratum holds one row per feature.

    NULL p counts as 1 in the mixture branch and stays NULL, outside the family, in the paired branch.
    """
    pv = F.coalesce(p, F.lit(1.0)) if null_as_one else F.col(p)
    d = df.withColumn("_p", pv)
    fam = Window.partitionBy(*keys, F.col("_p").isNull())
    d = d.withColumn("_m", F.count(F.lit(1)).over(fam)).withColumn("_r", F.rank().over(fam.orderBy("_p")) + F.count(F.lit(1)).over(
        Window.partitionBy(*keys, "_p")) - 1)
    run = fam.orderBy(F.desc("_p")).rangeBetween(Window.unboundedPreceding, 0)
    return d.withColumn(out, F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), F.min(F.col("_p") * F.col("_m") / F.col("_r")).over(run)))).drop("_p", "_m", "_r")


# Feature groups of the signal summary.
SIGNAL_GROUPS = {
    "mismatch": ["mismatch_fwd_total", "mismatch_rev_total", "mismatch_total", "mismatch_weighted_score", "mismatch_3prime_total"],
    "global": ["len_global", "gc_global", "at_skew_global", "gc_skew_global", "entropy_global", "lz_global", "homopolymer_max_global"],
    "rnafold": ["mfe_global", "mfe_head", "mfe_mid1", "mfe_mid2", "mfe_mid3", "mfe_tail"]}
REGIONAL = "^(gc|entropy|lz|homopolymer_max)_(head|mid|tail)"


def top_signals(stats: DataFrame, n: int = 20, groups: dict | None = None) -> DataFrame:
    """Best n per data level and feature group (a feature may belong to several groups)."""
    f = F.col("feature")
    tags = [F.when(f.isin(v), k) for k, v in (groups or SIGNAL_GROUPS).items()]
    tags += [F.when(f.rlike(REGIONAL), "regional"), F.when(f.startswith("motif_"), "motif")]
    d = stats.withColumn("feature_group", F.explode(F.array_compact(F.array(*tags))))
    return top_per_group(d, ["data_level", "feature_group"], [F.asc_nulls_last("beta_fdr"), F.asc_nulls_last("spearman_fdr"),
                                                             F.desc_nulls_last("std_beta"), "strata", "feature"], n)


def external_corr(long: DataFrame, keys=("compare_id",), min_rows: int = 500, min_n: int = 20) -> DataFrame:
    """Per comparison and feature; NULL below ``min_n`` values or when constant; small comparisons are left out."""
    keys = list(keys)
    s = rank_corr(long, [*keys, "feature"], min_n=1)
    big = long.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.max("_n").alias("_n")).where(F.col("_n") >= min_rows)
    ok = lambda v: F.when(F.col("n") >= min_n, F.col(v))
    s = s.join(big.select(*keys), keys, "left_semi").select(*keys, "feature", "n", ok("spearman").alias("spearman_r"), ok("pearson").alias("pearson_r"))
    return s.withColumns({"spearman_p": corr_p("spearman_r", "n"), "pearson_p": corr_p("pearson_r", "n")})


def pairs_overview(training: DataFrame, keys=("compare_id", "dataset", "exp_yes", "exp_no")) -> DataFrame:
    """H19."""
    return training.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def topbottom_shift(training: DataFrame, features: list[str], n: int = 200, key: str = "compare_id", y: str = "log2fc", min_rows: int = 500) -> DataFrame:
    """The n highest and n lowest rows per comparison; means, medians and Cohen's d (sample variance)."""
    big = training.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select(key)
    t = training.join(big, key, "left_semi").select(key, "seq_id", y, *features)
    top = top_per_group(t, [key], [F.desc(y), F.desc("seq_id")], n).withColumn("_s", F.lit("pos"))
    low = top_per_group(t, [key], [F.asc(y), F.asc("seq_id")], n).withColumn("_s", F.lit("neg"))
    long = top.unionByName(low).unpivot([key, "_s"], features, "feature", "x").withColumn("x", finite("x"))
    side = lambda s: F.when(F.col("_s") == s, F.col("x"))
    g = long.groupBy(key, "feature").agg(*[f(side(s)).alias(f"{name}_{s}") for s in ("pos", "neg") for name, f in
                                           (("n", F.count), ("mean", F.avg), ("median", F.median), ("_v", F.var_samp))])
    pool = ((F.col("n_pos") - 1) * F.col("_v_pos") + (F.col("n_neg") - 1) * F.col("_v_neg")) / F.greatest(F.lit(1), F.col("n_pos") + F.col("n_neg") - 2)
    return g.withColumns({"delta_mean": F.col("mean_pos") - F.col("mean_neg"), "delta_median": F.col("median_pos") - F.col("median_neg"),
                          "cohen_d": F.when((F.col("n_pos") >= 5) & (F.col("n_neg") >= 5) & (pool > 0), (F.col("mean_pos") - F.col("mean_neg")) / F.sqrt(pool))
                          }).drop("_v_pos", "_v_neg")


def feature_assoc(long: DataFrame, keys: list[str]) -> DataFrame:
    """Spearman with p and q, moments and missing rate per feature; ``long`` may hold NULL or NaN x."""
    s = rank_corr(long, [*keys, "feature"], min_n=1).drop("pearson")
    m = long.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(finite("x")).alias("mean"), F.stddev_pop(finite("x")).alias("sd"),
                                           (1 - F.count(finite("x")) / F.count(F.lit(1))).alias("missing_rate"))
    d = m.join(s, [*keys, "feature"], "left").withColumnRenamed("spearman", "rho").withColumn("p", corr_p("rho", "n"))
    return bh_fdr(d, "p", keys, "q").withColumns({"group": feature_group(), "category": feature_category()})


def top_assoc(assoc: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """H21."""
    return top_per_group(assoc, keys, [F.desc_nulls_last(F.abs(F.round("rho", 12))), "feature"], n, out="rank")


def mw_shift(wide: DataFrame, keys: list[str], features: list[str], y: str = "y", min_side: int = 20) -> DataFrame:
    """Y > 0 against y < 0 and top against bottom decile: medians, Mann-Whitney p, Cliff's delta, q."""
    q = exact_quantiles(wide, keys, y, {"_lo": 0.1, "_hi": 0.9}).drop("n")
    s = lambda cond, contrast, side: F.when(cond, F.struct(F.lit(contrast).alias("contrast"), F.lit(side).alias("side")))
    v = F.col(y)
    sides = F.array_compact(F.array(s(v > 0, "pos_vs_neg", "A"), s(v < 0, "pos_vs_neg", "B"),
                                    s(v >= F.col("_hi"), "top10_vs_bottom10", "A"), s(v <= F.col("_lo"), "top10_vs_bottom10", "B")))
    d = wide.join(q, keys).select(*keys, *[finite(f).alias(f) for f in features], F.explode(sides).alias("_c")).select(*keys, *features, "_c.*")
    d = d.unpivot([*keys, "contrast", "side"], features, "feature", "x").where(F.col("x").isNotNull())
    g = [*keys, "contrast", "feature"]
    n_side = keep(d.groupBy(*g, "side", "x").agg(F.count(F.lit(1)).alias("_n")))   # ties collapse map-side; all below works on counts
    pool = n_side.groupBy(*g, "x").agg(F.sum("_n").alias("_n"), F.sum(F.when(F.col("side") == "A", F.col("_n")).otherwise(0)).alias("_na"))
    h = cumulate(pool, g, ["x"])
    t = F.col("_n").cast("double")
    u = h.groupBy(*g).agg(F.sum("_na").alias("n_a"), (F.sum("_n") - F.sum("_na")).alias("n_b"),
                          F.sum(F.col("_na") * (F.col("_below") + (t + 1) / 2)).alias("_r1"), F.sum(t * t * t - t).alias("_t"))
    m = histogram_quantiles(cumulate(n_side, [*g, "side"], ["x"]), [*g, "side"], "x", {"m": 0.5})
    isA = F.col("side") == "A"
    med = m.groupBy(*g).agg(F.max(F.when(isA, F.col("m"))).alias("median_a"), F.max(F.when(~isA, F.col("m"))).alias("median_b"))
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = a + b
    U = F.col("_r1") - a * (a + 1) / 2
    sigma = F.sqrt(a * b / 12 * ((n + 1) - F.col("_t") / (n * (n - 1))))
    z = (F.greatest(U, a * b - U) - a * b / 2 - 0.5) / sigma
    ok = (F.col("n_a") >= min_side) & (F.col("n_b") >= min_side)
    out = u.join(med, g).withColumns({"insufficient": (~ok).cast("int"), "delta_median": F.col("median_a") - F.col("median_b"),
                                      "cliff_delta": F.when(ok, 2 * U / (a * b) - 1), "_z": F.when(ok, z)})
    out = out.withColumn("p", normal_two_sided("_z")).drop("_r1", "_t", "_z")
    return bh_fdr(out, "p", [*keys, "contrast"], "q")


def feature_corr_matrix(wide: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """H23, long: Pearson between features over the rows that have both; gaps and infinite values leave their pairs only.

    Every Arrow batch sends one matrix a moment and group: products of the values and of the masks of what is present
    (n, sums of either side where both are there), which are then summed. NULL where a side doesn't vary.
    """
    k = len(features)
    dt = dict(wide.dtypes)
    schema = ", ".join([f"{x} {dt[x]}" for x in keys] + ["i int", "j int", "n double", "si double", "sj double", "sii double", "sjj double", "sij double"])
    ii, jj = np.meshgrid(range(k), range(k), indexing="ij")

    def moments(batches):
        for pdf in batches:
            for key, g in pdf.groupby(keys, sort=False, dropna=False):
                x = g[features].to_numpy(dtype=float)
                there = np.isfinite(x)
                x, there = np.where(there, x, 0.0), there.astype(float)
                s, q = x.T @ there, (x * x).T @ there
                out = {name: v for name, v in zip(keys, key)}
                out.update(i=ii.ravel(), j=jj.ravel(), n=(there.T @ there).ravel(), si=s.ravel(), sj=s.T.ravel(), sii=q.ravel(), sjj=q.T.ravel(), sij=(x.T @ x).ravel())
                yield pd.DataFrame(out)[[*keys, "i", "j", "n", "si", "sj", "sii", "sjj", "sij"]]

    names = F.array(*[F.lit(f) for f in features])
    m = wide.select(*keys, *features).mapInPandas(moments, schema).groupBy(*keys, "i", "j").agg(*[F.sum(v).alias(v) for v in ("n", "si", "sj", "sii", "sjj", "sij")])
    v = lambda s, q: F.col(q) / F.col("n") - F.col(s) * F.col(s) / (F.col("n") * F.col("n"))
    cov = F.col("sij") / F.col("n") - F.col("si") * F.col("sj") / (F.col("n") * F.col("n"))
    m = m.withColumn("n", F.nullif("n", F.lit(0.0)))
    return m.select(*keys, F.element_at(names, F.col("i") + 1).alias("feature_i"), F.element_at(names, F.col("j") + 1).alias("feature_j"),
                    F.when((v("si", "sii") > 0) & (v("sj", "sjj") > 0), cov / F.sqrt(v("si", "sii") * v("sj", "sjj"))).alias("corr"))


def quantile_bins(df: DataFrame, keys: list[str], y: str, bins: int) -> DataFrame:
    """``bin``, ``y_lo``, ``y_hi`` by equal-count edges of y inside keys; repeated edges are dropped, one bin if nothing is left."""
    q = exact_quantiles(df, keys, y, {f"_e{i:03d}": i / bins for i in range(bins + 1)})
    edges = F.array_distinct(F.array(*[F.col(f"_e{i:03d}") for i in range(bins + 1)]))
    e = q.select(*keys, edges.alias("_edges"))
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    d = df.join(e, keys).withColumn("bin", F.size(F.filter(inner, lambda x: x < F.col(y))))
    return d.withColumns({"y_lo": F.get("_edges", "bin"), "y_hi": F.coalesce(F.get("_edges", F.col("bin") + 1), F.get("_edges", "bin"))}).drop("_edges")


def feature_trend(wide: DataFrame, keys: list[str], features: list[str], y: str = "y", bins: int = 10, min_bin: int = 20) -> DataFrame:
    """Y and x per quantile bin of y."""
    b = keep(quantile_bins(keep(wide.select(*keys, y, *features)), keys, y, bins))
    g = [*keys, "bin"]
    ys = b.groupBy(*g).agg(F.count(F.lit(1)).alias("bin_n"), F.first("y_lo").alias("y_lo"), F.first("y_hi").alias("y_hi"), F.avg(y).alias("y_mean"))
    ys = ys.join(exact_quantiles(b, g, y, {"y_median": 0.5}).drop("n"), g)
    d = b.select(*g, *[finite(f).alias(f) for f in features]).unpivot(g, features, "feature", "x")
    n = d.where(F.col("x").isNotNull()).groupBy(*g, "feature", "x").agg(F.count(F.lit(1)).alias("_n"))
    xs = n.groupBy(*g, "feature").agg((F.sum(F.col("x") * F.col("_n")) / F.sum("_n")).alias("x_mean"))
    med = histogram_quantiles(cumulate(n, [*g, "feature"], ["x"]), [*g, "feature"], "x", {"x_median": 0.5}).drop("n")
    return ys.join(xs.join(med, [*g, "feature"]), g).withColumn("small_bin", (F.col("bin_n") < min_bin).cast("int"))


def consistent_features(top: DataFrame, keys=("species", "locus", "variant", "feature"), tag: str = "tag") -> DataFrame:
    """Features in the top list of every tag (relational division)."""
    tags = top.agg(F.countDistinct(tag).alias("_all")).withColumn("_one", F.lit(1))
    g = top.groupBy(*keys).agg(F.countDistinct(tag).alias("n_tags_in_top")).withColumn("_one", F.lit(1))
    return g.join(F.broadcast(tags), "_one").where(F.col("n_tags_in_top") == F.col("_all")).drop("_one", "_all")


def group_composition(top: DataFrame, keys=("tag", "species", "locus", "variant")) -> DataFrame:
    """H25."""
    return top.groupBy(*keys, feature_group().alias("group")).agg(F.count(F.lit(1)).alias("n_in_top"))
