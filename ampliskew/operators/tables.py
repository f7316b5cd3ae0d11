"""Report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as sq
from ..functions.cols import c, ratio
from ..functions.joins import join_facts
from ..functions.ranks import cumulate, exact_quantiles, histogram_quantiles, top_per_group, value_histogram
from ..session import keep
from .features import PRIMERS
from .stats import feature_category, quantile_bins, rank_corr

KMER = "^k([1-8])_(head30|tail30|mid[0-9]+)_([ACGT]{1,8})$"
GROUP = ["species", "locus", "model", "variant"]


def metrics_summary(metrics: DataFrame, keys=("tag", "model", "variant")) -> DataFrame:
    """One input row per fitted model, so groups are small."""
    return metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_models"), F.avg("r2").alias("mean_r2"), F.median("r2").alias("median_r2"), F.avg("spearman").alias("mean_spearman"),
                                      F.avg("sign_acc").alias("mean_sign_acc"), F.avg("rmse").alias("mean_rmse"))


def best_variant(metrics: DataFrame, keys=("tag", "species", "locus", "model")) -> DataFrame:
    """J11."""
    return top_per_group(metrics, list(keys), [F.desc_nulls_last("spearman"), F.asc_nulls_last("rmse"), F.desc_nulls_last("r2"), "variant"], 1)


def variant_effects(metrics: DataFrame, base: str = "no_kmer", keys=("tag", "species", "locus", "model"), cols=("r2", "rmse", "spearman", "mae")) -> DataFrame:
    """Difference of every variant to the base variant of its group."""
    b = metrics.where(F.col("variant") == base).select(*keys, *[F.col(x).alias(f"base_{x}") for x in cols])
    return metrics.join(b, list(keys), "left").withColumns({f"delta_{x}": F.col(x) - F.col(f"base_{x}") for x in cols})


def ablation(metrics: DataFrame, contrasts=(("no_kmer", "no_kmer_noprimer"), ("all", "all_noprimer")), keys=("tag", "species", "locus", "model")) -> DataFrame:
    """B minus A for the primer contrasts that exist in a group."""
    side = lambda p: metrics.select(*keys, F.col("variant").alias(p), F.col("spearman").alias(f"{p}_spearman"), F.col("rmse").alias(f"{p}_rmse"))
    allowed = F.concat_ws("|", "A", "B").isin([f"{a}|{b}" for a, b in contrasts])
    return side("A").join(side("B"), list(keys)).where(allowed).withColumns(
        {"delta_spearman": F.col("B_spearman") - F.col("A_spearman"), "delta_rmse": F.col("B_rmse") - F.col("A_rmse")})


def parse_tag(tag="tag") -> Column:
    """top0p5p -> 0.005."""
    return F.regexp_replace(F.regexp_extract(c(tag), "^top([0-9]+(?:p[0-9]+)?)p$", 1), "p", ".").try_cast("double") / 100


def parse_k(variant="variant") -> Column:
    """J13."""
    return F.regexp_extract(c(variant), "k([0-9]+)$", 1).try_cast("int")


def group_overview(metrics: DataFrame, keys=("tag", "species", "locus")) -> DataFrame:
    """J14."""
    return metrics.groupBy(*keys).agg(F.countDistinct("model", "variant").alias("n_models"))


def variant_catalog(metrics: DataFrame, keys=("tag", "model")) -> DataFrame:
    """J14."""
    return metrics.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("variant")), ",").alias("variants"))


def presence_matrix(metrics: DataFrame, variants: list[str], keys=("tag", "species", "locus", "model")) -> DataFrame:
    """J14."""
    return metrics.groupBy(*keys).agg(*[F.max((F.col("variant") == v).cast("int")).alias(v) for v in variants])


def y_histogram(df: DataFrame, keys: list[str], y: str = "y", lo: float = -6.0, hi: float = 6.0, bins: int = 60) -> DataFrame:
    """Fixed bins, the last one closed; per split and over all splits in one grouping."""
    w = (hi - lo) / bins
    b = F.least(F.floor((F.col(y) - lo) / w), F.lit(bins - 1)).cast("int")
    d = df.where(F.col(y).between(lo, hi)).withColumn("bin", b)
    ks = [F.col(k) for k in keys]
    g = d.groupingSets([[*ks, F.col("split"), F.col("bin")], [*ks, F.col("bin")]], *ks, F.col("split"), F.col("bin")).agg(F.count(F.lit(1)).alias("n"), F.grouping("split").alias("_g"))
    return g.withColumn("split", F.when(F.col("_g") == 1, "all").otherwise(F.col("split"))).drop("_g").withColumn("bin_left", F.col("bin") * w + lo)


PROBS = {"q000": 0.0, "q001": 0.001, "q01": 0.01, "q05": 0.05, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99, "q999": 0.999, "q100": 1.0}


def y_quantiles(df: DataFrame, keys: list[str], y: str = "y", probs=None) -> DataFrame:
    """13 quantiles and the smallest |y| per split and overall; values are counted once, by split, before any is repeated."""
    g = [*keys, "split"]
    n = df.where(F.col(y).isNotNull()).groupBy(*g, y).agg(F.count(F.lit(1)).alias("_c"))
    d = n.withColumn("_s", F.explode(F.array(F.col("split"), F.lit("all")))).groupBy(*keys, F.col("_s").alias("split"), y).agg(F.sum("_c").alias("_n"))
    h = cumulate(d, g, [y])
    return histogram_quantiles(h, g, y, probs or PROBS).join(h.groupBy(*g).agg(F.min(F.abs(y)).alias("min_abs_y")), g)


def dataset_overview(df: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """All from counts of (pair, y), the only rows that are stored, and how many rows of a count are the first of their sequence."""
    first = (F.row_number().over(Window.partitionBy(*keys, "seq_id").orderBy("seq_id")) == 1) & F.col("seq_id").isNotNull()
    lines = keep(df.select(*keys, "pair_id", y, first.alias("_first")).groupBy(*keys, "pair_id", y).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_first").alias("_seqs")))
    n, v = F.col("_n"), F.col(y)
    known = F.sum(F.when(v.isNotNull(), n))
    agg = lines.groupBy(*keys).agg(F.sum(n).alias("n_rows"), known.alias("_known"), (F.sum(n * v) / known).alias("y_mean"),
                                   (F.sum(F.when(v >= 0, n).otherwise(0)) / F.sum(n)).alias("frac_nonneg"), F.countDistinct("pair_id").alias("n_pairs"), F.sum("_seqs").alias("n_sequences"))
    dev = v - F.col("y_mean")
    sd = lines.join(agg.select(*keys, "_known", "y_mean"), keys).groupBy(*keys, "_known").agg(F.sum(n * dev * dev).alias("_ss"))
    sd = sd.select(*keys, F.when(F.col("_known") > 1, F.sqrt(F.col("_ss") / (F.col("_known") - 1))).alias("y_sd"))
    h = cumulate(lines.where(v.isNotNull()).groupBy(*keys, y).agg(F.sum(n).alias("_n")), keys, [y])
    q = histogram_quantiles(h, keys, y, {k: v for k, v in PROBS.items() if k not in ("q001", "q999")}).drop("n")
    return agg.drop("_known").join(sd, keys).join(q, keys).select(*keys, "n_rows", "y_mean", "y_sd", "frac_nonneg", "n_pairs", "n_sequences", *q.drop(*keys).columns)


def true_counts(df: DataFrame, keys: list[str], y: str = "y", clip: float = 6.0) -> DataFrame:
    """J17."""
    f = lambda cond, n: (F.count(F.when(cond, 1)) / F.count(F.lit(1))).alias(n)
    v = F.col(y)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), f(v > 0, "frac_pos"), f(v < 0, "frac_neg"), f(v == 0, "frac_zero"), f(F.abs(v) >= clip, "frac_clipped"))


def pair_manifest(training: DataFrame, samples: DataFrame) -> DataFrame:
    """Pairs with the metadata of both sides and notes on what does not match."""
    p = training.groupBy("pair_id", "yes_file_id", "no_file_id").agg(F.count(F.lit(1)).alias("n_rows"))
    m = lambda s: samples.select(*[F.col(x).alias(f"{s}_{x}") for x in ("file_id", "species", "locus", "pcr", "n_individuals")])
    j = p.join(m("yes"), "yes_file_id", "left").join(m("no"), "no_file_id", "left")
    note = lambda cond, t: F.when(cond, t)
    ne = lambda x: F.col(f"yes_{x}") != F.col(f"no_{x}")
    notes = F.array_compact(F.array(note(F.col("yes_pcr").isNull(), "yes_unknown"), note(F.col("no_pcr").isNull(), "no_unknown"), note(ne("species"), "species_mismatch"), note(ne("locus"), "locus_mismatch"),
                                    note(ne("n_individuals"), "n_individuals_mismatch"), note(F.col("yes_pcr") == F.col("no_pcr"), "same_pcr")))
    return j.withColumn("notes", F.array_join(notes, ";"))


def reference_variant(metrics: DataFrame, prefer: list[str], keys=("tag", "species", "locus")) -> DataFrame:
    """First variant of the preference list that a group has."""
    pos = F.array_position(F.array(*[F.lit(v) for v in prefer]), F.col("variant"))
    return metrics.where(pos > 0).groupBy(*keys).agg(F.min_by("variant", pos).alias("reference_variant"))


def parse_kmer_feature(f="feature") -> dict[str, Column]:
    part = lambda i: F.nullif(F.regexp_extract(c(f), KMER, i), F.lit(""))
    return {"k": part(1).cast("int"), "region": part(2), "kmer": part(3)}


def importance_by_region(imp: DataFrame, keys: list[str]) -> DataFrame:
    """Importance summed by type, k and region."""
    d = imp.withColumns(parse_kmer_feature())
    return d.groupBy(*keys, F.when(F.col("k").isNotNull(), "kmer").otherwise("non_kmer").alias("type"), "k", "region").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("mean_abs_shap").alias("sum_abs_shap"), F.sum("mean_shap").alias("sum_shap"))


def attribution_rollup(attr: DataFrame, seqs: DataFrame, head: int = 30, tail: int = 30, bins: int = 3) -> DataFrame:
    """Attributions (seq_id, pos 0-based, attr) by region, base, position and distance from the end, in one pass.

    ``dim`` names the roll-up, ``value`` its key; regions follow each sequence's own length.
    """
    d = attr.join(seqs.select("seq_id", "sequence"), "seq_id")
    n, p = F.length("sequence"), F.col("pos")
    m = n - head - tail
    region = (F.when(p < head, "head").when(p >= n - tail, "tail")
              .otherwise(F.concat(F.lit("mid"), (F.least(F.floor((p - head) * bins / F.greatest(m, F.lit(1))), F.lit(bins - 1)) + 1).cast("int"))))
    d = d.where(p < n).select(region.alias("region"), F.substring("sequence", p + 1, F.lit(1)).alias("base"), p.cast("string").alias("position"), (n - 1 - p).cast("string").alias("from_end"), "attr")
    dims = ["region", "base", "position", "from_end"]
    e = d.select("attr", F.explode(F.array(*[F.struct(F.lit(x).alias("dim"), F.col(x).alias("value")) for x in dims])).alias("_d")).select("attr", "_d.*")
    g = e.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("attr").alias("sum_attr"), F.sum(F.abs("attr")).alias("sum_abs_attr"), F.avg("attr").alias("mean_attr"), F.avg(F.abs("attr")).alias("mean_abs_attr"))
    tot = g.groupBy("dim").agg(F.sum("n_tokens").alias("_t"))
    return g.join(tot, "dim").withColumn("token_frac", F.col("n_tokens") / F.col("_t")).drop("_t")


def local_top_positions(attr: DataFrame, n: int = 5) -> DataFrame:
    """J20."""
    return top_per_group(attr, ["seq_id"], [F.desc(F.abs("attr")), "pos"], n, out="rank")


def importance_budget(imp: DataFrame, keys: list[str], dim: str) -> DataFrame:
    """Share of importance by region (inside k), k, primer or category."""
    d = imp.withColumns(parse_kmer_feature())
    if dim == "region":
        d, by, within = d.where(F.col("k").isNotNull()), [*keys, "k", "region"], [*keys, "k"]
    elif dim == "k":
        d, by, within = d.where(F.col("k").isNotNull()), [*keys, "k"], keys
    elif dim == "primer":
        d, by, within = d.withColumn("primer", F.when(F.col("feature").startswith("feat_pr_"), "primer").otherwise("nonprimer")), [*keys, "primer"], keys
    else:
        d, by, within = d.withColumn("category", feature_category()), [*keys, "category"], keys
    g = d.groupBy(*by).agg(F.sum("mean_abs_shap").alias("sum_abs_shap"))
    tot = g.groupBy(*within).agg(F.sum("sum_abs_shap").alias("_t"))
    return g.join(tot, within).withColumn("frac", ratio("sum_abs_shap", "_t")).drop("_t")


def top_kmers_by_region(imp: DataFrame, keys: list[str], n: int = 30) -> DataFrame:
    """J22."""
    d = imp.withColumns(parse_kmer_feature()).where(F.col("k").isNotNull())
    return top_per_group(d, [*keys, "k", "region"], [F.desc("mean_abs_shap"), "kmer"], n, out="rank_in_region")


def shared_kmers(imp: DataFrame, keys: list[str]) -> DataFrame:
    """K-mers found in two or more regions, with their value in each."""
    d = imp.withColumns(parse_kmer_feature()).where(F.col("k").isNotNull()).groupBy(*keys, "k", "kmer", "region").agg(F.avg("mean_abs_shap").alias("mean_abs_shap"))
    g = d.groupBy(*keys, "k", "kmer").agg(F.count(F.lit(1)).alias("n_regions")).where("n_regions >= 2")
    return d.join(g, [*keys, "k", "kmer"])


def k_curve(metrics: DataFrame, cols=("spearman", "rmse", "r2")) -> DataFrame:
    """J22."""
    return metrics.withColumn("k", parse_k()).select("tag", "species", "locus", "model", "variant", "k", *cols)


def primerlike(top: DataFrame, min_k: int = 6, primers=None) -> DataFrame:
    """K-mers (>= min_k) contained in a primer or its reverse complement; ambiguous primer letters match nothing.

    The primers are a literal list, so each row tests them in place.
    """
    texts = {f"{loc}_{s}": p for loc, (f, r) in (primers or PRIMERS).items() for s, p in (("F", f), ("R", r))}
    plain = lambda p: p.translate(str.maketrans({x: "." for x in "RYSWKMBDHVN"}))
    hit = lambda p: F.lit(plain(p)).contains(F.col("kmer")) | F.lit(plain(sq.revcomp_text(p))).contains(F.col("kmer"))
    hits = F.array_compact(F.array(*[F.when((F.length("kmer") >= min_k) & hit(p), name) for name, p in texts.items()]))
    return top.withColumn("primer_hits", F.array_join(hits, ",")).withColumn("is_primerlike", (F.col("primer_hits") != "").cast("int"))


def primerlike_fraction(hits: DataFrame, keys: list[str]) -> DataFrame:
    """J23."""
    return hits.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n_top"), F.sum("is_primerlike").alias("n_primerlike")).withColumn("primerlike_frac", F.col("n_primerlike") / F.col("n_top"))


def kmer_logo(top: DataFrame, keys: list[str]) -> DataFrame:
    """Base shares per position over the top k-mers, zeros kept."""
    d = top.select(*keys, "k", "region", F.posexplode(sq.letters("kmer")).alias("_p", "_b"))
    g = d.groupBy(*keys, "k", "region", (F.col("_p") + 1).alias("pos")).agg(*[F.avg((F.col("_b") == b).cast("double")).alias(b) for b in "ACGT"])
    return g.unpivot([*keys, "k", "region", "pos"], list("ACGT"), "base", "freq")


def scatter_sample(pred: DataFrame, keys: list[str], n: int = 5000, seed: int = 1, row: str = "row_id") -> DataFrame:
    """N rows per group in hash order.

    Rows are counted by the first 12 bits of their hash; only those up to the bin where a group's count reaches ``n`` are sorted.
    """
    d = pred.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(row)))).withColumn("_bin", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = d.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 4096 lines at most
    last = counts.withColumn("_b", before).where(F.col("_b") < n).groupBy(*keys).agg(F.max("_bin").alias("_last"))
    d = join_facts(d, last, keys, row).where(F.col("_bin") <= F.col("_last"))
    d = top_per_group(d, keys, [F.substring("_h", 1, 8), F.md5(F.col(row)), row], n)
    return d.withColumn("resid", F.col("y_pred") - F.col("y_true")).withColumn("abs_resid", F.abs("resid")).drop("_h", "_bin", "_last")


def calibration(pred: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """Predictions and residuals per quantile bin of y."""
    b = quantile_bins(keep(pred.select(*keys, "y_true", "y_pred")), keys, "y_true", bins)
    b = keep(b.withColumn("resid", F.col("y_pred") - F.col("y_true")))
    g = [*keys, "bin"]
    out = b.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.avg("y_true").alias("y_true_mean"), F.avg("y_pred").alias("y_pred_mean"), F.avg("resid").alias("resid_mean"),
                            F.sqrt(F.avg(F.col("resid") * F.col("resid"))).alias("resid_rmse"), F.avg(F.abs("resid")).alias("resid_mae"))
    long = b.unpivot(g, ["y_true", "y_pred", "resid"], "_v", "x")
    med = exact_quantiles(long, [*g, "_v"], "x", {"m": 0.5}).groupBy(*g).agg(*[F.max(F.when(F.col("_v") == v, F.col("m"))).alias(f"{v}_med") for v in ("y_true", "y_pred", "resid")])
    return out.join(med, g)


def residual_quantiles(pred: DataFrame, keys: list[str]) -> DataFrame:
    """J25."""
    d = pred.withColumn("resid", F.col("y_pred") - F.col("y_true"))
    return exact_quantiles(d, keys, "resid", {"resid_q01": 0.01, "resid_q05": 0.05, "resid_q50": 0.5, "resid_q95": 0.95, "resid_q99": 0.99})


def top_importance(imp: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """J26."""
    d = top_per_group(imp, keys, [F.desc("mean_abs_shap"), "feature"], n, out="rank")
    s = F.col("mean_shap")
    return d.withColumns({"category": feature_category(), "sign": F.signum("mean_shap"), "direction": F.when(s > 0, "positive").when(s < 0, "negative").otherwise("zero")})


def rank_concordance(imp: DataFrame, keys: list[str], a: str = "xgb", b: str = "rf", min_n: int = 10) -> DataFrame:
    """Spearman of two models' importances over the features both have."""
    val = lambda m: F.max(F.when(F.col("model") == m, F.col("mean_abs_shap")))
    w = imp.where(F.col("model").isin(a, b)).groupBy(*keys, "feature").agg(val(a).alias("x"), val(b).alias("y"))
    return rank_corr(w, keys, min_n=min_n).select(*keys, F.col("n").alias("n_features"), F.col("spearman").alias("rank_corr"))


def nearest_rank_summary(pred: DataFrame, keys: list[str], probs=(0.05, 0.5, 0.95)) -> DataFrame:
    """Rows, mean and nearest-rank quantiles (index floor(p * (n - 1) + 0.5)) of the predictions."""
    h = value_histogram(pred, keys, "y_pred")
    t = h.groupBy(*keys).agg(F.sum("_n").alias("n"), (F.sum(F.col("y_pred") * F.col("_n")) / F.sum("_n")).alias("mean_pred"))
    hit = lambda p: (F.col("_below") <= F.floor((F.col("n") - 1) * F.lit(p) + 0.5)) & (F.floor((F.col("n") - 1) * F.lit(p) + 0.5) < F.col("_below") + F.col("_n"))
    return h.join(t, keys).groupBy(*keys, "n", "mean_pred").agg(*[F.max(F.when(hit(p), F.col("y_pred"))).alias(f"p{int(p * 100):02d}") for p in probs])


def feature_manifest(features: DataFrame, keys: list[str]) -> DataFrame:
    """J28."""
    k = parse_kmer_feature()["k"]
    return features.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_features"), F.count(k).alias("n_kmer"), F.count(F.when(F.col("feature").startswith("feat_pr_"), 1)).alias("n_primer"))


def union_with_context(tables: list[tuple[dict, DataFrame]]) -> DataFrame:
    """Per-model tables under each other with their context as columns; missing columns become NULL."""
    out = None
    for ctx, df in tables:
        d = df.withColumns({k: F.lit(v) for k, v in ctx.items()})
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out.withColumns({"topbias_frac": parse_tag(), "variant_k": parse_k()})


def sample_sheet_summary(samples: DataFrame) -> DataFrame:
    """J30."""
    skip = (F.col("n_individuals") <= 1).cast("int")
    return samples.groupBy("species", "locus").agg(F.count(F.lit(1)).alias("n_samples"), F.sum(skip).alias("n_skip_no_control"))


def split_sizes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """J30."""
    return rows.groupBy(*keys).agg(*[F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}") for s in ("train", "val", "test")])
