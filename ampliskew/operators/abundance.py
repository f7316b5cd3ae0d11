"""Reads -> counts -> relative abundance, thresholds, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_facts
from ..functions.cols import ratio, ratio0
from ..functions.ranks import ordered_positions, top_per_group

META = ["sample_id", "marker", "group_name", "sample_type", "species_scope", "is_core_analysis"]

# The four filter rules and the group-name prefixes.
RULES = {"count_ge_2": ("count", 2.0), "rel_ge_0.001": ("relative_abundance", 0.001),
         "rel_ge_0.005": ("relative_abundance", 0.005), "rel_ge_0.01": ("relative_abundance", 0.01)}
PREFIX_SPECIES = {"Ea": "Equus_asinus", "Bt": "Bos_taurus", "Ss": "Sus_scrofa"}


def dereplicate(reads: DataFrame, sample: str = "sample_id", seq: str = "seq") -> DataFrame:
    """Copies of each upper-case sequence per sample; empty reads are dropped. Counts combine map-side."""
    s = F.upper(seq)
    return (reads.where(F.length(seq) > 0).groupBy(sample, s.alias("sequence")).agg(F.count(F.lit(1)).alias("count")))


def seq_id(sequence, style: str = "md5") -> Column:
    """Content id; ``short`` is SEQ_ and 16 hex digits, ``md5`` all 32."""
    h = F.md5(F.upper(sequence))
    return F.concat(F.lit("SEQ_"), F.substring(h, 1, 16)) if style == "short" else h


def relative_abundance(df: DataFrame, sample: str = "sample_id", min_count: int = 0) -> DataFrame:
    """Count over the sample total; rows below ``min_count`` leave after the total is taken.

    Totals come from a map-side combined groupBy; rows of a hot sample stay spread.
    """
    tot = df.groupBy(sample).agg(F.sum("count").alias("_total"))
    out = join_facts(df, tot, sample, [x for x in ("seq_id", "sequence") if x in df.columns][:1] or df.columns).withColumn("relative_abundance", ratio0("count", "_total")).drop("_total")
    return out.where(F.col("count") >= min_count) if min_count else out


def sequence_catalog(df: DataFrame, seq: str = "sequence", style: str = "md5") -> DataFrame:
    """One row per distinct sequence with length and GC share."""
    n = F.length("sequence")
    gc = n - F.length(F.translate("sequence", "GC", ""))
    return (df.select(F.upper(seq).alias("sequence")).where(F.length("sequence") > 0).distinct()
            .select(seq_id("sequence", style).alias("seq_id"), "sequence", n.alias("length"), F.round(gc / n, 6).alias("gc")))


def sample_summary(df: DataFrame, by=META) -> DataFrame:
    """C05. A sample holds a sequence once (C01), so counting rows is the distinct count."""
    return df.groupBy(*by).agg(F.sum("count").alias("total_reads"), F.count("seq_id").alias("n_unique_sequences"),
                               F.max("relative_abundance").alias("max_rel_abundance"))


def _percent(frac: float) -> str:
    return f"top{frac * 100:g}pct"


def rank_tags(df: DataFrame, fracs=(0.01, 0.005), min_count: int = 2, sample: str = "sample_id") -> DataFrame:
    """Abundance rank per sample and tags; cut-off max(1, round half-even(u * f))."""
    u = df.groupBy(sample).agg(F.count(F.lit(1)).alias("_u"))
    r = ordered_positions(df, [sample], "count", "seq_id", "abundance_rank").join(u, sample)
    tags = [F.when(F.col("count") >= min_count, f"count{min_count}")]
    for f in fracs:
        cut = F.greatest(F.lit(1.0), F.rint(F.col("_u") * F.lit(float(f))))
        tags.append(F.when(F.col("abundance_rank") <= cut, _percent(f)))
    return r.withColumn("tag", F.array_join(F.array_compact(F.array(*tags)), ",")).drop("_u")


def level_flags(df: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Over rows with count >= 2, 0-based rank below floor(u * f) flags the top 1 % and 0.5 %."""
    kept = df.where(F.col("count") >= 2)
    u = kept.groupBy(sample).agg(F.count(F.lit(1)).alias("_u"))
    r = ordered_positions(kept, [sample], "count", "seq_id", "_p").join(u, sample)
    top1 = F.col("_p") - 1 < F.floor(F.col("_u") * 0.01)
    top05 = F.col("_p") - 1 < F.floor(F.col("_u") * 0.005)
    return (r.withColumn("is_top1", top1).withColumn("is_top05", top05)
            .withColumn("level_tag", F.when(top05, "top0.5%").when(top1, "top1%").otherwise("count_2")).drop("_p", "_u"))


def global_counts(df: DataFrame, min_count: int = 2) -> DataFrame:
    """Total count and number of samples per sequence, kept from ``min_count`` on."""
    return (df.groupBy("seq_id").agg(F.sum("count").alias("total_count"), F.count(F.lit(1)).alias("n_samples"))
            .where(F.col("total_count") >= min_count))


def filter_catalog(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """Catalogue rows whose id survived the global filter."""
    return catalog.join(counts.select("seq_id"), "seq_id", "left_semi")


def with_rules(df: DataFrame, rules=None) -> DataFrame:
    """All rows once per rule with ``threshold_label`` and ``keep``: one pass instead of one job per rule."""
    rules = rules or RULES
    arr = F.array(*[F.struct(F.lit(k).alias("label"), (F.col(col) >= F.lit(cut)).alias("keep"))
                    for k, (col, cut) in rules.items()])
    return df.withColumn("_r", F.explode(arr)).select(*df.columns, F.col("_r.label").alias("threshold_label"),
                                                      F.col("_r.keep").alias("keep"))


def apply_thresholds(df: DataFrame, rules=None) -> DataFrame:
    """Rows that pass each rule."""
    return with_rules(df, rules).where("keep").drop("keep")


def _diversity(total: Column, sum_clnc: Column, sum_c2: Column):
    """Shannon (ln) and Simpson from sums alone: H = ln T - sum(c ln c)/T, 1 - sum(c^2)/T^2."""
    h = F.when(total > 0, F.ln(total) - sum_clnc / total).otherwise(0.0)
    s = F.when(total > 0, 1.0 - sum_c2 / (total * total)).otherwise(0.0)
    return h, s


def threshold_summary(df: DataFrame, rules=None) -> DataFrame:
    """Per sample and rule; samples with nothing kept stay with zeros.

    Diversity needs only sums of count, count^2 and count*ln(count), so everything but the ten largest shares is
    one map-side combined aggregation.
    """
    r = with_rules(df, rules)
    cnt = F.col("count").cast("double")
    kept = F.col("keep") & (F.col("count") > 0)
    k = lambda x: F.coalesce(F.sum(F.when(kept, x)), F.lit(0.0))
    agg = r.groupBy(*META, "threshold_label").agg(
        F.count(F.when(F.col("keep"), F.lit(1))).alias("n_unique_sequences_kept"),
        F.sum("count").alias("total_reads_all"),
        F.coalesce(F.sum(F.when(F.col("keep"), F.col("count"))), F.lit(0)).alias("total_reads_kept"),
        k(cnt * F.ln(cnt)).alias("_clnc"), k(cnt * cnt).alias("_c2"),
        F.coalesce(F.max(F.when(F.col("keep"), F.col("relative_abundance"))), F.lit(0.0)).alias("dominant_rel_abundance"))
    top = top_per_group(r.where("keep").select("sample_id", "threshold_label", "seq_id", "relative_abundance"),
                        ["sample_id", "threshold_label"], [F.desc("relative_abundance"), "seq_id"], 10)
    top = top.groupBy("sample_id", "threshold_label").agg(F.sum("relative_abundance").alias("_top10"))
    h, s = _diversity(F.col("total_reads_kept").cast("double"), F.col("_clnc"), F.col("_c2"))
    return (agg.join(top, ["sample_id", "threshold_label"], "left")
            .withColumn("fraction_reads_kept", ratio0("total_reads_kept", "total_reads_all"))
            .withColumn("shannon", h).withColumn("simpson_1_minus_d", s)
            .withColumn("top10_rel_abundance", F.coalesce("_top10", F.lit(0.0))).drop("_clnc", "_c2", "_top10"))


def threshold_wide(summary: DataFrame, labels=None) -> DataFrame:
    """C11: one ``<metric>__<label>`` column per metric and rule."""
    labels = list(labels or RULES)
    metrics = ["n_unique_sequences_kept", "fraction_reads_kept", "shannon", "simpson_1_minus_d", "dominant_rel_abundance"]
    aggs = [F.max(F.when(F.col("threshold_label") == x, F.col(m))).alias(f"{m}__{x}") for m in metrics for x in labels]
    return summary.groupBy(*META).agg(*aggs)


def prefix_species(group_name, default: str = "Unknown") -> Column:
    g = F.col(group_name) if isinstance(group_name, str) else group_name
    out = F.lit(default)
    for p, s in reversed(list(PREFIX_SPECIES.items())):
        out = F.when(g.startswith(p), s).otherwise(out)
    return out


def haplotype_complexity(df: DataFrame, min_rel: float = 0.01, min_count: int = 2) -> DataFrame:
    """Richness, diversity, evenness and share of the first 1, 3, 10 and the remaining haplotypes."""
    by = ["sample_id", "marker", "group_name", "sample_type", "species_scope"]
    f = df.where((F.col("sample_type") == "intra_mix") & (F.lower("is_core_analysis") == "yes")
                 & (F.col("count") >= min_count) & (F.col("relative_abundance") >= min_rel))
    cnt = F.col("count").cast("double")
    agg = f.groupBy(*by).agg(
        F.sum("count").alias("total_reads_retained"), F.count(F.lit(1)).alias("n_unique_sequences"),
        F.sum(cnt * F.ln(cnt)).alias("_clnc"), F.sum(cnt * cnt).alias("_c2"),
        F.max("relative_abundance").alias("dominant_rel_abundance"), F.sum("relative_abundance").alias("_all"))
    top = top_per_group(f.select("sample_id", "seq_id", "relative_abundance"), ["sample_id"],
                        [F.desc("relative_abundance"), "seq_id"], 10, out="_rn")
    top = top.groupBy("sample_id").agg(F.sum(F.when(F.col("_rn") <= 3, F.col("relative_abundance"))).alias("top3_rel_abundance"),
                                       F.sum("relative_abundance").alias("top10_rel_abundance"))
    h, s = _diversity(F.col("total_reads_retained").cast("double"), F.col("_clnc"), F.col("_c2"))
    n = F.col("n_unique_sequences")
    return (agg.join(top, "sample_id").withColumn("shannon", h).withColumn("simpson_1_minus_d", s)
            .withColumn("pielou_evenness", F.when(n <= 1, 0.0).otherwise(F.col("shannon") / F.ln(n)))
            .withColumn("tail_rel_abundance", F.when(n <= 1, 0.0).otherwise(F.col("_all") - F.col("dominant_rel_abundance")))
            .withColumn("target_species_inferred", prefix_species("group_name"))
            .drop("_clnc", "_c2", "_all"))


def complexity_by_group(metrics: DataFrame) -> DataFrame:
    """C13."""
    cols = ["n_unique_sequences", "shannon", "simpson_1_minus_d", "pielou_evenness", "dominant_rel_abundance", "tail_rel_abundance"]
    return metrics.groupBy("marker", "group_name", "target_species_inferred").agg(
        F.countDistinct("sample_id").alias("n_samples"), *[F.avg(x).alias(f"mean_{x}") for x in cols])


def renormalize(df: DataFrame, keys=("threshold_label", "sample_id")) -> DataFrame:
    """C14: shares inside what each sample kept under each rule."""
    keys = list(keys)
    cnt = F.coalesce(F.col("count"), F.lit(0))
    tot = df.groupBy(*keys).agg(F.sum(cnt).alias("retained_total_count"),
                                F.sum("relative_abundance").alias("retained_signal_fraction_from_original"))
    return join_facts(df, tot, keys, [x for x in ("seq_id", "sequence") if x in df.columns][:1] or df.columns).withColumn("relative_abundance_renorm", ratio0(cnt, "retained_total_count"))


def renorm_checks(df: DataFrame) -> DataFrame:
    """C15."""
    return df.groupBy("threshold_label", "sample_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("count").alias("retained_total_count"),
        F.sum("relative_abundance_renorm").alias("renorm_sum"),
        F.max("retained_signal_fraction_from_original").alias("retained_signal_fraction_from_original"))


def core_samples(df: DataFrame) -> DataFrame:
    """B14."""
    return df.where(F.lower("is_core_analysis") == "yes")


def expected_design(samples: DataFrame, n_inter_targets: int = 10) -> DataFrame:
    """N equal targets per inter mix, the species of the group-name prefix for intra mixes."""
    core = core_samples(samples)
    base = ["sample_id", "marker", "group_name", "sample_type"]
    inter = (core.where(F.col("sample_type") == "inter_mix")
             .select(*base, F.explode(F.sequence(F.lit(1), F.lit(n_inter_targets))).alias("_i"))
             .select(*base, F.concat(F.lit("TARGET_"), F.lpad(F.col("_i").cast("string"), 2, "0")).alias("target_label"),
                     F.round(F.lit(1.0 / n_inter_targets), 6).alias("expected_prop")))
    intra = (core.where(F.col("sample_type") == "intra_mix")
             .select(*base, prefix_species("group_name", "REPLACE_WITH_TARGET_SPECIES").alias("target_label"),
                     F.lit(1.0).alias("expected_prop")))
    return inter.unionByName(intra)


def sample_design(samples: DataFrame) -> DataFrame:
    """The projection of the core samples."""
    return core_samples(samples).select(*META)


def sample_feature_levels(stats: DataFrame, feats: DataFrame) -> DataFrame:
    """C17: flagged statistics with features, one row per level a sequence belongs to (count2, top1pct, top0.5pct)."""
    levels = F.array_compact(F.array(F.lit("count2"), F.when(F.col("is_top1"), "top1pct"), F.when(F.col("is_top05"), "top0.5pct")))
    return stats.join(feats, "seq_id", "left").withColumn("level", F.explode(levels))
