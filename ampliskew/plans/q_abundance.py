"""Queries C01-C17, B14."""

from pyspark.sql import functions as F

from ..operators import abundance as ab
from .registry import query

META_SQL = "sample_id, marker, group_name, sample_type, species_scope, is_core_analysis"
AB = ("fx_abundance",)

RULE_ROWS = """SELECT a.*, t.threshold_label, CASE t.col WHEN 'count' THEN a.count >= t.cut ELSE a.relative_abundance >= t.cut END AS keep
FROM fx_abundance a, (VALUES ('count_ge_2', 'count', 2.0::DOUBLE), ('rel_ge_0.001', 'rel', 0.001::DOUBLE),
  ('rel_ge_0.005', 'rel', 0.005::DOUBLE), ('rel_ge_0.01', 'rel', 0.01::DOUBLE)) t(threshold_label, col, cut)"""

# Shares here are a few per mille, so the queries below use cut-offs that split the derived samples.
LOW_RULES = {"count_ge_2": ("count", 2.0), "rel_ge_0.0003": ("relative_abundance", 0.0003),
             "rel_ge_0.0008": ("relative_abundance", 0.0008), "rel_ge_0.9": ("relative_abundance", 0.9)}
LOW_ROWS = """SELECT a.*, t.threshold_label, CASE t.col WHEN 'count' THEN a.count >= t.cut ELSE a.relative_abundance >= t.cut END AS keep
FROM fx_abundance a, (VALUES ('count_ge_2', 'count', 2.0::DOUBLE), ('rel_ge_0.0003', 'rel', 0.0003::DOUBLE),
  ('rel_ge_0.0008', 'rel', 0.0008::DOUBLE), ('rel_ge_0.9', 'rel', 0.9::DOUBLE)) t(threshold_label, col, cut)"""


@query("b14_core_samples", needs=("fx_samples",), sql="SELECT * FROM fx_samples WHERE lower(is_core_analysis) = 'yes'")
def _(t):
    return ab.core_samples(t.samples)


@query("c01_dereplicate", needs=("fx_reads",), sql="SELECT sample_id, upper(seq) AS sequence, count(*) AS count FROM fx_reads GROUP BY 1, 2")
def _(t):
    return ab.dereplicate(t.reads)


@query("c02_seq_id", needs=("fx_reads",),
       sql="SELECT DISTINCT seq, 'SEQ_' || substr(md5(seq), 1, 16) AS short_id, md5(seq) AS full_id FROM fx_reads")
def _(t):
    return t.reads.select("seq").distinct().select("seq", ab.seq_id("seq", "short").alias("short_id"), ab.seq_id("seq").alias("full_id"))


@query("c03_relative_abundance", needs=("fx_counts",), r="relative_abundance", sql="""
SELECT * FROM (SELECT sample_id, seq_id, count, count / CAST(sum(count) OVER (PARTITION BY sample_id) AS DOUBLE) AS relative_abundance
FROM fx_counts) x WHERE count >= 2""")
def _(t):
    return ab.relative_abundance(t.counts, min_count=2)


@query("c04_sequence_catalog", needs=("fx_reads",), sql="""
SELECT 'SEQ_' || substr(md5(seq), 1, 16) AS seq_id, seq AS sequence, CAST(length(seq) AS INTEGER) AS length,
  round((length(seq) - length(translate(seq, 'GC', ''))) / CAST(length(seq) AS DOUBLE), 6) AS gc
FROM (SELECT DISTINCT seq FROM fx_reads) r""")
def _(t):
    return ab.sequence_catalog(t.reads, "seq", "short")


@query("c05_sample_summary", needs=AB, i="total_reads", r="max_rel_abundance", sql=f"""
SELECT {META_SQL}, sum(count) AS total_reads, count(DISTINCT seq_id) AS n_unique_sequences, max(relative_abundance) AS max_rel_abundance
FROM fx_abundance GROUP BY ALL""")
def _(t):
    return ab.sample_summary(t.abundance)


@query("c06_rank_tags", needs=("fx_counts",), sql="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY count DESC, md5(seq_id), seq_id) AS abundance_rank,
  count(*) OVER (PARTITION BY sample_id) AS u FROM fx_counts)
SELECT sample_id, seq_id, count, abundance_rank, concat_ws(',', CASE WHEN count >= 2 THEN 'count2' END,
  CASE WHEN abundance_rank <= greatest(1, round_even(u * 0.01::DOUBLE, 0)) THEN 'top1pct' END,
  CASE WHEN abundance_rank <= greatest(1, round_even(u * 0.005::DOUBLE, 0)) THEN 'top0.5pct' END) AS tag FROM r""")
def _(t):
    return ab.rank_tags(t.counts)


@query("c07_level_flags", needs=("fx_counts",), sql="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY count DESC, md5(seq_id), seq_id) - 1 AS p,
  count(*) OVER (PARTITION BY sample_id) AS u FROM fx_counts WHERE count >= 2)
SELECT sample_id, seq_id, count, p < floor(u * 0.01::DOUBLE) AS is_top1, p < floor(u * 0.005::DOUBLE) AS is_top05,
  CASE WHEN p < floor(u * 0.005::DOUBLE) THEN 'top0.5%' WHEN p < floor(u * 0.01::DOUBLE) THEN 'top1%' ELSE 'count_2' END AS level_tag FROM r""")
def _(t):
    return ab.level_flags(t.counts)


GLOBAL_SQL = "SELECT seq_id, CAST(sum(count) AS BIGINT) AS total_count, count(*) AS n_samples FROM fx_counts GROUP BY 1 HAVING sum(count) >= 300"


@query("c08_global_counts", needs=("fx_counts",), sql=GLOBAL_SQL)
def _(t):
    return ab.global_counts(t.counts, 300)


@query("c08_filter_catalog", needs=("fx_counts", "fx_catalog"), sql=f"""
SELECT c.* FROM fx_catalog c WHERE seq_id IN (SELECT seq_id FROM ({GLOBAL_SQL}) g)""")
def _(t):
    return ab.filter_catalog(t.catalog, ab.global_counts(t.counts, 300))


@query("c09_apply_thresholds", needs=AB, r="relative_abundance", sql=f"SELECT * EXCLUDE (keep) FROM ({RULE_ROWS}) x WHERE keep")
def _(t):
    return ab.apply_thresholds(t.abundance)


SUMMARY_SQL = f"""
WITH r AS ({LOW_ROWS}),
k AS (SELECT *, count / CAST(sum(count) OVER (PARTITION BY sample_id, threshold_label) AS DOUBLE) AS p,
  row_number() OVER (PARTITION BY sample_id, threshold_label ORDER BY relative_abundance DESC, seq_id) AS rn FROM r WHERE keep),
d AS (SELECT sample_id, threshold_label, count(*) AS n, sum(count) AS reads, -sum(p * ln(p)) AS shannon, 1 - sum(p * p) AS simpson,
  max(relative_abundance) AS dom, sum(CASE WHEN rn <= 10 THEN relative_abundance END) AS top10 FROM k GROUP BY 1, 2),
a AS (SELECT {META_SQL}, threshold_label, CAST(sum(count) AS BIGINT) AS total_reads_all FROM r GROUP BY ALL)
SELECT a.*, coalesce(d.n, 0) AS n_unique_sequences_kept, CAST(coalesce(d.reads, 0) AS BIGINT) AS total_reads_kept,
  CAST(coalesce(d.reads, 0) AS DOUBLE) / a.total_reads_all AS fraction_reads_kept, coalesce(d.shannon, 0) AS shannon,
  coalesce(d.simpson, 0) AS simpson_1_minus_d, coalesce(d.dom, 0) AS dominant_rel_abundance, coalesce(d.top10, 0) AS top10_rel_abundance
FROM a LEFT JOIN d ON a.sample_id = d.sample_id AND a.threshold_label = d.threshold_label"""
SUMMARY_R = "fraction_reads_kept shannon simpson_1_minus_d dominant_rel_abundance top10_rel_abundance"


@query("c10_threshold_summary", needs=AB, r=SUMMARY_R, sql=SUMMARY_SQL)
def _(t):
    return ab.threshold_summary(t.abundance, LOW_RULES)


METRICS = ["n_unique_sequences_kept", "fraction_reads_kept", "shannon", "simpson_1_minus_d", "dominant_rel_abundance"]


@query("c11_threshold_wide", needs=AB, sql=f"""
SELECT {META_SQL}, {', '.join(f'''max(CASE WHEN threshold_label = '{x}' THEN {m if i == 0 else f'round({m}, 6) + 0.0'} END) AS "{m}__{x}"'''
                              for i, m in enumerate(METRICS) for x in LOW_RULES)} FROM ({SUMMARY_SQL}) s GROUP BY ALL""")
def _(t):
    s = ab.threshold_summary(t.abundance, LOW_RULES)
    return ab.threshold_wide(s.withColumns({m: F.round(m, 6) for m in METRICS[1:]}), LOW_RULES)


COMPLEX_SQL = """
WITH f AS (SELECT *, count / CAST(sum(count) OVER (PARTITION BY sample_id) AS DOUBLE) AS p,
  row_number() OVER (PARTITION BY sample_id ORDER BY relative_abundance DESC, seq_id) AS rn
  FROM fx_abundance WHERE sample_type = 'intra_mix' AND lower(is_core_analysis) = 'yes' AND count >= 2 AND relative_abundance >= 0.0008),
g AS (SELECT sample_id, marker, group_name, sample_type, species_scope, CAST(sum(count) AS BIGINT) AS total_reads_retained,
  count(DISTINCT seq_id) AS n_unique_sequences, -sum(p * ln(p)) AS shannon, 1 - sum(p * p) AS simpson_1_minus_d,
  max(relative_abundance) AS dominant_rel_abundance, sum(CASE WHEN rn <= 3 THEN relative_abundance END) AS top3_rel_abundance,
  sum(CASE WHEN rn <= 10 THEN relative_abundance END) AS top10_rel_abundance,
  coalesce(sum(CASE WHEN rn > 1 THEN relative_abundance END), 0) AS tail_rel_abundance FROM f GROUP BY ALL)
SELECT *, CASE WHEN n_unique_sequences <= 1 THEN 0 ELSE shannon / ln(n_unique_sequences) END AS pielou_evenness,
  CASE substr(group_name, 1, 2) WHEN 'Ea' THEN 'Equus_asinus' WHEN 'Bt' THEN 'Bos_taurus' WHEN 'Ss' THEN 'Sus_scrofa' ELSE 'Unknown' END AS target_species_inferred
FROM g"""


@query("c12_haplotype_complexity", needs=AB, sql=COMPLEX_SQL, r="shannon simpson_1_minus_d dominant_rel_abundance "
       "top3_rel_abundance top10_rel_abundance tail_rel_abundance pielou_evenness")
def _(t):
    return ab.haplotype_complexity(t.abundance, 0.0008)


@query("c13_complexity_by_group", needs=AB, r="mean_n_unique_sequences mean_shannon mean_simpson_1_minus_d mean_pielou_evenness "
       "mean_dominant_rel_abundance mean_tail_rel_abundance", sql=f"""
SELECT marker, group_name, target_species_inferred, count(DISTINCT sample_id) AS n_samples, avg(n_unique_sequences) AS mean_n_unique_sequences,
  avg(shannon) AS mean_shannon, avg(simpson_1_minus_d) AS mean_simpson_1_minus_d, avg(pielou_evenness) AS mean_pielou_evenness,
  avg(dominant_rel_abundance) AS mean_dominant_rel_abundance, avg(tail_rel_abundance) AS mean_tail_rel_abundance
FROM ({COMPLEX_SQL}) c GROUP BY ALL""")
def _(t):
    return ab.complexity_by_group(ab.haplotype_complexity(t.abundance, 0.0008))


RENORM_SQL = f"""SELECT * EXCLUDE (keep), CAST(sum(count) OVER w AS BIGINT) AS retained_total_count,
  sum(relative_abundance) OVER w AS retained_signal_fraction_from_original, count / CAST(sum(count) OVER w AS DOUBLE) AS relative_abundance_renorm
FROM ({LOW_ROWS}) x WHERE keep WINDOW w AS (PARTITION BY threshold_label, sample_id)"""


@query("c14_renormalize", needs=AB, sql=RENORM_SQL,
       r="relative_abundance retained_signal_fraction_from_original relative_abundance_renorm")
def _(t):
    return ab.renormalize(ab.apply_thresholds(t.abundance, LOW_RULES))


@query("c15_renorm_checks", needs=AB, r="renorm_sum retained_signal_fraction_from_original", sql=f"""
SELECT threshold_label, sample_id, count(*) AS n_rows, CAST(sum(count) AS BIGINT) AS retained_total_count, sum(relative_abundance_renorm) AS renorm_sum,
  max(retained_signal_fraction_from_original) AS retained_signal_fraction_from_original FROM ({RENORM_SQL}) r GROUP BY 1, 2""")
def _(t):
    return ab.renorm_checks(ab.renormalize(ab.apply_thresholds(t.abundance, LOW_RULES)))


@query("c16_expected_design", needs=("fx_samples",), r="expected_prop", sql="""
SELECT sample_id, marker, group_name, sample_type, 'TARGET_' || lpad(CAST(i AS VARCHAR), 2, '0') AS target_label, 0.142857::DOUBLE AS expected_prop
FROM (SELECT *, unnest(range(1, 8)) AS i FROM (SELECT * EXCLUDE (i) FROM fx_samples)) s WHERE lower(is_core_analysis) = 'yes' AND sample_type = 'inter_mix'
UNION ALL SELECT sample_id, marker, group_name, sample_type, CASE substr(group_name, 1, 2) WHEN 'Ea' THEN 'Equus_asinus' WHEN 'Bt' THEN 'Bos_taurus'
  WHEN 'Ss' THEN 'Sus_scrofa' ELSE 'REPLACE_WITH_TARGET_SPECIES' END, 1.0::DOUBLE
FROM fx_samples WHERE lower(is_core_analysis) = 'yes' AND sample_type = 'intra_mix'""")
def _(t):
    return ab.expected_design(t.samples, 7)


@query("c16_sample_design", needs=("fx_samples",), sql=f"SELECT {META_SQL} FROM fx_samples WHERE lower(is_core_analysis) = 'yes'")
def _(t):
    return ab.sample_design(t.samples)


@query("c17_sample_feature_levels", needs=("fx_counts", "fx_features"), sql="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY count DESC, md5(seq_id), seq_id) - 1 AS p,
  count(*) OVER (PARTITION BY sample_id) AS u FROM fx_counts WHERE count >= 2),
l AS (SELECT *, 'count2' AS level FROM r UNION ALL SELECT *, 'top1pct' FROM r WHERE p < floor(u * 0.01::DOUBLE)
  UNION ALL SELECT *, 'top0.5pct' FROM r WHERE p < floor(u * 0.005::DOUBLE))
SELECT l.sample_id, l.seq_id, l.count, l.level, f.feat_len, f.feat_cpg_n FROM l LEFT JOIN fx_features f USING (seq_id)""")
def _(t):
    x = ab.sample_feature_levels(ab.level_flags(t.counts), t.features)
    return x.select("sample_id", "seq_id", "count", "level", "feat_len", "feat_cpg_n")
