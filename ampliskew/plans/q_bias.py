"""Queries E01-E12, E19-E25."""

from pyspark.sql import functions as F

from ..operators import abundance as ab
from ..operators import bias
from .q_abundance import LOW_RULES, RENORM_SQL
from .registry import query

NEED = ("fx_abundance", "fx_annotation", "fx_expected")
CORE = """core AS (SELECT a.*, n.species_label FROM fx_abundance a JOIN fx_annotation n USING (seq_id) WHERE lower(is_core_analysis) = 'yes')"""
OBS = """obs AS (SELECT sample_type, sample_id, marker, group_name, species_label, sum(relative_abundance) AS observed_prop FROM core GROUP BY ALL)"""
BIAS = """bias AS (SELECT e.sample_id, e.marker, e.group_name, e.target_label AS species_label, e.expected_prop, coalesce(o.observed_prop, 0) AS observed_prop,
  CASE WHEN e.expected_prop > 0 THEN coalesce(o.observed_prop, 0) / e.expected_prop END AS bias_ratio,
  log2(nullif(CASE WHEN e.expected_prop > 0 THEN coalesce(o.observed_prop, 0) / e.expected_prop END, 0)) AS log2_bias_ratio,
  abs(coalesce(o.observed_prop, 0) - e.expected_prop) AS abs_deviation, pow(coalesce(o.observed_prop, 0) - e.expected_prop, 2) AS sq_error
  FROM fx_expected e LEFT JOIN obs o ON e.sample_id = o.sample_id AND e.marker = o.marker AND e.group_name = o.group_name AND e.target_label = o.species_label
  WHERE e.sample_type = 'inter_mix')"""


def core(t, kind=None):
    x = ab.core_samples(t.abundance.join(t.annotation.select("seq_id", "species_label"), "seq_id"))
    return x.where(F.col("sample_type") == kind) if kind else x


def exp(t, kind):
    return t.expected.where(F.col("sample_type") == kind).drop("sample_type")


@query("e01_observed_props", needs=NEED, r="observed_prop", sql=f"WITH {CORE}, {OBS} SELECT * EXCLUDE (sample_type) FROM obs")
def _(t):
    return bias.observed_props(core(t))


@query("e02_inter_bias", needs=NEED, r="expected_prop observed_prop bias_ratio log2_bias_ratio abs_deviation sq_error",
       sql=f"WITH {CORE}, {OBS}, {BIAS} SELECT * FROM bias")
def _(t):
    return bias.inter_bias(exp(t, "inter_mix"), bias.observed_props(core(t, "inter_mix")))


@query("e03_bias_overall", needs=NEED, r="mean_abs_deviation rmse", sql=f"""
WITH {CORE}, {OBS}, {BIAS} SELECT sample_id, marker, group_name, avg(abs_deviation) AS mean_abs_deviation, sqrt(avg(sq_error)) AS rmse,
  count(DISTINCT species_label) AS n_targets FROM bias GROUP BY ALL""")
def _(t):
    return bias.bias_overall(bias.inter_bias(exp(t, "inter_mix"), bias.observed_props(core(t, "inter_mix"))))


TN = """tn AS (SELECT o.sample_type, o.sample_id, o.marker, o.group_name, CASE WHEN e.target_label IS NULL THEN 0 ELSE 1 END AS is_expected_target,
  sum(observed_prop) AS prop, CASE WHEN e.target_label IS NULL THEN 'nontarget' ELSE 'target' END AS target_class
  FROM obs o LEFT JOIN fx_expected e ON o.sample_id = e.sample_id AND o.species_label = e.target_label GROUP BY ALL)"""


@query("e04_target_nontarget", needs=NEED, r="prop", sql=f"WITH {CORE}, {OBS}, {TN} SELECT * EXCLUDE (sample_type) FROM tn WHERE sample_type = 'inter_mix'")
def _(t):
    return bias.target_nontarget(bias.observed_props(core(t, "inter_mix")), exp(t, "inter_mix"))


@query("e05_combined_targets", needs=NEED, r="prop", sql=f"WITH {CORE}, {OBS}, {TN} SELECT * FROM tn")
def _(t):
    p = [bias.target_nontarget(bias.observed_props(core(t, k)), exp(t, k), keys) for k, keys in
         (("inter_mix", ["sample_id"]), ("intra_mix", bias.SAMPLE))]
    return bias.combine_target_tables(*p)


@query("e05_prop_checks", needs=NEED, r="total_prop", sql=f"""
WITH {CORE}, {OBS} SELECT sample_id, marker, group_name, sum(observed_prop) AS total_prop FROM obs GROUP BY ALL""")
def _(t):
    return bias.prop_checks(bias.observed_props(core(t)))


RN = f"""ren AS (SELECT r.*, n.species_label FROM ({RENORM_SQL}) r JOIN fx_annotation n USING (seq_id)),
obs AS (SELECT threshold_label, sample_type, sample_id, marker, group_name, species_label, sum(relative_abundance_renorm) AS observed_prop FROM ren GROUP BY ALL),
ex AS (SELECT e.*, l.threshold_label FROM fx_expected e, (VALUES {', '.join(f"('{x}')" for x in LOW_RULES)}) l(threshold_label)),
bias AS (SELECT e.threshold_label, e.sample_id, e.marker, e.group_name, e.target_label AS species_label, e.expected_prop, coalesce(o.observed_prop, 0) AS observed_prop
  FROM ex e LEFT JOIN obs o ON e.threshold_label = o.threshold_label AND e.sample_id = o.sample_id AND e.target_label = o.species_label WHERE e.sample_type = 'inter_mix')"""


def multi(t):
    r = ab.renormalize(ab.apply_thresholds(t.abundance, LOW_RULES)).join(t.annotation.select("seq_id", "species_label"), "seq_id")
    return bias.bias_multi_threshold(r, t.expected, LOW_RULES)


@query("e06_bias_by_threshold", needs=NEED, r="expected_prop observed_prop bias_ratio log2_bias_ratio abs_deviation sq_error", sql=f"""
WITH {RN} SELECT *, CASE WHEN expected_prop > 0 THEN observed_prop / expected_prop END AS bias_ratio,
  CASE WHEN expected_prop > 0 AND observed_prop > 0 THEN log2(observed_prop / expected_prop) END AS log2_bias_ratio,
  abs(observed_prop - expected_prop) AS abs_deviation, pow(observed_prop - expected_prop, 2) AS sq_error FROM bias""")
def _(t):
    return multi(t)["inter"]


@query("e06_bias_overall_by_threshold", needs=NEED, r="mean_abs_deviation rmse", sql=f"""
WITH {RN} SELECT threshold_label, sample_id, marker, group_name, avg(abs(observed_prop - expected_prop)) AS mean_abs_deviation,
  sqrt(avg(pow(observed_prop - expected_prop, 2))) AS rmse, count(DISTINCT species_label) AS n_targets FROM bias GROUP BY ALL""")
def _(t):
    return multi(t)["overall"]


@query("e06_targets_by_threshold", needs=NEED, r="prop", sql=f"""
WITH {RN} SELECT o.threshold_label, o.sample_type, o.sample_id, o.marker, o.group_name, CASE WHEN e.target_label IS NULL THEN 0 ELSE 1 END AS is_expected_target,
  sum(observed_prop) AS prop, CASE WHEN e.target_label IS NULL THEN 'nontarget' ELSE 'target' END AS target_class
FROM obs o LEFT JOIN fx_expected e ON o.sample_id = e.sample_id AND o.species_label = e.target_label GROUP BY ALL""")
def _(t):
    return multi(t)["targets"]


@query("e06_checks_by_threshold", needs=NEED, r="total_prop", sql=f"""
WITH {RN} SELECT threshold_label, sample_id, marker, group_name, sum(observed_prop) AS total_prop, sample_type AS scope FROM obs GROUP BY ALL""")
def _(t):
    return multi(t)["checks"]


@query("e07_build_pairs", needs=("fx_pairs",), sql="SELECT * FROM fx_pairs")
def _(t):
    return t.pairs


@query("e07_unpaired_groups", needs=("fx_samples",), sql="""
SELECT species, n_individuals, locus, count(*) FILTER (pcr = 'yes') AS n_yes, count(*) FILTER (pcr = 'no') AS n_no FROM fx_samples
GROUP BY ALL HAVING count(*) FILTER (pcr = 'yes') = 0 OR count(*) FILTER (pcr = 'no') = 0""")
def _(t):
    return bias.unpaired_groups(t.samples)


@query("e08_first_pairs", needs=("fx_samples",), sql="""
SELECT species, locus, min(CASE WHEN pcr = 'yes' THEN file_id END) AS id_yes, min(CASE WHEN pcr = 'no' THEN file_id END) AS id_no
FROM fx_samples GROUP BY ALL HAVING min(CASE WHEN pcr = 'yes' THEN file_id END) IS NOT NULL AND min(CASE WHEN pcr = 'no' THEN file_id END) IS NOT NULL""")
def _(t):
    return bias.first_pairs(t.samples, ["species", "locus"])


@query("e09_sample_totals", needs=("fx_counts",), i="total", sql="SELECT sample_id, sum(count) AS total, count(DISTINCT seq_id) AS n_unique FROM fx_counts GROUP BY 1")
def _(t):
    return bias.sample_totals(t.counts)


@query("e10_paired_log2fc", needs=("fx_training",), r="rel_yes rel_no log2fc", sql="SELECT * FROM fx_training")
def _(t):
    return t.training


@query("e10_paired_log2fc_features", needs=("fx_training", "fx_features"), r="log2fc feat_gc feat_pA", sql="""
SELECT pair_id, seq_id, log2fc, f.* EXCLUDE (seq_id) FROM fx_training JOIN fx_features f USING (seq_id)""")
def _(t):
    return bias.paired_log2fc(t.counts, t.pairs, t.features).select("pair_id", "seq_id", "log2fc", *[c for c in t.features.columns if c != "seq_id"])


@query("e11_aligned_bias", needs=("fx_abundance", "fx_samples"), r="abundance_pcr abundance_nopcr bias_score", sql="""
WITH p AS (SELECT species, locus, min(CASE WHEN pcr = 'yes' THEN file_id END) AS y, min(CASE WHEN pcr = 'no' THEN file_id END) AS n FROM fx_samples GROUP BY ALL)
SELECT p.species, p.locus, a.seq_id, a.relative_abundance AS abundance_pcr, b.relative_abundance AS abundance_nopcr,
  log2((a.relative_abundance + 1e-9) / (b.relative_abundance + 1e-9)) AS bias_score
FROM p JOIN fx_abundance a ON a.sample_id = p.y JOIN fx_abundance b ON b.sample_id = p.n AND a.seq_id = b.seq_id""")
def _(t):
    p = bias.first_pairs(t.samples, ["species", "locus"])
    rel = ab.relative_abundance(t.counts)
    side = lambda c: p.select("species", "locus", F.col(c).alias("sample_id")).join(rel, "sample_id").select("species", "locus", "seq_id", "relative_abundance")
    return bias.aligned_bias(side("id_yes"), side("id_no"), ["species", "locus", "seq_id"])


AUDIT_ROWS = """SELECT yes_file_id, no_file_id FROM fx_training UNION ALL SELECT no_file_id, yes_file_id FROM fx_training WHERE count_no > 40
UNION ALL SELECT yes_file_id, yes_file_id FROM fx_training WHERE count_yes > 60 UNION ALL SELECT yes_file_id, 'gone' FROM fx_training WHERE count_yes > 80"""


@query("e12_audit_pairs", needs=("fx_training", "fx_samples"), sql=f"""
WITH s AS (SELECT * REPLACE (CASE WHEN i IN (4, 6, 5) THEN 1 ELSE n_individuals END AS n_individuals) FROM fx_samples),
al AS (SELECT species, locus, max(CASE WHEN pcr = 'yes' THEN file_id END) AS y, max(CASE WHEN pcr = 'no' THEN file_id END) AS n FROM s WHERE n_individuals > 1
  GROUP BY ALL HAVING count(*) FILTER (pcr = 'yes') = 1 AND count(*) FILTER (pcr = 'no') = 1),
g AS (SELECT yes_file_id, no_file_id, count(*) AS n_rows FROM ({AUDIT_ROWS}) x GROUP BY ALL)
SELECT g.*, CASE WHEN a.file_id IS NULL OR b.file_id IS NULL THEN 'bad' WHEN a.species <> b.species OR a.locus <> b.locus THEN 'bad'
  WHEN a.pcr = b.pcr THEN 'same_pcr' WHEN EXISTS (SELECT 1 FROM al WHERE (al.y = g.yes_file_id AND al.n = g.no_file_id) OR (al.n = g.yes_file_id AND al.y = g.no_file_id)) THEN 'ok'
  ELSE 'bad' END AS verdict
FROM g LEFT JOIN s a ON a.file_id = g.yes_file_id LEFT JOIN s b ON b.file_id = g.no_file_id""")
def _(t):
    y, n = F.col("yes_file_id"), F.col("no_file_id")
    tr = t.training
    rows = (tr.select(y, n).union(tr.where("count_no > 40").select(n, y)).union(tr.where("count_yes > 60").select(y, y.alias("b")))
            .union(tr.where("count_yes > 80").select(y, F.lit("gone"))))
    s = t.samples.withColumn("n_individuals", F.when(F.col("i").isin(4, 6, 5), 1).otherwise(F.col("n_individuals")))
    return bias.audit_pairs(rows, s)


@query("e19_id_overlap", needs=("fx_counts", "fx_catalog"), sql="""
SELECT sample_id, count(*) FILTER (seq_id IN (SELECT seq_id FROM fx_catalog WHERE sequence LIKE 'A%')) AS n_present FROM fx_counts GROUP BY 1""")
def _(t):
    return bias.id_overlap(t.catalog.where(F.col("sequence").startswith("A")), t.counts)


@query("e20_coverage_metrics", needs=("fx_depth", "fx_samples"), sql="""
SELECT s.file_id, s.species, s.locus, s.pcr, round(avg(depth), 2) AS mean_coverage, round(stddev_pop(depth), 2) AS std_dev,
  round(stddev_pop(depth) / avg(depth), 4) AS cv, count(*) AS covered_bases FROM fx_depth d JOIN fx_samples s ON d.file_id = s.file_id GROUP BY ALL""")
def _(t):
    return bias.coverage_metrics(t.depth, t.samples)


KD_SQL = """
WITH km AS (SELECT seq_id AS contig, k, s AS start, substr(sequence, s, k) AS kmer FROM (SELECT seq_id, sequence, k, unnest(range(1, length(sequence) - k + 2)) AS s
  FROM fx_catalog, (VALUES (3), (4)) v(k)) x),
m AS (SELECT file_id, avg(depth) AS m FROM fx_depth WHERE depth > 0 GROUP BY 1),
w AS (SELECT d.file_id, km.contig, km.k, km.start, km.kmer, sum(d.depth) / CAST(km.k AS DOUBLE) AS loc
  FROM fx_depth d JOIN km ON d.contig = km.contig AND d.pos >= km.start AND d.pos < km.start + km.k GROUP BY d.file_id, km.contig, km.k, km.start, km.kmer),
r AS (SELECT p.pair_id, n.k, n.kmer, (coalesce(y.loc, 0) / my.m) / (n.loc / mn.m) AS r
  FROM fx_pairs p JOIN m my ON my.file_id = p.yes_file_id JOIN m mn ON mn.file_id = p.no_file_id JOIN w n ON n.file_id = p.no_file_id AND n.loc > 5
  LEFT JOIN w y ON y.file_id = p.yes_file_id AND y.contig = n.contig AND y.k = n.k AND y.start = n.start)
SELECT pair_id, k, kmer, count(*) AS n, avg(r) AS mean_ratio, stddev_pop(r) AS std_ratio FROM r GROUP BY 1, 2, 3"""


def reference(t):
    return t.catalog.withColumnRenamed("seq_id", "contig")


@query("e21_kmer_depth_ratio", needs=("fx_catalog", "fx_depth", "fx_pairs"), r="mean_ratio std_ratio", sql=KD_SQL)
def _(t):
    return bias.kmer_depth_ratio(reference(t), t.depth, t.pairs)


SHIFT_SQL = """
WITH u AS (SELECT file_id, pos, upper(ref) AS ref, depth, upper(bases) AS b FROM fx_pileup WHERE depth > 0),
c AS (SELECT file_id, pos, ref, depth, x.base, x.o, length(b) - length(replace(b, x.base, '')) + CASE WHEN ref = x.base THEN length(b) - length(translate(b, '.,', '')) ELSE 0 END AS n
  FROM u, (VALUES ('A', 0), ('T', 1), ('C', 2), ('G', 3)) x(base, o)),
f AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY file_id, pos) AS DOUBLE) AS f FROM c),
d AS (SELECT p.pair_id, y.pos, n.ref AS ref_base, n.depth AS depth_no, y.depth AS depth_pcr, y.base, y.f - n.f AS d, y.f AS fy, n.f AS fn,
  row_number() OVER (PARTITION BY p.pair_id, y.pos ORDER BY abs(y.f - n.f) DESC, y.o) AS rn
  FROM fx_pairs p JOIN f y ON y.file_id = p.yes_file_id JOIN f n ON n.file_id = p.no_file_id AND n.pos = y.pos AND n.base = y.base)
SELECT pair_id, pos, ref_base, depth_no, depth_pcr, round(max(CASE WHEN rn = 1 THEN d END), 4) AS max_diff,
  'Delta_' || max(CASE WHEN rn = 1 THEN base END) AS change_type, {cols}
FROM d GROUP BY pair_id, pos, ref_base, depth_no, depth_pcr HAVING max(CASE WHEN rn = 1 THEN abs(d) END) > 0.05""".replace(
    "{cols}", ", ".join(f"round(max(CASE WHEN base = '{b}' THEN {'fn' if s == 'no' else 'fy'} END), 3) AS freq_{s}_{b}" for s in ("no", "pcr") for b in "ATCG"))


@query("e22_base_shift", needs=("fx_pileup", "fx_pairs"), sql=SHIFT_SQL)
def _(t):
    return bias.base_shift(t.pileup, t.pairs)


@query("e23_contig_abundance", needs=("fx_idxstats",), r="share", sql="""
SELECT contig, file_id, mapped / CAST(sum(mapped) OVER (PARTITION BY file_id) AS DOUBLE) AS share, 0.1::DOUBLE AS expected FROM fx_idxstats""")
def _(t):
    return bias.contig_abundance(t.idxstats)


FILES = [f"src{i}" for i in range(20)]


@query("e23_contig_matrix", needs=("fx_idxstats",), sql=f"""
SELECT contig, {', '.join(f"round(coalesce(max(CASE WHEN file_id = '{f}' THEN share END), 0), 4) AS {f}" for f in FILES)}, 0.1::DOUBLE AS expected
FROM (SELECT contig, file_id, mapped / CAST(sum(mapped) OVER (PARTITION BY file_id) AS DOUBLE) AS share FROM fx_idxstats) x GROUP BY 1""")
def _(t):
    return bias.contig_matrix(bias.contig_abundance(t.idxstats), FILES)


@query("e24_variable_kmers", needs=("fx_catalog", "fx_depth", "fx_pairs"), r="variance", sql=f"""
SELECT kmer, var_samp(round(mean_ratio, 6)) AS variance, count(*) AS n_groups FROM ({KD_SQL}) x WHERE k = 3 GROUP BY 1 ORDER BY variance DESC NULLS LAST, kmer LIMIT 30""")
def _(t):
    k = bias.kmer_depth_ratio(reference(t), t.depth, t.pairs).withColumn("mean_ratio", F.round("mean_ratio", 6))
    return bias.variable_kmers(k)


@query("e24_change_counts", needs=("fx_pileup", "fx_pairs"), sql=f"SELECT pair_id, change_type, count(*) AS n_sites FROM ({SHIFT_SQL}) x GROUP BY ALL")
def _(t):
    return bias.change_counts(bias.base_shift(t.pileup, t.pairs))


LB = f"""lb AS (SELECT threshold_label, sample_id, marker, regexp_replace(group_name, '^.*_', '') AS group_name, species_label,
  round(CASE WHEN expected_prop > 0 AND observed_prop > 0 THEN log2(observed_prop / expected_prop) END, 6) AS log2_bias_ratio FROM bias)"""


def log_bias(t):
    return multi(t)["inter"].select("threshold_label", "sample_id", "marker", F.regexp_replace("group_name", "^.*_", "").alias("group_name"),
                                    "species_label", F.round("log2_bias_ratio", 6).alias("log2_bias_ratio"))


@query("e25_case_candidates", needs=NEED, sql=f"""
WITH {RN}, {LB}, m AS (SELECT * FROM lb WHERE threshold_label = 'rel_ge_0.0003')
SELECT * FROM (SELECT *, 'high' AS "case" FROM m ORDER BY log2_bias_ratio DESC NULLS LAST, sample_id, species_label LIMIT 20) a
UNION ALL SELECT * FROM (SELECT *, 'low' AS "case" FROM m ORDER BY log2_bias_ratio ASC NULLS LAST, sample_id, species_label LIMIT 20) b""")
def _(t):
    return bias.case_candidates(log_bias(t), main="rel_ge_0.0003")


@query("e25_marker_discordant", needs=NEED, r="bias_12S bias_16S marker_gap_abs", nudge=1e-9, sql=f"""
WITH {RN}, {LB}, p AS (SELECT group_name, species_label, avg(CASE WHEN marker = '12S' THEN log2_bias_ratio END) AS "bias_12S",
  avg(CASE WHEN marker = '16S' THEN log2_bias_ratio END) AS "bias_16S" FROM lb WHERE threshold_label = 'rel_ge_0.0003' GROUP BY 1, 2)
SELECT *, abs("bias_12S" - "bias_16S") AS marker_gap_abs FROM p ORDER BY marker_gap_abs DESC NULLS LAST, group_name, species_label LIMIT 20""")
def _(t):
    return bias.marker_discordant(log_bias(t).where(F.col("threshold_label") == "rel_ge_0.0003"), ["group_name", "species_label"])
