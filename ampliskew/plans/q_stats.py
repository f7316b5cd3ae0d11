"""Queries H01-H25."""

from pyspark.sql import functions as F

from ..functions.cols import rnd
from ..operators import abundance as ab
from ..operators import stats as st
from .fixtures import FEATS
from .q_abundance import LOW_RULES, RENORM_SQL
from .q_bias import multi
from .registry import query

LONG = ("fx_long",)


def training(t):
    return t.training.join(t.features, "seq_id")


def long(t):
    return st.features_long(training(t), FEATS)


@query("h01_features_long", needs=LONG, r="x", sql="SELECT pair_id, seq_id, feature, x, CAST(count_yes + count_no AS DOUBLE) AS w FROM fx_long WHERE count_yes + count_no >= 1")
def _(t):
    return long(t).select("pair_id", "seq_id", "feature", "x", "w")


CORR = """corr AS (SELECT pair_id, feature, n, w_sum, CASE WHEN sxx / w_sum - pow(sx / w_sum, 2) > 0 AND syy / w_sum - pow(sy / w_sum, 2) > 0
  THEN (sxy / w_sum - sx / w_sum * sy / w_sum) / sqrt((sxx / w_sum - pow(sx / w_sum, 2)) * (syy / w_sum - pow(sy / w_sum, 2))) ELSE 0 END AS pearson_corr
  FROM (SELECT pair_id, feature, count(*) AS n, sum(w) AS w_sum, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * log2fc) AS sy, sum(w * log2fc * log2fc) AS syy, sum(w * x * log2fc) AS sxy
  FROM (SELECT *, CAST(count_yes + count_no AS DOUBLE) AS w FROM fx_long) l GROUP BY 1, 2) m)"""


@query("h02_weighted_corr", needs=LONG, r="pearson_corr", sql=f"WITH {CORR} SELECT * FROM corr")
def _(t):
    return st.weighted_corr(long(t))


META = """SELECT feature, count(*) AS n_pairs, avg(abs(pearson_corr)) AS mean_abs_corr, median(abs(pearson_corr)) AS median_abs_corr,
  count(*) FILTER (pearson_corr > 0) / CAST(count(*) AS DOUBLE) AS frac_pos_corr,
  avg(abs(pearson_corr)) * 2 * abs(count(*) FILTER (pearson_corr > 0) / CAST(count(*) AS DOUBLE) - 0.5) AS stability_score FROM corr GROUP BY 1"""
META_R = "mean_abs_corr median_abs_corr frac_pos_corr stability_score"


@query("h03_meta_corr", needs=LONG, r=META_R, sql=f"WITH {CORR} {META}")
def _(t):
    return st.meta_corr(st.weighted_corr(long(t)))


@query("h04_top_features", needs=LONG, r=META_R, sql=f"WITH {CORR} SELECT * FROM ({META}) m WHERE n_pairs >= 5 ORDER BY mean_abs_corr DESC, feature LIMIT 3")
def _(t):
    return st.top_features(st.meta_corr(st.weighted_corr(long(t))), "mean_abs_corr", 3, 5)


SHIFT = """sh AS (SELECT *, delta_yes_minus_no / nullif(sqrt((vy + vn) / 2), 0) AS effect_d, sqrt(vy) AS sd_yes, sqrt(vn) AS sd_no FROM
  (SELECT *, mean_yes - mean_no AS delta_yes_minus_no, greatest(qy / nullif(wy, 0) - mean_yes * mean_yes, 0) AS vy, greatest(qn / nullif(wn, 0) - mean_no * mean_no, 0) AS vn FROM
  (SELECT pair_id, feature, sum(count_yes)::DOUBLE AS wy, sum(count_no)::DOUBLE AS wn, sum(count_yes * x) / nullif(sum(count_yes), 0) AS mean_yes, sum(count_no * x) / nullif(sum(count_no), 0) AS mean_no,
  sum(count_yes * x * x) AS qy, sum(count_no * x * x) AS qn, count(*) FILTER (count_yes >= 1) AS ny_rows, count(*) FILTER (count_no >= 1) AS nn_rows FROM fx_long GROUP BY 1, 2) a) b)"""


@query("h05_weighted_shift", needs=("fx_long", "fx_pairs"), r="mean_yes mean_no delta_yes_minus_no sd_yes sd_no effect_d", sql=f"""
WITH {SHIFT} SELECT pair_id, feature, wy, wn, mean_yes, mean_no, delta_yes_minus_no, sd_yes, sd_no, effect_d, ny_rows, nn_rows, p.species, p.locus FROM sh JOIN fx_pairs p USING (pair_id)""")
def _(t):
    return st.weighted_shift(long(t), t.pairs).drop("n_individuals", "yes_file_id", "no_file_id")


SHIFT_META = """count(delta_yes_minus_no) AS {n}, median(delta_yes_minus_no) AS median_delta, avg(abs(delta_yes_minus_no)) AS mean_abs_delta,
  count(*) FILTER (delta_yes_minus_no > 0) / CAST(count(delta_yes_minus_no) AS DOUBLE) AS frac_pos_delta, median(abs(effect_d)) AS median_abs_effect_d"""


@query("h06_meta_shift", needs=LONG, r="median_delta mean_abs_delta frac_pos_delta median_abs_effect_d", sql=f"WITH {SHIFT} SELECT feature, {SHIFT_META.format(n='n_pairs')} FROM sh GROUP BY 1")
def _(t):
    return st.meta_shift(st.weighted_shift(long(t), t.pairs))


JOINT = f"""gs AS (SELECT pair_id, 'ALL' AS group_type, 'ALL' AS group_value FROM fx_pairs UNION ALL SELECT pair_id, 'locus', locus FROM fx_pairs),
jc AS (SELECT group_type, group_value, feature, count(*) AS n_pairs_corr, avg(abs(pearson_corr)) AS mean_abs_corr, median(abs(pearson_corr)) AS median_abs_corr,
  count(*) FILTER (pearson_corr > 0) / CAST(count(*) AS DOUBLE) AS frac_pos_corr FROM corr JOIN gs USING (pair_id) GROUP BY 1, 2, 3),
js AS (SELECT group_type, group_value, feature, {SHIFT_META.format(n='n_pairs_shift')} FROM sh JOIN gs USING (pair_id) GROUP BY 1, 2, 3),
jj AS (SELECT *, 2 * abs(frac_pos_corr - 0.5) AS sign_cons_corr, 2 * abs(frac_pos_delta - 0.5) AS sign_cons_delta FROM jc JOIN js USING (group_type, group_value, feature)),
joint AS (SELECT *, mean_abs_corr * sign_cons_corr AS stability_corr, mean_abs_corr * mean_abs_delta AS joint_strength,
  mean_abs_corr * sign_cons_corr * mean_abs_delta * sign_cons_delta AS joint_stable,
  CAST(row_number() OVER (PARTITION BY group_type, group_value ORDER BY round(mean_abs_corr * sign_cons_corr * mean_abs_delta * sign_cons_delta, 12) DESC, feature) AS INTEGER) AS rank FROM jj)"""


def joint(t):
    return st.joint_rank(st.pair_statistics(long(t)), None, t.pairs)


@query("h07_joint_rank", needs=("fx_long", "fx_pairs"), r="mean_abs_corr median_abs_corr frac_pos_corr sign_cons_corr stability_corr median_delta mean_abs_delta frac_pos_delta "
       "sign_cons_delta median_abs_effect_d joint_strength joint_stable", sql=f"WITH {CORR}, {SHIFT}, {JOINT} SELECT * FROM joint")
def _(t):
    return joint(t)


@query("h08_infer_delta", needs=LONG, r="delta_yes_minus_no", sql=f"WITH {SHIFT} SELECT pair_id, feature, mean_yes - mean_no AS delta_yes_minus_no, CAST(NULL AS DOUBLE) AS effect_d FROM sh")
def _(t):
    return st.infer_delta(st.weighted_shift(long(t), t.pairs).select("pair_id", "feature", "mean_yes", "mean_no")).drop("mean_yes", "mean_no")


KX = """kx AS (SELECT seq_id, kmer AS feature, CAST(count(*) AS DOUBLE) AS x FROM (SELECT seq_id, unnest([substr(sequence, i, 3) for i in range(1, length(sequence) - 1)]) AS kmer FROM fx_catalog) w GROUP BY 1, 2)"""


@query("h09_sparse_kmer_stats", needs=("fx_training", "fx_catalog"), r="pearson_corr mean_yes mean_no delta_yes_minus_no effect_d", sql=f"""
WITH {KX}, fs AS (SELECT DISTINCT feature FROM kx),
fx_long AS (SELECT t.*, fs.feature, coalesce(kx.x, 0) AS x FROM fx_training t CROSS JOIN fs LEFT JOIN kx ON kx.seq_id = t.seq_id AND kx.feature = fs.feature), {CORR}, {SHIFT}
SELECT c.pair_id, c.feature, c.n AS n_points, c.w_sum, c.pearson_corr, s.mean_yes, s.mean_no, s.delta_yes_minus_no, s.effect_d FROM corr c JOIN sh s ON c.pair_id = s.pair_id AND c.feature = s.feature""")
def _(t):
    return st.sequence_kmer_stats(t.training, t.catalog, 3).drop("wy", "wn", "sd_yes", "sd_no")


@query("h10_merge_stats", needs=LONG, r="pearson_corr", sql=f"""
WITH {CORR} SELECT pair_id, feature, CASE WHEN feature = 'feat_gc' THEN n END AS n, CASE WHEN feature IN ('feat_gc', 'feat_pA') THEN NULL ELSE w_sum END AS w_sum,
  CASE WHEN feature = 'feat_gc' THEN -pearson_corr WHEN feature = 'feat_pA' THEN -pearson_corr ELSE pearson_corr END AS pearson_corr FROM corr WHERE feature <> 'feat_len'""".replace(
    "CASE WHEN feature = 'feat_gc' THEN n END AS n", "CASE WHEN feature IN ('feat_gc', 'feat_pA') THEN CAST(n AS DOUBLE) END AS n"))
def _(t):
    cr = st.weighted_corr(long(t))
    a = cr.select("pair_id", "feature", "w_sum", "pearson_corr")
    b = cr.where(F.col("feature").isin("feat_gc", "feat_pA")).select("pair_id", "feature", F.col("n").cast("double").alias("n"), (-F.col("pearson_corr")).alias("pearson_corr"))
    return st.merge_stats(a, b, "second", "^feat_", "_len$")


@query("h11_type_counts", needs=("fx_long", "fx_pairs"), sql=f"""
WITH {CORR}, {SHIFT}, {JOINT} SELECT group_type, group_value, CASE WHEN feature LIKE 'feat\\_pr\\_%' ESCAPE '\\' THEN 'primer' ELSE 'seq_global' END AS feature_type, count(*) AS n_features FROM joint GROUP BY ALL""")
def _(t):
    return st.type_counts(joint(t))


@query("h11_export_top", needs=("fx_long", "fx_pairs"), sql=f"""
WITH {CORR}, {SHIFT}, {JOINT}, x AS (SELECT group_type, group_value, feature, rank, CASE WHEN feature LIKE 'feat\\_pr\\_%' ESCAPE '\\' THEN 'primer' ELSE 'seq_global' END AS feature_type FROM joint)
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY group_type, group_value, feature_type ORDER BY rank) <= 2""")
def _(t):
    return st.export_top(joint(t), 2).select("group_type", "group_value", "feature", "rank", "feature_type")


F2 = """fa AS (SELECT seq_id, 'm' || (length(sequence) % 2) AS marker, CAST(length(sequence) AS VARCHAR) AS a FROM fx_catalog WHERE sequence NOT LIKE 'A%'),
fb AS (SELECT seq_id, 'm' || (length(sequence) % 2) AS marker, CASE WHEN sequence LIKE '%AAAA%' THEN 'many' ELSE '1.5' END AS b FROM fx_catalog WHERE sequence NOT LIKE 'C%')"""


def two_tables(t):
    mk = F.concat(F.lit("m"), F.length("sequence") % 2).alias("marker")
    a = t.catalog.where(~F.col("sequence").startswith("A")).select("seq_id", mk, F.length("sequence").cast("string").alias("a"))
    b = t.catalog.where(~F.col("sequence").startswith("C")).select("seq_id", mk, F.when(F.col("sequence").contains("AAAA"), "many").otherwise("1.5").alias("b"))
    return st.merge_features([a, b])


@query("h12_merge_features", needs=("fx_catalog",), sql=f"WITH {F2} SELECT coalesce(fa.seq_id, fb.seq_id) AS seq_id, coalesce(fa.marker, fb.marker) AS marker, a, b FROM fa FULL JOIN fb ON fa.seq_id = fb.seq_id AND fa.marker = fb.marker")
def _(t):
    return two_tables(t)


@query("h12_feature_qc", needs=("fx_catalog",), sql=f"""
WITH {F2}, m AS (SELECT coalesce(fa.marker, fb.marker) AS marker, a, b FROM fa FULL JOIN fb ON fa.seq_id = fb.seq_id)
SELECT marker AS threshold_label, CASE WHEN count(TRY_CAST(a AS DOUBLE)) = count(a) THEN 1 ELSE 0 END + CASE WHEN count(TRY_CAST(b AS DOUBLE)) = count(b) THEN 1 ELSE 0 END AS n_numeric_features FROM m GROUP BY 1""")
def _(t):
    return st.feature_qc(two_tables(t).withColumnRenamed("marker", "threshold_label"), ["a", "b"])


NEED = ("fx_abundance", "fx_annotation", "fx_features")
SPF = f"""rf AS (SELECT r.*, n.species_label, CASE WHEN f.feat_cpg_n = 0 THEN NULL ELSE f.feat_gc END AS feat_gc, f.feat_len FROM ({RENORM_SQL}) r JOIN fx_annotation n USING (seq_id) JOIN fx_features f USING (seq_id)),
sf AS (SELECT threshold_label, sample_id, marker, group_name, species_label, count(*) AS n_sequences_in_species, CAST(sum(count) AS BIGINT) AS species_total_count_retained,
  sum(relative_abundance_renorm * feat_gc) / sum(CASE WHEN feat_gc IS NOT NULL THEN relative_abundance_renorm END) AS feat_gc, sum(relative_abundance_renorm * feat_len) / sum(relative_abundance_renorm) AS feat_len FROM rf GROUP BY ALL)"""


def renorm_features(t):
    r = ab.renormalize(ab.apply_thresholds(t.abundance, LOW_RULES)).join(t.annotation.select("seq_id", "species_label"), "seq_id")
    f = t.features.select("seq_id", F.when(F.col("feat_cpg_n") > 0, F.col("feat_gc")).alias("feat_gc"), "feat_len")
    return r.join(f, "seq_id")


@query("h13_species_features", needs=NEED, r="feat_gc feat_len", sql=f"WITH {SPF} SELECT * FROM sf")
def _(t):
    return st.species_features(renorm_features(t), ["feat_gc", "feat_len"])


HAP = f"""hp AS (SELECT *, row_number() OVER (PARTITION BY threshold_label, sample_id ORDER BY relative_abundance_renorm DESC, md5(seq_id), seq_id) AS dominant_rank
  FROM rf WHERE sample_type = 'intra_mix' AND lower(is_core_analysis) = 'yes')"""


@query("h14_haplotype_rank", needs=NEED, sql=f"""
WITH {SPF}, {HAP} SELECT threshold_label, sample_id, seq_id, dominant_rank, CASE WHEN dominant_rank = 1 THEN 1 ELSE 0 END AS dominant_flag, CASE WHEN dominant_rank > 1 THEN 1 ELSE 0 END AS tail_flag FROM hp""")
def _(t):
    return st.haplotype_rank(renorm_features(t)).select("threshold_label", "sample_id", "seq_id", "dominant_rank", "dominant_flag", "tail_flag")


@query("h17_tail_vs_dom", needs=NEED, r="proxy", sql=f"""
WITH {SPF}, {HAP} SELECT threshold_label, sample_id, seq_id, CASE WHEN dominant_rank = 1 THEN relative_abundance_renorm ELSE -relative_abundance_renorm END AS proxy FROM hp""")
def _(t):
    return st.haplotype_rank(renorm_features(t)).select("threshold_label", "sample_id", "seq_id", st.tail_vs_dom().alias("proxy"))


def species_long(t):
    b = multi(t)["inter"]
    s = b.join(st.species_features(renorm_features(t), ["feat_gc", "feat_len"]), ["threshold_label", "sample_id", "marker", "group_name", "species_label"], "left")
    key = F.concat_ws("|", F.lit("species"), "threshold_label", "marker", F.lit("abs_deviation"))
    return s.select(key.alias("strata"), rnd("abs_deviation", 9).alias("y"), rnd("feat_gc", 9).alias("feat_gc"), rnd("feat_len", 9).alias("feat_len")).unpivot(["strata", "y"], ["feat_gc", "feat_len"], "feature", "x")


@query("h15_h16_univariate_stats")
def _(t):
    return st.univariate_stats(species_long(t), ["strata"])


RHO = """d AS (SELECT strata, feature, x, y FROM sl WHERE x IS NOT NULL AND y IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY strata, feature ORDER BY x) + (count(*) OVER (PARTITION BY strata, feature, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY strata, feature ORDER BY y) + (count(*) OVER (PARTITION BY strata, feature, y) - 1) / 2.0 AS ry FROM d)"""
TR = """sl AS (SELECT pair_id AS strata, feature, round(x, 9) AS x, round(log2fc, 9) AS y FROM fx_long)"""


@query("h15_spearman_pearson", needs=LONG, r="spearman pearson", sql=f"""
WITH {TR}, {RHO} SELECT strata, feature, count(*) AS n, corr(rx, ry) AS spearman, corr(x, y) AS pearson FROM rk GROUP BY 1, 2 HAVING count(*) >= 6""")
def _(t):
    lg = long(t).select(F.col("pair_id").alias("strata"), "feature", rnd("x", 9).alias("x"), rnd("log2fc", 9).alias("y"))
    return st.rank_corr(lg, ["strata", "feature"], min_n=6)


@query("h16_bh_fdr", needs=("fx_catalog",), r="q", sql="""
WITH d AS (SELECT seq_id, substr(sequence, 1, 2) AS stratum, CASE WHEN sequence LIKE '%GGGGG%' THEN NULL ELSE round(pow(('0x' || substr(md5(seq_id), 1, 6))::BIGINT / 16777215.0::DOUBLE, 3), 3) END AS p FROM fx_catalog),
r AS (SELECT *, p * count(p) OVER (PARTITION BY stratum) / (rank() OVER (PARTITION BY stratum, p IS NULL ORDER BY p) + count(*) OVER (PARTITION BY stratum, p) - 1) AS raw FROM d)
SELECT seq_id, stratum, p, CASE WHEN p IS NOT NULL THEN least(1, min(raw) OVER (PARTITION BY stratum, p IS NULL ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) END AS q FROM r""")
def _(t):
    u = F.conv(F.substring(F.md5("seq_id"), 1, 6), 16, 10).cast("double") / 16777215.0
    d = t.catalog.select("seq_id", F.substring("sequence", 1, 2).alias("stratum"), F.when(~F.col("sequence").contains("GGGGG"), F.round(u * u * u, 3)).alias("p"))
    return st.bh_fdr(d, "p", ["stratum"])


@query("h18_top_signals")
def _(t):
    s = st.univariate_stats(species_long(t), ["strata"]).withColumn("data_level", F.lit("species"))
    return st.top_signals(s, 20, {"global": ["feat_gc", "feat_len"], "mismatch": ["feat_gc"]})


def ext_long(t):
    return long(t).select(F.col("pair_id").alias("compare_id"), "seq_id", "feature", rnd("x", 9).alias("x"), rnd("log2fc", 9).alias("y"))


@query("h19_external_corr")
def _(t):
    return st.external_corr(ext_long(t))


@query("h19_pairs_overview", needs=("fx_training",), sql="SELECT pair_id AS compare_id, species AS dataset, yes_file_id AS exp_yes, no_file_id AS exp_no, count(*) AS rows FROM fx_training GROUP BY ALL")
def _(t):
    return st.pairs_overview(t.training.select(F.col("pair_id").alias("compare_id"), F.col("species").alias("dataset"), F.col("yes_file_id").alias("exp_yes"), F.col("no_file_id").alias("exp_no")))


TB_R = "mean_pos median_pos mean_neg median_neg delta_mean delta_median cohen_d"


@query("h20_topbottom_shift", needs=LONG, r=TB_R, sql="""
WITH l AS (SELECT pair_id AS compare_id, seq_id, feature, x, round(log2fc, 9) AS y FROM fx_long),
r AS (SELECT *, row_number() OVER (PARTITION BY compare_id, feature ORDER BY y DESC, seq_id DESC) AS a, row_number() OVER (PARTITION BY compare_id, feature ORDER BY y, seq_id) AS b FROM l),
g AS (SELECT compare_id, feature, count(*) FILTER (a <= 200) AS n_pos, count(*) FILTER (b <= 200) AS n_neg, avg(x) FILTER (a <= 200) AS mean_pos, avg(x) FILTER (b <= 200) AS mean_neg,
  median(x) FILTER (a <= 200) AS median_pos, median(x) FILTER (b <= 200) AS median_neg, var_samp(x) FILTER (a <= 200) AS vp, var_samp(x) FILTER (b <= 200) AS vn FROM r GROUP BY 1, 2)
SELECT compare_id, feature, n_pos, n_neg, mean_pos, mean_neg, median_pos, median_neg, mean_pos - mean_neg AS delta_mean, median_pos - median_neg AS delta_median,
  (mean_pos - mean_neg) / sqrt(((n_pos - 1) * vp + (n_neg - 1) * vn) / (n_pos + n_neg - 2)) AS cohen_d FROM g""")
def _(t):
    x = training(t).withColumn("compare_id", F.col("pair_id")).withColumn("log2fc", rnd("log2fc", 9))
    return st.topbottom_shift(x, FEATS)


def strat_wide(t):
    return training(t).select("locus", rnd("log2fc", 9).alias("y"), *[F.when(F.col(f) != 3.0, F.col(f)).alias(f) for f in FEATS])


def strat_long(t):
    return long(t).select("locus", F.concat_ws("|", "pair_id", "seq_id").alias("row_id"), "feature", F.when(F.col("x") != 3.0, F.col("x")).alias("x"), rnd("log2fc", 9).alias("y"))


@query("h21_feature_assoc")
def _(t):
    return st.feature_assoc(strat_long(t), ["locus"])


@query("h21_assoc_moments", needs=LONG, r="rho mean sd missing_rate", sql=f"""
WITH sl AS (SELECT locus AS strata, feature, CASE WHEN x <> 3 THEN x END AS x, round(log2fc, 9) AS y FROM fx_long), {RHO},
c AS (SELECT strata, feature, corr(rx, ry) AS rho FROM rk GROUP BY 1, 2)
SELECT sl.strata AS locus, sl.feature, count(*) AS n_rows, avg(x) AS mean, stddev_pop(x) AS sd, 1 - count(x) / CAST(count(*) AS DOUBLE) AS missing_rate, any_value(rho) AS rho
FROM sl JOIN c ON c.strata = sl.strata AND c.feature = sl.feature GROUP BY 1, 2""")
def _(t):
    return st.feature_assoc(strat_long(t), ["locus"]).select("locus", "feature", "n_rows", "mean", "sd", "missing_rate", "rho")


@query("h21_top_assoc")
def _(t):
    return st.top_assoc(st.feature_assoc(strat_long(t), ["locus"]), ["locus"], 3)


@query("h22_mw_shift", needs=LONG, r="median_a median_b delta_median cliff_delta", sql="""
WITH l AS (SELECT locus, feature, CASE WHEN x <> 3 THEN x END AS x, round(log2fc, 9) AS y, pair_id, seq_id FROM fx_long),
q AS (SELECT locus, quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM l WHERE feature = 'feat_gc' GROUP BY 1),
s AS (SELECT l.*, 'pos_vs_neg' AS contrast, CASE WHEN y > 0 THEN 'A' ELSE 'B' END AS side FROM l WHERE y <> 0
  UNION ALL SELECT l.*, 'top10_vs_bottom10', CASE WHEN y >= hi THEN 'A' ELSE 'B' END FROM l JOIN q USING (locus) WHERE y >= hi OR y <= lo),
d AS (SELECT *, rank() OVER (PARTITION BY locus, contrast, feature ORDER BY x) + (count(*) OVER (PARTITION BY locus, contrast, feature, x) - 1) / 2.0 AS r FROM s WHERE x IS NOT NULL),
g AS (SELECT locus, contrast, feature, count(*) FILTER (side = 'A') AS n_a, count(*) FILTER (side = 'B') AS n_b, median(x) FILTER (side = 'A') AS median_a, median(x) FILTER (side = 'B') AS median_b,
  sum(r) FILTER (side = 'A') AS r1 FROM d GROUP BY 1, 2, 3)
SELECT locus, contrast, feature, n_a, n_b, median_a, median_b, median_a - median_b AS delta_median, CASE WHEN n_a < 20 OR n_b < 20 THEN 1 ELSE 0 END AS insufficient,
  CAST(2 * (r1 - n_a * (n_a + 1) / 2) / (CAST(n_a AS DOUBLE) * n_b) - 1 AS DOUBLE) AS cliff_delta FROM g""")
def _(t):
    return st.mw_shift(strat_wide(t), ["locus"], FEATS).drop("p", "q")


@query("h22_mw_tests")
def _(t):
    return st.mw_shift(strat_wide(t), ["locus"], FEATS)


@query("h23_feature_corr_matrix", needs=LONG, digits=5, r="corr", sql="""
SELECT a.locus, a.feature AS feature_i, b.feature AS feature_j, corr(a.x, b.x) AS corr FROM fx_long a JOIN fx_long b ON a.pair_id = b.pair_id AND a.seq_id = b.seq_id GROUP BY 1, 2, 3""")
def _(t):
    return st.feature_corr_matrix(training(t), ["locus"], FEATS)


@query("h23_feature_corr_gaps", needs=LONG, digits=5, r="corr", sql="""
WITH l AS (SELECT * FROM fx_long WHERE (count_yes + count_no + length(feature)) % 5 <> 0)
SELECT a.locus, a.feature AS feature_i, b.feature AS feature_j, corr(a.x, b.x) AS corr FROM l a JOIN l b ON a.pair_id = b.pair_id AND a.seq_id = b.seq_id GROUP BY 1, 2, 3""")
def _(t):
    """Every feature lacks about a fifth of its rows, each other ones."""
    gap = lambda f: F.when((F.col("count_yes") + F.col("count_no") + len(f)) % 5 != 0, F.col(f))
    return st.feature_corr_matrix(training(t).withColumns({f: gap(f) for f in FEATS}), ["locus"], FEATS)


@query("h24_feature_trend", needs=LONG, r="y_lo y_hi y_mean x_mean y_median x_median", sql="""
WITH l AS (SELECT locus, feature, x, round(log2fc, 9) AS y FROM fx_long),
e AS (SELECT locus, list_sort(list_distinct(quantile_cont(y, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM l WHERE feature = 'feat_gc' GROUP BY 1),
b AS (SELECT l.*, e, len([v for v in e[2:len(e) - 1] if v < y]) AS bin FROM l JOIN e USING (locus))
SELECT locus, feature, CAST(bin AS INTEGER) AS bin, count(*) AS bin_n, any_value(e[bin + 1]) AS y_lo, any_value(e[bin + 2]) AS y_hi, avg(y) AS y_mean, avg(x) AS x_mean, median(y) AS y_median, median(x) AS x_median,
  CASE WHEN count(*) < 20 THEN 1 ELSE 0 END AS small_bin FROM b GROUP BY 1, 2, 3""")
def _(t):
    return st.feature_trend(training(t).withColumn("y", rnd("log2fc", 9)), ["locus"], FEATS)


TOPF = """tp AS (SELECT pair_id AS tag, 's' AS species, 'l' AS locus, 'v' AS variant, feature, abs(round(pearson_corr, 9)) AS s FROM corr
QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY abs(round(pearson_corr, 9)) DESC, feature) <= 4)"""


def top_lists(t):
    from ..functions.ranks import top_per_group
    cr = st.weighted_corr(long(t)).select(F.col("pair_id").alias("tag"), F.lit("s").alias("species"), F.lit("l").alias("locus"), F.lit("v").alias("variant"), "feature",
                                          F.abs(F.round("pearson_corr", 9)).alias("s"))
    return top_per_group(cr, ["tag"], [F.desc("s"), "feature"], 4)


@query("h25_consistent_features", needs=("fx_long", "fx_pairs"), sql=f"""
WITH {CORR}, {SHIFT}, {JOINT}, tp AS (SELECT group_value AS tag, feature FROM joint WHERE group_type = 'locus' AND rank <= 3)
SELECT feature, count(DISTINCT tag) AS n_tags_in_top FROM tp GROUP BY ALL HAVING count(DISTINCT tag) = (SELECT count(DISTINCT tag) FROM tp)""")
def _(t):
    j = joint(t).where("group_type = 'locus' AND rank <= 3").select(F.col("group_value").alias("tag"), "feature")
    return st.consistent_features(j, ["feature"])


@query("h25_group_composition", needs=LONG, sql=f"""
WITH {CORR}, {TOPF} SELECT tag, species, locus, variant, CASE WHEN feature LIKE 'feat\\_pr\\_%' ESCAPE '\\' THEN 'primer' ELSE 'nonprimer' END AS "group", count(*) AS n_in_top FROM tp GROUP BY ALL""")
def _(t):
    return st.group_composition(top_lists(t))
