"""Queries D01-D17, A14."""

from pyspark.sql import functions as F

from ..operators import labels as lb
from ..sources import tables as tbl
from .fixtures import RAW_LABELS
from .registry import query

AB, LB = ("fx_abundance",), ("fx_labels",)



MODES = """m1 AS (SELECT {k}seq_id, sample_id AS top_sample FROM fx_abundance GROUP BY {k}seq_id, sample_id QUALIFY row_number() OVER (PARTITION BY {k}seq_id ORDER BY count(*) DESC, sample_id) = 1),
m2 AS (SELECT {k}seq_id, group_name AS top_group FROM fx_abundance GROUP BY {k}seq_id, group_name QUALIFY row_number() OVER (PARTITION BY {k}seq_id ORDER BY count(*) DESC, group_name) = 1)"""


@query("d01_annotation_candidates", needs=AB, r="max_rel_abundance", sql=f"""
WITH {MODES.format(k='')}, g AS (SELECT seq_id, sequence, CAST(sum(count) AS BIGINT) AS total_count, count(DISTINCT sample_id) AS n_samples, max(relative_abundance) AS max_rel_abundance,
  string_agg(DISTINCT marker, ',' ORDER BY marker) AS markers_seen FROM fx_abundance GROUP BY 1, 2 HAVING sum(count) >= 800 OR max(relative_abundance) >= 0.0018)
SELECT g.*, top_sample, top_group, '' AS species_label, 'pending' AS annotation_status, '' AS is_target_candidate FROM g JOIN m1 USING (seq_id) JOIN m2 USING (seq_id)""")
def _(t):
    return lb.annotation_candidates(t.abundance, 800, 0.0018)


QS = f"""{MODES.format(k='marker, ')}, qs AS (SELECT g.*, top_sample, top_group FROM (SELECT marker, seq_id, sequence, CAST(sum(count) AS BIGINT) AS total_count, count(DISTINCT sample_id) AS n_samples, max(relative_abundance) AS max_rel_abundance,
  string_agg(DISTINCT sample_type, ',' ORDER BY sample_type) AS sample_types FROM fx_abundance GROUP BY 1, 2, 3 HAVING sum(count) >= 500 OR max(relative_abundance) >= 0.0018) g JOIN m1 USING (marker, seq_id) JOIN m2 USING (marker, seq_id))"""


def queries(t):
    return lb.annotation_candidates(t.abundance, 500, 0.0018, per_marker=True)


@query("d02_annotation_queries", needs=AB, r="max_rel_abundance", sql=f"WITH {QS} SELECT * FROM qs")
def _(t):
    return queries(t)


BEST = """bh AS (SELECT marker, qseqid, sseqid, pident, qcovs, bitscore, length, first_name AS sscinames FROM (SELECT *, row_number() OVER w AS rn, first_value(sscinames IGNORE NULLS) OVER (PARTITION BY marker, qseqid ORDER BY bitscore DESC, pident DESC, qcovs DESC, length DESC, sseqid DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_name FROM fx_hits WINDOW w AS (PARTITION BY marker, qseqid ORDER BY bitscore DESC, pident DESC, qcovs DESC, length DESC, sseqid DESC)) x WHERE rn = 1)"""


@query("d03_best_hits", needs=("fx_hits",), sql=f"WITH {BEST} SELECT * FROM bh")
def _(t):
    return lb.best_hits(t.hits)


TIER = "CASE WHEN pident >= 99 AND qcovs >= 95 THEN 'high_confidence' WHEN pident >= 97 AND qcovs >= 90 THEN 'medium_confidence' WHEN pident >= 95 AND qcovs >= 80 THEN 'low_confidence' ELSE 'unresolved' END"


@query("d04_d05_species_and_tier", needs=("fx_hits",), sql=f"SELECT qseqid, sseqid, split_part(sseqid, '|', 1) AS species, CASE WHEN sseqid LIKE '%|%' THEN split_part(sseqid, '|', 2) ELSE sseqid END AS second, sseqid AS out_of_range, {TIER} AS tier FROM fx_hits")
def _(t):
    return t.hits.select("qseqid", "sseqid", lb.species_from_hit().alias("species"), lb.species_from_hit(idx=1).alias("second"), lb.species_from_hit(idx=7).alias("out_of_range"), lb.hit_tier().alias("tier"))


ANN = f"""{QS}, {BEST}, an AS (SELECT q.marker, q.seq_id, q.total_count, coalesce(split_part(b.sseqid, '|', 1), 'UNANNOTATED') AS species_label, CASE WHEN b.sseqid IS NULL THEN 'unresolved' ELSE {TIER} END AS annotation_status, b.bitscore,
  CASE WHEN b.sseqid IS NULL THEN 'No BLAST hit under current database/threshold' ELSE '' END AS notes FROM qs q LEFT JOIN bh b ON b.marker = q.marker AND b.qseqid = q.seq_id)"""


def annotated(t):
    return lb.annotate(queries(t), lb.best_hits(t.hits))


@query("d06_annotate", needs=("fx_abundance", "fx_hits"), sql=f"WITH {ANN} SELECT * FROM an")
def _(t):
    return annotated(t).select("marker", "seq_id", "total_count", "species_label", "annotation_status", "bitscore", "notes")


@query("d07_annotation_status", needs=("fx_abundance", "fx_hits"), i="total_count", sql=f"WITH {ANN} SELECT marker, annotation_status, count(DISTINCT seq_id) AS n_sequences, sum(total_count) AS total_count FROM an GROUP BY 1, 2")
def _(t):
    return lb.annotation_status(annotated(t))


@query("a14_fasta_lines", needs=AB, sql=f"WITH {QS} SELECT '>' || seq_id || '|marker=' || marker || '|total_count=' || total_count || '|max_rel=' || printf('%.6f', max_rel_abundance) || '|top_group=' || top_group || chr(10) || sequence AS value FROM qs")
def _(t):
    return tbl.fasta_lines(queries(t), tbl.count_header())


ANN2 = """an AS (SELECT seq_id, species_label, annotation_status, 1 AS line_no FROM fx_annotation WHERE seq_id NOT LIKE 'P1%' UNION ALL SELECT seq_id, 'second', 'x', 2 FROM fx_annotation WHERE seq_id LIKE 'P2%'),
mg AS (SELECT a.*, coalesce(nullif(n.species_label, ''), 'UNANNOTATED') AS species_label, coalesce(nullif(n.annotation_status, ''), 'unannotated') AS annotation_status FROM fx_abundance a LEFT JOIN an n ON n.seq_id = a.seq_id AND n.line_no = 1)"""


def merged(t):
    a = t.annotation
    n = a.where(~F.col("seq_id").startswith("P1")).withColumn("line_no", F.lit(1)).unionByName(
        a.where(F.col("seq_id").startswith("P2")).select("seq_id", F.lit("second").alias("species_label"), F.lit("x").alias("annotation_status"), F.lit(2).alias("line_no")))
    return lb.merge_annotation(t.abundance, n)


@query("d08_merge_annotation", needs=("fx_abundance", "fx_annotation"), sql=f"WITH {ANN2} SELECT sample_id, seq_id, count, species_label, annotation_status FROM mg")
def _(t):
    return merged(t).select("sample_id", "seq_id", "count", "species_label", "annotation_status")


@query("d09_annotation_coverage", needs=("fx_abundance", "fx_annotation"), i="total_count", sql=f"WITH {ANN2} SELECT seq_id, species_label, annotation_status, sum(count) AS total_count, count(DISTINCT sample_id) AS n_samples FROM mg GROUP BY 1, 2, 3")
def _(t):
    return lb.annotation_coverage(merged(t))


# What the derived spellings must become.
HARMONIZED = ["Bos_taurus", "Bos_indicus", "Sus_scrofa_domesticus", "Canis_lupus", "Canis_lupus", "Ovis_aries", "Capra_hircus", "Equus_quagga", "Vulpes_bengalensis", "Felis_catus",
              "mus_MUSCULUS_domesticus", "Homo_sapiens", "", "Alces_alces", "Oryctolagus_cuniculus", "Sus_scrofa", "Gallus_gallus", "Canis_lupus_chanco", "Bos_taurus", "Ammotragus_lervia"]
UNIFIED = [("Bos_taurus", "alias_map_compact"), ("Bos_indicus", "basic_normalize"), ("Sus_scrofa", "alias_map"), ("Canis_lupus", "alias_map"), ("Dog", "basic_normalize"), ("Ovis_aries", "alias_map_compact"),
           ("Capra_hircus;", "basic_normalize"), ("Equus_quagga", "basic_normalize"), ("Vulpes_bengalensis", "basic_normalize"), ("Felis_catus", "alias_map_compact"), ("Mus_musculus", "alias_map"),
           ("Homo_sapiens", "alias_map_compact"), ("", "basic_normalize"), ("Alces_alces", "basic_normalize"), ("Oryctolagus_cuniculus", "basic_normalize"), ("Sus_scrofa", "alias_map_compact"),
           ("Gallus_gallus", "basic_normalize"), ("Canis_lupus", "trinomial_to_binomial"), ("Bos_taurus", "alias_map_compact"), ("Ammotragus_lervia", "basic_normalize")]


def table_sql(rows):
    q = lambda v: "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(q(x) for x in ((a, *b) if isinstance(b, tuple) else (a, b))) + ")" for a, b in dict(zip(RAW_LABELS, rows)).items())


@query("d10_harmonize_labels", needs=LB, sql=f"SELECT l.seq_id, l.species_label, v.h AS harmonized FROM fx_labels l JOIN (VALUES {table_sql(HARMONIZED)}) v(raw, h) ON v.raw = l.species_label")
def _(t):
    return t.labels.select("seq_id", "species_label", lb.harmonize_label("species_label").alias("harmonized"))


@query("d11_unify_labels", needs=LB, sql=f"SELECT l.seq_id, v.label, v.rule FROM fx_labels l JOIN (VALUES {table_sql(UNIFIED)}) v(raw, label, rule) ON v.raw = l.species_label")
def _(t):
    return t.labels.select("seq_id", lb.unify_label("species_label").alias("u")).select("seq_id", "u.*")


EXPECT = ["Bos_taurus", "Sus_scrofa", "Equus_asinus", "Canis_lupus", "Danio_rerio"]


def expected(t):
    e = t.expected.where("sample_type = 'inter_mix'").select("sample_id", "marker", "group_name").distinct()
    return e.withColumn("target_label", F.explode(F.array(*[F.lit(x) for x in EXPECT])))


EXP = f"ee AS (SELECT e.*, unnest({EXPECT}) AS target_label FROM (SELECT DISTINCT sample_id, marker, group_name FROM fx_expected WHERE sample_type = 'inter_mix') e)"
H = f"hl AS (SELECT l.seq_id, l.marker, v.h AS species_label, l.annotation_status, l.total_count, l.species_label AS raw FROM fx_labels l JOIN (VALUES {table_sql(HARMONIZED)}) v(raw, h) ON v.raw = l.species_label)"
RULES = {**{k: v for k, v in lb.EXACT_RULES.items()}, **lb.NEAR_RULES}
UN = f"""{EXP}, {H}, un AS (SELECT h.*, CASE WHEN h.species_label = '' THEN 'UNANNOTATED' WHEN h.species_label IN ({', '.join(repr(x) for x in EXPECT)}) THEN h.species_label WHEN r.t IS NOT NULL THEN r.t WHEN g.t IS NOT NULL THEN g.t WHEN a.t IS NOT NULL THEN a.t ELSE h.species_label END AS label,
  CASE WHEN h.species_label = '' THEN 'empty_label' WHEN h.species_label IN ({', '.join(repr(x) for x in EXPECT)}) THEN 'already_expected_target' WHEN r.t IS NOT NULL THEN r.why WHEN g.t IS NOT NULL THEN 'genus_fallback:' || g.g WHEN a.t IS NOT NULL THEN a.why ELSE 'kept_as_original' END AS reason
  FROM hl h LEFT JOIN (VALUES {', '.join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in RULES.items())}) r(l, t, why) ON r.l = h.species_label
  LEFT JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in lb.GENUS_TARGETS.items())}) g(g, t) ON g.g = split_part(h.species_label, '_', 1)
  LEFT JOIN (VALUES {', '.join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in lb.AGGRESSIVE_RULES.items())}) a(l, t, why) ON a.l = h.species_label)"""


def harmonized(t):
    return t.labels.withColumn("species_label", lb.harmonize_label("species_label"))


def unified(t):
    return lb.unify_to_targets(harmonized(t), expected(t), aggressive=True)


LE = ("fx_labels", "fx_expected")


@query("d12_unify_to_targets", needs=LE, sql=f"""
WITH {UN} SELECT seq_id, species_label AS species_label_original, label AS species_label, reason AS label_unify_reason, CASE WHEN species_label <> label THEN 'standardized_label' ELSE annotation_status END AS annotation_status FROM un""")
def _(t):
    return unified(t).select("seq_id", "species_label_original", "species_label", "label_unify_reason", "annotation_status")


def both(t):
    return t.labels.withColumn("after", lb.harmonize_label("species_label"))


@query("d13_label_changes", needs=LB, sql=f"WITH {H} SELECT DISTINCT 'annotation' AS source, raw AS before, species_label AS after FROM hl WHERE raw <> species_label")
def _(t):
    return lb.label_changes(both(t), "species_label", "after")


@query("d14_label_inventory", needs=LE, sql=f"WITH {EXP}, {H} SELECT DISTINCT 'annotation' AS source, trim(raw) AS label FROM hl WHERE raw <> '' UNION ALL SELECT DISTINCT 'expected', target_label FROM ee")
def _(t):
    return lb.label_inventory({"annotation": (t.labels, "species_label"), "expected": (expected(t), "target_label")})


@query("d14_harmonization_summary", needs=LB, sql=f"""
WITH {H} SELECT (SELECT count(DISTINCT trim(raw)) FROM hl WHERE trim(raw) <> '') AS n_unique_before, (SELECT count(DISTINCT species_label) FROM hl WHERE species_label <> '') AS n_unique_after,
  (SELECT count(*) FROM (SELECT DISTINCT raw, species_label FROM hl WHERE raw <> species_label) c) AS n_changes""")
def _(t):
    inv = lambda d, c: lb.label_inventory({"annotation": (d, c)})
    return lb.harmonization_summary(inv(t.labels, "species_label"), inv(both(t), "after"), lb.label_changes(both(t), "species_label", "after"))


@query("d15_expected_coverage", needs=LE, sql=f"WITH {EXP}, {H} SELECT ee.*, target_label IN (SELECT species_label FROM hl) AS present FROM ee")
def _(t):
    return lb.expected_coverage(expected(t), harmonized(t))


@query("d15_missing_labels", needs=LE, sql=f"WITH {EXP}, {H} SELECT ee.* FROM ee WHERE target_label NOT IN (SELECT species_label FROM hl)")
def _(t):
    return lb.missing_labels(expected(t), harmonized(t))


@query("d16_mapping_report", needs=LE, sql=f"""
WITH {UN} SELECT species_label AS species_label_original, label AS species_label, reason AS label_unify_reason, count(DISTINCT seq_id) AS n_sequences, sum(coalesce(TRY_CAST(total_count AS DOUBLE), 0)) AS total_count FROM un GROUP BY 1, 2, 3""")
def _(t):
    return lb.mapping_report(unified(t))


@query("d17_target_coverage", needs=LE, sql=f"""
WITH {UN} SELECT marker, CASE WHEN label IN ({', '.join(repr(x) for x in EXPECT)}) THEN 1 ELSE 0 END AS is_expected_target, count(DISTINCT seq_id) AS n_sequences, sum(coalesce(TRY_CAST(total_count AS DOUBLE), 0)) AS total_count,
  CASE WHEN label IN ({', '.join(repr(x) for x in EXPECT)}) THEN 'expected_target' ELSE 'other_label' END AS class FROM un GROUP BY ALL""")
def _(t):
    return lb.target_coverage(unified(t), expected(t))


@query("d17_unmatched", needs=LE, sql=f"WITH {UN} SELECT seq_id, label AS species_label, reason AS label_unify_reason FROM un WHERE label NOT IN ({', '.join(repr(x) for x in EXPECT)})")
def _(t):
    return lb.unmatched(unified(t), expected(t)).select("seq_id", "species_label", "label_unify_reason")
