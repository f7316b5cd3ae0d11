"""Queries B05, B06, F01-F31 over the distinct read catalogue."""

from pyspark.sql import functions as F

from ..functions import arrow
from ..functions import seq as sq
from ..functions.cols import rnd
from ..operators import features as ft
from .fixtures import MARKER_PRIMERS
from .registry import query

RC = ("fx_read_catalog",)
S = "sequence"


def n_sql(letters, s="sequence"):
    return f"(length({s}) - length(translate({s}, '{letters}', '')))"


def div0(a, b):
    return f"coalesce({a} / nullif(CAST({b} AS DOUBLE), 0), 0)"


@query("b05_revcomp", needs=RC, sql="""SELECT seq_id, reverse(translate(sequence, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) AS rc FROM fx_read_catalog""")
def _(t):
    return t.read_catalog.select("seq_id", sq.revcomp("sequence").alias("rc"))


@query("b06_iupac_match", needs=RC, sql="SELECT seq_id, regexp_matches(sequence, '[AG][CT][ACGT]AC[ACT]G') AS hit FROM fx_read_catalog")
def _(t):
    return t.read_catalog.select("seq_id", F.col(S).rlike(sq.iupac_regex("RYNACHG")).alias("hit"))


STRICT = """SELECT seq_id, sequence, length(sequence) - 60 AS m, substr(sequence, 1, 30) AS head, right(sequence, 30) AS tail FROM fx_read_catalog WHERE length(sequence) >= 61"""
MIDS = """substr(sequence, 31, m // 3 + CASE WHEN m % 3 > 0 THEN 1 ELSE 0 END) AS mid1,
  substr(sequence, CAST(31 + m // 3 + least(m % 3, 1) AS INTEGER), CAST(m // 3 + CASE WHEN m % 3 > 1 THEN 1 ELSE 0 END AS INTEGER)) AS mid2,
  substr(sequence, CAST(31 + 2 * (m // 3) + m % 3 AS INTEGER), CAST(m // 3 AS INTEGER)) AS mid3"""


@query("f01_regions_strict", needs=RC, sql=f"SELECT seq_id, sequence, head, {MIDS}, tail FROM ({STRICT}) x")
def _(t):
    return ft.regions_strict(t.read_catalog)[0]


@query("f01_region_rejects", needs=RC, sql="SELECT * FROM fx_read_catalog WHERE length(sequence) < 61")
def _(t):
    return ft.regions_strict(t.read_catalog)[1]


@query("f02_regions_soft", needs=RC, sql="""
SELECT seq_id, substr(sequence, 1, 30) AS head30, CASE WHEN m > 0 THEN substr(sequence, 31, CAST(m // 3 + CASE WHEN m % 3 > 0 THEN 1 ELSE 0 END AS INTEGER)) ELSE '' END AS mid0,
  CASE WHEN m > 0 THEN substr(sequence, CAST(31 + m // 3 + least(m % 3, 1) AS INTEGER), CAST(m // 3 + CASE WHEN m % 3 > 1 THEN 1 ELSE 0 END AS INTEGER)) ELSE '' END AS mid1,
  CASE WHEN m > 0 THEN substr(sequence, CAST(31 + 2 * (m // 3) + m % 3 AS INTEGER), CAST(m // 3 AS INTEGER)) ELSE '' END AS mid2, right(sequence, 30) AS tail30
FROM (SELECT *, length(sequence) - 60 AS m FROM fx_read_catalog) x""")
def _(t):
    return ft.regions_soft(t.read_catalog).drop("sequence")


@query("f03_regions_floor", needs=RC, sql="""
SELECT seq_id, substr(sequence, 1, 30) AS head30, substr(sequence, 31, CAST(m // 3 AS INTEGER)) AS mid0,
  substr(sequence, CAST(31 + m // 3 AS INTEGER), CAST(2 * m // 3 - m // 3 AS INTEGER)) AS mid1,
  substr(sequence, CAST(31 + 2 * m // 3 AS INTEGER), CAST(m - 2 * m // 3 AS INTEGER)) AS mid2, right(sequence, 30) AS tail30
FROM (SELECT *, greatest(length(sequence) - 60, 0) AS m FROM fx_read_catalog) x""")
def _(t):
    return ft.regions_soft(t.read_catalog, even=True).drop("sequence")


@query("f04_sequence_context", needs=("fx_catalog", "fx_abundance", "fx_annotation"), sql="""
WITH s AS (SELECT DISTINCT a.seq_id, a.marker, a.sample_type, n.species_label FROM fx_abundance a JOIN fx_annotation n USING (seq_id)),
g AS (SELECT seq_id, string_agg(DISTINCT marker, ',' ORDER BY marker) AS markers, string_agg(DISTINCT sample_type, ',' ORDER BY sample_type) AS sample_types_seen,
  string_agg(DISTINCT species_label, ',' ORDER BY species_label) AS species_labels_seen FROM s GROUP BY 1)
SELECT c.seq_id, coalesce(markers, 'UNKNOWN') AS markers, sample_types_seen, species_labels_seen, CAST(length(sequence) AS INTEGER) AS length,
  CAST((length(sequence) - 60) // 3 + CASE WHEN (length(sequence) - 60) % 3 > 0 THEN 1 ELSE 0 END AS INTEGER) AS mid1_len, substr(sequence, 1, 30) AS head
FROM fx_catalog c LEFT JOIN g USING (seq_id)""")
def _(t):
    a = t.abundance.join(t.annotation, "seq_id")
    return ft.sequence_context(t.catalog, a).select("seq_id", "markers", "sample_types_seen", "species_labels_seen", "length", "mid1_len", "head")


def plogp(b, n):
    return f"CASE WHEN {n_sql(b)} > 0 THEN -({n_sql(b)} / CAST({n} AS DOUBLE)) * log2({n_sql(b)} / CAST({n} AS DOUBLE)) ELSE 0 END"


BASE_R = ("feat_pA feat_pC feat_pG feat_pT feat_pN feat_gc feat_at feat_gc2 feat_gc_skew feat_at_skew feat_gc_head30 feat_gc_tail30 "
          "feat_entropy1 feat_entropy_len")


@query("f05_f08_base_composition", needs=RC, r=BASE_R, sql=f"""
SELECT seq_id, CAST(length(sequence) AS INTEGER) AS feat_len, {', '.join(f"{div0(n_sql(b), 'length(sequence)')} AS feat_p{b}" for b in 'ACGTN')},
  CASE WHEN sequence LIKE '%N%' THEN 1 ELSE 0 END AS feat_hasN, {div0(n_sql('GC'), 'length(sequence)')} AS feat_gc, {div0(n_sql('AT'), 'length(sequence)')} AS feat_at,
  pow({div0(n_sql('GC'), 'length(sequence)')}, 2) AS feat_gc2, {div0(f"({n_sql('G')} - {n_sql('C')})", n_sql('GC'))} AS feat_gc_skew,
  {div0(f"({n_sql('A')} - {n_sql('T')})", n_sql('AT'))} AS feat_at_skew, left(sequence, 1) AS feat_5p_base, right(sequence, 1) AS feat_3p_base,
  {div0(n_sql('GC', 'left(sequence, 30)'), 'least(length(sequence), 30)')} AS feat_gc_head30, {div0(n_sql('GC', 'right(sequence, 30)'), 'least(length(sequence), 30)')} AS feat_gc_tail30,
  {' + '.join(plogp(b, n_sql('ACGT')) for b in 'ACGT')} AS feat_entropy1, {' + '.join(plogp(b, 'length(sequence)') for b in 'ACGT')} AS feat_entropy_len,
  round({' + '.join(plogp(b, 'length(sequence)') for b in 'ACGTN')}, 4) AS feat_entropy_symbols
FROM fx_read_catalog""")
def _(t):
    return t.read_catalog.withColumns(ft.base_composition(S)).drop("sequence")


@query("f09_f10_f13_f14_f17_f18_complexity")
def _(t):
    x = arrow.scans("direp", "trirep", "tandem_density", "alternating", "dust", "palindromes")(F.col(S))
    cols = ft.complexity(S, x)
    keep = ["feat_lz76", "feat_lz", "feat_dust", "feat_direp_maxreps", "feat_trirep_maxreps", "feat_tandem_density", "feat_zdna_alt_max"]
    return t.read_catalog.select("seq_id", *[cols[k].alias(k) for k in keep], *[x[f"pal_{k}"].alias(k) for k in ("n6", "n8", "n10", "max_len")])


@query("f09_lz76", needs=("fx_catalog",), sql="""
WITH RECURSIVE step(seq_id, x, n, start, parts) AS (SELECT seq_id, sequence, length(sequence), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM fx_catalog
  UNION ALL SELECT seq_id, x, n, coalesce(list_min([e for e in range(start + 1, n + 1) if position(substr(x, start + 1, e - start) IN substr(x, 1, e - 1)) = 0]), n), parts + 1 FROM step WHERE start < n)
SELECT seq_id, CASE WHEN max(n) < 2 THEN 2 * max(n) ELSE max(parts) END AS feat_lz76 FROM step GROUP BY seq_id""")
def _(t):
    return t.catalog.select("seq_id", arrow.lz76(S).alias("feat_lz76"))


def reps_sql(u):
    return (f"coalesce(list_max([r for r in range(2, length(sequence) // {u} + 1) if len([i for i in range(1, length(sequence) - {u} * r + 2) "
            f"if substr(sequence, i, {u} * r) = repeat(substr(sequence, i, {u}), r) AND NOT contains(substr(sequence, i, {u}), 'N')]) > 0]), 1)")


def shape_sql(u, r, n_free):
    free = f" AND NOT contains(substr(sequence, i, {u}), 'N')" if n_free else ""
    return f"flatten([range(i, i + {u * r}) for i in range(1, length(sequence) - {u * r} + 2) if substr(sequence, i, {u * r}) = repeat(substr(sequence, i, {u}), {r}){free}])"


@query("f13_tandem_repeats", needs=("fx_catalog",), r="feat_tandem_density", sql=f"""
SELECT seq_id, CAST({reps_sql(2)} AS INTEGER) AS feat_direp_maxreps, CAST({reps_sql(3)} AS INTEGER) AS feat_trirep_maxreps,
  len(list_distinct(list_concat({shape_sql(3, 3, True)}, {shape_sql(2, 3, True)}, {shape_sql(1, 4, False)}))) / CAST(length(sequence) AS DOUBLE) AS feat_tandem_density FROM fx_catalog""")
def _(t):
    return t.catalog.select("seq_id", sq.max_tandem(S, 2).alias("feat_direp_maxreps"), sq.max_tandem(S, 3).alias("feat_trirep_maxreps"), sq.tandem_density(S).alias("feat_tandem_density"))


@query("f14_palindromes", needs=("fx_catalog",), sql="""
WITH c AS (SELECT seq_id, sequence AS x, unnest(range(1, length(sequence))) AS c FROM fx_catalog), h AS (SELECT seq_id, x, c, unnest(range(1, least(c, length(x) - c) + 1)) AS h FROM c),
p AS (SELECT seq_id, h FROM h WHERE substr(x, c - h + 1, 2 * h) = reverse(translate(substr(x, c - h + 1, 2 * h), 'ACGT', 'TGCA')))
SELECT f.seq_id, count(p.h) FILTER (h >= 3) AS n6, count(p.h) FILTER (h >= 4) AS n8, count(p.h) FILTER (h >= 5) AS n10, coalesce(2 * max(h), 0) AS max_len FROM fx_catalog f LEFT JOIN p ON p.seq_id = f.seq_id GROUP BY f.seq_id""")
def _(t):
    return t.catalog.withColumn("pal", arrow.palindromes(S)).select("seq_id", "pal.*")


@query("f18_dust", needs=("fx_catalog",), r="feat_dust", sql="""
WITH s AS (SELECT seq_id, sequence AS x, length(sequence) AS n, least(64, length(sequence)) AS w FROM fx_catalog), i AS (SELECT *, unnest(range(1, n - w + 2)) AS i FROM s WHERE n >= 3),
j AS (SELECT seq_id, w, i, substr(x, CAST(j AS BIGINT), 3) AS m FROM (SELECT *, unnest(range(i, i + w - 2)) AS j FROM i) q), c AS (SELECT seq_id, w, i, m, count(*) AS c FROM j WHERE NOT contains(m, 'N') GROUP BY ALL),
d AS (SELECT seq_id, i, sum(c * (c - 1) / 2) / any_value(w) AS d FROM c GROUP BY seq_id, i)
SELECT s.seq_id, coalesce(max(d), 0) AS feat_dust FROM s LEFT JOIN d ON d.seq_id = s.seq_id GROUP BY s.seq_id""")
def _(t):
    return t.catalog.select("seq_id", arrow.dust(S).alias("feat_dust"))


@query("f11_homopolymers", needs=RC, sql="""
WITH r AS (SELECT seq_id, list_transform(regexp_extract_all(sequence, 'A+|C+|G+|T+|N+'), lambda x: x) AS r FROM fx_read_catalog)
SELECT seq_id, CAST(list_max([length(x) for x in r]) AS INTEGER) AS feat_run_max, CAST(len(r) AS INTEGER) AS feat_n_runs, {per}, {ge} FROM r""".format(
    per=", ".join(f"CAST(coalesce(list_max([length(x) for x in r if x[1] = '{b}']), 0) AS INTEGER) AS feat_run{b}_max" for b in "ACGT"),
    ge=", ".join(f"CAST(len([x for x in r if length(x) >= {k}]) AS INTEGER) AS feat_run_ge{k}" for k in (4, 5, 6))))
def _(t):
    return t.read_catalog.withColumns(ft.homopolymers(S)).drop("sequence")


DI = [a + b for a in "ACGT" for b in "ACGT"]


@query("f12_dinucleotides", needs=RC, r=" ".join(f"feat_di_{d}" for d in DI) + " feat_CpG feat_UpA feat_or_CpG", sql=f"""
WITH w AS (SELECT seq_id, sequence, length(sequence) AS n, [substr(sequence, i, 2) for i in range(1, length(sequence))] AS w FROM fx_read_catalog),
d AS (SELECT seq_id, sequence, n, {', '.join(f"len([x for x in w if x = '{d}']) AS d_{d}" for d in DI)}, len([x for x in w if x NOT LIKE '%N%']) AS tot FROM w)
SELECT seq_id, {', '.join(f"{div0('d_' + d, 'tot')} AS feat_di_{d}" for d in DI)}, d_CG / CAST(n - 1 AS DOUBLE) AS feat_CpG, d_TA / CAST(n - 1 AS DOUBLE) AS feat_UpA,
  {div0('d_CG', f"(({n_sql('C')} / CAST(n AS DOUBLE)) * ({n_sql('G')} / CAST(n AS DOUBLE)) * (n - 1))")} AS "feat_or_CpG" FROM d""")
def _(t):
    return ft.stage_dinucleotides(t.read_catalog).withColumns(ft.dinucleotides(S)).drop("sequence", "_di")


@query("f15_end_complement", needs=RC, r="v", sql="""
WITH x AS (SELECT seq_id, left(sequence, 30) AS h, reverse(translate(right(sequence, 30), 'ACGT', 'TGCA')) AS t FROM fx_read_catalog)
SELECT seq_id, coalesce(len([i for i in range(1, length(h) + 1) if h[i] = t[i] AND h[i] <> 'N'])
  / nullif(CAST(len([i for i in range(1, length(h) + 1) if h[i] <> 'N' AND t[i] <> 'N']) AS DOUBLE), 0), 0) AS v FROM x""")
def _(t):
    return t.read_catalog.select("seq_id", sq.end_complement(S).alias("v"))


@query("f16_g4", needs=RC, sql="""
SELECT seq_id, CAST(len(regexp_extract_all(sequence, '(G{3,}[ACGTN]{1,7}){3}G{3,}')) AS INTEGER) AS g4, CAST(len(regexp_extract_all(sequence, '(C{3,}\\w{1,7}){3,}C{3,}')) AS INTEGER) AS imotif,
  CAST(coalesce(list_max([length(x) for x in regexp_extract_all(sequence, 'G+')]), 0) AS INTEGER) AS g_island_max,
  CAST(len([x for x in regexp_extract_all(sequence, 'G+') if length(x) >= 3]) AS INTEGER) AS g_island_n3 FROM fx_read_catalog""")
def _(t):
    k = ft.complexity(S)
    return t.read_catalog.select("seq_id", k["feat_g4_count"].alias("g4"), k["feat_imotif"].alias("imotif"),
                                 k["feat_G_island_max"].alias("g_island_max"), k["feat_G_island_n3"].alias("g_island_n3"))


@query("f17_alternating_max", needs=RC, sql="""
WITH f AS (SELECT seq_id, sequence, array_to_string([CASE WHEN substr(translate(sequence, 'AGCT', 'RRYY'), i, 2) IN ('RY', 'YR') THEN '1' ELSE '0' END
  for i in range(1, length(sequence))], '') AS f FROM fx_read_catalog)
SELECT seq_id, CAST(CASE WHEN f LIKE '%1%' THEN list_max([length(x) for x in regexp_extract_all(f, '1+')]) + 1 WHEN length(translate(sequence, 'N', '')) > 0 THEN 1 ELSE 0 END AS INTEGER) AS v FROM f
""")
def _(t):
    return t.read_catalog.select("seq_id", sq.alternating_max(S).alias("v"))


@query("f19_f20_kmer_summaries", needs=RC, digits=6, nudge=1e-9, r=" ".join(f"{f}_{k}" for f in ("entropy", "gini", "top10cov", "lingcomp") for k in range(1, 9)), sql="""
WITH w AS (SELECT seq_id, k, length(sequence) AS n, unnest([substr(sequence, i, k) for i in range(1, length(sequence) - k + 2)]) AS kmer FROM fx_read_catalog, (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) v(k)),
c AS (SELECT seq_id, k, n, kmer, count(*) AS c FROM w WHERE kmer NOT LIKE '%N%' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY seq_id, k ORDER BY c, kmer) AS i, count(*) OVER (PARTITION BY seq_id, k) AS d, sum(c) OVER (PARTITION BY seq_id, k) AS t FROM c),
g AS (SELECT seq_id, k, count(*) AS d, -sum((c / t) * log2(c / t)) AS e, 2.0::DOUBLE * sum(i * c) / (count(*) * any_value(t)) - (count(*) + 1) / CAST(count(*) AS DOUBLE) AS gini,
  sum(CASE WHEN i > r.d - 10 THEN c END) / any_value(t) AS top, count(*) / CAST(least(pow(4, k), any_value(n) - k + 1) AS DOUBLE) AS ling FROM r GROUP BY seq_id, k)
SELECT b.seq_id, {cols} FROM fx_read_catalog b LEFT JOIN g ON g.seq_id = b.seq_id GROUP BY b.seq_id""".format(
    cols=", ".join(f"CAST(coalesce(max(d) FILTER (k = {k}), 0) AS INTEGER) AS distinct_{k}, coalesce(max(e) FILTER (k = {k}), 0) AS entropy_{k}, coalesce(max(gini) FILTER (k = {k}), 0) AS gini_{k}, "
                   f"coalesce(max(top) FILTER (k = {k}), 0) AS top10cov_{k}, coalesce(max(ling) FILTER (k = {k}), 0) AS lingcomp_{k}" for k in range(1, 9))))
def _(t):
    d = ft.kmer_summaries(t.read_catalog)
    return d.select("seq_id", *[F.col(f"feat_k{k}_{f}").alias(f"{f}_{k}") for k in range(1, 9) for f in ("distinct", "entropy", "gini", "top10cov")],
                    *[F.col(f"feat_lingcomp_k{k}").alias(f"lingcomp_{k}") for k in range(1, 9)])


NN_ALL = {**sq.NN, **{sq.revcomp_text(k): v for k, v in sq.NN.items()}}


def tm_sql(i):
    steps = " + ".join(f"{v[i]}::DOUBLE * len([x for x in w if x = '{k}'])" for k, v in sorted(NN_ALL.items()))
    ends = " + ".join(f"CASE WHEN {e}(s, 1) IN ('A', 'T') THEN {sq.NN_END_AT[i]} ELSE {sq.NN_END_GC[i]} END" for e in ("left", "right"))
    return f"({steps} + {ends})"


@query("f21_melting_temperature", needs=RC, r="tm", digits=4, sql=f"""
WITH x AS (SELECT seq_id, replace(sequence, 'N', '') AS s FROM fx_read_catalog), y AS (SELECT *, [substr(s, i, 2) for i in range(1, length(s))] AS w FROM x)
SELECT seq_id, CASE WHEN length(s) > 0 THEN 1000 * {tm_sql(0)} / ({tm_sql(1)} + 0.368 * (length(s) - 1) * ln(0.05) + 1.987 * ln(250e-9)) - 273.15 ELSE 0 END AS tm,
  CAST(2 * {n_sql('AT', 's')} + 4 * {n_sql('GC', 's')} AS DOUBLE) AS wallace FROM y""")
def _(t):
    return t.read_catalog.select("seq_id", sq.tm_nn(S).alias("tm"), sq.tm_wallace(S).alias("wallace"))


@query("f22_window_maxima", needs=RC, r="gc20", sql=f"""
SELECT seq_id, CASE WHEN length(sequence) < 20 THEN {div0(n_sql('GC'), 'length(sequence)')}
  ELSE list_max([length(translate(substr(sequence, i, 20), 'ATN', '')) / 20.0::DOUBLE for i in range(1, length(sequence) - 18)]) END AS gc20 FROM fx_read_catalog""")
def _(t):
    return t.read_catalog.select("seq_id", sq.window_max(S, 20, sq.gc_share).alias("gc20"))


@query("f22_tm_window_max")
def _(t):
    return t.read_catalog.select("seq_id", sq.tm_window_max(S, 20).alias("tm20"))


def marker_primers(t):
    rows = [(m, f, r) for m, (f, r) in MARKER_PRIMERS.items()]
    return t.spark.createDataFrame(rows, "marker string, forward_primer_5to3 string, reverse_primer_5to3 string")


def miss_sql(a, b):
    return f"[i for i in range(0, least(length({a}), length({b}))) if substr({a}, i + 1, 1) <> substr({b}, i + 1, 1)]"


@query("f23_primer_mismatch", needs=("fx_catalog",), r="mismatch_weighted_score", sql=f"""
WITH p(marker, f, r) AS (VALUES {', '.join(f"('{m}', '{f}', '{sq.revcomp_text(r)}')" for m, (f, r) in MARKER_PRIMERS.items())}),
x AS (SELECT c.seq_id, p.marker, p.f, p.r, left(c.sequence, length(p.f)) AS h, right(c.sequence, length(p.r)) AS t
  FROM fx_catalog c JOIN p ON p.marker = CASE WHEN c.sequence LIKE 'A%' OR c.sequence LIKE 'C%' THEN '12S' WHEN c.sequence LIKE 'G%' THEN '16S' ELSE 'none' END),
y AS (SELECT *, {miss_sql('h', 'f')} AS fm, {miss_sql('t', 'r')} AS rm FROM x)
SELECT seq_id, marker, CAST(len(fm) AS INTEGER) AS mismatch_fwd_total, CAST(len(rm) AS INTEGER) AS mismatch_rev_total,
  list_sum([1.0::DOUBLE / (length(f) - i) for i in fm]) + list_sum([1.0::DOUBLE / (length(r) - i) for i in rm]) AS mismatch_weighted_score,
  CASE WHEN list_contains(fm, length(f) - 1) THEN 1 ELSE 0 END + CASE WHEN list_contains(rm, length(r) - 1) THEN 1 ELSE 0 END AS mismatch_3prime_total,
  array_to_string(fm, ',') AS mismatch_fwd_positions, array_to_string(rm, ',') AS mismatch_rev_positions FROM y""")
def _(t):
    mk = F.when(F.left(S, F.lit(1)).isin("A", "C"), "12S").when(F.left(S, F.lit(1)) == "G", "16S").otherwise("none")
    r, _ = ft.regions_strict(t.catalog.withColumn("marker", mk))
    return ft.primer_mismatch(r, marker_primers(t)).select(
        "seq_id", "marker", "mismatch_fwd_total", "mismatch_rev_total", "mismatch_weighted_score", "mismatch_3prime_total",
        "mismatch_fwd_positions", "mismatch_rev_positions")


def mm_at(p, i):
    return " + ".join(f"CASE WHEN substr(sequence, CAST({i} + {j + 1} AS INTEGER), 1) IN ({', '.join(repr(b) for b in sq.IUPAC[x])}) THEN 0 ELSE 1 END" for j, x in enumerate(p))


def primer_sql(locus):
    """One line a sequence: the best sites of the locus' two primers anywhere and near the ends."""
    fwd, rev = MARKER_PRIMERS[locus][0], sq.revcomp_text(MARKER_PRIMERS[locus][1])
    f, r = len(fwd), len(rev)
    letters = lambda p, best, js: " + ".join(f"CASE WHEN substr(sequence, CAST({best} % 100000 + {j + 1} AS INTEGER), 1) IN ({', '.join(repr(b) for b in sq.IUPAC[p[j]])}) THEN 0 ELSE 1 END" for j in js)
    return f"""SELECT seq_id, '{locus}' AS locus, CAST(fb // 100000 AS INTEGER) AS f_mm_best, CAST(fb % 100000 AS INTEGER) AS f_pos_best, CAST(fe // 100000 AS INTEGER) AS f_mm_end, CAST(fe % 100000 AS INTEGER) AS f_pos_end,
  CAST(rb // 100000 AS INTEGER) AS r_mm_best, CAST(rb % 100000 AS INTEGER) AS r_pos_best, CAST(re // 100000 AS INTEGER) AS r_mm_end, CAST(re % 100000 AS INTEGER) AS r_pos_end,
  CAST({letters(fwd, 'fb', range(f - 5, f))} AS INTEGER) AS f_mm_3p5_best, CAST({letters(rev, 'rb', range(5))} AS INTEGER) AS r_mm_3p5_best,
  {n_sql('GC', f'substr(sequence, CAST(fe % 100000 + 1 AS INTEGER), {f})')} / {f}.0::DOUBLE AS f_gc_end,
  substr(sequence, CAST(greatest(0, least(n, greatest(0, re % 100000 + {r // 2} - 30) + 60) - 60) + 1 AS INTEGER), 60) AS r_endwin60
FROM (SELECT seq_id, sequence, length(sequence) AS n,
  list_min([({mm_at(fwd, 'i')}) * 100000 + i for i in range(0, length(sequence) - {f} + 1)]) AS fb,
  list_min([({mm_at(fwd, 'i')}) * 100000 + i for i in range(0, least(length(sequence) - {f}, 10) + 1)]) AS fe,
  list_min([({mm_at(rev, 'i')}) * 100000 + i for i in range(0, length(sequence) - {r} + 1)]) AS rb,
  list_min([({mm_at(rev, 'i')}) * 100000 + i for i in range(greatest(0, length(sequence) - {r} - 10), length(sequence) - {r} + 1)]) AS re FROM fx_catalog) x"""


@query("f24_f25_primer_match", needs=("fx_catalog",), r="f_gc_end", sql=" UNION ALL ".join(map(primer_sql, MARKER_PRIMERS)))
def _(t):
    d = ft.primer_features(t.catalog, primers=MARKER_PRIMERS)
    names = ["f_mm_best", "f_pos_best", "f_mm_end", "f_pos_end", "r_mm_best", "r_pos_best", "r_mm_end", "r_pos_end", "f_mm_3p5_best",
             "r_mm_3p5_best", "f_gc_end", "r_endwin60"]
    one = lambda locus: F.struct(F.lit(locus).alias("locus"), *[F.col(f"feat_pr_{locus}_{x}").alias(x) for x in names])
    return d.select("seq_id", F.explode(F.array(*map(one, MARKER_PRIMERS))).alias("p")).select("seq_id", "p.*")


@query("f26_structure_stats", needs=RC, r="pair_frac", sql="""
WITH d AS (SELECT seq_id, translate(sequence, 'ACGTN', '(.)..') AS db FROM fx_read_catalog)
SELECT seq_id, length(translate(db, '.', '')) / CAST(length(db) AS DOUBLE) AS pair_frac,
  CAST(coalesce(list_max([length(x) for x in regexp_extract_all(db, '[()]+')]), 0) AS INTEGER) AS stem_max,
  CAST(coalesce(list_max([length(x) for x in regexp_extract_all(db, '[.]+')]), 0) AS INTEGER) AS loop_max,
  CAST(len(regexp_extract_all(db, '\\([.]+\\)')) AS INTEGER) AS hairpin_count FROM d""")
def _(t):
    d = t.read_catalog.select("seq_id", F.translate(S, "ACGTN", "(.)..").alias("db"))
    return d.select("seq_id", sq.structure_stats("db").alias("s")).select("seq_id", "s.*")


REG = ["global", *ft.REGIONS]


@query("f27_attach_mfe", needs=("fx_catalog",), sql=f"""
WITH m AS (SELECT 'P' || l_partkey AS seq_id, list_value({', '.join(repr(r) for r in REG)})[CAST(l_linenumber % 6 AS INTEGER) + 1] AS region,
  l_orderkey * 10 + l_linenumber AS line_no, -l_quantity AS mfe FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY seq_id, region ORDER BY line_no DESC, mfe DESC) AS rn FROM m)
SELECT c.seq_id, {', '.join(f"max(CASE WHEN region = '{x}' THEN mfe END) AS mfe_{x}" for x in REG)} FROM fx_catalog c LEFT JOIN r ON r.seq_id = c.seq_id AND rn = 1 GROUP BY 1""")
def _(t):
    li = t.raw("lineitem")
    m = li.select(F.concat(F.lit("P"), "l_partkey").alias("seq_id"), F.element_at(F.array(*[F.lit(x) for x in REG]), F.col("l_linenumber") % 6 + 1).alias("region"),
                  F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), -F.col("l_quantity")).alias("line_no"), (-F.col("l_quantity")).alias("mfe"))
    return ft.attach_mfe(t.catalog, m)


@query("f28_enrichment_zones")
def _(t):
    return ft.zone_totals(t.read_catalog).groupBy("motif", "window", "threshold").agg(
        F.sum("num_zones").alias("num_zones"), F.sum("total_length").alias("total_length"), F.count(F.lit(1)).alias("n_sequences"))


@query("f28_zone_midpoints", needs=RC, sql="""
WITH w AS (SELECT seq_id, i, CASE WHEN length(translate(substr(sequence, CAST(i AS INTEGER), 20), 'ATN', '')) >= 16.0 THEN 1 ELSE 0 END AS hit
  FROM (SELECT seq_id, sequence, unnest(range(1, length(sequence) - 18)) AS i FROM fx_read_catalog) x),
h AS (SELECT seq_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY seq_id ORDER BY i) <= 20 THEN 0 ELSE 1 END AS new FROM w WHERE hit = 1),
z AS (SELECT seq_id, i, sum(new) OVER (PARTITION BY seq_id ORDER BY i) AS z FROM h)
SELECT seq_id, CAST(min(i) AS INTEGER) AS start, CAST(max(i) + 19 AS INTEGER) AS "end", (min(i) + max(i) + 19) / 2.0::DOUBLE AS midpoint FROM z GROUP BY seq_id, z""")
def _(t):
    return ft.enrichment_zones(t.read_catalog, ["GC"], [20], [0.8]).select("seq_id", "start", "end", "midpoint")


@query("f29_regional_features")
def _(t):
    return ft.regional_features(ft.regions_strict(t.read_catalog)[0])


@query("f30_core_features")
def _(t):
    return ft.core_features(t.read_catalog.withColumn("db", F.translate(S, "ACGTN", "(.)..")), "db").drop("sequence", "db")


@query("f31_encode_tokens", needs=RC, sql="""
SELECT seq_id, array_to_string([CASE WHEN i > length(sequence) THEN 0 ELSE CASE substr(sequence, i, 1) WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 3 WHEN 'T' THEN 4 ELSE 5 END END
  for i in range(1, 91)], '') AS tokens,
  array_to_string([CASE WHEN i > length(sequence) THEN 4 ELSE CASE substr(sequence, i, 1) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END END
  for i in range(1, 91)], '') AS bank, array_to_string([CASE WHEN substr(sequence, i, 1) = 'G' THEN 1 ELSE 0 END for i in range(1, 91)], '') AS g_row FROM fx_read_catalog""")
def _(t):
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), "")
    return t.read_catalog.select("seq_id", text(sq.encode_tokens(S, 90)).alias("tokens"), text(sq.encode_tokens(S, 90, first=0, other=4, pad=4)).alias("bank"),
                                 text(F.get(sq.one_hot(S, 90), F.lit(2))).alias("g_row"))


@query("f31_token_length", needs=RC, sql="SELECT CAST(floor(quantile_cont(length(sequence), 0.95)) AS BIGINT) AS token_length FROM fx_read_catalog")
def _(t):
    from ..functions.ranks import exact_quantiles
    d = t.read_catalog.select(F.lit(1).alias("k"), F.length("sequence").alias("n_letters"))
    return exact_quantiles(d, ["k"], "n_letters", {"q": 0.95}).select(F.floor("q").alias("token_length"))
