"""Queries A01-A13, A15, B01-B04, B07-B11, B13, E13-E18."""

from pyspark.sql import functions as F

from .. import schemas as sc
from ..functions import seq as sq
from ..operators import external as ex
from ..operators import kmers as km
from ..operators import reads as rd
from ..sources import manifest as mf
from ..sources import tables as tbl
from .fixtures import MARKER_PRIMERS
from .registry import query

RC, RD = ("fx_read_catalog",), ("fx_reads",)
SHORT = {"12S": ("ACGTA", "TTAGC"), "16S": ("GATYC", "CCGA")}


@query("a01_typed_samples", sql="""
SELECT 'S' || s_suppkey AS file_id, coalesce(TRY_CAST(trim(n) AS INTEGER), -1) AS n_individuals, coalesce(TRY_CAST(trim(m) AS INTEGER), -1) AS min_len
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'many' WHEN s_suppkey % 7 = 0 THEN NULL ELSE ' ' || s_nationkey || ' ' END AS n, CASE WHEN s_acctbal < 0 THEN '' ELSE CAST(s_suppkey AS VARCHAR) END AS m FROM supplier) x""")
def _(t):
    k = F.col("s_suppkey")
    n = F.when(k % 5 == 0, "many").when(k % 7 != 0, F.concat(F.lit(" "), "s_nationkey", F.lit(" ")))
    s = t.raw("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("file_id"), n.alias("n_individuals"), F.when(F.col("s_acctbal") < 0, "").otherwise(k.cast("string")).alias("min_len"))
    return tbl.typed_samples(s).fillna(-1)


@query("a05_parse_fastq", sql="""
WITH d AS (SELECT doc_id, translate(regexp_replace(text, '[^a-zA-Z]', '', 'g'), 'bdefhijklmnopqrsuvwxyz', 'ccgtacgtacgtacgtacgtac') AS s FROM documents)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'r' ELSE 'r' || doc_id || ' x' END AS header, upper(s) AS seq, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'I' ELSE repeat('I', length(s)) END AS qual,
  CASE WHEN doc_id % 13 = 0 THEN 'truncated' WHEN doc_id % 11 = 0 THEN 'line1_not_header(@)' WHEN doc_id % 7 = 0 THEN 'line3_not_plus(+)' WHEN doc_id % 5 = 0 AND length(s) <> 1 THEN 'seq_qual_length_mismatch' END AS problem FROM d""")
def _(t):
    i = F.col("doc_id")
    s = F.translate(F.regexp_replace("text", "[^a-zA-Z]", ""), "bdefhijklmnopqrsuvwxyz", "ccgtacgtacgtacgtacgtac")
    d = t.raw("documents").select("doc_id", s.alias("s"))
    head = F.when(i % 11 == 0, "r").otherwise(F.concat(F.lit("@r"), "doc_id", F.lit(" x")))
    tail = F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("\n"), F.when(i % 5 == 0, "I").otherwise(F.repeat(F.lit("I"), F.length("s")))))
    return tbl.parse_fastq(d.select("doc_id", F.concat(head, F.lit("\n"), "s", F.lit("\r\n"), F.when(i % 7 == 0, "-").otherwise("+"), tail).alias("value")))


@query("a06_parse_fasta", sql="""
SELECT 'q' || doc_id AS seq_id, upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS sequence FROM documents""")
def _(t):
    d = t.raw("documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, ">").otherwise(""), F.lit("q"), "doc_id", F.lit(" note of it\n"), F.regexp_replace("text", "[^a-zA-Z\\s]", ""), F.lit("\n")).alias("value"))
    return tbl.parse_fasta(d)


HIT_FIELDS = ["p_name", "p_brand", "p_size", "p_partkey", "p_size", "p_retailprice", "p_retailprice", "p_brand", "p_type"]


@query("a08_parse_hits", sql="""
SELECT 'm' || (p_partkey % 3) AS marker, p_name AS qseqid, p_brand AS sseqid, CAST(p_size AS DOUBLE) AS pident, CAST(p_partkey AS INTEGER) AS length, CASE WHEN p_size > 40 THEN -1 ELSE CAST(p_size AS DOUBLE) END AS qcovs,
  p_retailprice AS evalue, p_retailprice AS bitscore, p_brand AS sscinames, NULLIF(CASE WHEN p_size < 5 THEN '' ELSE p_type END, '') AS stitle FROM part""")
def _(t):
    x = {"p_size": F.when(F.col("p_size") > 40, "n/a").otherwise(F.col("p_size").cast("string"))}
    cols = [F.col(f).cast("string") if not (f == "p_size" and n == 4) else x[f] for n, f in enumerate(HIT_FIELDS)]
    cols[-1] = F.when(F.col("p_size") < 5, "").otherwise(F.col("p_type"))
    d = t.raw("part").select(F.concat(F.lit("/d/m"), F.col("p_partkey") % 3, F.lit(".blast.tsv")).alias("path"), F.concat_ws("\t", *cols).alias("value"))
    return tbl.parse_lines(d.select(tbl.marker_of_file("path").alias("marker"), "value"), sc.HITS).fillna(-1, ["qcovs"])


@query("a09_parse_alignment", sql="""
SELECT 'depth' AS kind, 'c' || l_suppkey AS contig, CAST(l_partkey AS INTEGER) AS pos, CAST(l_linenumber AS INTEGER) AS depth, '' AS ref, '' AS bases, CAST(-1 AS BIGINT) AS mapped FROM lineitem
UNION ALL SELECT 'pileup', 'c' || l_suppkey, CAST(l_partkey AS INTEGER), CAST(l_linenumber AS INTEGER), l_returnflag, l_linestatus, -1 FROM lineitem
UNION ALL SELECT 'idxstats', 'c' || l_suppkey, -1, -1, '', '', l_orderkey FROM lineitem""")
def _(t):
    l = t.raw("lineitem").withColumn("contig", F.concat(F.lit("c"), "l_suppkey"))
    line = lambda *x: l.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in x]).alias("value"))
    out = ["contig", "pos", "depth", "ref", "bases", "mapped"]
    null = {"pos": "int", "depth": "int", "ref": "string", "bases": "string", "mapped": "bigint"}
    parts = [("depth", line("contig", "l_partkey", "l_linenumber"), sc.DEPTH), ("pileup", line("contig", "l_partkey", "l_returnflag", "l_linenumber", "l_linestatus", "l_linestatus"), sc.PILEUP),
             ("idxstats", line("contig", "l_partkey", "l_orderkey", "l_orderkey"), sc.IDXSTATS)]
    done = []
    for kind, d, schema in parts:
        p = tbl.parse_lines(d, schema)
        done.append(p.select(F.lit(kind).alias("kind"), *[F.col(c) if c in p.columns else F.lit(None).cast(null[c]).alias(c) for c in out]))
    return done[0].unionByName(done[1]).unionByName(done[2]).fillna(-1).fillna("")


@query("a11_split_of_file", sql="""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' END AS split FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 4
    name = F.concat(F.lit("/d/x."), F.when(k == 0, "train").when(k == 1, "val").when(k == 2, "test").otherwise("other"), F.when(k == 1, ".tsv.gz").otherwise(".tsv"))
    return t.raw("orders").select("o_orderkey", tbl.split_of_file(name).alias("split"))


@query("a12_table_lines", sql="""
SELECT p_partkey || chr(9) || coalesce(CASE WHEN p_size % 2 = 0 THEN p_name END, '') || chr(9) || p_size AS value FROM part""")
def _(t):
    return tbl.table_lines(t.raw("part").withColumn("p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_name"))), ["p_partkey", "p_name", "p_size"])


@query("a13_partition_folder", sql="""
SELECT 'marker=' || coalesce(CASE WHEN p_size > 3 THEN p_brand END, '__HIVE_DEFAULT_PARTITION__') || '/size=' || p_size AS folder, count(*) AS n FROM part GROUP BY 1""")
def _(t):
    p = t.raw("part").select(F.when(F.col("p_size") > 3, F.col("p_brand")).alias("marker"), F.col("p_size").alias("size"))
    return p.groupBy(tbl.partition_folder(["marker", "size"]).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@query("a02_validate_samples", needs=("fx_samples",), sql="""
WITH s AS (SELECT CASE WHEN i = 3 THEN 'src2' WHEN i = 5 THEN ' ' ELSE file_id END AS file_id, CASE WHEN i = 7 THEN '18S' ELSE locus END AS locus, CASE WHEN i = 8 THEN 'maybe' WHEN i = 9 THEN 'NoPCR' ELSE pcr END AS pcr FROM fx_samples)
SELECT file_id, 'empty file_id' AS problem FROM s WHERE trim(file_id) = '' UNION ALL SELECT file_id, 'unexpected locus' FROM s WHERE locus NOT IN ('12S', '16S', 'srRNA', 'lrRNA')
UNION ALL SELECT file_id, 'unrecognized pcr' FROM s WHERE lower(pcr) NOT IN ('yes', 'no', 'nopcr') UNION ALL SELECT file_id, 'duplicate file_id' FROM s WHERE trim(file_id) <> '' GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    i = F.col("i")
    s = t.samples.select(F.when(i == 3, "src2").when(i == 5, " ").otherwise(F.col("file_id")).alias("file_id"), F.when(i == 7, "18S").otherwise(F.col("locus")).alias("locus"),
                         F.when(i == 8, "maybe").when(i == 9, "NoPCR").otherwise(F.col("pcr")).alias("pcr"))
    return tbl.validate_samples(s)


def files(t):
    d = t.raw("documents")
    ext = F.when(F.col("doc_id") % 3 == 0, "_R1.fastq.gz").when(F.col("doc_id") % 3 == 1, ".fq").otherwise(".txt")
    sub = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/d/raw/"), "source", ext)).otherwise(F.concat(F.lit("/d/raw/x"), "doc_id", F.lit("/"), "source", F.lit("_"), "doc_id", ext))
    f = d.select(sub.alias("path"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2).alias("depth"), F.lit("raw").alias("source_dir"))
    return f.groupBy("path", "depth", "source_dir").agg(F.max("size").alias("size"))


FILES = """f AS (SELECT path, depth, max(size) AS size, regexp_extract(path, '([^/]+)$', 1) AS name FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN '/d/raw/' || source || e ELSE '/d/raw/x' || doc_id || '/' || source || '_' || doc_id || e END AS path,
  CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS depth, n_chars AS size FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN '_R1.fastq.gz' WHEN 1 THEN '.fq' ELSE '.txt' END AS e FROM documents) d) x GROUP BY 1, 2),
c AS (SELECT s.file_id, f.*, CASE WHEN depth = 1 AND name IN (file_id || '.fq') THEN 10000 ELSE 8000 + CASE WHEN name IN (file_id || '_R1.fastq.gz', file_id || '_1.fq', file_id || '_1_R1.fastq.gz') AND name <> file_id || '_1_R1.fastq.gz' THEN 7500 ELSE 0 END - depth * 10 + least(size, 10000000) // 1000000 END AS score
  FROM fx_samples s JOIN f ON starts_with(f.name, s.file_id) AND name NOT LIKE '%.txt'),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, path) AS rn, count(*) OVER (PARTITION BY file_id) AS n FROM c)"""


@query("a03_build_manifest", needs=("fx_samples",), sql=f"""
WITH {FILES} SELECT s.file_id, coalesce(r.n, 0) AS n_matches, r.path AS fastq_path, CASE WHEN r.name = s.file_id || '.fq' THEN 'exact_file_id' WHEN r.name IN (s.file_id || '_R1.fastq.gz', s.file_id || '_1.fq') THEN 'exact_file_id_tag' WHEN r.name IS NOT NULL THEN 'glob_startswith_file_id' END AS match_rule,
  CASE WHEN r.n IS NULL THEN 'MISSING' WHEN r.n > 1 THEN 'AMBIGUOUS' ELSE 'OK' END AS status, (SELECT string_agg(path, ';' ORDER BY rn) FROM r q WHERE q.file_id = s.file_id) AS all_matches
FROM fx_samples s LEFT JOIN r ON r.file_id = s.file_id AND r.rn = 1""")
def _(t):
    m = mf.build_manifest(t.samples.select("file_id", "sample_name"), files(t))
    return m.select("file_id", "n_matches", "fastq_path", "match_rule", "status", F.when(F.col("n_matches") > 0, F.array_join("all_matches", ";")).alias("all_matches"))


@query("a04_audit_manifest", needs=("fx_samples",), sql="""
WITH m AS (SELECT file_id, i, CASE WHEN i % 5 = 0 THEN NULL WHEN i % 5 = 1 THEN '/d/raw/none' || i ELSE '/d/p' || (i // 4) END AS p FROM fx_samples)
SELECT file_id, 'missing' AS problem FROM m WHERE p IS NULL UNION ALL SELECT file_id, 'path_not_found' FROM m WHERE p LIKE '/d/raw/none%'
UNION ALL SELECT file_id, 'shared_path' FROM m WHERE p IN (SELECT p FROM m GROUP BY p HAVING count(*) > 1)
UNION ALL SELECT m.file_id, CASE WHEN q % 4 = 0 THEN 'line1_not_header(@)' WHEN q % 4 = 1 THEN 'line3_not_plus(+)' ELSE 'seq_qual_length_mismatch' END FROM m JOIN (SELECT DISTINCT i // 4 AS q FROM fx_samples) r ON m.p = '/d/p' || q WHERE q % 4 < 3""")
def _(t):
    i = F.col("i")
    m = t.samples.select("file_id", F.when(i % 5 == 1, F.concat(F.lit("/d/raw/none"), i)).when(i % 5 > 1, F.concat(F.lit("/d/p"), F.floor(i / 4).cast("int"))).alias("fastq_path"))
    m = m.withColumn("status", F.when(F.col("fastq_path").isNull(), "MISSING").otherwise("OK"))
    f = t.samples.select(F.floor(i / 4).cast("int").alias("q")).distinct().select(F.concat(F.lit("/d/p"), "q").alias("path"), "q")
    q = F.col("q") % 4
    first = f.select("path", F.when(q == 0, ">r").otherwise("@r").alias("header"), F.lit("ACGT").alias("seq"), F.when(q == 1, "r").otherwise("+").alias("plus"), F.when(q == 2, "III").otherwise("IIII").alias("qual"))
    return mf.audit_manifest(m, f.select("path"), first)


@query("a10_external_to_long", sql="""
SELECT raw_id, experiment, sum(value) AS value FROM (SELECT CAST(p_partkey AS VARCHAR) AS raw_id, 'PCR1' AS experiment, CAST(p_size % 5 AS DOUBLE) AS value FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'PCR2', floor(p_retailprice) FROM part) x
WHERE value <> 0 GROUP BY 1, 2""")
def _(t):
    p = t.raw("part")
    return ex.to_long(p.select(F.col("p_partkey").cast("string").alias("raw"), (F.col("p_size") % 5).cast("string").alias("PCR1"), F.floor("p_retailprice").cast("string").alias("PCR2")))


@query("a10_external_long_form", sql="""
SELECT CAST(l_partkey AS VARCHAR) AS raw_id, trim(l_linestatus) AS experiment, sum(CAST(l_linenumber AS DOUBLE)) AS value FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2""")
def _(t):
    l = t.raw("lineitem").select(F.concat(F.lit(" "), "l_linestatus").alias("Experiment "), F.when(F.col("l_linenumber") == 2, "zero").otherwise(F.col("l_linenumber").cast("string")).alias("READS"), F.col("l_partkey").cast("string").alias("Seq"))
    return ex.to_long(l)


@query("a15_kmer_json", needs=("fx_catalog",), sql="""
SELECT seq_id, kmer, CAST(count(*) AS INTEGER) AS n FROM (SELECT seq_id, unnest([substr(sequence, i, 2) for i in range(1, length(sequence))]) AS kmer FROM fx_catalog) w GROUP BY 1, 2""")
def _(t):
    return tbl.kmer_map_from_json(tbl.kmer_map_to_json(km.kmers_long(t.catalog, [2], ["all"])))


def samples_with_primers(t):
    pick = lambda j: F.when(F.col("marker") == "12S", SHORT["12S"][j]).otherwise(SHORT["16S"][j])
    return t.samples.select("sample_id", "marker", "species_scope", "sample_type", pick(0).alias("forward_primer_5to3"), pick(1).alias("reverse_primer_5to3"))


def kept_reads(t):
    r = t.reads.withColumn("qual", F.translate("seq", "ACGTN", "I5?#!"))
    return rd.trim_filter_reads(r, samples_with_primers(t), 0.2, min_q=20, min_len=25, max_len=400, discard_untrimmed=True, max_n=0)


def best_sql(text, primer):
    """Mismatches x 100000 + start of the best site of a primer, leftmost first; null in a shorter text."""
    one = " + ".join(f"CASE WHEN substr({text}, CAST(i + {j + 1} AS INTEGER), 1) IN ({', '.join(repr(b) for b in sq.IUPAC[x])}) THEN 0 ELSE 1 END" for j, x in enumerate(primer))
    return f"list_min([({one}) * 100000 + i for i in range(0, length({text}) - {len(primer)} + 1)])"


def site_sql(text, side):
    """Start of the site of the sample's primer, if at most a fifth of its letters mismatch."""
    pick = {m: SHORT[m][0] if side == 0 else sq.revcomp_text(SHORT[m][1]) for m in ("12S", "16S")}
    case = lambda f: f"CASE WHEN marker = '12S' THEN {f('12S')} ELSE {f('16S')} END"
    return case(lambda m: best_sql(text, pick[m])), case(lambda m: str(len(pick[m]))), case(lambda m: str(int(len(pick[m]) * 0.2)))


(B5, K5, E5), (B3, _, E3) = site_sql("s1", 0), site_sql("s2", 1)
KEPT = f"""kq AS (SELECT r.sample_id, read_no, seq, marker FROM fx_reads r JOIN fx_samples s ON s.sample_id = r.sample_id),
kl AS (SELECT read_no, 'f' AS side, unnest(string_split(seq, '')) AS x, generate_subscripts(string_split(seq, ''), 1) AS i FROM kq
  UNION ALL SELECT read_no, 'r', unnest(string_split(reverse(seq), '')), generate_subscripts(string_split(seq, ''), 1) FROM kq),
kc AS (SELECT read_no, side, i, sum(CASE x WHEN 'A' THEN -20 WHEN 'C' THEN 0 WHEN 'G' THEN -10 WHEN 'T' THEN 18 ELSE 20 END) OVER (PARTITION BY read_no, side ORDER BY i) AS s FROM kl),
kn AS (SELECT *, min(CASE WHEN s < 0 THEN i END) OVER (PARTITION BY read_no, side) AS stop FROM kc),
kt AS (SELECT read_no, coalesce(max(c) FILTER (side = 'f'), 0) AS a, coalesce(max(c) FILTER (side = 'r'), 0) AS z FROM (SELECT read_no, side, first(i ORDER BY s DESC, i) AS c FROM kn WHERE s > 0 AND (stop IS NULL OR i < stop) GROUP BY 1, 2) t GROUP BY 1),
k1 AS (SELECT kq.*, substr(seq, CAST(coalesce(a, 0) + 1 AS INTEGER), CAST(greatest(length(seq) - coalesce(a, 0) - coalesce(z, 0), 0) AS INTEGER)) AS s1 FROM kq LEFT JOIN kt ON kt.read_no = kq.read_no),
k2 AS (SELECT *, {B5} AS b5 FROM k1),
k3 AS (SELECT *, b5 // 100000 <= {E5} AS c5, CASE WHEN b5 // 100000 <= {E5} THEN substr(s1, CAST(b5 % 100000 + {K5} + 1 AS INTEGER)) ELSE s1 END AS s2 FROM k2),
k4 AS (SELECT *, {B3} AS b3 FROM k3),
k5 AS (SELECT sample_id, read_no, coalesce(c5, false) AS cut_5p, coalesce(b3 // 100000 <= {E3}, false) AS cut_3p, CASE WHEN b3 // 100000 <= {E3} THEN left(s2, CAST(b3 % 100000 AS INTEGER)) ELSE s2 END AS s3 FROM k4),
kept AS (SELECT sample_id, read_no, s3 AS seq, translate(s3, 'ACGTN', 'I5?#!') AS qual, cut_5p, cut_3p FROM k5 WHERE (cut_5p OR cut_3p) AND length(s3) BETWEEN 25 AND 400 AND s3 NOT LIKE '%N%')"""


@query("b01_trim_filter_reads", needs=("fx_reads", "fx_samples"), sql=f"WITH {KEPT} SELECT * FROM kept")
def _(t):
    return kept_reads(t)


RET = f"""{KEPT}, ret AS (SELECT s.sample_id, s.marker, s.species_scope, s.sample_type, coalesce(a.n, 0) AS raw_reads, coalesce(b.n, 0) AS filtered_reads, round(coalesce(b.n, 0) / CAST(a.n AS DOUBLE), 6) AS retention_rate
FROM fx_samples s LEFT JOIN (SELECT sample_id, count(*) AS n FROM fx_reads GROUP BY 1) a USING (sample_id) LEFT JOIN (SELECT sample_id, count(*) AS n FROM kept GROUP BY 1) b USING (sample_id))"""


def retention(t):
    return rd.read_retention(t.reads, kept_reads(t), t.samples.select("sample_id", "marker", "species_scope", "sample_type"))


@query("b02_read_retention", needs=("fx_reads", "fx_samples"), sql=f"WITH {RET} SELECT * FROM ret")
def _(t):
    return retention(t)


QC = "count(DISTINCT sample_id) AS n_samples, CAST(sum(raw_reads) AS BIGINT) AS raw_reads_total, CAST(sum(filtered_reads) AS BIGINT) AS filtered_reads_total, avg(retention_rate) AS mean_retention_rate, median(retention_rate) AS median_retention_rate"


@query("b03_qc_report", needs=("fx_reads", "fx_samples"), nudge=1e-9, r="mean_retention_rate median_retention_rate", sql=f"""
WITH {RET} SELECT 'overall' AS level, NULL AS marker, NULL AS species_scope, NULL AS sample_type, {QC} FROM ret UNION ALL SELECT 'marker', marker, NULL, NULL, {QC} FROM ret GROUP BY marker
UNION ALL SELECT 'scope', NULL, species_scope, sample_type, {QC} FROM ret GROUP BY species_scope, sample_type""")
def _(t):
    return rd.qc_report(retention(t))


@query("b04_sample_read_summary", needs=("fx_reads", "fx_samples"), r="mean_len frac_reads_with_N", i="total_reads min_len max_len unique_sequences n_reads_with_N", sql="""
SELECT s.file_id, count(r.seq) AS total_reads, count(DISTINCT r.seq) AS unique_sequences, coalesce(min(length(r.seq)), -1) AS min_len, coalesce(avg(length(r.seq)), -1) AS mean_len, coalesce(max(length(r.seq)), -1) AS max_len,
  count(*) FILTER (r.seq LIKE '%N%') AS n_reads_with_N, coalesce(count(*) FILTER (r.seq LIKE '%N%') / nullif(CAST(count(r.seq) AS DOUBLE), 0), -1) AS frac_reads_with_N
FROM fx_samples s LEFT JOIN fx_reads r ON r.sample_id = s.sample_id AND s.i <> 4 GROUP BY 1""".replace("AS n_reads_with_N", 'AS "n_reads_with_N"').replace("AS frac_reads_with_N", 'AS "frac_reads_with_N"'))
def _(t):
    s = rd.sample_read_summary(t.samples.select("file_id"), t.reads.where("sample_id <> 'src4'"))
    return s.fillna(-1, ["min_len", "max_len"]).fillna(-1.0, ["mean_len", "frac_reads_with_N"])


CLIP = """cl AS (SELECT seq_id, sequence AS s0, CASE WHEN regexp_matches(sequence, '^GAT[CT]C') THEN '16S_F' WHEN regexp_matches(sequence, '^ACGTA') THEN '12S_F' END AS clip_head,
  CASE WHEN regexp_matches(sequence, '^(GAT[CT]C|ACGTA)') THEN substr(sequence, 6) ELSE sequence END AS s1 FROM fx_read_catalog),
c2 AS (SELECT *, CASE WHEN regexp_matches(s1, 'GCTAA$') THEN '12S_R' WHEN regexp_matches(s1, 'TCGG$') THEN '16S_R' END AS clip_tail,
  CASE WHEN regexp_matches(s1, 'GCTAA$') THEN left(s1, length(s1) - 5) WHEN regexp_matches(s1, 'TCGG$') THEN left(s1, length(s1) - 4) ELSE s1 END AS sequence FROM cl)"""


@query("b07_clip_primers", needs=RC, sql=f"WITH {CLIP} SELECT seq_id, sequence, clip_head, clip_tail FROM c2")
def _(t):
    return rd.clip_primers(t.read_catalog, primers=SHORT)


@query("b08_clip_counts", needs=RC, sql=f"WITH {CLIP} SELECT clip_head, clip_tail, count(*) AS n_sequences FROM c2 GROUP BY 1, 2")
def _(t):
    return rd.clip_counts(rd.clip_primers(t.read_catalog, primers=SHORT))


TEXTS = {"12S_F": "ACGTAC", "16S_F": "GATYC"}


@query("b09_primer_residue", needs=RC, r="frac", sql="""
SELECT primer, "where", count(*) FILTER (regexp_matches(CASE WHEN "where" = 'HEAD' THEN left(sequence, 30) ELSE right(sequence, 30) END, p)) AS n, count(*) AS total_seqs,
  count(*) FILTER (regexp_matches(CASE WHEN "where" = 'HEAD' THEN left(sequence, 30) ELSE right(sequence, 30) END, p)) / CAST(count(*) AS DOUBLE) AS frac
FROM fx_read_catalog, (VALUES ('12S_F', 'HEAD', '^ACGT'), ('12S_F', 'TAIL_revcomp', '^GTAC'), ('16S_F', 'HEAD', '^GAT[CT]'), ('16S_F', 'TAIL_revcomp', '^G[AG]AT')) v(primer, "where", p) GROUP BY 1, 2""")
def _(t):
    return rd.primer_residue(t.read_catalog, first=4, texts=TEXTS)


@query("b10_head_fingerprint", needs=RC, r="frac", sql="""
WITH h AS (SELECT substr(sequence, 1, 12) AS head_n, count(*) AS n FROM fx_read_catalog WHERE length(sequence) >= 12 GROUP BY 1)
SELECT head_n, n, CAST(row_number() OVER (ORDER BY n DESC, head_n) AS INTEGER) AS rank, (SELECT count(*) FROM fx_read_catalog) AS total_seqs, n / CAST((SELECT count(*) FROM fx_read_catalog) AS DOUBLE) AS frac FROM h ORDER BY n DESC, head_n LIMIT 5""")
def _(t):
    return rd.head_fingerprint(t.read_catalog, 12, 5)


@query("b11_clip_effect", needs=RC, r="frac", sql=f"""
WITH {CLIP}, b AS (SELECT 'pre' AS phase, s0 AS s FROM c2 UNION ALL SELECT 'post', sequence FROM c2)
SELECT phase, primer, 'HEAD' AS "where", count(*) FILTER (regexp_matches(left(s, 30), p)) AS n, count(*) AS total_seqs, count(*) FILTER (regexp_matches(left(s, 30), p)) / CAST(count(*) AS DOUBLE) AS frac
FROM b, (VALUES ('12S_F', '^ACGTA'), ('16S_F', '^GAT[CT]C')) v(primer, p) GROUP BY 1, 2""")
def _(t):
    return rd.clip_effect(t.read_catalog, primers=SHORT)[0]


TOK = """tok AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN '"' || CAST(p_partkey AS VARCHAR) || '"' WHEN 1 THEN '> ' || md5(p_name) WHEN 2 THEN '''acguacguacguacgun''' WHEN 3 THEN '  ' WHEN 4 THEN p_name ELSE '"''ACGT''"' END AS raw, p_partkey % 6 AS m FROM part)"""


def tokens(t):
    k, m = F.col("p_partkey"), F.col("p_partkey") % 6
    raw = (F.when(m == 0, F.concat(F.lit('"'), k.cast("string"), F.lit('"'))).when(m == 1, F.concat(F.lit("> "), F.md5("p_name"))).when(m == 2, "'acguacguacguacgun'").when(m == 3, "  ")
           .when(m == 4, F.col("p_name")).otherwise("\"'ACGT'\""))
    return t.raw("part").select(k.alias("k"), raw.alias("raw"))


@query("b13_classify_token", sql=f"""
WITH {TOK} SELECT k, CASE m WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN substr(raw, 3) WHEN 2 THEN 'acguacguacguacgun' WHEN 3 THEN '' WHEN 4 THEN raw ELSE 'ACGT' END AS token,
  CASE m WHEN 0 THEN 'numeric' WHEN 1 THEN 'md5_like' WHEN 2 THEN 'seq_like' WHEN 3 THEN 'empty' ELSE 'other' END AS class FROM tok""")
def _(t):
    return tokens(t).select("k", rd.clean_token("raw").alias("token"), rd.classify_token("raw").alias("class"))


EXT = ("fx_external",)
CYC = "CAST(regexp_extract(experiment, '_c([0-9]+)', 1) AS INTEGER)"


def ext(t):
    return t.external.withColumn("experiment", F.regexp_replace("experiment", "^PCR0\\*([0-9]+)_r([01])$", "run$2-PCR$1"))


EX = """ex AS (SELECT dataset, 'run' || right(experiment, 1) || '-PCR' || regexp_extract(experiment, '\\*([0-9]+)_', 1) AS experiment, CAST(regexp_extract(experiment, '\\*([0-9]+)_', 1) AS INTEGER) AS cycle, seq_id, value FROM fx_external),
es AS (SELECT DISTINCT dataset, experiment, cycle FROM ex),
eb AS (SELECT dataset, experiment AS exp_no, cycle AS cycle_no FROM es QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY cycle, experiment) = 1),
ep AS (SELECT es.dataset, experiment AS exp_yes, exp_no, cycle AS cycle_yes, cycle_no, cycle - cycle_no AS cycle_delta, es.dataset || '__' || experiment || '_vs_' || exp_no AS compare_id FROM es JOIN eb ON es.dataset = eb.dataset WHERE experiment <> exp_no),
et AS (SELECT dataset, experiment, sum(value) AS t FROM ex GROUP BY 1, 2),
ed AS (SELECT k.dataset, k.compare_id, k.seq_id, coalesce(y.value, 0) AS count_yes, coalesce(n.value, 0) AS count_no, ty.t AS total_yes, tn.t AS total_no FROM (SELECT DISTINCT ep.*, ex.seq_id FROM ep JOIN ex ON ex.dataset = ep.dataset AND ex.experiment IN (ep.exp_yes, ep.exp_no)) k
  LEFT JOIN ex y ON y.dataset = k.dataset AND y.experiment = k.exp_yes AND y.seq_id = k.seq_id LEFT JOIN ex n ON n.dataset = k.dataset AND n.experiment = k.exp_no AND n.seq_id = k.seq_id
  JOIN et ty ON ty.dataset = k.dataset AND ty.experiment = k.exp_yes JOIN et tn ON tn.dataset = k.dataset AND tn.experiment = k.exp_no)"""


@query("e13_parse_cycle", needs=EXT, sql=f"WITH {EX} SELECT DISTINCT experiment, cycle FROM es")
def _(t):
    return ext(t).select("experiment").distinct().withColumn("cycle", ex.parse_cycle("experiment"))


@query("e14_baseline_pairs", needs=EXT, sql=f"WITH {EX} SELECT * FROM ep")
def _(t):
    return ex.baseline_pairs(ext(t))


@query("e14_max_vs_min", needs=EXT, sql=f"WITH {EX} SELECT * FROM ep QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY cycle_yes DESC, exp_yes DESC) = 1")
def _(t):
    return ex.baseline_pairs(ext(t), "max_vs_min")


@query("e15_external_log2fc", needs=("fx_external", "fx_catalog"), r="log2fc", sql=f"""
WITH {EX}, dn AS (SELECT ep.compare_id, c.seq_id FROM ep CROSS JOIN fx_catalog c)
SELECT dn.compare_id, dn.seq_id, coalesce(count_yes, 0) AS count_yes, coalesce(count_no, 0) AS count_no,
  CASE WHEN ed.seq_id IS NULL THEN 0 ELSE greatest(-6, least(6, log2((count_yes / total_yes + 1e-12) / (count_no / total_no + 1e-12)))) END AS log2fc FROM dn LEFT JOIN ed USING (compare_id, seq_id)""")
def _(t):
    e = ext(t)
    d = t.catalog.select("seq_id", F.explode(F.array(*[F.lit(f"ds{i}") for i in range(3)])).alias("dataset"))
    return ex.external_log2fc(e, ex.baseline_pairs(e), d).select("compare_id", "seq_id", "count_yes", "count_no", "log2fc")


@query("e16_external_training", needs=("fx_external", "fx_features"), r="log2fc feat_gc", sql=f"""
WITH {EX} SELECT compare_id, ed.seq_id, log2((count_yes / total_yes + 1e-12) / (count_no / total_no + 1e-12)) AS log2fc, f.feat_gc,
  CASE WHEN ('0x' || substr(md5('1|' || ed.seq_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.8 THEN 'train' WHEN ('0x' || substr(md5('1|' || ed.seq_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split
FROM ed JOIN fx_features f ON f.seq_id = ed.seq_id WHERE count_yes >= 20 AND count_no >= 20""")
def _(t):
    e = ext(t)
    return ex.external_training(e, ex.baseline_pairs(e), t.features, 20, "both").select("compare_id", "seq_id", "log2fc", "feat_gc", "split")


@query("e17_external_catalog", needs=EXT, sql=f"""
WITH {EX} SELECT dataset, experiment, cycle, count(*) AS n_rows, sum(value) AS total, CAST(dense_rank() OVER (PARTITION BY dataset ORDER BY cycle) AS INTEGER) AS cycle_order FROM ex GROUP BY dataset, experiment, cycle""")
def _(t):
    return ex.external_catalog(ext(t))


@query("e17_pair_summary", needs=EXT, sql=f"WITH {EX} SELECT dataset, compare_id, count(*) AS rows, max(total_yes) AS total_yes, max(total_no) AS total_no FROM ed GROUP BY 1, 2")
def _(t):
    e = ext(t)
    return ex.pair_summary(ex._both_sides(e, ex.baseline_pairs(e)))


IDS = """ids AS (SELECT seq_id AS true_id, CASE length(sequence) % 4 WHEN 0 THEN '"' || seq_id || '"' WHEN 1 THEN 'ext_' || seq_id WHEN 2 THEN '>' || lower(sequence) ELSE 'unknown_' || seq_id END AS raw_id, length(sequence) % 4 AS m FROM fx_catalog)"""


def raw_ids(t):
    m = F.length("sequence") % 4
    return t.catalog.select(F.when(m == 0, F.concat(F.lit('"'), "seq_id", F.lit('"'))).when(m == 1, F.concat(F.lit("ext_"), "seq_id")).when(m == 2, F.concat(F.lit(">"), F.lower("sequence"))).otherwise(F.concat(F.lit("unknown_"), "seq_id")).alias("raw_id"))


@query("e18_map_external_ids", needs=("fx_catalog",), sql=f"WITH {IDS} SELECT raw_id, CASE WHEN m < 3 THEN true_id END AS seq_id, CASE m WHEN 0 THEN 'direct' WHEN 1 THEN 'mapping' WHEN 2 THEN 'sequence' END AS how FROM ids")
def _(t):
    return ex.map_external_ids(raw_ids(t), t.catalog, t.catalog.select(F.concat(F.lit("ext_"), "seq_id").alias("raw_id"), "sequence"))


@query("e18_best_mapping", needs=("fx_catalog",), r="share", sql=f"""
WITH {IDS}, o AS (SELECT 'm' || (CAST(substr(true_id, 2) AS INTEGER) % 3) AS mapping_file, count(DISTINCT raw_id) AS overlap FROM ids GROUP BY 1)
SELECT mapping_file, overlap, overlap / CAST((SELECT count(DISTINCT raw_id) FROM ids) AS DOUBLE) AS share FROM o ORDER BY overlap DESC, mapping_file LIMIT 1""")
def _(t):
    i = raw_ids(t)
    m = t.catalog.select(F.concat(F.lit("m"), F.substring("seq_id", 2, 20).cast("int") % 3).alias("mapping_file"), "seq_id", "sequence")
    mod = F.length("sequence") % 4
    raw = F.when(mod == 0, F.concat(F.lit('"'), "seq_id", F.lit('"'))).when(mod == 1, F.concat(F.lit("ext_"), "seq_id")).when(mod == 2, F.concat(F.lit(">"), F.lower("sequence"))).otherwise(F.concat(F.lit("unknown_"), "seq_id"))
    return ex.best_mapping(i, m.select("mapping_file", raw.alias("raw_id")))
