"""Inputs of the registered queries, derived from the given tables by Spark, and the same tables as SQL.

The given tables hold no sequencing data, so sequences, samples and hits are derived from them row by row:
every table below reads its source tables whole, and grows with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import abundance as ab
from ..operators import bias
from ..operators.features import spread
from ..session import keep

# Fixed values of the derived tables: letter -> base code, label spellings, primers.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGNAC"
MARKER_PRIMERS = {"12S": ("GGGATTAGATACCCCACTATGCYTA", "GAGGGTGACGGGCGGTGT"),
                  "16S": ("ACCAAAAACATCACCTCYAGCAT", "AATAGGATTGCGCTGTTATCCCTA")}
RAW_LABELS = ["Bos taurus", "Bos_indicus", "Sus_scrofa_domesticus", "Canis lupus-familiaris", "dog", "Ovis_aries",
              "Capra  hircus;", "Equus_quagga", "Vulpes_bengalensis", "Felis_catus", "mus_MUSCULUS domesticus",
              "Homo sapiens", "", "Alces_alces", "Oryctolagus cuniculus|", "Sus_scrofa", "Gallus_gallus",
              "Canis_lupus_chanco", "Bos_taurus", "Ammotragus_lervia"]
LABELS_SQL = "[" + ",".join(f"'{x}'" for x in RAW_LABELS) + "]"

SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def _sql(name: str, needs: tuple[str, ...], body: str) -> None:
    SQL[name] = (needs, body)


def with_tables(needs, body: str) -> str:
    """``WITH`` clause for the closure of ``needs`` in front of a query that may start with its own CTEs."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for m in SQL[n][0]:
            visit(m)
        order.append(n)

    for n in needs:
        visit(n)
    body = body.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL[n][1].strip()})" for n in order)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


_sql("fx_samples", (), """
SELECT sample_id, sample_id AS file_id, 'MP' || i AS sample_name, i,
  'sp' || (i // 8) AS species, CASE WHEN i // 8 >= 2 THEN 1 ELSE 10 END AS n_individuals,
  CASE WHEN i % 2 = 0 THEN '12S' ELSE '16S' END AS locus,
  CASE WHEN i % 2 = 0 THEN '12S' ELSE '16S' END AS marker,
  CASE WHEN (i // 2) % 2 = 0 OR i = 19 THEN 'yes' ELSE 'no' END AS pcr,
  CASE WHEN i % 4 = 0 THEN 'Ea' WHEN i % 4 = 1 THEN 'Bt' WHEN i % 4 = 2 THEN 'Ss' ELSE 'Zz' END || '_' || (i // 4) AS group_name,
  CASE WHEN (i // 4) % 2 = 0 THEN 'inter_mix' ELSE 'intra_mix' END AS sample_type,
  CASE WHEN (i // 4) % 2 = 0 THEN 'inter' ELSE 'intra' END AS species_scope,
  CASE WHEN i = 18 THEN 'no' WHEN i % 3 = 0 THEN 'YES' ELSE 'yes' END AS is_core_analysis
FROM (SELECT DISTINCT source AS sample_id, CAST(substr(source, 4) AS INTEGER) AS i FROM documents) s
""")

_sql("fx_reads", (), f"""
SELECT sample_id, doc_id * 1000000 + pos AS read_no,
  regexp_replace(translate(lower(raw), '{LETTERS}', '{BASES}'), '[^ACGTN]', '', 'g') AS seq
FROM (SELECT source AS sample_id, doc_id, unnest(regexp_split_to_array(text, '[.\\n]')) AS raw,
             generate_subscripts(regexp_split_to_array(text, '[.\\n]'), 1) - 1 AS pos FROM documents) r
WHERE length(regexp_replace(translate(lower(raw), '{LETTERS}', '{BASES}'), '[^ACGTN]', '', 'g')) >= 20
""")

_sql("fx_read_catalog", ("fx_reads",), "SELECT md5(seq) AS seq_id, seq AS sequence FROM fx_reads GROUP BY seq")

_sql("fx_catalog", (), """
SELECT 'P' || p_partkey AS seq_id, substr(translate(md5(p_partkey || 'a') || md5(p_partkey || 'b') || md5(p_partkey || 'c')
  || md5(p_partkey || 'd'), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 60 + p_size) AS sequence FROM part
""")

_sql("fx_counts", (), """
SELECT 'src' || (l_suppkey % 20) AS sample_id, 'P' || l_partkey AS seq_id, CAST(sum(l_quantity) AS BIGINT) AS count
FROM lineitem GROUP BY 1, 2
""")

_sql("fx_abundance", ("fx_samples", "fx_counts", "fx_catalog"), """
SELECT s.sample_id, s.marker, s.group_name, s.sample_type, s.species_scope, s.is_core_analysis, a.seq_id, c.sequence,
  a.count, a.count / CAST(sum(a.count) OVER (PARTITION BY a.sample_id) AS DOUBLE) AS relative_abundance
FROM fx_counts a JOIN fx_samples s ON a.sample_id = s.sample_id JOIN fx_catalog c ON a.seq_id = c.seq_id
""")

_sql("fx_annotation", (), """
SELECT 'P' || p_partkey AS seq_id, p_brand AS species_label,
  CASE WHEN p_size >= 30 THEN 'high_confidence' WHEN p_size >= 10 THEN 'low_confidence' ELSE '' END AS annotation_status
FROM part
""")

_sql("fx_labels", (), f"""
SELECT 'P' || p_partkey AS seq_id, CASE WHEN p_partkey % 2 = 0 THEN '12S' ELSE '16S' END AS marker,
  {LABELS_SQL}[CAST(p_partkey % {len(RAW_LABELS)} AS INTEGER) + 1] AS species_label,
  CASE WHEN p_size >= 30 THEN 'high_confidence' ELSE 'unresolved' END AS annotation_status,
  CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS total_count
FROM part
""")

_sql("fx_expected", ("fx_samples",), """
SELECT s.sample_id, s.marker, s.group_name, s.sample_type, b.p_brand AS target_label,
  CASE WHEN s.sample_type = 'inter_mix' THEN CASE WHEN b.p_brand = 'Brand#1' THEN 0.0 ELSE 1.0 / b.nb END ELSE 1.0 END::DOUBLE AS expected_prop
FROM fx_samples s, (SELECT p_brand, count(*) OVER () AS nb FROM (SELECT DISTINCT p_brand FROM part)) b
WHERE lower(s.is_core_analysis) = 'yes' AND (s.sample_type = 'inter_mix' OR b.p_brand IN ('Brand#2', 'Brand#3'))
""")

_sql("fx_hits", (), """
SELECT CASE WHEN p_partkey % 2 = 0 THEN '12S' ELSE '16S' END AS marker, 'P' || p_partkey AS qseqid,
  'Species_' || ((p_size + j) % 11) || '|acc' || j AS sseqid, CAST(90 + (p_size + j) % 10 AS DOUBLE) AS pident,
  100 + p_size AS length, CAST(70 + (p_partkey * 7 + j) % 31 AS DOUBLE) AS qcovs,
  floor(p_retailprice) + (p_size * j) % 3 AS bitscore, CASE WHEN (p_size + j) % 4 = 0 THEN 'name' || j END AS sscinames
FROM part, (SELECT unnest([0, 1, 2]) AS j) h WHERE p_size > 3
""")

_sql("fx_pairs", ("fx_samples",), """
SELECT y.species || '__n' || y.n_individuals || '__' || y.locus || '__' || y.file_id || '_vs_' || n.file_id AS pair_id,
  y.species, y.n_individuals, y.locus, y.file_id AS yes_file_id, n.file_id AS no_file_id,
  y.sample_name AS yes_sample_name, n.sample_name AS no_sample_name
FROM fx_samples y JOIN fx_samples n ON y.species = n.species AND y.n_individuals = n.n_individuals AND y.locus = n.locus
WHERE y.pcr = 'yes' AND n.pcr = 'no'
""")

_sql("fx_totals", ("fx_counts",), "SELECT sample_id, CAST(sum(count) AS BIGINT) AS total FROM fx_counts GROUP BY 1")

_sql("fx_training", ("fx_pairs", "fx_counts", "fx_totals", "fx_samples"), """
SELECT *, CAST(log2(rel_yes / rel_no) AS DOUBLE) AS log2fc FROM (
SELECT k.pair_id, k.species, k.n_individuals, k.locus, k.yes_file_id, k.no_file_id, k.seq_id, coalesce(y.count, 0) AS count_yes, coalesce(n.count, 0) AS count_no,
  ty.total AS total_yes, tn.total AS total_no, (coalesce(y.count, 0) + 0.5::DOUBLE) / (ty.total + 0.5::DOUBLE) AS rel_yes,
  (coalesce(n.count, 0) + 0.5::DOUBLE) / (tn.total + 0.5::DOUBLE) AS rel_no
FROM (SELECT DISTINCT p.*, a.seq_id FROM fx_pairs p JOIN fx_counts a ON a.sample_id IN (p.yes_file_id, p.no_file_id)) k
LEFT JOIN fx_counts y ON y.sample_id = k.yes_file_id AND y.seq_id = k.seq_id
LEFT JOIN fx_counts n ON n.sample_id = k.no_file_id AND n.seq_id = k.seq_id
JOIN fx_totals ty ON ty.sample_id = k.yes_file_id JOIN fx_totals tn ON tn.sample_id = k.no_file_id) t
""")

_sql("fx_features", ("fx_catalog",), """
SELECT seq_id, CAST(length(sequence) AS DOUBLE) AS feat_len,
  (length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', ''))) / CAST(length(sequence) AS DOUBLE) AS feat_gc,
  (length(sequence) - length(replace(sequence, 'A', ''))) / CAST(length(sequence) AS DOUBLE) AS feat_pA,
  CAST((length(sequence) - length(replace(sequence, 'CG', ''))) // 2 AS DOUBLE) AS feat_cpg_n,
  CAST(CASE WHEN sequence LIKE 'A%' THEN 1 ELSE 0 END AS DOUBLE) AS feat_pr_12S_start_a
FROM fx_catalog
""")

FEATS = ["feat_len", "feat_gc", "feat_pA", "feat_cpg_n", "feat_pr_12S_start_a"]

_sql("fx_long", ("fx_training", "fx_features"), "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT t.*, '{x}' AS feature, f.{x} AS x FROM fx_training t JOIN fx_features f USING (seq_id)" for x in FEATS) + ")")

_sql("fx_depth", (), """
SELECT 'src' || (l_suppkey % 20) AS file_id, 'P' || l_partkey AS contig, CAST(l_orderkey % 60 AS INTEGER) + 1 AS pos,
  CAST(sum(l_quantity) AS INTEGER) AS depth
FROM lineitem GROUP BY 1, 2, 3
""")

_sql("fx_idxstats", (), """
SELECT 'src' || (l_suppkey % 20) AS file_id, l_shipmode AS contig, count(*) AS mapped FROM lineitem GROUP BY 1, 2
""".replace("l_shipmode", "l_returnflag || l_linestatus"))

_sql("fx_pileup", (), """
SELECT 'src' || (l_suppkey % 20) AS file_id, 'chr1' AS contig, CAST(l_partkey AS INTEGER) AS pos,
  substr('ACGT', CAST(l_partkey % 4 AS INTEGER) + 1, 1) AS ref,
  CAST(count(*) AS INTEGER) AS depth,
  string_agg(CASE l_returnflag WHEN 'A' THEN '.' WHEN 'N' THEN substr('acgtACGT', l_linenumber, 1) ELSE ',' END, ''
             ORDER BY l_orderkey, l_linenumber) AS bases
FROM lineitem GROUP BY 1, 3, 4
""")

_sql("fx_external", (), """
SELECT 'ds' || (l_suppkey % 3) AS dataset, 'PCR0*' || (5 * (l_suppkey % 4) + 10) || '_r' || (l_suppkey % 2) AS experiment,
  'P' || l_partkey AS seq_id, sum(l_quantity) AS value
FROM lineitem GROUP BY 1, 2, 3
""")

_sql("fx_predictions", ("fx_training", "fx_features"), """
SELECT t.species, t.locus, m.model, m.variant, t.pair_id, t.seq_id, round(t.log2fc, 6) AS y_true,
  round(0.5 * t.log2fc + (f.feat_gc - 0.5) * m.slope, 6) AS y_pred,
  sqrt(t.count_yes + t.count_no) AS w
FROM fx_training t JOIN fx_features f USING (seq_id),
  (SELECT * FROM (VALUES ('rf', 'all', 0.5::DOUBLE), ('rf', 'no_kmer', 3.0::DOUBLE), ('xgb', 'all', -1.0::DOUBLE), ('xgb', 'no_kmer', 2.0::DOUBLE)) v(model, variant, slope)) m
""")


class Tables:
    """The given tables and everything derived from them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def samples(self) -> DataFrame:
        i = F.col("i")
        s = (self.raw("documents").select(F.col("source").alias("sample_id")).distinct()
             .withColumn("i", F.substring("sample_id", 4, 9).cast("int")))
        block = F.floor(i / 4).cast("int")
        inter = block % 2 == 0
        marker = F.when(i % 2 == 0, "12S").otherwise("16S")
        prefix = F.when(i % 4 == 0, "Ea").when(i % 4 == 1, "Bt").when(i % 4 == 2, "Ss").otherwise("Zz")
        sp = F.floor(i / 8).cast("int")
        return s.select(
            "sample_id", F.col("sample_id").alias("file_id"), F.concat(F.lit("MP"), i).alias("sample_name"), "i",
            F.concat(F.lit("sp"), sp).alias("species"), F.when(sp >= 2, 1).otherwise(10).alias("n_individuals"),
            marker.alias("locus"), marker.alias("marker"),
            F.when((F.floor(i / 2) % 2 == 0) | (i == 19), "yes").otherwise("no").alias("pcr"),
            F.concat(prefix, F.lit("_"), block).alias("group_name"),
            F.when(inter, "inter_mix").otherwise("intra_mix").alias("sample_type"),
            F.when(inter, "inter").otherwise("intra").alias("species_scope"),
            F.when(i == 18, "no").when(i % 3 == 0, "YES").otherwise("yes").alias("is_core_analysis"))

    @cached_property
    def reads(self) -> DataFrame:
        d = self.raw("documents").select(F.col("source").alias("sample_id"), "doc_id",
                                         F.posexplode(F.split("text", "[.\\n]")).alias("pos", "raw"))
        seq = F.regexp_replace(F.translate(F.lower("raw"), LETTERS, BASES), "[^ACGTN]", "")
        return (d.select("sample_id", (F.col("doc_id") * 1000000 + F.col("pos")).alias("read_no"), seq.alias("seq"))
                .where(F.length("seq") >= 20))

    @cached_property
    def read_catalog(self) -> DataFrame:
        return spread(self.reads.select(F.col("seq").alias("sequence")).distinct().select(F.md5("sequence").alias("seq_id"), "sequence"))

    @cached_property
    def catalog(self) -> DataFrame:
        k = F.col("p_partkey").cast("string")
        hexes = F.concat(*[F.md5(F.concat(k, F.lit(x))) for x in "abcd"])
        # Merged, not broadcast: sequences and what is derived from them are far larger than the files of ``part``.
        return self.raw("part").select(
            F.concat(F.lit("P"), k).alias("seq_id"),
            F.substring(F.translate(hexes, "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(1), F.lit(60) + F.col("p_size")).alias("sequence")).hint("merge")

    @cached_property
    def counts(self) -> DataFrame:
        # Dealt by sequence before they are counted, so that pairs and features find them in place.
        rows = self.raw("lineitem").select(F.concat(F.lit("src"), F.col("l_suppkey") % 20).alias("sample_id"),
                                           F.concat(F.lit("P"), F.col("l_partkey")).alias("seq_id"), "l_quantity").repartition("seq_id")
        return rows.groupBy("sample_id", "seq_id").agg(F.sum("l_quantity").cast("long").alias("count"))

    @cached_property
    def abundance(self) -> DataFrame:
        meta = self.samples.select("sample_id", "marker", "group_name", "sample_type", "species_scope", "is_core_analysis")
        return ab.relative_abundance(self.counts).join(meta, "sample_id").join(self.catalog, "seq_id")

    @cached_property
    def annotation(self) -> DataFrame:
        return self.raw("part").select(
            F.concat(F.lit("P"), F.col("p_partkey")).alias("seq_id"), F.col("p_brand").alias("species_label"),
            F.when(F.col("p_size") >= 30, "high_confidence").when(F.col("p_size") >= 10, "low_confidence").otherwise("")
            .alias("annotation_status"))

    @cached_property
    def labels(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            F.concat(F.lit("P"), k).alias("seq_id"), F.when(k % 2 == 0, "12S").otherwise("16S").alias("marker"),
            F.element_at(F.array(*[F.lit(x) for x in RAW_LABELS]), (k % len(RAW_LABELS) + 1).cast("int")).alias("species_label"),
            F.when(F.col("p_size") >= 30, "high_confidence").otherwise("unresolved").alias("annotation_status"),
            F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("total_count"))

    @cached_property
    def expected(self) -> DataFrame:
        brands = self.raw("part").select(F.col("p_brand").alias("target_label")).distinct()
        nb = brands.agg(F.count(F.lit(1)).alias("nb")).withColumn("_one", F.lit(1))
        s = (self.samples.where(F.lower("is_core_analysis") == "yes")
             .select("sample_id", "marker", "group_name", "sample_type", F.lit(1).alias("_one")))
        e = s.join(brands.withColumn("_one", F.lit(1)), "_one").join(nb, "_one")
        inter = F.col("sample_type") == "inter_mix"
        prop = F.when(inter, F.when(F.col("target_label") == "Brand#1", 0.0).otherwise(1.0 / F.col("nb"))).otherwise(1.0)
        return (e.where(inter | F.col("target_label").isin("Brand#2", "Brand#3"))
                .select("sample_id", "marker", "group_name", "sample_type", "target_label", prop.alias("expected_prop")))

    @cached_property
    def hits(self) -> DataFrame:
        p = self.raw("part").where(F.col("p_size") > 3).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        size, j, k = F.col("p_size"), F.col("j"), F.col("p_partkey")
        return p.select(
            F.when(k % 2 == 0, "12S").otherwise("16S").alias("marker"), F.concat(F.lit("P"), k).alias("qseqid"),
            F.concat(F.lit("Species_"), (size + j) % 11, F.lit("|acc"), j).alias("sseqid"),
            (F.lit(90) + (size + j) % 10).cast("double").alias("pident"), (F.lit(100) + size).alias("length"),
            (F.lit(70) + (k * 7 + j) % 31).cast("double").alias("qcovs"),
            (F.floor("p_retailprice") + (size * j) % 3).cast("double").alias("bitscore"),
            F.when((size + j) % 4 == 0, F.concat(F.lit("name"), j)).alias("sscinames"))

    @cached_property
    def pairs(self) -> DataFrame:
        return bias.build_pairs(self.samples)

    @cached_property
    def training(self) -> DataFrame:
        # Counts are far fewer than lines: stored once, so that what reads these rows again doesn't count the lines again.
        return bias.paired_log2fc(keep(self.counts).repartition("seq_id"), self.pairs)

    @cached_property
    def features(self) -> DataFrame:
        n = F.length("sequence")
        return self.catalog.select(
            "seq_id", n.cast("double").alias("feat_len"),
            ((n - F.length(F.translate("sequence", "GC", ""))) / n).alias("feat_gc"),
            ((n - F.length(F.translate("sequence", "A", ""))) / n).alias("feat_pA"),
            F.regexp_count("sequence", F.lit("CG")).cast("double").alias("feat_cpg_n"),
            F.col("sequence").startswith("A").cast("double").alias("feat_pr_12S_start_a"))

    @cached_property
    def depth(self) -> DataFrame:
        return (self.raw("lineitem")
                .groupBy(F.concat(F.lit("src"), F.col("l_suppkey") % 20).alias("file_id"),
                         F.concat(F.lit("P"), F.col("l_partkey")).alias("contig"),
                         ((F.col("l_orderkey") % 60).cast("int") + 1).alias("pos"))
                .agg(F.sum("l_quantity").cast("int").alias("depth")))

    @cached_property
    def idxstats(self) -> DataFrame:
        return (self.raw("lineitem")
                .groupBy(F.concat(F.lit("src"), F.col("l_suppkey") % 20).alias("file_id"),
                         F.concat("l_returnflag", "l_linestatus").alias("contig"))
                .agg(F.count(F.lit(1)).alias("mapped")))

    @cached_property
    def pileup(self) -> DataFrame:
        base = (F.when(F.col("l_returnflag") == "A", ".")
                .when(F.col("l_returnflag") == "N", F.substring(F.lit("acgtACGT"), F.col("l_linenumber"), F.lit(1))).otherwise(","))
        return (self.raw("lineitem")
                .groupBy(F.concat(F.lit("src"), F.col("l_suppkey") % 20).alias("file_id"), F.lit("chr1").alias("contig"),
                         F.col("l_partkey").cast("int").alias("pos"),
                         F.substring(F.lit("ACGT"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("ref"))
                .agg(F.count(F.lit(1)).cast("int").alias("depth"),
                     F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", base.alias("b")))),
                                              lambda x: x.b), "").alias("bases")))

    @cached_property
    def external(self) -> DataFrame:
        k = F.col("l_suppkey")
        return (self.raw("lineitem")
                .groupBy(F.concat(F.lit("ds"), k % 3).alias("dataset"),
                         F.concat(F.lit("PCR0*"), F.lit(5) * (k % 4) + 10, F.lit("_r"), k % 2).alias("experiment"),
                         F.concat(F.lit("P"), F.col("l_partkey")).alias("seq_id"))
                .agg(F.sum("l_quantity").alias("value")))

    @cached_property
    def predictions(self) -> DataFrame:
        m = F.explode(F.array(*[F.struct(F.lit(a).alias("model"), F.lit(b).alias("variant"), F.lit(s).alias("slope"))
                                for a, b, s in (("rf", "all", 0.5), ("rf", "no_kmer", 3.0), ("xgb", "all", -1.0), ("xgb", "no_kmer", 2.0))]))
        t = self.training.join(self.features.select("seq_id", "feat_gc"), "seq_id")
        t = t.withColumns({"y_true": F.round("log2fc", 6), "w": F.sqrt(F.col("count_yes") + F.col("count_no"))}).withColumn("m", m)  # once a row, not once a model
        return t.select("species", "locus", "m.model", "m.variant", "pair_id", "seq_id",
                        "y_true", F.round(0.5 * F.col("log2fc") + (F.col("feat_gc") - 0.5) * F.col("m.slope"), 6).alias("y_pred"), "w")
