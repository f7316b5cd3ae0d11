"""Bias against an expected mixture and between paired samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_facts
from ..functions.cols import ratio, ratio0
from ..functions.ranks import top_per_group
from ..session import keep

SAMPLE = ["sample_id", "marker", "group_name"]
#: Starts of one piece of a reference.
PIECE = 4096


def observed_props(df: DataFrame, value: str = "relative_abundance", by=()) -> DataFrame:
    """Share per sample and species label."""
    return df.groupBy(*by, *SAMPLE, "species_label").agg(F.sum(value).alias("observed_prop"))


def inter_bias(expected: DataFrame, observed: DataFrame, by=()) -> DataFrame:
    """Expected targets with observed share (missing = 0), ratio, log2 ratio and deviations."""
    e = expected.withColumnRenamed("target_label", "species_label")
    obs, exp = F.col("observed_prop"), F.col("expected_prop")
    return (e.join(observed, [*by, *SAMPLE, "species_label"], "left")
            .withColumn("observed_prop", F.coalesce(obs, F.lit(0.0)))
            .withColumn("bias_ratio", F.when(exp > 0, obs / exp))
            .withColumn("log2_bias_ratio", F.log2(F.nullif("bias_ratio", F.lit(0.0))))
            .withColumn("abs_deviation", F.abs(obs - exp))
            .withColumn("sq_error", (obs - exp) * (obs - exp)))


def bias_overall(df: DataFrame, by=()) -> DataFrame:
    """Mean absolute deviation and RMSE per sample."""
    return df.groupBy(*by, *SAMPLE).agg(F.avg("abs_deviation").alias("mean_abs_deviation"),
                                        F.sqrt(F.avg("sq_error")).alias("rmse"),
                                        F.countDistinct("species_label").alias("n_targets"))


def target_nontarget(observed: DataFrame, expected: DataFrame, keys=("sample_id",), by=()) -> DataFrame:
    """Share of expected and of other labels; ``keys`` are matched beside the label."""
    t = (expected.withColumnRenamed("target_label", "species_label").select(*keys, "species_label").distinct()
         .withColumn("is_expected_target", F.lit(1)))
    return (observed.join(t, [*keys, "species_label"], "left")
            .withColumn("is_expected_target", F.coalesce("is_expected_target", F.lit(0)))
            .groupBy(*by, *SAMPLE, "is_expected_target").agg(F.sum("observed_prop").alias("prop"))
            .withColumn("target_class", F.when(F.col("is_expected_target") == 1, "target").otherwise("nontarget")))


def combine_target_tables(inter: DataFrame, intra: DataFrame) -> DataFrame:
    """E05."""
    return inter.withColumn("sample_type", F.lit("inter_mix")).unionByName(intra.withColumn("sample_type", F.lit("intra_mix")))


def prop_checks(observed: DataFrame, by=()) -> DataFrame:
    """Totals that should be 1."""
    return observed.groupBy(*by, *SAMPLE).agg(F.sum("observed_prop").alias("total_prop"))


def bias_multi_threshold(renorm: DataFrame, expected: DataFrame, labels) -> dict[str, DataFrame]:
    """E01-E05 for every rule at once; ``threshold_label`` is a group key, not a loop."""
    by = ["threshold_label"]
    lab = F.explode(F.array(*[F.lit(x) for x in labels])).alias("threshold_label")
    exp = expected.select("*", lab)
    part = {}
    for t in ("inter_mix", "intra_mix"):
        obs = observed_props(renorm.where(F.col("sample_type") == t), "relative_abundance_renorm", by)
        e = exp.where(F.col("sample_type") == t).drop("sample_type")
        part[t] = (obs, e)
    io, ie = part["inter_mix"]
    ao, ae = part["intra_mix"]
    inter = inter_bias(ie, io, by)
    return {
        "inter": inter, "overall": bias_overall(inter, by),
        "targets": combine_target_tables(target_nontarget(io, ie, ["threshold_label", "sample_id"], by),
                                         target_nontarget(ao, ae, ["threshold_label", *SAMPLE], by)),
        "checks": prop_checks(io, by).withColumn("scope", F.lit("inter_mix")).unionByName(
            prop_checks(ao, by).withColumn("scope", F.lit("intra_mix"))),
    }


PAIR_KEYS = ["species", "n_individuals", "locus"]


def build_pairs(samples: DataFrame) -> DataFrame:
    """Every amplified x unamplified combination inside species, individuals and locus."""
    side = lambda v, p: samples.where(F.col("pcr") == v).select(
        *PAIR_KEYS, F.col("file_id").alias(f"{p}_file_id"), F.col("sample_name").alias(f"{p}_sample_name"))
    pid = F.concat("species", F.lit("__n"), "n_individuals", F.lit("__"), "locus", F.lit("__"), "yes_file_id", F.lit("_vs_"), "no_file_id")
    return side("yes", "yes").join(side("no", "no"), PAIR_KEYS).select(
        pid.alias("pair_id"), *PAIR_KEYS, "yes_file_id", "no_file_id", "yes_sample_name", "no_sample_name")


def unpaired_groups(samples: DataFrame) -> DataFrame:
    """Groups that miss one side."""
    return (samples.groupBy(*PAIR_KEYS)
            .agg(F.count(F.when(F.col("pcr") == "yes", 1)).alias("n_yes"), F.count(F.when(F.col("pcr") == "no", 1)).alias("n_no"))
            .where((F.col("n_yes") == 0) | (F.col("n_no") == 0)))


def first_pairs(samples: DataFrame, keys=("species", "locus", "n_individuals"), order: str = "file_id") -> DataFrame:
    """First amplified x first unamplified sample per group."""
    keys = list(keys)
    return (samples.groupBy(*keys)
            .agg(F.min_by("file_id", F.when(F.col("pcr") == "yes", F.col(order))).alias("id_yes"),
                 F.min_by("file_id", F.when(F.col("pcr") == "no", F.col(order))).alias("id_no"))
            .where(F.col("id_yes").isNotNull() & F.col("id_no").isNotNull()))


def sample_totals(ab: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Reads and distinct sequences per sample."""
    return ab.groupBy(sample).agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("n_unique"))


def paired_log2fc(ab: DataFrame, pairs: DataFrame, feats: DataFrame | None = None, pseudo: float = 0.5) -> DataFrame:
    """Every sequence present on either side of a pair, with pseudocount log2 fold change.

    Each count is sent to the pairs it takes part in, and the two sides meet in one groupBy(pair, sequence), where a
    full outer join would take two scans and two shuffles; counts that lie by sequence already aren't moved again.
    What is known of a pair joins afterwards.
    """
    side = F.explode(F.array(F.struct(F.col("yes_file_id").alias("sample_id"), F.lit(True).alias("yes")),
                             F.struct(F.col("no_file_id").alias("sample_id"), F.lit(False).alias("yes"))))
    tot = keep(sample_totals(ab).select("sample_id", "total"))  # read for either side: a line a sample
    meta = (pairs.select("pair_id", *PAIR_KEYS, "yes_file_id", "no_file_id")
            .join(tot.select(F.col("sample_id").alias("yes_file_id"), F.col("total").alias("total_yes")), "yes_file_id")
            .join(tot.select(F.col("sample_id").alias("no_file_id"), F.col("total").alias("total_no")), "no_file_id"))
    cnt = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))
    sides = pairs.select("pair_id", side.alias("s")).select("pair_id", "s.sample_id", "s.yes")
    both = (join_facts(ab.select("sample_id", "seq_id", "count"), sides, "sample_id", "seq_id").groupBy("pair_id", "seq_id")
            .agg(cnt(F.col("yes")).alias("count_yes"), cnt(~F.col("yes")).alias("count_no")))
    both = join_facts(both, meta, "pair_id", "seq_id")
    rel = lambda s: (F.col(f"count_{s}") + F.lit(pseudo)) / (F.col(f"total_{s}") + F.lit(pseudo))
    out = (both.withColumn("rel_yes", rel("yes")).withColumn("rel_no", rel("no"))
           .withColumn("log2fc", F.log2(F.col("rel_yes") / F.col("rel_no"))))
    out = out.select("pair_id", *PAIR_KEYS, "yes_file_id", "no_file_id", "seq_id", "count_yes", "count_no", "total_yes",
                     "total_no", "rel_yes", "rel_no", "log2fc")
    return out.join(feats, "seq_id") if feats is not None else out


def aligned_bias(yes: DataFrame, no: DataFrame, keys=("seq_id",), eps: float = 1e-9) -> DataFrame:
    """Sequences seen on both sides, log2((a+eps)/(b+eps))."""
    keys = list(keys)
    y = yes.withColumnRenamed("relative_abundance", "abundance_pcr")
    n = no.select(*keys, F.col("relative_abundance").alias("abundance_nopcr"))
    return y.join(n, keys).withColumn("bias_score", F.log2((F.col("abundance_pcr") + eps) / (F.col("abundance_nopcr") + eps)))


def audit_pairs(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows per (yes, no) id pair and verdict ok / bad / same_pcr against the one allowed pair per group."""
    m = samples.select("file_id", "species", "locus", "pcr")
    multi = samples.where(F.col("n_individuals") > 1)
    allowed = (multi.groupBy("species", "locus")
               .agg(F.count(F.when(F.col("pcr") == "yes", 1)).alias("ny"), F.count(F.when(F.col("pcr") == "no", 1)).alias("nn"),
                    F.max(F.when(F.col("pcr") == "yes", F.col("file_id"))).alias("_ay"),
                    F.max(F.when(F.col("pcr") == "no", F.col("file_id"))).alias("_an"))
               .where((F.col("ny") == 1) & (F.col("nn") == 1)).select("species", "locus", "_ay", "_an"))
    g = rows.groupBy("yes_file_id", "no_file_id").agg(F.count(F.lit(1)).alias("n_rows"))
    pre = lambda p: m.select(*[F.col(x).alias(f"{p}_{x}") for x in m.columns])
    j = (g.join(pre("y"), F.col("yes_file_id") == F.col("y_file_id"), "left")
         .join(pre("n"), F.col("no_file_id") == F.col("n_file_id"), "left")
         .join(allowed, (F.col("y_species") == F.col("species")) & (F.col("y_locus") == F.col("locus")), "left"))
    direct = (F.col("_ay") == F.col("yes_file_id")) & (F.col("_an") == F.col("no_file_id"))
    swapped = (F.col("_ay") == F.col("no_file_id")) & (F.col("_an") == F.col("yes_file_id"))
    verdict = (F.when(F.col("y_file_id").isNull() | F.col("n_file_id").isNull(), "bad")
               .when((F.col("y_species") != F.col("n_species")) | (F.col("y_locus") != F.col("n_locus")), "bad")
               .when(F.col("y_pcr") == F.col("n_pcr"), "same_pcr").when(direct | swapped, "ok").otherwise("bad"))
    return j.select("yes_file_id", "no_file_id", "n_rows", verdict.alias("verdict"))


def id_overlap(ids: DataFrame, ab: DataFrame) -> DataFrame:
    """How many of the probed ids each sample holds; samples without any stay with 0."""
    probe = ids.select("seq_id").distinct()
    hit = ab.join(probe, "seq_id", "left_semi").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_present"))
    return (ab.select("sample_id").distinct().join(hit, "sample_id", "left")
            .withColumn("n_present", F.coalesce("n_present", F.lit(0))))


def coverage_metrics(depth: DataFrame, samples: DataFrame) -> DataFrame:
    """Mean, population standard deviation, CV and covered positions per sample with metadata."""
    m = depth.groupBy("file_id").agg(F.avg("depth").alias("_m"), F.stddev_pop("depth").alias("_s"),
                                     F.count(F.lit(1)).alias("covered_bases"))
    return (samples.select("file_id", "species", "locus", "pcr").join(m, "file_id")
            .select("file_id", "species", "locus", "pcr", F.round("_m", 2).alias("mean_coverage"), F.round("_s", 2).alias("std_dev"),
                    F.round(ratio("_s", "_m"), 4).alias("cv"), "covered_bases"))


def kmer_depth_ratio(reference: DataFrame, depth: DataFrame, pairs: DataFrame, ks=(3, 4), min_local: float = 5.0) -> DataFrame:
    """amplified/unamplified depth ratio per reference k-mer, both sides normalised by their mean covered depth.

    Each covered position is sent once to its piece of the contig (and to the one before, where windows reach in), and there to the k windows it
    belongs to, so missing positions count as 0, no ordered window over a contig is needed and windows aren't shuffled. The reference comes in pieces of PIECE starts and is merged, never
    broadcast: a plan that explodes it looks small by the size of its files.
    """
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("sequence") - 1) / PIECE).cast("int")))
    pieces = (reference.where(F.length("sequence") >= min(ks)).select("contig", "sequence", at.alias("_piece"))
              .select("contig", "_piece", F.substring("sequence", F.col("_piece") * PIECE + 1, F.lit(PIECE + max(ks) - 1)).alias("_text")).hint("merge"))
    side = F.explode(F.array(F.struct(F.col("yes_file_id").alias("file_id"), F.lit(1).alias("yes")),
                             F.struct(F.col("no_file_id").alias("file_id"), F.lit(0).alias("yes"))))
    p = pairs.select("pair_id", side.alias("s")).select("pair_id", "s.file_id", "s.yes")
    d = join_facts(depth.where(F.col("depth") > 0), p, "file_id", ["contig", "pos"])
    yes = F.col("yes") == 1
    means = d.groupBy("pair_id").agg(F.avg(F.when(yes, F.col("depth"))).alias("_my"), F.avg(F.when(~yes, F.col("depth"))).alias("_mn"))
    k = F.explode(F.array(*[F.lit(x) for x in ks]))
    piece = lambda at: F.floor((at - 1) / PIECE).cast("int")
    first = lambda k: F.greatest(F.lit(1), F.col("pos") - k + 1)
    dealt = d.select("pair_id", "contig", "pos", "depth", "yes", F.explode(F.sequence(piece(first(max(ks))), piece(F.col("pos")))).alias("_piece")).repartition("contig", "_piece")
    loc = (dealt.select("pair_id", "contig", "_piece", "pos", "depth", "yes", k.alias("k"))
           .select("*", F.explode(F.sequence(first(F.col("k")), F.col("pos"))).alias("start")).where(piece(F.col("start")) == F.col("_piece"))
           .groupBy("pair_id", "contig", "_piece", "k", "start")
           .agg(F.sum(F.when(yes, F.col("depth")).otherwise(0)).alias("_dy"), F.sum(F.when(~yes, F.col("depth")).otherwise(0)).alias("_dn"))
           .where(F.col("_dn") / F.col("k") > min_local))
    start = (F.col("start") - 1) % PIECE + 1
    loc = loc.join(pieces, ["contig", "_piece"]).where(start + F.col("k") - 1 <= F.length("_text")).withColumn("kmer", F.substring("_text", start, F.col("k")))
    r = (join_facts(loc, means, "pair_id", ["contig", "start"])
         .withColumn("r", (F.col("_dy") / F.col("k") / F.coalesce("_my", F.lit(1.0))) / (F.col("_dn") / F.col("k") / F.coalesce("_mn", F.lit(1.0)))))
    return r.groupBy("pair_id", "k", "kmer").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_ratio"), F.stddev_pop("r").alias("std_ratio"))


def base_frequencies(pileup: DataFrame) -> DataFrame:
    """A/T/C/G share per covered site; '.' and ',' count as the reference base."""
    up = F.upper("bases")
    n = lambda ch: F.length(up) - F.length(F.translate(up, ch, ""))
    ref = F.upper("ref")
    cols = {b: n(b) + F.when(ref == b, n(".,")).otherwise(0) for b in "ATCG"}
    p = pileup.where(F.col("depth") > 0).select("file_id", "contig", "pos", ref.alias("ref"), "depth", *[v.alias(f"n_{b}") for b, v in cols.items()])
    tot = sum((F.col(f"n_{b}") for b in "ATCG"), F.lit(0))
    return p.where(tot > 0).select("file_id", "contig", "pos", "ref", "depth", *[(F.col(f"n_{b}") / tot).alias(f"f_{b}") for b in "ATCG"])


def base_shift(pileup: DataFrame, pairs: DataFrame, min_shift: float = 0.05) -> DataFrame:
    """Largest signed change of a base share between the sides of a pair (first base wins a tie: A, T, C, G)."""
    f = base_frequencies(pileup)
    yes = f.select(F.col("file_id").alias("yes_file_id"), "contig", "pos", F.col("depth").alias("depth_pcr"),
                   *[F.col(f"f_{b}").alias(f"pcr_{b}") for b in "ATCG"])
    no = f.select(F.col("file_id").alias("no_file_id"), "contig", "pos", F.col("ref").alias("ref_base"), F.col("depth").alias("depth_no"),
                  *[F.col(f"f_{b}").alias(f"no_{b}") for b in "ATCG"])
    j = join_facts(yes, pairs.select("pair_id", "yes_file_id", "no_file_id"), "yes_file_id", ["contig", "pos"]).join(no, ["no_file_id", "contig", "pos"])
    diff = lambda b: F.col(f"pcr_{b}") - F.col(f"no_{b}")
    best = F.array_max(F.array(*[F.struct(F.abs(diff(b)).alias("a"), F.lit(-i).alias("o"), diff(b).alias("d"), F.lit(f"Delta_{b}").alias("c"))
                                 for i, b in enumerate("ATCG")]))
    return (j.withColumn("b", best).where(F.col("b.a") > min_shift)
            .select("pair_id", "pos", "ref_base", "depth_no", "depth_pcr", F.round("b.d", 4).alias("max_diff"), F.col("b.c").alias("change_type"),
                    *[F.round(f"{s}_{b}", 3).alias(f"freq_{s}_{b}") for s in ("no", "pcr") for b in "ATCG"]))


def contig_abundance(idx: DataFrame, expected: float = 0.1) -> DataFrame:
    """Share of mapped reads per contig and sample (long form; the unmapped line '*' is left out)."""
    d = idx.where(F.col("contig") != "*")
    t = d.groupBy("file_id").agg(F.sum("mapped").alias("_t"))
    return d.join(t, "file_id").select("contig", "file_id", ratio0("mapped", "_t").alias("share"), F.lit(expected).alias("expected"))


def contig_matrix(shares: DataFrame, files) -> DataFrame:
    """Contig x sample matrix, missing = 0, four decimals."""
    cols = [F.round(F.coalesce(F.max(F.when(F.col("file_id") == f, F.col("share"))), F.lit(0.0)), 4).alias(f) for f in files]
    return shares.groupBy("contig").agg(*cols, F.max("expected").alias("expected"))


def variable_kmers(stats: DataFrame, k: int = 3, top: int = 30) -> DataFrame:
    """K-mers whose ratio varies most over the groups."""
    return (stats.where(F.col("k") == k).groupBy("kmer").agg(F.var_samp("mean_ratio").alias("variance"), F.count(F.lit(1)).alias("n_groups"))
            .orderBy(F.desc_nulls_last("variance"), "kmer").limit(top))


def change_counts(shift: DataFrame) -> DataFrame:
    """E24."""
    return shift.groupBy("pair_id", "change_type").agg(F.count(F.lit(1)).alias("n_sites"))


def case_candidates(df: DataFrame, top: int = 20, main: str = "rel_ge_0.005") -> DataFrame:
    """Highest and lowest log2 bias at the main rule (all rules when it is absent) as one table with ``case``."""
    present = df.agg(F.max(F.col("threshold_label") == main).alias("present")).scalar()   # part of the plan, no job here
    m = df.where(~F.coalesce(present, F.lit(False)) | (F.col("threshold_label") == main))
    key = ["sample_id", "species_label", "threshold_label"]
    hi = m.orderBy(F.desc_nulls_last("log2_bias_ratio"), *key).limit(top).withColumn("case", F.lit("high"))
    lo = m.orderBy(F.asc_nulls_last("log2_bias_ratio"), *key).limit(top).withColumn("case", F.lit("low"))
    return hi.unionByName(lo)


def marker_discordant(df: DataFrame, keys=("sample_id", "group_name", "species_label"), top: int = 20) -> DataFrame:
    """Largest |12S - 16S| gap; rows with one marker only sort last."""
    val = lambda mk: F.avg(F.when(F.col("marker") == mk, F.col("log2_bias_ratio")))
    p = df.groupBy(*keys).agg(val("12S").alias("bias_12S"), val("16S").alias("bias_16S"))
    return (p.withColumn("marker_gap_abs", F.abs(F.col("bias_12S") - F.col("bias_16S")))
            .orderBy(F.desc_nulls_last("marker_gap_abs"), *keys).limit(top))
