"""Model datasets: splits, filters, sampling, vectors (I01-I11, B12). Sampling is by hash, so it repeats on any cluster."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_facts
from ..functions.cols import c, finite, number
from ..functions.ranks import cumulate, ordered_positions
from ..session import keep


def norm_file_id(x) -> Column:
    """Base name without .gz, one known extension, pipeline suffixes and read number."""
    plain = F.trim(c(x))
    s = F.replace(F.regexp_extract(plain, "([^/]*)$", 1), F.lit(".gz"), F.lit(""))
    for suf in ("fastq", "fq", "fasta", "fa", "tsv", "txt", "csv", "trim", "trimmed", "merged", "clean", "filtered"):
        s = F.regexp_replace(s, f"\\.{suf}$", "")
    s = F.regexp_replace(F.regexp_replace(s, "_R[12]$", ""), "\\.R[12]$", "")
    bare = ~(F.contains(plain, F.lit("/")) | F.contains(plain, F.lit(".")) | F.contains(plain, F.lit("_R")))   # nothing to cut: no pattern is tried
    return F.when(bare, plain).otherwise(s)


def stable_u01(x) -> Column:
    """First eight md5 hex digits over 0xFFFFFFFF."""
    return F.conv(F.substring(F.md5(c(x)), 1, 8), 16, 10).cast("double") / 4294967295.0


def split_by_hash(df: DataFrame, key: str = "pair_id", train: float = 0.8, val: float = 0.1, seed: int | None = None) -> DataFrame:
    """I02."""
    u = stable_u01(F.concat(F.lit(f"{seed}|"), F.col(key)) if seed is not None else key)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def split_adaptive(df: DataFrame, min_pairs: int = 3) -> DataFrame:
    """By pair where a (species, locus) has enough pairs, by sequence otherwise."""
    n = df.groupBy("species", "locus").agg(F.countDistinct("pair_id").alias("_np"))
    mode = F.when(F.col("_np") >= min_pairs, "pair").otherwise("seq")
    key = F.concat_ws("::", "species", "locus", F.when(F.col("split_mode") == "pair", F.col("pair_id")).otherwise(F.col("seq_id")))
    u = stable_u01(key)
    return (join_facts(df, n, ["species", "locus"], "seq_id").withColumn("split_mode", mode)
            .withColumn("split", F.when(u < 0.15, "test").when(u < 0.30, "val").otherwise("train")).drop("_np"))


def model_rows(training: DataFrame, samples: DataFrame, min_support: int = 2, min_individuals: int = 1, y_clip: float = 6.0, weight: str = "sqrt_sum",
               species=None, loci=None) -> DataFrame:
    """Supported rows of known multi-individual samples with clipped y and weight."""
    t = training.drop("species", "locus", "n_individuals").where(F.col("count_yes") + F.col("count_no") >= min_support)
    m = lambda p: samples.select(F.col("file_id").alias(f"_{p}id"), F.col("n_individuals").alias(f"_{p}n"), *([F.col("species"), F.col("locus")] if p == "y" else []))
    j = (t.withColumns({"_a": norm_file_id("yes_file_id"), "_b": norm_file_id("no_file_id")})
         .join(m("y"), F.col("_a") == F.col("_yid")).join(m("n"), F.col("_b") == F.col("_nid")))
    j = j.where((F.col("_yn") > min_individuals) & (F.col("_nn") > min_individuals))
    if species:
        j = j.where(F.col("species").isin(*species))
    if loci:
        j = j.where(F.col("locus").isin(*loci))
    s = (F.col("count_yes") + F.col("count_no")).cast("double")
    w = {"sqrt_sum": F.sqrt(F.greatest(s, F.lit(0.0))), "log1p": F.log1p(F.greatest(s, F.lit(0.0))), "none": F.lit(1.0)}[weight]
    y = F.greatest(F.lit(-y_clip), F.least(F.lit(y_clip), F.col("log2fc")))
    return j.withColumns({"y": y, "w": w}).drop("_a", "_b", "_yid", "_nid", "_yn", "_nn")


def drop_counts(training: DataFrame, samples: DataFrame, min_support: int = 2, min_individuals: int = 1) -> DataFrame:
    """Rows lost per reason, the first reason that applies."""
    m = samples.select("file_id", "n_individuals")
    j = (training.withColumns({"_a": norm_file_id("yes_file_id"), "_b": norm_file_id("no_file_id")}).drop("n_individuals")
         .join(m.select(F.col("file_id").alias("_a"), F.col("n_individuals").alias("_yn")), "_a", "left")
         .join(m.select(F.col("file_id").alias("_b"), F.col("n_individuals").alias("_nn")), "_b", "left"))
    why = (F.when(F.col("count_yes") + F.col("count_no") < min_support, "support").when(F.col("_yn").isNull() | F.col("_nn").isNull(), "unknown_id")
           .when((F.col("_yn") <= min_individuals) | (F.col("_nn") <= min_individuals), "single_individual").otherwise("kept"))
    return j.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def cap_rows(df: DataFrame, keys: list[str], caps: dict[str, int], row_key: str, seed: int = 1) -> DataFrame:
    """At most caps[split] rows per stratum and split, those with the smallest hashes; splits without a cap keep all.

    Rows are counted by the first 16 bits of their hash; where the counts of a stratum reach its cap lies its cut. Rows below
    the cut stay where they are, and only those that share its 16 bits are sorted, by hash, md5 of the key and key.
    """
    if not caps:
        return df
    by = [*keys, "split"]
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_key)))
    rows = keep(df.withColumn("_u", hashed).withColumn("_bin", F.conv(F.substring("_u", 1, 4), 16, 10).cast("int")))
    cap = F.coalesce(*[F.when(F.col("split") == k, F.lit(v)) for k, v in caps.items()])
    counts = rows.where(F.col("split").isin(*caps)).groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # 65536 lines at most
    counts = counts.withColumn("_upto", upto).withColumn("_below", F.col("_upto") - F.col("_c"))
    full = (F.col("_below") < cap) & (cap <= F.col("_upto")) | (cap <= 0) & (F.col("_below") == 0)
    cuts = counts.where(full).select(*by, F.col("_bin").alias("_cut"), (cap - F.col("_below")).alias("_room"))
    met = join_facts(rows, cuts, by, row_key, "left")
    sure = met.where(F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut"))).select(*df.columns)
    edge = met.where(F.col("_bin") == F.col("_cut"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.substring("_u", 1, 8), F.md5(F.col(row_key).cast("string")), row_key))
    return sure.unionByName(edge.withColumn("_place", place).where(F.col("_place") <= F.col("_room")).select(*df.columns))


def topbias(df: DataFrame, keys: list[str], frac: float, row_key: str, y: str = "y") -> DataFrame:
    """ceil(f*n) rows of largest |y|; ties at the cut by hash.

    The cut of a group lies where the counts of its values, largest first, reach ceil(f*n). Only rows from there on are
    stored, and only those that tie at a cut without room for all are put in order; NULL comes last.
    """
    a = df.withColumn("_a", F.abs(y).cast("double"))
    h = cumulate(a.groupBy(*keys, "_a").agg(F.count(F.lit(1)).alias("_n")), keys, ["_a"], descending=True)
    k = h.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.sum("_n") * F.lit(frac))).alias("_k"))
    cut = h.join(k, keys).where((F.col("_below") < F.col("_k")) & (F.col("_k") <= F.col("_below") + F.col("_n")))
    cut = cut.select(*keys, F.col("_a").alias("_cut"), (F.col("_k") - F.col("_below")).alias("_room"), F.col("_n").alias("_tied"))
    tied = F.col("_a").eqNullSafe(F.col("_cut"))
    top = keep(join_facts(a, cut, keys, row_key).where(tied | (F.col("_a") > F.col("_cut")) | F.col("_cut").isNull()))
    sure = top.where(~tied | (F.col("_room") == F.col("_tied"))).select(*df.columns)
    edge = top.where(tied & (F.col("_room") < F.col("_tied")))
    return sure.unionByName(ordered_positions(edge, keys, F.lit(0.0), row_key, "_pos").where(F.col("_pos") <= F.col("_room")).select(*df.columns))


def topbias_threshold(df: DataFrame, key: str, frac: float, y: str = "y") -> DataFrame:
    """Rows with |y| at least the ceil(f*n)-th largest, ties kept."""
    from ..functions.ranks import value_histogram
    a = df.withColumn("_a", F.abs(y))
    h = value_histogram(a, [key], "_a")
    tot = h.groupBy(key).agg(F.sum("_n").alias("_tot"))
    k = F.greatest(F.lit(1), F.ceil(F.col("_tot") * F.lit(frac)))
    above = F.col("_tot") - F.col("_below") - F.col("_n")   # rows with a larger value
    cut = h.join(tot, key).where((above < k)).groupBy(key).agg(F.min("_a").alias("_cut"))
    return join_facts(a, cut, key, y).where(F.col("_a") >= F.col("_cut")).drop("_a", "_cut")


def resplit(df: DataFrame, keys: list[str], row_key: str, val: float = 0.1, test: float = 0.1, min_val: int = 1, min_test: int = 1, seed: int = 1) -> DataFrame:
    """Random split with minimum sizes; datasets without room for a training row are left out.

    Rows are counted by the first 16 bits of their hash, as in ``cap_rows``: the counts tell in which bins the training and the
    validation rows end, rows of other bins are split where they are, and only those two bins of a dataset are sorted.
    """
    df = keep(df.dropna(subset=keys))
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_key)))
    rows = df.withColumn("_bin", F.coalesce(F.conv(F.substring(hashed, 1, 4), 16, 10).cast("int"), F.lit(-1)))
    counts = rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # 65537 lines at most
    counts = counts.withColumns({"_upto": upto, "_n": F.sum("_c").over(Window.partitionBy(*keys))}).where(F.col("_n") >= 1 + min_val + min_test)
    nv, nt = F.greatest(F.lit(min_val), F.rint(F.col("_n") * val)), F.greatest(F.lit(min_test), F.rint(F.col("_n") * test))
    room = F.col("_n") - nv - nt >= 1
    counts = counts.withColumn("_e2", F.col("_n") - F.when(room, nt).otherwise(min_test)).withColumn("_e1", F.col("_e2") - F.when(room, nv).otherwise(min_val))
    ends = []
    for i in "12":  # 1: last training row, 2: last validation row
        past = F.col("_upto") > F.col(f"_e{i}")
        bin_, left = F.when(past, F.col("_bin")), F.col(f"_e{i}") - F.col("_upto") + F.col("_c")
        ends += [F.coalesce(F.min(bin_), F.lit(1 << 16)).alias(f"_cut{i}"), F.min_by(left, bin_).alias(f"_room{i}")]
    met = join_facts(rows, counts.groupBy(*keys).agg(*ends), keys, row_key)
    at_cut = F.col("_bin").isin(F.col("_cut1"), F.col("_cut2"))
    place = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(F.substring(hashed, 1, 8), F.md5(F.col(row_key).cast("string")), row_key))
    within = lambda i: (F.col("_bin") < F.col(f"_cut{i}")) | (F.col("_bin") == F.col(f"_cut{i}")) & (F.col("_place") <= F.col(f"_room{i}"))
    split = F.when(within(1), "train").when(within(2), "val").otherwise("test")
    placed = met.where(~at_cut).withColumn("_place", F.lit(0)).unionByName(met.where(at_cut).withColumn("_place", place))
    return placed.withColumn("split", split).select(*[c for c in df.columns if c != "split"], "split")


def variant_columns(features: list[str], variant: str) -> list[str]:
    """Dense columns of a variant (k-mer blocks are added as sparse vectors)."""
    if variant.startswith("kmer_only"):
        return []
    return [f for f in features if not (variant.endswith("noprimer") and f.startswith("feat_pr_"))]


def with_kmer_vectors(df: DataFrame, kmers: DataFrame, vocab: list[str], out: str = "kmers") -> DataFrame:
    """``df`` with one sparse count vector per row over a capped vocabulary, built in the JVM; empty for sequences without its words. ``kmers``: seq_id, feature, x.

    Words are merged, never broadcast: there are many for each sequence, however small the files they come from.
    """
    tok = (kmers.where(F.col("feature").isin(vocab)).groupBy("seq_id")
           .agg(F.flatten(F.collect_list(F.array_repeat("feature", F.col("x").cast("int")))).alias("_tok"))).hint("merge")
    d = df.join(tok, "seq_id", "left").withColumn("_tok", F.coalesce("_tok", F.array().cast("array<string>")))
    return CountVectorizerModel.from_vocabulary(vocab, inputCol="_tok", outputCol=out).transform(d).drop("_tok")


def assemble(df: DataFrame, features: list[str], variant: str, kmers: DataFrame | str | None = None, vocab: list[str] | None = None) -> DataFrame:
    """``features`` vector of a variant: no_kmer, no_kmer_noprimer, kmer_only_all, kmer_only_k<k>, all, all_noprimer.

    ``kmers``: seq_id, feature, x, or the column of ``df`` with the counts over ``vocab`` (``with_kmer_vectors``), for several variants of the same rows.
    """
    dense = variant_columns(features, variant)
    d = df.withColumns({f: F.coalesce(number(f), F.lit(0.0)) for f in dense})
    parts = list(dense)
    if not variant.startswith("no_kmer"):
        words = vocab if not variant.startswith("kmer_only_k") else [v for v in vocab if v.startswith(f"k{variant[11:]}_")]
        if isinstance(kmers, str):
            d = VectorSlicer(inputCol=kmers, outputCol="_kmers", indices=[i for i, w in enumerate(vocab) if w in set(words)]).transform(d)
        else:
            d = with_kmer_vectors(d, kmers, words, "_kmers")
        parts.append("_kmers")
    return VectorAssembler(inputCols=parts, outputCol="features").transform(d).drop("_kmers")


def kmer_audit(rows: DataFrame, kmers: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per dataset whose sequence has no k-mers at all, none of the vocabulary, or a match. ``kmers``: seq_id, n_all, n_match."""
    j = rows.join(kmers, "seq_id", "left")
    a, m = F.coalesce("n_all", F.lit(0)), F.coalesce("n_match", F.lit(0))
    cnt = lambda cond: F.count(F.when(cond, 1))
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), cnt(a == 0).alias("n_empty"), cnt((a > 0) & (m == 0)).alias("n_no_match"), cnt(m > 0).alias("n_match"),
                                F.sum(m).alias("nnz")).withColumn("all_zero", (F.col("nnz") == 0).cast("int"))


def clean_features(df: DataFrame, features: list[str], y: str, key: list[str], min_rows: int = 10) -> DataFrame:
    """Numbers only, infinities and gaps to 0, clipped to +-1e10; rows without y and small datasets leave."""
    lim = F.lit(1e10)
    d = df.withColumn(y, finite(F.col(y).try_cast("double"))).where(F.col(y).isNotNull())
    d = d.withColumns({f: F.greatest(-lim, F.least(lim, F.coalesce(number(f), F.lit(0.0)))) for f in features})
    n = d.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select(*key)
    return d.join(n, key, "left_semi")
