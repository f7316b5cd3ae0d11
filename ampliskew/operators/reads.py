"""Read filters, primer census and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions import seq as sq
from ..functions.cols import c, ratio0
from ..functions.ranks import top_per_group
from .features import PRIMERS

TEXTS = {f"{locus}_{s}": p for locus, (f, r) in PRIMERS.items() for s, p in (("F", f), ("R", r))}


def quality_window(qual, cutoff: int = 20) -> Column:
    """struct(start, stop) kept by the running-sum rule at both ends (0-based, stop exclusive).

    From an end inward the sum of (cutoff - quality) grows while quality is low; the cut lies where it peaks and
    the scan ends when it turns negative.
    """
    n = F.length(c(qual))
    scores = F.transform(sq.letters(qual), lambda x: F.ascii(x) - 33)
    zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("best"), F.lit(0).alias("cut"), F.lit(0).alias("i"), F.lit(False).alias("done"))

    def step(a, q):
        s = a["s"] + F.lit(cutoff) - q
        done = a["done"] | (s < 0)
        up = ~done & (s > a["best"])
        return F.struct(s.alias("s"), F.when(up, s).otherwise(a["best"]).alias("best"), F.when(up, a["i"] + 1).otherwise(a["cut"]).alias("cut"),
                        (a["i"] + 1).alias("i"), done.alias("done"))

    cut = lambda arr: F.aggregate(arr, zero, step, lambda a: a["cut"])
    return sq.let(scores, lambda sc: F.struct(cut(sc).alias("start"), (n - cut(F.reverse(sc))).alias("stop")))


def trim_filter_reads(reads: DataFrame, samples: DataFrame, error: float = 0.2, min_q: int | None = None, min_len=None, max_len=None,
                      discard_untrimmed: bool = False, max_n: int | None = None) -> DataFrame:
    """Quality trim, 5' primer, 3' primer (reverse complement), then length and N filters.

    A primer site has at most floor(error * length) mismatches over IUPAC letters, no indels; the site with the
    fewest mismatches is taken, leftmost first. ``samples``: sample_id, forward_primer_5to3, reverse_primer_5to3
    and, where lengths are per sample, min_len and max_len.
    """
    d = reads.join(samples.select("sample_id", F.upper("forward_primer_5to3").alias("_f"), sq.revcomp("reverse_primer_5to3").alias("_r"),
                                  *[F.col(x).alias(f"_{x}") for x in ("min_len", "max_len") if x in samples.columns]), "sample_id")
    if min_q is not None:
        d = d.withColumn("_w", quality_window("qual", min_q))
        d = d.withColumns({x: F.substring(x, F.col("_w.start") + 1, F.greatest(F.col("_w.stop") - F.col("_w.start"), F.lit(0))) for x in ("seq", "qual")}).drop("_w")

    def site(d, primer, name):
        d = d.withColumn(name, arrow.best_site("seq", primer))
        return d.withColumn(name, F.when(F.col(name)["mm"] <= F.floor(F.length(primer) * error), F.col(name)["pos"]))

    d = site(d, "_f", "_5").withColumn("_cut", F.when(F.col("_5").isNotNull(), F.col("_5") + F.length("_f")).otherwise(0))
    keep = lambda x, start, n: F.substring(x, start, n)
    quals = ["qual"] if "qual" in d.columns else []
    d = d.withColumns({x: keep(x, F.col("_cut") + 1, F.length(x) - F.col("_cut")) for x in ["seq", *quals]})
    d = site(d, "_r", "_3")
    d = d.withColumns({x: F.when(F.col("_3").isNotNull(), keep(x, F.lit(1), F.col("_3"))).otherwise(F.col(x)) for x in ["seq", *quals]})
    if discard_untrimmed:
        d = d.where(F.col("_5").isNotNull() | F.col("_3").isNotNull())
    lo = F.col("_min_len") if "_min_len" in d.columns else F.lit(min_len)
    hi = F.col("_max_len") if "_max_len" in d.columns else F.lit(max_len)
    n = F.length("seq")
    d = d.where((F.coalesce(lo, F.lit(0)) <= n) & (n <= F.coalesce(hi, F.lit(2 ** 31 - 1))))
    if max_n is not None:
        d = d.where(sq.n_of("seq", "N") <= max_n)
    return d.select(*reads.columns, F.col("_5").isNotNull().alias("cut_5p"), F.col("_3").isNotNull().alias("cut_3p"))


def read_retention(raw: DataFrame, kept: DataFrame, samples: DataFrame) -> DataFrame:
    """Raw and filtered counts per sample with the share that is left."""
    cnt = lambda d, n: d.groupBy("sample_id").agg(F.count(F.lit(1)).alias(n))
    j = samples.join(cnt(raw, "raw_reads"), "sample_id", "left").join(cnt(kept, "filtered_reads"), "sample_id", "left").fillna(0, ["raw_reads", "filtered_reads"])
    return j.withColumn("retention_rate", F.round(ratio0("filtered_reads", "raw_reads"), 6))


def qc_report(qc: DataFrame) -> DataFrame:
    """Overall, by marker and by (scope, type) in one pass; one input row per sample."""
    ks = [F.col("marker"), F.col("species_scope"), F.col("sample_type")]
    g = qc.groupingSets([[], [ks[0]], ks[1:]], *ks).agg(
        F.countDistinct("sample_id").alias("n_samples"), F.sum("raw_reads").alias("raw_reads_total"), F.sum("filtered_reads").alias("filtered_reads_total"),
        F.avg("retention_rate").alias("mean_retention_rate"), F.median("retention_rate").alias("median_retention_rate"), F.grouping_id().alias("_g"))
    return g.withColumn("level", F.when(F.col("_g") == 7, "overall").when(F.col("_g") == 3, "marker").otherwise("scope")).drop("_g")


def sample_read_summary(manifest: DataFrame, reads: DataFrame) -> DataFrame:
    """Lengths, distinct sequences and N per manifest sample; samples without reads stay with zeros."""
    n = F.length("seq")
    per = reads.where(n > 0).groupBy("sample_id", "seq").agg(F.count(F.lit(1)).alias("_c"))
    g = per.groupBy(F.col("sample_id").alias("file_id")).agg(
        F.sum("_c").alias("total_reads"), F.count(F.lit(1)).alias("unique_sequences"), F.min(n).alias("min_len"), (F.sum(n * F.col("_c")) / F.sum("_c")).alias("mean_len"),
        F.max(n).alias("max_len"), F.sum(F.when(F.col("seq").contains("N"), F.col("_c")).otherwise(0)).alias("n_reads_with_N"))
    j = manifest.join(g, "file_id", "left").fillna(0, ["total_reads", "unique_sequences", "n_reads_with_N"])
    return j.withColumn("frac_reads_with_N", F.when(F.col("total_reads") > 0, F.col("n_reads_with_N") / F.col("total_reads")))


def clip_primers(df: DataFrame, seq: str = "sequence", primers=None) -> DataFrame:
    """Strict clip: forward primer exactly at the start, then reverse complement of a reverse primer at the end."""
    ps = primers or PRIMERS

    def longest(side, texts):
        out_n, out_h = F.lit(0), F.lit(None).cast("string")
        for name, t in sorted(texts.items(), key=lambda x: len(x[1])):   # the longest match is tested last and wins
            pat = sq.iupac_regex(t)
            hit = F.col(seq).rlike(f"^{pat}" if side == "head" else f"{pat}$")
            out_n, out_h = F.when(hit, len(t)).otherwise(out_n), F.when(hit, name).otherwise(out_h)
        return out_n, out_h

    hn, hh = longest("head", {f"{k}_F": f for k, (f, _) in ps.items()})
    d = df.withColumns({"_h": hn, "clip_head": hh}).withColumn(seq, F.substring(seq, F.col("_h") + 1, F.length(seq)))
    tn, th = longest("tail", {f"{k}_R": sq.revcomp_text(r) for k, (_, r) in ps.items()})
    return d.withColumns({"_t": tn, "clip_tail": th}).withColumn(seq, F.substring(seq, F.lit(1), F.length(seq) - F.col("_t"))).drop("_h", "_t")


def clip_counts(clipped: DataFrame) -> DataFrame:
    """B08."""
    return clipped.groupBy("clip_head", "clip_tail").agg(F.count(F.lit(1)).alias("n_sequences"))


def primer_residue(seqs: DataFrame, seq: str = "sequence", head: int = 30, tail: int = 30, first: int | None = None, by=(), texts=None) -> DataFrame:
    """Share of sequences whose head window starts with a primer, or tail window with its reverse complement.

    ``first`` compares only that many letters. All primers are counted in one aggregation.
    """
    aggs = [F.count(F.lit(1)).alias("total_seqs")]
    texts = texts or TEXTS
    for name, p in texts.items():
        for where, t, win in (("HEAD", p, sq.head(seq, head)), ("TAIL_revcomp", sq.revcomp_text(p), sq.tail(seq, tail))):
            aggs.append(F.sum(win.rlike("^" + sq.iupac_regex(t[:first] if first else t)).cast("int")).alias(f"{name}|{where}"))
    g = seqs.groupBy(*by).agg(*aggs)
    long = g.unpivot([*by, "total_seqs"], [f"{n}|{w}" for n in texts for w in ("HEAD", "TAIL_revcomp")], "_k", "n")
    return long.select(*by, F.split_part("_k", F.lit("|"), F.lit(1)).alias("primer"), F.split_part("_k", F.lit("|"), F.lit(2)).alias("where"), "n", "total_seqs", ratio0("n", "total_seqs").alias("frac"))


def head_fingerprint(seqs: DataFrame, n: int = 20, topk: int = 5, seq: str = "sequence", by=()) -> DataFrame:
    """Most common first n letters; sequences shorter than n count in the denominator only."""
    by = list(by)
    d = seqs.select(*by, F.lit(1).alias("_one"), F.when(F.length(seq) >= n, F.substring(seq, 1, n)).alias("head_n"))
    g = d.groupBy(*by, "_one", "head_n").agg(F.count(F.lit(1)).alias("n"))
    tot = g.groupBy(*by, "_one").agg(F.sum("n").alias("total_seqs"))
    top = top_per_group(g.where(F.col("head_n").isNotNull()), [*by, "_one"], [F.desc("n"), "head_n"], topk, out="rank")
    return top.join(tot, [*by, "_one"]).withColumn("frac", F.col("n") / F.col("total_seqs")).drop("_one")


def clip_effect(seqs: DataFrame, topk: int = 1, primers=None) -> tuple[DataFrame, DataFrame]:
    """Residue and fingerprint before and after clipping."""
    both = seqs.select("sequence", F.lit("pre").alias("phase")).unionByName(clip_primers(seqs, primers=primers).select("sequence", F.lit("post").alias("phase")))
    texts = {f"{k}_F": f for k, (f, _) in (primers or PRIMERS).items()}
    return primer_residue(both, by=["phase"], texts=texts).where(F.col("where") == "HEAD"), head_fingerprint(both, 20, topk, by=["phase"])


def clean_token(x) -> Column:
    """Up to two layers of quotes and one leading '>' off."""
    s = F.trim(c(x))
    for _ in range(2):
        s = F.trim(F.regexp_replace(s, "^(?:\"(.*)\"|'(.*)')$", "$1$2"))
    return F.trim(F.regexp_replace(s, "^>", ""))


def looks_like_seq(x) -> Column:
    s = F.replace(sq.clean(clean_token(x)), F.lit(" "), F.lit(""))
    return (F.length(c(x)) >= 15) & s.rlike("^[ACGTNRYKMSWBDHV]*$")


def classify_token(x) -> Column:
    """B13."""
    s = clean_token(x)
    return (F.when(s == "", "empty").when(looks_like_seq(s), "seq_like").when(s.rlike("^[0-9a-fA-F]{32}$"), "md5_like").when(s.rlike("^[0-9]+$"), "numeric").otherwise("other"))
