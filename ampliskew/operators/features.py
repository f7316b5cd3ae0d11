"""Feature jobs over the distinct sequence catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions import seq as sq
from ..functions.cols import c, ratio0, text_or

# Primers per locus, forward and reverse, 5' to 3'.
PRIMERS = {"12S": ("GGGATTAGATACCCCACTATGCYTA", "GAGGGTGACGGGCGGTGT"),
           "16S": ("ACCAAAAACATCACCTCYAGCAT", "AATAGGATTGCGCTGTTATCCCTA")}
REGIONS = ["head", "mid1", "mid2", "mid3", "tail"]
# Fixed values of the enrichment scan.
ZONE_MOTIFS = ["A", "T", "C", "G", "GC", "AT", "GT", "AC", "GA", "CT"]
ZONE_WINDOWS = [10, 20, 30, 40, 50]
ZONE_THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9]


def spread(catalog: DataFrame, key: str = "seq_id") -> DataFrame:
    """Catalogue over all cores. Sequences are small and their features costly, so partitions cut by size are too few."""
    spark = catalog.sparkSession
    n = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return catalog.repartition(n, key)


def regions_strict(df: DataFrame, seq: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """(rows with head, mid1..3, tail; rows shorter than 61 letters)."""
    s = F.upper(seq)
    parts = sq.regions_even_sizes(s)
    ok = df.where(F.length(seq) >= 61).withColumns(dict(zip(REGIONS, parts)))
    return ok, df.where(F.length(seq) < 61)


def regions_soft(df: DataFrame, seq: str = "sequence", w: int = 30, bins: int = 3, even: bool = False) -> DataFrame:
    """F02 (remainder to the first parts) or F03 (``even``: cut at floor(b*m/bins)); short sequences are kept."""
    parts = (sq.regions_floor if even else sq.regions_even_sizes)(seq, w, bins)
    names = [f"head{w}", *[f"mid{i}" for i in range(bins)], f"tail{w}"]
    return df.withColumns(dict(zip(names, parts)))


def sequence_context(catalog: DataFrame, ab: DataFrame) -> DataFrame:
    """regions and lengths with the markers, sample types and labels a sequence was seen under.

    Distinct (sequence, value) pairs are formed before they are listed, so a list holds at most the few markers,
    types and labels that exist.
    """
    seen = ab.select("seq_id", "marker", "sample_type", "species_label").distinct()
    join = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    seen = seen.groupBy("seq_id").agg(join("marker").alias("markers"), join("sample_type").alias("sample_types_seen"),
                                      join("species_label").alias("species_labels_seen"))
    ok, _ = regions_strict(catalog)
    return (ok.join(seen, "seq_id", "left").withColumn("markers", text_or("markers", "UNKNOWN"))
            .withColumn("length", F.length("sequence")).withColumns({f"{r}_len": F.length(r) for r in REGIONS}))


def base_composition(s) -> dict[str, Column]:
    """F05, F06, F07, F08."""
    n = F.length(s)
    return {
        "feat_len": n, **{f"feat_p{b}": ratio0(sq.n_of(s, b), n) for b in "ACGTN"}, "feat_hasN": (sq.n_of(s, "N") > 0).cast("int"),
        "feat_gc": sq.gc_share(s), "feat_at": ratio0(sq.n_of(s, "AT"), n), "feat_gc2": sq.gc_share(s) * sq.gc_share(s),
        "feat_gc_skew": sq.skew(s, "G", "C"), "feat_at_skew": sq.skew(s, "A", "T"),
        "feat_5p_base": F.substring(s, 1, 1), "feat_3p_base": F.right(s, F.lit(1)),
        "feat_gc_head30": sq.gc_share(sq.head(s)), "feat_gc_tail30": sq.gc_share(sq.tail(s)),
        "feat_entropy1": sq.base_entropy(s), "feat_entropy_len": sq.base_entropy(s, "length"), "feat_entropy_symbols": sq.symbol_entropy(s),
    }


def stage_dinucleotides(df: DataFrame, seq: str = "sequence") -> DataFrame:
    """adds ``_di``, the 16 counts and their total; features read it as a column instead of counting again."""
    return (df.withColumn("_d", F.struct(*[v.alias(k) for k, v in sorted(sq.dinucleotide_counts(seq).items())]))
            .withColumn("_di", F.struct("_d.*", sum((F.col(f"_d.{a}{b}") for a in "ACGT" for b in "ACGT"), F.lit(0)).alias("total"))).drop("_d"))


def dinucleotides(s) -> dict[str, Column]:
    """F12, from the staged counts."""
    d = lambda x: F.col(f"_di.{x}")
    n = F.length(s)
    exp = ratio0(sq.n_of(s, "C"), n) * ratio0(sq.n_of(s, "G"), n) * F.greatest(n - 1, F.lit(0))
    per = F.greatest(n - 1, F.lit(1))
    return {**{f"feat_di_{a}{b}": ratio0(d(a + b), d("total")) for a in "ACGT" for b in "ACGT"}, "feat_CpG": d("CG") / per,
            "feat_UpA": d("TA") / per, "feat_or_CpG": ratio0(d("CG"), exp)}


def homopolymers(s, scan: Column | None = None) -> dict[str, Column]:
    """F11 on the maximal runs; ``scan``: see ``complexity``."""
    x = scan if scan is not None else arrow.scans("runs")(c(s))
    return {f"feat_{f}": x[f] for f in arrow.SCANS["runs"][0]}


def complexity(s, scan: Column | None = None) -> dict[str, Column]:
    """F09, F10, F13-F18, F22. ``scan``: a struct of all ``arrow.SCANS``, where it is at hand."""
    x = scan if scan is not None else arrow.scans("direp", "trirep", "tandem_density", "end_complement", "alternating", "dust")(c(s))
    g = F.regexp_extract_all(c(s), F.lit("G+"), F.lit(0))
    return {
        "feat_lz76": arrow.lz76(s), "feat_lz": arrow.zlib_ratio(s), "feat_dust": x["dust"],
        "feat_direp_maxreps": x["direp"], "feat_trirep_maxreps": x["trirep"], "feat_tandem_density": x["tandem_density"],
        "feat_end_complement": x["end_complement"], "feat_g4_count": sq.g4_count(s), "feat_g4_open": sq.quadruplex_open(s, "G"),
        "feat_imotif": sq.quadruplex_open(s, "C"),
        "feat_G_island_max": sq.longest(g), "feat_G_island_n3": sq.n_at_least(g, 3), "feat_zdna_alt_max": x["alternating"],
    }


def thermo(s, scan: Column | None = None) -> dict[str, Column]:
    """F21, F22; ``scan``: see ``complexity``."""
    x = scan if scan is not None else arrow.scans("gc_w20")(c(s))
    return {"feat_tm_wallace": sq.tm_wallace(s), "feat_tm": sq.tm_nn(s),
            "feat_tm_method": F.when(F.length(F.translate(s, "N", "")) > 0, "nearest_neighbour").otherwise("none"),
            "feat_tm_w20_max": sq.tm_window_max(s, 20), "feat_gc_w20_max": x["gc_w20"]}


def kmer_summaries(df: DataFrame, seq: str = "sequence", kmax: int = 8) -> DataFrame:
    """per k distinct, entropy, Gini, top-10 share and linguistic complexity, inside the row (no shuffle)."""
    ks = range(1, kmax + 1)
    d = df.withColumn("_words", arrow.word_summaries(kmax)(seq))
    n = F.length(seq)
    out = {}
    for k in ks:
        for f in ("distinct", "entropy", "gini", "top10cov"):
            out[f"feat_k{k}_{f}"] = F.col(f"_words.{f}_{k}")
        room = F.least(F.lit(4 ** k), n - (k - 1))
        out[f"feat_lingcomp_k{k}"] = F.when(room > 0, F.col(f"_words.distinct_{k}") / room).otherwise(0.0)
    d = d.withColumns(out)
    mean = sum((F.col(f"feat_lingcomp_k{k}") for k in ks), F.lit(0.0)) / kmax
    return d.withColumn(f"feat_lingcomp_mean_k1_{kmax}", mean).drop("_words")


def primer_features(df: DataFrame, seq: str = "sequence", primers=None, slack: int = 10) -> DataFrame:
    """every primer of every locus against every sequence; reverse primers by their reverse complement."""
    sites, out = {}, {}
    n = F.length(seq)
    for locus, (fwd, rev) in (primers or PRIMERS).items():
        for side, text in (("f", fwd.upper()), ("r", sq.revcomp_text(rev))):
            k = len(text)
            lo = F.lit(0) if side == "f" else F.greatest(F.lit(0), n - (k + slack))
            hi = F.least(n - k, F.lit(slack)) if side == "f" else n - k
            m, q = f"_{locus}_{side}", f"feat_pr_{locus}_{side}_"
            sites[m] = arrow.primer_sites(seq, F.lit(text), lo, F.greatest(lo, hi))
            pos, end = F.col(m)["pos"], F.col(m)["end_pos"]
            three = [(j, text[j]) for j in (range(max(0, k - 5), k) if side == "f" else range(min(5, k)))]
            misses = sum((F.coalesce((~sq.sub(seq, pos + 1 + j, 1).isin(*sq.IUPAC[x])).cast("int"), F.lit(1)) for j, x in three), F.lit(0))
            out.update({
                q + "mm_best": F.col(m)["mm"], q + "pos_best": pos, q + "mm_end": F.col(m)["end_mm"], q + "pos_end": end,
                q + "is_end": (end != -1).cast("int"), q + "mm_3p5_best": F.when(pos != -1, misses),
                q + "gc_end": F.when(end != -1, sq.gc_share(sq.sub(seq, end + 1, k))), q + "endwin60": sq.local_window(seq, end, k)})
    return df.withColumns(sites).withColumns(out).drop(*sites)


def primer_mismatch(regions: DataFrame, primers: DataFrame) -> DataFrame:
    """literal mismatches of head and tail against the primers of the marker (other markers drop out).

    ``primers``: marker, forward_primer_5to3, reverse_primer_5to3; a handful of rows, joined on the marker.
    """
    p = primers.select("marker", F.upper("forward_primer_5to3").alias("_f"), sq.revcomp("reverse_primer_5to3").alias("_r"))
    d = regions.join(p, "marker")

    def misses(a, b):
        k = F.least(F.length(a), F.length(b))
        idx = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(idx, lambda i: F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1)))

    d = d.withColumns({"_fm": misses(F.left("head", F.length("_f")), F.col("_f")), "_rm": misses(F.right("tail", F.length("_r")), F.col("_r"))})
    score = lambda m, k: F.aggregate(m, F.lit(0.0), lambda a, i: a + 1.0 / (k - i))
    last = lambda m, k: F.array_contains(m, k - 1).cast("int")
    f, r = F.length("_f"), F.length("_r")
    fs, rs = score(F.col("_fm"), f), score(F.col("_rm"), r)
    text = lambda m: F.array_join(F.transform(m, lambda x: x.cast("string")), ",")
    return d.select(
        "seq_id", "marker", f.alias("forward_primer_len"), r.alias("reverse_primer_len"), F.size("_fm").alias("mismatch_fwd_total"),
        F.size("_rm").alias("mismatch_rev_total"), (F.size("_fm") + F.size("_rm")).alias("mismatch_total"),
        fs.alias("mismatch_fwd_weighted_score"), rs.alias("mismatch_rev_weighted_score"), (fs + rs).alias("mismatch_weighted_score"),
        (last(F.col("_fm"), f) + last(F.col("_rm"), r)).alias("mismatch_3prime_total"),
        text(F.col("_fm")).alias("mismatch_fwd_positions"), text(F.col("_rm")).alias("mismatch_rev_positions"))


def regional_features(regions: DataFrame, seq: str = "sequence") -> DataFrame:
    """length, GC, skews, entropy, LZ76 and longest run of the whole sequence and of the five regions."""
    cols = {}
    for r, s in (("global", F.upper(seq)), *((x, F.col(x)) for x in REGIONS)):
        cols.update({f"len_{r}": F.length(s), f"gc_{r}": sq.gc_share(s), f"at_skew_{r}": sq.skew(s, "A", "T"), f"gc_skew_{r}": sq.skew(s, "G", "C"),
                     f"entropy_{r}": sq.base_entropy(s, "length"), f"lz_{r}": arrow.lz76(s), f"homopolymer_max_{r}": sq.longest(sq.runs(s))})
    return spread(regions).select("seq_id", *[v.alias(k) for k, v in cols.items()])


def core_features(catalog: DataFrame, structure: str | None = None) -> DataFrame:
    """the full feature row per distinct sequence; ``structure`` names a supplied dot-bracket column."""
    d = spread(catalog).withColumn("sequence", sq.clean("sequence"))
    d = stage_dinucleotides(primer_features(kmer_summaries(d)))
    s = F.col("sequence")
    d, x = d.withColumn("_scan", arrow.scans(*arrow.SCANS)(s)), F.col("_scan")
    cols = {**base_composition(s), **dinucleotides(s), **homopolymers(s, x), **complexity(s, x), **thermo(s, x)}
    cols.update({f"feat_pal_{k}": x[f"pal_{k}"] for k in ("n6", "n8", "n10")})
    cols["feat_pal_maxlen"] = x["pal_max_len"]
    if structure:
        d = d.withColumn("_db", sq.structure_stats(structure))
        cols.update({f"feat_{k}": F.col(f"_db.{k}") for k in ("pair_frac", "stem_max", "loop_max", "hairpin_count")})
    return d.withColumns(cols).drop("_scan", "_db", "_di")


def attach_mfe(regions: DataFrame, mfe: DataFrame) -> DataFrame:
    """supplied energies (seq_id, region, line_no, mfe) as mfe_<region>; the last line of an id wins."""
    m = mfe.groupBy("seq_id").agg(*[F.max_by("mfe", F.when(F.col("region") == r, F.col("line_no"))).alias(f"mfe_{r}") for r in ["global", *REGIONS]])
    return regions.select("seq_id").distinct().join(m, "seq_id", "left")


def enrichment_zones(catalog: DataFrame, motifs=None, wins=None, thresholds=None, seq: str = "sequence") -> DataFrame:
    """merged intervals (1-based, closed) where a window holds at least w*t letters of the motif set.

    A hit starts a new zone when it lies more than w after the previous hit; zone ends follow the same way.
    """
    z = _zone_rows(catalog, motifs, wins, thresholds, seq, "start int, end int")
    return z.withColumn("midpoint", (F.col("start") + F.col("end")) / 2)


def zone_totals(catalog: DataFrame, motifs=None, wins=None, thresholds=None, seq: str = "sequence") -> DataFrame:
    """``zone_summary`` of the zones of a catalogue with one row a sequence, added up where they are found."""
    return _zone_rows(catalog, motifs, wins, thresholds, seq, "num_zones long, total_length long")


def _zone_rows(catalog, motifs, wins, thresholds, seq, values: str) -> DataFrame:
    motifs, wins, thresholds = motifs or ZONE_MOTIFS, wins or ZONE_WINDOWS, sorted(thresholds or ZONE_THRESHOLDS)
    name = lambda xs, f: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col(f) + 1)
    src = spread(catalog).select("seq_id", F.upper(seq).alias("s"))
    kind = src.schema["seq_id"].dataType.simpleString()
    z = src.mapInArrow(arrow.zone_rows(motifs, wins, thresholds, "num_zones" in values), f"seq_id {kind}, motif int, window int, threshold int, {values}")
    return z.withColumns({"motif": name(motifs, "motif"), "threshold": name(thresholds, "threshold")})


def zone_summary(zones: DataFrame) -> DataFrame:
    """zones and covered length per sequence, motif, window and threshold."""
    return zones.groupBy("seq_id", "motif", "window", "threshold").agg(
        F.count(F.lit(1)).alias("num_zones"), F.sum(F.col("end") - F.col("start") + 1).alias("total_length"))
