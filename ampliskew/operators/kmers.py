"""k-mer operators."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_facts
from ..functions import seq as sq
from ..functions.arrow import Letters
from ..functions.cols import ratio0
from ..functions.ranks import top_per_group
from ..functions.words import MAX_K, Rolled, spelled
from .features import spread

#: Rows of one Arrow batch of words.
ROWS = 100_000
#: Rows whose words are added up together, and sums that a task holds before it hands them on.
PAIRS, HELD_SUMS = 2000, 8_000_000
BASE4 = str.maketrans("ACGT", "0123")


def _count_words(df: DataFrame, tables: list[tuple[dict, Column]]) -> DataFrame:
    """seq_id, labels, kmer, n for every (labels, word array).

    The catalogue is spread by seq_id first, so the words of a sequence are counted where they are exploded: the
    groupBy holds seq_id and needs no further shuffle.
    """
    labels = list(tables[0][0])
    tag = lambda lit: lambda x: F.struct(*lit, x.alias("kmer"))
    parts = [F.transform(words, tag([F.lit(v).alias(k) for k, v in d.items()])) for d, words in tables]
    return (spread(df).select("seq_id", F.explode(F.flatten(F.array(*parts))).alias("_w")).select("seq_id", "_w.*")
            .groupBy("seq_id", *labels, "kmer").agg(F.count(F.lit(1)).cast("int").alias("n")))


SCOPES = ("all", "head", "tail")


def kmers_long(catalog: DataFrame, ks=range(1, 9), scopes=SCOPES, seq: str = "sequence", w: int = 30) -> DataFrame:
    """seq_id, scope, k, kmer, n; words with N are skipped, words with other letters kept as they are.

    Words are numbers of two bits a base that roll along all sequences of a batch; nothing is shuffled.
    """
    ks = sorted(ks)
    src = catalog.select("seq_id", seq)
    kind = src.schema["seq_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rolled, ids = Rolled(b.column(1), w), b.column(0)
            names = pa.schema([("seq_id", ids.type), ("scope", pa.string()), ("k", pa.int32()), ("kmer", pa.string()), ("n", pa.int32())])
            for k in ks:
                for s in scopes:
                    owner, word, n, odd = rolled.counted(k, s)
                    parts = [(owner, spelled(k).take(pa.array(word)), n)]
                    if odd:
                        parts.append((np.asarray([o for o, _ in odd]), pa.array([x for _, x in odd]), np.asarray(list(odd.values()))))
                    for at, words, times in parts:
                        for a in range(0, len(at), ROWS):
                            z = slice(a, a + ROWS)
                            m = len(at[z])
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[z])), pa.array([s] * m), pa.array(np.full(m, k, "i4")), words[z], pa.array(times[z].astype("i4"))], schema=names)

    return src.mapInArrow(run, f"seq_id {kind}, scope string, k int, kmer string, n int")


def kmer_df(kmers: DataFrame) -> DataFrame:
    """Sequences holding the k-mer and occurrences."""
    return kmers.groupBy("scope", "k", "kmer").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total_count"))


def kmer_table(catalog: DataFrame, ks=range(1, 9), scopes=SCOPES, seq: str = "sequence", w: int = 30) -> DataFrame:
    """G02 straight from sequences: scope, k, kmer, df, total_count.

    Each task adds up 4^k counters a scope and word length and sends those in use, so what is shuffled doesn't grow with
    the sequences.
    """
    ks = sorted(ks)
    names = pa.schema([("scope", pa.string()), ("k", pa.int32()), ("kmer", pa.string()), ("df", pa.int64()), ("total_count", pa.int64())])

    def run(batches):
        seen = {(s, k): np.zeros((2, 4**k), "i8") for s in scopes for k in ks}
        odd_df, odd_n = Counter(), Counter()
        for b in batches:
            rolled = Rolled(b.column(0), w)
            for k in ks:
                for s in scopes:
                    _, word, n, odd = rolled.counted(k, s)
                    seen[s, k][0] += np.bincount(word, minlength=4**k)
                    seen[s, k][1] += np.bincount(word, n, 4**k).astype("i8")
                    for (_, text), times in odd.items():
                        odd_df[s, k, text] += 1
                        odd_n[s, k, text] += times
        for (s, k), (df, n) in seen.items():
            used = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(used)), pa.array(np.full(len(used), k, "i4")), spelled(k).take(pa.array(used)), pa.array(df[used]), pa.array(n[used])], schema=names)
        if odd_df:
            s, k, text = zip(*odd_df)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(k, pa.int32()), pa.array(text), pa.array(list(odd_df.values()), pa.int64()), pa.array([odd_n[x] for x in odd_df], pa.int64())], schema=names)

    parts = catalog.select(seq).mapInArrow(run, "scope string, k int, kmer string, df long, total_count long")
    return parts.groupBy("scope", "k", "kmer").agg(F.sum("df").alias("df"), F.sum("total_count").alias("total_count"))


def select_vocab(df: DataFrame, min_df: int = 10, max_per_k: int = 2000) -> DataFrame:
    """Most widespread k-mers per scope and k (ties: total, then the k-mer)."""
    return top_per_group(df.where(F.col("df") >= min_df), ["scope", "k"], [F.desc("df"), F.desc("total_count"), "kmer"], max_per_k)


def union_vocab(vocab: DataFrame, min_k: int = 6, max_k: int = 8, cap: int = 4000) -> DataFrame:
    """Scopes summed up, top ``cap`` per k."""
    u = vocab.where(F.col("k").between(min_k, max_k)).groupBy("k", "kmer").agg(F.sum("df").alias("df_sum"), F.sum("total_count").alias("total_sum"))
    return top_per_group(u, ["k"], [F.desc("df_sum"), F.desc("total_sum"), "kmer"], cap)


def select_vocab_capped(df: DataFrame, min_df: int = 2, top_per_k: int = 200, cap: int = 1600) -> DataFrame:
    """Top per k by support, then a global cap (support desc, k, k-mer)."""
    per = top_per_group(df.where(F.col("df") >= min_df), ["k"], [F.desc("df"), "kmer"], top_per_k)
    return per.orderBy(F.desc("df"), "k", "kmer").limit(cap)


def expand_kmers(core: DataFrame, kmers: DataFrame, vocab: list[tuple[str, int, str]]) -> DataFrame:
    """One 0-default column feat_<scope>_k<k>_<kmer> per entry of a short vocabulary (larger ones: sparse vectors)."""
    names = [f"feat_{s}_k{k}_{m}" for s, k, m in vocab]
    hit = lambda s, k, m: (F.col("scope") == s) & (F.col("k") == k) & (F.col("kmer") == m)
    wide = (kmers.where(F.concat_ws("|", "scope", "k", "kmer").isin([f"{s}|{k}|{m}" for s, k, m in vocab]))
            .groupBy("seq_id").agg(*[F.max(F.when(hit(*v), F.col("n"))).alias(n) for v, n in zip(vocab, names)]))
    return core.join(wide, "seq_id", "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})


def region_of_start(start: Column, k: int, length: Column, head: int, tail: int, bins: int) -> Column:
    """Region of a 0-based start; the head test comes first, words across a border belong nowhere (NULL)."""
    tail_start = F.greatest(length - tail, F.lit(0))
    npos = tail_start - head - k + 1
    b = F.least(F.floor((start - head) * bins / npos), F.lit(bins - 1)).cast("int")
    return (F.when(start + k <= head, f"head{head}").when(start >= tail_start, f"tail{tail}")
            .when((start >= head) & (start + k <= tail_start) & (npos > 0), F.concat(F.lit("mid"), b)))


def region_kmers_strict(clipped: DataFrame, vocab: DataFrame | None = None, ks=(6, 7, 8), head: int = 30, tail: int = 30, bins: int = 3,
                        mode: str = "count", seq: str = "sequence") -> DataFrame:
    """seq_id, k, region, kmer, x over clipped sequences, restricted to the vocabulary (k, kmer) when given.

    The vocabulary is capped per k (G04), so broadcasting it is bounded.
    """
    clipped, n = clipped.withColumn("_len", F.length(seq)), F.col("_len")   # a column, so it is not measured once per word
    long = _count_words(clipped, [({"k": k}, _placed(seq, k, n, head, tail, bins)) for k in ks])
    long = long.select("seq_id", "k", F.split_part("kmer", F.lit("_"), F.lit(1)).alias("region"),
                       F.split_part("kmer", F.lit("_"), F.lit(2)).alias("kmer"), F.col("n").cast("double").alias("x"))
    if vocab is not None:
        long = long.join(F.broadcast(vocab.select("k", "kmer").distinct()), ["k", "kmer"], "left_semi")
    return long.withColumn("x", F.lit(1.0)) if mode == "presence" else long


def _placed(seq, k, n, head, tail, bins) -> Column:
    """Words of one k as <region>_<kmer>; words with N or across a border are left out."""
    named = F.transform(sq.windows(seq, k), lambda x, i: F.when(~F.contains(x, F.lit("N")), F.concat(
        region_of_start(i, k, n, head, tail, bins), F.lit("_"), x)))
    return F.filter(named, lambda x: x.isNotNull())


def region_kmer_table(catalog: DataFrame, ks=(6, 7, 8), head: int = 30, tail: int = 30, bins: int = 3, strict: bool = True, seq: str = "sequence") -> DataFrame:
    """G07 (``strict``) or G08 straight from sequences: k, region, kmer, n_seqs, x.

    Each task rolls its sequences' words as numbers, tells their regions by their starts and adds up counters of word and
    region; only those in use are sent on, so what is shuffled doesn't grow with the sequences. Words with N or across a
    border are left out; words with other letters are kept as they are. G08's middle parts take the remainder first.
    """
    ks, names = sorted(ks), [f"head{head}", *[f"mid{i}" for i in range(bins)], f"tail{tail}"]
    schema = pa.schema([("k", pa.int32()), ("region", pa.string()), ("kmer", pa.string()), ("n_seqs", pa.int64()), ("x", pa.int64())])
    many = len(names)

    def placed(start, size, k):
        """(windows, regions) of each start; a window of G08 may lie in several segments of a short sequence."""
        if strict:
            border = np.maximum(size - tail, 0)
            room = border - head - k + 1
            mid = np.minimum((start - head) * bins // np.maximum(room, 1), bins - 1)
            where = np.where(start + k <= head, 0, np.where(start >= border, many - 1, np.where((start >= head) & (start + k <= border) & (room > 0), 1 + mid, -1)))
            on = np.flatnonzero(where >= 0)
            return on, where[on]
        middle = np.maximum(size - head - tail, 0)
        base, rest = middle // bins, middle % bins
        cuts = [head + base * b + np.minimum(rest, b) for b in range(bins + 1)]
        inside = [start + k <= head, *((start >= a) & (start + k <= np.minimum(z, size)) for a, z in zip(cuts, cuts[1:])), start >= size - tail]
        on = [np.flatnonzero(x) for x in inside]
        return np.concatenate(on), np.repeat(np.arange(many), [len(x) for x in on])

    def run(batches):
        seen = {k: np.zeros((2, many * 4**k), "i8") for k in ks}
        odd_df, odd_n = Counter(), Counter()
        for whole in batches:
            for a in range(0, whole.num_rows, PAIRS):
                rolled = Rolled(whole.column(0).slice(a, PAIRS), head)
                for k in ks:
                    code = rolled._roll(k)
                    n = len(code)
                    start, size, owner = rolled.start[:n], rolled.size[:n], rolled.owner[:n]
                    inside = (start + k <= size) & (rolled.skips[k:k + n] == rolled.skips[:n])
                    at = np.flatnonzero(inside)
                    on, region = placed(start[at], size[at], k)
                    on = at[on]
                    packed = rolled.others[k + on] == rolled.others[on]
                    word = region[packed] * 4**k + code[on[packed]]
                    seen[k][1] += np.bincount(word, minlength=many * 4**k)
                    each = np.unique(owner[on[packed]] * (many * 4**k) + word) % (many * 4**k)
                    seen[k][0] += np.bincount(each, minlength=many * 4**k)
                    texts = Counter((int(owner[i]), int(r), rolled.data[i:i + k].tobytes().decode("latin-1")) for i, r in zip(on[~packed].tolist(), region[~packed].tolist()))
                    for (_, r, text), times in texts.items():
                        odd_df[k, r, text] += 1
                        odd_n[k, r, text] += times
        for k, (df, x) in seen.items():
            used = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, "i4")), pa.array(names).take(pa.array(used >> 2 * k)), spelled(k).take(pa.array(used & (4**k - 1))), pa.array(df[used]), pa.array(x[used])], schema=schema)
        if odd_df:
            k, r, text = zip(*odd_df)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([names[i] for i in r]), pa.array(text), pa.array(list(odd_df.values()), pa.int64()), pa.array([odd_n[i] for i in odd_df], pa.int64())], schema=schema)

    parts = catalog.select(seq).mapInArrow(run, "k int, region string, kmer string, n_seqs long, x long")
    return parts.groupBy("k", "region", "kmer").agg(F.sum("n_seqs").alias("n_seqs"), F.sum("x").alias("x"))


def feature_name(k="k", region="region", kmer="kmer") -> Column:
    return F.concat(F.lit("k"), F.col(k), F.lit("_"), F.col(region), F.lit("_"), F.col(kmer))


def region_kmers_segment(seqs: DataFrame, features: DataFrame | None = None, ks=(6, 7, 8), head: int = 30, bins: int = 3, even: bool = False,
                         mode: str = "count", seq: str = "sequence") -> DataFrame:
    """Cut into segments first, then slide inside each; ``features`` (feature) restricts to a capped list."""
    parts = (sq.regions_floor if even else sq.regions_even_sizes)(seq, head, bins)
    names = [f"head{head}", *[f"mid{i}" for i in range(bins)], f"tail{head}"]
    d = seqs.withColumns(dict(zip(names, parts)))
    long = _count_words(d, [({"k": k, "region": r}, sq.kmers(r, k)) for r in names for k in ks])
    long = long.select("seq_id", "k", "region", "kmer", F.col("n").cast("double").alias("x"))
    if features is not None:
        long = (long.withColumn("feature", feature_name()).join(F.broadcast(features.select("feature").distinct()), "feature", "left_semi").drop("feature"))
    return long.withColumn("x", F.lit(1.0)) if mode == "presence" else long


def region_kmers_full(seqs: DataFrame, k: int, head: int = 30, bins: int = 3, mode: str = "count") -> DataFrame:
    """Every k-mer of k=1..5 in five regions; column = region * 4^k + base-4 code of the k-mer."""
    names = [f"head{head}", *[f"mid{i}" for i in range(bins)], f"tail{head}"]
    order = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("region")) - 1
    code = F.conv(F.translate("kmer", "ACGT", "0123"), 4, 10).cast("long")
    long = region_kmers_segment(seqs, None, [k], head, bins, even=True, mode=mode)
    return long.withColumn("col", (order * 4 ** k + code).cast("long"))


MOTIF_REGIONS = ["global", "head", "tail", "mid1", "mid2", "mid3"]


def _motif_words(regions: DataFrame, ks) -> DataFrame:
    d = regions.withColumn("global", F.upper("sequence"))
    return _count_words(d, [({"region": r, "k": k}, sq.windows(r, k)) for r in MOTIF_REGIONS for k in ks])


def motif_catalog(regions: DataFrame, ks=(4, 5), top: int = 20) -> DataFrame:
    """Most frequent words per region and k (words may hold N); ties by the word."""
    g = _motif_words(regions, ks).groupBy("region", "k", "kmer").agg(F.sum("n").alias("global_occurrence_count"))
    return top_per_group(g, ["region", "k"], [F.desc("global_occurrence_count"), "kmer"], top).withColumnRenamed("kmer", "motif")


#: Sequences whose motifs are counted together.
MOTIF_ROWS = 500


def motif_counts(texts: list[str | None], motifs: list[str], ks=(4, 5)) -> np.ndarray:
    """How often each of ``motifs`` with a length in ``ks`` occurs in each text, overlaps included; all windows of a length are looked up at once."""
    x = Letters([t or "" for t in texts])
    alphabet = np.unique(Letters(motifs).code)
    number = lambda code: np.where(alphabet[(at := np.minimum(np.searchsorted(alphabet, code), len(alphabet) - 1))] == code, at + 1, 0)
    letter, base = number(x.code), len(alphabet) + 1
    out = np.zeros(len(texts) * len(motifs), "i8")
    for k in ks:
        own, n = np.asarray([j for j, m in enumerate(motifs) if len(m) == k], "i8"), len(letter) - k + 1
        if not len(own) or n < 1:
            continue
        words = number(Letters([motifs[j] for j in own]).code).reshape(-1, k) @ base ** np.arange(k)
        by = np.argsort(words)
        at = np.flatnonzero(x.left[:n] >= k)
        code = sum(letter[j:j + n] * base**j for j in range(k))[at]
        place = np.minimum(np.searchsorted(words, code, sorter=by), len(own) - 1)
        hit = words[by[place]] == code
        out += np.bincount(x.owner[at[hit]] * len(motifs) + own[by[place[hit]]], minlength=len(out))
    return out.reshape(len(texts), len(motifs))


def motif_features(regions: DataFrame, catalog: DataFrame) -> DataFrame:
    """G11, long: count and presence of every selected motif per sequence and region, zeros kept.

    The catalogue is capped (regions x k x top), so it comes to the driver; sequences are spread over all tasks, where their motifs are counted a batch at once.
    """
    found: dict[str, list[str]] = {}
    for r in catalog.select("region", "motif").distinct().collect():
        found.setdefault(r.region, []).append(r.motif)
    motifs = {r: sorted(found[r]) for r in MOTIF_REGIONS if r in found}
    src = spread(regions).withColumn("global", F.upper("sequence")).select("seq_id", *motifs)
    names = ["seq_id", "region", "motif", "count", "present"]

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, MOTIF_ROWS):
                b = whole.slice(a, MOTIF_ROWS)
                for i, (region, own) in enumerate(motifs.items()):
                    n = motif_counts(b.column(i + 1).to_pylist(), own).ravel().astype("i4")
                    rows = np.repeat(np.arange(b.num_rows), len(own))
                    motif = pa.array(own, pa.string()).take(pa.array(np.tile(np.arange(len(own)), b.num_rows)))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([region]).take(pa.array(np.zeros(len(n), "i8"))), motif, pa.array(n), pa.array((n > 0).astype("i4"))], names)

    return src.mapInArrow(run, f"seq_id {src.schema['seq_id'].dataType.simpleString()}, region string, motif string, count int, present int")


def sample_kmer_norm(ab: DataFrame, kmers: DataFrame, vocab: DataFrame, totals: DataFrame) -> DataFrame:
    """Reads x occurrences per sample and vocabulary k-mer, and the same per read."""
    k = kmers.join(F.broadcast(vocab.select("scope", "k", "kmer")), ["scope", "k", "kmer"], "left_semi")
    s = (ab.select("sample_id", "seq_id", "count").join(k, "seq_id").groupBy("sample_id", "scope", "k", "kmer")
         .agg(F.sum(F.col("count") * F.col("n")).alias("sum_count")))
    return join_facts(s, totals.select("sample_id", "total"), "sample_id", "kmer").where("total > 0").withColumn("norm_per_read", F.col("sum_count") / F.col("total"))


def sample_kmer_sums(ab: DataFrame, catalog: DataFrame, vocab: DataFrame, totals: DataFrame, seq: str = "sequence", w: int = 30) -> DataFrame:
    """G12 straight from sequences: as ``sample_kmer_norm``, without a row for every word of every sequence and sample.

    Each task rolls the words of its sequences once, adds reads x occurrences up by sample and vocabulary word, and sends
    the sums. ``vocab`` is capped by scope and k (G03), so it is broadcast; one with letters beyond A, C, G, T takes
    the other way.
    """
    words = vocab.select("scope", "k", "kmer").distinct().orderBy("scope", "k", "kmer").toArrow()
    scope, k, kmer = (words.column(i).to_pylist() for i in range(3))
    if not kmer or any(set(x) - set("ACGT") for x in kmer) or max(k) > MAX_K:
        return sample_kmer_norm(ab, kmers_long(catalog, sorted(set(k)), sorted(set(scope)), seq, w), vocab, totals)
    size, place = len(kmer), {x: np.full(4 ** x[1], -1, "i4") for x in zip(scope, k)}
    for i, (s, n, text) in enumerate(zip(scope, k, kmer)):
        place[s, n][int(text.translate(BASE4), 4)] = i
    src = ab.select("sample_id", "seq_id", "count").join(catalog.select("seq_id", seq), "seq_id").select("sample_id", F.col("count").cast("double").alias("c"), seq)
    kind = src.schema["sample_id"].dataType.simpleString()

    def out(held, kind):
        for sample, sums in held.items():
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([sample] * len(used), kind), pa.array(used.astype("i4")), pa.array(sums[used])], ["sample_id", "i", "x"])

    def run(batches):
        held, own_kind = {}, pa.string()
        for whole in batches:
            own_kind = whole.schema.field(0).type
            for a in range(0, whole.num_rows, PAIRS):
                b = whole.slice(a, PAIRS)
                texts, samples = b.column(2).dictionary_encode(), b.column(0).dictionary_encode()
                rolled, parts = Rolled(texts.dictionary, w), []
                for (s, n), at in sorted(place.items(), key=lambda x: x[0][1]):
                    owner, code, times, _ = rolled.counted(n, s)
                    on = at[code] >= 0
                    parts.append((owner[on], at[code[on]], times[on]))
                owner, word, times = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, "i8"),) * 3
                order = np.argsort(owner, kind="stable")
                word, times = word[order], times[order]
                length = np.bincount(owner, minlength=len(texts.dictionary))
                first = np.cumsum(length) - length
                ok = pc.and_(pc.is_valid(b.column(0)), pc.is_valid(b.column(2))).to_numpy(zero_copy_only=False)
                row, sample = texts.indices.fill_null(0).to_numpy()[ok], samples.indices.fill_null(0).to_numpy()[ok]
                many = length[row]
                at = np.arange(many.sum()) + np.repeat(first[row] - (np.cumsum(many) - many), many)
                sums = np.bincount(np.repeat(sample.astype("i8"), many) * size + word[at], times[at] * np.repeat(b.column(1).to_numpy()[ok], many), len(samples.dictionary) * size).astype("f8")  # whole numbers without any row
                for name, own in zip(samples.dictionary.to_pylist(), sums.reshape(-1, size)):
                    held[name] = held[name] + own if name in held else own
            if len(held) * size > HELD_SUMS:
                yield from out(held, own_kind)
                held = {}
        yield from out(held, own_kind)

    sums = src.mapInArrow(run, f"sample_id {kind}, i int, x double").groupBy("sample_id", "i").agg(F.sum("x").cast("long").alias("sum_count"))
    names = ab.sparkSession.createDataFrame(words.append_column("_i", pa.array(np.arange(size, dtype="i4"))))
    s = sums.join(F.broadcast(names), F.col("i") == F.col("_i")).select("sample_id", "scope", "k", "kmer", "sum_count")
    return join_facts(s, totals.select("sample_id", "total"), "sample_id", "kmer").where("total > 0").withColumn("norm_per_read", F.col("sum_count") / F.col("total"))


def pair_kmer_log2fc(norm: DataFrame, pairs: DataFrame, eps: float = 1e-12) -> DataFrame:
    """log2 ratio of the two sides for k-mers present on either; k-mers on neither side are 0 and left out."""
    side = F.explode(F.array(F.struct(F.col("yes_file_id").alias("sample_id"), F.lit(1).alias("yes")),
                             F.struct(F.col("no_file_id").alias("sample_id"), F.lit(0).alias("yes"))))
    p = pairs.select("pair_id", side.alias("s")).select("pair_id", "s.sample_id", "s.yes")
    val = lambda v: F.coalesce(F.sum(F.when(F.col("yes") == v, F.col("norm_per_read"))), F.lit(0.0))
    g = join_facts(norm, p, "sample_id", "kmer").groupBy("pair_id", "scope", "k", "kmer").agg(val(1).alias("yes_norm"), val(0).alias("no_norm"))
    return g.withColumn("log2fc", F.log2((F.col("yes_norm") + eps) / (F.col("no_norm") + eps)))


def pair_kmer_top(fc: DataFrame, n: int = 50) -> DataFrame:
    """Strongest rises and falls per pair."""
    key = ["scope", "k", "kmer"]
    up = top_per_group(fc.where("log2fc > 0"), ["pair_id"], [F.desc("log2fc"), *key], n, out="rank").withColumn("direction", F.lit("up_in_yes"))
    down = top_per_group(fc.where("log2fc < 0"), ["pair_id"], [F.asc("log2fc"), *key], n, out="rank").withColumn("direction", F.lit("down_in_yes"))
    return up.unionByName(down)


def kmer_frequencies(catalog: DataFrame, ks=(1, 2, 3), scope: str = "all", seq: str = "sequence") -> DataFrame:
    """G14, long: occurrences over the sequence length, over 30 for head and tail."""
    k = kmers_long(catalog, ks, [scope], seq)
    if scope == "all":
        return k.join(catalog.select("seq_id", F.length(seq).alias("_n")), "seq_id").withColumn("freq", F.col("n") / F.col("_n")).drop("_n")
    return k.withColumn("freq", F.col("n") / 30.0)


def frequency_columns(catalog: DataFrame, words: list[str], seq: str = "sequence") -> DataFrame:
    """Freq_<kmer> columns for a given word list, counted inside the row."""
    ks = sorted({len(w) for w in words})
    d = catalog.withColumns({f"_w{k}": sq.windows(seq, k) for k in ks})
    return d.withColumns({f"Freq_{w}": ratio0(F.size(F.filter(F.col(f"_w{len(w)}"), _equals(w))), F.length(seq)) for w in words}).drop(*[f"_w{k}" for k in ks])


def _equals(w: str):
    return lambda x: x == w


def ranked_kmers(joint: DataFrame, locus: str, ks, n_all: int, n_locus: int, cap: int) -> DataFrame:
    """First n per k of the overall ranking, then of the locus ranking, without repeats, capped.

    ``joint``: group_type, group_value, feature, rank.
    """
    f = joint.withColumn("k", F.regexp_extract("feature", "^k([0-9]+)_", 1).try_cast("int")).where(F.col("k").isin(list(ks)))
    a = top_per_group(f.where(F.col("group_type") == "ALL"), ["k"], ["rank", "feature"], n_all).withColumn("_src", F.lit(0))
    b = top_per_group(f.where((F.col("group_type") == "locus") & (F.col("group_value") == locus)), ["k"], ["rank", "feature"], n_locus).withColumn("_src", F.lit(1))
    u = a.unionByName(b).groupBy("feature", "k").agg(F.min(F.struct("_src", "rank")).alias("_o"))
    return u.orderBy("_o", "feature").limit(cap).select("feature", "k", F.col("_o._src").alias("source"), F.col("_o.rank").alias("rank"))


def slice_by_k(df: DataFrame, k: int, keys=("seq_id",)) -> DataFrame:
    """The columns of one k."""
    return df.select(*keys, *[x for x in df.columns if re.match(rf"^k{k}_", x)])


def concat_blocks(blocks: list[DataFrame], key: str = "seq_id") -> DataFrame:
    """Blocks side by side; a repeated column name gets __dup<n>."""
    seen: dict[str, int] = {}
    out = None
    for b in blocks:
        names = {}
        for x in b.columns:
            if x == key:
                continue
            seen[x] = seen.get(x, 0) + 1
            names[x] = x if seen[x] == 1 else f"{x}__dup{seen[x] - 1}"
        b = b.select(key, *[F.col(x).alias(n) for x, n in names.items()])
        out = b if out is None else out.join(b, key)
    return out
