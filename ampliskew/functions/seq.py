"""Column expressions over DNA strings; all but ``tm_window_max`` stay in the JVM. Sequences are upper-case ACGTN. ``arrow.scans`` gives many of them faster, a batch at a time.

``s`` is always a Column (or column name) holding the sequence; use ``clean`` first on raw input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow
from .cols import c, ratio0

# IUPAC codes as base sets, and their complements.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
         "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
CODES = "ACGTRYSWKMBDHVN"
COMPLEMENTS = "TGCAYRSWMKVHDBN"

# Unified nearest-neighbour table (SantaLucia 1998), dH kcal/mol and dS cal/(mol K).
NN = {"AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4),
      "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9)}
NN_END_AT = (2.3, 4.1)
NN_END_GC = (0.1, -2.8)
SODIUM_MM, STRAND_NM = 50.0, 250.0


def clean(s) -> Column:
    return F.translate(F.upper(c(s)), "U", "T")


def revcomp(s) -> Column:
    """IUPAC-aware reverse complement."""
    return F.reverse(F.translate(F.upper(c(s)), CODES, COMPLEMENTS))


def revcomp_text(s: str) -> str:
    return s.upper().translate(str.maketrans(CODES, COMPLEMENTS))[::-1]


def iupac_regex(primer: str) -> str:
    """Primer as a pattern; N in a sequence never matches."""
    return "".join(IUPAC[x] if len(IUPAC[x]) == 1 else f"[{IUPAC[x]}]" for x in primer.upper())


def n_of(s, letters: str) -> Column:
    """How many positions hold one of ``letters``."""
    one = [F.length(c(s)) - F.length(F.replace(c(s), F.lit(x), F.lit(""))) for x in letters]
    return sum(one[1:], one[0])


def n_pair(s, pair: str) -> Column:
    """Overlapping count of a two-letter word with different letters (a word that cannot overlap itself)."""
    return ((F.length(c(s)) - F.length(F.replace(c(s), F.lit(pair), F.lit("")))) / 2).cast("int")


def dinucleotide_counts(s) -> dict[str, Column]:
    """the 16 overlapping counts; XX follows from the count of X minus every other successor of X."""
    s = c(s)
    out = {a + b: n_pair(s, a + b) for a in "ACGT" for b in "ACGT" if a != b}
    for a in "ACGT":
        others = [out[a + b] for b in "ACGT" if b != a] + [n_pair(s, a + "N"), F.endswith(s, F.lit(a)).cast("int")]
        out[a + a] = n_of(s, a) - sum(others[1:], others[0])
    return out


def sub(s, start, length) -> Column:
    """substring with column or int arguments, 1-based."""
    as_col = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.substring(c(s), as_col(start), as_col(length))


def head(s, w: int = 30) -> Column:
    return F.substring(c(s), 1, w)


def tail(s, w: int = 30) -> Column:
    return F.right(c(s), F.lit(w))


def gc_share(s) -> Column:
    return ratio0(n_of(s, "GC"), F.length(c(s)))


def skew(s, a: str, b: str) -> Column:
    """(a - b) / (a + b), 0 when neither occurs."""
    return ratio0(n_of(s, a) - n_of(s, b), n_of(s, a + b))


def _plogp(k: Column, n: Column) -> Column:
    p = k / n
    return F.when(k > 0, -p * F.log2(p)).otherwise(0.0)


def base_entropy(s, over: str = "acgt") -> Column:
    """entropy (log2) of A, C, G, T over their own total (``acgt``) or the full length (``length``)."""
    n = F.length(c(s)) if over == "length" else n_of(s, "ACGT")
    return F.when(n > 0, sum((_plogp(n_of(s, b), n) for b in "ACGT"), F.lit(0.0))).otherwise(0.0)


def symbol_entropy(s) -> Column:
    """entropy of all symbols A, C, G, T, N, four decimals."""
    n = F.length(c(s))
    return F.when(n > 0, F.round(sum((_plogp(n_of(s, b), n) for b in "ACGTN"), F.lit(0.0)), 4)).otherwise(0.0)


def runs(s) -> Column:
    """Maximal runs of one letter, in order."""
    return F.regexp_extract_all(c(s), F.lit("(A+|C+|G+|T+|N+)"), F.lit(0))


def longest(words: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(words, lambda x: F.length(x))), F.lit(0))


def n_at_least(words: Column, k: int) -> Column:
    return F.size(F.filter(words, lambda x: F.length(x) >= k))


def flags(s, k: int, test) -> Column:
    """Text of 0/1: whether ``test`` holds for the k letters from each position on."""
    return F.array_join(F.transform(windows(s, k), lambda x: F.when(test(x), "1").otherwise("0")), "")


def longest_flags(text: Column) -> Column:
    return longest(F.regexp_extract_all(text, F.lit("1+"), F.lit(0)))


def max_tandem(s, unit: int) -> Column:
    """most repeats of one N-free unit in a row, at least 1: r equal letters at distance ``unit`` span r + unit."""
    eq = lambda x: (F.substring(x, 1, 1) == F.right(x, F.lit(1))) & (F.substring(x, 1, 1) != "N")
    return F.greatest(F.lit(1), F.floor((longest_flags(flags(s, unit + 1, eq)) + unit) / unit)).cast("int")


def tandem_density(s) -> Column:
    """share of positions inside runs >= 4 or 2-/3-letter repeats >= 3, which is the union of their shortest forms."""
    s = c(s)
    n = F.length(s)
    shapes = F.regexp_extract_all(s, F.lit("(?=(([^N]{3})\\2{2}|([^N]{2})\\3{2}|(.)\\4{3}|))"), F.lit(1))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("to"), F.lit(0).alias("n"))

    def step(acc, x):
        to = F.greatest(acc["to"], acc["i"] + F.length(x))
        return F.struct((acc["i"] + 1).alias("i"), to.alias("to"), (acc["n"] + (to > acc["i"]).cast("int")).alias("n"))

    return F.when(n > 0, F.aggregate(F.slice(shapes, F.lit(1), n), zero, step, lambda acc: acc["n"]) / n).otherwise(0.0)


def end_complement(s, w: int = 30) -> Column:
    """share of positions where the head equals the reverse complement of the tail, over A/C/G/T pairs."""
    h, t = head(s, w), F.reverse(F.translate(tail(s, w), "ACGT", "TGCA"))
    idx = F.when(F.length(h) > 0, F.sequence(F.lit(1), F.length(h))).otherwise(F.array().cast("array<int>"))
    both = F.filter(idx, lambda i: (F.substring(h, i, F.lit(1)) != "N") & (F.substring(t, i, F.lit(1)) != "N"))
    eq = F.filter(both, lambda i: F.substring(h, i, F.lit(1)) == F.substring(t, i, F.lit(1)))
    return ratio0(F.size(eq), F.size(both))


def g4_count(s) -> Column:
    """F16: non-overlapping quadruplex motifs with loops of 1-7 letters."""
    return F.regexp_count(c(s), F.lit("(G{3,}[ACGTN]{1,7}){3}G{3,}"))


def quadruplex_open(s, base: str) -> Column:
    """F16: the older open form with three or more loops; base C gives the i-motif."""
    return F.regexp_count(c(s), F.lit("(%s{3,}\\w{1,7}){3,}%s{3,}" % (base, base)))


def alternating_max(s) -> Column:
    """longest alternating purine/pyrimidine stretch; other letters break it."""
    ry = F.translate(c(s), "AGCT", "RRYY")
    r = longest_flags(flags(ry, 2, lambda x: x.isin("RY", "YR")))
    return F.when(r > 0, r + 1).otherwise((n_of(s, "ACGT") > 0).cast("int"))


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``; inside a lambda a plain expression would be evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


PIECE = 256


def windows(s, k) -> Column:
    """All substrings of length k (int or Column).

    A substring call walks the text from its start, so long texts are first cut into overlapping pieces: n windows
    then cost n * PIECE steps instead of n * n.
    """
    s = c(s)
    k = F.lit(k) if isinstance(k, int) else k
    n = F.length(s)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((n - k) / PIECE).cast("int")), lambda b: F.substring(s, b * PIECE + 1, k + (PIECE - 1)))
    small = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - k + 1), lambda i: F.substring(x, i, k))
    return F.when(n >= k, F.flatten(F.transform(pieces, small))).otherwise(F.array().cast("array<string>"))


def letters(s) -> Column:
    return windows(s, 1)


def kmers(s, k: int) -> Column:
    """Substrings of length k without N."""
    return F.filter(windows(s, k), lambda x: ~F.contains(x, F.lit("N")))


def word_counts(words: Column) -> Column:
    """Ascending occurrence counts of the distinct words: sort, mark where the word changes, difference the marks."""
    none = F.array().cast("array<int>")

    def count(o):
        marks = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: (i == 0) | (F.get(o, i) != F.get(o, i - 1)))
        gaps = lambda f: F.transform(f, lambda x, i: F.coalesce(F.get(f, i + 1), F.size(o)) - x)
        return F.when(F.size(o) > 0, F.array_sort(let(marks, gaps))).otherwise(none)

    return let(F.array_sort(words), count)


def count_summary(counts: Column) -> Column:
    """struct(distinct, entropy, gini, top10cov) of ascending counts."""
    add = lambda a, x: a + x

    def summary(cs, total):
        n = F.size(cs)
        ent = F.aggregate(cs, F.lit(0.0), lambda a, x: a - (x / total) * F.log2(x / total))
        rank = F.aggregate(F.transform(cs, lambda x, i: (i + 1) * x), F.lit(0), add)
        top = F.aggregate(F.slice(cs, F.greatest(n - 9, F.lit(1)), F.lit(10)), F.lit(0), add)
        return F.struct(n.alias("distinct"), ent.alias("entropy"), F.coalesce(2.0 * rank / (n * total) - (n + 1) / n, F.lit(0.0)).alias("gini"),
                        F.coalesce(top / total, F.lit(0.0)).alias("top10cov"))

    return let(counts, lambda cs: let(F.nullif(F.aggregate(cs, F.lit(0), add), F.lit(0)), lambda t: summary(cs, t)))


def tm_wallace(s) -> Column:
    """2(A+T) + 4(G+C)."""
    return (2 * n_of(s, "AT") + 4 * n_of(s, "GC")).cast("double")


def tm_nn(s) -> Column:
    """nearest-neighbour melting temperature; dH and dS are linear in the dinucleotide counts. N is left out."""
    comp = {"A": "T", "T": "A", "C": "G", "G": "C"}

    def tm(x):
        d = dinucleotide_counts(x)
        n = F.length(x)

        def total(i):
            t = F.lit(0.0)
            for pair, v in NN.items():
                twin = comp[pair[1]] + comp[pair[0]]
                k = d[pair] if twin == pair else d[pair] + d[twin]
                t = t + k * F.lit(v[i])
            for end in (F.substring(x, 1, 1), F.right(x, F.lit(1))):
                t = t + F.when(end.isin("A", "T"), NN_END_AT[i]).otherwise(NN_END_GC[i])
            return t

        ds = total(1) + F.lit(0.368 * math.log(SODIUM_MM / 1000)) * (n - 1)
        value = total(0) * 1000 / (ds + F.lit(1.987 * math.log(STRAND_NM * 1e-9))) - 273.15
        return F.when(n > 0, value).otherwise(0.0)

    return let(F.replace(c(s), F.lit("N"), F.lit("")), tm)


def tm_window_max(s, w: int) -> Column:
    """largest nearest-neighbour temperature over windows of length w (running sums, so an Arrow function)."""
    comp = {"A": "T", "T": "A", "C": "G", "G": "C"}
    nn = dict(NN)
    nn.update({comp[b] + comp[a]: v for (a, b), v in NN.items()})
    return arrow.tm_window_max(w, nn, (NN_END_AT, NN_END_GC), 0.368 * math.log(SODIUM_MM / 1000), 1.987 * math.log(STRAND_NM * 1e-9))(c(s))


def window_max(s, w: int, f) -> Column:
    """largest value of ``f`` over windows of length w, ``f`` of the whole sequence when it is shorter."""
    return F.when(F.length(c(s)) < w, f(c(s))).otherwise(F.array_max(F.transform(windows(s, w), f)))


def local_window(s, pos: Column, length: int, win: int = 60) -> Column:
    """``win`` letters around the middle of a primer site at 0-based ``pos``, shifted inward at the ends."""
    n = F.length(c(s))
    end = F.least(n, F.greatest(F.lit(0), pos + length // 2 - win // 2) + win)
    start = F.greatest(F.lit(0), end - win)
    return F.when(pos < 0, "").otherwise(F.substring(c(s), start + 1, end - start))


def structure_stats(db) -> Column:
    """paired share, longest paired run, longest loop and hairpins of a dot-bracket string."""
    s = F.coalesce(c(db), F.lit(""))
    words = lambda p: F.regexp_extract_all(s, F.lit(p), F.lit(0))
    return F.struct(ratio0(n_of(s, "()"), F.length(s)).alias("pair_frac"), longest(words("[()]+")).alias("stem_max"),
                    longest(words("[.]+")).alias("loop_max"), F.regexp_count(s, F.lit("\\([.]+\\)")).alias("hairpin_count"))


def regions_even_sizes(s, w: int = 30, bins: int = 3):
    """head, tail and a middle whose first parts take the remainder; empty parts when the middle is empty."""
    s = c(s)
    n = F.length(s)
    m = F.greatest(n - 2 * w, F.lit(0))
    base, rem = F.floor(m / bins).cast("int"), (m % bins).cast("int")
    start = lambda b: F.lit(w + 1) + base * b + F.least(rem, F.lit(b))
    mids = [F.substring(s, start(b), base + (F.lit(b) < rem).cast("int")) for b in range(bins)]
    return [head(s, w), *mids, tail(s, w)]


def regions_floor(s, w: int = 30, bins: int = 3):
    """middle parts cut at floor(b * m / bins)."""
    s = c(s)
    m = F.greatest(F.length(s) - 2 * w, F.lit(0))
    cut = lambda b: F.floor(m * b / bins).cast("int")
    return [head(s, w), *[F.substring(s, cut(b) + (w + 1), cut(b + 1) - cut(b)) for b in range(bins)], tail(s, w)]


def encode_tokens(s, length: int, codes: str = "ACGT", first: int = 1, other: int = 5, pad: int = 0) -> Column:
    """int codes per position, cut or padded to ``length``."""
    s = F.substring(F.upper(c(s)), 1, length)

    def one(x):
        out = F.lit(other)
        for i, b in enumerate(codes):
            out = F.when(x == b, first + i).otherwise(out)
        return out

    return let(F.transform(letters(s), one), lambda body: F.concat(body, F.array_repeat(F.lit(pad), F.lit(length) - F.size(body))))


def one_hot(s, length: int) -> Column:
    """four rows A, C, G, T of 0/1 per position."""
    tok = encode_tokens(s, length)
    return F.array(*[F.transform(tok, lambda x: (x == b).cast("int")) for b in (1, 2, 3, 4)])
