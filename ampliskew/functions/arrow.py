"""The few per-sequence values without a column expression, as Arrow-batched functions; NULL gives NULL."""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .words import Rolled


@F.pandas_udf(DoubleType())
def zlib_ratio(s: pd.Series) -> pd.Series:
    """deflated bytes per letter."""
    return s.map(lambda x: len(zlib.compress(x.encode())) / max(1, len(x)) if x is not None else None)


@F.pandas_udf(LongType())
def lz76(s: pd.Series) -> pd.Series:
    """components of the exhaustive history (Lempel-Ziv 1976); one letter alone counts 2.

    A component ends where its text no longer occurs in everything before its last letter.
    """

    return s.map(lambda x: None if x is None else lz76_count(x)).astype("Int64")


#: Letters from which on a suffix automaton, linear in the text, takes the place of searches, which are quadratic.
LONG_TEXT = 2000


def lz76_count(x: str) -> int:
    n = len(x)
    if n < 2:
        return 2 * n
    if n >= LONG_TEXT:
        return _lz76_automaton(x)
    parts, start = 0, 0
    for end in range(1, n + 1):
        if x.find(x[start:end], 0, end - 1) < 0:
            parts, start = parts + 1, end
    return parts + (start < n)


def _lz76_automaton(x: str) -> int:
    """The same count: the automaton holds all of x before its last letter, and ``at`` is the state of the open component.

    States are rows of one table of links, one column a letter of x.
    """
    letters = {c: i for i, c in enumerate(sorted(set(x)))}
    k = len(letters)
    links, length, suffix = array("i", [-1]) * (2 * len(x) * k + k), array("i", [0]) * (2 * len(x) + 1), array("i", [-1]) * (2 * len(x) + 1)
    states, last, parts, at, held = 1, 0, 0, 0, 0  # held: letters of the open component so far
    for i, c in enumerate(map(letters.__getitem__, x)):
        to = links[at * k + c]
        if to < 0:
            parts, at, held = parts + 1, 0, 0
        else:
            at, held = to, held + 1
        new, states = states, states + 1
        length[new] = i + 1
        p = last
        while p >= 0 and links[p * k + c] < 0:
            links[p * k + c] = new
            p = suffix[p]
        if p < 0:
            suffix[new] = 0
        else:
            q = links[p * k + c]
            if length[p] + 1 == length[q]:
                suffix[new] = q
            else:
                copy, states = states, states + 1
                length[copy], suffix[copy] = length[p] + 1, suffix[q]
                links[copy * k:copy * k + k] = links[q * k:q * k + k]
                while p >= 0 and links[p * k + c] == q:
                    links[p * k + c] = copy
                    p = suffix[p]
                suffix[q] = suffix[new] = copy
                if at == q and held <= length[copy]:
                    at = copy
        last = new
    return parts + (held > 0)


#: Sequences whose words are counted at once.
ROWS = 2000


def word_summaries(kmax: int):
    """struct of distinct_k, entropy_k, gini_k, top10cov_k for k = 1..kmax over words without N; zeros without words.

    Words of all sequences of a batch roll along as packed numbers and are sorted by (sequence, count) once a length.
    """
    names = ("distinct", "entropy", "gini", "top10cov")
    fields = [StructField(f"{f}_{k}", IntegerType() if f == "distinct" else DoubleType()) for k in range(1, kmax + 1) for f in names]

    def part(texts: pa.Array) -> dict[str, np.ndarray]:
        rolled, rows, out = Rolled(texts), len(texts), {}
        for k in range(1, kmax + 1):
            owner, _, n, odd = rolled.counted(k, "all")
            owner, n = np.append(owner, [o for o, _ in odd]).astype("i8"), np.append(n, list(odd.values())).astype("f8")
            order = np.lexsort((n, owner))
            owner, n = owner[order], n[order]
            distinct, total = np.bincount(owner, minlength=rows), np.bincount(owner, n, rows)
            rank = np.arange(len(n)) - (np.cumsum(distinct) - distinct)[owner] + 1
            share = n / total[owner]
            d, t = np.maximum(distinct, 1), np.maximum(total, 1)
            gini = 2.0 * np.bincount(owner, rank * n, rows) / (d * t) - (d + 1) / d
            top = np.bincount(owner, n * (rank > distinct[owner] - 10), rows) / t
            out |= {f"distinct_{k}": distinct, f"entropy_{k}": np.bincount(owner, -share * np.log2(share), rows) + 0.0, f"gini_{k}": np.where(distinct > 0, gini, 0.0), f"top10cov_{k}": top}
        return out

    @F.pandas_udf(StructType(fields))
    def summaries(s: pd.Series) -> pd.DataFrame:
        parts = [pd.DataFrame(part(pa.array(s.iloc[a:a + ROWS], pa.string(), from_pandas=True))) for a in range(0, max(len(s), 1), ROWS)]
        return pd.concat(parts, ignore_index=True).astype({f"distinct_{k}": "int32" for k in range(1, kmax + 1)})

    return summaries


@F.pandas_udf(DoubleType())
def dust(s: pd.Series) -> pd.Series:
    """densest 64-letter window by equal trimer pairs, per window letter; counts roll along the sequence."""
    return s.map(lambda x: None if x is None else dust_score(x))


def dust_score(x: str) -> float:
    n, win = len(x), min(64, len(x))
    if n < 3:
        return 0.0
    seen: dict[str, int] = {}
    pairs = best = 0
    for i in range(n - 2):
        gone = x[i - win + 2:i - win + 5] if i >= win - 2 else "N"
        if "N" not in gone:
            seen[gone] -= 1
            pairs -= seen[gone]
        new = x[i:i + 3]
        if "N" not in new:
            k = seen.get(new, 0)
            pairs += k
            seen[new] = k + 1
        best = max(best, pairs)
    return best / win


@F.pandas_udf(StructType([StructField(x, LongType()) for x in ("n6", "n8", "n10", "max_len")]))
def palindromes(s: pd.Series) -> pd.DataFrame:
    """reverse-complement palindromes around even centres; N pairs with N."""
    return pd.DataFrame([[None] * 4 if x is None else palindrome_counts(x) for x in s], columns=["n6", "n8", "n10", "max_len"]).astype("Int64")


def palindrome_counts(x: str) -> list[int]:
    """Radii in linear time (Manacher 1975)."""
    n, y = len(x), x.translate(str.maketrans("ACGT", "TGCA"))
    radius = np.zeros(n + 1, dtype=np.int64)   # radius[c]: half length around the gap before letter c
    centre = right = 0
    for i in range(1, n):
        r = min(radius[2 * centre - i], right - i) if i < right else 0
        while i - r > 0 and i + r < n and x[i - r - 1] == y[i + r]:
            r += 1
        radius[i] = r
        if i + r > right:
            centre, right = i, i + r
    return [int(np.maximum(radius - k, 0).sum()) for k in (2, 3, 4)] + [int(2 * radius.max())]


def tm_window_max(w: int, nn: dict, ends: tuple, salt: float, strand: float):
    """largest nearest-neighbour temperature over w-letter windows, N left out inside each window.

    ``nn`` holds (dH, dS) of all 16 steps, ``ends`` those of terminal A/T and G/C. Sums over a window are differences
    of running sums along the N-free letters.
    """
    table = np.rint(10 * np.array([[nn[a + b] for b in "ACGT"] for a in "ACGT"])).astype("i8")  # tenths, so that sums are exact
    end = np.array([ends[0], ends[1], ends[1], ends[0]])

    def part(texts):
        x = Letters(texts)
        k = np.minimum(w, x.size)
        known = x.base < 4
        z = x.base[known]
        steps = np.concatenate([np.zeros((1, 2), "i8"), np.cumsum(table[z[:-1], z[1:]], axis=0)])
        cum = np.append(0, np.cumsum(known))
        at = np.flatnonzero(x.left >= k[x.owner])
        own = x.owner[at]
        lo, hi = cum[at], cum[at + k[own]] - 1
        full = hi >= lo
        lo, hi, own = lo[full], hi[full], own[full]
        h, t = ((steps[hi] - steps[lo]) / 10 + end[z[lo]] + end[z[hi]]).T
        value = 1000 * h / (t + salt * (hi - lo) + strand) - 273.15
        best = np.full(len(texts), -np.inf)
        if len(own):
            new = np.flatnonzero(np.append(True, np.diff(own) != 0))
            best[own[new]] = np.maximum.reduceat(value, new)
        gaps = np.bincount(own, minlength=len(texts)) < np.maximum(x.size - k + 1, 1)  # windows without a letter, or no window
        return np.where((x.size > 0) & ~gaps, best, np.maximum(best, 0.0))

    @F.pandas_udf(DoubleType())
    def tm(s: pd.Series) -> pd.Series:
        there = s.notna()
        texts = [x if ok else "" for x, ok in zip(s, there)]
        return pd.Series(np.concatenate([np.zeros(0), *(part(texts[a:z]) for a, z in cut_up(texts))])).where(there.to_numpy())

    return tm


BITS = np.zeros(128, dtype=np.uint8)   # base sets as bits: A=1, C=2, G=4, T=8
for _code, _bases in {"A": 1, "C": 2, "G": 4, "T": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11,
                      "V": 7, "N": 15}.items():
    BITS[ord(_code)] = _bases


def _sites(s: pd.Series, primers: pd.Series, lo=None, hi=None) -> tuple[np.ndarray, np.ndarray]:
    """Fewest mismatches of each row's IUPAC primer and their leftmost start in lo..hi; -1, -1 without a place for it.

    All sequences of a batch with the same primer are one array of base sets, and a primer letter is compared with all
    starts at once. Letters other than A, C, G, T in a sequence mismatch every primer letter.
    """
    mm, pos = np.full(len(s), -1, "i4"), np.full(len(s), -1, "i4")
    size = np.asarray([len(x) if x is not None else 0 for x in s], "i8")
    for p in primers.dropna().unique():
        m = len(p)
        rows = np.flatnonzero((primers == p).to_numpy(bool) & (size >= max(m, 1)) & s.notna().to_numpy()) if m else np.zeros(0, "i8")
        if not len(rows):
            continue
        n = size[rows]
        bits = BITS[np.frombuffer("".join(s.iloc[rows]).encode("ascii", "replace"), "u1") & 127]
        bits[(bits & (bits - 1)) != 0] = 0
        bits = np.append(bits, np.zeros(m, "u1"))
        misses = np.zeros(len(bits) - m, "i8")
        for j, x in enumerate(BITS[np.frombuffer(p.encode(), "u1")]):
            misses += (bits[j:j + len(misses)] & x) == 0
        first = np.cumsum(n) - n
        start = np.arange(len(misses)) - np.repeat(first, n)
        fits = start + m <= np.repeat(n, n)
        if lo is not None:
            fits &= (start >= np.repeat(lo.to_numpy("i8")[rows], n)) & (start <= np.repeat(hi.to_numpy("i8")[rows], n))
        best = np.minimum.reduceat(np.where(fits, misses << 32 | start, NONE), first)
        found = best < NONE
        mm[rows[found]], pos[rows[found]] = best[found] >> 32, best[found] & 0xFFFFFFFF
    return mm, pos


NONE = 1 << 62


@F.pandas_udf(StructType([StructField(x, IntegerType()) for x in ("mm", "pos", "end_mm", "end_pos")]))
def primer_sites(s: pd.Series, primer: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
    """the best site anywhere and the best one that starts in lo..hi; (primer length, -1) if the sequence is too short, null for a null."""
    out = {}
    short, there = np.asarray([len(x) if x is not None else 0 for x in primer], "i4"), s.notna() & primer.notna()
    for a, b, bounds in (("mm", "pos", ()), ("end_mm", "end_pos", (lo.fillna(0), hi.fillna(0)))):
        mm, pos = _sites(s, primer, *bounds)
        out[a], out[b] = pd.Series(np.where(pos < 0, short, mm)).where(there, None).astype("Int32"), pd.Series(pos).where(there, None).astype("Int32")
    return pd.DataFrame(out)


@F.pandas_udf(StructType([StructField("mm", IntegerType()), StructField("pos", IntegerType())]))
def _best_site(s: pd.Series, primer: pd.Series) -> pd.DataFrame:
    mm, pos = _sites(s, primer)
    return pd.DataFrame({"mm": pd.Series(mm).where(pos >= 0).astype("Int32"), "pos": pd.Series(pos).where(pos >= 0).astype("Int32")})


# Fewest mismatches and their leftmost 0-based start. Not inlined into later filters, so it runs once per row.
best_site = _best_site.asNondeterministic()


#: Letters that are scanned for zones together.
ZONE_LETTERS = 1 << 19


def _zones(texts: list[bytes], motifs, windows, thresholds):
    """(motif, window, threshold, sequence numbers, starts, ends) of the merged windows of all ``texts``, scanned at once.

    Letters are cumulated over the texts, windows that cross into the next text are left out, and a zone starts at a hit
    of another text or more than a window after the last hit.
    """
    size = np.asarray([len(x) for x in texts], "i8")
    data = np.frombuffer(b"".join(texts), "u1")
    owner, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    left = np.repeat(first + size, size) - np.arange(len(data))  # letters from here to the text's end
    for m, letters in enumerate(motifs):
        cum = np.append(0, np.cumsum(np.isin(data, [ord(x) for x in letters])))
        for w in windows:
            if len(data) < w:
                continue
            n = np.where(left[:len(data) - w + 1] >= w, cum[w:] - cum[:-w], -1)
            for t, share in enumerate(thresholds):
                hit = np.flatnonzero(n >= w * share)
                if len(hit) == 0:
                    break
                own = owner[hit]
                at = np.flatnonzero(np.append(True, (np.diff(hit) > w) | (own[1:] != own[:-1])))
                begin, end, own = hit[at], hit[np.append(at[1:], len(hit)) - 1], own[at]
                yield m, w, t, own, begin - first[own] + 1, end - first[own] + w


def zones(motifs, windows, thresholds):
    """array of (motif, window, threshold, start, end) for merged windows rich in the letters of a motif."""
    fields = [StructField(x, IntegerType()) for x in ("motif", "window", "threshold", "start", "end")]

    @F.pandas_udf(ArrayType(StructType(fields)))
    def scan(s: pd.Series) -> pd.Series:
        out = [None if x is None else [] for x in s]
        for m, w, t, own, start, end in _zones([(x or "").encode("ascii", "replace") for x in s], motifs, windows, thresholds):
            for i, a, b in zip(own.tolist(), start.tolist(), end.tolist()):
                out[i].append((m, w, t, a, b))
        return pd.Series(out, dtype=object)

    return scan


def zone_rows(motifs, windows, thresholds, summed: bool = False):
    """batches of (seq_id, sequence) to rows (seq_id, motif, window, threshold, start, end), see ``zones``.

    ``summed``: num_zones and total_length (both long) of each sequence in place of start and end.
    """
    names = ["seq_id", "motif", "window", "threshold", *(("num_zones", "total_length") if summed else ("start", "end"))]

    def run(batches):
        for b in batches:
            texts = [(x or "").encode("ascii", "replace") for x in b.column(1).to_pylist()]
            part = np.cumsum([len(x) for x in texts]) // ZONE_LETTERS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
            for a, e in zip(cuts, cuts[1:]):
                for m, w, t, own, start, end in _zones(texts[a:e], motifs, windows, thresholds):
                    values = [start.astype("i4"), end.astype("i4")]
                    if summed:
                        at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                        values = [np.diff(np.append(at, len(own))), np.add.reduceat(end - start + 1, at)]
                        own = own[at]
                    same = (pa.array(np.full(len(own), v, "i4")) for v in (m, w, t))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own + a)), *same, *map(pa.array, values)], names)

    return run


#: Letters whose scans run together, and letters from which on a text's palindromes and trimers are scanned alone, in linear time.
SCAN_LETTERS, LONG_SCAN = 1 << 20, 2000
#: Counts of trimers that texts side by side may take; more, with many letters, are counted text by text.
DUST_COUNTS = 1 << 25
_BASES, _PAIRED = np.frombuffer(b"ACGT", "u1").astype("u4"), np.frombuffer(b"TGCA", "u1").astype("u4")
#: What ends a line to a pattern's dot.
_LINE_ENDS = np.asarray([10, 13, 0x85, 0x2028, 0x2029], "u4")


def cut_up(texts: list[str]) -> list[tuple[int, int]]:
    """Ranges of about SCAN_LETTERS letters of ``texts``, one at least."""
    part = np.cumsum([len(x) for x in texts], dtype="i8") // SCAN_LETTERS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return list(zip(cuts, cuts[1:]))


class Letters:
    """All letters of some texts in a row: codes, number of their text, place in it, and letters from there to its end."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.size = np.asarray([len(x) for x in texts], "i8")
        self.first = np.cumsum(self.size) - self.size
        self.owner = np.repeat(np.arange(len(texts)), self.size)
        self.at = np.arange(len(self.code)) - self.first[self.owner]
        self.left = self.size[self.owner] - self.at
        self.base = np.full(len(self.code), 4, "i8")  # 4: not A, C, G or T
        for i, x in enumerate(_BASES):
            self.base[self.code == x] = i

    def most(self, values: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Largest of ``values`` in each text (0 at least), which belong to the letters ``where``."""
        out = np.zeros(len(self.size), "i8")
        if len(values):
            new = np.flatnonzero(np.append(True, np.diff(self.owner[where]) != 0))
            out[self.owner[where][new]] = np.maximum.reduceat(values, new)
        return out

    def longest(self, flag: np.ndarray) -> np.ndarray:
        """Longest run of true flags in each text; a flag is false where it would reach into the next text."""
        start = np.flatnonzero(flag & ~np.append(False, flag[:-1] & (self.owner[1:] == self.owner[:-1])))
        stop = np.flatnonzero(flag & ~np.append(flag[1:] & (self.owner[1:] == self.owner[:-1]), False))
        return self.most(stop - start + 1, start)

    def same(self, distance: int) -> np.ndarray:
        """Whether the letter ``distance`` further on in the same text is the same."""
        out = np.zeros(len(self.code), bool)
        if len(out) > distance:
            out[:-distance] = (self.code[distance:] == self.code[:-distance]) & (self.left[:-distance] > distance)
        return out


def _tandems(x: Letters, unit: int) -> np.ndarray:
    return np.maximum(1, (x.longest(x.same(unit) & (x.code != ord("N"))) + unit) // unit)


def _tandem_density(x: Letters) -> np.ndarray:
    ends, n = np.zeros(len(x.code) + 1, "i8"), len(x.code)
    for unit, times in ((3, 3), (2, 3), (1, 4)):
        need, flag = unit * (times - 1), x.same(unit) & ((x.code != ord("N")) if unit > 1 else ~np.isin(x.code, _LINE_ENDS))
        cum = np.append(0, np.cumsum(flag))
        hit = np.flatnonzero(cum[need:] - cum[:len(cum) - need] == need) if n >= need else np.zeros(0, "i8")
        ends += np.bincount(hit, minlength=n + 1) - np.bincount(hit + unit * times, minlength=n + 1)[:n + 1]
    covered = np.bincount(x.owner, np.cumsum(ends)[:n] > 0, len(x.size))
    return covered / np.maximum(x.size, 1)


def _end_complement(x: Letters, w: int = 30) -> np.ndarray:
    head = np.flatnonzero(x.at < w)
    a, b = x.code[head], x.code[x.first[x.owner[head]] + x.left[head] - 1]
    paired = b.copy()
    for letter, other in zip(_BASES, _PAIRED):
        paired[b == letter] = other
    both = (a != ord("N")) & (paired != ord("N"))
    n = np.bincount(x.owner[head], both, len(x.size))
    return np.bincount(x.owner[head], both & (a == paired), len(x.size)) / np.maximum(n, 1)


def _alternating(x: Letters) -> np.ndarray:
    side = np.where(np.isin(x.code, [ord(c) for c in "AGR"]), 1, np.where(np.isin(x.code, [ord(c) for c in "CTY"]), 2, 0))
    flag = np.zeros(len(side), bool)
    flag[:-1] = (side[1:] + side[:-1] == 3) & (side[1:] * side[:-1] == 2) & (x.left[:-1] > 1)
    run = x.longest(flag)
    return np.where(run > 0, run + 1, np.bincount(x.owner, x.base < 4, len(x.size)) > 0)


def _runs(x: Letters) -> dict[str, np.ndarray]:
    start = np.flatnonzero(np.append(True, (x.code[1:] != x.code[:-1]) | (x.owner[1:] != x.owner[:-1]))[:len(x.code)])
    size = np.diff(np.append(start, len(x.code)))
    known = (x.base[start] < 4) | (x.code[start] == ord("N"))
    start, size = start[known], size[known]
    out = {"run_max": x.most(size, start), "n_runs": np.bincount(x.owner[start], minlength=len(x.size))}
    for i, c in enumerate("ACGT"):
        on = x.base[start] == i
        out[f"run{c}_max"] = x.most(size[on], start[on])
    return out | {f"run_ge{k}": np.bincount(x.owner[start], size >= k, len(x.size)) for k in (4, 5, 6)}


def _palindrome_radii(x: Letters) -> np.ndarray:
    """Half length of the longest palindrome around the gap before each letter, all gaps widened together."""
    paired = x.code.copy()
    for letter, other in zip(_BASES, _PAIRED):
        paired[x.code == letter] = other
    radius, open_, r = np.zeros(len(x.code), "i8"), np.flatnonzero(x.at > 0), 0
    while len(open_):
        open_ = open_[(x.at[open_] > r) & (x.left[open_] > r)]
        open_ = open_[x.code[open_ - r - 1] == paired[open_ + r]]
        r += 1
        radius[open_] = r
    return radius


def _palindromes(x: Letters) -> dict[str, np.ndarray]:
    radius = _palindrome_radii(x)
    sums = {name: np.bincount(x.owner, np.maximum(radius - k, 0), len(x.size)) for name, k in (("pal_n6", 2), ("pal_n8", 3), ("pal_n10", 4))}
    return sums | {"pal_max_len": 2 * x.most(radius, np.arange(len(radius)))}


def _dust(x: Letters) -> np.ndarray:
    """All texts roll their window along side by side, longest first, each with its own counts of trimers."""
    by = np.argsort(-x.size, kind="stable")
    size, first = x.size[by], x.first[by]
    win = np.minimum(64, size)
    known = x.code != ord("N")
    letter = np.unique(x.code, return_inverse=True)[1]
    k = int(letter.max(initial=0)) + 1
    word, whole = np.zeros(len(letter), "i8"), np.zeros(len(letter), bool)
    word[:-2] = (letter[:-2] * k + letter[1:-1]) * k + letter[2:]
    whole[:-2] = known[:-2] & known[1:-1] & known[2:]
    word = np.unique(word, return_inverse=True)[1]
    width = int(word.max(initial=0)) + 1
    if len(size) * width > DUST_COUNTS:
        return np.asarray([dust_score(t) for t in x.texts])
    seen, pairs, best = np.zeros(len(size) * width, "i4"), np.zeros(len(size), "i8"), np.zeros(len(size), "i8")
    for i in range(int(size.max(initial=0)) - 2):
        m = int(np.searchsorted(-size, -(i + 2)))  # texts with a trimer here
        rows, out = np.arange(m), i - win[:m] + 2
        gone = rows[out >= 0]
        old = first[gone] + out[gone]
        gone, old = gone[whole[old]], old[whole[old]]
        place = gone * width + word[old]
        seen[place] -= 1
        pairs[gone] -= seen[place]
        new = first[:m] + i
        come = rows[whole[new]]
        place = come * width + word[new[come]]
        pairs[come] += seen[place]
        seen[place] += 1
        np.maximum(best[:m], pairs[:m], out=best[:m])
    scores = np.zeros(len(size))
    scores[by] = np.where(size >= 3, best / np.maximum(win, 1), 0.0)
    return scores


def _gc_windows(x: Letters, w: int = 20) -> np.ndarray:
    """Largest share of G and C in a window, or that of a shorter text."""
    gc = (x.base == 1) | (x.base == 2)
    cum = np.append(0, np.cumsum(gc))
    at = np.flatnonzero(x.left >= w)
    short = np.bincount(x.owner, gc, len(x.size)) / np.maximum(x.size, 1)
    return np.where(x.size < w, short, x.most(cum[at + w] - cum[at], at) / w)


#: Scans of all texts of a batch at once: fields, their types, what a null gives (the value, or null) and the function.
_INT, _DOUBLE = IntegerType(), DoubleType()
SCANS = {
    "direp": ({"direp": _INT}, {"direp": 1}, lambda x: {"direp": _tandems(x, 2)}),
    "trirep": ({"trirep": _INT}, {"trirep": 1}, lambda x: {"trirep": _tandems(x, 3)}),
    "tandem_density": ({"tandem_density": _DOUBLE}, {"tandem_density": 0.0}, lambda x: {"tandem_density": _tandem_density(x)}),
    "end_complement": ({"end_complement": _DOUBLE}, {"end_complement": 0.0}, lambda x: {"end_complement": _end_complement(x)}),
    "alternating": ({"alternating": _INT}, {}, lambda x: {"alternating": _alternating(x)}),
    "gc_w20": ({"gc_w20": _DOUBLE}, {}, lambda x: {"gc_w20": _gc_windows(x)}),
    "runs": ({f: _INT for f in ("run_max", "n_runs", "runA_max", "runC_max", "runG_max", "runT_max", "run_ge4", "run_ge5", "run_ge6")},
             {f: 0 for f in ("run_max", "runA_max", "runC_max", "runG_max", "runT_max")}, _runs),
    "palindromes": ({f"pal_{f}": LongType() for f in ("n6", "n8", "n10", "max_len")}, {}, _palindromes),
    "dust": ({"dust": _DOUBLE}, {}, lambda x: {"dust": _dust(x)}),
}


def _alone(x: str, names) -> dict:
    """Palindromes and trimers of a long text."""
    out = {}
    if "dust" in names:
        out["dust"] = dust_score(x)
    if "palindromes" in names:
        out |= dict(zip(("pal_n6", "pal_n8", "pal_n10", "pal_max_len"), palindrome_counts(x)))
    return out


@lru_cache
def scans(*names: str):
    """Struct of the fields of the SCANS ``names``, for all letters of a batch at once."""
    fields = {f: t for n in names for f, t in SCANS[n][0].items()}
    nulls = {f: v for n in names for f, v in SCANS[n][1].items()}

    def part(texts: list[str]) -> dict[str, np.ndarray]:
        letters, out = Letters(texts), {}
        apart = [i for i, x in enumerate(texts) if len(x) >= LONG_SCAN] if {"dust", "palindromes"} & set(names) else []
        short = Letters(["" if len(x) >= LONG_SCAN else x for x in texts]) if apart else letters
        for n in names:
            out |= SCANS[n][2](short if n in ("dust", "palindromes") else letters)
        for i in apart:
            for f, v in _alone(texts[i], names).items():
                out[f][i] = v
        return out

    @F.pandas_udf(StructType([StructField(f, t) for f, t in fields.items()]))
    def scan(s: pd.Series) -> pd.DataFrame:
        there = s.notna().to_numpy()
        texts = [x if ok else "" for x, ok in zip(s, there)]
        parts = [part(texts[a:z]) for a, z in cut_up(texts)]
        out = {}
        for f, t in fields.items():
            v = pd.Series(np.concatenate([np.asarray(p[f]) for p in parts]))
            v = v.astype({IntegerType: "Int32", LongType: "Int64"}.get(type(t), "float64"))
            out[f] = v.where(there, nulls.get(f, np.nan if type(t) is DoubleType else pd.NA))
        return pd.DataFrame(out)

    return scan
