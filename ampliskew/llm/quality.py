"""Op 3: an isolation forest on rule statistics, its threshold calibrated from labelled rows."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import col, fresh, slices, written

BLANKS = "\t\n\x0b\x0c\r "
TO_BLANK = str.maketrans(BLANKS, " " * len(BLANKS))
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def rule_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null has no words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = [w for w in text.translate(TO_BLANK).split(" ") if w]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, covered = Counter(windows), -1  # covered: last word counted
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def with_statistics(docs: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """``docs`` with the five statistics under ``names``; nothing is shuffled."""
    text = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # mapInArrow takes no names with dots
    wide = StructType([*plain.schema.fields, *(StructField(f"s{i}", LongType()) for i in range(len(names)))])

    def run(batches):
        for whole in batches:
            for b in slices(whole, text):
                got = np.asarray([rule_statistics(t) for t in b.column(text).to_pylist()], "i8").reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in got.T.copy())], wide.names)

    return plain.mapInArrow(run, wide).toDF(*docs.columns, *names)


def shares(stats: np.ndarray) -> np.ndarray:
    """Length-free features: letters a word and symbols a word; repetition is for the base rules."""
    n = np.maximum(stats[:, 0], 1).astype("f8")
    return np.stack([stats[:, 1] / n, np.log1p(20 * stats[:, 2] / n)], 1)


def mean_path(n: int) -> float:
    """Mean path of an unsuccessful search in a random tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    """Trees in flat arrays: feature (-1: leaf), cut, left child (the right one follows), path length of a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    size: int

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int = 100, subsample: int = 256, seed: int = 42) -> IsolationForest:
        rng = np.random.default_rng(seed)
        size = min(subsample, len(rows))
        depth = math.ceil(math.log2(max(size, 2)))
        out = []
        for _ in range(trees):
            feature, cut, left, path = [], [], [], []
            todo = [(rows[rng.choice(len(rows), size, replace=False)], 0)]
            at = 0
            while at < len(todo):
                own, level = todo[at]
                at += 1
                low, high = (own.min(0), own.max(0)) if len(own) else (np.zeros(rows.shape[1]),) * 2
                free = np.flatnonzero(high > low)
                if level >= depth or len(own) < 2 or not len(free):
                    feature.append(-1), cut.append(0.0), left.append(0), path.append(level + mean_path(len(own)))
                    continue
                f = int(rng.choice(free))
                c = rng.uniform(low[f], high[f])
                feature.append(f), cut.append(c), left.append(len(todo)), path.append(0.0)
                todo += [(own[own[:, f] <= c], level + 1), (own[own[:, f] > c], level + 1)]
            out.append(tuple(map(np.asarray, (feature, cut, left, path))))
        return cls(out, size)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for rows that random splits isolate soon."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, left, path in self.trees:
            node = np.zeros(len(rows), "i8")
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                node = np.where(inner, left[node] + (rows[every, f] > cut[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(mean_path(self.size), 1e-9))


def calibrated(histogram: list[tuple[float, int, int]], penalty: float) -> float:
    """Threshold for (score, good rows, bad rows): scores above it are rejected.

    It has the most bad rows above it less ``penalty`` times the good ones; infinite if no cut gains anything.
    """
    best, at, gain = 0.0, math.inf, 0.0
    ordered = sorted(histogram, reverse=True)
    for (score, good, bad), below in zip(ordered, [*ordered[1:], (0.0, 0, 0)]):
        gain += bad - penalty * good
        if gain > best:
            best, at = gain, (score + below[0]) / 2
    return at


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4096, bad_share: float = 0.03,
                  trees: int = 100, subsample: int = 256, penalty: float = 25.0, seed: int = 42, passing: bool = False) -> DataFrame:
    """``id_col``, the five statistics, base_failed, score and kept of every row; with ``passing`` all columns of ``docs`` first.

    The forest is fitted on at most ``sample`` good labelled rows that pass the base rules, those with the smallest
    hashes, and a ``bad_share`` of bad ones beside them (rare rows are what random splits isolate). It is the only thing
    fitted on a sample. The threshold comes from the scores of all labelled rows (a histogram of at
    most 10001 scores reaches the driver): it rejects bad rows only while a lost good row costs ``penalty`` of them.
    ``labels`` has ``id_col`` and quality (1 good, 0 bad, null ignored); of several labels of an id the lowest counts.
    Null and empty texts have no words and fail the base rules, whole texts count. Equal rows get equal results, rows
    with a null id are judged but never labelled. Without labels of both kinds the forest rejects nothing; an empty
    table gives an empty one. Added columns take other names where ``docs`` has theirs (``fresh``).
    """
    src = docs if passing else docs.select(col(id_col), col(text_col))
    names = fresh(src, *STATS, "base_failed", "score", "kept")
    stat, (failed, score, kept) = names[:5], names[5:]
    df = with_statistics(src, text_col, stat)
    if not passing:
        df = df.drop(col(text_col))
    n, rep = col(stat[0]), col(stat[4])
    df = written(df.withColumn(failed, (n < 50) | (100 * rep > 50 * n)), "rule-statistics")
    truth = labels.where("quality is not null").groupBy(col(id_col).alias("_labelled")).agg(F.min("quality").alias("_quality"))
    known = df.where(~col(failed)).select(col(id_col), *map(col, stat)).join(truth, col(id_col) == F.col("_labelled")).select(*map(col, stat), F.when(F.col("_quality") > 0, 1).otherwise(0).alias("good"))
    order = F.xxhash64(F.lit(seed), *map(col, stat))
    first = lambda good, most: known.where(F.col("good") == good).select(*map(col, stat)).orderBy(order, *map(col, stat)).limit(most).collect()
    rows = first(1, sample)
    rows += first(0, max(1, int(bad_share * len(rows))))
    forest = IsolationForest.fit(shares(np.asarray(rows, "i8").reshape(-1, 5)), trees, subsample, seed) if rows else None
    shared = df.sparkSession.sparkContext.broadcast(forest)  # at most trees x 2 x subsample nodes

    @F.pandas_udf("double")
    def scored(a, b, c, d, e):
        import pandas as pd

        if shared.value is None:
            return pd.Series(np.zeros(len(a)))
        return pd.Series(shared.value.score(shares(np.stack([x.to_numpy() for x in (a, b, c, d, e)], 1))).round(4))

    hist = known.withColumn("score", scored(*map(col, stat))).groupBy("score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    limit = calibrated([tuple(r) for r in hist.collect()], penalty)
    return df.withColumn(score, scored(*map(col, stat))).withColumn(kept, ~col(failed) & (col(score) <= F.lit(limit)))
