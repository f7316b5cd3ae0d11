"""Exact ranks, row numbers and quantiles inside groups of any size.

``row_number() OVER (PARTITION BY g ORDER BY x)`` sorts a whole group in one task. A group may hold
a third of all rows here (one sample, one feature, one pair), so equal values are collapsed into counts map-side, the
counts are dealt by range of (group, x) over all tasks, and the sums of earlier ranges are added to later ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import keep
from .cols import c

PREC = Window.unboundedPreceding
#: Rows of a group up to which one task ranks it whole; larger groups are dealt by range. Results are the same.
TASK_ROWS = 1_000_000


def fits(df: DataFrame, keys) -> bool:
    """Whether no group of ``df`` has over TASK_ROWS rows: one number of a count that is combined before its shuffle."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= TASK_ROWS


def mean_rank(keys, value) -> Column:
    """Average rank inside whole groups."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def value_cells(x) -> tuple[Column, Column]:
    """Two monotone integers that cut the numbers: 64 cells per octave on every scale and sign, and 65536 parts of each.

    Cells follow the logarithm, so values of any size spread alike; values within a millionth of each other, such as
    times of day, still spread over the parts.
    """
    v = c(x).cast("double")
    octave = F.log2(F.abs(v)) * 64
    cell = F.floor(octave)
    sign = F.when(v > 0, 1).when(v < 0, -1).otherwise(0)
    whole = F.when(sign == 0, 0).otherwise(sign * (cell + 70000))
    part = F.when(sign == 0, 0).otherwise(sign * F.floor((octave - cell) * 65536))
    inf = F.lit(float("inf"))
    return F.when(F.abs(v) == inf, sign * 200000).otherwise(whole).cast("long"), F.when(F.abs(v) == inf, 0).otherwise(part).cast("long")


def cumulate(hist: DataFrame, keys, order, n: str = "_n", descending: bool = False) -> DataFrame:
    """Adds ``_below``: rows of the group that sort before this histogram line; lines with a NULL in ``keys`` leave.

    Lines are dealt by range of (keys, order), so tasks are even however the values lie, and summed up where they are; a
    group that goes on in the next slices gets the sums of those before, one line a slice. The first of ``order``
    follows ``descending``, further columns break ties. The result is stored, so reading it again costs nothing.
    """
    keys = list(keys)
    by = [*map(c, keys), c(order[0]).desc() if descending else c(order[0]).asc(), *map(c, order[1:])]
    src = hist.dropna(subset=keys).repartitionByRange(*by).sortWithinPartitions(*by)
    kind, names = src.schema[n].dataType.simpleString(), src.columns

    def run(batches):
        at, held, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if b.num_rows == 0:
                continue
            x = b.column(names.index(n)).to_numpy(zero_copy_only=False)
            new = np.zeros(b.num_rows, bool)
            for k in keys:
                code = b.column(names.index(k)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            before = np.cumsum(x) - x
            before = before - before[start]
            key = lambda i: [b.column(names.index(k))[i].as_py() for k in keys]
            if held == key(0):
                before[start == 0] += total
            held, total = key(len(x) - 1), before[-1] + x[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, b.column(names.index(n)).type), pa.array(np.full(len(x), at, "i4"))], [*names, "_in", "_slice"])

    lines = keep(src.mapInArrow(run, StructType([*src.schema.fields, *StructType.fromDDL(f"_in {kind}, _slice int").fields])))
    earlier = F.sum("_sn").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(PREC, -1))
    gone = lines.groupBy(*keys, "_slice").agg(F.sum(n).alias("_sn")).withColumn("_off", earlier).where("_off IS NOT NULL").drop("_sn")
    return lines.join(F.broadcast(gone), [*keys, "_slice"], "left").withColumn("_below", F.coalesce("_off", F.lit(0)) + F.col("_in")).drop("_off", "_in", "_slice")


def value_histogram(df: DataFrame, keys, value: str) -> DataFrame:
    """keys, value, _n, _below (rows with a smaller value)."""
    hist = df.where(c(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return cumulate(hist, keys, [value])


def average_ranks(df: DataFrame, keys, values: dict[str, str], ties: bool = False) -> DataFrame:
    """Ascending ranks inside ``keys``, ties share their mean rank; ``values`` maps value columns to rank columns.

    Counts the groups first (see ``fits``), so hand over rows that are cheap to read again. Rows with NULL in a ranked column are dropped. All histograms are taken from ``df`` itself, so ranking two columns
    reads it three times and nests nothing.
    """
    keys = list(keys)
    df = df.dropna(subset=list(values))
    if not ties and fits(df, keys):
        return df.withColumns({name: mean_rank(keys, v) for v, name in values.items()})
    out = df
    for v, name in values.items():
        h = value_histogram(df, keys, v)
        h = h.select(*keys, v, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(name), *([F.col("_n").alias(f"{name}_ties")] if ties else []))
        out = out.join(h, [*keys, v])
    return out


def ordered_positions(df: DataFrame, keys, value, tie, out: str, descending: bool = True) -> DataFrame:
    """1-based position of every row inside ``keys`` by ``value``, then by md5 of ``tie``, then by ``tie``.

    Same as row_number() with that order, but rows are dealt by range, so no group is sorted whole and ties on the
    value are spread by their hashes. All columns of ``df`` are stored, so hand over those you need.
    """
    v, t = F.col("_v"), F.md5(c(tie).cast("string"))
    rows = df.withColumns({"_v": c(value).cast("double"), "_t": t, "_n": F.lit(1).cast("long")})
    return cumulate(rows, keys, [v, "_t", tie], descending=descending).withColumn(out, F.col("_below") + 1).drop("_v", "_t", "_n", "_below")


def exact_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """keys, n and one linearly interpolated quantile column per entry of ``probs``.

    ``keys`` may not be empty: pass a literal column for one overall group.
    """
    return histogram_quantiles(value_histogram(df, list(keys), value), list(keys), value, probs)


def histogram_quantiles(h: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles from a cumulated histogram (keys, value, _n, _below)."""
    tot = h.groupBy(*keys).agg(F.sum("_n").alias("n"))
    j = h.join(tot, keys)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        for side, r in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_below") <= r) & (r < F.col("_below") + F.col("_n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
    q = j.groupBy(*keys, "n").agg(*aggs)
    cols = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return q.select(*keys, "n", *cols)


def top_per_group(df: DataFrame, keys, order, k: int, out: str | None = None) -> DataFrame:
    """First ``k`` rows per group in a total order.

    For k up to spark.sql.optimizer.windowGroupLimitThreshold Spark cuts every input partition down to
    k rows per group before the shuffle, so a hot group never meets in one task.
    """
    rn = out or "_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    res = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= k)
    return res if out else res.drop(rn)
