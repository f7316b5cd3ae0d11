"""Regression metrics, resampling, permutation null."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.joins import join_facts
from ..functions.ranks import cumulate, value_histogram
from ..session import keep
from .forests import by_key


#: Sums of a group's rows (r: ranks inside slices of y and p, see ``regression_metrics``).
SUMS = ["n", "y", "p", "yy", "pp", "yp", "sse", "sae", "ok", "ry", "rp", "ryy", "rpp", "ryp"]
#: Distinct values of y up to which their ranks are broadcast (three numbers each); groups with the same values count once.
RANKED = 1 << 18


def _run_ranks(batches, value: str):
    """(batch of whole runs, average rank in its group so far) from batches sorted by h and ``value``; ranks count m.

    A run of equal values that goes on in the next batch is held back.
    """
    held, last, total = None, None, 0.0
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [*held, b]).combine_chunks()
        if not t.num_rows:
            continue
        h, v = t.column("h").to_numpy(), t.column(value).to_numpy()
        at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (v[1:] != v[:-1])))
        if at[-1]:
            yield (done := t.slice(0, at[-1])), (got := _ranks(h, done.column("m").to_numpy(), at[:-1], last, total))[0]
            last, total = got[1:]
        held = t.slice(at[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _ranks(t.column("h").to_numpy(), t.column("m").to_numpy(), np.zeros(1, "i8"), last, total)[0]


def _ranks(h, m, starts, last, total):
    """Ranks of whole runs, the group they end in and its count so far."""
    n = np.add.reduceat(m, starts)
    own = h[starts]
    first = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), np.arange(len(own)), 0))
    below = np.cumsum(n) - n
    below = below - below[first] + np.where((first == 0) & (own == last), total, 0.0)
    return np.repeat(below + (n + 1) / 2.0, np.diff(np.append(starts, len(m)))), own[-1], below[-1] + n[-1]


def regression_metrics(pred: DataFrame, keys: list[str], mult: str | None = None, zero_is_positive: bool = True) -> DataFrame:
    """R2, RMSE, MAE, Spearman (average ranks), Pearson and sign accuracy; ``mult`` counts repeated rows.

    Values of y are counted map-side. Groups with the same values and counts, such as all models of the same rows, share their
    ranks. Up to RANKED values are ranked as they stand and the ranks are broadcast; more are dealt
    by range of (group, y) with their rows and ranked in their slice. Rows are then dealt by range of (group, p), ranked and
    added up. What a slice's ranks lack, the counts of the group's earlier slices, is the same for all its rows, so it is put right
    in the sums of each pair of slices. Numbers alone are shuffled, names join the sums; no row is stored, no group meets in one task.
    """
    d = pred.select(*keys, (F.col("y_true").cast("double") + 0.0).alias("y"), (F.col("y_pred").cast("double") + 0.0).alias("p"), (F.col(mult) if mult else F.lit(1)).cast("double").alias("m")).dropna(subset=["y", "p"])
    d = d.withColumn("h", F.xxhash64(*keys))
    values = keep(d.groupBy("h", *keys, "y").agg(F.sum("m").alias("_n")))
    d = d.select("h", "y", "p", "m")
    spark = pred.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # not merged by size: packed rows are far larger when sorted

    def by_y(batches):
        at = TaskContext.get().partitionId()
        for t, r in _run_ranks(batches, "y"):
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in "hypm"), pa.array(r), pa.array(np.full(len(r), at, "i4"))], [*"hypm", "ry", "sy"])

    def by_p(batches):
        at, sums = TaskContext.get().partitionId(), {}
        for t, rp in _run_ranks(batches, "p"):
            h, y, p, m, ry, sy = (t.column(c).to_numpy() for c in ("h", "y", "p", "m", "ry", "sy"))
            e, pos = y - p, (lambda x: x >= 0) if zero_is_positive else (lambda x: x > 0)
            parts = (1.0, y, p, y * y, p * p, y * p, e * e, np.abs(e), pos(y) == pos(p), ry, rp, ry * ry, rp * rp, ry * rp)
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(h)]):
                own, code = np.unique(sy[a:b], return_inverse=True)
                got = np.stack([np.bincount(code, m[a:b] * (x if np.isscalar(x) else x[a:b]), len(own)) for x in parts], 1)
                for s, x in zip(own.tolist(), got):
                    k = (int(h[a]), s)
                    sums[k] = sums[k] + x if k in sums else x
        lines = [(*k, at, *x.tolist()) for k, x in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(list(zip(*lines)) or [[]] * len(types), types)], out.names)

    out = StructType.fromDDL("h long, sy int, sp int, " + ", ".join(f"{x} double" for x in SUMS))
    types = list(to_arrow_schema(out).types)
    marks = [F.bit_xor(F.xxhash64("y", "_n", F.lit(i))).alias(f"_x{i}") for i in (1, 2)]  # values of a group are distinct, so none cancel
    alike = Window.partitionBy("_k", "_x1", "_x2")
    groups = keep(values.groupBy("h").agg(F.count(F.lit(1)).alias("_k"), *marks).select("h", F.min("h").over(alike).alias("_r"), "_k"))
    lines = groups.agg(F.sum(F.when(F.col("h") == F.col("_r"), F.col("_k")).otherwise(0)).alias("n"), F.count(F.lit(1)).alias("groups")).first()
    if (lines["n"] or 0) + lines["groups"] <= RANKED:
        ranks = cumulate(values.join(F.broadcast(groups.where("h = _r")), "h").select("_r", "y", "_n"), ["_r"], ["y"]).select("_r", "y", (F.col("_below") + (F.col("_n") + 1) / 2.0).alias("ry"))
        slices = d.join(F.broadcast(groups.select("h", "_r")), "h").join(F.broadcast(ranks), ["_r", "y"]).select("h", "y", "p", "m", "ry", F.lit(0).alias("sy"))
    else:
        slices = d.repartitionByRange(tasks, "h", "y").sortWithinPartitions("h", "y").mapInArrow(by_y, "h long, y double, p double, m double, ry double, sy int")
    slices = keep(slices.repartitionByRange(tasks, "h", "p").sortWithinPartitions("h", "p").mapInArrow(by_p, out))
    earlier = lambda s: F.coalesce(F.sum("n").over(Window.partitionBy("h").orderBy(s).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    before = lambda s, name: slices.groupBy("h", s).agg(F.sum("n").alias("n")).select("h", s, earlier(s).alias(name))
    t = slices.join(before("sy", "oy"), ["h", "sy"]).join(before("sp", "op"), ["h", "sp"])
    n, ry, rp, oy, op = (F.col(x) for x in ("n", "ry", "rp", "oy", "op"))
    s = {x: F.col(x) for x in SUMS} | {"ry": ry + n * oy, "rp": rp + n * op, "ryy": F.col("ryy") + 2 * oy * ry + n * oy * oy, "rpp": F.col("rpp") + 2 * op * rp + n * op * op,
                                       "ryp": F.col("ryp") + oy * rp + op * ry + n * oy * op}
    g = t.groupBy("h").agg(*[F.sum(v).alias(f"_{k}") for k, v in s.items()]).join(values.select("h", *keys).distinct(), "h")
    c = {k: F.col(f"_{k}") for k in s}
    n = c["n"]

    def corr(a, b, aa, bb, ab):
        va, vb = aa / n - (a / n) * (a / n), bb / n - (b / n) * (b / n)
        return F.when((va > 1e-12) & (vb > 1e-12), (ab / n - (a / n) * (b / n)) / F.sqrt(va * vb))

    vy = c["yy"] - c["y"] * c["y"] / n
    return g.select(*keys, n.cast("long").alias("n"), F.when(vy > 0, 1 - c["sse"] / vy).alias("r2"), F.sqrt(c["sse"] / n).alias("rmse"), (c["sae"] / n).alias("mae"),
                    corr(c["ry"], c["rp"], c["ryy"], c["rpp"], c["ryp"]).alias("spearman"), corr(c["y"], c["p"], c["yy"], c["pp"], c["yp"]).alias("pearson"),
                    (c["ok"] / n).alias("sign_acc"))


def scored_groups(pred: DataFrame, keys: list[str]) -> DataFrame:
    """The groups that ``regression_metrics`` has a row for, without the metrics; combined before the shuffle."""
    return pred.select(*keys, "y_true", "y_pred").dropna(subset=["y_true", "y_pred"]).select(*keys).distinct()


def pair_metrics(pred: DataFrame, keys: list[str], min_n: int = 30) -> DataFrame:
    """Metrics per pair with enough rows."""
    return regression_metrics(pred, [*keys, "pair_id"]).where(F.col("n") >= min_n).select(*keys, "pair_id", "n", "spearman", "rmse", "mae")


def pair_spearman(pred: DataFrame, keys: list[str], min_n: int = 30) -> DataFrame:
    """J05."""
    return pair_metrics(pred, keys, min_n).groupBy(*keys).agg(F.avg("spearman").alias("pair_spearman_mean"), F.count(F.lit(1)).alias("pair_spearman_n"))


#: Replicates of one task, and those whose weights it holds at once, which are WEIGHTS numbers at most (one replicate at least).
REPLICATES, HELD, WEIGHTS = 250, 25, 1 << 22
#: Rows a point up to which rows are drawn one by one; for more, the points' counts are drawn (a binomial each).
DRAWN = 7
#: Distinct points that a task ranks at once; a larger group is cut into slices of y and of p, where a task takes STEPS replicates.
CELLS, STEPS = 1 << 20, 1 << 10
#: Rows of a pair that are permuted at once (four numbers each in memory); of a larger pair, the size of its blocks.
PERMUTED_ROWS = 1 << 23
#: Bytes of packed ranks that a task holds before it hands them on.
BLOB_BYTES = 32 << 20


#: Share of the squared mean rank that rounding leaves of the variance of equal values.
TRACE = 1e-12


def _code(names: list[str]):
    """64-bit code of the values of the columns ``names``, nulls included."""
    return F.xxhash64(*names, *[F.col(k).isNull() for k in names])


def _rng(*seed) -> np.random.Generator:
    """A counter-based generator keyed by the MD5 of ``seed``, so that replicates don't depend on partitions or retries."""
    return np.random.Generator(np.random.Philox(key=int(md5("|".join(map(str, seed)).encode()).hexdigest(), 16)))


def _order(values: np.ndarray):
    """Places of the ascending values (None: as they stand), the run of equal values of each place (None: no ties), last place of each run."""
    order = np.argsort(values, kind="stable")
    inside = values[order]
    last = np.append(np.flatnonzero(inside[1:] != inside[:-1]), len(values) - 1)
    run = None if len(last) == len(values) else np.repeat(np.arange(len(last)), np.diff(last, prepend=-1))
    return None if (order[1:] > order[:-1]).all() else order, run, last


def _weighted_ranks(w: np.ndarray, order):
    """Weights and average ranks in ascending order, where row i occurs ``w[i]`` times, and the sum of the squared ranks: from cumulated weights."""
    at, run, last = order
    own = w if at is None else np.take(w, at)
    upto = np.cumsum(own)[last]
    n = np.diff(upto, prepend=0)
    rank = upto - (n - 1) / 2.0
    return own, rank if run is None else np.take(rank, run), float(n @ (rank * rank))


def _weighted_spearman(w: np.ndarray, by_y, by_p, back: np.ndarray) -> float:
    """Spearman where row i occurs ``w[i]`` times; ``back``: where the rows in order of y are in that of p. One pass a replicate, in cache."""
    n = int(w.sum())
    _, ry, yy = _weighted_ranks(w, by_y)
    own, rp, pp = _weighted_ranks(w, by_p)
    mean = (n + 1) / 2.0
    vy, vp = yy / n - mean * mean, pp / n - mean * mean
    return (float(np.take(own * rp, back) @ ry) / n - mean * mean) / np.sqrt(vy * vp) if min(vy, vp) > TRACE * mean * mean else np.nan


def _points(pred: DataFrame, keys: list[str], unit: str | None) -> DataFrame:
    """keys, u, y, p and c (rows) of the distinct points of each group."""
    d = pred.select(*keys, (F.col(unit) if unit else F.lit(0)).cast("string").alias("u"), F.col("y_true").cast("double").alias("y"), F.col("y_pred").cast("double").alias("p"))
    return keep(d.dropna(subset=["y", "p"]).groupBy(*keys, "u", "y", "p").agg(F.count(F.lit(1)).alias("c")))


def _point_sums(y, p, c):
    e = y - p
    return [c * y, c * y * y, c * e * e, c * np.abs(e)]


def _packed(points: DataFrame, keys: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """keys and blob: the points (u, y, p, c and ``more``) of a group that a batch holds, as one Arrow stream."""
    def run(batches):
        for b in batches:
            for key, at in by_key(b, keys):
                own = b.take(pa.array(at))
                t = pa.RecordBatch.from_arrays([own.column("u").dictionary_encode(), *(own.column(x) for x in ("y", "p", "c", *more))], ["u", "y", "p", "c", *more])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema) as out:
                    out.write_batch(t)
                yield pa.RecordBatch.from_arrays([*(own.column(k).slice(0, 1) for k in keys), pa.array([sink.getvalue().to_pybytes()], pa.binary())], [*keys, "blob"])

    return points.select(*keys, "u", "y", "p", "c", *more).mapInArrow(run, StructType([*points.select(*keys).schema.fields, *StructType.fromDDL("blob binary").fields]))


def _unpacked(blobs: list[bytes], known: list[str] | None = None) -> list[np.ndarray]:
    """Number of u (ascending; its place in ``known``), y, p, c, the sums (points x 4) and what else the points in ``blobs`` have, in order of u, y and p."""
    parts = []
    for x in blobs:
        t = pa.ipc.open_stream(x).read_all().combine_chunks()
        parts.append((t.column("u").cast(pa.string()), [t.column(i).to_numpy() for i in range(1, t.num_columns)]))
    u = pa.chunked_array([z for x, _ in parts for z in x.chunks]).dictionary_encode().unify_dictionaries().combine_chunks()
    names = u.dictionary.to_pylist()
    number = {x: i for i, x in enumerate(known or sorted(names))}
    u = np.asarray([number[x] for x in names], "i8")[u.indices.to_numpy()]
    y, p, c, *more = (np.concatenate([n[i] for _, n in parts]) for i in range(len(parts[0][1])))
    at = np.lexsort((p, y, u))
    u, y, p, c = u[at], y[at], p[at], c[at]
    return [u, y, p, c, np.stack(_point_sums(y, p, c), 1), *(x[at] for x in more)]


def _replicates(points: DataFrame, keys: list[str], B: int, seed: int, weights) -> DataFrame:
    """keys, b, r2, rmse, mae, spearman of B replicates of each group's ``points``, exact at any size: see ``_whole`` and ``_sliced``."""
    coded = points.withColumn("_g", _code(keys))
    big = keep(coded.groupBy("_g").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > CELLS).select("_g"))
    if not big.limit(1).count():
        return _whole(points, keys, B, seed, weights)
    out = _whole(coded.join(F.broadcast(big), "_g", "left_anti").drop("_g"), keys, B, seed, weights)
    return out.unionByName(_sliced(coded.join(F.broadcast(big), "_g"), keys, B, seed, weights is _drawn_units))


def _whole(points: DataFrame, keys: list[str], B: int, seed: int, weights) -> DataFrame:
    """``_replicates`` of groups that a task ranks at once.

    A point goes once to each task of REPLICATES replicates of its group, packed, and is never repeated by replicate: in there a
    replicate is a row of weights, ``weights(rng, u, c, replicates)``, moments are products with the points' sums, and
    ranks come from the cumulated weights of the values, which are sorted once a task.
    """
    spark = points.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    dealt = _packed(points, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-B // REPLICATES) - 1)))).repartition(tasks, *keys, "block")
    shape = points.select(*keys).schema
    types = list(to_arrow_schema(shape))

    def run(key, group):
        own = [k.as_py() for k in key]
        u, y, p, c, sums = _unpacked(group.column("blob").to_pylist())
        sums /= c[:, None]  # of one row
        by_y, by_p = _order(y), _order(p)
        back = np.arange(len(p))
        if by_p[0] is not None:
            back[by_p[0]] = np.arange(len(p))
        if by_y[0] is not None:
            back = back[by_y[0]]
        rng, first = _rng(seed, *own), own[-1] * REPLICATES
        end, held = min(first + REPLICATES, B), max(1, min(HELD, WEIGHTS // len(y)))
        out = []
        for a in range(first, end, held):
            w = weights(rng, u, c, min(held, end - a))
            n = w.sum(1)
            sy, syy, sse, sae = (w.astype("f8") @ sums).T
            vy = syy - sy * sy / n
            with np.errstate(invalid="ignore", divide="ignore"):
                r2 = np.where(vy > 0, 1 - sse / vy, np.nan)
            rho = [_weighted_spearman(x, by_y, by_p, back) for x in w]
            out.append(np.stack([r2, np.sqrt(sse / n), sae / n, rho], 1))
        got = np.concatenate(out)
        columns = {f.name: pa.array([v] * len(got), f.type) for f, v in zip(types, own)} | {"b": pa.array(np.arange(first + 1, first + 1 + len(got)))}
        return pa.table(columns | {m: pa.array(got[:, i], mask=np.isnan(got[:, i])) for i, m in enumerate(("r2", "rmse", "mae", "spearman"))})

    return dealt.groupBy(*keys, "block").applyInArrow(run, StructType([*shape.fields, *StructType.fromDDL("b long, r2 double, rmse double, mae double, spearman double").fields]))


def _at_slice(points: DataFrame, v: str, other: str, name: str) -> DataFrame:
    """``points`` with their slice of ``v``: 2^20 x (run of slices, ascending in ``v``) and the part of the run.

    A slice holds whole values and less than 2 x CELLS points; a value of more points is a run of several parts, all of that value.
    """
    h = cumulate(points.groupBy("_g", v).agg(F.count(F.lit(1)).alias("_n")), ["_g"], [v])
    hot = F.col("_n") > CELLS
    h = h.select("_g", v, (2 * F.floor(F.col("_below") / CELLS) + hot.cast("long")).alias("_run"), F.when(hot, F.ceil(F.col("_n") / CELLS)).otherwise(1).alias("_parts"))
    found = join_facts(points, h, ["_g", v], ["u", other])
    return found.withColumn(name, F.col("_run") * PARTS + F.pmod(F.xxhash64("u", other), F.col("_parts"))).drop("_run", "_parts")


PARTS = 1 << 20


def _sliced(points: DataFrame, keys: list[str], B: int, seed: int, by_unit: bool) -> DataFrame:
    """``_replicates`` of large groups (``_g``: their code): no task holds more than a slice of y and one of p.

    Where a slice of y meets one of p is a cell. A replicate first draws how many rows each cell gets (of each stratum; of drawn units this
    follows), and then, from a seed of the cell's own, how often each of its points comes. So every task knows the rows below its slices, can draw
    the cells of a slice as other tasks do, ranks them, and adds up the points of one cell; cells' sums make the replicate.
    """
    spark = points.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = keep(points.groupBy("_g", *keys).agg(F.lit(1)).select("_g", *keys))
    placed = keep(_at_slice(_at_slice(points.select("_g", "u", "y", "p", "c"), "y", "p", "row"), "p", "y", "col"))
    table = keep(placed.groupBy("_g", "u", "row", "col").agg(F.sum("c").alias("n")))
    cells = F.broadcast(table.select("_g", "row", "col").distinct())
    counts = table.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("u", "row", "col", "n"))).alias("table"))
    none, no_table = F.lit(None).cast("binary"), F.lit(None).cast(counts.schema["table"].dataType)
    at, block = ["_g", "row", "col"], F.explode(F.sequence(F.lit(0), F.lit(-(-B // STEPS) - 1))).alias("block")
    sides = [_packed(placed, ["_g", own], (other,)).join(cells, ["_g", own]).select(*at, F.lit(own).alias("side"), "blob", no_table.alias("table")) for own, other in (("row", "col"), ("col", "row"))]
    sides.append(counts.join(cells, "_g").select(*at, F.lit("table").alias("side"), none.alias("blob"), "table"))
    dealt = sides[0].unionAll(sides[1]).unionAll(sides[2]).select("*", block).repartition(tasks, *at, "block")
    steps = STEPS

    def run(key, group):
        g, row, col, block = (k.as_py() for k in key)
        lines = group.filter(pc.equal(group.column("side"), "table")).column("table")[0].as_py()
        units = sorted({x["u"] for x in lines})
        number = {x: i for i, x in enumerate(units)}
        lines = sorted((number[x["u"]], x["row"], x["col"], x["n"]) for x in lines)
        tu, tr, tc, tn = np.asarray(lines, "i8").T
        line = {x[:3]: i for i, x in enumerate(lines)}
        ends = np.append(np.flatnonzero(tu[1:] != tu[:-1]) + 1, len(tu))

        def slice_of(side, v, mine):
            u, y, p, c, sums, other = _unpacked(group.filter(pc.equal(group.column("side"), side)).column("blob").to_pylist(), units)
            by = np.argsort(other, kind="stable")  # cell by cell, there by u, y and p
            u, c, sums, other, value = u[by], c[by], sums[by] / c[by, None], other[by], (y, p)[v][by]
            cut = np.flatnonzero(np.append(True, (other[1:] != other[:-1]) | (u[1:] != u[:-1])))
            runs = [(int(u[a]), *((mine, int(other[a])) if v == 0 else (int(other[a]), mine)), a, z) for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(u)])]
            mark = (tr, tc)[v] // PARTS
            own = np.flatnonzero(other == (col, row)[v])
            return u, c, sums, runs, _order(value), mark < mine // PARTS, mark == mine // PARTS, (mine // PARTS) % 2, slice(own[0], own[-1] + 1)

        both = slice_of("row", 0, row), slice_of("col", 1, col)
        out = []
        for b in range(block * steps + 1, min((block + 1) * steps, B) + 1):
            rng = _rng(seed, g, b)
            if by_unit:
                times = np.bincount(rng.integers(0, len(units), len(units)), minlength=len(units))
                rows = times[tu] * tn
            else:
                rows = np.concatenate([rng.multinomial(tn[a:z].sum(), tn[a:z] / tn[a:z].sum()) for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())])
            got = []
            for u, c, sums, runs, order, below, same, hot, cell in both:
                if by_unit:
                    w = times[u] * c
                else:
                    w, held = np.empty(len(c), "i8"), None
                    for k, r, q, a, z in runs:
                        if held != (r, q):
                            held, own = (r, q), _rng(seed, g, b, r, q)
                        w[a:z] = _drawn(own, c[a:z], int(rows[line[k, r, q]]))
                if hot:
                    rank = np.full(cell.stop - cell.start, rows[below].sum() + (rows[same].sum() + 1) / 2.0)
                else:
                    rank = np.empty(len(w))
                    rank[slice(None) if order[0] is None else order[0]] = _weighted_ranks(w, order)[1]
                    rank = rank[cell] + rows[below].sum()
                got.append((w[cell].astype("f8"), rank, sums[cell]))
            (w, ry, sums), (_, rp, _) = got
            out.append((g, b, w.sum(), *(w @ sums), w @ (ry * ry), w @ (rp * rp), w @ (ry * rp)))
        return pa.table({x: pa.array(v, pa.int64() if x in ("_g", "b") else pa.float64()) for x, v in zip(("_g", "b", *parts), zip(*out))})

    parts = ("n", "sy", "syy", "sse", "sae", "yy", "pp", "yp")
    made = dealt.groupBy(*at, "block").applyInArrow(run, "_g long, b long, " + ", ".join(f"{x} double" for x in parts))
    made = made.groupBy("_g", "b").agg(*[F.sum(x).alias(x) for x in parts]).join(F.broadcast(names), "_g")
    n, sy, syy, sse, sae, yy, pp, yp = map(F.col, parts)
    mean = (n + 1) / 2.0
    spread, vy, vp = syy - sy * sy / n, yy / n - mean * mean, pp / n - mean * mean
    rho = F.when(F.least(vy, vp) > TRACE * mean * mean, (yp / n - mean * mean) / F.sqrt(vy * vp))
    return made.select(*keys, "b", F.when(spread > 0, 1 - sse / spread).alias("r2"), F.sqrt(sse / n).alias("rmse"), (sae / n).alias("mae"), rho.alias("spearman"))


def _drawn(rng, c, n: int):
    """How often each point comes when ``n`` rows are drawn with replacement from points of ``c`` rows."""
    upto = np.cumsum(c)
    total = int(upto[-1])
    if max(n, total) > DRAWN * len(c):
        return rng.multinomial(n, c / total)
    drawn = np.bincount(rng.integers(0, total, n, dtype="u4" if total < 1 << 32 else "i8"), minlength=total)
    return drawn if total == len(c) else np.diff(np.cumsum(drawn)[upto - 1], prepend=0)


def _drawn_rows(rng, u, c, replicates):
    """As many rows as each stratum ``u`` (ascending) has, drawn with replacement: how often each point comes."""
    out = np.empty((replicates, len(c)), "i8")
    ends = np.append(np.flatnonzero(u[1:] != u[:-1]) + 1, len(u))
    for b in range(replicates):
        for a, z in zip([0, *ends[:-1].tolist()], ends.tolist()):
            out[b, a:z] = _drawn(rng, c[a:z], int(c[a:z].sum()))
    return out


def _drawn_units(rng, u, c, replicates):
    """As many units ``u`` as there are, drawn with replacement, each with all its rows."""
    k = int(u.max()) + 1
    draws = rng.integers(0, k, (replicates, k)) + k * np.arange(replicates)[:, None]
    return np.bincount(draws.ravel(), minlength=replicates * k).reshape(replicates, k)[:, u] * c


def _summary(m: DataFrame, keys: list[str], B: int, cols=("r2", "rmse", "mae", "spearman")) -> DataFrame:
    """Mean, deviation and 2.5/97.5 % over the replicates (B values per group); needs max(10, 10 % of B) valid ones."""
    need = max(10, int(0.1 * B))
    aggs = [F.count(F.lit(1)).alias("n_boot")]
    for x in cols:
        ok = F.count(x) >= min(need, B)
        aggs += [F.when(ok, F.avg(x)).alias(f"{x}_boot_mean"), F.when(ok, F.stddev_samp(x)).alias(f"{x}_boot_sd"), F.when(ok, F.percentile(x, 0.025)).alias(f"{x}_ci_low"),
                 F.when(ok, F.percentile(x, 0.975)).alias(f"{x}_ci_high"), (1 - F.count(x) / F.count(F.lit(1))).alias(f"{x}_nan_frac")]
    return m.groupBy(*keys).agg(*aggs)


def bootstrap_rows(pred: DataFrame, keys: list[str], B: int = 5000, seed: int = 1) -> DataFrame:
    """Rows drawn with replacement inside each group."""
    return _summary(_replicates(_points(pred, keys, None), keys, B, seed, _drawn_rows), keys, B)


def bootstrap_pairs(pred: DataFrame, keys: list[str], B: int = 1000, seed: int = 1, small: int = 200, tiny: int = 50, few_pairs: int = 5) -> DataFrame:
    """Whole pairs drawn with replacement; flags for small groups. Only the points are stored, not the rows."""
    out = _summary(_replicates(_points(pred, keys, "pair_id"), keys, B, seed, _drawn_units), keys, B)
    size = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"), F.countDistinct("pair_id").alias("n_pairs"))
    flag = lambda c: c.cast("int")
    return out.join(size, keys).withColumns({"flag_small_test": flag(F.col("n_test") < small), "flag_tiny_test": flag(F.col("n_test") < tiny), "flag_few_pairs": flag(F.col("n_pairs") < few_pairs)})


def y_bins(pred: DataFrame, keys: list[str], max_bins: int = 8) -> DataFrame:
    """Rows with ``_bin``, their quantile bin of y: round(sqrt n) bins, 2..max, at most 3 below 20 rows; equal values share one."""
    h = value_histogram(pred, keys, "y_true")
    n = h.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    k = F.greatest(F.lit(2), F.least(F.lit(max_bins), F.rint(F.sqrt("_t")).cast("int")))
    k = F.when(F.col("_t") < 20, F.least(k, F.lit(3))).otherwise(k)
    bins = h.join(n, keys).select(*keys, "y_true", F.least(F.floor(F.col("_below") * k / F.col("_t")), k - 1).cast("int").alias("_bin"))
    return pred.join(bins, [*keys, "y_true"])


def bootstrap_stratified(pred: DataFrame, keys: list[str], B: int = 1000, seed: int = 1, max_bins: int = 8) -> DataFrame:
    """Rows drawn inside quantile bins of y."""
    pred = keep(pred.select(*keys, "y_true", "y_pred"))
    return _summary(_replicates(_points(y_bins(pred, keys, max_bins), keys, "_bin"), keys, B, seed, _drawn_rows), keys, B, ("rmse", "spearman"))


def merge_ci(master: DataFrame, ci: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals beside the metrics, with the older names <metric>_lo and <metric>_hi."""
    j = master.join(ci, keys, "left")
    return j.withColumns({f"{c[:-7]}_lo": F.col(c) for c in ci.columns if c.endswith("_ci_low")} | {f"{c[:-8]}_hi": F.col(c) for c in ci.columns if c.endswith("_ci_high")})


def _packed_ranks(values: DataFrame, tasks: int) -> DataFrame:
    """h, w, slice, seq, n, r1, r2 and blob: (rank in its slice, rows) of the values of a pair ``w``, ascending; n rows, r1 and r2 the sums of their ranks and squares.

    ``values`` (h, w, v, m: rows) are dealt by range of (h, v): equal values meet, and their average rank lacks no more than
    the rows of the group's earlier slices. What leaves are two numbers for each distinct value of a pair, no names.
    """
    names, types = ["h", "w", "slice", "seq", "n", "r1", "r2", "blob"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]

    def out(held, at, seq):
        lines = []
        for key, own in held.items():
            x = np.concatenate(own)
            r, m = x.T
            lines.append((*key, at, seq, int(m.sum()), float(m @ r), float(m @ (r * r)), x.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(list(zip(*lines)) or [[]] * len(types), types)], names)

    def run(batches):
        at, seq, held, size = TaskContext.get().partitionId(), 0, {}, 0
        for t, r in _run_ranks(batches, "v"):
            h, w, m = (t.column(c).to_numpy() for c in ("h", "w", "m"))
            by = np.lexsort((r, w, h))
            h, w, r, m = h[by], w[by], r[by], m[by]
            new = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]))
            first = np.flatnonzero(new | np.append(True, r[1:] != r[:-1]))
            lines, pair = np.stack([r[first], np.add.reduceat(m, first)], 1), np.flatnonzero(new[first])
            for a, z in zip(pair.tolist(), [*pair[1:].tolist(), len(first)]):
                held.setdefault((int(h[first[a]]), int(w[first[a]])), []).append(lines[a:z])
            size += lines.nbytes
            if size > BLOB_BYTES:
                yield out(held, at, seq)
                seq, held, size = seq + 1, {}, 0
        yield out(held, at, seq)

    return values.repartitionByRange(tasks, "h", "v").sortWithinPartitions("h", "v").mapInArrow(run, "h long, w long, slice int, seq int, n long, r1 double, r2 double, blob binary")


def _block(blobs: pa.Table, a: int, z: int) -> np.ndarray:
    """Ranks at the places ``a`` to ``z`` of a pair's rows in ascending order, from those of its blobs that reach in there."""
    parts = []
    for start, off, blob in sorted(zip(*(blobs.column(c).to_pylist() for c in ("start", "off", "blob")))):
        r, m = np.frombuffer(blob, "f8").reshape(-1, 2).T
        upto = start + np.cumsum(m).astype("i8")
        parts.append(np.repeat(r + off, np.maximum(np.minimum(upto, z) - np.maximum(upto - m.astype("i8"), a), 0)))
    return np.concatenate(parts)


def _permuted(ry: np.ndarray, rp: np.ndarray, n: int, block: int, i: int, j: int, B: int, seed: tuple) -> list[float]:
    """Of B permutations of a pair's ``n`` rows, the sums of ry x rp over the rows of block ``i`` that come to places of block ``j``.

    A pair of one ``block`` of rows is permuted as it stands. A larger one is permuted as a whole all the same: how many rows of each block come to each block
    of places is drawn first (a table with the blocks' sizes on both margins), then which of them and to which
    places, by a permutation of either block; tasks draw the same from the same seeds.
    """
    if n <= block:
        rng = _rng(*seed)
        return [float(rng.permutation(ry) @ rp) for _ in range(B)]
    sizes, out = np.diff(np.append(np.arange(0, n, block), n)), []
    for b in range(B):
        rng, left, table = _rng(*seed, b), sizes, []
        for size in sizes:
            table.append(rng.multivariate_hypergeometric(left, size))
            left = left - table[-1]
        table = np.stack(table)
        rows, places = _rng(*seed, b, "rows", i).permutation(ry), _rng(*seed, b, "places", j).permutation(rp)
        a, z = table[i, :j].sum(), table[:i, j].sum()
        out.append(float(rows[a:a + table[i, j]] @ places[z:z + table[i, j]]))
    return out


def permutation_null(pred: DataFrame, keys: list[str], B: int = 200, seed: int = 1, row: str = "row_id", within: str | None = "pair_id") -> DataFrame:
    """Spearman after shuffling y inside each pair (inside the group without pairs).

    Shuffling changes no rank and parts y from p, so all it needs are the ranks of either in each pair: values are dealt by
    range as numbers, ranked and packed by pair; no row is stored and no name is shuffled with it. A task permutes the ranks of one
    pair and adds up their products for all permutations, and pairs' sums make the group's. A pair of more than
    PERMUTED_ROWS rows is permuted by blocks, see ``_permuted``. Rows need no name, ``row`` is not read.
    """
    g = [*keys, *([within] if within else [])]
    spark = pred.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    d = pred.select(*g, F.col("y_true").cast("double").alias("y"), F.col("y_pred").cast("double").alias("p")).dropna(subset=["y", "p"])
    h = [F.xxhash64(_code(keys), F.lit(side)) for side in (0, 1)]
    values = d.select(_code(g).alias("w"), F.explode(F.array(*[F.struct(x.alias("h"), (F.col(v) + 0.0).alias("v")) for x, v in zip(h, "yp")])).alias("x"))
    blobs = keep(_packed_ranks(values.select("x.h", "w", "x.v", F.lit(1.0).alias("m")), tasks))
    pairs = keep(d.groupBy(*g).agg(F.count(F.lit(1)).alias("rows")).withColumns({"w": _code(g), "hy": h[0], "hp": h[1]}))
    lines = blobs.drop("blob")
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offs = lines.groupBy("h", "slice").agg(F.sum("n").alias("n")).select("h", "slice", before(["h"], ["slice"]).alias("off"))
    lines = keep(lines.withColumn("start", before(["h", "w"], ["slice", "seq"])).join(offs, ["h", "slice"]).join(pairs.select("w", "hy", "rows"), "w"))

    block = PERMUTED_ROWS
    place = lambda at: F.floor(at / block).cast("int")
    own, other = F.sequence(place(F.col("start")), place(F.col("start") + F.col("n") - 1)), F.sequence(F.lit(0), place(F.col("rows") - 1))
    y = F.col("h") == F.col("hy")
    dealt = join_facts(blobs.select("h", "w", "slice", "seq", "blob"), lines.drop("r1", "r2"), ["h", "w", "slice", "seq"], "seq")
    dealt = dealt.withColumns({"y": y, "i": F.when(y, own).otherwise(other), "j": F.when(y, other).otherwise(own)}).withColumn("i", F.explode("i")).withColumn("j", F.explode("j"))

    def run(key, group):
        w, i, j = (k.as_py() for k in key)
        n, y = group.column("rows")[0].as_py(), group.column("y")
        ry, rp = (_block(group.filter(on), at * block, min((at + 1) * block, n)) for on, at in ((y, i), (pc.invert(y), j)))
        return pa.table({"w": pa.array([w] * B, pa.int64()), "b": pa.array(np.arange(1, B + 1)), "s": pa.array(_permuted(ry, rp, n, block, i, j, B, (seed, w)))})

    dealt = dealt.select("w", "i", "j", "y", "start", "off", "rows", "blob").repartition(tasks, "w", "i", "j")
    sums = dealt.groupBy("w", "i", "j").applyInArrow(run, "w long, b long, s double")
    sums = sums.join(pairs.select(*g, "w", "hy", "hp"), "w").groupBy(*keys, "hy", "hp", "b").agg(F.sum("s").alias("s"))
    n, off, mean = F.col("n"), F.col("off"), (F.sum("n") + 1) / 2.0
    spread = (F.sum(F.col("r2") + 2 * off * F.col("r1") + n * off * off) / F.sum("n") - mean * mean).alias("v")
    m = lines.groupBy("h").agg(F.sum("n").alias("n"), mean.alias("mean"), spread)
    m = m.select("h", "n", "mean", F.when(F.col("v") > TRACE * F.col("mean") * F.col("mean"), F.col("v")).alias("v"))
    side = lambda x: m.select(F.col("h").alias(f"h{x}"), F.col("n").alias(f"n{x}"), F.col("mean").alias(f"m{x}"), F.col("v").alias(f"v{x}"))
    rho = (F.col("s") / F.col("ny") - F.col("my") * F.col("mp")) / F.sqrt(F.col("vy") * F.col("vp"))
    return sums.join(side("y"), "hy").join(side("p"), "hp").select(*keys, F.col("b").alias("perm_id"), rho.alias("perm_spearman"))
