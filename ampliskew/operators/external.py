"""External abundance tables: cycles, baseline pairs, fold changes, id mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_facts
from ..functions import seq as sq
from ..functions.cols import c
from .dataset import split_by_hash
from .reads import clean_token, looks_like_seq

# Recognised column names of long tables.
SEQ_NAMES = ["sequence", "seq", "seq_id", "scaffold", "id"]
EXP_NAMES = ["experiment", "exp", "sample", "condition"]
VAL_NAMES = ["abundance", "count", "reads", "value"]


def to_long(df: DataFrame) -> DataFrame:
    """A10: long or wide table -> raw_id, experiment, value; blanks and zeros leave, repeats are summed."""
    low = {x.strip().lower(): x for x in df.columns}
    pick = lambda names: next((low[n] for n in names if n in low), None)
    s, e, v = pick(SEQ_NAMES), pick(EXP_NAMES), pick(VAL_NAMES)
    if s and e and v:
        d = df.select(F.col(s).alias("raw_id"), F.trim(e).alias("experiment"), F.col(v).try_cast("double").alias("value"))
    else:
        first, exps = df.columns[0], df.columns[1:]
        d = df.select(F.col(first).alias("raw_id"), *[F.col(f"`{x}`").try_cast("double").alias(x) for x in exps]).unpivot("raw_id", exps, "experiment", "value")
    return d.where("value <> 0").groupBy("raw_id", "experiment").agg(F.sum("value").alias("value"))


def parse_cycle(x, exact: bool = False) -> Column:
    """PCR0*<n> as the whole name, or PCR<n> anywhere (a stand-alone one first)."""
    s = c(x)
    num = lambda p, g=1: F.regexp_extract(s, p, g).try_cast("int")
    if exact:
        return num("^PCR0*([0-9]+)$")
    return F.coalesce(num("(?i)(?:^|[^A-Za-z0-9])PCR([0-9]+)(?:$|[^A-Za-z0-9])"), num("(?i)PCR([0-9]+)"))


def baseline_pairs(exps: DataFrame, mode: str = "vs_baseline", baseline: str | None = None, exact: bool = False) -> DataFrame:
    """baseline = named, else lowest cycle, else first name; every other experiment against it (or only the last).

    ``exps``: dataset, experiment; a few experiments per dataset.
    """
    e = exps.select("dataset", "experiment").distinct().withColumn("cycle", parse_cycle("experiment", exact))
    first = F.struct((F.col("experiment") != F.lit(baseline or "")).cast("int"), F.col("cycle").isNull().cast("int"), F.col("cycle"), F.col("experiment"))
    base = e.groupBy("dataset").agg(F.min_by(F.struct(F.col("experiment").alias("exp_no"), F.col("cycle").alias("cycle_no")), first).alias("_b")).select("dataset", "_b.*")
    p = e.join(base, "dataset").where(F.col("experiment") != F.col("exp_no"))
    p = p.select("dataset", F.col("experiment").alias("exp_yes"), "exp_no", F.col("cycle").alias("cycle_yes"), "cycle_no", (F.col("cycle") - F.col("cycle_no")).alias("cycle_delta"),
                 F.concat("dataset", F.lit("__"), "experiment", F.lit("_vs_"), "exp_no").alias("compare_id"))
    if mode == "max_vs_min":
        w = Window.partitionBy("dataset").orderBy(F.desc_nulls_last("cycle_yes"), F.desc("exp_yes"))
        p = p.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return p


def _both_sides(ab: DataFrame, pairs: DataFrame) -> DataFrame:
    """compare_id, seq_id, count_yes, count_no, total_yes, total_no for sequences present on either side."""
    tot = ab.groupBy("dataset", "experiment").agg(F.sum("value").alias("_t"))
    side = F.explode(F.array(F.struct(F.col("exp_yes").alias("experiment"), F.lit(True).alias("yes")), F.struct(F.col("exp_no").alias("experiment"), F.lit(False).alias("yes"))))
    p = pairs.select("dataset", "compare_id", side.alias("s")).select("dataset", "compare_id", "s.*")
    v = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("value"))), F.lit(0.0))
    t = p.join(tot, ["dataset", "experiment"]).groupBy("compare_id", "dataset").agg(F.max(F.when(F.col("yes"), F.col("_t"))).alias("total_yes"), F.max(F.when(~F.col("yes"), F.col("_t"))).alias("total_no"))
    p = p.join(t, ["compare_id", "dataset"])   # totals ride along with the sides, so data rows are dealt once, by comparison and sequence
    return (join_facts(ab, p, ["dataset", "experiment"], "seq_id").groupBy("compare_id", "dataset", "total_yes", "total_no", "seq_id")
            .agg(v(F.col("yes")).alias("count_yes"), v(~F.col("yes")).alias("count_no")))


def external_log2fc(ab: DataFrame, pairs: DataFrame, sequences: DataFrame | None = None, eps: float = 1e-12, clip: float = 6.0) -> DataFrame:
    """log2((rel_yes + eps) / (rel_no + eps)) clipped to +-clip; empty totals count as 1.

    ``sequences`` (dataset, seq_id) makes the result dense: designed sequences seen on neither side appear with 0.
    """
    d = _both_sides(ab, pairs)
    if sequences is not None:
        dense = sequences.select("dataset", "seq_id").distinct().join(pairs.select("dataset", "compare_id"), "dataset")
        tot = d.select("compare_id", "total_yes", "total_no").distinct()
        d = dense.join(d.drop("dataset", "total_yes", "total_no"), ["compare_id", "seq_id"], "left").join(tot, "compare_id", "left").fillna(0.0, ["count_yes", "count_no"])
    t = lambda x: F.when(F.coalesce(F.col(x), F.lit(0.0)) > 0, F.col(x)).otherwise(1.0)
    ry, rn = F.col("count_yes") / t("total_yes"), F.col("count_no") / t("total_no")
    y = F.log2((ry + eps) / (rn + eps))
    return d.withColumns({"rel_yes": ry, "rel_no": rn, "log2fc": F.greatest(F.lit(-clip), F.least(F.lit(clip), y))})


def external_training(ab: DataFrame, pairs: DataFrame, feats: DataFrame, min_support: float = 1.0, mode: str = "sum", eps: float = 1e-12, seed: int = 1) -> DataFrame:
    """Sequences with features on either side that pass the support rule, with fold change and md5 split."""
    d = _both_sides(ab, pairs).where("total_yes > 0 AND total_no > 0")
    y, n = F.col("count_yes"), F.col("count_no")
    ok = {"both": (y >= min_support) & (n >= min_support), "any": (y >= min_support) | (n >= min_support), "sum": y + n >= min_support}[mode]
    if min_support > 0:
        d = d.where(ok)
    d = d.withColumns({"rel_yes": y / F.col("total_yes"), "rel_no": n / F.col("total_no")})
    d = d.withColumn("log2fc", F.log2((F.col("rel_yes") + eps) / (F.col("rel_no") + eps)))
    return split_by_hash(d.join(feats, "seq_id"), "seq_id", seed=seed)


def external_catalog(ab: DataFrame) -> DataFrame:
    """Experiments, sequences and cycle order per dataset."""
    e = ab.groupBy("dataset", "experiment").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total")).withColumn("cycle", parse_cycle("experiment"))
    return e.withColumn("cycle_order", F.dense_rank().over(Window.partitionBy("dataset").orderBy(F.asc_nulls_last("cycle"))))


def pair_summary(training: DataFrame) -> DataFrame:
    """E17."""
    return training.groupBy("dataset", "compare_id").agg(F.count(F.lit(1)).alias("rows"), F.max("total_yes").alias("total_yes"), F.max("total_no").alias("total_no"))


def map_external_ids(rows: DataFrame, catalog: DataFrame, mapping: DataFrame) -> DataFrame:
    """Raw id -> catalogue id directly, through (raw_id, sequence), or by the md5 of a raw id that is a sequence.

    ``catalog``: seq_id, sequence. Unmatched rows keep NULL in ``seq_id`` and ``how``.
    """
    norm = lambda x: F.md5(F.replace(sq.clean(clean_token(x)), F.lit(" "), F.lit("")))
    by_md5 = catalog.select(norm("sequence").alias("_m"), F.col("seq_id").alias("_id"))
    via = mapping.select(clean_token("raw_id").alias("_raw"), norm("sequence").alias("_m")).join(by_md5, "_m").groupBy("_raw").agg(F.min("_id").alias("_via"))
    d = rows.withColumn("_x", clean_token("raw_id")).withColumn("_h", F.when(looks_like_seq(F.col("_x")), norm("_x")))
    d = d.join(catalog.select(F.col("seq_id").alias("_direct")).distinct(), F.col("_x") == F.col("_direct"), "left")
    d = d.join(via, F.col("_x") == F.col("_raw"), "left").join(by_md5.groupBy("_m").agg(F.min("_id").alias("_own")), F.col("_h") == F.col("_m"), "left")
    how = F.when(F.col("_direct").isNotNull(), "direct").when(F.col("_via").isNotNull(), "mapping").when(F.col("_own").isNotNull(), "sequence")
    return d.withColumns({"seq_id": F.coalesce("_direct", "_via", "_own"), "how": how}).drop("_x", "_h", "_direct", "_raw", "_via", "_m", "_own")


def best_mapping(ids: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mapping file with the largest share of the probed ids. ``mappings``: mapping_file, raw_id."""
    probe = ids.select("raw_id").distinct()
    n = probe.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    o = probe.join(mappings.select("mapping_file", "raw_id").distinct(), "raw_id").groupBy("mapping_file").agg(F.count(F.lit(1)).alias("overlap")).withColumn("_one", F.lit(1))
    return o.join(F.broadcast(n), "_one").select("mapping_file", "overlap", (F.col("overlap") / F.col("_n")).alias("share")).orderBy(F.desc("overlap"), "mapping_file").limit(1)
