"""Manifest of read files per sample and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cols import any_of

# Endings, read tags, scores and rule names.
EXTS = [".fq", ".fastq", ".fq.gz", ".fastq.gz"]
TAGS = ["_R1", "_1", ".R1", ".1"]


def list_files(spark: SparkSession, root: str, source_dir: str) -> DataFrame:
    """path, size and depth below the root; file contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    rel = F.regexp_replace("path", "^.*" + root.rstrip("/").replace(".", "\\.") + "/", "")
    return f.select("path", "size", F.size(F.split(rel, "/")).alias("depth"), F.lit(source_dir).alias("source_dir"))


def build_manifest(samples: DataFrame, files: DataFrame, prefer: list[str] = ("trimmed", "raw"), keep: int | None = None) -> DataFrame:
    """Candidates whose name starts with the file id or sample name, scored; the first folder with any wins. ``keep`` limits ``all_matches``.

    A name meets the ids through its prefixes (at most its length many), an equi join instead of a nested loop.
    """
    name = F.regexp_extract("path", "([^/]+)$", 1)
    f = files.withColumn("name", name).where(any_of(F.col("name").endswith(e) for e in EXTS))
    pre = f.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.left("name", i))))
    ids = samples.select("file_id", "sample_name", F.explode(F.array_distinct(F.array("file_id", "sample_name"))).alias("key"))
    c = pre.join(ids, "key").drop("key").distinct()
    fid, sn, nm = F.col("file_id"), F.col("sample_name"), F.col("name")
    is_any = lambda stem, tags: any_of(nm == F.concat(stem, F.lit(t + e)) for t in tags for e in EXTS)
    part = lambda stem, a, b: F.when(nm.startswith(stem), a).when(nm.contains(stem), b).otherwise(0)
    score = (part(fid, 8000, 7000) + part(sn, 6000, 5000) + F.when(is_any(fid, TAGS), 7500).otherwise(0) + F.when(is_any(sn, TAGS), 6500).otherwise(0)
             - F.col("depth") * 10 + F.floor(F.least(F.col("size"), F.lit(10000000)) / 1000000))
    root = F.col("depth") == 1
    score = F.when(root & is_any(fid, [""]), 10000).when(root & is_any(sn, [""]), 9500).otherwise(score)
    rule = (F.when(is_any(fid, [""]), "exact_file_id").when(is_any(sn, [""]), "exact_sample_name").when(is_any(fid, TAGS), "exact_file_id_tag").when(is_any(sn, TAGS), "exact_sample_name_tag")
            .when(nm.startswith(fid), "glob_startswith_file_id").when(nm.contains(fid), "glob_contains_file_id").when(nm.startswith(sn), "glob_startswith_sample_name").otherwise("glob_contains_sample_name"))
    place = F.array_position(F.array(*[F.lit(p) for p in prefer]), F.col("source_dir"))
    pref = F.when(place > 0, place).otherwise(len(prefer) + 1)   # folders that aren't listed come last
    c = c.withColumns({"score": score.cast("long"), "match_rule": rule, "_p": pref})
    first = c.groupBy("file_id").agg(F.min("_p").alias("_p"))
    c = c.join(first, ["file_id", "_p"])
    n = c.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_matches"))
    top = c.withColumn("_r", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("score"), "path")))   # the few files of one id
    top = top if keep is None else top.where(F.col("_r") <= keep)
    g = top.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "path"))), lambda x: x.path).alias("all_matches"),
                                   *[F.max(F.when(F.col("_r") == 1, F.col(x))).alias(y) for x, y in (("path", "fastq_path"), ("source_dir", "source_dir"), ("match_rule", "match_rule"))])
    j = samples.join(g.join(n, "file_id"), "file_id", "left").fillna(0, ["n_matches"])
    return j.withColumns({"input_type": F.lit("SE_FASTQ"), "status": F.when(F.col("n_matches") == 0, "MISSING").when(F.col("n_matches") > 1, "AMBIGUOUS").otherwise("OK")})


def audit_manifest(manifest: DataFrame, files: DataFrame, first_records: DataFrame | None = None) -> DataFrame:
    """Problems per sample: missing row, path not found, path shared by several ids, malformed first record.

    ``first_records``: path, header, seq, plus, qual of the first record of each file.
    """
    out = manifest.where((F.col("status") == "MISSING") | F.col("fastq_path").isNull()).select("file_id", F.lit("missing").alias("problem"))
    have = manifest.where(F.col("fastq_path").isNotNull())
    out = out.unionByName(have.join(files.select(F.col("path").alias("fastq_path")), "fastq_path", "left_anti").select("file_id", F.lit("path_not_found").alias("problem")))
    shared = have.groupBy("fastq_path").agg(F.countDistinct("file_id").alias("_n")).where("_n > 1").select("fastq_path")
    out = out.unionByName(have.join(shared, "fastq_path", "left_semi").select("file_id", F.lit("shared_path").alias("problem")))
    if first_records is not None:
        r = first_records.withColumnRenamed("path", "fastq_path")
        bad = (F.when(~F.col("header").startswith("@"), "line1_not_header(@)").when(~F.col("plus").startswith("+"), "line3_not_plus(+)").when(F.length("seq") != F.length("qual"), "seq_qual_length_mismatch"))
        out = out.unionByName(have.join(r, "fastq_path").select("file_id", bad.alias("problem")).where(F.col("problem").isNotNull()))
    return out
