"""Table scans, metadata checks and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as sc
from ..functions.cols import blank_to_null, require


def read_table(spark: SparkSession, path, columns: list[str] | None = None, schema: str | None = None, sep: str = "\t") -> DataFrame:
    """TSV/CSV(.gz) with a header, text columns unless a schema is given; blanks are NULL; column subset pruned at the scan."""
    r = spark.read.option("header", True).option("sep", sep).option("nullValue", "")
    df = (r.schema(schema) if schema else r).csv(path)
    return df.select(*columns) if columns else df


def merge_by_id(tables: list[DataFrame], key: str = "seq_id") -> DataFrame:
    """Union of files, one row per id (the first file that has it)."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("_o", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    cols = [x for x in out.columns if x not in (key, "_o")]
    return out.groupBy(key).agg(F.min_by(F.struct(*cols), "_o").alias("_r")).select(key, "_r.*")


def read_samples(spark: SparkSession, path, kind: str = "paired") -> DataFrame:
    """Metadata with required columns checked and numbers typed."""
    req = sc.PAIRED_COLUMNS if kind == "paired" else sc.MIXTURE_REQUIRED
    return typed_samples(require(read_table(spark, path), req, f"{kind} metadata"))


def typed_samples(df: DataFrame) -> DataFrame:
    """Number columns of text metadata; what doesn't parse is NULL."""
    return df.withColumns({x: F.trim(x).try_cast(t) for x, t in sc.NUMERIC.items() if x in df.columns})


def parse_lines(lines: DataFrame, schema: str, sep: str = "\t", line: str = "value") -> DataFrame:
    """The fields of delimited text lines as typed columns behind the other columns of ``lines``; blanks and values that don't parse are NULL."""
    part = F.split(F.col(line), F.lit(sep if sep not in "|." else "\\" + sep), -1)
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return lines.select(*[x for x in lines.columns if x != line], *[blank_to_null(F.get(part, F.lit(i))).try_cast(t).alias(n) for i, (n, t) in enumerate(fields)])


def normalize_pcr(x="pcr") -> Column:
    """Yes / no, NULL when not recognised."""
    v = F.lower(F.trim(F.col(x)))
    return F.when(v.isin(sc.PCR_YES), "yes").when(v.isin(sc.PCR_NO), "no")


def validate_samples(df: DataFrame) -> DataFrame:
    """One row per violation (file_id, problem)."""
    fid, loc = blank_to_null("file_id"), blank_to_null("locus")
    checks = F.array_compact(F.array(F.when(fid.isNull(), "empty file_id"), F.when(loc.isNotNull() & ~loc.isin(sc.VALID_LOCI), "unexpected locus"),
                                     F.when(normalize_pcr().isNull(), "unrecognized pcr")))
    rows = df.select("file_id", F.explode(checks).alias("problem"))
    dup = df.where(fid.isNotNull()).groupBy(fid.alias("file_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("file_id", F.lit("duplicate file_id").alias("problem"))
    return rows.unionByName(dup)


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """Records cut at '\\n>', id = first word of the header, lines joined and upper-cased."""
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path))


def parse_fasta(records: DataFrame) -> DataFrame:
    """seq_id and sequence of records as text (``value``), with or without their leading '>'."""
    t = records.withColumn("value", F.regexp_replace("value", "^>", ""))
    head = F.regexp_extract("value", "^([^\\n\\r]*)", 1)
    body = F.regexp_replace(F.regexp_extract("value", "(?s)^[^\\n]*\\n(.*)$", 1), "\\s", "")
    return t.where(F.length("value") > 0).select(F.regexp_extract(head, "^(\\S*)", 1).alias("seq_id"), F.upper(body).alias("sequence"))


def _from_name(pattern: str) -> Column:
    return F.regexp_extract(F.input_file_name(), pattern, 1)


def parse_fastq(records: DataFrame, value: str = "value") -> DataFrame:
    """Header, upper-case seq, qual and problem (NULL if well formed) of four-line records as text, behind the other columns."""
    part = F.split(F.col(value), "\r?\n", -1)
    at = lambda i: F.get(part, F.lit(i))
    bad = (F.when(F.size(part) < 4, "truncated").when(~at(0).startswith("@"), "line1_not_header(@)").when(~at(2).startswith("+"), "line3_not_plus(+)")
           .when(F.length(at(1)) != F.length(at(3)), "seq_qual_length_mismatch"))
    return records.select(*[x for x in records.columns if x != value], F.regexp_replace(at(0), "^@", "").alias("header"), F.upper(at(1)).alias("seq"), at(3).alias("qual"), bad.alias("problem"))


def marker_of_file(path) -> Column:
    """<marker>.blast.tsv."""
    return F.nullif(F.regexp_extract(path, "([^/]+)\\.blast\\.tsv", 1), F.lit(""))


def split_of_file(path) -> Column:
    """Train, val or test in <name>.<split>.tsv."""
    return F.nullif(F.regexp_extract(path, "\\.(train|val|test)\\.tsv", 1), F.lit(""))


def read_hits(spark: SparkSession, path) -> DataFrame:
    """Tabular hits, marker from <marker>.blast.tsv."""
    return spark.read.schema(sc.HITS).option("sep", "\t").csv(path).withColumn("marker", marker_of_file(F.input_file_name()))


def read_alignment(spark: SparkSession, path, kind: str) -> DataFrame:
    """Depth, pileup or idxstats text with file_id from the file name."""
    return spark.read.schema({"depth": sc.DEPTH, "pileup": sc.PILEUP, "idxstats": sc.IDXSTATS}[kind]).option("sep", "\t").option("quote", "").csv(path).withColumn("file_id", _from_name("([^/.]+)\\.[^/]*$"))


def read_training(spark: SparkSession, path) -> DataFrame:
    """Training chunks; split from the file name, a ``split`` column wins."""
    df = read_table(spark, path)
    named = split_of_file(F.input_file_name())
    return df.withColumn("split", F.coalesce(blank_to_null("split"), named) if "split" in df.columns else named)


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, fmt: str = "csv", mode: str = "error") -> None:
    """TSV.gz with a fixed column order, or Parquet. The order of rows is set by the caller's sort."""
    d = df.select(*columns) if columns else df
    if fmt == "parquet":
        d.write.mode(mode).parquet(path)
    else:
        d.write.mode(mode).csv(path, sep="\t", header=True, compression="gzip")


def write_ordered(df: DataFrame, path: str, by: list[str], columns: list[str] | None = None, rows_per_file: int = 0, mode: str = "error") -> DataFrame:
    """TSV.gz files without headers that are sorted one by one and, by name, one after the other; returns their ranges.

    Rows are range-partitioned by ``by`` (ascending, null first) and, where they tie, by their hash, so a hot value is
    spread over files; each task sorts and writes its range. Ranges: file, n, first and last (structs of ``by``), which
    tell a reader the files that a key can be in.
    """
    d = df.select(*columns) if columns else df
    lost = [x for x in by if x not in d.columns]
    if lost:
        raise ValueError(f"not among the columns: {lost}")
    tie = fresh_name(d, "_tie")
    order = [*map(F.col, by), F.col(tie)]
    d = d.withColumn(tie, F.xxhash64(*d.columns)).repartitionByRange(*order).sortWithinPartitions(*order).drop(tie)
    w = d.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    w.csv(path, sep="\t", header=False, compression="gzip", emptyValue='""', nullValue="")
    back = df.sparkSession.read.schema(d.schema).csv(path, sep="\t", header=False, emptyValue="", nullValue="")
    key = F.struct(*by)
    return (back.groupBy(F.regexp_extract(F.input_file_name(), "([^/]*)$", 1).alias("file"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).orderBy("file"))


def fresh_name(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def table_lines(df: DataFrame, columns: list[str], sep: str = "\t") -> DataFrame:
    """Rows as delimited lines in a fixed column order; NULL is blank."""
    return df.select(F.concat_ws(sep, *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in columns]).alias("value"))


def partition_folder(columns: list[str]) -> Column:
    """The folder below the root that a row is written to."""
    return F.concat_ws("/", *[F.concat(F.lit(f"{x}="), F.coalesce(F.col(x).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for x in columns])


def write_partitioned(df: DataFrame, path: str, columns: list[str], fmt: str = "parquet", mode: str = "error") -> None:
    """One folder per value of ``columns``."""
    df.write.mode(mode).partitionBy(*columns).format(fmt).save(path)


def fasta_lines(df: DataFrame, header: Column | str = "seq_id", seq: str = "sequence") -> DataFrame:
    """A14: '>header' and sequence as one text value."""
    h = F.col(header) if isinstance(header, str) else header
    return df.select(F.concat(F.lit(">"), h, F.lit("\n"), F.col(seq)).alias("value"))


def count_header() -> Column:
    """id|marker=..|total_count=..|max_rel=%.6f|top_group=.."""
    return F.format_string("%s|marker=%s|total_count=%d|max_rel=%.6f|top_group=%s", "seq_id", "marker", "total_count", "max_rel_abundance", "top_group")


def write_fasta(df: DataFrame, path: str, header: Column | str = "seq_id", mode: str = "error") -> None:
    """A14."""
    fasta_lines(df, header).write.mode(mode).text(path)


def kmer_map_to_json(kmers: DataFrame) -> DataFrame:
    """One JSON map per sequence; a map holds the words of one sequence only."""
    return kmers.groupBy("seq_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("kmer", "n")))).alias("kmer_json"))


def kmer_map_from_json(df: DataFrame, col: str = "kmer_json") -> DataFrame:
    """Text that does not parse gives no rows."""
    m = F.from_json(col, "map<string,int>")
    return df.select("seq_id", F.explode(m).alias("kmer", "n"))
