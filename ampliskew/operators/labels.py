"""Annotation and label handling (D01-D17). Rule and alias tables are literals of a few dozen entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import c, number, text_or
from ..functions.ranks import top_per_group

# Alias spellings, canonical labels and merge rules.
DEFAULT_ALIASES = {
    "Canis_lupus_familiaris": "Canis_lupus", "Canis familiaris": "Canis_lupus", "Canis_familiaris": "Canis_lupus", "dog": "Canis_lupus", "Dog": "Canis_lupus",
    "Mus_musculus_domesticus": "Mus_musculus", "Mus musculus domesticus": "Mus_musculus", "Oryctolagus cuniculus": "Oryctolagus_cuniculus",
    "Homo sapiens": "Homo_sapiens", "Bos taurus": "Bos_taurus", "Sus scrofa": "Sus_scrofa", "Equus asinus": "Equus_asinus", "Ovis aries": "Ovis_aries",
    "Capra hircus": "Capra_hircus", "Felis catus": "Felis_catus"}
CANONICAL_ALIASES = {
    "Bos taurus": "Bos_taurus", "Bos_taurus_taurus": "Bos_taurus", "Sus scrofa": "Sus_scrofa", "Sus_scrofa_domesticus": "Sus_scrofa", "Equus asinus": "Equus_asinus",
    "Canis lupus": "Canis_lupus", "Canis_lupus_familiaris": "Canis_lupus", "Canis familiaris": "Canis_lupus", "Felis catus": "Felis_catus", "Homo sapiens": "Homo_sapiens",
    "Mus musculus": "Mus_musculus", "Mus_musculus_domesticus": "Mus_musculus", "Oryctolagus cuniculus": "Oryctolagus_cuniculus", "Ovis aries": "Ovis_aries", "Capra hircus": "Capra_hircus"}
TRINOMIAL = ["Canis_lupus", "Mus_musculus", "Sus_scrofa", "Bos_taurus"]
EXACT_RULES = {"Canis_lupus_familiaris": ("Canis_lupus", "exact_rule:dog_to_wolf")}
NEAR_RULES = {
    "Bos_indicus": ("Bos_taurus", "near_relative_rule:bovid_to_cattle"), "Bos_javanicus": ("Bos_taurus", "near_relative_rule:bovid_to_cattle"),
    "Bison_bonasus": ("Bos_taurus", "near_relative_rule:bovid_to_cattle"), "Bubalus_bubalis": ("Bos_taurus", "near_relative_rule:bovid_to_cattle"),
    "Vulpes_bengalensis": ("Canis_lupus", "near_relative_rule:canid_to_wolf"), "Vulpes_rueppellii": ("Canis_lupus", "near_relative_rule:canid_to_wolf"),
    "Equus_quagga": ("Equus_asinus", "near_relative_rule:equid_to_donkey"), "Ovis_orientalis": ("Ovis_aries", "near_relative_rule:ovis_to_sheep"),
    "Ammotragus_lervia": ("Ovis_aries", "near_relative_rule:caprine_to_sheep"), "Budorcas_taxicolor_whitei": ("Capra_hircus", "near_relative_rule:caprine_to_goat")}
AGGRESSIVE_RULES = {
    "Alces_alces": ("Bos_taurus", "aggressive_rule:ungulate_to_cattle"), "Odocoileus_virginianus": ("Bos_taurus", "aggressive_rule:ungulate_to_cattle"),
    "Rangifer_tarandus": ("Bos_taurus", "aggressive_rule:ungulate_to_cattle"), "Philantomba_monticola": ("Capra_hircus", "aggressive_rule:small_bovid_to_goat"),
    "Diceros_bicornis_minor": ("Bos_taurus", "aggressive_rule:large_ungulate_to_cattle")}
GENUS_TARGETS = {"Bos": "Bos_taurus", "Sus": "Sus_scrofa", "Capra": "Capra_hircus", "Ovis": "Ovis_aries", "Equus": "Equus_asinus", "Felis": "Felis_catus", "Canis": "Canis_lupus",
                 "Mus": "Mus_musculus", "Oryctolagus": "Oryctolagus_cuniculus", "Homo": "Homo_sapiens"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(m, key)


def annotation_candidates(ab: DataFrame, min_count: int = 100, min_rel: float = 0.001, per_marker: bool = False, core_only: bool = False) -> DataFrame:
    """Sequences worth annotating: total >= min_count OR share >= min_rel (a zero share bound keeps everything).

    Most frequent sample and group come from pre-counted (sequence, value) rows, so no list of a hot sequence is formed.
    Rows are grouped by id; the text is attached at the end.
    """
    if core_only:
        ab = ab.where(F.lower("is_core_analysis") == "yes")
    key = (["marker"] if per_marker else []) + ["seq_id"]
    text = ab.groupBy("seq_id").agg(F.first("sequence").alias("sequence"))   # the only shuffle of sequence text
    g = ab.groupBy(*key).agg(F.sum("count").alias("total_count"), F.countDistinct("sample_id").alias("n_samples"), F.max("relative_abundance").alias("max_rel_abundance"))
    g = g.where((F.col("total_count") >= min_count) | (F.col("max_rel_abundance") >= min_rel))

    def mode(col, out):
        n = ab.groupBy(*key, col).agg(F.count(F.lit(1)).alias("_n"))
        return n.groupBy(*key).agg(F.min(F.struct(-F.col("_n"), F.col(col).alias("v")))["v"].alias(out))

    seen = "sample_type" if per_marker else "marker"
    lists = ab.select(*key, seen).distinct().groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(seen)), ",").alias("sample_types" if per_marker else "markers_seen"))
    out = g.join(mode("sample_id", "top_sample"), key).join(mode("group_name", "top_group"), key).join(lists, key).join(text, "seq_id")
    out = out.select(*key, "sequence", *[x for x in out.columns if x not in (*key, "sequence")])
    return out if per_marker else out.withColumns({"species_label": F.lit(""), "annotation_status": F.lit("pending"), "is_target_candidate": F.lit("")})


def best_hits(hits: DataFrame) -> DataFrame:
    """Best line per (marker, query) by bitscore, identity, coverage, length; the nullable name is the first non-null in that order."""
    order = F.struct(*[F.coalesce(F.col(x), F.lit(float("-inf"))).alias(x) for x in ("bitscore", "pident", "qcovs", "length")], F.col("sseqid").alias("_id"))
    g = hits.groupBy("marker", "qseqid").agg(F.max_by(F.struct("sseqid", "pident", "qcovs", "bitscore", "length"), order).alias("_b"),
                                             F.max_by("sscinames", F.when(F.col("sscinames").isNotNull(), order)).alias("sscinames"))
    return g.select("marker", "qseqid", "_b.*", "sscinames")


def species_from_hit(x="sseqid", sep: str = "\\|", idx: int = 0) -> Column:
    """D04."""
    return F.trim(F.coalesce(F.get(F.split(c(x), sep), F.lit(idx)), c(x)))


def hit_tier(pident="pident", qcovs="qcovs") -> Column:
    """D05."""
    p, q = c(pident), c(qcovs)
    return (F.when((p >= 99) & (q >= 95), "high_confidence").when((p >= 97) & (q >= 90), "medium_confidence").when((p >= 95) & (q >= 80), "low_confidence").otherwise("unresolved"))


def annotate(queries: DataFrame, best: DataFrame) -> DataFrame:
    """D06."""
    b = best.withColumns({"species_label": species_from_hit(), "annotation_status": hit_tier()}).withColumnRenamed("qseqid", "seq_id")
    j = queries.join(b, ["marker", "seq_id"], "left")
    return j.withColumns({"notes": F.when(F.col("sseqid").isNull(), "No BLAST hit under current database/threshold").otherwise(""), "species_label": F.coalesce("species_label", F.lit("UNANNOTATED")),
                          "annotation_status": F.coalesce("annotation_status", F.lit("unresolved"))})


def annotation_status(ann: DataFrame) -> DataFrame:
    """D07."""
    return ann.groupBy("marker", "annotation_status").agg(F.countDistinct("seq_id").alias("n_sequences"), F.sum("total_count").alias("total_count"))


def merge_annotation(ab: DataFrame, ann: DataFrame, order: str = "line_no") -> DataFrame:
    """First annotation per sequence, blanks to defaults."""
    a = ann.groupBy("seq_id").agg(F.min_by(F.struct("species_label", "annotation_status"), F.col(order)).alias("_a")).select("seq_id", "_a.*")
    return ab.join(a, "seq_id", "left").withColumns({"species_label": text_or("species_label", "UNANNOTATED"), "annotation_status": text_or("annotation_status", "unannotated")})


def annotation_coverage(merged: DataFrame) -> DataFrame:
    """D09."""
    return merged.groupBy("seq_id", "species_label", "annotation_status").agg(F.sum("count").alias("total_count"), F.countDistinct("sample_id").alias("n_samples"))


def normalize_label(x) -> Column:
    """D10."""
    s = F.regexp_replace(F.trim(c(x)), "[;|]+$", "")
    s = F.regexp_replace(F.regexp_replace(F.replace(s, F.lit("-"), F.lit("_")), "\\s+", "_"), "_+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def harmonize_label(x, aliases: dict[str, str] | None = None) -> Column:
    """Alias of the raw text, alias of the normalised text, else the normalised text; own aliases override defaults."""
    table = {**DEFAULT_ALIASES, **(aliases or {})}
    raw, step = F.trim(c(x)), normalize_label(x)
    return F.when(raw == "", raw).otherwise(F.coalesce(_lookup(table, raw), _lookup(table, step), step))


def basic_label(x) -> Column:
    """Separators to one underscore, parentheses out, Genus_species casing."""
    s = F.regexp_replace(F.trim(c(x)), "[ \\t/|:-]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_+|_+$", "")
    s = F.regexp_replace(F.regexp_replace(s, "\\(.*?\\)", ""), "^[_ ]+|[_ ]+$", "")
    s = F.regexp_replace(s, "_+", "_")
    cased = F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2))))
    t = F.trim(c(x))
    return F.when(F.lower(t).isin("", "nan", "none"), t).otherwise(cased)


def unify_label(x) -> Column:
    """struct(label, rule)."""
    raw = F.coalesce(c(x), F.lit(""))
    basic = basic_label(raw)
    compact = {k.replace(" ", "").replace("_", "").lower(): v for k, v in reversed(list(CANONICAL_ALIASES.items()))}
    hit, hit2 = _lookup(CANONICAL_ALIASES, basic), _lookup(compact, F.lower(F.regexp_replace(raw, "[\\s_]+", "")))
    out = F.struct(basic.alias("label"), F.lit("basic_normalize").alias("rule"))
    for t in TRINOMIAL:
        out = F.when(basic.startswith(t + "_"), F.struct(F.lit(t).alias("label"), F.lit("trinomial_to_binomial").alias("rule"))).otherwise(out)
    out = F.when(hit2.isNotNull(), F.struct(hit2.alias("label"), F.lit("alias_map_compact").alias("rule"))).otherwise(out)
    return F.when(hit.isNotNull(), F.struct(hit.alias("label"), F.lit("alias_map").alias("rule"))).otherwise(out)


def unify_to_targets(ann: DataFrame, expected: DataFrame, aggressive: bool = False) -> DataFrame:
    """Rule cascade towards the expected targets, with the reason."""
    t = expected.select(F.trim("target_label").alias("_t")).distinct()
    d = ann.withColumns({"species_label_original": F.col("species_label"), "_l": F.trim("species_label")}).join(t, F.col("_l") == F.col("_t"), "left")
    lab = F.col("_l")
    genus = F.split_part("_l", F.lit("_"), F.lit(1))
    pair = lambda a, b: F.struct(a.alias("label"), b.alias("reason"))
    out = pair(lab, F.lit("kept_as_original"))
    rule = lambda rules: ({k: v[0] for k, v in rules.items()}, {k: v[1] for k, v in rules.items()})

    def apply(rules, out):
        to, why = rule(rules)
        return F.when(_lookup(to, lab).isNotNull(), pair(_lookup(to, lab), _lookup(why, lab))).otherwise(out)

    if aggressive:
        out = apply(AGGRESSIVE_RULES, out)
    out = F.when(_lookup(GENUS_TARGETS, genus).isNotNull(), pair(_lookup(GENUS_TARGETS, genus), F.concat(F.lit("genus_fallback:"), genus))).otherwise(out)
    out = apply(EXACT_RULES, apply(NEAR_RULES, out))
    out = F.when(F.col("_t").isNotNull(), pair(lab, F.lit("already_expected_target"))).otherwise(out)
    out = F.when(F.coalesce(lab, F.lit("")) == "", pair(F.lit("UNANNOTATED"), F.lit("empty_label"))).otherwise(out)
    d = d.withColumn("_o", out).withColumns({"species_label": F.col("_o.label"), "label_unify_reason": F.col("_o.reason")})
    changed = ~F.col("species_label_original").eqNullSafe(F.col("species_label"))
    return d.withColumn("annotation_status", F.when(changed, "standardized_label").otherwise(F.col("annotation_status"))).drop("_l", "_t", "_o")


def label_changes(df: DataFrame, before: str, after: str, source: str = "annotation") -> DataFrame:
    """Distinct changes."""
    return (df.where(~F.col(before).eqNullSafe(F.col(after))).select(F.lit(source).alias("source"), F.col(before).alias("before"), F.col(after).alias("after")).distinct())


def label_inventory(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Distinct non-blank labels per source."""
    out = None
    for name, (df, col) in tables.items():
        d = df.select(F.lit(name).alias("source"), F.trim(col).alias("label")).where("label <> ''").distinct()
        out = d if out is None else out.unionByName(d)
    return out


def harmonization_summary(before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """One row."""
    tag = lambda d, k: d.select(F.lit(k).alias("_k"), *[F.col(x) for x in d.columns if x == "label"])
    u = tag(before, "b").unionByName(tag(after, "a")).unionByName(tag(changes, "c"), allowMissingColumns=True)
    n = lambda k: F.countDistinct(F.when(F.col("_k") == k, F.col("label")))
    return u.agg(n("b").alias("n_unique_before"), n("a").alias("n_unique_after"), F.count(F.when(F.col("_k") == "c", 1)).alias("n_changes"))


def expected_coverage(expected: DataFrame, ann: DataFrame) -> DataFrame:
    """Expected rows flagged by presence of their label in the annotation."""
    have = ann.select(F.trim("species_label").alias("target_label")).where("target_label <> ''").distinct().withColumn("_p", F.lit(True))
    return expected.join(have, "target_label", "left").withColumn("present", F.coalesce("_p", F.lit(False))).drop("_p")


def missing_labels(expected: DataFrame, ann: DataFrame) -> DataFrame:
    """D15."""
    return expected.join(ann.select(F.trim("species_label").alias("target_label")), "target_label", "left_anti")


def mapping_report(unified: DataFrame) -> DataFrame:
    """Counts that do not parse are 0."""
    return unified.groupBy("species_label_original", "species_label", "label_unify_reason").agg(F.countDistinct("seq_id").alias("n_sequences"), F.sum(F.coalesce(number("total_count"), F.lit(0.0))).alias("total_count"))


def target_coverage(unified: DataFrame, expected: DataFrame) -> DataFrame:
    """D17."""
    t = expected.select(F.trim("target_label").alias("species_label")).distinct().withColumn("_p", F.lit(1))
    d = unified.join(t, "species_label", "left").withColumn("is_expected_target", F.coalesce("_p", F.lit(0)))
    return d.groupBy("marker", "is_expected_target").agg(F.countDistinct("seq_id").alias("n_sequences"), F.sum(F.coalesce(number("total_count"), F.lit(0.0))).alias("total_count")).withColumn(
        "class", F.when(F.col("is_expected_target") == 1, "expected_target").otherwise("other_label"))


def unmatched(unified: DataFrame, expected: DataFrame) -> DataFrame:
    """D17."""
    return unified.join(expected.select(F.trim("target_label").alias("species_label")), "species_label", "left_anti").orderBy(F.desc_nulls_last(number("total_count")), "seq_id")
