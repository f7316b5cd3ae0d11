"""Op 4: benchmark decontamination by token windows, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, fresh, row_keyed, written

#: Code points that part words: ASCII other than digits and letters.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
GAP, WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: 64-bit words of the filter that goes to every task: 64 KiB, whatever the benchmark.
FILTER_WORDS = 1 << 13
#: Benchmark windows up to which their texts are broadcast (about 100 bytes each); beyond it the join is shuffled.
BROADCAST_WINDOWS = 200_000


def token_array(text) -> Column:
    """Lower-cased words; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), PARTS), lambda w: w != "")


def benchmark_windows(items: DataFrame, width: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """size, hash, window (text), items (ids as strings): every distinct window of the items; an item with fewer words, but not none, is one window."""
    words = items.select(col(id_col).cast("string").alias("item"), token_array(col(text_col)).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(width))
    each = words.select("item", "words", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at"))
    each = each.select("item", "size", F.slice("words", F.col("at"), F.col("size")).alias("part"))
    hashed = F.xxhash64(F.transform("part", lambda w: F.xxhash64(w)))
    return each.groupBy("size", hashed.alias("hash"), F.array_join("part", " ").alias("window")).agg(F.collect_set("item").alias("items"))


def filter_words(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FILTER_WORDS longs of a Bloom filter with one bit a window, and the window sizes; one row each."""
    place = F.col("hash").bitwiseAND(F.lit(FILTER_WORDS * 64 - 1))
    used = windows.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    dense = windows.sparkSession.range(0, FILTER_WORDS, 1, 1).select(F.col("id").cast("int").alias("word")).join(used, "word", "left")
    bits = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("bits"))
    return bits, windows.agg(F.array_sort(F.collect_set("size")).alias("sizes"))


def hits(docs: DataFrame, windows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, n_words, at (1-based word), size, items: a line for each verified window in a document, one line without ``at`` for a document without.

    In each row the words' hashes are taken once, each window's hash from them, and the filter is asked inside the row,
    so only windows that pass it are exploded, with their text; the join on the text then removes what the filter let
    through by chance.
    """
    bits, sizes = (f.scalar() for f in filter_words(windows))
    df = docs.select(*keys, token_array(col(text_col)).alias("_words"))
    df = df.select(*keys, "_words", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"), bits.alias("_bits"), sizes.alias("_sizes"))

    def passes(h: Column) -> Column:
        place = h.bitwiseAND(F.lit(FILTER_WORDS * 64 - 1))
        word = F.get("_bits", F.shiftright(place, 6).cast("int"))
        return F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1

    def of_size(size: Column) -> Column:
        starts = F.when(F.size("_hashes") >= size, F.sequence(F.lit(1), F.size("_hashes") - size + 1)).otherwise(F.array().cast("array<int>"))
        hashed = F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("_hashes", i, size)).alias("hash")))
        found = F.filter(hashed, lambda x: passes(x["hash"]))
        return F.transform(found, lambda x: F.struct(x["at"].alias("at"), F.array_join(F.slice("_words", x["at"], size), " ").alias("window")))

    found = df.select(*keys, F.size("_words").cast("long").alias("n_words"), F.explode_outer(F.flatten(F.transform("_sizes", of_size))).alias("_hit"))
    found = found.select(*keys, "n_words", F.col("_hit.at").alias("at"), F.col("_hit.window").alias("_window"))
    known = windows.select("window", "size", "items")
    if windows.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    return found.join(known, found["_window"] == known["window"], "left").select(*keys, "n_words", F.when(F.col("size").isNotNull(), F.col("at")).alias("at"), "size", "items")


def judged(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_words, n_hit, n_items, items_sha256, contaminated, spans (array of at and after, merged)."""
    found = lines.groupBy(*keys).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", (F.col("at") + F.col("size")).alias("after"))))).alias("_all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    span = "struct<at:int,after:int>"
    merged = F.aggregate("_all", F.array().cast(f"array<{span}>"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["after"] >= x["at"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["at"].alias("at"), F.greatest(F.try_element_at(acc, F.lit(-1))["after"], x["after"]).alias("after")))),
    ).otherwise(F.concat(acc, F.array(x))))
    found = found.select(*keys, "n_words", merged.cast(f"array<{span}>").alias("spans"), "_items")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["after"] - x["at"])
    found = found.withColumn("n_hit", n_hit)
    return found.select(*keys, "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
                        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans")


def without_spans(text, spans) -> Column:
    """The text without the words of ``spans`` and what follows each of them up to the next word."""
    token = F.regexp_extract_all(text, F.lit(f"^{GAP}+|{WORD}+{GAP}*"), F.lit(0))
    lead = F.when(text.rlike(f"^{GAP}"), 1).otherwise(0)
    kept = F.filter(token, lambda t, i: ~F.exists(spans, lambda s: (i + 1 - lead >= s["at"]) & (i + 1 - lead < s["after"])))
    return F.array_join(kept, "")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id_col``, n_words, n_hit, n_items, items_sha256, contaminated, spans (hit words: at, after) of every row.

    A word is hit if it lies in any occurrence of a benchmark window. Null and empty texts have no words and are clean;
    rows with equal or null ids are judged each for itself; an empty benchmark finds nothing; other columns are ignored.
    To the tasks go a filter of fixed size and, where they are no more than BROADCAST_WINDOWS, the windows.
    """
    windows = written(benchmark_windows(benchmark, width, item_id, item_text), "windows")
    rows = docs.select(col(id_col).alias("_id"), col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    keys = ["_row", "_id"]
    return judged(hits(rows, windows, keys, "_text"), keys).drop("_row").withColumnRenamed("_id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", stored: bool = False, width: int = 13, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without contaminated rows (``documents``), or with the hit words of such rows removed from the text (``spans``).

    Columns stay as they are. ``stored``: see ``row_keyed``. Corner cases as for ``contamination``.
    """
    row, judged_row = fresh(docs, "row", "judged_row")
    rows = row_keyed(docs, row, stored)
    found = contamination(rows, benchmark, width, row, text_col, item_id, item_text).where("contaminated").select(col(row).alias(judged_row), F.col("spans").alias("_spans"))
    if action == "documents":
        return rows.join(found, col(row) == col(judged_row), "left_anti").select(*map(col, docs.columns))
    spans, = fresh(rows, "spans")
    out = rows.join(found.select(judged_row, F.col("_spans").alias(spans)), col(row) == col(judged_row), "left")
    cut = F.when(col(judged_row).isNotNull(), without_spans(col(text_col), col(spans))).otherwise(col(text_col))
    return out.select(*(cut.alias(c) if c == text_col else col(c) for c in docs.columns))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS size, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT size FROM bw
), dw AS (
  SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, sizes WHERE len(ws) >= size)
), hit AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN pos ON w.doc_id = pos.doc_id LEFT JOIN its ON w.doc_id = its.doc_id
"""
