"""Op 11: spelling variants of a vocabulary through a bit-sliced position index."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC_SQL, build, col, crc_sql, slices, whole_groups, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Letters at either end that one of two near words of MIN_LETTERS or more keeps whatever the error is.
END, MIN_LETTERS = 3, 6
#: Words of a shard beyond which it is cut by halves of its words; words so long are always cut so.
SHARD, LONG = 8192, 64
#: Query words whose bitsets are kept at once.
QUERIES = 1024


def run_counts(docs: DataFrame, id_col: str, text_col: str, min_letters: int, one_in: int) -> DataFrame:
    """word, n: runs of letters of whole texts, counted inside each task before anything is shuffled.

    ``one_in``: a run whose CRC-32, taken with its document's id, it divides loses one code point (0: none does).
    """
    src = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), col(text_col).cast("string").alias("text"))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        seen = Counter()
        for whole in batches:
            for b in slices(whole, 1):
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if not t:
                        continue
                    own = Counter(RUN.findall(t.encode().lower().decode()))  # bytes.lower() knows A-Z only
                    if one_in:
                        start = zlib.crc32(f"{i}:".encode())
                        for w in list(own):
                            h = zlib.crc32(w.encode(), start)
                            if h % one_in == 0:
                                at, n = h % len(w), own.pop(w)
                                seen[w[:at] + w[at + 1:]] += n
                    seen.update(own)
                    if len(seen) > HELD_WORDS:
                        yield counted(seen)
                        seen = Counter()
        yield counted(seen)

    def counted(seen):
        keep = [w for w in seen if len(w) >= min_letters]
        return build(schema, keep, [seen[w] for w in keep])

    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_words(words: list[str], n: np.ndarray, least: int = 0, apart: int = 0, long: int = 0):
    """For each word with near ones: place, how many, and the place of its commonest near word (of equal ones the first).

    Near: exactly one letter inserted, deleted or replaced. ``words`` are distinct and ascend. Each pair of a position and a letter has a
    bitset over all words; all words of a block walk along their letters at once and keep four bitsets each: words equal
    so far, words with one letter replaced, and words one letter shorter or longer so far, which look at the position
    before or after. ``least`` > 0: only pairs whose shorter word has that length. ``apart``: without pairs that agree on
    that many first letters. ``long`` > 0: without pairs of two words of that length.
    """
    k, none = len(words), np.zeros(0, "i8")
    size = np.fromiter(map(len, words), "i8", k)
    codes = np.asarray(words, f"U{size.max()}").view("<u4").reshape(k, -1)
    letters, codes = np.unique(np.hstack([codes, np.zeros((k, 2), "u4")]), return_inverse=True)  # code 0 stands behind the end
    codes = codes.reshape(k, -1)
    lanes = -(-k // 64)

    def bitsets(x: np.ndarray, values: int) -> np.ndarray:
        """One bitset for each value: the words that have it."""
        on = np.zeros((values, 64 * lanes), "u1")
        on[x, np.arange(k)] = 1
        return np.packbits(on, axis=1, bitorder="little").view("<u8")

    of_size = bitsets(size - size.min() + 1, int(size.max() - size.min()) + 3)  # one empty row on either side
    out = []
    order = np.argsort(-size, kind="stable")
    for q in (order[a:a + QUERIES] for a in range(0, k, QUERIES)):
        m = size[q]
        zero = np.full((len(q), lanes), 2**64 - 1, "u8")
        swap, short, more = (np.zeros_like(zero) for _ in range(3))
        before, here, after = None, bitsets(codes[:, 0], len(letters)), bitsets(codes[:, 1], len(letters))
        start = zero
        for i in range(int(m[0]) + 1):
            if i == apart:
                start = zero.copy()
            end = int((m > i).sum())  # longest first: the rest is at its end
            if end < len(zero):
                own, at = m[end:len(zero)], m[end:len(zero)] - size.min() + 1
                same, less = swap[end:] & of_size[at], short[end:] & of_size[at - 1]
                longer = (more[end:] | zero[end:]) & of_size[at + 1]
                if least:
                    same, less, longer = (x & np.where(own == s, np.uint64(2**64 - 1), np.uint64(0))[:, None] for x, s in ((same, least), (less, least + 1), (longer, least)))
                if long:
                    same &= np.where(own == long, np.uint64(0), np.uint64(2**64 - 1))[:, None]
                near = same | less | longer
                if apart:
                    near &= ~start[end:len(zero)]
                row, word = np.nonzero(np.unpackbits(near.view("u1"), axis=1, bitorder="little"))
                if len(row):
                    best = np.lexsort((word, -n[word], row))
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    out.append((q[end:len(zero)][row[first]], np.diff(first, append=len(row)), word[best[first]]))
                zero, swap, short, more = (x[:end] for x in (zero, swap, short, more))
            if not end:
                break
            c = codes[q[:end], i]
            hit = here[c]
            swap = (swap & hit) | (zero & ~hit)
            short = zero if before is None else (short & before[c]) | zero
            more = (more | zero) & after[c]
            zero = zero & hit
            before, here, after = here, after, bitsets(codes[:, min(i + 2, codes.shape[1] - 1)], len(letters))
    return tuple(map(np.concatenate, zip(*out))) if out else (none, none, none)


def shards(words: DataFrame) -> DataFrame:
    """key, least, apart, word, n: words that share an end, so that every pair of near words meets in exactly one shard.

    Two near words agree on the first END letters or, if the error is there, on the last END. Shards of more than SHARD
    words, and words longer than LONG, are cut by the length of a pair's shorter word and by one of its halves, of which
    one has no error. A pair that agrees on both ends counts at the first only.
    """
    size = F.length("word")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("apart"), F.substring("word", 1, END).alias("part")), F.struct(F.lit(END).alias("apart"), F.expr(f"substring(word, -{END})").alias("part"))))
    short = words.where(size <= LONG).select("word", "n", ends.alias("e")).select("word", "n", "e.apart", F.concat_ws("/", F.col("e.apart").cast("string"), "e.part").alias("key"))
    full = short.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > SHARD).select(F.col("key").alias("_full"))
    placed = short.join(full, F.col("key") == F.col("_full"), "left")
    whole = placed.where("_full IS NULL").select("key", F.lit(0).alias("least"), "apart", "word", "n")

    def halves(df: DataFrame, keep) -> DataFrame:
        """Shards inside a shard: of the pair's shorter length ``least`` and its first or second half."""
        d = df.withColumn("least", F.explode(F.array(size, size - 1))).where((F.col("least") >= MIN_LETTERS) & keep)
        cut = F.floor(F.col("least") / 2).cast("int")
        parts = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.expr("substring(word, 1, int(floor(least / 2)))").alias("part")),
                                  F.struct(cut.alias("half"), F.expr("right(word, least - int(floor(least / 2)))").alias("part"))))
        d = d.select("key", "least", "apart", "word", "n", parts.alias("h")).where("apart = 0 OR h.half > 0")
        name = F.concat_ws("/", "key", F.col("least").cast("string"), F.col("h.half").cast("string"), "h.part")
        return d.select(name.alias("key"), "least", F.when(F.col("apart") > 0, F.col("apart")).otherwise(F.col("h.half")).alias("apart"), "word", "n")

    cut = halves(placed.where("_full IS NOT NULL").drop("_full"), F.col("least") < LONG)
    long = words.where(size >= LONG).select("word", "n", F.lit(0).alias("apart"), F.lit("").alias("key"))
    return whole.unionByName(cut).unionByName(halves(long, F.col("least") >= LONG))


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct of -n and word) of the words that have near ones among ``words`` (word, n)."""
    dealt = shards(words).repartition("key").sortWithinPartitions("key", "word")
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])

    def run(batches):
        for b, cuts in whole_groups(batches, "key"):
            words, n, got = b.column("word"), b.column("n").to_numpy(), [np.zeros((3, 0), "i8")]
            for a, z in zip(cuts, cuts[1:]):
                if z - a > 1:
                    least, apart = (b.column(c)[a].as_py() for c in ("least", "apart"))
                    place, near, best = near_words(words.slice(a, z - a).to_pylist(), n[a:z], least, apart, 0 if least else LONG)
                    got.append(np.stack([place + a, near, best + a]))
            place, near, best = np.concatenate(got, axis=1)
            yield build(schema, words.take(pa.array(place)), near, words.take(pa.array(best)), n[best])

    found = dealt.select("key", "least", "apart", "word", "n").mapInArrow(run, "word string, near long, form string, form_n long")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 6, min_n: int = 5, times: int = 5, one_in: int = 0) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of at least ``min_letters`` letters and ``min_n`` occurrences.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. Two are near if they differ by exactly one
    inserted, deleted or replaced letter. A word's form is its near word with the largest n (ties: the first in code-point
    order) if that is at least ``times`` the word's own n, else null; root follows forms to the last one, and is the word
    itself without a form. A form has ``times`` the n at least, so forms make no circles and chains are as short as the
    logarithm of the largest n. Null and empty texts have no words, repeated rows count again, a null id stands as an
    empty one (ids matter with ``one_in`` only, see ``run_counts``), other columns are ignored, an empty table gives an
    empty one.
    """
    if min_letters < MIN_LETTERS or times < 2:
        raise ValueError(f"words need {MIN_LETTERS} letters at least, and times must be 2 or more")
    words = written(run_counts(docs, id_col, text_col, min_letters, one_in).where(F.col("n") >= min_n), "words")
    near = neighbours(words).withColumnRenamed("word", "_word")
    has = -F.col("best.m") >= times * F.col("n")
    full = words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", F.when(has, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, -F.col("best.m")).alias("form_n"))
    full = written(full, "variants")
    jump = full.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    for _ in range(ceil(log(max(2.0, log(most) / log(times) + 1), 2))):  # doubling: a chain has no more steps than the logarithm of the largest n
        far = jump.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        jump = written(jump.join(far, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root")), "roots")
    roots = jump.select(F.col("word").alias("_word"), "root")
    return full.join(roots, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
hexed AS (SELECT run, n, length(run) AS len, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
summed AS (SELECT run, n, len, {crc_sql('x')} AS h FROM hexed, crc_bits),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % len AS BIGINT)) || substring(run, CAST(h % len AS BIGINT) + 2) ELSE run END AS word, n FROM summed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
spelt AS (SELECT word, n, length(word) AS len, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!"#$%&()*+,-./:;<=>?@[]^_`|~') AS w FROM words),
pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM spelt a JOIN spelt b ON left(a.w, 3) = left(b.w, 3) AND abs(a.len - b.len) <= 1 AND levenshtein(a.w, b.w) = 1
  UNION SELECT a.word, a.n, b.word, b.n FROM spelt a JOIN spelt b ON right(a.w, 3) = right(b.w, 3) AND abs(a.len - b.len) <= 1 AND levenshtein(a.w, b.w) = 1),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
forms AS (SELECT words.word, CASE WHEN other_n >= 5 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM words LEFT JOIN best ON words.word = best.word),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL),
roots AS (SELECT walk.word, walk.root FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN roots ON forms.word = roots.word
"""
