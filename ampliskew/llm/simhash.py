"""Op 6: SimHash fingerprints, links within a Hamming radius through BK-trees, and components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, build, col, fresh, row_keyed, slices, written
from .components import components

BLANKS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans(UPPER + BLANKS, LOWER + " " * len(BLANKS))
SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 hashes of all word shingles; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").translate(FOLD).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    if len(words) < width:
        return xxh64_intdigest(" ".join(words), SEED)
    columns = [words[i:len(words) - width + 1 + i] for i in range(width)]
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in map(" ".join, zip(*columns))), "<u8", len(columns[0]))
    ones = np.zeros(64, "i8")
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a:a + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col`` and fingerprint (signed 64-bit) of every row; whole texts, nothing is shuffled."""
    src = docs.select(col(id_col).alias("key"), col(text_col).cast("string").alias("text"))

    def run(batches):
        for whole in batches:
            schema = pa.schema([("key", whole.schema.field(0).type), ("fingerprint", pa.int64())])
            for b in slices(whole, 1):
                yield build(schema, b.column(0), np.asarray([fingerprint(t, width) for t in b.column(1).to_pylist()], "<u8").view("<i8"))

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, fingerprint long").withColumnRenamed("key", id_col)


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add_and_find(self, value: int, radius: int) -> list[int]:
        """Places of the values within ``radius``; then the value is added.

        Of a node at distance d only the edges d-radius .. d+radius can lead to hits.
        """
        values, children = self.values, self.children
        place, found = len(values), []
        if place:
            todo = [0]
            while todo:
                node = todo.pop()
                d = (values[node] ^ value).bit_count()
                if d <= radius:
                    found.append(node)
                kids = children[node]
                if kids:
                    todo += [kids[k] for k in range(d - radius, d + radius + 1) if k in kids] if len(kids) > 2 * radius else [c for k, c in kids.items() if -radius <= k - d <= radius]
            node = 0
            while True:
                d = (values[node] ^ value).bit_count()
                nxt = children[node].get(d)
                if nxt is None:
                    children[node][d] = place
                    break
                node = nxt
        values.append(value)
        children.append({})
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``radius`` among distinct values."""
    if len(values) == 2:
        return [(values[0], values[1])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, parent, out = BKTree(), list(range(len(values))), []

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, v in enumerate(values):
        for j in tree.add_and_find(v, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((values[j], v))
    return out


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of all choices of ``blocks - radius`` of equal blocks of the 64 bits: values within ``radius`` agree on one."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(one, blocks - radius)]


def links(distinct: DataFrame, radius: int = 3, blocks: int = 6, value: str = "fingerprint") -> DataFrame:
    """a, b (signed 64-bit): links within ``radius`` that connect what all such links connect.

    Two values within ``radius`` agree on ``blocks - radius`` of the blocks whatever bits differ, so each value goes to
    one shard for each choice of blocks and no link is lost. With 6 blocks and radius 3 these are 20 shards of values
    that share about 32 bits; a shard grows only with values that are alike, not with the corpus, and holds 8 bytes a
    value. Every shard is a BK-tree of its own in the task that its values were shuffled to; it gives a spanning forest
    in place of all its pairs, so output is linear.
    """
    masks = block_masks(radius, blocks)
    signed = [int(np.uint64(m).view("i8")) for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(value).bitwiseAND(F.lit(s)).alias("k")) for i, s in enumerate(signed)]))
    shards = distinct.select(F.col(value).alias("v"), keys.alias("s")).select("s.m", "s.k", "v")
    shards = shards.repartition("m", "k").sortWithinPartitions("m", "k", "v")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held = None
        for b in batches:
            m, k, v = (b.column(i).to_numpy() for i in range(3))
            if held is not None:
                m, k, v = (np.concatenate(x) for x in zip(held, (m, k, v)))
            new = np.flatnonzero((np.diff(m) != 0) | (np.diff(k) != 0)) + 1
            cuts = [0, *new.tolist(), len(v)]
            held = m[cuts[-2]:], k[cuts[-2]:], v[cuts[-2]:]  # the last shard may go on
            yield forest(v, np.asarray(cuts[:-1]))
        if held is not None:
            yield forest(held[2], np.asarray([0, len(held[2])]))

    def forest(v, cuts):
        got = []
        for i in np.flatnonzero(np.diff(cuts) > 1):
            got += shard_links(v[cuts[i]:cuts[i + 1]].view("<u8").tolist(), radius)
        pairs = np.asarray(got, "<u8").reshape(-1, 2).view("<i8")
        return build(schema, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

    return shards.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """``id_col``, fingerprint string (16 hex digits), component_id (smallest id reachable over links, itself included).

    One row per input row. Texts without words (null, empty) have fingerprint zero and link like any other. Rows with
    equal ids each get their own fingerprint; a null id is never the smallest unless all of its component are null.
    Other columns are ignored; an empty table gives an empty one. Copies meet in one fingerprint before any join.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(fps.groupBy("fingerprint").agg(F.min(col(id_col)).alias("least")), "distinct-fingerprints")
    label = components(links(nodes.select("fingerprint"), radius))  # node, component: only of linked nodes
    named = nodes.join(label, nodes["fingerprint"] == label["node"], "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "component").select(F.col("fingerprint").alias("_print"), "component_id")
    out = fps.join(by_print, fps["fingerprint"] == by_print["_print"])
    return out.select(col(id_col), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, stored: bool = False, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest id, of equal ids the first stored.

    Columns stay as they are; ``stored``: see ``row_keyed``. Rows with a null id come before others.
    """
    row, key, dropped = fresh(docs, "row", "key", "dropped_row")
    rows = row_keyed(docs, row, stored)
    keyed = rows.select(F.struct(col(id_col).alias("id"), col(row).alias("row")).alias(key), col(text_col))
    again = near_duplicates(keyed, key, text_col, width, radius).where(col(key) != F.col("component_id")).select(col(key)["row"].alias(dropped))
    return rows.join(again, col(row) == col(dropped), "left_anti").select(*map(col, docs.columns))
