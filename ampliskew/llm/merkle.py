"""Op 13: a Merkle manifest of a dataset as postorder logs of hash trees with 16 children a node.

Nodes of a tree are written in the order in which they are complete: a node follows its last child. After leaf i (from
0) stand i leaves and, for each level k, the floor(i / 16^k) nodes that are complete by then, so the node j of level l,
whose last leaf is e, stands at place e + sum(e // 16^k for k >= 1) + l: no index is kept, siblings are addressed.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_SQL, LOWER, UPPER, ascii_lower, build, col, crc_sql, whole_groups, written

FAN = 16
#: Levels that a builder adds to the aligned run of leaves it is given, and that run's length.
LEVELS, RUN = 3, FAN**3
DIGEST = 32


def place(level: int, j: int, n: int) -> int:
    """Where node ``j`` of ``level`` stands in the postorder log of a tree of ``n`` leaves."""
    e = min((j + 1) * FAN**level, n) - 1
    at, k = e + level, e // FAN
    while k:
        at, k = at + k, k // FAN
    return at


def height(n: int) -> int:
    """Levels above the leaves until one node remains; a lone leaf has none."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def parent(children: list[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def append_log(leaves: list[bytes], levels: int) -> bytes:
    """The nodes of ``levels`` levels over ``leaves`` in the order of completion."""
    log, n = [], len(leaves)
    open_: list[list[bytes]] = [[] for _ in range(levels + 1)]  # children that wait for their parent, by level
    for i, leaf in enumerate(leaves):
        log.append(leaf)
        open_[0].append(leaf)
        for level in range(levels):
            if len(open_[level]) < FAN and i < n - 1:
                break
            node = parent(open_[level])
            open_[level] = []
            log.append(node)
            open_[level + 1].append(node)
    return b"".join(log)


def siblings(log: bytes, i: int, n: int, levels: int) -> list[bytes]:
    """For each level the hex digests left and right of leaf ``i``'s path, addressed in the log."""
    out, j, width = [], i, n
    for level in range(levels):
        a, z = j // FAN * FAN, min(j // FAN * FAN + FAN, width)
        run = [log[DIGEST * p:DIGEST * (p + 1)].hex().encode() for p in (place(level, x, n) for x in range(a, z))]
        out += [b"".join(run[:j - a]), b"".join(run[j - a + 1:])]
        j, width = j // FAN, -(-width // FAN)
    return out


def fold(leaf: bytes, path: list[bytes]) -> bytes:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    for left, right in zip(path[::2], path[1::2]):
        leaf = sha256(left + leaf.hex().encode() + right).digest()
    return leaf


def numbered(rows: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """``rows`` with i, their place inside their group by ``order`` (from 0), and total, the group's rows.

    Rows are range-partitioned by group and order, so a hot group lies in many parts; a part's first place in each group
    comes from the counts of (part, group), of which there are at most parts + groups.
    """
    rows = rows.withColumn("_null", F.col(group).isNotNull())
    keys = [F.col("_null"), F.col(group), *order]
    cut = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    cut = written(cut.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), name)
    counts = cut.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    by = Window.partitionBy(group)
    before = F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    base = counts.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "_first", before.alias("_before"), F.sum("_n").over(by).alias("total"))
    full = cut.join(base, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return full.withColumn("i", F.col("_before") + F.col("_row") - F.col("_first")).drop("_null", "_part", "_row", "_p", "_g", "_first", "_before")


def build_logs(leaves: DataFrame, tier: int) -> DataFrame:
    """g, tier, block, first, total, n, log: postorder logs of aligned runs of RUN leaves (g, i, total, digest).

    A builder ends at LEVELS levels, or earlier where its run is the whole tree; the last node of its log stands for the
    run. ``first`` is the place of the run's first leaf in the postorder of the whole tree that this tier's leaves span.
    """
    dealt = leaves.select("g", F.floor(F.col("i") / RUN).cast("long").alias("block"), "i", "total", "digest")
    dealt = dealt.repartition("g", "block").sortWithinPartitions("g", "block", "i")

    def run(batches):
        for b, cuts in whole_groups(batches, "g", "block"):
            g, block, total, digest = (b.column(c) for c in ("g", "block", "total", "digest"))
            at = pa.array(cuts[:-1], pa.int64())
            logs = []
            for a, z in zip(cuts, cuts[1:]):
                n = total[a].as_py()
                logs.append(append_log(digest.slice(a, z - a).to_pylist(), LEVELS if n > RUN else height(n)))
            first = [place(0, x * RUN, x * RUN + 1) for x in block.take(at).to_pylist()]
            schema = pa.schema([("g", g.type), ("block", pa.int64()), ("first", pa.int64()), ("total", pa.int64()), ("n", pa.int64()), ("log", pa.binary())])
            yield build(schema, g.take(at), block.take(at), first, total.take(at), np.diff(cuts), logs)

    kind = leaves.schema["g"].dataType.simpleString()
    out = dealt.mapInArrow(run, f"g {kind}, block long, first long, total long, n long, log binary")
    return out.select("g", F.lit(tier).alias("tier"), "block", "first", "total", "n", "log")


def tree_logs(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The logs of all groups' trees, tier by tier: each tier's runs are the next one's leaves until all are single."""
    tiers = []
    most = leaves.agg(F.max("total")).first()[0] or 0
    while True:
        tiers.append(written(build_logs(leaves, len(tiers)), f"{name}-log"))
        if most <= RUN:
            return tiers
        most = -(-most // RUN)
        tops = tiers[-1].where(F.col("total") > RUN)
        leaves = tops.select("g", F.col("block").alias("i"), F.ceil(F.col("total") / RUN).cast("long").alias("total"), F.expr(f"substring(log, length(log) - {DIGEST - 1}, {DIGEST})").alias("digest"))


def roots(tiers: list[DataFrame]) -> DataFrame:
    """g, digest: the root of each group's tree, which ends the only log of its last tier."""
    out = None
    for t in tiers:
        top = t.where(F.col("total") <= RUN).select("g", F.expr(f"substring(log, length(log) - {DIGEST - 1}, {DIGEST})").alias("digest"))
        out = top if out is None else out.union(top)
    return out


def proved(leaves: DataFrame, logs: DataFrame, above: DataFrame | None, more: list[str], fn, schema: str) -> DataFrame:
    """``fn(columns, path)`` of every leaf (g, i, ``more``) with its whole path: siblings in its run's log, then those above.

    ``above``: g, block (null: of all blocks), path. Leaves meet their log by (g, block), so at most RUN leaves and one log
    are together.
    """
    src = logs.select(F.col("g").alias("_g"), F.col("block").alias("_b"), "total", "n", "log")
    if above is not None:
        up = above.select(F.col("g").alias("_ug"), F.col("block").alias("_ub"), F.col("path").alias("above"))
        src = src.join(up, F.col("_g").eqNullSafe(F.col("_ug")) & (F.col("_b") == F.col("_ub")), "left")
    else:
        src = src.withColumn("above", F.lit(None).cast("array<binary>"))
    dealt = leaves.select("g", F.floor(F.col("i") / RUN).cast("long").alias("block"), "i", *more)
    heads = src.select(F.col("_g").alias("g"), F.col("_b").alias("block"), F.lit(-1).cast("long").alias("i"), *[F.lit(None).cast(dealt.schema[c].dataType).alias(c) for c in more], "total", "n", "log", "above")
    rows = dealt.unionByName(heads, allowMissingColumns=True).repartition("g", "block").sortWithinPartitions("g", "block", "i")

    def run(batches):
        for b, cuts in whole_groups(batches, "g", "block"):
            out = []
            for a, z in zip(cuts, cuts[1:]):
                head = {c: b.column(c)[a].as_py() for c in ("total", "n", "log", "above")}
                levels = LEVELS if head["total"] > RUN else height(head["total"])
                first = (b.column("block")[a].as_py() or 0) * RUN
                part = b.slice(a + 1, z - a - 1)
                for i, row in zip(part.column("i").to_pylist(), part.select(["g", "i", *more]).to_pylist()):
                    out.append(fn(row, siblings(head["log"], i - first, head["n"], levels) + (head["above"] or [])))
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(run, schema)


def paths(tiers: list[DataFrame], top: DataFrame) -> list[DataFrame]:
    """For each tier: g, block and the path above that block's run, up to the root over all groups.

    ``top``: g and the path from a group's root on.
    """
    kind = tiers[0].schema["g"].dataType.simpleString()
    out: list[DataFrame] = []
    for t in reversed(range(len(tiers))):
        ends = tiers[t].where(F.col("total") <= RUN).select(F.col("g").alias("_g"), "block").join(top.select("g", "path"), F.col("_g").eqNullSafe(F.col("g"))).select("g", "block", "path")
        if out:
            inner = tiers[t].where(F.col("total") > RUN).select("g", F.col("block").alias("i"))
            down = proved(inner, tiers[t + 1], out[0], [], lambda row, path: {"g": row["g"], "block": row["i"], "path": path}, f"g {kind}, block long, path array<binary>")
            ends = ends.union(down)
        out.insert(0, written(ends, "paths"))
    return out


def leaf_text(fields: list) -> F.Column:
    """``-`` for a null, else the UTF-8 byte count, ``:`` and the value, field by field."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*[one(c.cast("string")) for c in fields])


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), one_in: int = 5):
    """(rows, logs of the sources' trees, logs of the tree over the sources), logs as lists of tables, one a tier.

    rows: id, leaf, subroot, root, proof_sha256, folded_root, verified of every row. A leaf is the SHA-256 of its row's
    ``fields``; leaves of a source ascend by id (null first, equal ids by their digest, so repeated rows have equal
    leaves); sources ascend bytewise, null first. Proofs are the siblings on the way to the root. Where ``one_in`` divides
    the CRC-32 of the decimal id the row is read as if A-Z of its text had been lower-cased, and folded_root comes from
    that leaf; rows with a null id are never so. Null and empty values differ. An empty table has no rows and no root.
    Columns that aren't in ``fields`` are ignored.

    Texts are hashed where they are read; ids, sources and digests are all that is shuffled. Builders of 4096 leaves work
    side by side and a hot source is dealt to many of them.
    """
    text = lambda c: ascii_lower(col(c)) if c == text_col else col(c)
    told = F.crc32(col(id_col).cast("string").cast("binary")) % one_in == 0
    leaf = lambda pick: F.unhex(F.sha2(leaf_text([pick(c) for c in fields]), 256))
    src = docs.select(col(id_col).alias("id"), col(source_col).cast("string").alias("g"), leaf(col).alias("digest"), F.when(told, leaf(text)).alias("other"))
    leaves = written(numbered(written(src, "leaves"), "g", [F.col("id"), F.col("digest")], "ordered-leaves"), "numbered-leaves")
    inner = tree_logs(leaves, "source")
    subroots = written(roots(inner), "subroots")
    order = numbered(subroots.withColumn("s", F.struct(F.col("g").isNotNull(), "g")).withColumn("all", F.lit(0)), "all", [F.col("s")], "ordered-sources")
    order = written(order.select(F.col("all").alias("g"), "i", "total", "digest", F.col("g").alias("source")), "sources")
    outer = tree_logs(order, "root")
    root = roots(outer).first()
    kind = "string"
    above = paths(outer, outer[0].select("g").distinct().withColumn("path", F.array().cast("array<binary>")))
    pick = lambda row, path: {"g": row["source"], "path": path, "subroot": row["digest"]}
    top = written(proved(order, outer[0], above[0], ["source", "digest"], pick, f"g {kind}, path array<binary>, subroot binary"), "source-paths")
    whole = root["digest"] if root else b""

    def judge(row, path):
        inner_path = path[:2 * height(row["count"])]
        subroot, proof = fold(row["digest"], inner_path), sha256(b"".join(path)).hexdigest()
        if fold(subroot, path[len(inner_path):]) != whole:
            raise RuntimeError("a proof doesn't lead to the root")
        folded = fold(row["digest"] if row["other"] is None else row["other"], path)
        return {"id": row["id"], "leaf": row["digest"].hex(), "subroot": subroot.hex(), "root": whole.hex(), "proof_sha256": proof, "folded_root": folded.hex(), "verified": folded == whole}

    kind = leaves.schema["id"].dataType.simpleString()
    rows = proved(leaves.withColumn("count", F.col("total")), inner[0], paths(inner, top)[0], ["id", "digest", "other", "count"], judge,
                  f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return rows.withColumnRenamed("id", id_col), inner, outer


def levels_sql(name: str, first: str, levels: int) -> str:
    """CTEs name0, name1, ...: nodes (g, i, n of its level, d) and the digests left and right of it among its siblings."""
    around = lambda frame: f"coalesce(string_agg(d, '') OVER (PARTITION BY g, i // {FAN} ORDER BY i ROWS BETWEEN {frame}), '')"
    with_sides = lambda src: f"SELECT g, i, n, d, {around('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {around('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM ({src})"
    out = [f"{name}0 AS ({with_sides(first)})"]
    for k in range(levels):
        up = f"SELECT g, i // {FAN} AS i, (max(n) + {FAN - 1}) // {FAN} AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE max(d) END AS d FROM {name}{k} GROUP BY g, i // {FAN}"
        out.append(f"{name}{k + 1} AS ({with_sides(up)})")
    return ",\n".join(out)


def manifest_sql(inner: int = 6, outer: int = 4) -> str:
    """The rows of ``manifest`` over documents, for sources of up to 16^inner rows and 16^outer sources."""
    one = lambda f: f"coalesce(strlen({f}) || ':' || {f}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(one(f) for f in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    steps = [("s", k, f"leaves.g IS NOT DISTINCT FROM s{k}.g AND leaves.i // {FAN**k} = s{k}.i") for k in range(inner)] + [("o", k, f"tops.i // {FAN**k} = o{k}.i") for k in range(outer)]
    path = " || ".join(f"CASE WHEN {t}{k}.n > 1 THEN {t}{k}.l || {t}{k}.r ELSE '' END" for t, k, _ in steps)
    fold_steps, last = [], "folding"
    for x, (t, k, _) in enumerate(steps):
        fold_steps.append(f"f{x} AS (SELECT * REPLACE (CASE WHEN n{x} > 1 THEN sha256(l{x} || folded || r{x}) ELSE folded END AS folded) FROM {last})")
        last = f"f{x}"
    sides = ", ".join(f"{t}{k}.n AS n{x}, {t}{k}.l AS l{x}, {t}{k}.r AS r{x}" for x, (t, k, _) in enumerate(steps))
    joins = " ".join(f"JOIN {t}{k} ON {on}" for t, k, on in steps)
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""
WITH {CRC_SQL},
read AS (SELECT doc_id, source AS g, {leaf('text')} AS leaf, {leaf(lower)} AS other, hex(encode(CAST(doc_id AS VARCHAR))) AS x FROM documents),
leaves AS (SELECT doc_id, g, leaf, CASE WHEN {crc_sql('x')} % 5 = 0 THEN other END AS other, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM read, crc_bits),
{levels_sql('s', 'SELECT g, i, n, leaf AS d FROM leaves', inner)},
tops AS (SELECT g, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM s{inner}),
{levels_sql('o', 'SELECT 0 AS g, i, n, d FROM tops', outer)},
folding AS (SELECT doc_id, leaf, tops.d AS subroot, sha256({path}) AS proof_sha256, coalesce(other, leaf) AS folded, {sides}
  FROM leaves JOIN tops ON tops.g IS NOT DISTINCT FROM leaves.g {joins}),
{', '.join(fold_steps)}
SELECT doc_id, leaf, subroot, o{outer}.d AS root, proof_sha256, folded AS folded_root, folded = o{outer}.d AS verified FROM {last}, o{outer}
"""


OP13_SQL = manifest_sql()
