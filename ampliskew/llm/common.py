"""Shared folder, written tables and column names."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z only; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text bytes handled at once inside a task.
SLICE_BYTES = 4 << 20
#: CTE with the 256 steps of CRC-32 for SQL checks, and the sum itself over the hex digits in column ``x``.
CRC_SQL = "crc_bits AS (SELECT list(c ORDER BY b) AS steps FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) r(b)))"


def crc_sql(x: str) -> str:
    octets = f"list_transform(range(length({x}) // 2), lambda i: CAST('0x' || substring({x}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])))"


@lru_cache(1)
def own_dir() -> str:
    return Path(tempfile.mkdtemp(prefix="spark-shared-")).as_uri()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = own_dir()
    if "://" not in base and not base.startswith("file:"):
        base = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/") + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and rereads it: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_keyed(df: DataFrame, name: str, stored: bool) -> DataFrame:
    """Adds a key of every row that stays the same whenever and however the table is read.

    ``stored``: ``df`` is read from files as they are; others are written to the shared folder first.
    """
    df = df if stored else written(df, "rows")
    place = df.metadataColumn("_metadata")
    return df.withColumn(name, F.concat_ws(":", place["file_name"], place["row_index"].cast("string")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def col(name: str):
    """The column of exactly that name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def ascii_lower(text):
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES):
    """Parts of an Arrow batch with about ``limit`` text bytes each; one long text makes a part of its own."""
    size = batch.column(column).nbytes
    if size <= limit or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    for part in (batch.slice(0, half), batch.slice(half)):
        yield from slices(part, column, limit)


def build(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def whole_groups(batches, *names: str):
    """Batches that hold whole groups, from batches sorted by the columns ``names``, and the cuts between their groups.

    Only a group that goes on in the next batch is held back.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        if held and any(held[-1].column(n)[-1].as_py() != b.column(n)[0].as_py() for n in names):
            yield one_group(held)
            held = []
        last = starts_of(b, names)[-1]
        if last and held:
            first = starts_of(b, names)[1]
            yield one_group([*held, b.slice(0, first)])
            b, last, held = b.slice(first), last - first, []
        if last:
            done = b.slice(0, last)
            yield done, [*starts_of(done, names), last]
        held.append(b.slice(last))
    if held:
        yield one_group(held)


def one_group(parts: list[pa.RecordBatch]):
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0] if len(parts) > 1 else parts[0]
    return whole, [0, whole.num_rows]


def starts_of(b: pa.RecordBatch, names) -> list[int]:
    """Where the groups of a sorted batch start; nulls are a group."""
    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for n in names:
        x = b.column(n)
        a, z = x.slice(0, len(x) - 1), x.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, z), False), pc.xor(pc.is_null(a), pc.is_null(z)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new).tolist()
