"""Op 10: token ids in binary files, as frequency ranks in byte-aligned variable-length coding.

A file is a row of blocks. A block holds whole documents: magic, counts, the documents' ids and lengths, then one control
byte for each four ranks (two bits a rank: its bytes less one), then the ranks' bytes, little end first. Rank 0 is the
most frequent token id of the corpus, so most ranks take one byte. Control bytes stand apart from the data, so a block
is decoded by table lookup without looking at single bytes.
"""

from __future__ import annotations

import re
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import build, col, shared_dir, slices, written
from .wordcache import ChunkCache, encoded

MAGIC = b"TIDS0001"
HEAD = "<8sqqqq"  # magic, documents, ids, ids before the block, bytes of data
NO_ID = -(2**63)
#: Marks the key of a text's first word; no other key has a tabulator.
FIRST = "\t"
#: Latin letters with signs behind them: exactly two pieces of the pre-tokenizer (one without signs).
PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\[-`{-~]*)")


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """Byte-level spelling of the letters of PLAIN beyond ASCII: printable bytes stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spell = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return {c: "".join(spell[b] for b in chr(c).encode()) for c in range(0xC0, 0x250)}


class ByteEncoder:
    """Token ids of texts, as the tokenizers library gives them for the whole text.

    Its pre-tokenizer never joins a blank or line break to what stands before it, so in texts with single blanks and
    line breaks each word, with its blank, is encoded for itself and kept in a bounded cache. Words of Latin letters and
    signs behind them go piece by piece to the library's model; other words through the whole tokenizer. Texts with other
    white space, or with strings that may be special tokens, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.newline = self.lib.encode("\n", add_special_tokens=False).ids
        self.signs: dict[str, list[int]] = {"": []}
        self.cache = ChunkCache(self._fresh)

    def _fresh(self, keys: list[str]) -> list[list[int]]:
        """Keys are a word behind a blank, a line break and the first word of a line, or FIRST and the first word of a text."""
        model, signs, letters, out, odd = self.model.tokenize, self.signs, byte_letters(), [], []
        for k in keys:
            head = k[0] in "\n\t"
            plain = PLAIN.fullmatch(k, head)
            if not plain:
                odd.append(len(out))
                out.append(k[1:] if head else " " + k)
                continue
            word, tail = plain.groups()
            if not word.isascii():
                word = word.translate(letters)
            ids = [t.id for t in model(word if head else "\u0120" + word)]
            if tail:
                if tail not in signs:
                    signs[tail] = [t.id for t in model(tail)]
                    if len(signs) > 100_000:
                        self.signs = signs = {"": [], tail: signs[tail]}
                ids += signs[tail]
            out.append(self.newline + ids if k[0] == "\n" else ids)
        for i, e in zip(odd, self.lib.encode_batch_fast([out[i] for i in odd], add_special_tokens=False)):
            out[i] = self.newline + e.ids if keys[i][0] == "\n" else e.ids
        return out

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end_id`` behind it, in one array, and their ends."""
        keys = [self._keys(t) for t in texts]
        odd = self.lib.encode_batch_fast([t for t, own in zip(texts, keys) if own is None], add_special_tokens=False)
        flat, ends = encoded(self.cache, keys, [e.ids for e in odd])
        return np.insert(flat, ends, end_id), ends + np.arange(1, len(ends) + 1)

    @staticmethod
    def _keys(text: str) -> list[str] | None:
        if not text:
            return []
        # printable excludes all white space but the blank
        if "<|" in text or not text.replace("\n", "").isprintable():
            return None
        keys = text.replace("\n", " \n").split(" ")
        if "" in keys or "\n" in keys:  # blanks or line breaks that don't stand alone between words
            return None
        keys[0] = FIRST + keys[0]
        return keys


@lru_cache(2)
def encoder(path: str) -> ByteEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return ByteEncoder(path)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """part, local (ids before it in its part), key, n, ids (binary) in ascending order of ``id_col`` by part and local.

    Nulls come first; rows with the same id stand in the order of their texts' hashes. The last row of each part has no
    ``local`` but ``counts`` (binary): how often each token id occurs in the part, as 64-bit integers.
    """
    src = docs.select(col(id_col).cast("long").alias("key"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.repartitionByRange(partitions, "key").sortWithinPartitions("key", F.xxhash64("text"), F.length("text"))
    schema = pa.schema([("local", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        enc, before, seen = encoder(tokenizer), 0, np.zeros(0, "i8")
        for whole in batches:
            for batch in slices(whole, 1):
                flat, ends = enc.encode(batch.column(1).to_pylist(), end_id)
                n = np.diff(ends, prepend=0)
                ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype("i4")), pa.py_buffer(flat.astype("<i4"))])
                yield build(schema, before + ends - n, batch.column(0), n, ids, pa.nulls(len(n), pa.binary()))
                before += len(flat)
                seen = added(seen, np.bincount(flat))
        yield build(schema, [None], [None], [0], [None], [seen.tobytes()])

    return src.mapInArrow(run, "local long, key long, n long, ids binary, counts binary").withColumn("part", F.spark_partition_id())


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two counts of different length."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    out = long.astype("i8")
    out[:len(short)] += short
    return out


def packed(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    n = len(ranks)
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.astype("<u4").view("u1").reshape(n, 4)[np.arange(4) < size[:, None]]
    codes = np.zeros(-(-n // 4) * 4, "u1")
    codes[:n] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], "u1")).sum(1, dtype="u1")
    return control.tobytes(), data.tobytes()


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each control byte: bytes of its four ranks in sum, and the place of each of their 16 bytes (16: none)."""
    size = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)
    first = np.cumsum(size, 1) - size
    place = np.where(np.arange(4) < size[:, :, None], first[:, :, None] + np.arange(4), 16)
    return size.sum(1), place.reshape(256, 16)


def unpacked(control: bytes, data: bytes, n: int) -> np.ndarray:
    total, place = tables()
    c = np.frombuffer(control, "u1")
    # unused ranks of the last control byte count one byte each, which the data lack
    padded = np.frombuffer(data + bytes(20), "u1")
    ends = np.cumsum(total[c])
    out = np.empty((len(c), 16), "u1")
    for a in range(0, len(c), 1 << 16):
        part = c[a:a + (1 << 16)]
        at = place[part]
        got = padded[np.minimum((ends[a:a + len(part)] - total[part])[:, None] + at, len(padded) - 1)]
        got[at == 16] = 0
        out[a:a + len(part)] = got
    return out.reshape(-1).view("<u4")[:n]


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = 32 << 20) -> str:
    """Writes the files and returns their folder (default: a new one in the shared folder).

    ``tokenizer`` is a path that every executor can open. Every text is encoded whole, null as empty, and ``end_id`` is
    appended. Files follow the ascending order of ``id_col`` by name. Texts are shuffled once, by range of their ids,
    into parts of about ``partition_bytes``; ranks come from the counts of all ids. To the driver go the parts' totals
    (one number a part) and the rank table (one entry a token id, at most the vocabulary). A task writes each file
    under a name of its own and moves it into place, so a repeated task writes the same files again. An empty table
    gives a folder with the rank table only. ``folder`` may be of any kind that pyarrow's file systems open.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-files")
    size = docs.agg(F.sum(F.octet_length(col(text_col).cast("string")))).first()[0] or 0
    table = written(tokenized(docs, tokenizer, end_id, id_col, text_col, max(1, -(-size // partition_bytes))), "tokens")
    totals = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, before = {}, 0
    for part in sorted(totals):
        base[part], before = before, before + totals[part]

    def count(batches):
        seen = np.zeros(0, "i8")
        for b in batches:
            for x in b.column(0):
                seen = added(seen, np.frombuffer(x.as_py(), "i8"))
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(seen[used], pa.int64())], ["id", "n"])

    counts = table.where("local is null").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = np.asarray([r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()], "<u4")
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks.bin") as out:
        out.write(by_rank.tobytes())
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, "<u4")
    rank_of[by_rank] = np.arange(len(by_rank), dtype="<u4")
    shared = spark.sparkContext.broadcast((rank_of, base))

    def write(batches):
        ranks, starts = shared.value
        fs, root = file_system(folder)
        sink = name = part = None
        rows = total = upto = 0

        def close():
            sink.close()
            fs.move(f"{root}/_{name}.{token}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64()), pa.array([total], pa.int64())], ["file", "docs", "ids"])

        token = uuid.uuid4().hex
        for whole in batches:
            parts = whole.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
            for run in (whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:])):
                for b in slices(run, 4):
                    if b.num_rows == 0:
                        continue
                    local, own = b.column(1)[0].as_py(), b.column(0)[0].as_py()
                    if own != part or local != upto:
                        if sink:
                            yield close()
                        part, rows, total = own, 0, 0
                        name = f"part-{part:06d}-{local:015d}.tids"
                        sink = fs.open_output_stream(f"{root}/_{name}.{token}")
                    ids = np.frombuffer(b"".join(b.column(4).to_pylist()), "<u4")
                    control, data = packed(ranks[ids])
                    keys = b.column(2).fill_null(NO_ID).to_numpy()
                    sink.write(struct.pack(HEAD, MAGIC, b.num_rows, len(ids), starts[part] + local, len(data)) + keys.astype("<i8").tobytes() + b.column(3).to_numpy().astype("<i8").tobytes() + control + data)
                    rows, total, upto = rows + b.num_rows, total + len(ids), local + len(ids)
        if sink:
            yield close()

    made = table.where("local is not null").select("part", "local", "key", "n", "ids").mapInArrow(write, "file string, docs long, ids long").agg(F.sum("ids")).first()[0] or 0
    if made != before:
        raise RuntimeError(f"{made} ids were written of {before}")
    return folder


def file_system(folder: str):
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def blocks(content: memoryview):
    """(ids before the block, document ids, lengths, control, data) of each block; raises where a file is cut short."""
    at = 0
    while at < len(content):
        magic, docs, ids, start, size = struct.unpack_from(HEAD, content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += struct.calcsize(HEAD)
        ends = np.cumsum([at, 8 * docs, 8 * docs, -(-ids // 4), size])
        if ends[-1] > len(content):
            raise ValueError("the file ends inside a block")
        keys, lengths, control, data = (content[a:b] for a, b in zip(ends, ends[1:]))
        yield start, np.frombuffer(keys, "<i8"), np.frombuffer(lengths, "<i8"), bytes(control), bytes(data)
        at = int(ends[-1])


def read_token_files(spark, folder: str) -> DataFrame:
    """doc_id long, start long (ids of all documents before it), n_tokens long, ids binary (little-endian unsigned 32-bit)."""
    fs, root = file_system(folder)
    with fs.open_input_stream(f"{root}/ranks.bin") as src:
        by_rank = spark.sparkContext.broadcast(np.frombuffer(src.read(), "<u4"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for b in batches:
            for content in b.column(0):
                for start, keys, n, control, data in blocks(memoryview(content.as_buffer())):
                    ids = by_rank.value[unpacked(control, data, int(n.sum()))]
                    ends = np.cumsum(n)
                    flat = ids.astype("<u4").tobytes()
                    yield build(schema, pa.array(keys, pa.int64(), mask=keys == NO_ID), start + ends - n, n, [flat[4 * (e - k):4 * e] for e, k in zip(ends, n)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tids").load(folder)
    return files.select("content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
