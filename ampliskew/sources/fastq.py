"""FASTQ as a Spark data source (A05): ``spark.read.format("fastq").option("path", ...)``.

A gz file is one partition; plain text is cut into byte ranges, each starting at the first whole record of its range.
Options: path (comma separated files or folders), strict (error on a broken record instead of stopping at a truncated
tail), maxReads (per file), rangeBytes.
"""

from __future__ import annotations

import gzip
import io
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import READS

#: Records of one Arrow batch.
BATCH = 8192
SUFFIX = re.compile(r"\.(fastq|fq)(\.gz)?$")


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int | None


def _open_fs(path):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(spec: str):
    from pyarrow import fs
    for p in spec.split(","):
        system, local = _open_fs(p.strip())
        info = system.get_file_info(local)
        if info.type == fs.FileType.Directory:
            found = [i for i in system.get_file_info(fs.FileSelector(local, recursive=True)) if i.type == fs.FileType.File and SUFFIX.search(i.path)]
        elif info.type == fs.FileType.File:
            found = [info]
        else:
            raise FileNotFoundError(p)
        prefix = p.strip()[: p.strip().index("://") + 3] if "://" in p else ""
        for i in sorted(found, key=lambda i: i.path):
            yield prefix + i.path, i.size


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.spec = options.get("path")
        self.strict = str(options.get("strict", "true")).lower() == "true"
        self.max_reads = int(options.get("maxReads", "0"))
        self.range_bytes = int(options.get("rangeBytes", str(64 << 20)))
        if not self.spec:
            raise ValueError("fastq needs a path")

    def partitions(self):
        parts = []
        for path, size in _files(self.spec):
            whole = path.endswith(".gz") or self.max_reads > 0
            step = size if whole else self.range_bytes
            starts = [0] if whole or size == 0 else range(0, size, step)
            parts += [FileRange(path, s, None if whole else min(size, s + step)) for s in starts]
        return parts

    def read(self, part: FileRange):
        system, local = _open_fs(part.path)
        sample = SUFFIX.sub("", local.rsplit("/", 1)[-1])
        with system.open_input_file(local) as raw:
            f = gzip.GzipFile(fileobj=raw) if part.path.endswith(".gz") else io.BufferedReader(_Raw(raw))
            pos = _sync(f, part.start) if part.start else 0
            n, rows = 0, []
            while pos is not None and (part.end is None or pos < part.end):
                lines = [f.readline() for _ in range(4)]
                if not lines[0]:
                    break
                if not lines[3]:
                    if self.strict:
                        raise ValueError(f"truncated FASTQ record at byte {pos} in {part.path}")
                    break
                head, seq, plus, qual = (x.decode("utf-8", "replace").rstrip("\r\n") for x in lines)
                if self.strict and (not head.startswith("@") or not plus.startswith("+") or len(seq) != len(qual)):
                    raise ValueError(f"malformed FASTQ record at byte {pos} in {part.path}")
                if seq:
                    rows.append((sample, pos, head, seq.strip().upper(), qual))
                    n += 1
                    if len(rows) == BATCH:
                        yield _batch(rows)
                        rows = []
                    if self.max_reads and n >= self.max_reads:
                        break
                pos += sum(len(x) for x in lines)
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Records as Arrow, so that they reach Spark without a conversion row by row."""
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["sample_id", "read_no", "header", "seq", "qual"])


class _Raw(io.RawIOBase):
    def __init__(self, f):
        self.f = f

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, offset, whence=0):
        return self.f.seek(offset, whence)

    def tell(self):
        return self.f.tell()

    def readinto(self, b):
        data = self.f.read(len(b))
        b[: len(data)] = data
        return len(data)


def _sync(f, start: int):
    """Byte of the first record that begins at or after ``start``: an @ line whose second next line is a + line."""
    f.seek(start - 1)
    pos = start - 1 + len(f.readline())
    window = []
    while True:
        at, line = pos, f.readline()
        if not line:
            return None
        pos += len(line)
        window.append((at, line))
        if len(window) >= 3 and window[-3][1].startswith(b"@") and window[-1][1].startswith(b"+"):
            f.seek(window[-3][0])
            return window[-3][0]


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return READS

    def reader(self, schema):
        return FastqReader(self.options)


def read_fastq(spark, paths, strict: bool = True, max_reads: int = 0, range_bytes: int | None = None):
    """sample_id (file name), read_no (byte of the record), header, upper-case seq, qual.

    A truncated or malformed record ends the job; without ``strict`` a file ends at a truncated tail. ``max_reads`` is
    for looking at a file's head and reads it in one task.
    """
    spark.dataSource.register(FastqSource)
    r = spark.read.format("fastq").option("path", paths if isinstance(paths, str) else ",".join(paths)).option("strict", str(strict)).option("maxReads", str(max_reads))
    return (r.option("rangeBytes", str(range_bytes)) if range_bytes else r).load()
