"""Alignment files (BAM) as a Python data source, split over tasks."""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial
from glob import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.sources.tsv import local_or_remote

#: Bytes of a file that a task reads, and records of a batch.
SPLIT, BATCH = 32 << 20, 4_000
#: Records in a row that have to be plausible where a task looks for the beginning of its first one.
PLAUSIBLE = 4

# The columns; bases and operations by code; sizes of tag values.
SCHEMA = "name string, reference string, pos bigint, mapq int, cigar string, flags int, rnext string, pnext bigint, tlen bigint, seq string, qual string, tags map<string,string>"
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
TAG_VALUES = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def _block_size(head: bytes) -> int | None:
    """The size of the compressed block that begins here, if one does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 6 <= min(end, len(head)):
        length = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and length == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + length
    return None


class _Blocks:
    """The decompressed bytes of a file from a block on, with the place in the file at which the block of each byte begins."""

    def __init__(self, file, size: int, at: int) -> None:  # noqa: ANN001
        self.file, self.size, self.next = file, size, at
        self.data, self.at, self.starts = b"", 0, []  # starts: (offset in data, place of the block)

    def more(self) -> bool:
        """Read a block more; what was taken is let go. False at the end of the file."""
        if self.next >= self.size:
            return False
        self.file.seek(self.next)
        raw = self.file.read(min(65_536, self.size - self.next))
        length = _block_size(raw[:512])
        if length is None:
            raise ValueError("not a block of an alignment file")
        if self.at > 1 << 20:
            self.data = self.data[self.at :]
            self.starts = [(max(0, o - self.at), p) for i, (o, p) in enumerate(self.starts) if i + 1 == len(self.starts) or self.starts[i + 1][0] > self.at]
            self.at = 0
        self.starts.append((len(self.data), self.next))
        head = 12 + int.from_bytes(raw[10:12], "little")
        self.data += zlib.decompress(raw[head : length - 8], -15)
        self.next += length
        return True

    def has(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.has(n):
            raise EOFError("the file ends within a record")
        self.at += n
        return self.data[self.at - n : self.at]

    def place(self) -> int:
        """Where the block begins that holds the next byte."""
        return max(p for o, p in self.starts if o <= self.at)


def _first_block(file, size: int, start: int) -> int | None:  # noqa: ANN001
    """Where the first block at or after ``start`` begins: there, and where it says that it ends, the mark of a block is found (or the end of the file)."""
    at = start
    while at < size:
        file.seek(at)
        window = file.read(min(1 << 17, size - at))
        i = window.find(b"\x1f\x8b\x08\x04")
        while i >= 0:
            length = _block_size(window[i : i + 512])
            if length is not None:
                file.seek(at + i + length)
                if at + i + length == size or _block_size(file.read(512)) is not None:
                    return at + i
            i = window.find(b"\x1f\x8b\x08\x04", i + 1)
        at += max(1, len(window) - 3)
    return None


def _header(blocks: _Blocks, path: str) -> list[tuple[str, int]]:
    """Names and lengths of the references; leaves ``blocks`` at the first record."""
    if blocks.take(4) != b"BAM\1":
        raise ValueError(f"not an alignment file: {path}")
    blocks.take(*struct.unpack("<i", blocks.take(4)))
    out = []
    for _ in range(*struct.unpack("<i", blocks.take(4))):
        (n,) = struct.unpack("<i", blocks.take(4))
        name = blocks.take(n)[:-1].decode()
        out.append((name, *struct.unpack("<i", blocks.take(4))))
    return out


def _plausible(blocks: _Blocks, at: int, references: list[tuple[str, int]]) -> bool:
    """Whether a record may begin ``at`` bytes further on."""

    def position(ref: int, pos: int) -> bool:
        return -1 <= ref < len(references) and -1 <= pos and (ref < 0 or pos <= references[ref][1])

    for _ in range(PLAUSIBLE):
        if not blocks.has(at + 37):
            return not blocks.has(at + 1)  # the end of the file, reached with whole records
        size, ref, pos, n_name, _, _, n_cigar, _, n_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", blocks.data, blocks.at + at)
        if not (position(ref, pos) and position(next_ref, next_pos) and n_name > 0 and n_seq >= 0 and size >= 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq and size < 1 << 28):
            return False
        if not blocks.has(at + 4 + size):
            return False
        name = blocks.data[blocks.at + at + 36 : blocks.at + at + 36 + n_name]
        if name[-1] or any(not 33 <= c <= 126 for c in name[:-1]):
            return False
        at += 4 + size
    return True


def _tags(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[tag], at = data[at:end].decode(errors="replace"), end + 1
        elif kind == "B":
            form = TAG_VALUES[chr(data[at])]
            (n,) = struct.unpack_from("<i", data, at + 1)
            values = struct.unpack_from(f"<{n}{form}", data, at + 5)
            out[tag], at = ",".join(map(str, values)), at + 5 + n * struct.calcsize(form)
        else:
            (value,) = struct.unpack_from("<" + TAG_VALUES[kind], data, at)
            out[tag], at = value.decode() if kind == "A" else str(value), at + struct.calcsize(TAG_VALUES[kind])
    return out


def _record(data: bytes, references: list[tuple[str, int]]) -> tuple:
    """An alignment; positions count from 1, and what is absent is ``*`` or 0, as in the text format."""
    ref, pos, n_name, mapq, _, n_cigar, flags, n_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32
    name = data[at : at + n_name - 1].decode()
    at += n_name
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", data, at)) or "*"
    at += 4 * n_cigar
    packed = data[at : at + (n_seq + 1) // 2]
    seq = packed.hex().translate(_DIGITS)[:n_seq] or "*"
    at += len(packed)
    quality = data[at : at + n_seq]
    qual = "*" if not n_seq or quality[0] == 255 else bytes(q + 33 for q in quality).decode()
    at += n_seq
    where = references[ref][0] if ref >= 0 else "*"
    mate = "*" if next_ref < 0 else "=" if next_ref == ref else references[next_ref][0]
    return name, where, pos + 1, mapq, cigar, flags, mate, next_pos + 1, tlen, seq, qual, list(_tags(data[at:]).items())


_DIGITS = str.maketrans("0123456789abcdef", BASES)


def read_records(path: str, start: int = 0, end: int | None = None) -> Iterator[tuple]:
    """The alignments that begin in the blocks of a file from ``start`` up to ``end``.

    The first record of a range that doesn't begin the file is found by trying: from the first byte at which PLAUSIBLE records in a row have references, positions,
    names and lengths that fit.
    """
    files, at = local_or_remote(path)
    with files.open_input_file(at) as file:
        size = file.size()
        end = size if end is None else min(end, size)
        blocks = _Blocks(file, size, 0)
        references = _header(blocks, path)
        if start:
            first = _first_block(file, size, start)
            if first is None or first >= end:
                return
            # Records begin after the header, so a range within it has what begins after it.
            if first > blocks.place():
                blocks = _Blocks(file, size, first)
                skip = 0
                while blocks.has(skip + 1) and not _plausible(blocks, skip, references):
                    skip += 1
                if not blocks.has(skip + 1):
                    return
                blocks.at += skip
            else:
                while blocks.has(4) and blocks.place() < first:
                    blocks.take(*struct.unpack("<i", blocks.take(4)))
        while blocks.has(4) and blocks.place() < end:
            yield _record(blocks.take(*struct.unpack("<i", blocks.take(4))), references)


def _head(references: list[tuple[str, int]]) -> bytes:
    return b"BAM\1" + struct.pack("<ii", 0, len(references)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in references)


def _packed(name: str, ref: int, pos: int, seq: str) -> bytes:
    codes = [BASES.index(c) for c in seq] + [0]
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, 1, 0, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4)
    body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2)) + b"\xff" * len(seq)
    return struct.pack("<i", len(body)) + body


def packed_blocks(references: list[tuple[str, int]], reads: Iterable[tuple[str, int, int, str]], block: int = 60_000) -> Iterator[bytes]:
    """The compressed blocks of an alignment file of matches: (name, number of the reference, position from 0, bases), for tests and examples. No more than a block is held."""

    def compressed(part: bytes) -> bytes:
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = pack.compress(part) + pack.flush()
        return b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))

    data = bytearray(_head(references))
    for read in reads:
        data += _packed(*read)
        while len(data) >= block:
            yield compressed(bytes(data[:block]))
            del data[:block]
    if data:
        yield compressed(bytes(data))
    yield compressed(b"")


def packed(references: list[tuple[str, int]], reads: Iterable[tuple[str, int, int, str]], block: int = 60_000) -> bytes:
    """The blocks of :func:`packed_blocks` as one."""
    return b"".join(packed_blocks(references, reads, block))


def _pack_part(batches: Iterator, folder: str, references: list[tuple[str, int]], block: int) -> Iterator:
    """Write a partition as a file whose name no other attempt has; gives the names it has now and should have."""
    import pyarrow as pa
    from pyspark import TaskContext

    path = f"{folder}/.{uuid.uuid4().hex}"
    files, at = local_or_remote(path)
    files.create_dir(at.rpartition("/")[0])
    with files.open_output_stream(at) as file:
        for data in packed_blocks(references, (read for b in batches for read in zip(*(c.to_pylist() for c in b.columns))), block):
            file.write(data)
    yield pa.RecordBatch.from_pydict({"made": [path], "name": [f"{folder}/part-{TaskContext.get().partitionId():06d}.bam"]})


def write_packed(reads: DataFrame, folder: str, references: list[tuple[str, int]], block: int = 60_000) -> str:
    """The alignments of :func:`packed_blocks` from a table with these four columns, as a folder with a file for each partition, in the order of the table.

    Each file is written by the task that has the rows, block by block; the driver has two names a file, and names the files of the attempts that counted. Returns
    the pattern of the files.
    """
    spark = reads.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = fs.makeQualified(at).toString()
    pack = partial(_pack_part, folder=folder, references=references, block=block)
    found = reads.mapInArrow(pack, "made string, name string").collect()
    for made, name in found:
        if not fs.rename(hadoop.Path(made), hadoop.Path(name)):
            raise OSError(f"can't be renamed: {made}")
    if not found:  # a table without rows may have no partition
        out = fs.create(hadoop.Path(f"{folder}/part-000000.bam"), False)
        try:
            out.write(bytearray(packed(references, [], block)))
        finally:
            out.close()
    return f"{folder}/part-*.bam"


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], split: int) -> None:
        self.files, self.split = files, split

    def partitions(self) -> list[_Range]:
        return [_Range(path, i, min(i + self.split, size)) for path, size in self.files for i in range(0, max(size, 1), self.split)]

    def read(self, partition: _Range) -> Iterator:
        import pyarrow as pa

        text, long, number = pa.string(), pa.int64(), pa.int32()
        kinds = [text, text, long, number, text, number, text, long, long, text, text, pa.map_(text, text)]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for row in read_records(partition.path, partition.start, partition.end):
            rows.append(row)
            if len(rows) == BATCH:
                yield batch()
                rows = []
        if rows:
            yield batch()


class AlignmentSource(DataSource):
    """``spark.read.format("alignments").load(path)`` for local files, or by :func:`read_alignments` from wherever Spark reads files; the path may be a pattern. Each SPLIT
    bytes of a file are read by one task (option ``split``). Writing isn't supported."""

    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        if "files" in self.options:
            files = [tuple(x) for x in json.loads(self.options["files"])]
        else:
            files = [(p, os.path.getsize(p)) for p in sorted(glob(self.options["path"])) or [self.options["path"]]]
        return _Reader(files, int(self.options.get("split", SPLIT)))


def read_alignments(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The alignments of a file, or of the files that a pattern names, in the order of the files."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    files = sorted((f.getPath().toString(), f.getLen()) for f in found)
    if not files:
        raise ValueError(f"no such file: {path}")
    spark.dataSource.register(AlignmentSource)
    return spark.read.format("alignments").option("files", json.dumps(files)).option("split", split).load()
