"""BAM files as DataFrames, a file in as many pieces as Spark splits it into.

A BAM file is a row of gzip members (blocks of at most 64 KiB), so Spark's text reader, with the
first four bytes of a member as its separator, deals the blocks of a file to tasks and
finds the first block of a piece by itself.  Alignments lie across blocks and pieces:

1. A task unpacks the blocks of a piece one after another.  In the first piece alignments begin
   after the header; in others at the first place from which on all bytes at hand
   read as alignments.  What lies before that place, and the alignment that the piece breaks off in, go out as its edges.
2. The edges of neighbouring pieces are put together: each must give whole alignments and no
   byte more, else an error is raised.  So a place that was no beginning cannot pass.

A checkpoint (see session.cut) holds what was unpacked, so blocks are unpacked once.  A
header must lie in the first piece of its file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambiquant.session import cut

#: The first bytes of a block, those of a file, and bytes of each type of a tag.
MAGIC, FILE = b"\x1f\x8b\x08\x04", b"BAM\x01"
WIDTH = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
#: Bytes that the search for an alignment's beginning waits for, and alignments of a batch.
SEARCHED, BATCH = 1 << 18, 1 << 14
FIELDS = "kind string, file string, piece bigint, line bigint, qname string, flag int, ref int, pos int, mpos int, tlen int, nm int, read_length int, name string, head binary, tail binary, started boolean"
_NAMES = [x.split(" ")[0] for x in FIELDS.split(", ")]
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(x.split(" ")[0], _TYPES[x.split(" ")[1]]) for x in FIELDS.split(", ")])


def block_size(block: bytes) -> int | None:
    """Bytes of a block, as its header says; null where it has none.  block: without its first four bytes."""
    if len(block) < 8:
        return None
    at, end = 8, 8 + int.from_bytes(block[6:8], "little")
    while at + 4 <= min(end, len(block)):
        n = int.from_bytes(block[at + 2 : at + 4], "little")
        if block[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(block[at + 4 : at + 6], "little") + 1 - len(MAGIC)
        at += 4 + n
    return None


def unpacked(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """What blocks of one piece hold.  A block that has the separator inside comes in parts, which are joined by it."""
    part = b""
    for b in blocks:
        part = part + MAGIC + b if part else b
        size = block_size(part)
        if not part or (size is not None and len(part) < size):
            continue
        if size != len(part):
            raise ValueError("not a block of a BAM file")
        at = 8 + int.from_bytes(part[6:8], "little")
        yield zlib.decompress(part[at:-8], -15)
        part = b""
    if part:
        raise ValueError("a block of a BAM file is cut off")


def header(data: bytes) -> tuple[str, list[str], int] | None:
    """Text, names of references and length of a header; null if it isn't whole yet."""
    if len(data) < 8:
        return None
    if data[:4] != FILE:
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", data, 4)[0]
    at = 8 + n
    if len(data) < at + 4:
        return None
    text, count, names = data[8:at].rstrip(b"\0").decode("utf-8", "replace"), struct.unpack_from("<i", data, at)[0], []
    at += 4
    for _ in range(count):
        if len(data) < at + 4:
            return None
        n = struct.unpack_from("<i", data, at)[0]
        if len(data) < at + 8 + n:
            return None
        names.append(data[at + 4 : at + 3 + n].decode())
        at += 8 + n
    return text, names, at


def plausible(data: bytes, at: int) -> int:
    """The end of the alignment at a place, 0 if there is none, -1 if the data end before it can be told."""
    if len(data) < at + 36:
        return -1
    size, ref, pos, name, _, _, cigar, _, n, mate, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (33 <= size < 1 << 28 and ref >= -1 and pos >= -1 and mate >= -1 and mpos >= -1 and name >= 1 and 0 <= n):
        return 0
    if 32 + name + 4 * cigar + (n + 1) // 2 + n > size:
        return 0
    text = data[at + 36 : at + 36 + name]
    if len(text) == name and (text[-1] or not all(33 <= c <= 126 for c in text[:-1])):
        return 0
    return at + 4 + size if len(text) == name else -1


def beginning(data: bytes) -> int | None:
    """The first place from which on the data are alignments, one after another; at least one must be whole."""
    for first in range(len(data)):
        at, whole = first, 0
        while (end := plausible(data, at)) > 0 and end <= len(data):
            at, whole = end, whole + 1
        if end != 0 and whole:
            return first
    return None


def ends_of(data: bytes, at: int) -> list[int]:
    """Where whole alignments begin from a place on, and where the last of them ends."""
    places, n = [at], len(data)
    while at + 4 <= n:
        end = at + 4 + int.from_bytes(data[at : at + 4], "little", signed=True)
        if end < at + 36:
            raise ValueError("an alignment of a BAM file is broken")
        if end > n:
            break
        places.append(end)
        at = end
    return places


def _field(x: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return x[at[:, None] + np.arange(width)].copy().view(kind).ravel()


def tag_nm(x: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The NM tag of each alignment, 0 where there is none.  at, end: where its tags lie in x."""
    out, zeros = np.zeros(len(at), np.int32), np.nonzero(x == 0)[0]
    live = np.nonzero(at + 3 <= end)[0]
    at = at.copy()
    while len(live):
        p = at[live]
        kind = x[p + 2]
        named = (x[p] == ord("N")) & (x[p + 1] == ord("M"))
        step = np.zeros(len(live), np.int64)
        for c, width in WIDTH.items():
            of = kind == ord(c)
            step[of] = 3 + width
            if c in "cCsSiI" and (of & named).any():
                out[live[of & named]] = _field(x, p[of & named] + 3, {"c": "i1", "C": "u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4"}[c])
        text = (kind == ord("Z")) | (kind == ord("H"))
        if text.any():
            step[text] = zeros[np.searchsorted(zeros, p[text] + 3)] + 1 - p[text]
        array = kind == ord("B")
        if array.any():
            width = np.array([WIDTH.get(chr(c), 0) for c in range(256)])[x[p[array] + 3]]
            step[array] = 8 + width * _field(x, p[array] + 4, "<i4")
        if (step == 0).any():
            raise ValueError("a tag of a BAM file has a type that is none")
        at[live] += step
        live = live[~named & (at[live] + 3 <= end[live])]
    return out


def alignments(data: bytes, places: list[int]) -> dict[str, pa.Array]:
    """Columns of the alignments that begin at places (but the last, an end)."""
    x, p, end = np.frombuffer(data, np.uint8), np.array(places[:-1], np.int64), np.array(places[1:], np.int64)
    get = lambda at, kind: _field(x, p + at, kind)
    name, cigar, n = get(12, "u1").astype(np.int64), get(16, "<u2").astype(np.int64), get(20, "<i4").astype(np.int64)
    names = np.concatenate([[0], np.cumsum(name - 1)]).astype(np.int32)
    text = x[np.repeat(p + 36 - names[:-1], name - 1) + np.arange(names[-1])]
    tags = p + 36 + name + 4 * cigar + (n + 1) // 2 + n
    own = {"flag": get(18, "<u2"), "ref": get(4, "<i4"), "pos": get(8, "<i4") + 1, "mpos": get(28, "<i4") + 1, "tlen": get(32, "<i4"), "nm": tag_nm(x, tags, end), "read_length": n}
    qname = pa.StringArray.from_buffers(len(p), pa.py_buffer(names.tobytes()), pa.py_buffer(text.tobytes()))
    return {"qname": qname} | {c: pa.array(v.astype(np.int32)) for c, v in own.items()}


def _batch(kind: str, file: str, piece: int, columns: dict) -> pa.RecordBatch:
    """A batch of one kind of rows; columns that it lacks are null."""
    n = len(next(iter(columns.values())))
    columns = {"kind": pa.array([kind] * n), "file": pa.array([file] * n), "piece": pa.array([piece] * n, pa.int64())} | columns
    return pa.record_batch([pa.array(columns[f.name], f.type) if isinstance(columns.get(f.name), list) else columns.get(f.name, pa.nulls(n, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def read_piece(file: str, piece: int, blocks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Alignments of a piece, its edges, and the header's rows if it is the first."""
    data, started, head, line = b"", False, b"", 0
    for more in unpacked(blocks):
        data += more
        if not started and piece == 0:
            found = header(data)
            if not found:
                continue
            text, names, at = found
            yield _batch("header", file, 0, {"name": [text]})
            if names:
                yield _batch("reference", file, 0, {"ref": list(range(len(names))), "name": names})
            data, started = data[at:], True
        elif not started and len(data) >= SEARCHED:
            at = beginning(data)
            if at is not None:
                head, data, started = data[:at], data[at:], True
        if started and len(data) >= SEARCHED:
            places = ends_of(data, 0)
            yield from _alignments(file, piece, line, data, places)
            line, data = line + len(places) - 1, data[places[-1] :]
    if not started and piece == 0:
        if not data:
            return
        raise ValueError(f"{file}: the header does not end in the first piece; larger pieces (spark.sql.files.maxPartitionBytes) are needed")
    if not started:
        at = beginning(data)
        head, data, started = (data, b"", False) if at is None else (data[:at], data[at:], True)
    if started:
        places = ends_of(data, 0)
        yield from _alignments(file, piece, line, data, places)
        data = data[places[-1] :]
    yield _batch("edge", file, piece, {"head": [head], "tail": [data], "started": [started]})


def _alignments(file: str, piece: int, line: int, data: bytes, places: list[int]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(places) - 1, BATCH):
        part = places[lo : lo + BATCH + 1]
        yield _batch("alignment", file, piece, {"line": pa.array(np.arange(line + lo, line + lo + len(part) - 1))} | alignments(data, part))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (value, file, piece) as they come, piece by piece."""
    rows = ((v.as_py(), f.as_py(), p.as_py()) for b in batches for v, f, p in zip(b.column("value"), b.column("file"), b.column("piece")))
    row = next(rows, None)
    while row is not None:
        file, piece = row[1:]

        def blocks() -> Iterator[bytes]:
            nonlocal row
            while row is not None and row[1:] == (file, piece):
                yield row[0]
                row = next(rows, None)

        own = blocks()
        yield from read_piece(file, piece, own)
        for _ in own:  # nothing is left of a piece that was read to its end
            pass


def _stitched(table: pa.Table) -> pa.Table:
    """The alignments across pieces of one file, from their edges."""
    out, before, carry = [], 0, b""
    for piece, head, tail, started in sorted(zip(*[table.column(c).to_pylist() for c in ("piece", "head", "tail", "started")])):
        carry += head
        if not started:
            continue
        if carry:
            places = ends_of(carry, 0)
            if places[-1] != len(carry):
                raise ValueError("pieces of a BAM file do not fit together")
            # they follow all lines of the piece before
            out.append(_batch("alignment", table.column("file")[0].as_py(), before, {"line": pa.array(np.arange(len(places) - 1) + (1 << 62))} | alignments(carry, places)))
        before, carry = piece, tail
    if carry:
        raise ValueError("a BAM file ends inside an alignment")
    return pa.Table.from_batches(out, _SCHEMA)


def read_bam(spark: SparkSession, path: str, most_references: int = 5_000_000) -> dict[str, DataFrame]:
    """alignments, with the columns of `sequences.read_sam`; references (rname); headers (file, text).

    Names of references are broadcast if all files have at most `most_references`, else joined.
    """
    raw = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    rows = raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"))
    parsed = cut(rows.mapInArrow(_pieces, FIELDS))
    edges = parsed.filter("kind = 'edge'").groupBy("file").applyInArrow(_stitched, FIELDS)
    references = parsed.filter("kind = 'reference'").select("file", "ref", F.col("name").alias("rname"))
    named = F.broadcast(references) if references.count() <= most_references else references
    both = parsed.filter("kind = 'alignment'").unionByName(edges).join(named, ["file", "ref"], "left")
    ordinal = F.struct("file", "piece", "line").alias("ordinal")
    found = both.select("qname", "flag", F.coalesce("rname", F.lit("*")).alias("rname"), "pos", "mpos", "tlen", F.abs("tlen").alias("isize"), "nm", "read_length", ordinal)
    return {"alignments": found, "references": references.select("rname").distinct(), "headers": parsed.filter("kind = 'header'").select("file", F.col("name").alias("text"))}
