"""Hits files: reads and the features that each may come from, as text or binary.

Text: lines @TranscriptMetaData, @GeneIsoforms and @IdenticalTranscripts, then a line
>read and a line for each feature.  Binary: one zlib stream (or the same bytes as they
are) of a first line that names the format, a schema number, the same three sections, and
each read's name and numbers of features.  Numbers are 32-bit little-endian; names end
with a newline; a read's name that begins or ends like the one before is an empty line, the
length of the common beginning, the letters between, and the length of the common end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambiquant.session import cut

#: The first line of the files written here; readers go by the schema number, whatever it says.
MAGIC = "AMBIQUANT_HITS"
#: Fixed values of the binary layout: its schema number, and the byte before a length of 255 or more.
SCHEMA, LONG = 1, 255
READS = "read string, transcripts array<string>"
#: Rows of the three sections of a header.
HEADER = "section string, name string, effective_length double, true_length int, transcripts array<string>"
STEP = 1 << 16
#: Fixed values of deflate and zlib: what ends a segment, an empty last block, and the modulus of checksums.
MARK, END, ADLER = b"\0\0\xff\xff", b"\x03\0", 65521


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a text file, each a header line or a read with its lines."""
    return spark.read.option("lineSep", "\n>").text(path)


def read_text(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """meta, genes, identical and reads of a text hits file; reads without features are dropped."""
    whole = _records(spark, path)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    head = whole.filter(F.col("value").startswith("@")).select(F.explode(lines).alias("l")).filter(F.col("l").startswith("@"))
    c = F.split("l", "\t")
    rest = F.slice(c, F.lit(3), F.size(c))
    body = whole.select(F.regexp_replace("value", "^>", "").alias("value"))
    # the first chunk holds the header lines and, behind them, nothing of a read
    reads = body.filter(~F.col("value").startswith("@")).select(F.transform(lines, lambda x: F.trim(x)).alias("x"))
    return {
        "meta": head.filter(c[0] == "@TranscriptMetaData").select(c[1].alias("transcript"), c[2].cast("double").alias("effective_length"), c[3].cast("int").alias("true_length")),
        "genes": head.filter(c[0] == "@GeneIsoforms").select(c[1].alias("gene"), rest.alias("transcripts")),
        "identical": head.filter(c[0] == "@IdenticalTranscripts").select(F.slice(c, F.lit(2), F.size(c)).alias("transcripts")),
        "reads": reads.filter(F.size("x") > 1).select(F.get("x", F.lit(0)).alias("read"), F.slice("x", F.lit(2), F.size("x")).alias("transcripts")),
    }


def text_lines(meta: DataFrame, genes: DataFrame, identical: DataFrame) -> DataFrame:
    """Header lines, numbered in the order of the format."""
    tab = "\t"
    return (
        meta.select(F.lit(0).alias("n"), F.concat_ws(tab, F.lit("@TranscriptMetaData"), "transcript", F.format_string("%s", "effective_length"), "true_length").alias("value"))
        .union(genes.select(F.lit(1), F.concat_ws(tab, F.lit("@GeneIsoforms"), "gene", F.array_join("transcripts", tab))))
        .union(identical.select(F.lit(2), F.concat_ws(tab, F.lit("@IdenticalTranscripts"), F.array_join("transcripts", tab))))
    )


def write_text(reads: DataFrame, meta: DataFrame, genes: DataFrame, identical: DataFrame, path: str) -> None:
    """Part files in order: the header's, then reads'."""
    head = text_lines(meta, genes, identical).orderBy("n", "value").select("value").coalesce(1)
    body = reads.select(F.concat(F.lit(">"), F.col("read"), F.lit("\n"), F.array_join("transcripts", "\n")).alias("value"))
    head.union(body).write.mode("overwrite").text(path)


def shared_prefix(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _u32(*numbers: int) -> bytes:
    return struct.pack(f"<{len(numbers)}I", *numbers)


def _line(name: str) -> bytes:
    if "\n" in name or not name:
        raise ValueError(f"no name for a hits file: {name!r}")
    return name.encode() + b"\n"


def _length(n: int) -> bytes:
    return bytes([n]) if n < LONG else bytes([LONG]) + _u32(n)


def header_bytes(meta: Sequence[tuple], genes: Sequence[tuple], identical: Sequence[Sequence[str]], magic: str = MAGIC) -> bytes:
    """Everything before the reads.  meta: name, effective length, true length; genes: name, members."""
    out = [_line(magic), _u32(SCHEMA, len(meta))]
    for name, effective, true in meta:
        out += [_line(name), _line(repr(float(effective or 0))), _u32(int(true or 0))]
    out.append(_u32(len(genes)))
    for gene, members in genes:
        out += [_line(gene), _u32(len(members)), *map(_line, members)]
    out.append(_u32(len(identical)))
    for members in identical:
        out += [_u32(len(members)), *map(_line, members)]
    return b"".join(out)


def read_bytes(reads: Iterable[tuple[str, Sequence[str]]], number: dict[str, int]) -> Iterator[bytes]:
    """The records of reads, in their order; number: the place of each feature in the header."""
    before = b""
    for read, members in reads:
        name = _line(read)[:-1]
        head = shared_prefix(before, name)
        tail = shared_prefix(before[head:][::-1], name[head:][::-1])
        short = b"\n" + _length(head) + name[head : len(name) - tail] + b"\n" + _length(tail)
        yield (short if head or tail else name + b"\n") + _u32(len(members), *[number[t] for t in members])
        before = name


def pack(reads: list[tuple[str, list[str]]], meta: Sequence[tuple] | None = None, genes: Sequence[tuple] = (), identical: Sequence[Sequence[str]] = (), magic: str = MAGIC) -> bytes:
    """A binary file; without meta its header has the features of the reads, with lengths 0."""
    meta = [(t, 0.0, 0) for t in sorted({t for _, ts in reads for t in ts})] if meta is None else meta
    number = {m[0]: i for i, m in enumerate(meta)}
    return zlib.compress(header_bytes(meta, genes, identical, magic) + b"".join(read_bytes(reads, number)), 1)


class _Body:
    """The bytes of a binary file, unpacked as they are asked for."""

    def __init__(self, packed: bytes) -> None:
        self.packed, self.at, self.ready, self.place = packed, 0, b"", 0
        self.inflate = zlib.decompressobj() if packed[:1] == b"\x78" else None

    def _more(self) -> bool:
        piece = self.packed[self.at : self.at + STEP]
        self.at += len(piece)
        if not piece:
            if self.inflate and not self.inflate.eof:
                raise ValueError("the hits file is cut off")
            return False
        self.ready, self.place = self.ready[self.place :] + (self.inflate.decompress(piece) if self.inflate else piece), 0
        return True

    def done(self) -> bool:
        while self.place == len(self.ready):
            if not self._more():
                return True
        return False

    def line(self) -> bytes:
        while (end := self.ready.find(b"\n", self.place)) < 0:
            if not self._more():
                raise ValueError("the hits file is cut off")
        found, self.place = self.ready[self.place : end], end + 1
        return found

    def take(self, n: int) -> bytes:
        while len(self.ready) - self.place < n:
            if not self._more():
                raise ValueError("the hits file is cut off")
        self.place += n
        return self.ready[self.place - n : self.place]

    def numbers(self, n: int) -> tuple[int, ...]:
        return struct.unpack(f"<{n}I", self.take(4 * n))

    def number(self) -> int:
        return self.numbers(1)[0]

    def length(self) -> int:
        n = self.take(1)[0]
        return self.number() if n == LONG else n

    def names(self, n: int) -> list[str]:
        return [self.line().decode() for _ in range(n)]


def _header(b: _Body) -> dict[str, list]:
    b.line()
    if b.number() != SCHEMA:
        raise ValueError("not a binary hits file")
    return {
        "meta": [(b.line().decode(), float(b.line()), b.number()) for _ in range(b.number())],
        "genes": [(b.line().decode(), b.names(b.number())) for _ in range(b.number())],
        "identical": [b.names(b.number()) for _ in range(b.number())],
    }


def unpack_header(packed: bytes) -> dict[str, list]:
    """meta, genes and identical of a binary file."""
    return _header(_Body(packed))


def unpack(packed: bytes) -> Iterator[tuple[str, list[str]]]:
    """The reads of a binary file, one after the other."""
    b = _Body(packed)
    names = [m[0] for m in _header(b)["meta"]]
    before = b""
    while not b.done():
        name = b.line()
        if not name:
            head, middle, tail = b.length(), b.line(), b.length()
            name = before[:head] + middle + before[len(before) - tail :]
        yield name.decode(), [names[i] for i in b.numbers(b.number())]
        before = name


def to_binary(reads: DataFrame) -> DataFrame:
    """A binary file in each row, one for each batch of a partition, by name so that names are short."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"body": [pack([(r, list(t)) for r, t in zip(b["read"], b["transcripts"])])]})

    return reads.select("read", "transcripts").sortWithinPartitions("read").mapInPandas(run, "body binary")


def from_binary(bodies: DataFrame, batch: int = 10_000) -> DataFrame:
    """Reads of binary files (a column body, or content of Spark's binaryFile source)."""
    column = "body" if "body" in bodies.columns else "content"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for packed in b[column]:
                found = unpack(packed)
                while part := [r for _, r in zip(range(batch), found)]:
                    yield pd.DataFrame(part, columns=["read", "transcripts"])

    return bodies.select(column).mapInPandas(run, READS)


def _segment(raw: bytes) -> bytes:
    """Deflated bytes that need nothing before them and end where a byte ends, without the mark of that."""
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    return (c.compress(raw) + c.flush(zlib.Z_FULL_FLUSH))[: -len(MARK)]


def _inflated(piece: bytes) -> bytes | None:
    """What a segment holds; null if the piece is none."""
    z = zlib.decompressobj(-15)
    try:
        out = z.decompress(piece + MARK)
    except zlib.error:
        return None
    return out if not z.unconsumed_tail and (not z.eof or len(z.unused_data) >= len(MARK)) else None


def _joined_adler(a: int, b: int, length: int) -> int:
    """The checksum of two stretches of bytes, from theirs and the second one's length."""
    low, high = a & 0xFFFF, a >> 16
    l2, h2 = b & 0xFFFF, b >> 16
    return ((high + h2 + length * (low - 1)) % ADLER << 16) | (low + l2 - 1) % ADLER


def _records_of(raw: bytes) -> list[tuple[str, tuple[int, ...]]] | None:
    """Reads and feature numbers of whole records; null if the bytes are none."""
    b, out, before = _Body(b""), [], b""
    b.ready = raw
    try:
        while not b.done():
            name = b.line()
            if not name:
                head, middle, tail = b.length(), b.line(), b.length()
                if head + tail > len(before):
                    return None
                name = before[:head] + middle + before[len(before) - tail :]
            out.append((name.decode(), b.numbers(b.number())))
            before = name
    except (ValueError, struct.error):
        return None
    return out


def _whole(pieces: Iterator[bytes], first: bool) -> Iterator[tuple[dict | None, list]]:
    """Header and records of the segments of one stretch of a file.

    Bytes like a mark may lie inside a segment: what does not unpack to whole records is joined to what follows.
    """
    held = b""
    for piece in pieces:
        held = held + MARK + piece if held else piece
        if first:
            # a file by other writers has one stream, and so has all its reads here
            if held[:1] != b"\x78":
                first = False
            else:
                z = zlib.decompressobj(-15)
                try:
                    body = _Body(b"")
                    body.ready = z.decompress(held[2:] + MARK)
                    head = _header(body)
                    rest = _records_of(body.ready[body.place :])
                except (ValueError, zlib.error, struct.error):
                    continue
                if rest is not None:
                    yield head, rest
                    held, first = b"", False
                continue
        if held[:2] == END or not held.strip(b"\0\xff"):
            held = b""  # the end of the stream and its checksum
            continue
        raw = _inflated(held)
        found = None if raw is None else _records_of(raw)
        if found is not None:
            yield None, found
            held = b""
    if held.strip(b"\0\xff"):
        raise ValueError("the hits file is cut off, or a segment is larger than a piece of it")


def read_binary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of a binary file, or of the folder that `write_binary` makes, as read_text gives them.

    Segments are found by the mark between them, so a file is read by as many tasks as Spark cuts it
    for.  A file that was packed in one piece (or not at all) is one segment and one task, of at most 2 GB.
    Several files with headers may be read together; a folder's files share the one header.
    """
    raw = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MARK.decode("latin-1")).text(path)
    rows = raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"))
    schema = pa.schema([("file", pa.string()), ("section", pa.string()), ("name", pa.string()), ("effective_length", pa.float64()), ("true_length", pa.int32()), ("transcripts", pa.list_(pa.string())), ("numbers", pa.list_(pa.int32()))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ((v.as_py(), (f.as_py(), p.as_py())) for b in batches for v, f, p in zip(b.column("value"), b.column("file"), b.column("piece")))
        for (file, piece), own in groupby(every, key=lambda x: x[1]):
            pieces = (v for v, _ in own)
            start = next(pieces, b"")
            if piece == 0 and start[:1] != b"\x78" and start.find(b"\n") >= 0 and struct.pack("<I", SCHEMA) == start[start.find(b"\n") + 1 :][:4]:
                # not packed at all: bytes like marks are bytes
                body = _Body(MARK.join([start, *pieces]))
                parts: Iterator = iter([(_header(body), _records_of(body.ready[body.place :] + body.packed[body.at :]))])
            else:
                parts = _whole(chain([start], pieces), piece == 0)
            for head, reads in parts:
                if head is not None:
                    found = [(file, "names", None, None, None, [m[0] for m in head["meta"]], None)]
                    found += [(file, "meta", *m, None, None) for m in head["meta"]] + [(file, "genes", g, None, None, ts, None) for g, ts in head["genes"]]
                    yield batch(found + [(file, "identical", None, None, None, ts, None) for ts in head["identical"]])
                if reads is None:
                    raise ValueError("the hits file is cut off")
                for lo in range(0, len(reads), STEP):
                    yield batch([(file, "reads", r, None, None, None, list(n)) for r, n in reads[lo : lo + STEP]])

    found = cut(rows.mapInArrow(run, "file string, section string, name string, effective_length double, true_length int, transcripts array<string>, numbers array<int>"))
    head = found.drop("file", "numbers").distinct()  # files of one run repeat their header
    part = lambda section: head.filter(F.col("section") == section)
    # a row a file, with the names of the annotation's features
    names = found.filter("section = 'names'").select(F.col("file").alias("_file"), F.col("transcripts").alias("names"))
    reads = found.filter("section = 'reads'").select("file", F.col("name").alias("read"), "numbers")
    count = names.count()
    if count == 0:
        raise ValueError(f"{path}: no header of a hits file")
    joined = reads.crossJoin(F.broadcast(names)) if count == 1 else reads.join(F.broadcast(names), F.col("file") == F.col("_file"))
    return {
        "meta": part("meta").select(F.col("name").alias("transcript"), "effective_length", "true_length"),
        "genes": part("genes").select(F.col("name").alias("gene"), "transcripts"),
        "identical": part("identical").select("transcripts"),
        "reads": joined.select("read", F.transform("numbers", lambda i: F.element_at("names", i + 1)).alias("transcripts")).filter(F.size("transcripts") > 0),
    }


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of a hits file, text or binary, as its first lines tell: those of text hold no control characters."""
    first = [r[0] for r in spark.read.text(path).take(20)]
    text = all(c in "\t\r" or (c >= " " and c != "\ufffd") for line in first for c in line)
    return read_text(spark, path) if text and (not first or first[0][:1] in ("@", ">")) else read_binary(spark, path)


def write_binary(parts: dict[str, DataFrame], path: str, magic: str = MAGIC) -> None:
    """A folder of part files that are, one after another, a binary file: `cat path/part-*` joins them.

    Tasks pack segments of reads, each with a name in full at its start and nothing that it needs of others, and
    Spark's text writer puts the mark of a segment's end after each.  Their checksums, 20 bytes a segment, are
    joined for the end of the stream; after it one mark is left, which readers of such streams don't look at.  The
    driver holds the header, which is as large as the annotation.
    """
    spark = parts["reads"].sparkSession
    meta = [tuple(r) for r in parts["meta"].select("transcript", "effective_length", "true_length").orderBy("transcript").collect()]
    genes = [tuple(r) for r in parts["genes"].select("gene", "transcripts").orderBy("gene").collect()]
    identical = [r[0] for r in parts["identical"].select("transcripts").collect()]
    head = header_bytes(meta, genes, identical, magic)
    number = spark.sparkContext.broadcast({m[0]: i for i, m in enumerate(meta)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b"".join(read_bytes(zip(b.column("read").to_pylist(), b.column("transcripts").to_pylist()), number.value))
            if raw:
                yield pa.record_batch({"body": pa.array([_segment(raw)], pa.binary()), "adler": pa.array([zlib.adler32(raw)], pa.int64()), "size": pa.array([len(raw)], pa.int64())})

    packed = parts["reads"].select("read", "transcripts").sortWithinPartitions("read").mapInArrow(run, "body binary, adler bigint, size bigint")
    segments = cut(packed.withColumn("n", F.monotonically_increasing_id()))
    adler = zlib.adler32(head)
    for r in segments.select("n", "adler", "size").orderBy("n").collect():
        adler = _joined_adler(adler, r["adler"], r["size"])
    ends = [spark.createDataFrame([(x,)], "body binary").coalesce(1) for x in (b"\x78\x01" + _segment(head), END + struct.pack(">I", adler))]
    whole = ends[0].union(segments.select("body")).union(ends[1]).select(F.col("body").cast("string").alias("value"))
    whole.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", MARK.decode("latin-1")).text(path)


def inspect(parts: dict[str, DataFrame], first: int = 3) -> dict[str, tuple[list, int]]:
    """The first rows and the number of rows of each part."""
    return {k: (d.limit(first).collect(), d.count()) for k, d in parts.items()}
