"""BAM files in several pieces, against the SAM text of the same alignments."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from ambiquant import cli
from ambiquant.sources import bam, hits
from ambiquant.sources import sequences as src

REFS = [("a", 400), ("b", 500), ("chr|odd name", 9)]


def packed(data, size=20_000):
    """Blocks of a BAM file, and the empty one at its end."""
    out = []
    for lo in [*range(0, len(data), size), None]:
        body = b"" if lo is None else data[lo : lo + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        z = c.compress(body) + c.flush()
        out.append(bam.MAGIC + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(z) + 25) + z + struct.pack("<II", zlib.crc32(body), len(body)))
    return b"".join(out)


def tag(rnd, nm):
    tags = [b"ZSZ" + b"text\0", b"BBBS" + struct.pack("<iHH", 2, 7, 8), b"XXA!", b"FFf" + struct.pack("<f", 1.5), b"MDZ" + b"4\0"]
    rnd.shuffle(tags)
    if nm is not None:
        kind = rnd.choice("cCsSiI") if nm < 100 else rnd.choice("sSiI")
        tags.insert(rnd.randrange(4), b"NM" + kind.encode() + struct.pack("<" + {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}[kind], nm))
    return b"".join(tags)


def lines(n, seed=1):
    """(name, flag, reference, pos, mpos, tlen, nm, sequence length); pos is 1-based, 0 for none."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        ref = rnd.randrange(-1, 3)
        out.append((f"read{i // 2}:{'x' * rnd.randrange(9)}", rnd.choice([99, 147, 4, 77]), ref, 0 if ref < 0 else rnd.randrange(1, 300), rnd.randrange(0, 300), rnd.randrange(-300, 300), rnd.choice([None, 0, 3, 255, 70]), rnd.choice([0, 1, 4, 75])))
    return out


def as_bam(rows, refs=REFS, text="@HD\tVN:1.0\tSO:queryname\n"):
    rnd, t = random.Random(2), text.encode()
    data = bam.FILE + struct.pack("<i", len(t)) + t + struct.pack("<i", len(refs))
    for name, length in refs:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    for q, flag, ref, pos, mpos, tlen, nm, n in rows:
        cigar = struct.pack("<I", n << 4) if n else b""
        seq, qual = bytes(rnd.randrange(256) for _ in range((n + 1) // 2)), bytes(rnd.randrange(40) for _ in range(n))
        body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(q) + 1, 9, 0, len(cigar) // 4, flag, n, ref, mpos - 1, tlen) + q.encode() + b"\0" + cigar + seq + qual + tag(rnd, nm)
        data += struct.pack("<i", len(body)) + body
    return data


def as_sam(rows):
    named = lambda r: REFS[r][0] if r >= 0 else "*"
    return "@HD\tVN:1.0\tSO:queryname\n" + "".join(
        "\t".join(map(str, (q, flag, named(ref), pos, 9, f"{n}M" if n else "*", "=", mpos, tlen, "A" * n or "*", "*"))) + ("" if nm is None else f"\tNM:i:{nm}") + "\n" for q, flag, ref, pos, mpos, tlen, nm, n in rows
    )


def rows_of(df):
    columns = ["qname", "flag", "rname", "pos", "mpos", "isize", "tlen", "nm", "read_length"]
    return [tuple(r) for r in df.orderBy("ordinal").select(columns).collect()]


@pytest.fixture()
def small_pieces(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_equal_to_sam_text_in_several_pieces(spark, tmp_path, small_pieces):
    rows = lines(9000)
    data = packed(as_bam(rows))
    assert data.count(bam.MAGIC) > 40
    (tmp_path / "x.bam").write_bytes(data)
    (tmp_path / "x.sam").write_text(as_sam(rows))
    got = bam.read_bam(spark, str(tmp_path / "x.bam"))
    assert got["alignments"].select("ordinal.piece").distinct().count() > 3
    assert rows_of(got["alignments"]) == rows_of(src.read_sam(spark, str(tmp_path / "x.sam")))
    assert sorted(r[0] for r in got["references"].collect()) == sorted(n for n, _ in REFS)
    assert src.order_of(got["headers"].select(F.explode(F.split("text", "\n")).alias("value"))) == "queryname"


def test_long_alignments_and_several_files(spark, tmp_path, small_pieces):
    """Alignments longer than a piece, files with references of their own, an empty file of alignments."""
    (tmp_path / "in").mkdir()
    rows = [("long" + str(i), 0, 0, 5, 0, 0, 1, n) for i, n in enumerate((10, 150_000, 20, 90_000, 5))]
    (tmp_path / "in" / "1.bam").write_bytes(packed(as_bam(rows)))
    (tmp_path / "in" / "2.bam").write_bytes(packed(as_bam(rows[:1], [("other", 4)])))
    (tmp_path / "in" / "3.bam").write_bytes(packed(as_bam([])))
    got = bam.read_bam(spark, str(tmp_path / "in"))["alignments"]
    assert sorted((r["qname"], r["rname"], r["read_length"]) for r in got.collect()) == sorted([(r[0], "a", r[7]) for r in rows] + [("long0", "other", 10)])


def test_separator_inside_a_block():
    a, b = packed(b"first" * 50)[4:].split(bam.MAGIC)[0], packed(b"second")[4:].split(bam.MAGIC)[0]
    cut = len(a) // 2
    part = a[:cut] + bam.MAGIC + a[cut + 4 :]
    assert bam.block_size(part) == len(a)
    with pytest.raises(zlib.error):  # joined again, and then no deflate stream, as bytes were overwritten
        list(bam.unpacked(iter([a[:cut], a[cut + 4 :], b])))
    assert list(bam.unpacked(iter([b"", a, b]))) == [b"first" * 50, b"second"]
    with pytest.raises(ValueError):
        list(bam.unpacked(iter([a[:-9]])))


def test_broken_files(spark, tmp_path):
    data = as_bam(lines(300))
    for name, body in (("cut", packed(data[:-3])), ("none", packed(b"text" * 100))):
        (tmp_path / f"{name}.bam").write_bytes(body)
        with pytest.raises(Exception, match="ends inside|not a BAM file"):
            bam.read_bam(spark, str(tmp_path / f"{name}.bam"))["alignments"].count()


def test_beginnings():
    data = as_bam(lines(60))
    first = bam.header(data)[2]
    places = bam.ends_of(data, first)
    for at in range(first, first + 2000):
        assert bam.beginning(data[at:]) == min(p for p in places if p >= at) - at


def test_make_hits_from_bam(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a gene:g\n" + "ACGT" * 100 + "\n>b gene:g\n" + "ACGA" * 100 + "\n")
    rows = [x for i in range(40) for x in ((f"r{i}", 99, i % 2, 5, 150, 170, 0, 4), (f"r{i}", 147, i % 2, 150, 5, -170, 0, 4))]
    (tmp_path / "x.bam").write_bytes(packed(as_bam(rows, REFS[:2]), 1000))
    cli.main(["make-hits", "--sam", str(tmp_path / "x.bam"), "--fasta", str(tmp_path / "x.fa"), "--out", str(tmp_path / "hits")], spark)
    found = {r["read"]: r["transcripts"] for r in hits.read(spark, str(tmp_path / "hits"))["reads"].collect()}
    assert found == {f"r{i}": ["ab"[i % 2]] for i in range(40)}
