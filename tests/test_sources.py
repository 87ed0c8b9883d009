import random
import zlib

import pytest

from ambiquant.sources import hits, tables
from ambiquant.sources import sequences as src

READS = [("read1", ["tA", "tB"]), ("read2", ["tC"]), ("read22x", ["tA"])]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">t1 gene:g1 z\nACG\nTT\n>t2 gene:g2\nGG\n")
    f = src.header_ids(src.read_fasta(spark, str(tmp_path / "x.fa")))
    assert sorted(tuple(r) for r in f.select("transcript", "gene", "seq").collect()) == [("t1", "g1", "ACGTT"), ("t2", "g2", "GG")]
    src.write_fasta(f.select("header", "seq"), str(tmp_path / "out"))
    again = src.read_fasta(spark, str(tmp_path / "out"))
    assert sorted(r["seq"] for r in again.collect()) == ["ACGTT", "GG"]
    assert src.grep_entries(f, "g1", invert=True).count() == 1


def test_sam_gtf_vcf(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.0\n@SQ\tSN:t1\tLN:9\nr1\t99\tt1\t5\t9\t*\t=\t20\t-120\tACGT\t*\tNM:i:2\n")
    a = src.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert (a["isize"], a["nm"], a["mpos"], a["read_length"]) == (120, 2, 20, 4)
    assert src.sort_order(spark, str(tmp_path / "a.sam")) is None
    assert src.sam_references(spark, str(tmp_path / "a.sam")).first()[0] == "t1"
    (tmp_path / "a.gtf").write_text('#c\n1\ts\texon\t100\t200\t.\t+\t.\tgene_id "g"; transcript_id "t";\n1\ts\tCDS\t1\t2\t.\t+\t.\tx\n')
    g = src.read_gtf(spark, str(tmp_path / "a.gtf")).collect()
    assert [(r["transcript_id"], r["gene_id"], r["start"]) for r in g] == [("t", "g", 100)]
    (tmp_path / "a.vcf").write_text("#h\n1\t50\t.\tAT\tA\t30\tPASS\tx\n1\t60\t.\tA\tC\t.\tq10\tx\n")
    v = src.read_vcf(spark, str(tmp_path / "a.vcf"))
    assert src.strain_variants(v, 20).count() == 1


def test_hits_text_and_binary(spark, tmp_path):
    reads = spark.createDataFrame(READS, hits.READS)
    meta = spark.createDataFrame([("tA", 100.5, 200)], "transcript string, effective_length double, true_length int")
    genes = spark.createDataFrame([("g", ["tA", "tB"])], "gene string, transcripts array<string>")
    same = spark.createDataFrame([(["tA", "tB"],)], "transcripts array<string>")
    hits.write_text(reads, meta, genes, same, str(tmp_path / "h"))
    back = hits.read_text(spark, str(tmp_path / "h"))
    assert sorted((r[0], list(r[1])) for r in back["reads"].collect()) == READS
    assert tuple(back["meta"].first()) == ("tA", 100.5, 200)
    assert list(back["genes"].first()[1]) == ["tA", "tB"] and list(back["identical"].first()[0]) == ["tA", "tB"]
    assert list(hits.unpack(hits.pack(READS))) == READS
    # the layout byte by byte, as it is published
    u = lambda *n: b"".join(x.to_bytes(4, "little") for x in n)
    body = b"ANY NAME\n" + u(1, 2) + b"tA\n100.500000\n" + u(200) + b"tB\n2\n" + u(9) + u(1) + b"g\n" + u(2) + b"tA\ntB\n" + u(0)
    body += b"read1\n" + u(2, 0, 1) + b"\n\x04" + b"2\n\x00" + u(1, 1) + b"other\n" + u(0)
    assert hits.unpack_header(body) == {"meta": [("tA", 100.5, 200), ("tB", 2.0, 9)], "genes": [("g", ["tA", "tB"])], "identical": []}
    assert list(hits.unpack(body)) == [("read1", ["tA", "tB"]), ("read2", ["tB"]), ("other", [])]
    for bad in (hits.pack(READS)[:-9], body[:-2], b"z\n" + u(7)):
        with pytest.raises(ValueError):
            list(hits.unpack(bad))
    assert sorted((r[0], list(r[1])) for r in hits.from_binary(hits.to_binary(reads)).collect()) == READS


def test_tables(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("# Mapped fragments: 123\nfeature_id\tlog_mu\tsd\tunique_hits\tpercentiles5,50\nt1\t1.5\tNA\t3\t1,2\nt2\tnan\tinf\t0\tNA,NA\n")
    q = {r["feature_id"]: r for r in tables.read_quant(spark, str(tmp_path / "q.tsv")).collect()}
    assert q["t1"]["sd"] is None and list(q["t1"]["percentiles"]) == [1.0, 2.0] and q["t1"]["unique_hits"] == 3
    assert q["t2"]["sd"] == float("inf") and q["t2"]["log_mu"] != q["t2"]["log_mu"] and list(q["t2"]["percentiles"]) == [None, None]
    assert tables.mapped_fragments(spark, str(tmp_path / "q.tsv")).first()[0] == 123
    (tmp_path / "t.txt").write_text("a b\n1 2\n3 4\n")
    assert sorted(tuple(r) for r in tables.read_trace(spark, str(tmp_path / "t.txt")).collect()) == [("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 2.0), ("b", 1, 4.0)]
    (tmp_path / "x.M").write_text("#\ta\tb\n0 0\n0 1\n1 1\n1 1\n")
    (tmp_path / "x.k").write_text("5\n7\n")
    assert sorted(tuple(r) for r in tables.read_incidence(spark, str(tmp_path / "x.M"), str(tmp_path / "x.k")).collect()) == [(0, "a", 5), (0, "b", 5), (1, "b", 7)]
    m = tables.parse_matrices("# M\n0\n0\n\n# C\n0 0\n0 1\n")
    assert [x.shape for x in m] == [(2, 1), (2, 2)]
    meta = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "transcript string, effective_length double")
    new = spark.createDataFrame([("x_B", 9.0)], "transcript string, length double")
    assert sorted(tuple(r) for r in tables.adjusted_lengths(meta, new).collect()) == [("x", 9.0), ("y", 2.0)]


def test_class_stream(spark, tmp_path):
    from ambiquant.streaming.classes import class_stream

    spark.createDataFrame(READS, hits.READS).write.parquet(str(tmp_path / "in"))
    q = class_stream(spark.readStream.schema(hits.READS).parquet(str(tmp_path / "in")), "class_counts")
    q.processAllAvailable()
    assert spark.table("class_counts").count() == 3
    q.stop()


def test_binary_hits_in_parallel(spark, tmp_path):
    """Many segments in several part files: joined they are one stream for the plain reader; Spark reads each form in several tasks."""
    rnd = random.Random(3)
    names = [f"t{k:03d}" for k in range(300)]
    rows = [(f"run:{rnd.randrange(10**6)}:{i}", sorted(rnd.sample(names, rnd.randint(0, 4)))) for i in range(30_000)]
    parts = {
        "reads": spark.createDataFrame(rows, hits.READS).repartition(5),
        "meta": spark.createDataFrame([(n, 1.5, 9) for n in names], "transcript string, effective_length double, true_length int"),
        "genes": spark.createDataFrame([("g", names[:2])], "gene string, transcripts array<string>"),
        "identical": spark.createDataFrame([(names[:2],)], "transcripts array<string>"),
    }
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    hits.write_binary(parts, str(tmp_path / "h"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before["spark.sql.execution.arrow.maxRecordsPerBatch"])
    whole = b"".join(f.read_bytes() for f in sorted((tmp_path / "h").glob("part-*")))
    assert sorted(hits.unpack(whole)) == sorted(rows) and hits.unpack_header(whole)["genes"] == [("g", names[:2])]
    z = zlib.decompressobj()
    z.decompress(whole)
    assert z.eof and z.unused_data == hits.MARK  # the checksum is right
    (tmp_path / "one.bin").write_bytes(whole)
    (tmp_path / "plain.bin").write_bytes(hits.pack(rows, [(n, 1.5, 9) for n in names]))
    (tmp_path / "bare.bin").write_bytes(zlib.decompress(hits.pack(rows[:5000], [(n, 1.5, 9) for n in names])))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, n in (("h", 30_000), ("one.bin", 30_000), ("plain.bin", 30_000), ("bare.bin", 5000)):
            got = hits.read(spark, str(tmp_path / name))
            found = sorted((r[0], list(r[1])) for r in got["reads"].collect())
            assert found == sorted((r, t) for r, t in rows[:n] if t), name
            assert got["meta"].count() == 300
            if name in ("h", "one.bin"):
                assert spark.read.text(str(tmp_path / name)).rdd.getNumPartitions() > 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_marks_inside_segments():
    """Pieces that a mark inside a segment cuts are joined again."""
    numbers = {"a": 0, "b": 1}
    raw = b"".join(hits.read_bytes([(f"r{i}", ["a", "b"][: i % 3]) for i in range(2000)], numbers))
    segment = hits._segment(raw)
    want = [(f"r{i}", tuple(range(i % 3))) for i in range(2000)]
    for cut in (1, 7, len(segment) // 2):
        if hits._inflated(segment[:cut]) is None or hits._records_of(hits._inflated(segment[:cut])) is None:
            glued = [segment[:cut], segment[cut:]]
            assert hits.MARK.join(glued) != segment
    assert [r for _, part in hits._whole(iter([segment, segment]), False) for r in part] == want * 2
    with pytest.raises(ValueError):
        list(hits._whole(iter([segment[:-20]]), False))
    assert hits._joined_adler(zlib.adler32(b"abc" * 999), zlib.adler32(b"xyz" * 777), 2331) == zlib.adler32(b"abc" * 999 + b"xyz" * 777)
