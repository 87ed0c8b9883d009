import random

import pytest

from ambiquant import cli
from ambiquant.operators import alignments as al
from ambiquant.sources import hits, tables
from ambiquant.sources import sequences as src


def test_hits_quantify_and_compare(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a gene:g\n" + "ACGT" * 100 + "\n>b gene:g\n" + "ACGA" * 100 + "\n>c gene:h\n" + "TTTT" * 100 + "\n")
    line = "{0}\t0\t{1}\t5\t9\t*\t*\t0\t0\tACGT\t*\tNM:i:0"
    rows = [line.format(f"r{i}", t) for i in range(40) for t in (["a", "b"] if i % 4 == 0 else ["a"])] + [line.format(f"q{i}", "b") for i in range(10)]
    (tmp_path / "x.sam").write_text("@SQ\tSN:a\tLN:400\n" + "\n".join(rows) + "\n")
    p = lambda name: str(tmp_path / name)
    cli.main(["make-hits", "--sam", p("x.sam"), "--fasta", p("x.fa"), "--out", p("hits"), "--no-paired"], spark)
    cli.main(["quantify", "--hits", p("hits"), "--out", p("q"), "--gibbs-iter", "1024", "--max-em-iter", "20"], spark)
    q = {r["feature_id"]: r for r in tables.read_quant(spark, p("q/features")).collect()}
    assert q["a"]["log_mu"] > q["b"]["log_mu"] > q["c"]["log_mu"] and q["c"]["observed"] == 0 and q["a"]["unique_hits"] == 30
    g = {r["feature_id"]: r for r in tables.read_quant(spark, p("q/genes")).collect()}
    assert g["g"]["log_mu"] > q["a"]["log_mu"] and g["g"]["observed"] == 2 and g["h"]["observed"] == 0 and g["h"]["iact"] == 1 and g["h"]["ntranscripts"] == 1
    assert abs(q["a"]["mean_proportion"] + q["b"]["mean_proportion"] - 1) < 1e-9 and q["c"]["mean_proportion"] == 1 and q["c"]["mean_probit_proportion"] == float("inf")
    assert (q["a"]["ntranscripts"], q["c"]["ntranscripts"]) == (2, 1) and len(q["c"]["percentiles"]) == len(q["a"]["percentiles_proportion"]) == 5
    assert tables.mapped_fragments(spark, p("q/genes")).first()[0] == 50
    cli.main(["quantify", "--hits", p("hits"), "--out", p("q2"), "--gibbs-iter", "1024", "--max-em-iter", "20", "--seed", "5", "--debug"], spark)
    assert spark.read.csv(p("q2/debug/classes"), sep="\t", header=True).count() == 3
    cli.main(["collapse", "--out", p("c"), p("q"), p("q2"), "--hits", p("hits"), p("hits"), "--bound", "-0.01"], spark)
    c = {r["feature_id"]: r for r in tables.read_quant(spark, p("c/0_q")).collect()}
    assert set(c) in ({"a", "b", "c"}, {"a*b", "c"}) and tables.read_quant(spark, p("c/sets")).count() == len(c) % 3 // 2
    cli.main(["compare", "--out", p("bf"), "--groups", "2", "1", "--burnin", "1024", "--iterations", "1024", "--no-normalisation", *[p("q/features")] * 3], spark)
    bf = tables.read_quant(spark, p("bf"))
    assert bf.count() == 3 and "beta0_0" not in bf.columns and "eta1_0" in bf.columns and bf.columns[-4:-1] == [f"sd_{i}:features" for i in range(3)]
    a = bf.filter("feature_id = 'a'").first()
    assert abs(float(a["mu_0:features"]) - q["a"]["log_mu"]) < 1e-9 and "#prior_probability=0.1" in [r[0] for r in spark.read.text(p("bf")).collect()]
    cli.main(["compare", "--out", p("bf2"), "--groups", "2", "1", "--burnin", "1024", "--iterations", "1024", "--useprops", *[p("q/features")] * 3], spark)
    assert {r["feature_id"] for r in tables.read_quant(spark, p("bf2")).collect()} == {"a", "b"}
    cli.main(["compare", "--out", p("bf3"), "--groups", "2", "1", "--burnin", "1024", "--iterations", "1024", "--no-normalisation", "--range", "1", "2", *[p("q/features")] * 3], spark)
    got = {r["feature_id"]: r["bayes_factor"] for r in tables.read_quant(spark, p("bf3")).collect()}
    assert got == {r["feature_id"]: r["bayes_factor"] for r in bf.collect() if r["feature_id"] != "a"}
    cli.main(["polyclass", "--out", p("poly"), p("bf"), p("bf"), "--model-prior", "0.5", "0.25", "0.25"], spark)
    total = [sum(float(r[f"postprob_model{i}"]) for i in range(3)) for r in tables.read_quant(spark, p("poly")).collect()]
    assert len(total) == 3 and all(abs(x - 1) < 1e-9 for x in total)


def test_genes_with_unseen_members_and_merged_haplotypes(spark, tmp_path):
    """Mates that name different haplotypes meet once names are merged; an unseen member adds to its gene's trace."""
    (tmp_path / "x.fa").write_text("".join(f">{n} gene:{g}\n{s * 100}\n" for n, g, s in (("t_A", "g", "ACGT"), ("t_B", "g", "ACGA"), ("u_A", "g", "TTTT"), ("u_B", "g", "TTTA"), ("v_A", "h", "GGGG"), ("v_B", "h", "GGGA"))))
    line = "r{0}\t{1}\t{2}\t{3}\t9\t*\t=\t{4}\t{5}\tACGT\t*\tNM:i:0"
    rows = [x for i in range(30) for x in (line.format(i, 99, "t_A", 5, 150, 180), line.format(i, 147, "t_B", 150, 5, -180))]
    (tmp_path / "x.sam").write_text("@HD\tVN:1.0\n" + "\n".join(rows) + "\n")
    p = lambda name: str(tmp_path / name)
    cli.main(["make-hits", "--sam", p("x.sam"), "--fasta", p("x.fa"), "--out", p("hits"), "--merge-haplotypes", "--insert-size", "180", "25", "49"], spark)
    cli.main(["quantify", "--hits", p("hits"), "--out", p("q"), "--gibbs-iter", "1024", "--max-em-iter", "5"], spark)
    q = {r["feature_id"]: r for r in tables.read_quant(spark, p("q/features")).collect()}
    g = {r["feature_id"]: r for r in tables.read_quant(spark, p("q/genes")).collect()}
    assert set(q) == {"t", "u", "v"} and q["t"]["unique_hits"] == 30 and q["u"]["observed"] == 0
    assert 0 < q["t"]["mean_proportion"] < 1 and g["g"]["log_mu"] > q["t"]["log_mu"] and (g["g"]["observed"], g["g"]["ntranscripts"]) == (1, 2)
    assert g["h"]["observed"] == 0 and abs(g["h"]["mcse"] - g["h"]["sd"] / 32) < 1e-9


def test_input_order_and_pairs_by_flags(spark, tmp_path):
    """Of a read's alignments to a feature that are equally good the first of the file stands; the flags say whether there are pairs."""
    (tmp_path / "x.fa").write_text(">a gene:g\n" + "ACGT" * 100 + "\n>b gene:g\n" + "ACGA" * 100 + "\n")
    line = "r{0}\t{1}\ta\t{2}\t9\t*\t=\t{3}\t{4}\tACGT\t*\tNM:i:0"
    rows = [x for i in range(40) for x in (line.format(i, 99, 5, 150, 170), line.format(i, 147, 150, 5, -170), line.format(i, 99, 7, 160, 190), line.format(i, 147, 160, 7, -190))]
    (tmp_path / "x.sam").write_text("@HD\tVN:1.0\n" + "\n".join(rows) + "\n")
    sam = src.read_sam(spark, str(tmp_path / "x.sam"))
    assert [(r["qname"], r["pos"]) for r in sam.orderBy("ordinal").collect()] == [(x.split("\t")[0], int(x.split("\t")[3])) for x in rows]
    probe = al.read_probe(sam).first()
    assert probe["paired"] and probe["read_length"] == 4
    known = al.pair_mates(sam.withColumnsRenamed({"qname": "read", "rname": "transcript"}))
    assert {(r["left"], r["n_mates"]) for r in al.one_per_feature(known, 180).collect()} == {(5, 2)}
    (tmp_path / "y.fa").write_text(">a gene:g\nACGT\n>a gene:h\nACGA\n")
    for name, message in (("x", None), ("y", "several genes")):
        args = ["make-hits", "--sam", str(tmp_path / "x.sam"), "--fasta", str(tmp_path / f"{name}.fa"), "--out", str(tmp_path / f"hits_{name}")]
        if message:
            with pytest.raises(SystemExit, match=message):
                cli.main(args, spark)
        else:
            cli.main(args, spark)
            assert hits.read(spark, str(tmp_path / "hits_x"))["reads"].count() == 40


def test_lengths_by_fitted_positions(spark, tmp_path):
    """Reads start three times as often at a G: a feature with many has a greater length."""
    rnd = random.Random(5)
    seqs = {"a": "".join(rnd.choice("ACGT") for _ in range(500)), "b": "".join(rnd.choice("ACGT") for _ in range(450)), "c": "G" * 45 + "".join(rnd.choice("AGGG") for _ in range(400)), "short": "ACGT" * 5}
    (tmp_path / "x.fa").write_text("".join(f">{n} gene:g{n}\n{s}\n" for n, s in seqs.items()))
    rows = []
    for n in "ab":
        places = range(21, len(seqs[n]) - 21)
        rows += [(n, p + 1) for p in rnd.choices(places, [3 if seqs[n][p] == "G" else 1 for p in places], k=9000)]
    (tmp_path / "x.sam").write_text("@HD\tVN:1.0\n" + "".join(f"r{i}\t0\t{n}\t{p}\t9\t*\t*\t0\t0\tACGT\t*\tNM:i:0\n" for i, (n, p) in enumerate(rows)))
    cli.main(["make-hits", "--sam", str(tmp_path / "x.sam"), "--fasta", str(tmp_path / "x.fa"), "--out", str(tmp_path / "h"), "--fit-positions"], spark)
    got = {r["transcript"]: r["effective_length"] for r in hits.read(spark, str(tmp_path / "h"))["meta"].collect()}
    assert set(got) == set(seqs) and got["short"] == 20 and got["c"] > 1.3 * len(seqs["c"])
    assert abs((got["a"] + got["b"] - 2 * (40 - 4 + 1)) / (950 - 82) - 1) < 0.02


def test_hits_in_both_forms(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    reads = [(f"run1:{i:04d}/1", ["a", "b"][: 1 + i % 2]) for i in range(300)] + [("x" * 600, ["b"]), ("x" * 599 + "y", ["a"])]
    lines = ["@TranscriptMetaData\ta\t100.25\t300", "@TranscriptMetaData\tb\t0.1\t20", "@GeneIsoforms\tg\ta\tb", "@IdenticalTranscripts\ta\tb"]
    (tmp_path / "x.hits").write_text("\n".join(lines + [f">{r}\n" + "\n".join(ts) for r, ts in reads]) + "\n")
    cli.main(["hits-to-binary", "--hits", p("x.hits"), "--out", p("x.b")], spark)
    whole = b"".join(f.read_bytes() for f in sorted((tmp_path / "x.b").glob("part-*")))
    assert whole[:1] == b"\x78" and len(whole) < 6000 and sorted(hits.unpack(whole)) == sorted(reads)
    cli.main(["hits-to-text", "--hits", p("x.b"), "--out", p("x.t")], spark)
    a, b = hits.read(spark, p("x.hits")), hits.read(spark, p("x.t"))
    for k in a:
        assert sorted(map(str, a[k].collect())) == sorted(map(str, b[k].collect())), k


def test_sequence_commands(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    found = lambda f: {r["header"]: r["seq"] for r in src.read_fasta(spark, p(f)).collect()}
    rng = random.Random(3)
    chrom = "".join(rng.choice("ACGT") for _ in range(150_000))
    (tmp_path / "dna.fa").write_text(f">1 chromosome:x:1:1:150000:1\n{chrom}\n>2 dna\nACGTACGT\n>Y chromosome:x:Y:5:9:1\nNNNNACGTA\n")
    row = '{0}\ts\texon\t{1}\t{2}\t.\t{3}\t.\tgene_id "g{4}"; transcript_id "t{4}";\n'
    exons = [("1", 60_001, 140_000, "+", 1), ("1", 3, 9, "+", 1), ("1", 65_530, 65_540, "-", 2), ("2", 1, 8, "+", 3), ("2", 5, 9, "+", 4), ("Y", 4, 6, "+", 5), ("Y", 5, 9, "-", 6), ("9", 1, 2, "+", 7)]
    (tmp_path / "x.gtf").write_text("#kept\n" + "".join(row.format(*e) for e in exons) + '1\ts\tgene\t1\t2\t.\t+\t.\tgene_id "g1";\n')
    cli.main(["extract", "--gtf", p("x.gtf"), "--fasta", p("dna.fa"), "--out", p("x")], spark)
    turned = chrom[65_529:65_540][::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert found("x") == {"t1 gene:g1": chrom[2:9] + chrom[60_000:140_000], "t2 gene:g2": turned, "t3 gene:g3": "ACGTACGT", "t6 gene:g6": "TACGT"}
    cli.main(["filter-fasta", "--fasta", p("x"), "--pattern", "g[26]", "--invert", "--out", p("y")], spark)
    assert set(found("y")) == {"t1 gene:g1", "t3 gene:g3"}
    cli.main(["filter-gtf", "--fasta", p("y"), "--gtf", p("x.gtf"), "--out", p("z")], spark)
    assert sorted(r["transcript_id"] for r in src.read_gtf(spark, p("z")).collect()) == ["t1", "t1", "t3"]
    (tmp_path / "x.vcf").write_text("#h\n1\t1\t.\tA\tACC\t30\tPASS\tx\n")
    cli.main(["offset", "--gtf", p("x.gtf"), "--vcf", p("x.vcf"), "--out", p("o")], spark)
    assert src.comments(spark, p("o")).collect()[0][0] == "#kept" and sorted(r["start"] for r in src.read_gtf(spark, p("o")).filter("chrom = '1'").collect()) == [5, 60_003, 65_532]


def test_haplotypes_command(spark, tmp_path):
    """The published example, a feature on the minus strand, one whose haplotypes are equal, one without sites; a position between exons."""
    p = lambda name: str(tmp_path / name)
    (tmp_path / "x.fa").write_text(">ENST123 gene:ENSG123\nATCGAATGA\n>m gene:h\nAACC\n>e gene:h\nAACC\n>n gene:h\nTTTT\n")
    gff = "1\tprotein_coding\t{0}\t{1}\t{2}\t.\t{3}\t.\tID={4};Name=A\n"
    rows = [("gene", 1, 9999, "+", "x"), ("mRNA", 1000, 1014, "+", "ENST123"), ("exon", 1000, 1003, "+", "e1"), ("exon", 1010, 1014, "+", "e2"), ("CDS", 1, 2, "+", "c"), ("exon", 1, 2, "+", "stray")]
    rows += [("mRNA", 1, 4, "-", "m"), ("exon", 1, 4, "-", "e3"), ("mRNA", 1, 4, "+", "e"), ("exon", 1, 4, "+", "e4")]
    (tmp_path / "x.gff").write_text("##gff-version 3\n" + "".join(gff.format(*r) for r in rows))
    (tmp_path / "x.pos").write_text("ENST123 1 1003 1005 1011\nm 1 1\ne 1 2\n")
    (tmp_path / "x.hap").write_text("ENST123_A GCT\nENST123_B CCG\nm_A A\nm_B G\ne_A T\ne_B T\n")
    cli.main(["haplotypes", "--fasta", p("x.fa"), "--gff", p("x.gff"), "--positions", p("x.pos"), "--alleles", p("x.hap"), "--out", p("h")], spark)
    assert {r["header"]: r["seq"] for r in src.read_fasta(spark, p("h")).collect()} == {
        "ENST123_A gene:ENSG123_A": "ATCGATTGA", "ENST123_B gene:ENSG123_B": "ATCCAGTGA", "m_A gene:h_A": "AACT", "m_B gene:h_B": "AACC", "e gene:h": "ATCC", "n gene:h": "TTTT",
    }
