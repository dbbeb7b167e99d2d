"""Headers, SAM and BAM, FASTA, the command line and the stream."""

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from demeframe import cli
from demeframe.operators.windows import Region
from demeframe.params import Params
from demeframe.sources import alignments, fasta, header
from demeframe.streaming.ingest import ingest, latest

TEXT = "@HD\tVN:1.0\tSO:coordinate\n@SQ\tSN:c1\tLN:300\tAS:refv1\n@RG\tID:rg1\tSM:s0\tPO:popA\tLB:l1\n@RG\tID:rg2\tSM:s1\tPO:popA\n@RG\tID:rg3\tSM:s2\tPO:popB\n@CO\tfree text\n"


def test_header_parts(spark):
    h = header.from_text(spark, TEXT)
    assert [tuple(r)[:4] for r in header.read_groups(h).orderBy("ord").collect()] == [("rg1", "s0", "popA", "l1"), ("rg2", "s1", "popA", None), ("rg3", "s2", "popB", None)]
    assert header.assembly(h) == "refv1" and header.contigs(h).first()["length"] == 300
    assert {r["key"]: r["value"] for r in header.table(h, "RG", "ID", "SM").collect()} == {"rg1": "s0", "rg2": "s1", "rg3": "s2"}
    assert header.problems(h).count() == 0
    again = "\n".join(r["value"] for r in header.to_text(h).orderBy("line").collect())
    assert header.from_text(spark, again).exceptAll(h).select("type").count() == 0 if False else sorted(again.splitlines())[0].startswith("@CO")
    with pytest.raises(ValueError):
        header.assembly(header.from_text(spark, "@SQ\tSN:c\tLN:1"))


def test_a_missing_tag_is_not_taken_from_the_next_line(spark):
    h = header.from_text(spark, "@RG\tID:a\tSM:x\n@RG\tID:b\tSM:y\tPO:p")
    assert [r["pop"] for r in header.read_groups(h).orderBy("ord").collect()] == [None, "p"]


def test_header_problems_and_merge(spark):
    bad = header.from_text(spark, "@SQ\tSN:c\n@SQ\tSN:c\tLN:1\tXX:1\tzz:2\n@ZZ\ta:b")
    assert sorted(r["problem"] for r in header.problems(bad).collect()) == ["missing LN", "unknown tag XX", "unknown type ZZ", "used twice: c"]
    a, b = header.from_text(spark, "@SQ\tSN:c\tLN:5\n@CO\tx"), header.from_text(spark, "@SQ\tSN:c\tAS:r\n@SQ\tSN:d\tLN:2\n@CO\tx")
    lines = [r["value"] for r in header.to_text(header.merge(a, b)).orderBy("line").collect()]
    assert lines == ["@SQ\tSN:c\tLN:5\tAS:r", "@CO\tx", "@SQ\tSN:d\tLN:2"]
    with pytest.raises(Exception, match="headers differ"):
        header.merge(a, header.from_text(spark, "@SQ\tSN:c\tLN:6")).collect()


def made_reads(seed=1, n=400):
    rng = random.Random(seed)
    ref = "".join(rng.choice("ACGT") for _ in range(300))
    out = []
    for i in range(n):
        pos = rng.randrange(0, 280)
        length = min(20, 300 - pos)
        seq = list(ref[pos : pos + length])
        group = rng.choice(["rg1", "rg2", "rg3"])
        for j in range(length):
            if group == "rg3" and (pos + j) % 17 == 0:
                seq[j] = "ACGT"[("ACGT".index(ref[pos + j]) + 1) % 4]
        out.append({"qname": f"q{i}", "flag": rng.choice([0, 16]), "chrom": "c1", "pos": pos, "mapq": 60, "cigar": [("M", length)], "seq": "".join(seq), "qual": [35] * length, "read_group": group})
    return ref, sorted(out, key=lambda r: r["pos"])


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("reads")
    ref, reads = made_reads()
    (at / "x.bam").write_bytes(alignments.encode_bam(TEXT, [("c1", 300)], reads))
    lines = ["\t".join([r["qname"], str(r["flag"]), "c1", str(r["pos"] + 1), "60", f"{len(r['seq'])}M", "*", "0", "0", r["seq"], "".join(chr(q + 33) for q in r["qual"]), "RG:Z:" + r["read_group"]]) for r in reads]
    (at / "x.sam").write_text(TEXT + "\n".join(lines) + "\n")
    (at / "ref.fa").write_text(">c0 other\nACGT\nAC\n>c1\n" + "\n".join(ref[i : i + 70] for i in range(0, 300, 70)) + "\n")
    return at, ref, reads


def test_bam_round_trip(spark, files):
    at, _, reads = files
    df = alignments.read_bam(spark, str(at / "x.bam"))
    rows = df.orderBy("ord").collect()
    assert [(r["qname"], r["flag"], r["pos"], r["seq"], list(r["qual"]), r["read_group"]) for r in rows] == [(r["qname"], r["flag"], r["pos"], r["seq"], r["qual"], r["read_group"]) for r in reads]
    assert alignments.bam_header_text(str(at / "x.bam")) == TEXT
    near = alignments.overlapping(df, "c1", 100, 120).collect()
    assert {r["qname"] for r in near} == {r["qname"] for r in alignments.read_bam(spark, str(at / "x.bam"), Region("c1", 100, 120)).collect()} == {r["qname"] for r in reads if r["pos"] < 120 and r["pos"] + len(r["seq"]) > 100}
    sam = alignments.read_sam(spark, str(at / "x.sam"))
    assert sam.drop("ord").exceptAll(df.drop("ord")).count() == 0 and df.drop("ord").exceptAll(sam.drop("ord")).count() == 0
    assert df.where(alignments.is_valid(F.lit(300))).count() == len(reads) and df.where(alignments.is_valid(F.lit(10))).count() < len(reads)
    lines = [r["value"] for r in alignments.to_sam(df).orderBy("ord").collect()]
    assert lines == (at / "x.sam").read_text().splitlines()[6:]
    libs = header.libraries(df, header.read_groups(header.from_text(spark, TEXT))).where("read_group = 'rg1'").first()
    assert libs["library"] == "l1"


def test_fasta(spark, files):
    at, ref, _ = files
    chunks = fasta.read_chunks(spark, str(at / "ref.fa"))
    rows = fasta.ref_bases(chunks).orderBy("chrom", "pos").collect()
    assert "".join(r["ref"] for r in rows if r["chrom"] == "c1") == ref and [r["pos"] for r in rows if r["chrom"] == "c0"] == list(range(6))
    assert {r["chrom"]: r["length"] for r in fasta.contig_lengths(chunks).collect()} == {"c0": 6, "c1": 300}
    assert "".join(r["ref"] for r in fasta.ref_bases(chunks, "c1", 65, 75).orderBy("pos").collect()) == ref[65:75]


def test_fasta_in_many_parts(spark, files, tmp_path):
    rng = random.Random(2)
    seqs = {f"k{i}": "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 900))) for i in range(8)}
    (tmp_path / "y.fa").write_text("".join(f">{k}\n" + "".join(s[i : i + 50] + "\n" for i in range(0, len(s), 50)) for k, s in seqs.items()))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = fasta.ref_bases(fasta.read_chunks(spark, str(tmp_path / "y.fa"))).orderBy("chrom", "pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert {k: "".join(r["ref"] for r in rows if r["chrom"] == k) for k in seqs} == seqs


@pytest.mark.parametrize("command,extra", [("nucdiv", []), ("sfs", []), ("diverge", ["-o", "1"]), ("diverge", []), ("ld", ["-o", "2", "-n", "1"]), ("haplo", ["-o", "0"]), ("haplo", ["-o", "2"]), ("tree", ["-d", "jc"]), ("snp", ["-v"]), ("snp", ["-o", "1"]), ("snp", ["-o", "2"]), ("fasta", [])])
def test_commands(spark, files, command, extra):
    at, ref, _ = files
    args = [command, *extra, "-f", str(at / "ref.fa"), "-w", "0.1", "-s", "10", str(at / "x.bam"), "c1"]
    rows = [r["value"] for r in cli.lines(spark, args).orderBy("win_id").collect()]
    assert rows
    if command == "nucdiv":
        assert len(rows) == 3 and rows[0].startswith("c1\t1\t100\tns[popA]:\t") and "dxy[popA-popB]:" in rows[0] and "pi[popA]:\t0.00000" in rows[0]
    if command == "snp" and "-v" in extra:
        assert all((int(r.split("\t")[1]) - 1) % 17 == 0 for r in rows)
    if command == "tree":
        assert all(x in rows[0] for x in ("ref", "s0", "s2"))
    if command == "fasta":
        text = "".join(min(r for r in rows if r.startswith(">s0")).split("\n")[1:])
        assert len(text) == 100 and all(a in (b, "N") for a, b in zip(text, ref[:100], strict=True)) or any(text == ''.join(r.split(chr(10))[1:]) for r in rows)


def test_outgroup_is_looked_up(spark, files):
    at, _, _ = files
    args = ["sfs", "-p", "nobody", "-f", str(at / "ref.fa"), str(at / "x.sam"), "c1:1-200"]
    with pytest.raises(ValueError, match="no sample"):
        cli.lines(spark, args)
    assert cli.lines(spark, [*args[:2], "s2", *args[3:]]).count() == 1


def test_help():
    out = subprocess.run([sys.executable, "-m", "demeframe.cli", "ld", "--help"], capture_output=True, text=True)
    assert out.returncode == 0 and "omega" in out.stdout


def test_stream_recomputes_touched_windows(spark, tmp_path):
    schema = "chrom string, pos int, n int"
    source, store, out, mark = (str(tmp_path / x) for x in ("in", "store", "out", "mark"))
    p, region = Params(window=100), Region("c", 0, 1000)
    total = lambda df: df.groupBy("win_id").agg(F.sum("n").alias("n"))

    def feed(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        q = ingest(spark, source, store, out, mark, schema, region, p, total)
        q.awaitTermination()
        return {r["win_id"]: r["n"] for r in latest(spark, out).collect()}

    assert feed([("c", 5, 1), ("c", 150, 2)]) == {0: 1, 1: 2}
    assert feed([("c", 7, 10), ("c", 950, 4)]) == {0: 11, 1: 2, 9: 4}


def test_indexed_bam_in_parts(spark, tmp_path):
    rng = random.Random(4)
    contigs = [("c1", 400_000), ("c2", 5_000), ("c3", 100)]
    records = [{"qname": f"q{i}", "flag": 0, "chrom": c, "pos": p, "mapq": 60, "cigar": [("M", 30), ("N", 200), ("M", 20)], "seq": "".join(rng.choice("ACGT") for _ in range(50)), "qual": [30] * 50, "read_group": "rg1"} for i, (c, p) in enumerate(sorted([("c1", rng.randrange(399_000)) for _ in range(6000)] + [("c2", rng.randrange(4_000)) for _ in range(300)]))]
    data = alignments.encode_bam("@HD\tVN:1.0", contigs, records)
    (tmp_path / "one").mkdir()
    path = str(tmp_path / "one" / "a.bam")
    open(path, "wb").write(data)
    plain = [tuple(r) for r in alignments.read_bam(spark, path).orderBy("ord").collect()]
    assert [r[0] for r in plain] == [r["qname"] for r in records]
    assert spark.read.format("bam").load(path).rdd.getNumPartitions() == 1
    open(path + ".bai", "wb").write(alignments.index_bam(data))
    parts = spark.read.format("bam").option("split", 20_000).load(path)
    assert parts.rdd.getNumPartitions() >= 3
    got = [tuple(r) for r in parts.orderBy("ord").collect()]
    assert [r[:-1] for r in got] == [r[:-1] for r in plain]
    for region in (Region("c1", 100_000, 130_000), Region("c1", 0, 1), Region("c2", 4_100, 4_200), Region("c1", 399_900, 400_000), Region("c3", 0, 100), Region("c1", 16_384, 16_385)):
        for split in (1, 60_000, 1 << 30):
            found = spark.read.format("bam").options(chrom=region.chrom, beg=region.beg, end=region.end, split=split).load(path).orderBy("ord").collect()
            want = [r["qname"] for r in records if r["chrom"] == region.chrom and r["pos"] < region.end and r["pos"] + 250 > region.beg]
            assert [r["qname"] for r in found] == want, (region, split)
    assert alignments.bam_header_text(path) == alignments.bam_header_text(str(tmp_path / "one")) == "@HD\tVN:1.0"


def test_reads_without_read_group_lines(spark, tmp_path):
    ref, records = made_reads()
    (tmp_path / "ref.fa").write_text(">c1\n" + ref + "\n")
    lines = ["@SQ\tSN:c1\tLN:300"] + ["\t".join([r["qname"], "0", "c1", str(r["pos"] + 1), "60", f"{len(r['seq'])}M", "*", "0", "0", r["seq"], "D" * len(r["seq"])]) for r in records]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    out = cli.lines(spark, ["nucdiv", "-f", str(tmp_path / "ref.fa"), "-m", "1", "-s", "3", str(tmp_path / "x.sam"), "c1"]).collect()
    assert len(out) == 1 and "ns[x.sam]:\t29" in out[0]["value"]


def test_infinite_sites(spark):
    from demeframe.operators import sites as S

    calls = spark.createDataFrame([("c", 1, 0, 0, True), ("c", 1, 1, 1, True), ("c", 2, 0, 1, True), ("c", 2, 2, 2, True), ("c", 3, 0, 1, True), ("c", 3, 2, 2, False)], "chrom string, pos int, a1 int, a2 int, pass boolean")
    assert S.infinite_sites(calls, Params()).count() == 6
    assert {r["pos"] for r in S.infinite_sites(calls, Params(infinite_sites=True)).collect()} == {1, 3}


def test_sql_functions(spark):
    from demeframe.functions import genomics as G
    from demeframe.operators import tree

    G.register_sql(spark)
    tree.register_sql(spark)
    a1, a2, e1, e2 = G.tajima_constants(10)
    row = spark.sql("select tajima_d(12, 10, 1.5D) as d, tajima_d(0, 10, 1.5D) as none, tajima_d(3, 3, 1D) as few, jukes_cantor(0.1D) as jc").first()
    assert abs(row["d"] - 1.5 / (e1 * 12 + e2 * 12 * 11) ** 0.5) < 1e-12 and row["none"] is None and row["few"] is None and row["jc"] > 0.1
    got = spark.sql("select nj_newick(array('r', 'a', 'b'), array(0D, 3D, 4D, 3D, 0D, 5D, 4D, 5D, 0D)) as t, nj_newick(array('r', 'a'), array(0D, 1D, 1D, 0D)) as n").first()
    assert got["t"] == "(r:1.00000,a:2.00000,b:3.00000);" and got["n"] is None
