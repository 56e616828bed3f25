"""Readers, writers, the command line and the independence of the package from its optional part."""

import gzip
import subprocess
import sys
from pathlib import Path

import pytest

from hoptrace import cli, sinks
from hoptrace.operators.reference import existing_bed
from hoptrace.sources import sam, text
from hoptrace.sources.library import flanking_reads
from conftest import ROOT


def lines(spark, path):
    return [r[0] for r in spark.read.text(str(path)).collect()]


def test_fastq(spark, tmp_path):
    body = "".join(f"@r{i}/1 extra\nACGT{'A' * i}\n+\n{'' if i == 2 else '@' * (4 + i)}\n" for i in range(5))
    (tmp_path / "a.fq").write_text(body)
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write(body)
    for name in ("a.fq", "a.fq.gz"):
        got = {r["name"]: (r["seq"], r["qual"], r["mate"]) for r in text.read_fastq(spark, str(tmp_path / name), 1).collect()}
        assert got == {f"r{i}/1": (f"ACGT{'A' * i}", "I" * 6 if i == 2 else "@" * (4 + i), 1) for i in range(5)}


def test_fastq_in_splits(spark, tmp_path):
    (tmp_path / "b.fq").write_text("".join(f"@r{i}\nACGT{i}\n+\n@@@@@\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = text.read_fastq(spark, str(tmp_path / "b.fq"))
        assert {(r["name"], r["seq"]) for r in got.collect()} == {(f"r{i}", f"ACGT{i}") for i in range(2000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACG\nTT\n>two\nGGR\n")
    got = [tuple(r) for r in text.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ref_index").collect()]
    assert got == [(0, "one", 5, "ACGTT"), (1, "two", 3, "GGR")]


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:c1\tLN:500\n@SQ\tSN:c2\tLN:90\nr1\t16\tc2\t11\t60\t5M1I3D4M2S\t*\t0\t0\tACGT\tIIII\tXX:Z:q\tNM:i:3\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\nshort\t0\n")
    rows = sam.read_sam(spark, str(tmp_path / "a.sam"))
    got = {r["name"]: r for r in rows.collect()}
    assert got.keys() == {"r1", "r2"} and got["r2"]["qual"] is None
    r = got["r1"]
    assert (r["ref_index"], r["ref_length"], r["ref_start"], r["ref_end"], r["nm"]) == (1, 90, 10, 22, 3)
    assert [tuple(x) for x in sam.genome_reads(rows).collect()] == [("c2", "r1", "-", 11, 22, 3, "5M1I3D4M2S")]
    written = [x[0] for x in rows.filter("name = 'r1'").select(sinks.sam_line()).collect()]
    assert written == ["r1\t16\tc2\t11\t60\t5M1I3D4M2S\t*\t0\t0\tACGT\tIIII\tNM:i:3"]


def test_read_repeat(spark, tmp_path):
    (tmp_path / "rr.txt").write_text("a\tT\t+\nb\tT\na\tU\t-\textra\n")
    assert [tuple(r) for r in text.read_read_repeat(spark, str(tmp_path / "rr.txt")).collect()] == [("a", "U", "-")]


def test_repeatmasker(spark, tmp_path):
    body = ["   SW   perc perc", "score   div. del.", "", "  239   1.2  0.0  0.0  Chr3  7192  7483  (99)  C  hop  DNA/x  (0)  292  1  1", " 9 1 0 0 Chr3 9 20 (5) + hop DNA/x 1 12 (0) 2 *", " 9 1 0 0 Chr3 30 40 (5) + hop DNA/x 2 12 (0) 3", "x 1 2 3"]
    (tmp_path / "rm.out").write_text("\n".join(body) + "\n")
    got = text.read_repeatmasker(spark, str(tmp_path / "rm.out")).orderBy("ord")
    assert [(r["chrom"], r["te_start"], r["te_end"], r["strand"], r["intact"]) for r in got.collect()] == [("Chr3", 7192, 7483, "-", True), ("Chr3", 9, 20, "+", True), ("Chr3", 30, 40, "+", False)]
    assert existing_bed(got).orderBy("ord").first()["value"] == "Chr3\t7192\t7483\thop:7192-7483\t1\t-"


def test_insertions(spark, tmp_path):
    row = ("c", 5, 7, "T", "-", "ACG", 2, 3, 4, 5, "a note")
    calls = spark.createDataFrame([row], "chrom string, start long, end long, te_name string, strand string, tsd string, left_junction long, right_junction long, left_support long, right_support long, note string")
    sinks.write_insertions(calls, str(tmp_path / "o.gff"), str(tmp_path / "o.txt"), "s")
    assert lines(spark, tmp_path / "o.gff") == ["c\thoptrace\ts\t5\t7\t.\t-\t.\tID=repeat_c_5_7;Name=T;TSD=ACG;Note=a note;Right_junction_reads=3;Left_junction_reads=2;Right_support_reads=5;Left_support_reads=4;"]
    assert lines(spark, tmp_path / "o.txt") == [sinks.CALL_HEADER, "c\t5\t7\tT\t-\tACG\t3\t2\t5\t4"]
    assert [tuple(r) for r in text.read_insertions(spark, str(tmp_path / "o.gff")).collect()] == [row]
    (tmp_path / "p.gff").write_text("# x\n\nc\ts\tt\t1\t2\t.\t+\t.\tName=Q\nshort\tline\n")
    assert [tuple(r) for r in text.read_insertions(spark, str(tmp_path / "p.gff")).collect()] == [("c", 1, 2, "Q", "+", "UNK", 0, 0, 0, 0, "")]


def test_genotypes(spark, tmp_path):
    calls = spark.createDataFrame([("c", 5, 7, "T", "-", "ACG", 2, 3, 1, "heterozygous"), ("c", 9, 9, "T", "-", "UNK", 2, 0, 0, "")], "chrom string, start long, end long, te_name string, strand string, tsd string, left_junction long, right_junction long, spanners long, status string")
    sinks.write_genotypes(calls, str(tmp_path / "g.gff"), str(tmp_path / "g.txt"), "s")
    assert lines(spark, tmp_path / "g.gff") == ["##gff-version 3", "c\ts\ttransposable_element_attribute\t5\t7\t.\t-\t.\tID=c.7.spanners;avg_flankers=2.5;spanners=1;type=heterozygous;TE=T;TSD=ACG"]
    assert lines(spark, tmp_path / "g.txt") == [sinks.GENOTYPE_HEADER, "s\tT\tACG\tc:5..7\t-\t2.5\t1\theterozygous"]


def test_command_line(capsys, spark, tmp_path):
    assert cli.main([]) == 0 and "usage" in capsys.readouterr().err
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0 and "hoptrace" in capsys.readouterr().out
    assert cli.main(["find-reference", "-b", str(tmp_path / "no.sam"), "--repeatmasker", "x", "--read-repeat", "y", "-o", str(tmp_path)]) == 1


def test_steps_from_files(spark, tmp_path):
    """The steps from alignments on, by the command line."""
    (tmp_path / "g.sam").write_text("@SQ\tSN:c\tLN:5000\na/1:end:5\t0\tc\t901\t60\t100M\t*\t0\t0\t" + "A" * 100 + "\t*\tNM:i:0\nb/1:start:3\t0\tc\t998\t60\t100M\t*\t0\t0\t" + "A" * 100 + "\t*\tNM:i:0\n")
    (tmp_path / "rr.txt").write_text("a/1:end:5\thop\t+\nb/1:start:3\thop\t+\n")
    (tmp_path / "g.fa").write_text(">c\n" + "acgtacgtac" * 500 + "\n")
    base = ["-o", str(tmp_path / "out"), "--sample", "s"]
    assert cli.main(["find-insertions", "-b", str(tmp_path / "g.sam"), "-g", str(tmp_path / "g.fa"), "--read-repeat", str(tmp_path / "rr.txt"), *base]) == 0
    gff = tmp_path / "out/results/s.all_nonref_insert.gff"
    got = text.read_insertions(spark, str(gff)).collect()
    assert [(r["start"], r["end"], r["tsd"], r["te_name"], r["left_junction"], r["right_junction"]) for r in got] == [(998, 1000, ("acgtacgtac" * 500)[997:1000].upper(), "hop", 1, 1)]
    assert cli.main(["characterize", "-i", str(gff), "-b", str(tmp_path / "g.sam"), *base]) == 0
    assert len(lines(spark, tmp_path / "out/results/s.all_nonref_insert.characTErized.txt")) == 2


def test_without_optional_part():
    """The entry module works where the optional subpackage cannot be imported, and nothing else imports it."""
    code = "import sys; sys.modules['hoptrace.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'find_insertions' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
    for p in (ROOT / "hoptrace").rglob("*.py"):
        assert "llm" in p.parts or "hoptrace.llm" not in p.read_text()


def test_flanking_files(spark, tmp_path):
    """Flanking reads come back from their files; without any the step says so."""
    with pytest.raises(FileNotFoundError):
        flanking_reads(spark, str(tmp_path), "s")
    rows = [("a/1:end:5", "ACGT", "IIII", "T", "+", "5", "GG", 1), ("b/2:start:3", "AC", "II", "T", "+", "3", "", 2)]
    sinks.write_trimmed(spark.createDataFrame(rows, "name string, seq string, qual string, te_name string, strand string, junction_type string, te_portion string, direction int"), str(tmp_path), "s")
    assert sorted(map(tuple, flanking_reads(spark, str(tmp_path), "s").collect())) == [("a/1:end:5", "ACGT", "IIII", 1), ("b/2:start:3", "AC", "II", 2)]
    assert cli.main(["align-genome", "-l", "x", "-g", "y", "-o", str(tmp_path / "none"), "-c", "2"]) == 1


def test_sorted_alignments(spark, tmp_path):
    """Alignments are written by contig and place, and a region's filter reaches the files."""
    rows = [(i, f"r{i}", i % 3, (i * 37) % 1000) for i in range(500)]
    sinks.write_alignments(spark.createDataFrame(rows, "ordinal long, name string, ref_index int, ref_start int").repartition(4), str(tmp_path / "a.parquet"))
    seen = []
    for part in sorted((tmp_path / "a.parquet").glob("part-*")):
        seen += [(r["ref_index"], r["ref_start"]) for r in spark.read.parquet(str(part)).collect()]
    assert seen == sorted((r[2], r[3]) for r in rows)
    plan = spark.read.parquet(str(tmp_path / "a.parquet")).filter("ref_index = 1 and ref_start between 100 and 200")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ref_index,1)" in plan and "GreaterThanOrEqual(ref_start," in plan


def test_shared_folder(spark, tmp_path, monkeypatch):
    """What a run stages is gone at its end; on a cluster a missing shared folder is an error."""
    from hoptrace import staging

    with staging.scratch(spark) as own:
        assert staging.staged(spark.range(3), "x").count() == 3 and Path(own.removeprefix("file:")).exists()
    assert not Path(own.removeprefix("file:")).exists()
    none = type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d: None)}), "sparkContext": type("X", (), {"master": "spark://host:7077"})})
    with pytest.raises(ValueError):
        staging.shared_folder(none)


def test_places_beyond_an_int(spark):
    """Text has no bound on places."""
    line = "\t".join(["r1", "16", "Chr1", "6000000001", "60", "10M", "*", "0", "0", "*", "*", "NM:i:1"])
    rows = sam.genome_reads(sam.records(spark.createDataFrame([(line, 0)], "value string, ordinal long")))
    assert rows.select("chrom", "strand", "gstart", "gend").collect() == [("Chr1", "-", 6000000001, 6000000010)]
