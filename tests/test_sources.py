"""File readers and the reader program, by round trip."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from run_folder import write_locs, write_manifest, write_sheet, write_tile

from basewise import fixtures as fx
from basewise.__main__ import PROGRAMS, main
from basewise.operators.layout import CycleRange
from basewise.operators.transpose import transpose
from basewise.options import OptionError, Options
from basewise.plans.aligner import align_run
from basewise.plans.reader import assign_samples, read_run, run_clusters, run_pairs
from basewise.plans.writer import write_run
from basewise.sinks import write_fastq, write_pair_text
from basewise.sources.calls import read_controls
from basewise.sources.locations import location_rows, read_locations
from basewise.sources.manifest import read_manifest, run_ranges
from basewise.sources.sheet import read_sheet, sheet_duplicates
from basewise.sources.tables import pairs_from_messages, read_fasta
from basewise.functions.wire import encode_prq

READS = [(36, False), (8, True), (36, False)]


def options(root, **more):
    return Options.from_dict({
        "bcl_input_dir": str(root), "cram_output_dir": "o", "reference": "r", "flink_tmp_dir": "t", **more
    })


@pytest.fixture(scope="module")
def run_dir(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    base = root / "Data" / "Intensities" / "BaseCalls"
    os.makedirs(base)
    rows = fx.calls(fx.with_position(fx.clusters(spark, sf_dir))).select("lane", "tile", "cluster", "pf", "calls").toPandas()
    for (lane, tile), g in rows.groupby(["lane", "tile"]):
        g = g.sort_values("cluster")
        assert g["cluster"].tolist() == list(range(len(g)))
        calls = np.frombuffer(b"".join(map(bytes, g["calls"])), dtype=np.uint8).reshape(len(g), 80)
        write_tile(base, lane, tile, calls, g["pf"].to_numpy())
    n = np.arange(rows["cluster"].max() + 1)
    write_locs(root / "Data" / "Intensities" / "s.locs", np.stack([n % 1000, n // 1000], axis=1))
    write_manifest(root, READS, 2, 4)
    write_sheet(root, [tuple(r) for r in fx.sheet(spark, sf_dir).select("lane", "sample", "idx").collect()])
    return root


@pytest.mark.parametrize("block_size", [65_536, 64])
def test_run_folder_equals_fixture(spark, sf_dir, run_dir, block_size):
    got = run_pairs(spark, options(run_dir, block_size=str(block_size)))
    want = fx.pairs(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_dual_index(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("[Data]\nLane,Sample_ID,n,p,w,i,index,I5,index2\n1,a,,,,,AC,,GT\n1,b,,,,,AC,,TT\n1,c,,,,,GG\n")
    assert {tuple(r) for r in read_sheet(spark, str(path), True).collect()} == {(1, "a", "ACGT"), (1, "b", "ACTT"), (1, "c", "GG")}
    assert {tuple(r) for r in read_sheet(spark, str(path)).collect()} == {(1, "b", "AC"), (1, "c", "GG")}
    clusters = spark.createDataFrame([("x", 1, bytes([4, 5]), bytes([6, 7])), ("y", 1, bytes([4, 5]), bytes([7, 7]))], "name string, lane int, i1 binary, i2 binary")
    got = assign_samples(spark, options(tmp_path, sample_sheet=str(path), mismatches="0"), clusters, all_index_reads=True)
    assert {(r["name"], r["sample"]) for r in got.collect()} == {("x", "a"), ("y", "b")}
    path.write_text("[Data]\nLane,Sample_ID,n,p,w,i,index\n1,a,,,,,AC\n")
    assert [tuple(r) for r in read_sheet(spark, str(path), True).collect()] == [(1, "a", "AC")]


def test_adapter_option_masks_pairs(spark, sf_dir, run_dir):
    plain = fx.pairs(spark, sf_dir).collect()
    adapter = plain[0]["b1"][25:33]
    got = {r["name"]: r for r in run_pairs(spark, options(run_dir, adapter=adapter)).collect()}
    assert len(got) == len(plain)
    for r in plain:
        for b, q in (("b1", "q1"), ("b2", "q2")):
            kept = len(got[r["name"]][b].rstrip("N"))
            assert len(got[r["name"]][b]) == len(r[b]) and got[r["name"]][b][:kept] == r[b][:kept] and got[r["name"]][q][:kept] == r[q][:kept]
    assert got[plain[0]["name"]]["b1"] == plain[0]["b1"][:25] + "N" * 11


def test_programs_from_the_command_line(spark, sf_dir, run_dir, tmp_path):
    contigs = fx.contigs(spark, sf_dir).orderBy("ref_idx").collect()
    (tmp_path / "ref.fa").write_text("".join(f">{c['contig']}\n{c['seq']}\n" for c in contigs))
    (tmp_path / "run.properties").write_text(
        f"bcl_input_dir = {run_dir}\ncram_output_dir = nowhere\nreference = {tmp_path}/ref.fa\nflink_tmp_dir = {tmp_path}\n"
    )
    common = ["--properties", str(tmp_path / "run.properties"), "--data", str(tmp_path / "data"), f"--cram_output_dir={tmp_path}/out"]
    for program in PROGRAMS:
        main([program, *common], spark)
    assert spark.read.parquet(f"{tmp_path}/out/parquet").count() == 2 * fx.pairs(spark, sf_dir).count()
    for bad in (["painter"], ["reader"], ["reader", "x"], ["reader", "--data"], ["reader", "--data", "d", "--colour", "red"]):
        with pytest.raises(OptionError):
            main(bad, spark)


def test_three_programs_in_a_row(spark, sf_dir, run_dir, tmp_path):
    data, out = str(tmp_path / "data"), str(tmp_path / "out")
    contigs = fx.contigs(spark, sf_dir)
    read_run(spark, options(run_dir), data)
    align_run(spark, data, contigs)
    write_run(spark, data, contigs, out, part_records=100)
    toc = spark.read.parquet(f"{data}/toc")
    assert toc.groupBy("key").count().orderBy("key").collect() == [(0, 16), (1, 16)]
    assert spark.read.parquet(f"{out}/parquet").count() == 2 * fx.pairs(spark, sf_dir).count()
    assert spark.read.parquet(f"{out}/coverage").count() > 0
    # Every text file starts with the header, which occurs nowhere else.
    for folder, _, names in os.walk(f"{out}/sam"):
        parts = [n for n in names if n.startswith("part-")]
        if parts:
            assert len(parts) == 1
            lines = open(os.path.join(folder, parts[0])).read().splitlines()
            assert [ln.startswith("@") for ln in lines] == [True] * 6 + [False] * (len(lines) - 6)
            assert len(lines) <= 106 and lines[0].startswith("@SQ\tSN:") and lines[5].startswith("@PG")


def test_manifest_ranges(spark, run_dir):
    assert run_ranges(read_manifest(spark, str(run_dir / "RunInfo.xml"))) == [
        CycleRange(1, False, 1, 36), CycleRange(2, True, 37, 44), CycleRange(3, False, 45, 80)
    ]


def small_run(root, skip=(), reads=((3, False), (2, True), (2, False))):
    base = root / "Data" / "Intensities" / "BaseCalls"
    os.makedirs(base)
    width = sum(n for n, _ in reads)
    calls = (np.arange(5 * width, dtype=np.uint8) + 4).reshape(5, width)
    write_tile(base, 1, 1101, calls, np.array([1, 0, 3, 1, 1]), skip)
    write_locs(root / "Data" / "Intensities" / "s.locs", np.array([[0, 0], [1, 1], [2, 2], [3, 3.25], [-100.6, 4]]))
    write_manifest(root, reads, 1, 1)
    write_sheet(root, [(1, "A", "AC")])
    return calls


def test_only_filter_byte_one_passes_and_names(spark, tmp_path):
    calls = small_run(tmp_path)
    rows = run_clusters(spark, options(tmp_path)).orderBy("cluster").collect()
    assert [r["cluster"] for r in rows] == [0, 3, 4]
    assert bytes(rows[1]["r1"]) == calls[3, :3].tobytes() and bytes(rows[1]["r2"]) == calls[3, 5:].tobytes()
    assert rows[1]["name"] == "BW01:7:FCX1:1:1101:1030:1033"
    # Truncation goes towards zero: -1006 + 1000.5.
    assert rows[2]["x"] == -5


def test_missing_cycle(spark, tmp_path):
    calls = small_run(tmp_path, skip=(2,))
    with pytest.raises(FileNotFoundError, match="1101, 2"):
        run_clusters(spark, options(tmp_path))
    rows = run_clusters(spark, options(tmp_path), missing="drop").orderBy("cluster").collect()
    assert bytes(rows[0]["r1"]) == calls[0, [0, 2]].tobytes()


def test_three_reads_are_not_pairs(spark, tmp_path):
    small_run(tmp_path, reads=((2, False), (2, True), (2, False), (1, False)))
    with pytest.raises(ValueError, match="exactly 2"):
        run_pairs(spark, options(tmp_path))


def test_transpose_rejects_ragged_blocks(spark):
    calls = spark.createDataFrame([(1, 1, 1, 0, b"ab"), (1, 1, 2, 0, b"a")], "lane int, tile int, cycle int, block int, bytes binary")
    filters = spark.createDataFrame([(1, 1, 0, b"\1\1")], "lane int, tile int, block int, bytes binary")
    with pytest.raises(Exception, match="has 1 calls, filter has 2"):
        transpose(calls, filters, [CycleRange(1, False, 1, 2)]).collect()


def test_compressed_locations_and_control(spark, tmp_path):
    body = b"\1" + struct.pack("<i", 84) + b"\2" + bytes([0, 1, 2, 3]) + b"\0" * 81 + b"\0" + b"\1" + bytes([5, 6])
    (tmp_path / "s.clocs").write_bytes(body)
    blocks = read_locations(spark, str(tmp_path / "s.clocs"), "clocs", block_size=2)
    rows = location_rows(blocks, 2).orderBy("cluster").collect()
    # Bin 83 is column 1 of row 1.
    assert [tuple(r) for r in rows] == [(0, 1000, 1001), (1, 1002, 1003), (2, 1255, 1256)]
    (tmp_path / "L001").mkdir()
    (tmp_path / "L001" / "s_1_1101.control").write_bytes(b"\0" * 12 + np.array([5, -2], "<i2").tobytes())
    assert [tuple(r) for r in read_controls(spark, str(tmp_path)).orderBy("cluster").collect()] == [
        (1, 1101, 0, 5, "5:"), (1, 1101, 1, -2, "-2:")
    ]


def test_sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text(
        "[Header]\nx,y\n  [Data]  \r\nLane,ID,n,p,w,i,index\n1,A,,,,,ACGT\n\n2,B,,,,,ACGT\n1,C,,,,,ACGT\n[Other]\n1,D,,,,,TTTT\n"
    )
    assert sorted(map(tuple, read_sheet(spark, str(path)).collect())) == [(1, "C", "ACGT"), (2, "B", "ACGT")]
    assert [tuple(r) for r in sheet_duplicates(spark, str(path)).collect()] == [(1, "ACGT", 2)]
    path.write_text("[Header]\nx\n")
    with pytest.raises(Exception, match="no .Data. section"):
        read_sheet(spark, str(path)).collect()


def test_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c2 first\nACGT\nacg\n>c1\nTTTT\n")
    rows = read_fasta(spark, str(tmp_path / "r.fa")).orderBy("ref_idx").collect()
    assert [(r["ref_idx"], r["contig"], r["seq"], r["length"]) for r in rows] == [(0, "c2", "ACGTACG", 7), (1, "c1", "TTTT", 4)]


def test_fasta_titles_files_and_splits(spark, tmp_path):
    (tmp_path / "a.fa").write_text("stray\n>chr1 a->b note\r\nAC GT\r\nac\n>chr2\n>chr3 >x\n" + "ACGTTGCA\n" * 500)
    (tmp_path / "b.fa").write_text("TTT\n>chr4\nGG\n")
    want = [(0, "chr1", "ACGTAC"), (1, "chr2", ""), (2, "chr3", "ACGTTGCA" * 500 + "TTT"), (3, "chr4", "GG")]
    for size in ("128m", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = read_fasta(spark, str(tmp_path)).orderBy("ref_idx").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(r["ref_idx"], r["contig"], r["seq"]) for r in rows] == want
    (tmp_path / "b.fa").write_text(">chr1\nGG\n")
    with pytest.raises(ValueError, match="more than once"):
        read_fasta(spark, str(tmp_path))


def test_text_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("n1", "AC", "II", "GT", "##", "S1")], "name string, b1 string, q1 string, b2 string, q2 string, sample string")
    write_pair_text(pairs, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()["value"] == "n1\tAC\tII\tGT\t##"
    reads = spark.createDataFrame([("@n1 1:N:0:AA\n", "AC", "I#", "S1", 1)], "header string, bases string, quals string, sample string, read_no int")
    write_fastq(reads, str(tmp_path / "f"))
    (name,) = [n for n in os.listdir(tmp_path / "f" / "sample=S1" / "read_no=1") if n.startswith("part")]
    assert (tmp_path / "f" / "sample=S1" / "read_no=1" / name).read_text() == "@n1 1:N:0:AA\nAC\n+\nI#\n"


def test_messages(spark):
    pairs = spark.createDataFrame([("n", "A", "", "GT", "é")], "name string, b1 string, q1 string, b2 string, q2 string")
    sent = pairs.select(encode_prq(*map(F.col, pairs.columns)).alias("value"))
    assert bytes(sent.first()["value"]) == b"\0\0\0\1n\0\0\0\1A\0\0\0\0\0\0\0\2GT\0\0\0\2\xc3\xa9"
    assert [tuple(r) for r in pairs_from_messages(sent, "S1").collect()] == [("n", "A", "", "GT", "é", "S1")]
    short = sent.select(F.expr("substring(value, 1, 7)").alias("value"))
    with pytest.raises(Exception, match="truncated"):
        pairs_from_messages(short, "S1").collect()
