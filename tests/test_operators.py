"""Edge cases and brute-force checks of the operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewise import fixtures as fx
from basewise.functions import adapter, barcodes, cigar, decode, tags
from basewise.operators import containers, demux, mapping, ranking, reference, tracks
from basewise.operators.alignment import sam_records
from basewise.operators.reads import trim_adapter

BASES = "ACGT"


# ------------------------------------------------------------------ functions


def test_decode_every_byte(spark):
    df = spark.createDataFrame([(bytes(range(256)),)], "raw binary")
    b, q = df.select(decode.bases(F.col("raw")), decode.quals(F.col("raw"))).first()
    for byte in range(256):
        assert b[byte] == ("N" if byte < 4 else BASES[byte & 3])
        assert q[byte] == ("#" if byte < 4 else chr(33 + (byte >> 2)))
    assert (b[9], q[9], b[255], q[255]) == ("C", "#", "T", "`")


def test_cigar_round_trip_and_errors(spark):
    df = spark.createDataFrame([("5S10M2D3I4N1P6=7X2H",), ("*",)], "t string")
    back = df.select("t", cigar.cigar_parse(F.col("t")).alias("c")).select(
        "t", cigar.cigar_format(F.col("c")).alias("u"), cigar.alignment_end(F.lit(100), F.col("c")).alias("e"),
        cigar.read_length(F.col("c")).alias("r"),
    ).collect()
    assert back[0]["u"] == back[0]["t"] and back[1]["u"] == ""
    assert back[0]["e"] == 100 + 10 + 2 + 4 + 6 + 7 - 1 and back[0]["r"] == 5 + 10 + 3 + 6 + 7
    with pytest.raises(Exception, match="malformed CIGAR"):
        spark.createDataFrame([("5Q",)], "t string").select(cigar.cigar_parse(F.col("t"))).collect()
    with pytest.raises(Exception, match="unknown CIGAR operator"):
        df.select(cigar.cigar_format(cigar.cigar_parse(F.col("t")), cigar.ALIGNER_OPS)).collect()


def test_tags(spark):
    row = spark.range(1).select(tags.tags_text(tags.sam_tags(F.lit(3), F.lit(-2), F.create_map(F.lit("XA"), F.lit("a:b"))))).first()
    assert row[0] == "AS:i:-2\tNM:i:3\tXA:Z:a:b"


def brute_mask_start(bases, ad):
    hit = len(bases)
    for p in range(len(bases)):
        m = mm = 0
        dead = False
        for a, b in zip(ad, bases[p:]):
            if "N" in (a, b):
                continue
            m, mm = (m + 1, mm) if a == b else (m, mm + 1)
            dead = dead or (mm > 1 and mm > m)
        if not dead and m and 10 * m >= 9 * (m + mm):
            hit = p
            break
    return 0 if hit < 22 else hit


def test_adapter_against_brute_force(spark):
    rng = random.Random(1)
    ad = "".join(rng.choice(BASES) for _ in range(24))
    reads = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    reads += [r[:p] + ad[: rng.randint(1, 24)] for r in reads[:150] for p in (0, 21, 22, 30)]
    # Two mismatches first, then 18 matches: a score of 0.9 that the early exit turns to 0.
    reads.append("A" * 30 + "".join(BASES[(BASES.index(c) + 1) % 4] for c in ad[:2]) + ad[2:20])
    df = spark.createDataFrame([(r, "I" * len(r)) for r in reads], "bases string, quals string").repartition(3)
    for r in trim_adapter(df.withColumn("orig", F.col("bases")), ad).collect():
        start = brute_mask_start(r["orig"], ad)
        assert r["start"] == start, r
        assert r["bases"] == r["orig"][:start] + "N" * (len(r["orig"]) - start)
        assert r["quals"] == "I" * start + "#" * (len(r["orig"]) - start)


def test_adapter_edges(spark):
    starts = adapter._mask_starts("ACGTACGT", 1)
    import pandas as pd

    got = starts(pd.Series(["T" * 30 + "A", "T" * 21 + "ACGTACGT", "T" * 10, "", "T" * 30])).tolist()
    assert got == [30, 0, 0, 0, 30]
    assert adapter._mask_starts("ACGTACGT", 3)(pd.Series(["T" * 30 + "A"])).tolist() == [31]


# ---------------------------------------------------------------------- demux


def brute_match(lane, idx, sheet, limit):
    best = []
    for sl, _, s in sheet:
        if sl == lane and len(idx) <= len(s):
            d = sum(a != b for a, b in zip(idx, s))
            if d <= limit:
                best.append((d, s))
    if not best:
        return (None, -1, 0)
    d, s = min(best)
    return (s, d, sum(x == d for x, _ in best))


@pytest.mark.parametrize("limit", [0, 1, 2])
def test_both_demux_paths_against_brute_force(spark, limit, monkeypatch):
    rng = random.Random(limit)
    sheet = {(rng.randint(1, 2), "".join(rng.choice("ACG") for _ in range(5))): f"S{i}" for i in range(14)}
    sheet = [(lane, name, idx) for (lane, idx), name in sheet.items()] + [(1, "long", "ACGTACG")]
    seen = {(rng.randint(1, 3), "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 3, 4, 5, 5, 5, 6, 8])))) for _ in range(400)}
    seen |= {(1, "ACG."), (1, "acgac"), (2, "AC-GA"), (1, "+++++"), (1, "AC*GA"), (2, ".....")}
    observed = spark.createDataFrame(sorted(seen), "lane int, idx string")
    table = spark.createDataFrame(sheet, "lane int, sample string, idx string")
    want = {(lane, idx): brute_match(lane, idx, sheet, limit) for lane, idx in seen}
    for bound in (500_000, 0):
        monkeypatch.setattr(demux, "BROADCAST_ROWS", bound)
        got = demux.demux_match(observed, table, limit).collect()
        assert {(r["lane"], r["idx"]): (r["best_idx"], r["distance"], r["ties"]) for r in got} == want
        names = {(lane, idx): name for lane, name, idx in sheet}
        samples = {(r["lane"], r["idx"]): r["sample"] for r in demux.demux_assign(observed, table, limit).collect()}
        assert samples == {k: names.get((k[0], best), "Undetermined") for k, (best, _, _) in want.items()}
    assert demux.neighbourhood_size(2, 1) == 1 + 5 + 9


def test_wide_sheet_takes_the_distinct_path(spark, monkeypatch):
    monkeypatch.setattr(demux, "BROADCAST_ROWS", 10)
    sheet = spark.createDataFrame([(1, "A", "ACGT"), (1, "B", "TTTT")], "lane int, sample string, idx string")
    rows = spark.createDataFrame([(1, "ACGA", 1), (1, "GGGG", 2), (2, "ACGT", 3), (1, "TTTT", 4)], "lane int, idx string, n int")
    got = {r["n"]: r["sample"] for r in demux.demux_assign(rows, sheet).collect()}
    assert got == {1: "A", 2: "Undetermined", 3: "Undetermined", 4: "B"}


def test_reads_longer_than_a_chunk(spark):
    from basewise.operators.mapping import map_sequences

    rng = random.Random(4)
    contig = "".join(rng.choice("ACGT") for _ in range(6000))
    long = contig[700:4100]
    wrong = long[:1500] + "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] for c in long[1500:1507]) + long[1507:]
    back = wrong.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    contigs = spark.createDataFrame([(0, "c", contig)], "ref_idx int, contig string, seq string")
    seqs = spark.createDataFrame([(long,), (wrong,), (back,), (contig[100:150],)], "seq string")
    got = {r["seq"]: (r["pos"], r["strand"], r["nm"], r["votes"]) for r in map_sequences(seqs, contigs).collect()}
    words = lambda *runs: sum(max(0, n - 11) for n in runs)
    assert got == {
        long: (701, "+", 0, words(3400)), wrong: (701, "+", 7, words(1500, 1893)), back: (701, "-", 7, words(1500, 1893)),
        contig[100:150]: (101, "+", 0, words(50)),
    }


def test_hamming(spark):
    df = spark.createDataFrame([("ACGT", "ACGA", 1), ("AC", "TCGA", 1), ("", "A", 0), ("ACG", "AC", None), ("N", "A", 1)], "a string, b string, d int")
    assert all(r[0] == r[1] for r in df.select(barcodes.hamming(F.col("a"), F.col("b")), "d").collect())


# -------------------------------------------------------------------- ranking


def test_ranked_with_one_hot_group(spark):
    df = spark.range(0, 20_000, numPartitions=7).select(
        F.when(F.col("id") % 10 < 6, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % 20_011).alias("o")
    )
    got = ranking.ranked(df, ["g"], [F.col("o")])
    want = df.select("*", F.expr("row_number() over (partition by g order by o)").cast("long").alias("rn"))
    assert got.exceptAll(want).count() == 0 and got.count() == 20_000


# -------------------------------------------------------------------- mapping


def brute_map(read, contigs, k, penalty=5, min_score=10):
    """All placements that share a word, scored one by one."""
    found = []
    rc = read.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    for strand, o in (("+", read), ("-", rc)):
        for ref, seq in contigs:
            for at in range(len(seq) - len(o) + 1):
                same = "".join("1" if a == b != "N" else "0" for a, b in zip(o, seq[at:]))
                votes = sum(max(0, len(run) - k + 1) for run in same.split("0"))
                if votes:
                    found.append((-(len(o) - penalty * same.count("0")), -votes, ref, at + 1, strand))
    found.sort()
    if not found or -found[0][0] < min_score:
        return None
    score = -found[0][0]
    second = -found[1][0] if len(found) > 1 else None
    mapq = 60 if second is None else min(60, max(0, 60 * (score - second) // score))
    return (*found[0][2:], -found[0][1], score, mapq)


def test_mapping_against_brute_force(spark):
    rng = random.Random(5)
    seq = "".join(rng.choice(BASES) for _ in range(1500))
    # Long single-letter and two-letter stretches: very frequent words on both sides.
    c0 = seq[:900] + "A" * 120 + seq[900:1100] + "AC" * 60 + seq[1100:]
    c1 = "A" * 40 + seq[300:700] + "N" * 5 + seq[700:760] + "A" * 30
    contigs = [(0, c0), (1, c1)]
    reads = ["A" * 30, "T" * 30, "AC" * 15, "A" * 20 + "CCGTA", "ACGT", ""]
    for _ in range(120):
        c = rng.choice((c0, c1))
        at = rng.randint(0, len(c) - 30)
        r = list(c[at : at + rng.randint(20, 30)])
        for _ in range(rng.randint(0, 4)):
            r[rng.randrange(len(r))] = rng.choice("ACGTN")
        r = "".join(r)
        reads.append(r if rng.random() < 0.5 else r.translate(str.maketrans("ACGT", "TGCA"))[::-1])
    # A third of the input is copies of one read.
    rows = [(i, r) for i, r in enumerate(reads + [reads[0]] * 60)]
    df = spark.createDataFrame(rows, "id int, seq string")
    table = spark.createDataFrame([(i, f"c{i}", s) for i, s in contigs], "ref_idx int, contig string, seq string")
    got = {r["id"]: r for r in mapping.map_reads(df, table, k=8).collect()}
    assert len(got) == len(rows)
    for i, r in rows:
        want = brute_map(r, contigs, 8)
        g = got[i]
        assert (None if g["ref_idx"] is None else (g["ref_idx"], g["pos"], g["strand"], g["votes"], g["score"], g["mapq"])) == want, r


def test_reads_map_to_their_origin(spark, sf_dir):
    origin = fx.with_position(fx.clusters(spark, sf_dir)).withColumn("name", fx.name_column()).select(
        "name", "tcontig", "pos1", "tlen", (F.col("cid") % 13 == 0).alias("rand1"), (F.col("cid") % 169 == 0).alias("rand2")
    )
    rows = fx.records(spark, sf_dir).join(origin.withColumnRenamed("tlen", "size"), "name").where("mapq > 0")
    random_read = F.when(F.col("read_no") == 1, F.col("rand1")).otherwise(F.col("rand2"))
    start = F.when(F.col("read_no") == 1, F.col("pos1")).otherwise(F.col("pos1") + F.col("size") - 36)
    assert rows.where(random_read).count() == 0
    assert rows.where((F.col("rname") != F.col("tcontig")) | (F.col("pos") != start)).count() == 0
    assert rows.count() > 1500


def test_mate_fields_of_unmapped_reads(spark):
    contigs = spark.createDataFrame([(0, "c", "ACGT" * 50)], "ref_idx int, contig string, seq string")
    schema = "name string, sample string, read_no int, seq string, qual string, ref_idx int, pos int, strand string, nm int, score int, mapq int"
    rows = [
        ("a", "s", 1, "ACGT", "IIII", None, None, None, None, None, 0), ("a", "s", 2, "ACGT", "IIII", None, None, None, None, None, 0),
        ("b", "s", 1, "AACG", "ABCD", 0, 9, "-", 0, 4, 60), ("b", "s", 2, "ACGT", "IIII", None, None, None, None, None, 0),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r["name"], r["read_no"]): r for r in sam_records(df, contigs).collect()}
    assert (got["a", 1]["flag"], got["a", 2]["flag"]) == (1 + 4 + 64, 1 + 4 + 128)
    assert (got["b", 1]["flag"], got["b", 2]["flag"]) == (1 + 8 + 16 + 64, 1 + 4 + 128)
    assert (got["b", 1]["seq"], got["b", 1]["qual"]) == ("CGTT", "DCBA")
    shown = {(r["name"], r["read_no"]): r for r in sam_records(df, contigs, mate_info_on_unmapped=True).collect()}
    assert shown["b", 2]["flag"] == 1 + 4 + 32 + 128 and (shown["b", 2]["rnext"], shown["b", 2]["pnext"]) == ("c", 9)
    with pytest.raises(Exception, match="read number must be 1 or 2"):
        sam_records(df.withColumn("read_no", F.lit(3)), contigs).collect()


def test_chunks_of_a_long_contig(spark):
    rng = random.Random(2)
    seq = "".join(rng.choice(BASES) for _ in range(3 * reference.CHUNK + 7))
    contigs = spark.createDataFrame([(0, "c", seq)], "ref_idx int, contig string, seq string")
    words = reference.contig_words(reference.contig_chunks(contigs), 15).collect()
    assert sorted((r["p"], r["word"], r["prev"]) for r in words) == [
        (p + 1, seq[p : p + 15], seq[p - 1] if p else "^") for p in range(len(seq) - 14)
    ]


# ----------------------------------------------------------- containers, tracks


def brute_containers(refs, n, m):
    out, size, ctx, cid = [], 0, None, -1
    for r in refs:
        if size == 0 or size >= n or (ctx != -1 and r == -1) or (ctx not in (-2, r) and size > m):
            cid, size, ctx = cid + 1, 1, r
        else:
            ctx = ctx if ctx in (-2, r) else -2
            size += 1
        out.append((cid, size))
    return out


@pytest.mark.parametrize("n,m", [(10, 3), (7, 7), (5, 1), (100, 10)])
def test_coordinate_containers_against_the_sequential_rule(spark, n, m):
    rng = random.Random(n)
    rows = []
    for sample in "abc":
        for ref in [*sorted(rng.sample(range(12), 8)), -1]:
            for i in range(rng.choice([1, 2, 3, 4, 11, 30, 61])):
                rows.append((sample, ref, i if ref >= 0 else 0, f"{sample}{ref}-{i:03d}", 1))
    df = spark.createDataFrame(rows, "sample string, ref_idx int, pos int, name string, read_no int")
    got = {(r["sample"], r["name"]): (r["container_id"], r["rec_index"]) for r in containers.containers_by_coordinate(df, n, m).collect()}
    for sample in "abc":
        mine = sorted((r for r in rows if r[0] == sample), key=lambda r: (r[1] == -1, r[1], r[2], r[3]))
        for r, want in zip(mine, brute_containers([r[1] for r in mine], n, m)):
            assert got[sample, r[3]] == want


def test_tracks_against_brute_force(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice(BASES) for _ in range(2 * reference.CHUNK + 300))
    contigs = spark.createDataFrame([(0, "c", seq)], "ref_idx int, contig string, seq string")
    rows, depth, wrong = [], np.zeros(len(seq) + 2, int), np.zeros(len(seq) + 2, int)
    shapes = ["30M", "5S10M3D12M", "10M2I8M", "4M1200N9M", "3H6=2X6=", "2I9M"]
    for _ in range(200):
        shape = rng.choice(shapes)
        parts = [(int("".join(g)), op) for g, op in zip(*[iter(["".join(x) for _, x in itertools.groupby(shape, str.isdigit)])] * 2)]
        span = sum(n for n, op in parts if op in "MDN=X")
        # A hot start, close to a chunk edge, takes a third of the reads.
        pos = reference.CHUNK - 10 if rng.random() < 0.33 else rng.randint(1, len(seq) - span + 1)
        at, read = pos, ""
        for n, op in parts:
            if op in "MDN=X":
                depth[at : at + n] += 1
            for i in range(n):
                if op in "M=X":
                    base = seq[at - 1 + i] if rng.random() < 0.9 else rng.choice("ACGTN")
                    wrong[at + i] += base != seq[at - 1 + i]
                    read += base
                elif op in "IS":
                    read += rng.choice(BASES)
            at += n if op in "MDN=X" else 0
        rows.append((0, pos, shape, read))
    rows.append((-1, 0, "", "ACGT"))
    df = spark.createDataFrame(rows, "ref_idx int, pos int, text string, seq string").withColumn("cigar", cigar.cigar_parse(F.col("text")))
    assert {r["pos"]: r["n"] for r in tracks.coverage(df).collect()} == {p: int(d) for p, d in enumerate(depth) if d}
    assert {r["pos"]: r["n"] for r in tracks.mismatch_track(df, contigs).collect()} == {p: int(d) for p, d in enumerate(wrong) if d}


def test_comparison_of_a_batch():
    import numpy as np
    import pyarrow as pa

    reads, others = ["ACGTACGT", "ANGT", "A", "ACGTAC"], ["ACGAACGT", "ANGT", "A", "ACGTAC"]
    nm, votes = mapping.compare(pa.array(["x", *reads])[1:], pa.array(others), np.array([8, 8, 8, 2]), 3)
    assert nm.tolist() == [1, 1, 0, 0] and votes.tolist() == [1 + 2, 0, 0, 4]


def test_stored_tables_are_deleted(spark):
    import os

    from basewise import session

    with session.scratch(spark):
        inside = session.scratch_path(spark, "t")
        session.materialize(spark.range(3), "t")
    outside = session.materialize(spark.range(3), "t")
    assert not os.path.exists(os.path.dirname(inside).removeprefix("file:")) and outside.count() == 3


def test_index_is_stored_once(spark):
    rng = random.Random(9)
    seq = "".join(rng.choice(BASES) for _ in range(2500))
    contigs = spark.createDataFrame([(0, "c", seq)], "ref_idx int, contig string, seq string")
    index = reference.reference_index(contigs, 10)
    assert "Generate" not in index.words._jdf.queryExecution().toString()
    seqs = spark.createDataFrame([(seq[5:45],), (seq[2400:2440],)], "seq string")
    assert {r["pos"] for r in mapping.map_sequences(seqs, index).collect()} == {6, 2401}
