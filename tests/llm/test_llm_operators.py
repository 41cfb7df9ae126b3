"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import html
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from basewise.llm import chat, common, cross_polytope, exact_dedup, licences, main_text, packing, piece_bpe, quality, sharding, simhash

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row long, fingerprint string, kept string, length string, `a.b` int"


def near_copies(rng):
    base = " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 40)) for _ in range(400))
    for _ in range(25):
        words = base.split()
        words[rng.randrange(400)] = "other"
        yield " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = [None, "", " ", "\t\n", "a", "A", "one two", "one  two", "one\ttwo\n", "Ünïcode, ßtraße. Σίσυφος's <|endoftext|> 中文 12'll", "x" * 70_000, "word " * 9_000]
    out += ["the same text"] * 40 + list(near_copies(rng))
    out += [" ".join(rng.choice("ab cd ef, gh. ij'k LM É".split()) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i != 20 else None, t, 1, "f", "k", "l", 2) for i, t in enumerate(texts)]
    rows += [rows[5], rows[14], rows[0]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lowest(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(docs, bits):
    """Few bits force different chunks to share identifiers; the result must not change."""
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub("[\x20\x09-\x0d]+", " ", r.text or "")].append(r.doc_id)
    want = Counter((i, lowest(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    got = exact_dedup.exact_groups(docs, bits=bits).collect()
    assert Counter((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.id == r.keep_id for r in kept)


def test_chunks_follow_content():
    rng = np.random.Generator(np.random.PCG64(1))
    body = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8)).decode()
    import pyarrow as pa

    one, two = exact_dedup.chunks(pa.array([body, "head " + body]))
    assert b"".join(one) == body.encode() and max(map(len, one)) <= exact_dedup.MOST
    assert len(set(one) & set(two)) >= len(one) - 2
    assert exact_dedup.chunks(pa.array(["z", body]))[1] == one


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(docs):
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    prints = sorted({p for _, p in rows})
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 2]
    for a, b in pairs:
        parent[find(a)] = find(b)
    assert pairs, "the fixture must hold near copies"
    members = defaultdict(list)
    for i, p in rows:
        members[find(p)].append(i)
    want = Counter((i, p - (1 << 64) if p >> 63 else p, lowest(members[find(p)])) for i, p in rows)
    got = simhash.near_groups(docs).collect()
    assert Counter((r.id, r.fingerprint, r.component_id) for r in got) == want
    assert sum(r.row == r.keep_row for r in got) == len(members)


@pytest.mark.parametrize("segments", [8, 11, 16])
def test_links_of_any_grid(spark, segments):
    rng = random.Random(segments)
    values = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for v in list(values)[:120]:
        values.add(v ^ 1 << rng.randrange(64))
        values.add(v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    got = [tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), 2, segments).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (7000, 7000)]
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.root].add(r.node)
    assert sorted(map(len, groups.values())) == [2, 301]


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want[r.doc_id, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    got = packing.pack(docs, WORDS).collect()
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own]).tolist()[:-1]] and sum(n for _, n in own) <= 2048
    # No packing can do with less: all tokens need room, and no two pieces over half a sequence share one.
    assert len(places) <= max(-(-sum(r.length for r in got) // 2048), sum(r.length > 1024 for r in got)) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 60) for n in rng.sample(range(1, 101), 30)}
    plan = packing.make_plan(counts, 100)
    filled, ranks = defaultdict(list), defaultdict(set)
    for length, first, count, sequence, offset in plan.runs:
        for i in range(count):
            filled[sequence + i].append((offset, length))
            ranks[length].add(first + i)
    assert {n: len(r) for n, r in ranks.items()} == counts and all(r == set(range(len(r))) for r in ranks.values())
    assert len(filled) == plan.sequences
    for own in filled.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(n for _, n in own) <= 100
    best = packing.Plan(100)
    for n in sorted(counts, reverse=True):
        best.best_fit(n, counts[n])
    assert plan.sequences <= best.sequences * 1.03 + 1


def test_sharding(docs):
    rows = docs.collect()
    got = sharding.shard_table(docs, 16, seed=3).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_communication_is_exact_and_uniform():
    counts = [5, 0, 30, 7, 18]
    drawn = np.array([sharding.communication(counts, 4, s) for s in range(3000)])
    assert (drawn.sum(axis=2) == counts).all() and (drawn.sum(axis=1) == 15).all()
    assert np.abs(drawn.mean(axis=0) - np.array(counts)[:, None] / 4).max() < 0.15
    # Variance of a hypergeometric count.
    assert abs(drawn[:, 2, 0].var() / (30 * 0.25 * 0.75 * 30 / 59) - 1) < 0.12


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(back.select("source.doc_id", "source.text").collect()) == Counter(docs.select("doc_id", "text").collect())


def test_pieces_as_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng, own = random.Random(2), piece_bpe.codec(PIECES)
    for _ in range(1500):
        text = "".join(rng.choices("abcdetin  \n▁<>0129é中😀́\x00.,'-IN", k=rng.randint(0, 40)))
        ids = own.encode(text)
        assert ids == library.encode(text) and own.decode(ids) == library.decode(ids)
        odd = [rng.choice([rng.randrange(32000), rng.randint(3, 258)]) for _ in range(rng.randint(0, 8))]
        assert own.decode(odd) == library.decode(odd)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "")
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter(tuple(r) for r in piece_bpe.digest_table(docs, PIECES).collect()) == want
    encoded = piece_bpe.encode_table(docs, PIECES)
    assert Counter((r.id, r.text) for r in piece_bpe.decode_table(encoded, PIECES).collect()) == Counter((r.doc_id, library.decode(library.encode(r.text or ""))) for r in docs.collect())


def test_chat(spark):
    odd = ["", None, "<|im_end|>\n", "\\", "<\\|<", "a\nb", "<|im_start|>assistant\nhi"]
    rows = [(c, t, role, text) for c in (1, 2, None) for t, (role, text) in enumerate(itertools.product(["user", "assistant", "a\nb\\n", None], odd))]
    rows += [rows[3], (9, None, "assistant", "x")]
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, start int").repartition(4)
    said = defaultdict(list)
    for c, t, role, text in rows:
        said[c].append((-1 if t is None else t, role or "", text or ""))
    want = {}
    for c, own in said.items():
        own = [(r, t) for _, r, t in sorted(own)]
        loss = "".join(t for r, t in own if r == "assistant")
        want[c] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.marked(own)))
        spans = chat.render(own)
        assert "".join(s.added for s in spans) == chat.marked(own) and [(r, t) for r, t, _, _ in chat.parse(chat.marked(own))] == own
    assert {r[0]: tuple(r)[1:] for r in chat.digest_table(table).collect()} == want
    whole = defaultdict(str)
    for r in sorted(chat.format_turns(table).collect(), key=lambda r: r.position):
        assert r.start == len(whole[r.conv_id])
        whole[r.conv_id] += r.added
    assert {c: len(s) for c, s in whole.items()} == {c: w[4] for c, w in want.items()}


def test_templates_that_rewrite_history():
    turns = [("user", "hi"), ("assistant", "ho")] * 30
    assert not chat.rewrites(turns, chat.marked)
    assert not chat.rewrites(turns, lambda t: "<s>" + chat.marked(t))
    assert chat.rewrites(turns, lambda t: f"{len(t)} turns" + chat.marked(t))
    assert chat.rewrites(turns, lambda t: chat.marked([(r, x if i == len(t) - 1 else x[:1]) for i, (r, x) in enumerate(t)]))
    assert not chat.rewrites(turns, lambda t: "".join(f"{i}:{x};" for i, (_, x) in enumerate(t)))  # numbered turns stay as they were
    head = chat.render([("user", "a")], lambda t: "<s>" + chat.marked(t))
    assert head[0].added.startswith("<s>")


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar"><nav><a>Menu</a></nav>
    <div class="ad">Buy, now. Yes.</div><article><h1>Head &amp; line</h1><p><b>One,  two.<br><p>Three <a>linked</a> words&nbsp;here, &lt;b&gt;.</p><ul><li>x<li>y</ul>
    <form>Your name</form><aside>More, things. Here.</aside></article><div id="comments"><p>Nice, post. Thanks.</p></div><footer>&copy; us</footer><script>"<p>no</p>" """
    assert main_text.extract(page) == "Head & line\nOne, two.\nThree linked words here, <b>.\nx\ny"
    assert [main_text.extract(h) for h in (None, "", "<p></p>", "<nav>a</nav>", "just text")] == ["", "", "", "", "just text"]
    long = "".join(f"<p>Sentence {i}, and more of it. It goes on.</p>" for i in range(3000))
    assert main_text.extract(f"<div><a>m</a><a>n</a></div><div>{long}</div><div class='footer'>f</div>").count("\n") == 2999
    assert main_text.extract("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"


def test_main_text_of_all_pages(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages")
    got = {r.id: r for r in main_text.extract_table(pages.withColumn("text", F.lit("clash"))).collect()}
    for r in pages.collect():
        body = r.html.split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>", body)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_nearest(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    centres = rng.normal(size=(6, 24))
    vectors = [(centres[i % 6] + 0.6 * rng.normal(size=24)).tolist() for i in range(900)]
    vectors[17] = vectors[18] = vectors[0]  # ties
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] + [1.0] * 23, 1), (1003, [None] + [1.0] * 23, 1), (None, vectors[3], 1), (5, vectors[5], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, place int").repartition(3)
    got = defaultdict(list)
    for r in cross_polytope.search(table, lambda c: c % 100 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    every, hits = np.array(vectors), 0
    assert set(got) == set(range(0, 900, 100))
    for q, found in got.items():
        found.sort()
        distance = np.sqrt(((every - every[q]) ** 2).sum(axis=1))
        assert [r for r, _, _ in found] == list(range(1, 11)) and found == sorted(found, key=lambda f: (f[2], f[1]))
        assert all(v != q and s == distance[v] for _, v, s in found)
        hits += len({v for _, v, _ in found} & set([v for v in np.lexsort((np.arange(900), distance)) if v != q][:10]))
    assert hits >= 0.9 * 90
    few = spark.createDataFrame(rows[:4], table.schema)
    assert [r.vec_id for r in cross_polytope.search(few, lambda c: c % 100 == 0).orderBy("rank").collect()] == sorted([1, 2, 3], key=lambda v: np.linalg.norm(every[v] - every[0]))
    assert cross_polytope.search(few.limit(0), lambda c: c % 100 == 0).count() == 0


def test_rotation_keeps_lengths():
    rng = np.random.Generator(np.random.PCG64(1))
    x = rng.normal(size=(20, 50))
    assert np.allclose(np.linalg.norm(cross_polytope.rotated(x, 2), axis=1), np.linalg.norm(x, axis=1))
    turned = cross_polytope.rotated(x, 0)
    best = np.abs(turned).argmax(axis=1)
    assert (cross_polytope.axes(x, 0, 1)[:, 0] == best + 64 * (turned[np.arange(20), best] < 0)).all()


def test_licences(spark, docs, nothing):
    known = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0."]
    rows = [(i, f"Some other words that are here {i}, and go on.\n{known[i % 4]}\nThe end of it.") for i in range(40)] + [(90, None), (91, ""), (92, "long words " * 20_000 + ". " + known[0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, words string")
    found = [r for r in licences.scan(table, licences.fit(table)).collect() if r.confirmed]
    family = ["MIT", "CC-BY-NC", "GPL", "Apache-2.0"]
    assert sorted((r.id, r.paragraph, r.family) for r in found) == sorted([(i, 0, family[i % 4]) for i in range(40)] + [(92, 0, "MIT")])
    model = licences.fit(nothing)
    assert licences.scan(nothing, model).count() == 0


def test_quality(spark, sf_dir, docs, nothing):
    table, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    scored = quality.score(table, quality.fit(table, labels))
    held = scored.join(labels, scored.id == labels.doc_id).filter("held_out").collect()
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in held)
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.id: r.score for r in quality.score(table, quality.fit(table, flipped)).collect()}
    assert all(again[r.id] == r.score for r in held), "labels of held-out rows must not matter"
    model = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5} and quality.score(nothing, model).count() == 0
    one = quality.fit_rows(np.zeros((5, len(quality.FEATURES))), np.ones(5))
    assert one.scores(np.zeros((1, len(quality.FEATURES))))[0] > 0.8


def test_empty_tables(nothing):
    for made in (exact_dedup.exact_groups(nothing), simhash.near_groups(nothing), packing.pack(nothing, WORDS), sharding.shard_table(nothing), piece_bpe.digest_table(nothing, PIECES)):
        assert made.count() == 0
    turns = nothing.selectExpr("doc_id conv_id", "doc_id turn", "text role", "text")
    assert chat.digest_table(turns).count() == 0 and chat.format_turns(turns).count() == 0
    assert main_text.extract_table(nothing.selectExpr("doc_id page_id", "text url", "text html")).count() == 0
