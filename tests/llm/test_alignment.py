"""Token alignment against pair-by-pair overlaps."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from basewise.llm import alignment
from basewise.llm.common import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
LETTERS |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in LETTERS)}


def brute(texts):
    """``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each text."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    sides, count = [], Counter()
    for text in texts:
        want, spans = (" " + (text or "")).encode(), []
        for ids, entry in (
            (one.encode(" " + (text or ""), add_special_tokens=False).ids, lambda i: bytes(LETTERS[c] for c in one.id_to_token(i))),
            (two.encode(text or ""), lambda i: bytes([int(two.id_to_piece(i)[1:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()),
        ):
            at, own, joined = 0, [], b""
            for i in ids:
                own.append((at, at + len(entry(i)), i))
                joined += entry(i)
                at = len(joined)
            spans.append(own if text and joined == want else None)
        spans = [[], []] if None in spans else spans
        links = [(x, y) for a1, a2, x in spans[0] for b1, b2, y in spans[1] if a1 < b2 and b1 < a2]
        count.update(links)
        sides.append((spans, links))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    out = []
    for (a, b), links in sides:
        groups, x, y = [], [], []
        ends = {e for _, e, _ in a} & {e for _, e, _ in b}
        start = 0
        for end in sorted(ends):
            x, y = ([str(i) for s, e, i in side if start <= s and e <= end] for side in (a, b))
            groups.append(",".join(x) + "|" + ",".join(y))
            start = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), digest))
    return out


def check(spark, docs, texts, ids):
    got = sorted(map(tuple, alignment.align_table(docs, A, B).collect()), key=str)
    assert got == sorted([(i, *row) for i, row in zip(ids, brute(texts))], key=str)


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 200)
    texts = [None, "", " ", "a", "  two  spaces ", "<|endoftext|> and <s></s><0x41>", "low ▁ line", "tab\tnew\nline\r\n\0", "naïve café Σίσυφος 中文 𝔘𝔫𝔦 👩‍👩‍👧",
             "unbelievable tokenization of antidisestablishmentarianism", "x" * 3000, "repeat " * 200, "repeat " * 200, "1234567890 3.14159", "don't we'll"]
    ids = [*range(len(texts) - 2), None, 3]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in zip(ids, texts)], "doc_id long, text string, chunk string, id string, pairs int").repartition(3)
    check(spark, docs, texts, ids)


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").limit(60)
    rows = [r for r in docs.collect()]
    check(spark, docs, [r.text for r in rows], [r.doc_id for r in rows])


def test_no_rows(spark):
    empty = alignment.align_table(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert empty.count() == 0 and empty.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_covering_tokens_are_found_by_place_alone():
    import pandas as pd

    left, right = pd.DataFrame({"at": [0, 2, 5, 9]}), pd.DataFrame({"at": [0, 3, 5, 6]})
    assert alignment._covering(left, right).tolist() == [0, 0, 2, 3]
    assert alignment._covering(right, left).tolist() == [0, 1, 2, 2]


def test_units_met_together_are_told_apart_where_one_changes():
    texts = ["plain words here", "ab \ufb01ne \uff21", "tab\tand space", "\u00e9t\u00e9 \U0001f600", "x", ""]
    for path in (A, B):
        side = alignment.Side(path)
        assert side.tokens(texts) == [alignment.Side(path).tokens([t])[0] for t in texts]
    # An entry of as many other bytes: only the texts that hold it have no tokens.
    side = alignment.Side(A)
    token = Tokenizer.from_file(A).encode(" words", add_special_tokens=False).ids[0]
    side.entries[token] = bytes(len(side.entries[token]))
    assert [bool(t) for t in side.tokens(texts)] == [False, True, True, True, True, True]
