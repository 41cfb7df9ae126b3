"""Licences in paragraphs: several at once, wrapped over lines, unknown ones, brute-force confirmation."""

import re
import textwrap

import pytest

from basewise.llm import licences
from basewise.llm.common import table

MIT = " ".join(licences.SENTENCES["MIT"][:3])
ISC = licences.SENTENCES["ISC"][0]
OWN = "Copying of this recipe is allowed to members of the club who paid their fee for the running year, and to nobody else."


@pytest.fixture(scope="module")
def model(spark):
    return licences.fit(table(spark, "/root/testdata/sf0.01", "documents"))


def finds(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return licences.scan(docs, model).collect()


def confirmed(rows):
    return {(r.id, r.paragraph, r.family) for r in rows if r.confirmed}


def test_families(spark, model):
    texts = [
        "Intro words here.\n\nThis code is dual-licensed under the MIT License and the Apache License, Version 2.0.",
        "Copyright 2020 someone.\n\n" + "\n".join(textwrap.wrap(ISC, 70)) + "\n\nThe end.",
        "\n".join(textwrap.wrap(MIT, 72)),
        MIT,
        "one two three " * 60 + MIT + " four five six" * 60,
        OWN,
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "License: MIT\r\nAuthor: me\r\n \r\nSPDX-License-Identifier: BSD-3-Clause",
        "This work is licensed under CC BY-NC 4.0.",
        None,
        "",
    ]
    got = confirmed(finds(spark, model, texts))
    assert got == {(0, 1, "MIT"), (0, 1, "Apache-2.0"), (1, 1, "ISC"), (2, 0, "MIT"), (3, 0, "MIT"), (4, 0, "MIT"), (6, 0, "LGPL"), (7, 0, "MIT"), (7, 1, "BSD"), (8, 0, "CC-BY-NC")}


def test_confirmation_as_brute_force(spark, model):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = licences.scan(docs, model).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    split = lambda s: [w for w in re.split(r"[^\w]+|_", s.lower()) if w]
    runs = lambda ws, n: {" ".join(ws[i:i + n]) for i in range(max(1, len(ws) - n + 1))}
    known = {}
    for r in model.templates.filter("triples is not null").collect():
        known.setdefault(r.family, set()).add(frozenset(r.triples))
    assert len([r for r in rows if r.confirmed]) > 20
    for r in rows:
        block = re.split(r"\n[ \t]*(?:\n[ \t]*)+", texts[r.id])[r.paragraph]
        held = runs(split(block), 3) | runs(split(block), 2)
        best = max(len(t & held) / len(t) for t in known[r.family])
        # A passage is a part of its paragraph.
        assert r.similarity <= best + 1e-9 and r.confirmed == (r.similarity >= licences.CONFIRM) and licences.BAR <= r.probability <= 1
    # No paragraph that holds a whole template, line by line, is without its family.
    got = {(r.id, r.paragraph, r.family) for r in rows}
    for doc, text in texts.items():
        for n, block in enumerate(re.split(r"\n[ \t]*(?:\n[ \t]*)+", text)):
            for line in block.split("\n"):
                if re.search(r"(?i)(licensed|released) under the (MIT License|Apache License, Version 2\.0)\.", line):
                    assert {f for i, p, f in got if (i, p) == (doc, n)}, (doc, n, line[:200])


def test_repeated_rows(spark, model):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License.")], "doc_id long, text string")
    rows = licences.scan(docs, model).collect()
    assert len(rows) == 3 == len({r.row for r in rows}) and {r.family for r in rows} == {"MIT"}
