"""The pipeline stage by stage against brute force, and the queries with a SQL text."""

import re

import pytest
from parity import compare

import __spark_entry__ as entry
import corpus_pipeline
from basewise.llm import quality
from basewise.llm.common import table
from basewise.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_oracle(spark, duck, sf_dir, name):
    equal, message = compare(spark, duck, sf_dir, QUERIES[name], ORACLES[name])
    assert equal, message


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.collect()
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    good = {r.id for r in quality.score(docs, model).filter("predicted = 1").collect()}
    first = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert first.columns == docs.columns and sorted(r.doc_id for r in first.collect()) == sorted(good) and 0 < len(good) < len(rows)

    repeated = docs.union(docs.limit(30)).withColumnRenamed("lang", "row")
    second = corpus_pipeline.exact_stage(spark, repeated, sf_dir)
    keep = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        keep.setdefault(re.sub("[ \t-\r]+", " ", r.text), r.doc_id)
    assert second.columns == repeated.columns and sorted(r.doc_id for r in second.collect()) == sorted(keep.values())

    words = {r.doc_id: r.text.encode().lower().split() for r in rows}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    near = {a: [b for b in sets if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])] for a in sets}
    best = {a: a for a in sets}
    while (moved := {a: min(best[b] for b in near[a]) for a in sets}) != best:
        best = moved
    third = corpus_pipeline.near_stage(spark, docs, sf_dir)
    assert third.columns == docs.columns and sorted(r.doc_id for r in third.collect()) == sorted(set(best.values()))

    packed = corpus_pipeline.packing_stage(spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == set(sets)


def test_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    ids = lambda df: sorted((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert ids(docs) == ids(corpus_pipeline.run(spark, sf_dir))
    assert docs.limit(0).count() == 0
    empty = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0
