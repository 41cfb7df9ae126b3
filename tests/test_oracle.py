"""Registered queries against DuckDB.

A spread of them by default; ``BASEWISE_ALL=1`` runs all. ``tests/parity.py`` does the
same from the command line at any scale.
"""

import os

import pytest
from parity import compare

import __spark_entry__ as entry
from basewise.queries import ORACLES, QUERIES

SPREAD = [
    "enumerate_tiles", "cycle_ranges", "transpose_cycles", "mask_nocalls", "to_fastq", "to_read_pairs", "trim_adapter",
    "enumerate_kmers", "hamming", "demux_match", "demux_match_pieces", "sample_counts", "toc_message", "parse_prq",
    "count_windows", "stream_count_windows", "stream_align", "sam_records", "cigar_parse", "alignment_end", "with_eos",
    "containers_by_coordinate", "detached", "coverage", "mismatch_track", "roundtrip_diff", "demux_summary",
]
NAMES = list(QUERIES) if os.environ.get("BASEWISE_ALL") else SPREAD


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, sf_dir, name):
    equal, message = compare(spark, duck, sf_dir, entry.queries()[name], entry.oracle_sql()[name])
    assert equal, message


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
