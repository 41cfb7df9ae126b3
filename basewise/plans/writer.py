"""Aligned records to per-sample files and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basewise.operators.containers import (
    alignment_delta, container_context, container_quality, container_span, containers_by_coordinate,
    containers_by_count, mate_links,
)
from basewise.operators.reference import Reference, contigs_of
from basewise.operators.routing import drop_eos
from basewise.operators.tracks import coverage, mismatch_track
from basewise.sinks import write_records, write_sam_text
from basewise.sources.tables import read_records


def contain(records: DataFrame, coordinate_order: bool = False) -> DataFrame:
    """Records with every container column. Unsorted by default, as in a live pipeline."""
    placed = containers_by_coordinate(records) if coordinate_order else containers_by_count(records)
    return mate_links(alignment_delta(placed), coordinate_order)


def container_summary(contained: DataFrame) -> DataFrame:
    """One row per container: span, context, record count and quality check."""
    keys = ["sample", "container_id"]
    return container_span(contained).join(container_context(contained), keys).join(container_quality(contained), keys)


def write_run(spark: SparkSession, data: str, reference: DataFrame | Reference, out: str, part_records: int = 1_000_000) -> None:
    """The writer program: SAM text and Parquet per sample, tracks per contig."""
    records = drop_eos(read_records(spark, f"{data}/records"), aligned=True)
    write_sam_text(records, contigs_of(reference), f"{out}/sam", part_records)
    write_records(records, f"{out}/parquet")
    coverage(records).write.parquet(f"{out}/coverage")
    mismatch_track(records, reference).write.parquet(f"{out}/mismatches")
