"""Run manifest (XML)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise import schemas
from basewise.operators.layout import CycleRange, cycle_ranges


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per run: instrument, run_number, flowcell, reads, lanes, surfaces, swaths, tiles."""
    run = spark.read.format("xml").option("rowTag", "Run").schema(schemas.RUN_XML).load(path)
    reads = F.transform(
        "Reads.Read",
        lambda r: F.struct(r["_NumCycles"].alias("num_cycles"), (r["_IsIndexedRead"] == "Y").alias("is_index")),
    )
    layout = F.col("FlowcellLayout")
    return run.select(
        F.col("Instrument").alias("instrument"), F.col("_Number").alias("run_number"), F.col("Flowcell").alias("flowcell"),
        reads.alias("reads"), layout["_LaneCount"].alias("lanes"), layout["_SurfaceCount"].alias("surfaces"),
        layout["_SwathCount"].alias("swaths"), layout["_TileCount"].alias("tiles"),
    )


def manifest_reads(run: DataFrame) -> DataFrame:
    """(flowcell, read_no, num_cycles, is_index)."""
    return run.select("flowcell", F.posexplode("reads").alias("_i", "_r")).select(
        "flowcell", (F.col("_i") + 1).alias("read_no"), "_r.num_cycles", "_r.is_index"
    )


def run_ranges(run: DataFrame) -> list[CycleRange]:
    """Cycle ranges of one run. This is the one list the driver reads: a few reads."""
    rows = cycle_ranges(manifest_reads(run), ["flowcell"]).orderBy("read_no").collect()
    if not rows:
        raise ValueError("the run manifest lists no reads")
    return [CycleRange(r["read_no"], r["is_index"], r["first_cycle"], r["last_cycle"]) for r in rows]
