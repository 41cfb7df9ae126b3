"""Whole run folders made from the driver's tables: manifest, sheet, cycle, filter, control and location files."""

from __future__ import annotations

import gzip
import posixpath
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise import fixtures as fx
from basewise.operators.transpose import cycle_blocks
from basewise.options import Options
from basewise.session import materialize, scratch_path

BLOCK = 4096
BASE = "Data/Intensities/BaseCalls"


def put(path: str, content: bytes) -> None:
    """One file, from wherever this runs."""
    from pyarrow import fs

    where = path.removeprefix("file:") if path.startswith("file:") else path
    system, inside = (fs.LocalFileSystem(), "/" + where.lstrip("/")) if where.startswith("/") else fs.FileSystem.from_uri(where)
    system.create_dir(posixpath.dirname(inside), recursive=True)
    with system.open_output_stream(inside, compression=None) as out:
        out.write(content)


def write_files(files: DataFrame) -> int:
    """Writes (path, content) rows as files, from executors; the number written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                put(path, content.as_py())
            yield batch.select(["path"])

    return files.select("path", "content").mapInArrow(run, "path string").count()


def _joined(parts: list[dict], block_size: int) -> bytes:
    """Blocks of one file in a row; absent or short ones are filled with no-calls."""
    last = max(parts, key=lambda p: p["block"])
    out = bytearray(last["block"] * block_size + len(last["bytes"]))
    for p in parts:
        at = p["block"] * block_size
        out[at:at + len(p["bytes"])] = p["bytes"]
    return bytes(out)


def _tile_files(blocks: DataFrame, base: str) -> DataFrame:
    """(path, content, lane, tile, cycle) of the cycle files and, as cycle 0, the filter files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a row is a whole file
                r = batch.slice(at, 1).to_pylist()[0]
                body, lane, tile, cycle = _joined(r["parts"], BLOCK), r["lane"], r["tile"], r["cycle"]
                if cycle:
                    path = f"{base}/L{lane:03d}/C{cycle}.1/s_{lane}_{tile}.bcl.gz"
                    content = gzip.compress(struct.pack("<I", len(body)) + body, 1, mtime=0)
                else:
                    path = f"{base}/L{lane:03d}/s_{lane}_{tile}.filter"
                    content = struct.pack("<III", 0, 3, len(body)) + body
                yield pa.RecordBatch.from_pylist([{"path": path, "content": content, "lane": lane, "tile": tile, "cycle": cycle}], schema=_FILES)

    parts = blocks.groupBy("lane", "tile", "cycle").agg(F.collect_list(F.struct("block", "bytes")).alias("parts"))
    return parts.mapInArrow(run, "path string, content binary, lane int, tile int, cycle int")


_FILES = pa.schema([("path", pa.string()), ("content", pa.binary()), ("lane", pa.int32()), ("tile", pa.int32()), ("cycle", pa.int32())])


def locs_bytes(clusters: int) -> bytes:
    """A plain location file that gives cluster n the place of :func:`fixtures.with_position`."""
    n = np.arange(clusters)
    return b"\0" * 12 + np.stack([n % 1000, n // 1000], axis=1).astype("<f4").tobytes()


def clocs_bytes(clusters: int) -> bytes:
    """A compressed location file of so many clusters: 200 a bin, each at an offset of its own number."""
    out = [struct.pack("<bi", 1, -(-clusters // 200))]
    for at in range(0, clusters, 200):
        n = np.arange(at, min(at + 200, clusters))
        out.append(bytes([len(n)]) + np.stack([n % 200, n // 200 % 250], axis=1).astype(np.uint8).tobytes())
    return b"".join(out)


def run_files(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """The cycle and filter files of the run below ``root``, stored; nothing is written there yet."""
    df = fx.calls(fx.with_position(fx.clusters(spark, sf_dir)))
    return materialize(_tile_files(cycle_blocks(df, BLOCK), f"{root}/{BASE}"), "run-files")


def write_head(
    spark: SparkSession, sf_dir: str, root: str, reads: tuple[tuple[int, str], ...] = ((36, "N"), (8, "Y"), (36, "N")), **options: str
) -> Options:
    """Manifest, sample sheet and locations of the run; the options that read it, with ``options`` on top."""
    shape = fx.clusters(spark, sf_dir).agg(F.max("lane").alias("lanes"), F.max(F.col("tile") % 100).alias("tiles"), F.max(F.expr("cid div 8")).alias("last")).first()
    lanes, tiles, last = (shape[c] or 0 for c in ("lanes", "tiles", "last"))
    listed = "".join(f'<Read Number="{i + 1}" NumCycles="{n}" IsIndexedRead="{x}" />' for i, (n, x) in enumerate(reads))
    manifest = (
        f'<RunInfo><Run Id="x" Number="{fx.RUN}"><Flowcell>{fx.FLOWCELL}</Flowcell><Instrument>{fx.INSTRUMENT}</Instrument><Reads>{listed}</Reads>'
        f'<FlowcellLayout LaneCount="{lanes}" SurfaceCount="1" SwathCount="1" TileCount="{tiles}" /></Run></RunInfo>'
    )
    # A sheet has one line a barcode.
    rows = fx.sheet(spark, sf_dir).orderBy("lane", "idx").collect()
    second = any(x == "Y" for _, x in reads[2:])
    lines = [f"{r['lane']},{r['sample']},,,,,{r['idx'][:4] if second else r['idx']}" + (f",{r['idx'][4:]}" if second else "") for r in rows]
    sheet = "[Header]\nx,1\n\n[Data]\nLane,Sample_ID,Sample_Name,Plate,Well,I7,index" + ",index2" * second + "\n" + "\n".join(lines) + "\n"
    files = [("RunInfo.xml", manifest.encode()), ("SampleSheet.csv", sheet.encode()), ("Data/Intensities/s.locs", locs_bytes(last + 1)), ("Data/Intensities/s.clocs", clocs_bytes(last + 1))]
    write_files(spark.createDataFrame([(f"{root}/{name}", bytearray(content)) for name, content in files], "path string, content binary"))
    return Options.from_dict({"bcl_input_dir": root, "cram_output_dir": f"{root}-out", "reference": "-", "flink_tmp_dir": root, "block_size": str(BLOCK)}, options)


def run_folder(spark: SparkSession, sf_dir: str, **more: object) -> Options:
    """A whole run folder; the options that read it. ``more`` goes to :func:`write_head`."""
    root = scratch_path(spark, "run")
    write_files(run_files(spark, sf_dir, root))
    return write_head(spark, sf_dir, root, **more)


def control_files(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """(path, content) of a control file for each tile: cluster k of tile t has (7 k + t) mod 97."""
    sizes = fx.clusters(spark, sf_dir).groupBy("lane", "tile").agg((F.max(F.expr("cid div 8")) + 1).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values = ((np.arange(r["n"]) * 7 + r["tile"]) % 97).astype("<i2")
                path = f"{root}/{BASE}/L{r['lane']:03d}/s_{r['lane']}_{r['tile']}.control"
                yield pa.RecordBatch.from_pylist([{"path": path, "content": struct.pack("<III", 0, 2, r["n"]) + values.tobytes()}])

    return sizes.mapInArrow(run, "path string, content binary")
