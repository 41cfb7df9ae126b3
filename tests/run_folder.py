"""Writes run folders from cluster rows, for round trips through the readers."""

from __future__ import annotations

import gzip
import os
import struct

import numpy as np

MANIFEST = """<?xml version="1.0"?>
<RunInfo Version="2">
  <Run Id="test" Number="{number}">
    <Flowcell>{flowcell}</Flowcell>
    <Instrument>{instrument}</Instrument>
    <Reads>
{reads}
    </Reads>
    <FlowcellLayout LaneCount="{lanes}" SurfaceCount="1" SwathCount="1" TileCount="{tiles}" />
  </Run>
</RunInfo>
"""


def write_manifest(root, reads, lanes, tiles, instrument="BW01", number="7", flowcell="FCX1"):
    rows = "\n".join(
        f'      <Read Number="{i + 1}" NumCycles="{n}" IsIndexedRead="{"Y" if index else "N"}" />'
        for i, (n, index) in enumerate(reads)
    )
    with open(os.path.join(root, "RunInfo.xml"), "w") as f:
        f.write(MANIFEST.format(reads=rows, lanes=lanes, tiles=tiles, instrument=instrument, number=number, flowcell=flowcell))


def write_sheet(root, rows):
    with open(os.path.join(root, "SampleSheet.csv"), "w") as f:
        f.write("[Header]\nIEMFileVersion,4\n\n[Data]\n")
        f.write("Lane,Sample_ID,Sample_Name,Plate,Well,I7,index\n")
        f.writelines(f"{lane},{sample},x,,,,{idx}\n" for lane, sample, idx in rows)


def write_tile(base, lane, tile, calls: np.ndarray, passed: np.ndarray, skip_cycles=()):
    """``calls`` is (clusters, cycles) uint8."""
    folder = os.path.join(base, f"L{lane:03d}")
    os.makedirs(folder, exist_ok=True)
    for cycle in range(1, calls.shape[1] + 1):
        if cycle in skip_cycles:
            continue
        where = os.path.join(folder, f"C{cycle}.1")
        os.makedirs(where, exist_ok=True)
        with gzip.open(os.path.join(where, f"s_{lane}_{tile}.bcl.gz"), "wb") as f:
            f.write(struct.pack("<I", len(calls)) + calls[:, cycle - 1].tobytes())
    with open(os.path.join(folder, f"s_{lane}_{tile}.filter"), "wb") as f:
        f.write(struct.pack("<III", 0, 3, len(calls)) + passed.astype(np.uint8).tobytes())


def write_locs(path, xy: np.ndarray):
    with open(path, "wb") as f:
        f.write(b"\0" * 12 + xy.astype("<f4").tobytes())
