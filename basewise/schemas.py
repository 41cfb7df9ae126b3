"""Explicit schemas of every table that crosses a module boundary."""

# A run manifest read from its XML file. Attributes keep the reader's "_" mark.
RUN_XML = (
    "_Number string, Instrument string, Flowcell string, "
    "Reads struct<Read: array<struct<_NumCycles: int, _IsIndexedRead: string>>>, "
    "FlowcellLayout struct<_LaneCount: int, _SurfaceCount: int, "
    "_SwathCount: int, _TileCount: int>"
)

# One block of one cycle file: bytes[i] is the call of cluster block*block_size+i.
CALL_BLOCKS = "lane int, tile int, cycle int, block int, bytes binary"
FILTER_BLOCKS = "lane int, tile int, block int, bytes binary"
# Positions of one block, packed as little-endian int32 pairs (x, y).
LOCS_BLOCKS = "block int, xy binary"

PAIRS = "name string, b1 string, q1 string, b2 string, q2 string, sample string"

SAM = (
    "name string, flag int, rname string, pos int, mapq int, "
    "cigar array<struct<len: int, op: string>>, rnext string, pnext int, tlen int, "
    "seq string, qual string, tags map<string, string>, sample string, "
    "read_no int, ref_idx int, pos_end int"
)

TOC = "key int, id int, sample string"
CONTIGS = "ref_idx int, contig string, seq string"
