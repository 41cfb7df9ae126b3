"""DuckDB texts for the registered queries.

Each text restates the semantics over the driver's tables in plain SQL: joins,
running windows and one row per base or call, where the Spark side uses byte blocks,
``translate`` and higher-order functions. Shared steps are named CTEs below;
:func:`oracle` adds those a query needs.
"""

from __future__ import annotations

import re

_HEX = "'0123456789abcdef','ACGTACGTACGTACGT'"

CTES: dict[str, str] = {
    "fx_contigs": f"""
select r_regionkey as ref_idx, r_name as contig,
  array_to_string(list_transform(range(0,64), lambda i: translate(md5((case when i % 16 in (7,8) then 'repeat' else r_name end)||'-'||i::varchar),{_HEX})),'') as seq
from region""",
    "fx_sheet": f"""
select cast(n_nationkey % 2 + 1 as int) as lane, concat('S', cast(n_nationkey % 15 as varchar(10))) as sample,
  translate(substr(md5(n_name),1,8),{_HEX}) as idx
from nation""",
    "fx_orders": """
select o_orderkey as cid, cast(o_orderkey % 2 + 1 as int) as lane,
  cast(1101 + (o_orderkey % 8 - o_orderkey % 2) / 2 as int) as tile,
  case when o_orderstatus = 'P' then 0 else 1 end as pf,
  cast((o_orderkey % 12) * 2 + o_orderkey % 2 as int) as nk, cast(o_custkey % 5 as int) as rk,
  cast((o_orderkey * 37) % 1900 + 1 as int) as pos1, cast(80 + o_orderkey % 40 as int) as tlen
from orders""",
    "fx_origin": f"""
select o.*, translate(substr(md5(n.n_name),1,8),{_HEX}) as tidx, k.contig as tcontig, k.seq
from fx_orders o join nation n on n.n_nationkey = o.nk join fx_contigs k on k.ref_idx = o.rk""",
    "fx_clusters": f"""
select cid, lane, tile, pf, tcontig, pos1, tlen, tidx,
  case when cid % 11 = 0 then translate(substr(md5(cast(cid as varchar(20))),1,8),{_HEX})
       when cid % 7 = 0 then concat('NN', substr(tidx,3,6))
       when cid % 5 = 0 then concat(substr(tidx,1,7),'N') else tidx end as idx_obs,
  case when cid % 13 = 0 then substr(translate(concat(md5(cast(cid as varchar(20))), md5(concat('x', cast(cid as varchar(20))))),{_HEX}),1,36)
       else substr(seq,pos1,36) end as r1,
  case when cid % 169 = 0 then substr(translate(concat(md5(concat('y', cast(cid as varchar(20)))), md5(concat('z', cast(cid as varchar(20))))),{_HEX}),1,36)
       when cid % 17 = 0 then concat(substr(m2,1,17), translate(substr(m2,18,2),'ACGT','CATG'), substr(m2,20,17))
       else m2 end as r2
from (select fx_origin.*, reverse(translate(substr(seq,pos1+tlen-36,36),'ACGT','TGCA')) as m2 from fx_origin)""",
    "fx_cycles": "select f.*, unnest(range(1,81)) as cyc from fx_clusters f where pf = 1",
    "fx_bytes": """
select cid, cast(cyc as int) as cyc,
  case when ch = 'N' or (cid*7 + cyc*13) % 41 = 0 then 0
       else cast(4*((cid*7 + cyc*13) % 41) + instr('ACGT', ch) - 1 as int) end as b
from (select *, substr(concat(r1, idx_obs, r2), cast(cyc as int), 1) as ch from fx_cycles)""",
    # One row per call, decoded by rule: base bits, quality bits, no-call where the quality is 0.
    "call": """
select cid, cyc, b, case when cyc <= 36 then 1 when cyc <= 44 then 0 else 2 end as part,
  case when b // 4 = 0 then 'N' else substr('ACGT', b % 4 + 1, 1) end as base,
  case when b // 4 = 0 then '#' else chr(33 + b // 4) end as qual
from fx_bytes""",
    "part": """
select cid, part, string_agg(base, '' order by cyc) as bases, string_agg(qual, '' order by cyc) as quals,
  string_agg(substr('ACGT', b % 4 + 1, 1), '' order by cyc) as plain_bases,
  string_agg(chr(33 + b // 4), '' order by cyc) as plain_quals,
  string_agg(lpad(upper(to_hex(b)), 2, '0'), '' order by cyc) as raw
from call group by cid, part""",
    "decoded": """
select cid,
  max(bases) filter (part = 1) as b1, max(quals) filter (part = 1) as q1,
  max(bases) filter (part = 0) as idx, max(bases) filter (part = 2) as b2, max(quals) filter (part = 2) as q2
from part group by cid""",
    "named": """
select c.cid, c.lane, c.tile, c.cid // 8 as cluster, d.idx, d.b1, d.q1, d.b2, d.q2, c.tidx,
  concat('BW01:7:FCX1:', c.lane, ':', c.tile, ':', (c.cid // 8) % 1000 * 10 + 1000, ':', (c.cid // 8000) * 10 + 1000) as name
from fx_clusters c join decoded d using (cid)""",
    "seen": "select distinct lane, idx from named",
    "near": """
select o.lane, o.idx, s.idx as best_idx, s.sample, hamming(o.idx, s.idx) as distance
from seen o join fx_sheet s on s.lane = o.lane
where hamming(o.idx, s.idx) <= 1""",
    "nearest": """
select lane, idx, best_idx, sample, distance,
  count(*) over (partition by lane, idx, distance) as ties,
  row_number() over (partition by lane, idx order by distance, best_idx) as rk
from near qualify rk = 1""",
    "pairs": """
select n.*, coalesce(m.sample, 'Undetermined') as sample
from named n left join nearest m on m.lane = n.lane and m.idx = n.idx""",
    "toc": """
select cast(row_number() over (order by sample) - 1 as int) as id, sample
from (select distinct sample from fx_sheet union select 'Undetermined')""",
    "reads": """
select name, sample, 1 as read_no, b1 as seq, q1 as qual from pairs
union all select name, sample, 2, b2, q2 from pairs""",
    # --- mapping: every word against every word, votes by counting, all candidates scored
    "oriented": """
select seq, '+' as strand, seq as o from (select distinct seq from reads)
union all select seq, '-', reverse(translate(seq,'ACGT','TGCA')) from (select distinct seq from reads)""",
    "rword": """
select seq, strand, o, i, substr(o, i::int, 12) as w
from (select *, unnest(range(1, length(o) - 10)) as i from oriented)""",
    "cword": """
select ref_idx, contig, p, substr(seq, p::int, 12) as w, length(seq) as clen
from (select *, unnest(range(1, length(seq) - 10)) as p from fx_contigs)""",
    "cand": """
select r.seq, r.strand, r.o, c.ref_idx, cast(c.p - r.i + 1 as int) as pos, count(*) as votes
from rword r join cword c on c.w = r.w
where not contains(r.w, 'N') and c.p - r.i + 1 >= 1 and c.p - r.i + length(r.o) <= c.clen
group by all""",
    "scored": """
select *, length(seq) - 5 * nm as score from (
  select cand.*, hamming(o, substr(k.seq, pos, length(o))::varchar) as nm
  from cand join fx_contigs k using (ref_idx))""",
    "ordered": """
select *, row_number() over w as rk, lead(score) over w as s2 from scored
window w as (partition by seq order by score desc, votes desc, ref_idx, pos, strand)""",
    "best": """
select seq, ref_idx, pos, strand, cast(nm as int) as nm, cast(votes as int) as votes, cast(score as int) as score,
  cast(case when s2 is null then 60 when score <= 0 then 0
       else least(60, greatest(0, 60 * (score - s2) // score)) end as int) as mapq
from ordered where rk = 1 and score >= 10""",
    "mapped": """
select r.name, r.sample, r.read_no, r.seq, r.qual, b.ref_idx, b.pos, b.strand, b.nm, b.votes, b.score,
  coalesce(b.mapq, 0) as mapq, b.pos + length(r.seq) - 1 as pos_end
from reads r left join best b using (seq)""",
    "mates": """
select a.*, m.ref_idx as m_ref, m.pos as m_pos, m.pos_end as m_end, m.strand as m_strand
from mapped a join mapped m on m.name = a.name and m.read_no = 3 - a.read_no""",
    "geometry": """
select *, coalesce(ref_idx = m_ref and strand <> m_strand and abs(tlen) <= 1000
    and (case when strand = '+' then pos <= m_pos else m_pos <= pos end), false) as proper
from (select *, cast(case when ref_idx = m_ref then
    (greatest(pos_end, m_end) - least(pos, m_pos) + 1)
    * (case when pos < m_pos or (pos = m_pos and read_no = 1) then 1 else -1 end) else 0 end as int) as tlen
  from mates)""",
    "sam": """
select g.name, g.sample, g.read_no,
  cast(1 + (case g.read_no when 1 then 64 else 128 end) + (case when g.ref_idx is null then 4 else
     (case when g.proper then 2 else 0 end) + (case when g.strand = '-' then 16 else 0 end)
     + (case when g.m_ref is null then 8 when g.m_strand = '-' then 32 else 0 end) end) as int) as flag,
  coalesce(k.contig, '*') as rname, cast(coalesce(g.pos, 0) as int) as pos, cast(g.mapq as int) as mapq,
  case when g.ref_idx is null then '' else concat(length(g.seq), 'M') end as cigar,
  case when g.ref_idx is null then '*' else coalesce(mk.contig, '*') end as rnext,
  cast(case when g.ref_idx is null then 0 else coalesce(g.m_pos, 0) end as int) as pnext, g.tlen,
  case when g.strand = '-' then reverse(translate(g.seq,'ACGT','TGCA')) else g.seq end as seq,
  case when g.strand = '-' then reverse(g.qual) else g.qual end as qual,
  g.nm, g.score, cast(coalesce(g.ref_idx, -1) as int) as ref_idx, cast(coalesce(g.pos_end, 0) as int) as pos_end
from geometry g left join fx_contigs k on k.ref_idx = g.ref_idx left join fx_contigs mk on mk.ref_idx = g.m_ref""",
    # --- containers
    "by_count": """
select *, cast((rn - 1) // 100 as bigint) as container_id, cast((rn - 1) % 100 + 1 as int) as rec_index
from (select *, row_number() over (partition by sample order by name, read_no) as rn from sam)""",
    "in_order": """
select *, row_number() over (partition by sample order by (ref_idx = -1), ref_idx, pos, name, read_no) as rn from sam""",
    # The sequential rule, record by record: n = 100, m = 10.
    "walk": """
select sample, rn, ref_idx as ctx, 1 as size, 0 as container_id from in_order where rn = 1
union all
select r.sample, r.rn,
  case when w.size >= 100 or (w.ctx <> -1 and r.ref_idx = -1) then r.ref_idx
       when w.ctx = -2 or w.ctx = r.ref_idx then w.ctx
       when w.size > 10 then r.ref_idx else -2 end,
  case when w.size >= 100 or (w.ctx <> -1 and r.ref_idx = -1) then 1
       when w.ctx = -2 or w.ctx = r.ref_idx then w.size + 1
       when w.size > 10 then 1 else w.size + 1 end,
  case when w.size >= 100 or (w.ctx <> -1 and r.ref_idx = -1) then w.container_id + 1
       when w.ctx = -2 or w.ctx = r.ref_idx then w.container_id
       when w.size > 10 then w.container_id + 1 else w.container_id end
from walk w join in_order r on r.sample = w.sample and r.rn = w.rn + 1""",
    "by_coord": """
select r.*, cast(w.container_id as bigint) as container_id, cast(w.size as int) as rec_index
from in_order r join walk w on w.sample = r.sample and w.rn = r.rn""",
    # --- per base of a mapped record
    "placed_base": """
select s.ref_idx, s.pos + i - 1 as pos, substr(s.seq, i::int, 1) as base, substr(k.seq, (s.pos + i - 1)::int, 1) as ref_base
from (select *, unnest(range(1, length(seq) + 1)) as i from sam where ref_idx >= 0) s join fx_contigs k using (ref_idx)""",
}

# CTEs used more than once in a text are computed once.
_MATERIALIZED = {"fx_clusters", "call", "part", "named", "pairs", "reads", "best", "mapped", "sam", "in_order", "by_coord", "by_count"}


def _needs(sql: str) -> set[str]:
    return {n for n in CTES if re.search(rf"\b{n}\b", sql)}


def oracle(sql: str) -> str:
    """``sql`` with the CTEs it uses, directly or through other CTEs, in order."""
    needed: set[str] = set()
    todo = _needs(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo |= _needs(CTES[name]) - needed
    if not needed:
        return sql
    parts = []
    for name, text in CTES.items():
        if name in needed:
            head = name + ("(sample, rn, ctx, size, container_id)" if name == "walk" else "")
            parts.append(f"{head} as {'materialized ' if name in _MATERIALIZED else ''}({text})")
    kind = "with recursive " if "walk" in needed else "with "
    body = sql.strip()
    # A text with CTEs of its own continues the list.
    rest = ",\n" + body[5:] if body.startswith("with ") else "\n" + body
    return kind + ",\n".join(parts) + rest
