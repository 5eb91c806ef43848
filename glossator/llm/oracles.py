"""DuckDB SQL of corpus operators that SQL expresses, by plainer ways than the operators take."""

from __future__ import annotations

MIXING = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
        cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h from documents),
    s as (select source, cast(sum(size) as bigint) as source_size, count(*) as n_rows, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from d group by source),
    c as (select *, source_size * 3.0::double as cap, source_size * 3.0::double / weight as level from s),
    m as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by level, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
        / sum(weight) over (order by level, source nulls last rows between current row and unbounded following) as mu from c),
    t as (select *, least(cap, weight * coalesce((select arg_min(mu, level) from m where mu <= level), 'inf'::double)) as target from m),
    b as (select *, greatest(1, least(1024, floor((select min(target) from t where target > 0) / 1000)))::bigint as block,
        greatest(1, ceil(source_size / 4194304), ceil(n_rows / 65536))::bigint as shards from t),
    seats as (select cast(floor(sum(target) / max(block) + 0.5) as bigint) as n from b),
    sq as (select source, count(*) as quota from (select source, target / (2 * k + 1) as q from (select source, target, unnest(range(0, (select n from seats))) as k from b)
        qualify row_number() over (order by q desc, source nulls last) <= (select n from seats)) group by source),
    r as (select d.*, b.source_size, b.target, b.block, (h // 32) % shards as shard from d join b on d.source is not distinct from b.source),
    sh as (select source, shard, any_value(block) as block, cast(sum(size) as bigint) as shard_size from r group by source, shard),
    hq as (select source, shard, count(*) as quota from (select source, shard, seats, shard_size / (2 * k + 1) as q from
            (select sh.*, sq.quota as seats, unnest(range(0, sq.quota)) as k from sh join sq on sh.source is not distinct from sq.source)
        qualify row_number() over (partition by source order by q desc, shard) <= seats) group by source, shard),
    p as (select sh.source, sh.shard, sh.block, ceil(sh.shard_size / sh.block)::bigint as n, least(coalesce(quota, 0), 3 * ceil(sh.shard_size / sh.block)::bigint) as quota,
        cast('0x' || substr(md5('17:' || coalesce(sh.source, '') || ':' || sh.shard), 1, 15) as bigint) as hs from sh left join hq on sh.source is not distinct from hq.source and sh.shard = hq.shard),
    o as (select r.doc_id, r.size, r.source_size, r.target, r.block, n, quota, case when n > 0 then hs % n else 0 end as o, case when n > 0 then quota // n else 0 end as repeats,
        case when n > 0 then quota % n else 0 end as extra, sum(size) over (partition by r.source, r.shard order by h, doc_id, size rows unbounded preceding) as z
        from r join p on r.source is not distinct from p.source and r.shard = p.shard)
select doc_id, cast(size as bigint) as size, source_size, target, cast(repeats * size
    + greatest(0, least(z, greatest(o + extra - n, 0) * block) - (z - size))
    + greatest(0, least(z, least(o + extra, n) * block) - greatest(z - size, o * block)) as bigint) as taken from o
"""

NEAR_DEDUP = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
    s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as x from w),
    n as (select doc_id, count(*) as n from s group by doc_id),
    j as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
    e as (select a, b from j join n x on j.a = x.doc_id join n y on j.b = y.doc_id where 100 * m >= 85 * (x.n + y.n - m)),
    sym as (select a, b from e union all select b, a from e),
    reach as (select doc_id as a, doc_id as b from documents union select r.a, sym.b from reach r join sym on r.b = sym.a),
    c as (select a, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from documents d join c on d.doc_id = c.a left join n on d.doc_id = n.doc_id
"""

NEAREST = """
with v as (select vec_id, cast(embedding as double[]) as v from embeddings where embedding is not null),
    s as (select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.v, c.v) as score from v q join v c on q.vec_id != c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(row_number() over w as integer) as rank, vec_id, score from s window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 5
"""
