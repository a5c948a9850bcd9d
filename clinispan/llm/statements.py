"""What DuckDB gives for the queries on vectors and manifests, by plain means."""

from __future__ import annotations

#: op11: every pair of vectors, and what links reach.
OP11 = """
with recursive e as (select vec_id, cast(embedding as double[]) as v from embeddings),
good as (select vec_id, v, len(v) as n, row_number() over () as r from e where vec_id is not null and v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
unit as (select vec_id, r, n, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from good),
links as (select a.vec_id as a, b.vec_id as b from unit a join unit b on a.n = b.n and a.r <> b.r where list_inner_product(a.u, b.u) >= 0.9),
reach(a, b) as (select vec_id, vec_id from good union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as component_id from reach group by a),
degree as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(d.n, 0) as n_links, coalesce(l.component_id, e.vec_id) as component_id, coalesce(l.component_id, e.vec_id) is not distinct from e.vec_id as kept
from e left join degree d on d.a = e.vec_id left join least l on l.a = e.vec_id
"""


def op12(k: int = 40, rounds: int = 5) -> str:
    """op12: each round compares all vectors with all centroids."""
    ctes = ["q as (select vec_id, list_transform(cast(embedding as double[]), lambda x: cast(floor(256 * x) as bigint)) as v from embeddings where len(embedding) = 64 and len(list_filter(cast(embedding as double[]), lambda x: x is null or not isfinite(x))) = 0)",
            f"c0 as (select row_number() over (order by h) - 1 as c, v from (select sha256('2:' || vec_id) as h, v from q order by h limit {k}))"]

    def assign(i: int) -> str:
        return f"a{i} as (select vec_id, any_value(v) as v, min(struct_pack(d := d, c := c)) as best from (select q.vec_id, q.v, c.c, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from q, c{i} c) group by vec_id)"

    for i in range(rounds):
        ctes.append(assign(i))
        ctes.append(f"m{i} as (select c, list(m order by j) as v from (select best.c as c, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as m from (select best, unnest(v) as x, generate_subscripts(v, 1) as j from a{i}) group by best.c, j) group by c)")
        ctes.append(f"c{i+1} as (select c.c, coalesce(m.v, c.v) as v from c{i} c left join m{i} m using (c))")
    ctes.append(assign(rounds))
    return "with " + ",\n".join(x.replace(" as (", " as materialized (", 1) for x in ctes) + f"""
select vec_id, cast(best.c as integer) as cluster, best.d as distance, cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia, cast(sum(best.d) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.c = a.best.c"""


def _leaf(n: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(cast({x} as varchar)) || ':' || {x}, '-')" for x in ("doc_id", "source", "lang", n, "text")) + ")"


#: CRC-32 of doc_id in decimal, by the table crc_table of its 256 steps.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda i: ascii(cast(doc_id as varchar)[i])::bigint)), lambda s, b: xor(s >> 8, crc_table[1 + (xor(s, b) & 255)])), 4294967295::bigint)"

#: op13: levels by recursion, and each leaf's way up, first in its group's tree, then in the tree over the groups.
OP13 = f"""
with recursive bits(k, x, i) as (select k, k, 0 from range(256) t(k) union all select k, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, i + 1 from bits where i < 8),
crcs as (select list(x order by k) as crc_table from bits where i = 8),
leaves as (select doc_id, lang, {_leaf('n_chars')} as leaf, case when {_CRC} % 7 = 0 then {_leaf('(n_chars + 1)')} else {_leaf('n_chars')} end as altered from documents, crcs),
placed as (select *, dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from leaves),
up(tree, level, i, n, digest) as (select tree, 0, i, n, leaf from placed union all select tree, level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' order by i)) from up where n > 1 group by tree, level, i // 2),
subroots as (select tree, level as height, digest from up where n = 1),
top(level, i, n, digest) as (select 0, tree, count(*) over (), digest from subroots union all select level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' order by i)) from top where n > 1 group by level, i // 2),
nodes as (select tree, level, i, digest from up union all select -1, level, i, digest from top),
fold(doc_id, leaf, tree, height, level, i, own, proof) as (
  select doc_id, leaf, p.tree, height, 0, i, altered, '' from placed p join subroots s on s.tree = p.tree
  union all
  select f.doc_id, f.leaf, f.tree, f.height, f.level + 1, case when f.level + 1 = f.height then f.tree else f.i // 2 end, sha256(case when f.i % 2 = 1 then coalesce(s.digest, '') || f.own else f.own || coalesce(s.digest, '') end), f.proof || coalesce(s.digest, '')
  from fold f left join nodes s on s.tree = f.tree and s.level = f.level and s.i = xor(f.i, 1) where f.level < f.height),
crest(doc_id, leaf, tree, level, i, own, proof) as (
  select doc_id, leaf, tree, 0, tree, own, proof from fold where level = height
  union all
  select f.doc_id, f.leaf, f.tree, f.level + 1, f.i // 2, sha256(case when f.i % 2 = 1 then coalesce(s.digest, '') || f.own else f.own || coalesce(s.digest, '') end), f.proof || coalesce(s.digest, '')
  from crest f left join nodes s on s.tree = -1 and s.level = f.level and s.i = xor(f.i, 1) where f.level < (select max(level) from top)),
root as (select digest as root, level from top where n = 1)
select doc_id, leaf, s.digest as subroot, root, sha256(proof) as proof_sha256, own as folded_root, own = root as verified
from crest c join root on c.level = root.level join subroots s using (tree)
"""
