"""DuckDB SQL with the same rows as the queries that SQL can express: plain brute force over whole tables."""

from __future__ import annotations

#: op2: digests by SHA-1 in base 32, five bits at a time; the largest page of a digest is the response.
WARC_REVISITS = """
with d as (
  select page_id, url, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') as bits from pages
), k as (
  select page_id, url, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + list_sum(list_transform(range(5), lambda j: cast(substr(bits, 5 * i + j + 1, 1) as int) * (cast(16 as bigint) >> j))) as bigint), 1)), '') as payload_digest from d
)
select * exclude (last), case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to from (select *, max(page_id) over (partition by payload_digest) as last from k)
"""

#: op3: all pairs in double precision; components by a recursive query.
VECTOR_LINKS = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null
), u as (
  select vec_id, e from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda x: x * x)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95
), r as (
  select vec_id as node, vec_id as seen from embeddings union select r.node, l.b from r join l on l.a = r.seen
), c as (select node, min(seen) as component_id from r group by 1)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, component_id, e.vec_id = component_id as kept from embeddings e join c on c.node = e.vec_id
"""

#: op9: every query against every other row.
TOP_K = """
with v as materialized (
  select row_number() over () as n, vec_id, list_transform(cast(embedding as double[]), lambda x: cast(floor(x * 256) as bigint)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.n as q, q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v on q.vec_id % 50 = 0 and v.n <> q.n and len(q.e) = len(v.e)
)
select query_id, cast(r as integer) as rank, vec_id, score from (select *, row_number() over (partition by q order by score desc, vec_id) as r from s) where r <= 5
"""

#: op8: rules, links in the html, and components by a recursive query. Links that are relative to a folder, which the
#: tables don't have, are resolved by the operator alone.
_HOST = "translate(regexp_extract({0}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({0}, '://[^/?#]*([^?#]*)', 1)"
_RESOURCE = "case when contains({0}, '://') then translate(split_part({0}, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || " + _HOST + " || regexp_extract({0}, '://[^/?#]*([^#]*)', 1) end"


def _fits(host: str, rule_host: str, rule_path: str) -> str:
    return f"({host} = '{rule_host}' or ends_with({host}, '.{rule_host}')) and starts_with(path, '{rule_path}')"


_RULE = "case when {0} then 'example.net/en/' when {1} then 'example.com/de/' when {2} then 'org/fr/' when {3} then 'net/' end".format(*(_fits("host", h, p) for h, p in (("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/"), ("net", "/"))))

URL_RULES = f"""
with recursive p as (
  select page_id, coalesce({_HOST.format('url')}, '') as host, coalesce({_PATH.format('url')}, '') as path, {_RESOURCE.format('url')} as resource, html from pages
), tags as (select resource, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) as t from p where resource is not null
), hrefs as (
  select resource, regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) as h from tags where regexp_matches(t, '(?is)^<link\\b.*\\brel\\s*=\\s*["'']?[^"''>]*\\bcanonical\\b')
  union all select resource, regexp_extract(t, '(?is)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>;]+)', 1) from tags where regexp_matches(t, '(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')
), links as (
  select resource as a, case when contains(h, '://') then h when starts_with(h, '//') then split_part(resource, '://', 1) || ':' || h when starts_with(h, '/') then regexp_extract(resource, '^([^:]*://[^/?#]*)', 1) || h end as h from hrefs
), e as (select a, {_RESOURCE.format('h')} as b from links where h is not null
), ways as (select a, b from e union all select b, a from e
), r as (select a as node, a as seen from ways union select r.node, ways.b from r join ways on ways.a = r.seen
), c as (select node, min(seen) as component from r group by 1
), rated as (select component, {_RULE} as rule from (select component, {_HOST.format('node')} as host, {_PATH.format('node')} as path from c)
), fate as (select component, case when bool_or(rule in ('example.net/en/', 'org/fr/')) then 'allow' else 'block' end as inherited from rated where rule is not null group by 1
), judged as (select page_id, host, path, resource, {_RULE} as rule from p)
select page_id, host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' else coalesce(inherited, 'allow') end as verdict, j.resource
from judged j left join c on c.node = j.resource left join fate f on f.component = c.component
"""

#: op10: links of all pairs that share a shingle.
SHINGLES = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), s as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ') || '|' || len(w)] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as g from w
), n as (select doc_id, count(*) as n from s group by 1
), p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all
), l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)
), e as (select a, b from l union all select b, a from l
), r as (select doc_id as node, doc_id as seen from documents union select r.node, e.b from r join e on e.a = r.seen
), c as (select node, min(seen) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id from documents d join c on c.node = d.doc_id left join n on n.doc_id = d.doc_id
"""

#: op11: ten rounds and the last assignment, one after the other.
_FAR = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _lloyd(rounds: int) -> str:
    ctes = [
        """v as materialized (select vec_id, list_transform(cast(embedding as double[]), lambda x: cast(floor(x * 1024) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "c0 as materialized (select cast(row_number() over (order by sha256('3:' || vec_id)) - 1 as integer) as j, v as c from v qualify j < 8)",
    ]
    for k in range(rounds + 1):
        ctes.append(f"a{k} as materialized (select vec_id, v, (f).j as j, cast((f).d as bigint) as d from (select vec_id, any_value(v) as v, min({{'d': {_FAR}, 'j': j}}) as f from v cross join c{k} group by vec_id))")
        if k < rounds:
            ctes.append(
                f"""c{k + 1} as materialized (select c{k}.j, coalesce(m.c, c{k}.c) as c from c{k} left join (select j, list(cast((s - ((s % n) + n) % n) // n as bigint) order by d) as c from
  (select j, d, sum(x) as s, count(*) as n from (select j, unnest(v) as x, unnest(range(64)) as d from a{k}) group by j, d) group by j) m on m.j = c{k}.j)"""
            )
    return "with " + ",\n".join(ctes) + f"""
select vec_id, a.j as cluster, d as distance, cast(sum(d) over (partition by a.j) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.j = a.j"""


CENTROIDS = _lloyd(10)

#: op13: the levels one after the other (16^6 leaves a source and as many sources; more would need more levels). A node that
#: is its tree's only one stays as it is on all further levels.
_FIELD = "case when {0} is null then '-' else strlen(cast({0} as varchar)) || ':' || cast({0} as varchar) end"
_CRC = "xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda a, b: list_reduce(list_prepend(xor(a, b), [cast(0 as bigint) for _ in range(8)]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)))"


def _merkle(depth: int) -> str:
    leaf = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"
    ctes = [
        f"""d as materialized (select doc_id, source, {leaf.format(_FIELD.format("text"))} as leaf, case when doc_id is not null and {_CRC} % 5 = 0 then {leaf.format(_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))} end as seen from documents)""",
        "t as materialized (select source, row_number() over (order by source nulls first) - 1 as tree from (select distinct source from d))",
        """p0 as materialized (select doc_id, leaf, t.tree, row_number() over (partition by t.tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by t.tree) as size, leaf as own, coalesce(seen, leaf) as cur, '' as proof from d join t on t.source is not distinct from d.source)""",
    ]

    def climb(p: str, n: int) -> str:
        ctes.append(f"r{n} as materialized (select tree, pos // 16 as run, list(own order by pos) as ds from (select distinct tree, pos, own from {p} where size > 1) group by all)")
        before, after = "array_to_string(ds[:pos % 16], '')", "array_to_string(ds[pos % 16 + 2:], '')"
        ctes.append(
            f"""p{n + 1} as materialized (select doc_id, leaf, p.tree, case when size > 1 then pos // 16 else pos end as pos, case when size > 1 then (size + 15) // 16 else size end as size,
  case when size > 1 then sha256(array_to_string(ds, '')) else own end as own, case when size > 1 then sha256({before} || cur || {after}) else cur end as cur, case when size > 1 then proof || {before} || {after} else proof end as proof{", subroot" if n >= depth else ""}
  from {p} p left join r{n} r on p.size > 1 and r.tree = p.tree and r.run = p.pos // 16)"""
        )
        return f"p{n + 1}"

    p = "p0"
    for n in range(depth):
        p = climb(p, n)
    ctes.append(f"p{depth}x as materialized (select * exclude (tree, pos, size), 0 as tree, tree as pos, (select count(*) from t) as size, own as subroot from {p})")
    p = f"p{depth}x"
    for n in range(depth, 2 * depth):
        p = climb(p, n)
    return "with " + ",\n".join(ctes) + f"\nselect doc_id, leaf, subroot, own as root, sha256(proof) as proof_sha256, cur as folded_root, cur = own as verified from {p}"


MERKLE = _merkle(6)
