"""SQL twins of the queries, for DuckDB."""

from worktide.llm import quality, secrets, urls

LOWER = f"translate({{0}}, '{urls.UPPER}', '{urls.LOWER}')"

_BLOCKED = "|".join(
    r.pattern.strip("^").replace("^", "[^a-z0-9]") + ("([^a-z0-9]|$)" if r.pattern.endswith("^") else "")
    for r in urls.DEFAULT_RULES
    if r.verdict == "block"
)
_ALLOWED = "|".join(
    r.pattern.strip("^").replace("^", "[^a-z0-9]") + "([^a-z0-9]|$)"
    for r in urls.DEFAULT_RULES
    if r.verdict == "allow"
)

URL_FILTERS = f"""
with u as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages
), p as (
  select page_id, url, {LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")} as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from u
), r as (
  select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/'
  end as rule
  from p
)
select page_id, host, path, rule, case
  when rule in ('net/', 'example.com/de/') then 'block'
  when rule is not null then 'allow'
  when url is null then 'allow'
  when regexp_matches({LOWER.format("url")}, '[^a-z0-9]({_ALLOWED})') then 'allow'
  when regexp_matches({LOWER.format("url")}, '[^a-z0-9]({_BLOCKED})') then 'block'
  else 'allow' end as verdict
from r
"""

_WORD3 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{_WORD3}') as w
  from documents
), i as (
  select item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{_WORD3}') as w
  from benchmark where item_id is not null
), patterns as (
  select distinct item_id, least(13, len(w)) as n,
    unnest(list_transform(range(0, len(w) - least(13, len(w)) + 1), lambda k: list_slice(w, k + 1, k + least(13, len(w))))) as p
  from i where len(w) > 0
), sizes as (select distinct n from patterns),
places as (
  select r, n, unnest(range(0, len(w) - n + 1)) as k from d, sizes where len(w) >= n
), found as (
  select places.r, places.k, places.n, item_id
  from places join d on d.r = places.r
  join patterns on patterns.n = places.n and patterns.p = list_slice(d.w, k + 1, k + places.n)
), hits as (select r, count(distinct j) as n_hit from (select r, unnest(range(k, k + n)) as j from found) group by r),
items as (
  select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
  from found group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hits using (r) left join items using (r)
"""


def _found(pattern: str, kind: int, keep: str = "true") -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  select r, s.start as start, {kind} as kind, s.start + length(s.m) as stop, s.m as m from (
    select r, unnest(list_transform(range(1, len(m) + 1), lambda k: {{'m': m[k], 'start':
      coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0)}})) as s
    from (
      select r, regexp_extract_all(t, '{quoted}') as m, string_split_regex(t, '{quoted}') as gaps
      from d where regexp_matches(t, '{quoted}')
    )
  ) where {keep}"""


_ASSIGN = secrets.ASSIGN.replace("'", "''")
_W = secrets.WINDOW
_TERMS = "[" + ",".join(map(str, secrets.TERMS)) + "]"
_LIMIT = "case " + " ".join(
    f"when regexp_matches(m, '{k.pattern}') then {-1 if k.bits == float('inf') else k.limit}" for k in secrets.CLASSES
) + " end"
_NAMES = "[" + ",".join(f"'{k}'" for k in secrets.KINDS) + "]"

SECRETS = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
base as ({_found(secrets.ASSIGN, 0, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= {secrets.ASSIGN_VALUE}")}
  union all {_found(secrets.ACCESS, 1)} union all {_found(secrets.HEX, 2)}
), candidates as (
  select r, start, m, {_LIMIT} as lim from ({_found(secrets.CANDIDATE, 3)})
), windows as (
  select r, start, m, lim, unnest(range({_W}, length(m) + 1)) as i from candidates
  where lim >= 0 and not regexp_matches(lower(m), '{"|".join(secrets.ALLOWED)}')
), sums as (
  select r, start, i, lim, list_sum(list_transform(
    list_distinct(string_split(substr(m, i - {_W - 1}, {_W}), '')),
    lambda c: {_TERMS}[{_W} - length(replace(substr(m, i - {_W - 1}, {_W}), c, '')) + 1])) as total
  from windows
), entropy as (
  select r, start + min(i) - {_W} as start, 3 as kind, start + max(i) as stop
  from sums where total <= lim group by r, sums.start
), added as (
  select * from entropy e where not exists (
    select 1 from base b where b.r = e.r and b.start <= e.start and b.stop >= e.stop)
), every as (
  select r, start, kind, stop, true as fixed from base union all select r, start, kind, stop, false from added
), listed as (
  select r, count(*) filter (fixed and kind = 0) as a, count(*) filter (fixed and kind = 1) as k,
    count(*) filter (fixed and kind = 2) as h,
    string_agg(({_NAMES})[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop) filter (fixed) as base,
    string_agg(({_NAMES})[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop) as spans
  from every group by r
)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(k, 0)::bigint as n_access,
  coalesce(h, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join listed using (r)
"""

WARC = """
with p as (
  select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages
), g as (select h, max(page_id) as last, count(*) as n from p group by h),
b as (
  select page_id, body, h, last,
    array_to_string(list_transform(range(0, 8), lambda k:
      array_to_string(list_transform(range(0, 4), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          (('0x' || substr(h, 5 * k + 1, 5))::int // (32 ** (3 - j))::int) % 32 + 1, 1)), '')), '') as digest
  from p join g using (h)
)
select page_id, octet_length(encode(body))::bigint as payload_bytes, digest as payload_digest,
  case when page_id is distinct from last then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from last then last end as refers_to
from b
"""

_WORD10 = r"[^\x20\x09-\x0D]+"
_RULES = " or ".join("(" + r.format(m="m") + ")" for r in quality.RULES.values())
_BASE = " or ".join("(" + quality.RULES[r].format(m="m") + ")" for r in quality.BASE.rejects)

QUALITY = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '{_WORD10}') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD10}')) as lines
  from documents
), g as (
  select r, k, array_to_string(list_slice(w, k + 1, k + 8), ' ') as p
  from (select r, w, unnest(range(0, len(w) - 7)) as k from d where len(w) > 8)
), repeated as (
  select r, k from (select r, k, count(*) over (partition by r, p) as n from g) where n > 1
), covered as (
  select r, count(distinct j) as n from (select r, unnest(range(k, k + 8)) as j from repeated) group by r
), measured as (
  select doc_id, {{
    'n_words': len(w)::bigint,
    'word_chars': length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint,
    'n_symbols': length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint,
    'n_lines': len(lines)::bigint,
    'n_dup_lines': (len(lines) - len(list_distinct(lines)))::bigint,
    'n_repeat_words': coalesce(n, 0)::bigint,
    'n_upper': length(regexp_replace(t, '[^A-Z]+', '', 'g'))::bigint,
    'n_lower': length(regexp_replace(t, '[^a-z]+', '', 'g'))::bigint,
    'n_exclaim': length(regexp_replace(t, '[^!]+', '', 'g'))::bigint,
    'n_plain_words': len(list_filter(w, lambda x: regexp_matches(x, '[0-9A-Za-z]|[^\x00-\x7F]')))::bigint,
    'n_stutter': len(list_filter(list_zip(w, w[2:]), lambda x: x[1] = x[2]))::bigint
  }} as m
  from d left join covered using (r)
)
select doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words,
  ({_BASE}) as base_failed, not ({_RULES}) as kept
from measured
"""

HARD_NEGATIVES = """
with taking as (
  select row_number() over () as uid, vec_id,
         case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.uid as anchor_uid, a.vec_id as anchor_id, b.uid, b.vec_id, a.label = b.label as same,
         cast(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1),
           lambda i: a.v[i] * b.v[i])), 0) as bigint) as score
  from taking a join taking b on a.uid <> b.uid
  where a.vec_id % 100 = 0
), positive as (
  select * from scored where same
  qualify row_number() over (partition by anchor_uid order by score desc, vec_id, uid) <= 5
), negative as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score,
         n.score as negative_score,
         row_number() over (partition by p.anchor_uid, p.uid order by n.score desc, n.vec_id, n.uid) as rank
  from positive p join scored n
    on n.anchor_uid = p.anchor_uid and not n.same
   and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from negative where rank <= 5
"""
