"""DuckDB SQL with the rows of those training-data queries that SQL can express."""

from __future__ import annotations

from siltstone.llm.queries import DOMAINS, EPOCHS, MIN_SITES, RULES, SEED, SHARE, WEIGHTS

#: Words of a text, as the operators take them.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_TOP = """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10"""

_WINDOWS = rf"""with w as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w where len(w) >= 13)),
f as (select s, min(doc_id) as first from s group by 1),
hit as (select doc_id, i from s join f using (s) where first < doc_id),
gone as (select distinct doc_id, i + k as i from hit, range(0, 13) t(k)),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from w),
kept as (select words.doc_id, count(*) as n, string_agg(word, ' ' order by i) as t from words left join gone using (doc_id, i) where gone.i is null group by 1)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)"""

_WARC = """with p as (select page_id, coalesce(html, '') as h from pages),
k as (select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest, max(page_id) over (partition by h) as keep from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> keep then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> keep then keep end as refers_to from k"""

_SPREAD = f"""with c as (select doc_id, text, coalesce('s:' || source, 'n') as site, string_split(text, chr(10)) as cut from documents),
l as (select trim(unnest(cut), ' ') as line, text as copy, site from c),
b as (select list(line) as lines from (select line from l where line <> '' group by 1 having count(distinct copy) > 1 and count(distinct site) >= {MIN_SITES}))
select doc_id, coalesce(len(cut), 0) as n_lines, coalesce(len(cut) - len(kept), 0) as n_removed, sha256(array_to_string(kept, chr(10))) as kept_sha256
from (select *, list_filter(cut, lambda x: not list_contains(coalesce(lines, []), trim(x, ' '))) as kept from c cross join b)"""


def _weigh(level: str) -> str:
    own = WEIGHTS.get(level, {})
    return f"case {level} " + " ".join(f"when '{n}' then {w}" for n, w in own.items() if n != "*") + f" else {own.get('*', 1)} end"


def _pour(level: str, above: list[str], source: str, name: str) -> str:
    """The share of each child of its parent's budget, as nested windows."""
    keys = [*above, level]
    part = f"partition by {', '.join(above)}" if above else ""
    join = f"join {source} using ({', '.join(above)})" if above else f"cross join {source}"
    return f"""{name}0 as (select {', '.join(keys)}, sum(capacity) as capacity, {_weigh(level)} as weight from leaves group by {', '.join(keys)}),
{name}1 as (select *, greatest(budget - coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0), 0) as lft,
  sum(weight) over (w rows between current row and unbounded following) as beyond from {name}0 {join} window w as ({part} order by capacity / weight, {level})),
{name}2 as (select *, capacity * beyond <= lft * weight as filled from {name}1),
{name}3 as (select *, greatest(budget - coalesce(sum(case when filled then capacity end) over ({part}), 0), 0) as rest, case when filled then 0 else weight end as share from {name}2),
{name}4 as (select *, sum(share) over ({part}) as shares, sum(share) over ({part} order by capacity / weight, {level} rows unbounded preceding) as run from {name}3),
{name} as (select {', '.join(keys)}, cast(case when filled then capacity else rest * run // shares - rest * (run - share) // shares end as bigint) as budget from {name}4)"""


def mix_sql(share: float, epochs: int) -> str:
    """The mixture of a share of all tokens, every row at most so many times."""
    return rf"""with d as (select doc_id, lang, source, len({_WORDS}) as n_tokens,
  case when regexp_extract(source, '([0-9]+)$', 1) = '' then 'other' else 'domain' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % {DOMAINS}) end as domain from documents),
leaves as (select domain, lang, source, sum(n_tokens) as tokens, sum(n_tokens) * {epochs} as capacity from d group by 1, 2, 3),
top as (select cast(floor(sum(tokens) * {round(share * 100)} / 100) as bigint) as budget from leaves),
{_pour('domain', [], 'top', 'p')}, {_pour('lang', ['domain'], 'p', 'q')}, {_pour('source', ['domain', 'lang'], 'q', 'r')},
plan as (select domain, lang, source, case when tokens > 0 then budget // tokens else 0 end as whole, case when tokens > 0 then budget % tokens else 0 end as rest from leaves join r using (domain, lang, source)),
placed as (select *, md5('{SEED}:' || whole || ':' || doc_id) as place from d join plan using (domain, lang, source)),
run as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by place, doc_id rows between unbounded preceding and 1 preceding), 0) as before from placed)
select doc_id, domain, lang, source, n_tokens, cast(whole as bigint) as epochs, cast(greatest(0, least(n_tokens, rest - before)) as bigint) as partial from run"""

#: The article as the pages of the tables mark it; the operator itself reads any page.
_ARTICLE = r"""with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|<footer)', 1) as a from pages),
b as (select page_id, url, regexp_replace(regexp_replace(a, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') as b from a),
c as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39;?', chr(39), 'g'), '&nbsp;?', ' ', 'g'), '&amp;?', '&', 'g') as c from b),
d as (select page_id, url, trim(regexp_replace(c, '\s+', ' ', 'g')) as text from c)
select page_id, url, text, length(text) as n_chars from d"""

#: CRC-32: the table of its bytes, by its rule, and a string's value by that table.
_CRC = "crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, (c & 1) * 3988292384))) as t)"


def _crc(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: cast('0x' || h as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def _tree(name: str, nodes: str) -> str:
    """Levels of 3-ary trees over nodes (g, pos, n, d): name(g, lvl, pos, n, d), the leaves at level 0."""
    return f"""{name} as (select g, 0 as lvl, pos, n, d from {nodes}
  union all select g, lvl + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(d, '' order by pos)) from {name} where n > 1 group by g, lvl, pos // 3)"""


#: Rows are leaves of their source's tree, sources of the whole's; steps holds what stands left and right of a row's path.
_MERKLE = f"""with recursive {_CRC}, f as (select doc_id, coalesce('s' || source, '') as g, text, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head from documents),
h as (select doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as d, replace(text, chr(10), '') as cut, head from f),
leaves as (select *, row_number() over (partition by g order by doc_id) - 1 as pos, count(*) over (partition by g) as n from h),
{_tree("a", "leaves")},
tops as (select g as source, row_number() over (order by g) - 1 as pos, count(*) over () as n, d, '' as g from a where n = 1),
{_tree("b", "tops")},
depth as (select g, max(lvl) as top from a group by g),
path as (select doc_id, lvl, pos, any_value(left_) as left_, any_value(right_) as right_ from (
  select l.doc_id, x.lvl, x.pos, string_agg(y.d, '' order by y.pos) filter (y.pos < x.pos) as left_, string_agg(y.d, '' order by y.pos) filter (y.pos > x.pos) as right_
  from leaves l join a x on x.g = l.g and x.n > 1 and x.pos = l.pos // cast(pow(3, x.lvl) as bigint) join a y on y.g = x.g and y.lvl = x.lvl and y.pos // 3 = x.pos // 3 group by all
  union all select l.doc_id, depth.top + x.lvl, x.pos, string_agg(y.d, '' order by y.pos) filter (y.pos < x.pos), string_agg(y.d, '' order by y.pos) filter (y.pos > x.pos)
  from leaves l join depth using (g) join tops t on t.source = l.g join b x on x.n > 1 and x.pos = t.pos // cast(pow(3, x.lvl) as bigint) join b y on y.lvl = x.lvl and y.pos // 3 = x.pos // 3 group by all) group by all),
steps as materialized (select doc_id, lvl, coalesce(left_, '') as l, coalesce(right_, '') as r from path),
proofs as (select doc_id, sha256(coalesce(string_agg(l || r, '' order by lvl), '')) as proof_sha256, max(lvl) as last from leaves left join steps using (doc_id) group by doc_id),
fold as (select doc_id, 0 as lvl, case when {_crc('doc_id::varchar')} % 2 = 0 then sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) else d end as d from leaves cross join crc
  union all select doc_id, lvl + 1, sha256(l || d || r) from fold join steps using (doc_id, lvl)),
ends as (select doc_id, arg_max(d, lvl) as folded_root from fold group by doc_id),
whole as (select d as root from b where n = 1)
select l.doc_id, l.d as leaf, t.d as subroot, root, proof_sha256, folded_root, folded_root = root as verified
from leaves l join tops t on t.source = l.g cross join whole join proofs using (doc_id) join ends using (doc_id)"""

_URLS = """with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
rules(h, p, verdict) as (values """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + """),
m as (select page_id, host, path, h || p as rule, verdict, row_number() over (partition by page_id order by length(h || p) desc nulls last) as k
  from p left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where k = 1"""

_GAIN = r"""cast(floor(1000.0::double * ln((coalesce(t, 0) + 1.0::double) * ((select sum(s) from h) + 10000.0::double) / ((coalesce(s, 0) + 1.0::double) * ((select sum(t) from h) + 10000.0::double)))) as bigint)"""

_RESAMPLE = rf"""with {_CRC}, d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
e as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
x as (select doc_id, unnest(w) as w from d), y as (select unnest(w) as w from e),
v as materialized (select w, {_crc("w")} % 10000 as b from (select w from x union select w from y) cross join crc),
h as materialized (select b, cast(sum(s) as bigint) as s, cast(sum(t) as bigint) as t from (select b, 1 as s, 0 as t from x join v using (w) union all select b, 0, 1 from y join v using (w)) group by b),
g as materialized (select b, {_GAIN} as gain from h),
n as (select doc_id, cast(sum(gain) as bigint) as weight from x join v using (w) join g using (b) group by 1),
u as (select doc_id, len(w) as n_features, coalesce(weight, 0) as weight, (cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double as u from d left join n using (doc_id)),
s as (select doc_id, n_features, weight, weight + cast(floor(-1000.0::double * ln(-ln(u))) as bigint) as score from u),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from s where n_features >= 20)
select s.doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from s left join r using (doc_id)"""

SQL: dict[str, str] = {
    "op1_page_diff": _ARTICLE,
    "op2_exact_topk": _TOP,
    "op3_substring_dedup": _WINDOWS,
    "op6_mixing": mix_sql(SHARE, EPOCHS),
    "op7_warc": _WARC,
    "op10_line_spread": _SPREAD,
    "op11_merkle": _MERKLE,
    "op12_url_filter": _URLS,
    "op13_importance": _RESAMPLE,
}
