"""DuckDB SQL for the operators that SQL can express. Patterns, rules and figures are restated here from the contract, so the operators' own can't vouch for themselves."""

from __future__ import annotations

_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
for _c in "PASWDECRTOKNIY":  # letters of the keywords, in either case
    _ASSIGN = _ASSIGN[: _ASSIGN.index(")")].replace(_c.lower(), f"[{_c}{_c.lower()}]") + _ASSIGN[_ASSIGN.index(")") :]
_ACCESS, _HEX, _LONG = "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_=-]+"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans(kind: int, pattern: str) -> str:
    return f"""
select rid, {kind} k, s, s + length(m) e, m from (
  select rid, ms[i] m, coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)::bigint s
  from (select rid, ms, gs, unnest(range(1, len(ms) + 1)) i from (
    select rid, regexp_extract_all(t, {_quote(pattern)}, 0) ms, string_split_regex(t, {_quote(pattern)}) gs from d))
)"""


SECRETS = f"""
with d as (select row_number() over () rid, doc_id id, {{'o': source}} owner, {{'o': source, 'r': doc_id}} repo, coalesce(text, '') t from documents),
base as (
  select rid, k, s, e, v from (select rid, k, s, e, regexp_extract(m, {_quote(_ASSIGN)}, 2) v from ({_spans(0, _ASSIGN)})) where length(v) >= 12
  union all select rid, k, s, e, m from ({_spans(1, _ACCESS)}) where length(m) >= 18
  union all select rid, k, s, e, m from ({_spans(2, _HEX)}) where length(m) >= 16
),
weak as (
  select w.rid, k, s, e, m v from ({_spans(3, _LONG)}) w
  where length(m) >= 20 and regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')
    and not exists (select 1 from base b where b.rid = w.rid and b.s < w.e and w.s < b.e)
),
c as (select c.*, d.id, d.owner, d.repo from (select * from base union all select * from weak) c join d using (rid)),
freq as (select v, count(distinct owner) <= 2 and count(distinct repo) <= 10 live from c group by v),
kept as (select c.rid, k, s, e, live, ['assign', 'access', 'hex', 'owned'][k + 1] || ':' || s || ':' || e name from c join freq using (v) where k < 3 or live)
select d.id doc_id,
  count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex,
  sha256(coalesce(string_agg(name, ',' order by s, k) filter (k < 3), '')) base_sha256,
  coalesce(string_agg(name, ',' order by s, k), '') spans,
  count(*) filter (live) n_live, count(*) filter (not live) n_shared
from d left join kept using (rid) group by d.rid, d.id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
with d as (select row_number() over () rid, doc_id, {_WORDS} w from documents),
b as (select coalesce(cast(item_id as varchar), '') item, {_WORDS} w from benchmark),
win as (
  select distinct item, least(len(w), 13) n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') g
  from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from b where len(w) > 0)
),
hit as (
  select d.rid, d.i, win.n, win.item
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from win)) d
  join win on win.n = d.n and win.g = array_to_string(d.w[d.i:d.i + d.n - 1], ' ')
),
words as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + n)) p from hit) group by rid),
its as (select rid, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct rid, item from hit) group by rid)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join words using (rid) left join its using (rid)
"""

TOP_K = """
with v as (
  select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select q.vec_id query_id, c.vec_id vec_id, cast(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) as bigint) score, q.rid rid
  from v q join v c on q.vec_id % 100 = 0 and c.rid <> q.rid and len(c.e) = len(q.e)
)
select query_id, cast(rank as int) rank, vec_id, score
from (select *, row_number() over (partition by rid order by score desc, vec_id) rank from s) where rank <= 10
"""

WARC = """
with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) h from pages),
k as (select h, n, max(page_id) keeper from p where n >= 1000 group by h, n)
select page_id, cast(p.n as bigint) payload_bytes, p.h payload_digest,
  case when keeper is not null and page_id <> keeper then 'revisit' else 'response' end record_type,
  case when page_id <> keeper then keeper end refers_to
from p left join k on k.h = p.h and k.n = p.n
"""

SHARDS = "select doc_id, lang, source, n_chars, cast(length(text) as bigint) text_chars, sha256(text) text_sha256 from documents"


# The contract's rules, longest first.
_RULES = [("example.org", "/en/1", "block"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("org", "/", "allow")]
#: Rounds in SQL: after these, less than a ten-thousandth of the mass still moves. Masses are in units of 1e-12 of a seed.
_ROUNDS = 64


def _rule(action: bool) -> str:
    whens = [f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}') then '{what if action else host + path}'" for host, path, what in _RULES]
    return "case " + " ".join(whens) + " end"


def _rounds() -> str:
    out, last = "", "given"
    for i in range(_ROUNDS):
        flow = f"select w.kind, w.dst host, 85 * sum(r.mass // w.deg)::bigint // 100 mass from {last} r join ways w on w.kind = r.kind and w.src = r.host group by 1, 2"
        out += f", r{i} as (select kind, host, sum(mass)::bigint mass from ({flow} union all select kind, host, mass from given) group by 1, 2)"
        last = f"r{i}"
    return out


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_LINK = r"""(?i)href\s*=\s*["'']?(?:https?:)?//([^/"''?#\s>]+)"""

URLS = f"""
with u as (select page_id, html, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
h as (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path from u),
p as (select page_id, html, host, path, {_rule(False)} rule, {_rule(True)} said from h),
e as (select distinct host src, translate(unnest(regexp_extract_all(html, '{_LINK}', 1)), {_AZ}) dst from p),
edges as (select * from e where src <> dst and src <> ''),
dir as (select 1 kind, src, dst from edges union all select 0, dst, src from edges),
ways as (select *, count(*) over (partition by kind, src) deg from dir),
hosts as (select host, count(*) n, count(*) filter (said = 'allow') good, count(*) filter (said = 'block') bad from p group by host),
base as (select 1 kind, host, 1000000000000 * good // n seed from hosts union all select 0, host, 1000000000000 * bad // n from hosts),
given as (select kind, host, 15 * seed // 100 mass from base where 15 * seed // 100 > 0){_rounds()},
ranks as (select host, coalesce(sum(mass) filter (kind = 1), 0)::bigint trust, coalesce(sum(mass) filter (kind = 0), 0)::bigint distrust from r{_ROUNDS - 1} group by host)
select page_id, p.host, path, rule, coalesce(said, case when coalesce(distrust, 0) >= 37500000000 and coalesce(distrust, 0) > 2 * coalesce(trust, 0) then 'block' else 'allow' end) verdict,
  coalesce(trust, 0) trust, coalesce(distrust, 0) distrust
from p left join ranks on ranks.host = p.host
"""

_TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

INFILL = f"""
with d as (select doc_id, coalesce(text, '') t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) h from documents),
u as (
  select doc_id, t, case when t = '' then [] else regexp_extract_all(t, '{_TOKEN}') end w, {", ".join(f"cast('0x' || substr(h, {8 * i + 1}, 8) as bigint) h{i + 1}" for i in range(4))} from d
),
c as (select *, len(w) n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) b from u),
f as (
  select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end form,
    array_to_string(w[1:a], '') p, array_to_string(w[a + 1:b], '') m, array_to_string(w[b + 1:], '') s
  from c
)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then cast(length(p) as bigint) end prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256
from f
"""

# Restated: phrases (label, words, whether the contract's) and notices (label, words); a notice may lack a fifth of its words.
_PHRASES = [
    ("mit", "under the mit license", 1), ("apache-2", "apache license version 2", 1), ("cc-by-nc", "cc by nc", 1), ("agpl-3", "gnu affero general public license version 3", 0), ("bsd", "under the bsd license", 0),
    ("cc-by-nd", "cc by nd", 0), ("cc-by-sa", "cc by sa", 0), ("cc0", "cc0 1 0 universal", 0), ("gpl-2", "gnu general public license version 2", 0), ("gpl-3", "gnu general public license version 3", 0),
    ("lgpl", "gnu lesser general public license", 0), ("mpl-2", "mozilla public license version 2", 0), ("unlicense", "released into the public domain", 0),
]


def _licenses() -> str:
    """Bands of 16 diagonals from every eighth; runs of three words are compared as text."""
    from hearthspark.llm.licenses import NOTICES

    notice = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t).lower().split())
    known = [(label, words, base, 0) for label, words, base in _PHRASES] + [(label, notice(t), 0, 1) for label, t in NOTICES.items()]
    values = ", ".join(f"({i}, '{label}', string_split('{words}', ' '), {base}, {fuzzy})" for i, (label, words, base, fuzzy) in enumerate(known))
    return f"""
with d as (select row_number() over () rid, doc_id, {_WORDS} w from documents),
t as (select t, label, x, len(x) size, base, case fuzzy when 1 then len(x) // 5 else 0 end lack from (values {values}) v(t, label, x, base, fuzzy)),
tr as (select t, size, base, lack, i - 1 o, array_to_string(x[i:i + 2], ' ') g from (select *, unnest(range(1, size - 1)) i from t)),
dr as (select rid, i - 1 pos, array_to_string(w[i:i + 2], ' ') g from (select rid, w, unnest(range(1, len(w) - 1)) i from d)),
hits as (select rid, t, size, base, lack, o, pos - o dg from dr join tr using (g)),
exact as (select rid, t, base, dg from hits where lack = 0 group by rid, t, base, dg, size having count(*) = size - 2),
cover as (
  select rid, t, size, b, count(distinct p) n from (select rid, t, size, lack, b, unnest(range(o, o + 3)) p from (select *, unnest([floor(dg / 8.0) - 1, floor(dg / 8.0)]) b from hits where lack > 0))
  group by rid, t, size, lack, b having count(distinct p) >= size - lack
),
said as (select rid, t, 1.0::double score from exact union all select rid, t, n::double / size from cover),
per as (select rid, string_agg(distinct label, ',' order by label) labels, max(score) score from said join t using (t) group by rid),
based as (select rid, count(*) n, min(dg) a, max(dg) b, string_agg(distinct label, ',' order by label) labels from exact join t using (t) where t.base = 1 group by rid)
select doc_id, cast(len(w) as bigint) n_words, coalesce(based.n, 0) n_base, cast(based.a as bigint) first_word, cast(based.b as bigint) last_word,
  coalesce(based.labels, '') base_labels, coalesce(per.labels, '') labels, coalesce(per.score, 0.0) score
from d left join per using (rid) left join based using (rid)
"""


LICENSES = _licenses()


def _collocations() -> str:
    grams = " union all ".join(f"select lang, array_to_string(w[i:i + {k - 1}], ' ') p, {k} k from s where i + {k - 1} <= len(w)" for k in range(1, 5))
    cuts = " union all ".join(f"select *, {j} j, array_to_string(w[1:{j}], ' ') x, array_to_string(w[{j + 1}:], ' ') y from cand where k > {j}" for j in range(1, 4))
    subs = " union all ".join(f"select lang, f, array_to_string(w[{i}:{i + n - 1}], ' ') p from cand where k > {n} and k >= {i + n - 1}" for n in (2, 3) for i in range(1, 4))
    return f"""
with pieces as (select coalesce(lang, 'und') lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) t from documents),
w as (select lang, regexp_extract_all(t, '[^\\x20\\x09]+') w from pieces),
s as (select lang, w, unnest(range(1, len(w) + 1)) i from w),
n as (select lang, sum(len(w))::bigint n from w group by lang),
f as (select lang, p, k, count(*)::hugeint f from ({grams}) group by lang, p, k),
cand as (select lang, p, k, f, string_split(p, ' ') w from f where k >= 2 and f >= 30),
met as (select c.lang, c.p, c.f a, j, l.f l, r.f r, 2000000 * c.f // (l.f + r.f) score from ({cuts}) c join f l on l.lang = c.lang and l.p = c.x join f r on r.lang = c.lang and r.p = c.y),
low as (select * from met qualify row_number() over (partition by lang, p order by score, j) = 1),
held as (select lang, p, max(f) f from ({subs}) group by lang, p),
kept as (select low.* from low left join held on held.lang = low.lang and held.p = low.p where held.f is null or 100 * held.f < 80 * a)
select lang, rank, p phrase, a::bigint a, l::bigint l, r::bigint r, n, score::bigint score
from (select *, row_number() over (partition by lang order by score desc, a desc, p) rank from kept) join n using (lang) where rank <= 2000
"""


COLLOCATIONS = _collocations()
