"""DuckDB SQL for the queries that SQL can express."""

OP2 = r"""
with u as (
  select page_id, url, coalesce(contains(url, '://'), false) as ok from pages
), h as (
  select page_id, url, ok,
    case when ok then translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when ok then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path
  from u
), r(rule, rhost, rpath, rverdict) as (
  values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), j as (
  select h.*,
    (select rule from r where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) order by length(rule) desc, rule limit 1) as rule,
    case when ok and regexp_matches(lower(url), '(?s)://.*spam-farm\.') then '://*spam-farm.' end as p1,
    case when ok and regexp_matches(lower(url), '(?s)://.*cheap-pills\.') then '://*cheap-pills.' end as p2,
    case when ok and regexp_matches(lower(url), '(?s)://.*free-bets\.') then '://*free-bets.' end as p3,
    case when ok and regexp_matches(lower(url), '(?s)://.*adult-x\.') then '://*adult-x.' end as p4,
    case when ok and regexp_matches(lower(url), '(?s)://.*\.casino([^a-z0-9_.%-]|$)') then '://*.casino^' end as p5,
    case when ok and contains(lower(url), '/adserver/') then '/adserver/' end as p6
  from h
)
select page_id, host, path, rule,
  case when rule is not null then (select rverdict from r where r.rule = j.rule)
       when coalesce(p2, p1, p3, p4, p5, p6) is not null then 'block' else 'allow' end as verdict,
  coalesce(p2, p1, p3, p4, p5, p6) as pattern_rule
from j
"""


def op6(documents: str = "documents", share: tuple[int, int] = (4, 5), epochs: int = 4, seed: int = 17, columns: str = "doc_id, domain, lang, source, tokens, epoch") -> str:
    """The mixture over a table or subquery; every sum is of integers."""

    def deal(out: str, nodes: str, parents: str, name: str) -> str:
        by = f"partition by {parents}" if parents else ""
        return f"""{out}_s as (
  select *, (sum(weight) over ({by}))::bigint as w,
    coalesce(sum(weight) over ({by} order by cap / weight::double, {name} rows between unbounded preceding and 1 preceding), 0)::bigint as w_before,
    coalesce(sum(cap) over ({by} order by cap / weight::double, {name} rows between unbounded preceding and 1 preceding), 0)::bigint as cap_before
  from ({nodes})
), {out}_f as (select *, cap * (w - w_before) <= weight * (parent_budget - cap_before) as is_full from {out}_s
), {out}_l as (
  select *, (parent_budget - coalesce(sum(case when is_full then cap end) over ({by}), 0))::bigint as rem,
    (w - coalesce(sum(case when is_full then weight end) over ({by}), 0))::bigint as w_left from {out}_f
), {out} as (select * exclude (w, w_before, cap_before, is_full, rem, w_left),
    case when is_full then cap else weight * rem // greatest(w_left, 1) end as budget from {out}_l)"""

    return f"""with src as (
  select *, coalesce(lang, '') as k_lang, coalesce(source, '') as k_source,
    case when regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' then 'other'
         else 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::int % 4)::varchar end as domain,
    greatest(1, (strlen(coalesce(text, '')) + 3) // 4)::bigint as tokens
  from {documents}
), leaf0 as (
  select domain, k_lang, k_source, sum(tokens)::bigint as supply, (sum(tokens) * {epochs})::bigint as cap,
    case k_source when 'src0' then 2 else 1 end::bigint as weight
  from src group by all
), dom0 as (
  select domain, sum(cap)::bigint as cap, sum(supply)::bigint as supply,
    case domain when 'd0' then 4 when 'd1' then 3 when 'd2' then 2 else 1 end::bigint as weight from leaf0 group by all
), {deal("dom", f"select *, least((sum(cap) over ())::bigint, ((sum(supply) over ())::bigint * {share[0]} // {share[1]})::bigint) as parent_budget from dom0", "", "domain")},
lang0 as (
  select domain, k_lang, sum(cap)::bigint as cap, case k_lang when 'en' then 4 when 'de' then 2 when 'fr' then 2 when 'es' then 2 else 1 end::bigint as weight
  from leaf0 group by all
), {deal("lan", "select l.*, d.budget as parent_budget from lang0 l join dom d using (domain)", "domain", "k_lang")},
{deal("leaf", "select l.*, d.budget as parent_budget from leaf0 l join lan d using (domain, k_lang)", "domain, k_lang", "k_source")},
plan as (select domain, k_lang, k_source, (budget // supply)::int as full_epochs, (budget % supply)::bigint as rest from leaf
), hashed as (
  select s.*, p.full_epochs, p.rest,
    ('0x' || substr(md5('{seed}:' || p.full_epochs::varchar || ':' || coalesce(s.doc_id::varchar, '')), 1, 15))::bigint as h
  from src s join plan p using (domain, k_lang, k_source)
), taken as (
  select *, sum(tokens) over (partition by domain, k_lang, k_source order by h) <= rest as in_prefix from hashed
)
select {columns} from (select *, unnest(range(0, full_epochs + case when in_prefix then 1 else 0 end))::int as epoch from taken)
"""


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: All phrases of 1 to 4 words, counted without pruning.
OP12 = rf"""
with t as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) as piece from documents
), p as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as w from t
), f as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as n
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from p, range(1, 5) r(k) where len(w) >= k) group by all
), total as (select lang, sum(len(w))::bigint as n from p group by lang
), c as (select lang, phrase, string_split(phrase, ' ') as w, n as a from f where k >= 2 and n >= 30
), cuts as (select lang, phrase, a, unnest(range(1, len(w))) as k, w from c
), s as (
  select c.lang, c.phrase, c.a, c.k, l.n as l, r.n as r, ((2000000::hugeint * c.a) // (l.n + r.n))::bigint as score
  from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.k], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.k + 1:], ' ')
), low as (select lang, phrase, a, l, r, score from s qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_ as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as held
  from (select lang, w, a, m, unnest(range(1, len(w) - m + 2)) as i from c, range(2, 4) r(m) where len(w) > m) group by all
), kept as (select low.*, row_number() over (partition by low.lang order by score desc, a desc, phrase) as rank from low left join inner_ using (lang, phrase) where held is null or 100::hugeint * held < 80::hugeint * a
)
select lang, rank, phrase, a, l, r, total.n, score from kept join total using (lang) where rank <= 2000
"""

#: Every document's score for every item, from all postings of the items' terms.
OP13 = r"""
with d as (
  select row_number() over () as row, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, UPPER_LOWER)) as w from documents
), n as (select row, doc_id, len(w)::bigint as n from d where len(w) > 0
), g as (select count(*) as docs, sum(n)::bigint as terms from n
), i as (select row_number() over () as item_no, item_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, UPPER_LOWER))) as w from benchmark
), q as (select item_no, item_id, unnest(w) as term from i
), tf as (select row, term, count(*) as tf from (select row, unnest(w) as term from d) where term in (select term from q) group by all
), wt as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from tf, g group by term, docs
), p as (
  select row, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))::bigint as part
  from tf join n using (row) join wt using (term), g
), s as (select item_no, item_id, row, doc_id, sum(part)::bigint as score from q join p using (term) join n using (row) group by all having sum(part) > 0
), k as (select *, row_number() over (partition by item_no order by score desc, doc_id nulls first) as rank from s)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
""".replace("UPPER_LOWER", _LOWER)

ORACLES = {"op2_url_filters": OP2, "op6_mixing": op6(), "op12_phrases": OP12, "op13_search": OP13}
