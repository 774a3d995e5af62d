"""DuckDB forms of the catalogue's queries."""

from __future__ import annotations

_CORPUS = r"""corpus as (select source as collection_id, doc_id::varchar as doc_id, split_part(coalesce(text, ''), chr(10), 1) as title,
  substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2) as body from documents)"""
_WORDS = r"""words as (select collection_id, doc_id, list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') as tt,
  list_filter(regexp_split_to_array(lower(body), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') as bt from corpus)"""
_POST = """tok as (select collection_id, doc_id, unnest(tt) as term, 1 as t, 0 as b from words union all select collection_id, doc_id, unnest(bt), 0, 1 from words),
post as (select collection_id, doc_id, term, sum(t)::bigint as tf_title, sum(b)::bigint as tf_body from tok group by all)"""
_QUERIES = "q(query_id, text) as (values ('q1', 'the of and'), ('q2', 'der die und ist'), ('q3', 'la que de'), ('q4', 'that THE tion ing'), ('q5', ' --- '))"
_SNIPPET = r"case when length(trim(regexp_replace(body, '\s+', ' ', 'g'))) <= 180 then trim(regexp_replace(body, '\s+', ' ', 'g')) else rtrim(substr(trim(regexp_replace(body, '\s+', ' ', 'g')), 1, 180)) || '…' end"


def _lex(corpus: str = _CORPUS, queries: str = _QUERIES, every: bool = False) -> str:
    keep = "where found = n_terms" if every else ""
    return rf"""{corpus}, {_WORDS}, {_POST}, {queries},
terms as (select distinct query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: x <> '')) as term from q),
nt as (select query_id, count(*) as n_terms from terms group by 1),
st as (select collection_id, count(*) as n, avg(len(tt)) as avt, avg(len(bt)) as avb from words group by 1),
df as (select collection_id, term, count(*) as df from post group by 1, 2),
sc as (select query_id, collection_id, doc_id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (
   2.5 * case when tf_title = 0 then 0 else tf_title * 2.2::double / (tf_title + 1.2::double * (0.25 + 0.75::double * len(tt) / avt)) end
   + case when tf_body = 0 then 0 else tf_body * 2.2::double / (tf_body + 1.2::double * (0.25 + 0.75::double * len(bt) / avb)) end)) as score, count(*) as found
  from post join terms using (term) join df using (collection_id, term) join st using (collection_id) join words using (collection_id, doc_id) group by 1, 2, 3),
lex as (select query_id, collection_id, doc_id, score, row_number() over (partition by query_id, collection_id order by round(score, 9) desc, doc_id) as rank from sc join nt using (query_id) {keep})"""


_ITEMS = "items as (select vec_id::varchar as doc_id, embedding::double[] as v from embeddings), qs as (select doc_id as query_id, v as qv from items where doc_id::bigint % 100 = 0)"
_COS = "list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
_EXACT = f"""ex as (select query_id, doc_id, {_COS.format(a="qv", b="v")} as score from qs cross join items),
exact as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from ex)"""

_EMBED = r"""alltext as (select 'd' as kind, collection_id, doc_id as id, title || chr(10) || body as text from corpus union all select 'q', '', query_id, text from q),
etok as (select kind, collection_id, id, w, count(*) as c from (select kind, collection_id, id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as w from alltext) where w <> '' group by all),
vocab as (select distinct w from etok),
feat as (select w, 'word:' || w as f, 2.0::double as x from vocab union all select w, 'gram:' || substr('^' || w || '$', i::int, 3), 0.5 from (select w, unnest(range(1, length(w) + 1)) as i from vocab)),
hs as (select f, list_reduce(list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), (2 * i + 1)::int, 2))::hugeint), lambda h, b: (xor(h::ubigint, b::ubigint)::hugeint * 1099511628211::hugeint) % 18446744073709551616::hugeint, 14695981039346656037::hugeint) as h from (select distinct f from feat)),
wv as (select w, (h % 256)::bigint as slot, sum(case when h >= 9223372036854775808::hugeint then -x else x end) as x from feat join hs using (f) group by 1, 2),
vec as (select kind, collection_id, id, slot, sum(x) as x from (select kind, collection_id, id, slot, c * x as x from etok join wv using (w) union all select kind, collection_id, id, 0, 1.0 from alltext) group by all)"""
_NEAR = f"""{_EMBED},
nrm as (select kind, collection_id, id, sqrt(sum(x * x)) as n from vec group by all),
dots as (select b.id as query_id, a.collection_id, a.id as doc_id, sum(a.x * b.x) as dot from vec a join vec b on a.slot = b.slot and a.kind = 'd' and b.kind = 'q' group by all),
cosine as (select query_id, d.collection_id, doc_id, coalesce(dot, 0) / (a.n * b.n) as score from (select q.query_id, c.collection_id, c.doc_id, dot from q cross join corpus c left join dots using (query_id, collection_id, doc_id)) d
  join nrm a on a.kind = 'd' and a.collection_id = d.collection_id and a.id = d.doc_id join nrm b on b.kind = 'q' and b.id = d.query_id),
near as (select * from (select *, row_number() over (partition by query_id, collection_id order by round(score, 9) desc, doc_id) as rank from cosine) where rank <= 40)"""

_WHO = """who(query_id, subject, groups, scopes) as (values ('q1', 'alice', ['engineering'], ['search.execute']), ('q2', 'lead', ['engineering', 'leads'], ['search.execute']),
 ('q3', 'bob', ['sales'], ['search.execute']), ('q4', 'suspended-user', ['engineering'], ['search.execute']), ('q5', ' ', ['engineering'], ['search.execute']))"""
_REASON = """case when trim(subject) = '' then 'unauthenticated' when substr(collection_id, 4)::int >= 15 then 'collection_default_deny'
 when not list_contains(groups, 'engineering') or subject = 'suspended-user' then 'collection_policy_denied'
 when doc_id like '%0' and not (list_contains(groups, 'leads') and '{action}' = 'search') then 'document_policy_denied' else 'policy_allowed' end"""
_WALK = f"""{_WHO}, dec as (select lex.*, subject, {_REASON.format(action="search")} as reason from lex join who using (query_id)),
run as (select *, reason = 'policy_allowed' as allowed, sum((reason = 'policy_allowed')::int) over (partition by query_id, collection_id order by rank rows between unbounded preceding and current row) as given from dec),
seen as (select * from run where given < 5 or given = 5 and allowed)"""
_NODES = "nodes as (select distinct 'node-' || (substr(source, 4)::int % 4)::varchar as node_id, source as collection_id from documents)"
_ANSWERS = f"{_NODES}, ans as (select query_id, node_id, collection_id, doc_id, rank from lex join nodes using (collection_id) where rank <= 10)"
_RESP = "resp as (select query_id, node_id, 20.0 + substr(node_id, 6)::int * 30 + substr(query_id, 2, 1)::int as arrival from q cross join (select distinct node_id from nodes))"
_SHARDS = """want(query_id, cs) as (values ('q1', []::varchar[]), ('q2', ['src1', 'src2']), ('q3', ['src0', 'src4', 'src9']), ('q4', ['nowhere']), ('q5', ['src3'])),
hit as (select query_id, node_id, collection_id from want cross join nodes where len(cs) = 0 or list_contains(cs, collection_id)),
shards as (select query_id, node_id, node_id || ':' || collection_id as shard_id from hit union all
  select query_id, node_id, node_id from want cross join (select distinct node_id from nodes) anti join hit using (query_id, node_id))"""
_FEATURES = r"""len(regexp_split_to_array(trim(text), '\s+')) * (trim(text) <> '')::int as tokens, length(trim(text)) as runes,
 regexp_matches(trim(text), '^[^"]*("\s*"[^"]*)*"[^"]*[^"\s][^"]*"') as quoted,
 trim(text) <> '' and not regexp_matches(trim(text), '\s') and strlen(trim(text)) >= 4 and regexp_matches(trim(text), '[-_:/]') and regexp_matches(trim(text), '\p{Nd}') as id_like,
 len(regexp_split_to_array(trim(text), '\s+')) * (trim(text) <> '')::int >= 6 or trim(text) like '%?' or regexp_matches(lower(trim(text)), '^(how|why|what|which) ') as "natural" """
_CASES = f"""cases as (select concat_ws('-', conv_id, turn, role) as query_id, min(text) as text, min(conv_id) % 4 as ready, (min(turn) % 5 + 1) * 25000000 as deadline from conversations group by 1),
base(strategy, ord, quality, p95) as (values ('lexical', 0, 0.78::double, 15000000::bigint), ('vector', 1, 0.82, 35000000), ('hybrid', 2, 0.91, 60000000)),
f as (select *, {_FEATURES} from cases),
est as (select query_id, strategy, ord, p95, deadline, case when ord = 0 then p95 when ready = 0 then null else trunc(p95 / (ready / 3::double))::bigint end as lat,
  greatest(0, least(1, (quality + case when quoted or id_like then [0.08, -0.08, -0.06][ord + 1] else 0 end + case when "natural" then [-0.02, 0.05, 0.04][ord + 1] else 0 end) * case when ord = 0 then 1 else ready / 3::double end)) as qual from f cross join base),
pick as (select *, row_number() over (partition by query_id order by ok desc, case when ok then -round(qual, 9) else ord end, case when ok then lat else 0 end, ord) as r
  from (select *, coalesce(lat <= trunc(deadline * 0.85), false) as ok from est))"""
_LOG = """log as (select 'c' || (user_id % 4)::varchar as collection_id, row_number() over (partition by user_id % 4 order by ts, event_id) as seq,
  case when event_type = 'error' then 'delete' else 'upsert' end as op, user_id::varchar as doc_id, props as body from events),
com as (select collection_id, floor(max(seq) * 0.9)::bigint as committed from log group by 1)"""
_SEG = "seg as (select * from (select *, (seq - 1) // 50 + 1 as generation, row_number() over (partition by collection_id, doc_id, (seq - 1) // 50 order by seq desc) as r from log) where r = 1)"
_LEASE = """ev as (select user_id as node_id, floor(epoch(ts))::bigint as sec, event_id as n, case event_type when 'signup' then 'register' when 'error' then 'deregister' when 'click' then 'heartbeat' when 'view' then 'heartbeat' end as kind from events),
nowt as (select max(sec) as now from ev where kind is not null),
g as (select *, sum((kind = 'register')::int) over (partition by node_id order by sec, n) as grp from ev where kind is not null),
bk as (select *, kind <> 'register' and (sec - lag(sec) over w >= 43200 or lag(kind) over w = 'deregister') as broken from g where grp > 0 window w as (partition by node_id, grp order by sec, n)),
acc as (select *, max(coalesce(broken, false)::int) over (partition by node_id, grp order by sec, n) = 0 as ok from bk),
reg as (select node_id, grp, min(sec) as since, max(sec) + 43200 as ends, max((kind = 'deregister')::int) = 1 as gone from acc where ok group by 1, 2),
rg as (select *, lead(since) over (partition by node_id order by grp) as replaced from reg)"""
_BENCH = """corpus as (select 'bench' as collection_id, printf('document-%09d', n) as doc_id, 'topic' || ((n * 104729 + 7) % 4096) || ' owner' || ((n * 32771 + 49) % 16384) as title,
  'region' || ((n * 65537 + 21) % 256) || ' record' || n as body from range(200) t(n))"""
_BENCHQ = "q as (select n::varchar as query_id, 'topic' || ((((n * 7919 + 7) % 200) * 104729 + 7) % 4096) || ' region' || ((((n * 7919 + 7) % 200) * 65537 + 21) % 256) as text from range(10) t(n))"
_PAD = {k: "".join(f"{b ^ x:02x}" for b in b"audit-key".ljust(64, b"\0")) for k, x in (("i", 0x36), ("o", 0x5C))}


def _hmac(m: str) -> str:
    return f"sha256(unhex('{_PAD['o']}') || unhex(sha256(unhex('{_PAD['i']}') || encode({m}))))"


_TOP = "query_id, collection_id, doc_id, round(score, 6) as score, rank"
_RRF = "row_number() over (partition by {by} order by round(score, 9) desc, {ties}) as rank"

SQL = {
    "tokenize_lengths": f"with {_CORPUS}, {_WORDS} select doc_id, len(tt)::bigint as len_title, len(bt)::bigint as len_body, len(list_distinct(tt || bt))::bigint as n_terms from words",
    "lexical_field_stats": f"with {_CORPUS}, {_WORDS} select collection_id, count(*) as n, round(avg(len(tt)), 6) as avg_title, round(avg(len(bt)), 6) as avg_body from words group by 1",
    "doc_frequency": f"with {_CORPUS}, {_WORDS}, {_POST} select collection_id, term, count(*) as df, sum(tf_title)::bigint as tf_title, sum(tf_body)::bigint as tf_body from post group by 1, 2",
    "lexical_any": f"with {_lex()} select {_TOP} from lex where rank <= 10",
    "lexical_all": f"with {_lex(every=True)} select {_TOP} from lex",
    "snippets": f"with {_CORPUS} select doc_id, {_SNIPPET} as snippet from corpus",
    "feature_hashes": """with h as (select doc_id::varchar as doc_id, list_reduce(list_transform(range(0, strlen(doc_id::varchar)), lambda i: ('0x' || substr(hex(encode(doc_id::varchar)), (2 * i + 1)::int, 2))::hugeint),
  lambda h, b: (xor(h::ubigint, b::ubigint)::hugeint * 1099511628211::hugeint) % 18446744073709551616::hugeint, 14695981039346656037::hugeint) as h from documents)
select doc_id, (case when h >= 9223372036854775808::hugeint then h - 18446744073709551616::hugeint else h end)::bigint as hash,
  (select least(16, coalesce(min(k), 32))::bigint from range(32) t(k) where (h // (4::hugeint ** k)::hugeint) % 4 <> 0) as level from h""",
    "vector_normalize_check": "select vec_id, len(embedding) = 64 and not list_bool_or(list_transform(embedding, lambda x: isnan(x) or isinf(x))) as ok, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 5) as norm, round(embedding[1]::double / sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as first from embeddings",
    "vector_exact_topk": f"with {_ITEMS}, {_EXACT} select query_id, doc_id, round(score, 5) as score, rank from exact where rank <= 10",
    "recall_at_k": f"""with {_ITEMS}, {_EXACT}, ci as (select doc_id, list_transform(v, lambda x: round(x, 1)) as v from items), cq as (select doc_id as query_id, v as qv from ci where doc_id::bigint % 100 = 0),
cs as (select query_id, doc_id, {_COS.format(a="qv", b="v")} as score from cq cross join ci), cr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from cs)
select e.query_id, round(count(c.doc_id) / count(*)::double, 6) as recall from exact e left join cr c on c.query_id = e.query_id and c.doc_id = e.doc_id and c.rank <= 10 where e.rank <= 10 group by 1""",
    "rrf_fusion": f"with {_lex()}, f as (select collection_id, doc_id, sum(1 / (60 + rank)::double) as score from lex where rank <= 50 group by 1, 2), r as (select *, {_RRF.format(by='collection_id', ties='doc_id')} from f) select collection_id, doc_id, round(score, 9) as score, rank from r where rank <= 10",
    "ndcg_at_k": f"""with {_lex()}, gr as (select doc_id::varchar as doc_id, 2 * quality + 1 - toxic as grade from labels),
dcg as (select query_id, collection_id, sum((2 ** coalesce(grade, 0) - 1) / log2(rank + 1)) as d from lex left join gr using (doc_id) where rank <= 10 group by 1, 2),
id as (select collection_id, sum((2 ** grade - 1) / log2(r + 1)) as i from (select collection_id, grade, row_number() over (partition by collection_id order by grade desc, doc_id) as r from corpus join gr using (doc_id)) where r <= 10 group by 1)
select query_id, collection_id, round(case when coalesce(i, 0) = 0 then 0 else d / i end, 6) as ndcg from dcg left join id using (collection_id)""",
    "hash_embed_features": f"with {_CORPUS}, {_QUERIES}, {_EMBED} select id as doc_id, slot, x as weight from vec where kind = 'd' and x <> 0",
    "hash_vector_search": f"with {_CORPUS}, {_QUERIES}, {_NEAR} select {_TOP} from near",
    "hybrid_search": f"with {_lex()}, {_NEAR}, f as (select query_id, collection_id, doc_id, sum(1 / (60 + rank)::double) as score from (select query_id, collection_id, doc_id, rank from lex union all select query_id, collection_id, doc_id, rank from near) group by 1, 2, 3), r as (select *, {_RRF.format(by='query_id, collection_id', ties='doc_id')} from f) select query_id, collection_id, doc_id, round(score, 9) as score, rank from r where rank <= 10",
    "policy_decisions": f"with {_CORPUS}, {_WHO}, d as (select collection_id, doc_id, query_id, {_REASON.format(action='search')} as reason from corpus cross join who) select collection_id, doc_id, query_id, reason = 'policy_allowed' as allowed, reason from d",
    "authorized_search": f"with {_lex()}, {_WALK} select query_id, collection_id, doc_id, given::bigint as rank, title, {_SNIPPET} as snippet from seen join corpus using (collection_id, doc_id) where allowed",
    "audit_prefix": f"with {_lex()}, {_WALK} select 'search' as action, allowed, reason, {_hmac('subject')} as subject_hash, {_hmac('collection_id || chr(0) || doc_id')} as resource_hash from seen",
    "get_document": f"""with {_CORPUS}, {_WHO}, ids as (select collection_id, doc_id, title || chr(10) || body as content from corpus union all select collection_id, doc_id || '-gone', null from corpus),
d as (select *, {_REASON.format(action="read")} as reason from ids cross join who where query_id = 'q1')
select collection_id, doc_id, case when content is null then 'not_found' when reason <> 'policy_allowed' then 'permission_denied' else 'found' end as status, case when content is not null and reason = 'policy_allowed' then strlen(content) else 0 end as n_bytes from d""",
    "federated_search": f"""with {_lex()}, {_ANSWERS}, f as (select query_id, collection_id, doc_id, sum(1 / (60 + rank)::double) as score, min(node_id) as node_id from ans group by 1, 2, 3), r as (select *, {_RRF.format(by='query_id', ties='collection_id, doc_id')} from f)
select query_id, collection_id, doc_id, node_id, round(score, 9) as score, rank, title, {_SNIPPET} as snippet from r join corpus using (collection_id, doc_id) where rank <= 10""",
    "shard_coverage": f"with {_NODES}, {_SHARDS} select * from shards",
    "deadline_partial": f"""with {_NODES}, {_QUERIES}, {_SHARDS}, {_RESP} select query_id, coalesce(string_agg(shard_id, ',' order by shard_id) filter (arrival <= 100), '') as searched, coalesce(string_agg(shard_id, ',' order by shard_id) filter (arrival > 100), '') as unavailable from shards join resp using (query_id, node_id) group by 1""",
    "cumulative_updates": f"""with {_lex()}, {_ANSWERS}, {_RESP}, st2 as (select *, row_number() over (partition by query_id order by arrival, node_id) as step from resp where arrival <= 100),
f as (select a.query_id, t.step, a.collection_id, a.doc_id, sum(1 / (60 + a.rank)::double) as score from ans a join st2 s using (query_id, node_id) join st2 t on t.query_id = a.query_id and s.step <= t.step group by 1, 2, 3, 4),
r as (select *, {_RRF.format(by='query_id, step', ties='collection_id, doc_id')} from f) select query_id, step, collection_id, doc_id, round(score, 9) as score, rank from r where rank <= 10""",
    "query_features": f"select conv_id, turn, role, {_FEATURES} from conversations",
    "planner_select": f"with {_CASES} select query_id, strategy, ok as fits, round(qual, 6) as est_quality, case when ok then lat else p95 end as est_latency_ns from pick where r = 1",
    "tracker_snapshot": """with base(strategy, quality, p95) as (values ('lexical', 0.78::double, 15000000::bigint), ('vector', 0.82, 35000000), ('hybrid', 0.91, 60000000)),
o as (select ['lexical', 'vector', 'hybrid'][event_id % 3 + 1] as strategy, round(value * 1000000)::bigint as lat, event_id % 101 / 100.0::double as q, event_id from events),
l as (select *, row_number() over (partition by strategy order by event_id desc) as r from o where lat > 0),
s as (select strategy, avg(q) as q, quantile_disc(lat, 0.95) as p, count(*) as n from l where r <= 256 group by 1)
select strategy, round(coalesce(q, quality), 6) as quality, coalesce(p, p95) as p95_ns, coalesce(n, 0) as samples from base left join s using (strategy)""",
    "planner_compare": f"""with {_CASES}, o as (select query_id, strategy, 15000000 * (ord + 1) + length(text) % 97 * 1000000 as lat, 0.5 + (length(text) + ord) % 10 / 20.0::double as rq, deadline from cases cross join base),
a as (select strategy as policy, * exclude strategy from o union all select 'adaptive', * exclude strategy from o semi join (select query_id, strategy from pick where r = 1) p using (query_id, strategy))
select policy, count(*) as cases, round(avg(rq), 6) as mean_quality, (sum(lat)::bigint // count(*))::bigint as mean_latency_ns, round(avg((lat > deadline)::int), 6) as miss_rate from a group by 1""",
    "log_replay": f"with {_LOG}, l as (select *, row_number() over (partition by collection_id, doc_id order by seq desc) as r from log join com using (collection_id) where seq <= committed) select collection_id, doc_id, seq, body from l where r = 1 and op <> 'delete'",
    "log_truncate": f"with {_LOG}, c as (select log.*, seq - lag(seq) over (partition by collection_id order by seq) as d from log join com using (collection_id) where seq > committed // 3) select collection_id, count(*) as entries, min(seq) as low, max(seq) as high, count(*) filter (d <> 1) as gaps from c group by 1",
    "segment_documents": f"with {_LOG}, {_SEG}, l as (select *, row_number() over (partition by collection_id, doc_id order by generation desc) as z from seg) select collection_id, doc_id, seq, generation from l where z = 1 and op <> 'delete'",
    "segment_compact": f"""with {_LOG}, {_SEG}, t as (select *, row_number() over (partition by collection_id, doc_id order by generation desc) as z, max(generation) over () + 1 as next from seg)
select collection_id, doc_id, 'upsert' as op, seq, next as generation from t where z = 1 and op <> 'delete'""",
    "lease_active_nodes": f"with {_LEASE} select node_id, ends as expires_at from rg cross join nowt where replaced is null and not gone and ends > now",
    "registry_revision": f"with {_LEASE}, c as (select count(*) as registered, count(*) filter (gone) as deregistered, count(*) filter (not gone and ends <= coalesce(replaced, now)) as expired from rg cross join nowt) select *, registered + deregistered + expired as revision from c",
    "election_terms": """with recursive c as (select user_id % 4 as group_id, event_id as n, 'n' || (user_id % 3)::varchar as node_id, floor(epoch(ts))::bigint as sec, row_number() over (partition by user_id % 4 order by floor(epoch(ts)), event_id) as i from events where event_type = 'signup'),
f as (select group_id, i, n, node_id, true as won, node_id as holder, 1::bigint as term, sec + 7200 as ends from c where i = 1
  union all select c.group_id, c.i, c.n, c.node_id, c.sec >= f.ends or f.holder = c.node_id, case when c.sec >= f.ends or f.holder = c.node_id then c.node_id else f.holder end,
   f.term + (c.sec >= f.ends)::bigint, case when c.sec >= f.ends or f.holder = c.node_id then c.sec + 7200 else f.ends end from f join c on c.group_id = f.group_id and c.i = f.i + 1)
select group_id, n, node_id, won, case when won then term else 0 end as term from f""",
    "quorum_write": """with a as (select event_id as "offset", r, r = 0 or (event_id * 7 + r * 13) % 5 < event_id % 4 as ack, event_id % 11 <> 0 as leader from events cross join range(5) t(r))
select "offset", count(*) filter (ack) as acknowledged, 3::bigint as needed, count(*) filter (ack) >= 3 and bool_and(leader) as committed from a group by 1""",
    "replica_catch_up": """with m as (select max(event_id) + 1 as top from events), t as (select n_name as replica_id, n_nationkey * (top // 25) as c, n_nationkey * (top // 25) + n_nationkey % 3 as a, top * 4 // 5 as goal, top // 5 as low from nation cross join m),
x as (select *, case when c > goal then 'ahead' when c = goal then 'none' when c < low then 'snapshot' else 'entries' end as action from t)
select replica_id, action, (case when action in ('entries', 'snapshot') then a - c else 0 end)::bigint as dropped, case when action = 'entries' then (select count(*) from events where event_id + 1 > c and event_id + 1 <= goal) else 0 end as sent from x""",
    "search_metrics": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n, round(sum(value), 4) as total, quantile_disc(value, 0.95) as p95 from events group by 1, 2",
    "load_report": """select event_type, count(*) as requests, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99,
 list_sort(list(value))[floor(0.95 * (count(*) - 1) + 0.5)::int + 1] as load_p95, round(avg((value > 100)::int), 6) as slow_share from events where value is not null group by 1""",
    "benchmark_corpus_search": f"with {_lex(_BENCH, _BENCHQ, True)} select query_id, doc_id, round(score, 6) as score, rank from lex where rank <= 20",
    "stream_metrics": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "stream_leases": """with e as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 12 hour, true) as fresh from events),
s as (select *, sum(fresh::int) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from e)
select user_id as node_id, epoch_us(min(ts)) as since_us, epoch_us(max(ts) + interval 12 hour) as expires_us, count(*) as beats from s group by user_id, k""",
}

_REQ = r"""req as (select query_id, trim(text) as text, ready, case when lower(trim(m)) = '' then 'auto' else lower(trim(m)) end as mode, case when lim = 0 then 10 else lim end as lim, tm from (
  select query_id, text, ready, ['', ' AUTO', 'lexical', 'Vector ', 'hybrid', 'fuzzy', 'auto'][k + 1] as m, (length(text) % 107)::int as lim, case when k = 6 then -5 else deadline // 1000000 end::int as tm
  from (select *, (crc % 7)::int as k from cases join crcs using (query_id)))),
bad as (select *, case when text = '' then 'query is required' when lim not between 1 and 100 then 'limit must be between 1 and 100' when tm not between 1 and 10000 then 'timeout must be between 1 and 10000 milliseconds'
  when mode not in ('auto', 'lexical', 'vector', 'hybrid') then 'mode must be auto, lexical, vector, or hybrid' end as error from req)"""
#: CRC-32 by its definition, a bit at a time: DuckDB has no function for it.
_CRC = """crcs as (select query_id, xor(list_reduce(list_transform(range(0, strlen(query_id)), lambda i: ('0x' || substr(hex(encode(query_id)), (2 * i + 1)::int, 2))::bigint), lambda c, b:
  list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end), 4294967295::bigint), 4294967295) as crc from cases)"""
_NODES_ALL = """own as (select 'node-' || (substr(source, 4)::int % 4)::varchar as node_id, list_sort(list(distinct source)) as cs from documents group by 1),
every as (select node_id, cs from own union all select 'spare-' || node_id, cs[1:2] from own)"""
_WANTED = "want(query_id, cs) as (values ('q1', []::varchar[]), ('q2', ['src1', 'src2']), ('q3', ['src0', 'src4', 'src9']), ('q4', ['nowhere']), ('q5', ['src3']))"
_SET = """chg as (select 'c' || (user_id % 4) as collection_id, case when user_id % 3 = 0 then null else user_id::varchar end as doc_id, 'v' || event_id as version, event_id as n,
  case when event_id % 35 = 5 then 'policy version is required' when event_id % 6 = 3 then 'policy must contain at least one rule' when event_id % 6 = 4 then 'policy rule has an invalid effect'
   when event_id % 6 = 1 then 'policy rule must contain an action' when event_id % 6 = 2 then 'policy rule has an invalid action' end as error from events)"""
_TERMS = SQL["election_terms"].rsplit("select group_id, n, node_id, won,", 1)[0]
_UPDATES = SQL["cumulative_updates"]

SQL |= {
    "request_modes": f"""with {_CASES}, {_CRC}, {_REQ} select query_id, lim as "limit", tm as timeout_ms, error, case when error is null then case when mode = 'auto' then strategy else mode end end as chosen,
 case when mode in ('lexical', 'vector', 'hybrid') then mode when mode = 'auto' then 'hybrid' end as node_mode from bad left join (select query_id, strategy from pick where r = 1) using (query_id)""",
    "executor_requests": f"""with {_CASES}, {_CRC}, x as (select query_id, trim(text) as text, case when length(text) % 13 = 0 then '' else query_id end as request_id, (length(text) % 107)::int - 3 as lim, (crc % 7)::int as k from cases join crcs using (query_id))
select query_id, request_id, lim as "limit", array_to_string(list_sort(list_distinct(list_filter(['b', trim(['', ' AUTO', 'lexical', 'Vector ', 'hybrid', 'fuzzy', 'auto'][k + 1]), 'a'], lambda c: c <> ''))), ',') as collections,
 case when request_id = '' then 'request ID is required' when text = '' then 'query text is required' when lim <= 0 then 'result limit must be positive' when k = 6 then 'query timeout cannot be negative' end as error from x""",
    "planner_refusals": f"""with {_CASES}, x as (select case when trim(text) = '' then 'query is required' when deadline - 50000000 <= 0 then 'query deadline must be positive' when length(text) % 5 > 3 or ready > length(text) % 5 then 'invalid node health' else 'none' end as error from cases) select error, count(*) as n from x group by 1""",
    "node_readiness": f"with {_NODES_ALL} select node_id, node_id <> 'node-1' as ready from every",
    "collection_owners": f"with {_NODES_ALL}, f as (select c as collection_id, min(node_id) as node_id from (select node_id, unnest(cs) as c from every) group by 1) select *, (select count(*) from f) as collections from f",
    "catalog_nodes": f"with {_NODES_ALL}, {_WANTED} select query_id, node_id from want cross join every where len(want.cs) = 0 or list_has_any(every.cs, want.cs)",
    "requested_search": f"""with {_lex()}, {_NODES}, {_WANTED}, a as (select query_id, node_id, collection_id, doc_id, rank from lex join nodes using (collection_id) join want using (query_id) where rank <= 10 and (len(cs) = 0 or list_contains(cs, collection_id))),
f as (select query_id, collection_id, doc_id, sum(1 / (60 + rank)::double) as score from a group by all), r as (select *, {_RRF.format(by='query_id', ties='collection_id, doc_id')} from f)
select query_id, collection_id, doc_id, round(score, 9) as score, rank from r where rank <= 10""",
    "last_update": f"select query_id, step, collection_id, doc_id, rank from ({_UPDATES}) u where step = (select max(step) from ({_UPDATES}) v where v.query_id = u.query_id)",
    "planner_selections": f"with {_CASES} select strategy, count(r) as selected from base left join (select strategy, r from pick where r = 1) using (strategy) group by 1",
    "policy_store": f"with {_SET}, x as (select *, row_number() over (partition by collection_id, doc_id order by n desc) as r from chg where error is null) select collection_id, doc_id, version, 1::bigint as n_rules from x where r = 1",
    "policy_refusals": f"with {_SET} select coalesce(error, 'none') as error, count(*) as n from chg group by 1",
    "token_claims": """with x as (select event_id, user_id, event_id % 8 as k, event_id % 100 - 60 as e from events),
y as (select *, case when k in (2, 3, 6, 7) then 'invalid token' when e <= -30 then 'token expired' when k in (4, 5) then 'invalid token' end as error from x)
select event_id, error, case when error is null then 'u' || user_id end as subject, case when error is null then 'a,b' else '' end as "groups", error is null and user_id % 2 = 0 as may_write from y""",
    "metric_rates": """with e as (select event_type, floor(epoch(ts) / 300)::bigint * 300 + 300 as til from events), w as (select til as "until", event_type, count(*) as n from e group by 1, 2),
i as (select til + 300 * k as "until", event_type, count(*) as increase from e cross join range(3) t(k) group by 1, 2)
select "until", event_type, increase, round(coalesce(n, 0) / 300.0::double, 6) as rate from i left join w using ("until", event_type)""",
    "graph_recall_floor": "select count(*) as queries, true as floor_met from embeddings where vec_id % 100 = 0",
    "election_holders": f"""{_TERMS}, t as (select (min(sec) + max(sec)) // 2 as now from c), l as (select f.*, row_number() over (partition by f.group_id order by f.i desc) as r from f join c using (group_id, i) cross join t where won and c.sec <= now)
select group_id, node_id as holder, term, ends > now as live from l cross join t where r = 1""",
    "binary_log": f"with {_LOG} select collection_id, seq, op, doc_id, case when op = 'upsert' then coalesce(body, '') end as body from log",
    "append_log": f"with {_LOG} select collection_id, seq, op, doc_id, body from log",
    "seed_documents": """with c as (select distinct source as collection_id from documents) select collection_id, 'distributed-search' as doc_id, 'Distributed search architecture' as title, 'The coordinator fans queries out to owning nodes, merges ranked results, and never stores source document content.' as body from c
union all select collection_id, 'recovery-runbook', 'Replica recovery runbook', 'A recovering replica replays committed log entries when history is retained and installs a snapshot after compaction.' from c
union all select collection_id, 'local-ownership', 'Local ownership boundary', 'Documents and indexes remain under the control of the node that owns the ' || collection_id || ' collection.' from c""",
}
