"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import bpe, fingerprint, langid, media, mixing, neardup, quality, substring, toxicity, warc
from ravelin.llm.shared import materialize, remainder

MIX = {"fraction": 0.5, "epochs": 2, "seed": 7, "weights": {"lang": {"en": 2.0}, "source": {"src0": 4.0, "src1": 0.5}}}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs)).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), **MIX)


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_read(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures go to a table in the shared folder; what is described are the bytes read from there."""
    return media.describe(materialize(media.store(_read(spark, sf_dir, "documents")), "media"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return quality.score(docs, quality.learn(docs, labels))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_read(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return toxicity.detect(docs, toxicity.learn(docs, labels)).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_langid, op3_mix, op4_neardup, op5_media, op6_fingerprint, op7_quality, op8_warc, op9_toxicity, op10_substring)}


def _mix_sql() -> str:
    levels = list(mixing.LEVELS)

    def weight(level: str) -> str:
        named = MIX["weights"].get(level, {})
        return "case " + " ".join(f"when {level} = '{k}' then {float(v)}" for k, v in named.items()) + " else 1.0 end" if named else "1.0"

    steps = []
    for k in range(1, 4):
        keys, up = ", ".join(levels[:k]), ", ".join(levels[: k - 1])
        part = f"partition by {up}" if up else ""
        given = f"join share{k - 1} using ({up})" if up else "cross join (select floor(sum(tokens::double) * {f})::double as budget from leaves)".replace("{f}", str(MIX["fraction"]))
        steps.append(f"""
n{k} as (select x.*, budget from (select {keys}, sum(cap) as cap, ({weight(levels[k - 1])})::double as w from leaves group by {keys}) x {given}),
r{k} as (select *, cap / w as r from n{k} where w > 0 and cap > 0),
l{k} as (select *, (budget - (sum(cap) over a - cap)) / sum(w) over b as lev from r{k}
  window a as ({part} order by r, {levels[k - 1]} rows between unbounded preceding and current row), b as ({part} order by r, {levels[k - 1]} rows between current row and unbounded following)),
f{k} as (select *, first_value(case when lev <= r then lev end ignore nulls) over ({part} order by r, {levels[k - 1]} rows between unbounded preceding and unbounded following) as even from l{k}),
share{k} as (select {keys}, case when even is null then cap else least(cap, even * w) end as budget from f{k})""")
    keys = ", ".join(levels)
    return f"""
with meta as (select doc_id, domain, lang, source, n_tokens from (
  select doc_id, 'd' || (('0x' || substr(md5(coalesce(source, '(none)')), 1, 2))::int % 4)::varchar as domain, coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::bigint as n_tokens from documents) where n_tokens > 0),
leaves as (select {keys}, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * {MIX["epochs"]})::double as cap from meta group by {keys}),
{",".join(steps)},
plan as (select {keys}, floor(budget + 1e-6)::bigint // tokens as whole, floor(budget + 1e-6)::bigint % tokens as rest from leaves join share3 using ({keys})),
ordered as (select m.*, whole, rest, sum(n_tokens) over (partition by {keys} order by md5('{MIX["seed"]}|' || whole || '|' || doc_id), doc_id rows between unbounded preceding and current row) as upto from meta m join plan using ({keys})),
taken as (select *, greatest(0, least(n_tokens, rest - upto + n_tokens))::bigint as part from ordered)
select doc_id, {keys}, n_tokens, whole + (part = n_tokens)::bigint as copies, (whole * n_tokens + part)::bigint as tokens from taken where whole * n_tokens + part > 0"""


SQL = {
    "op3_mix": _mix_sql(),
    "op8_warc": """
with p as (select page_id, url, coalesce(html, '') as html from pages),
d as (select page_id, url, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when first_id is not null and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when first_id is not null and page_id <> first_id then first_id end as refers_to
  , record_bytes
from (select d.*, first_id, payload_bytes + 4 + strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: ' || case when first_id is not null and page_id <> first_id then 'revisit' else 'response' end)
  + strlen('WARC-Record-ID: <urn:page:>') + strlen(page_id::varchar) + case when first_id is not null and page_id <> first_id then strlen('WARC-Refers-To: <urn:page:>') + strlen(first_id::varchar) + 2 + strlen('WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest') + 2 else 0 end
  + strlen('WARC-Date: 2024-01-01T00:00:00Z') + coalesce(strlen('WARC-Target-URI: ' || url) + 2, 0) + strlen('WARC-Payload-Digest: sha256:') + 64 + strlen('Content-Type: text/html; charset=utf-8')
  + strlen('Content-Length: ') + case when first_id is not null and page_id <> first_id then 1 else strlen(payload_bytes::varchar) end + 14 as record_bytes
  from d left join f using (payload_digest))""",
    "op10_substring": """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13),
g as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as s from p),
m as (select s, min(doc_id) as d from g group by s),
gone as (select distinct g.doc_id, g.i + t.k as j from g join m using (s) cross join range(13) t(k) where m.d < g.doc_id),
every as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as j from w),
kept as (select doc_id, string_agg(x, ' ' order by j) as kept, count(*) as n from every anti join gone using (doc_id, j) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id)""",
}
