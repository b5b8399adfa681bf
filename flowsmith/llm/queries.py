"""Registered queries of the training-data operators: each one applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bm25, chat, exact, hpyp, mixing, ordinal, periodic, phrases, pieces, pii, simhash, urls, wordpiece
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


@register("op1_quality_classifier")
def op1(spark, sf):
    """Grades of all documents by the ordinal model fitted on the rated ones."""
    docs = table(spark, sf, "documents")
    model = ordinal.train(docs, ordinal.graded(table(spark, sf, "labels")))
    return ordinal.grade_documents(docs, model).withColumn("accept", F.col("tail_2") >= model.cut)


@register("op2_simhash_near_dedup")
def op2(spark, sf):
    """Fingerprint and component of every document."""
    return simhash.simhash_groups(table(spark, sf, "documents"))


PLANTED_CHAT = "</s>[INST] ok [/INST]"


@register("op3_chat_formatting")
def op3(spark, sf):
    """Digests read back from all formatted conversations and conversation -1."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", PLANTED_CHAT), (-1, 1, "assistant", PLANTED_CHAT)],
                                "conv_id bigint, turn bigint, role string, text string")
    return chat.chat_digests(chat.format_chats(turns.unionByName(own)))


@register("op4_sentencepiece")
def op4(spark, sf):
    """Ids of every whole text, and the digest of the text decoded from them."""
    back = pieces.encode_documents(table(spark, sf, "documents"), decoded=True)
    return back.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids",
                       F.sha2("text", 256).alias("decoded_sha256"))


OP5_SQL = """
with s as (select source, count(*) as n, sqrt(count(*)::double) as weight from documents group by source),
r as (select source, weight / (select sum(weight) from s) * (select sum(n) from s)::double / n as rate from s),
k as (select source, rate, unnest(range(0, cast(ceil(rate + 12.0 * sqrt(rate) + 30.0) as bigint) + 1)) as k from r),
steps as (select source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by source order by k) as cdf from k),
u as (select *, ('0x' || substr(md5('mix-1|' || coalesce(cast(doc_id as varchar), 'null') || '|1'), 1, 12))::bigint / 281474976710656.0e0 as u
      from documents),
c as (select *, (select count(*) from steps t where t.source is not distinct from u.source and t.cdf <= u.u) as copies from u),
e as (select *, cast(unnest(range(1, copies + 1)) as integer) as copy from c)
select doc_id, text, lang, source, n_chars, copy,
       md5('mix-1-place|' || coalesce(cast(doc_id as varchar), 'null') || '|' || cast(copy as varchar)) as place from e
"""


@register("op5_source_mixing", OP5_SQL)
def op5(spark, sf):
    """The documents mixed to square-root source weights, in random order."""
    docs = table(spark, sf, "documents")
    return mixing.mix(docs, mixing.tempered_weights(docs)).select("_row.*", "copy", "place")


@register("op6_bm25_top_k")
def op6(spark, sf):
    """The ten best documents for every document whose id is divisible by 20."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bm25.top_k(docs, docs.filter("doc_id % 20 = 0"))


@register("op7_personal_data")
def op7(spark, sf):
    """Personal data of every whole text."""
    return pii.find_personal_data(table(spark, sf, "documents"))


@register("op8_pitman_yor_scores")
def op8(spark, sf):
    """Language-model scores of every whole text."""
    return hpyp.language_scores(table(spark, sf, "documents"))


@register("op9_token_counts")
def op9(spark, sf):
    """Greedy word-piece counts of every whole text."""
    return wordpiece.token_counts(table(spark, sf, "documents"))


OP10_SQL = """
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) as sha,
                  row_number() over () as rid from documents),
w as (select doc_id, sha, count(*) over (partition by sha) as group_size,
             first_value(doc_id) over (partition by sha order by n desc, doc_id nulls last, rid) as keep_id,
             row_number() over (partition by sha order by n desc, doc_id nulls last, rid) = 1 as kept from d)
select doc_id, keep_id, group_size, kept, sha as text_sha256 from w
"""


@register("op10_exact_dedup", OP10_SQL)
def op10(spark, sf):
    """Group and decision of every document."""
    return exact.exact_groups(table(spark, sf, "documents")).drop("bucket")


def _words(terms) -> str:
    return ", ".join(f"'{t}'" for t in terms)


OP11_SQL = f"""
with u as (select page_id, coalesce(url, '') as url,
                  translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path from pages),
t as (select *, regexp_split_to_array(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+') as words from u),
c as (select *, len([w for w in words if w in ({_words(urls.STRICT)})]) as n_strict,
             len(list_distinct([w for w in words if w in ({_words(urls.SOFT)})])) as n_soft,
             case when ('.' || host) like '%.example.net' and path like '/en/%' then 'example.net/en/'
                  when ('.' || host) like '%.example.com' and path like '/de/%' then 'example.com/de/'
                  when ('.' || host) like '%.org' and path like '/fr/%' then 'org/fr/'
                  when ('.' || host) like '%.net' and path like '/%' then 'net/' end as rule from t)
select page_id, host, path, rule, n_strict::bigint as n_strict, n_soft::bigint as n_soft,
       case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
            when n_strict >= 1 or n_soft >= {urls.SOFT_LIMIT} then 'block' else 'allow' end as verdict from c
"""


@register("op11_url_filter", OP11_SQL)
def op11(spark, sf):
    """Host, path, rule and verdict of every page's url."""
    return urls.judge_urls(table(spark, sf, "pages"))


OP12_SQL = """
with d as (select coalesce(lang, 'und') as lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, [x for x in regexp_split_to_array(piece, '[ \\x09]+') if x <> ''] as words from d),
s as (select lang, words, unnest(range(1, len(words) + 1)) as i from w),
g as (select lang, words[i:i + k - 1] as key, k from s, (values (1), (2), (3), (4), (5)) v(k) where i + k - 1 <= len(words)),
f as (select lang, key, k, count(*) as a from g group by lang, key, k),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
p as (select * from f where k >= 2 and a >= 100),
cuts as (select lang, key, k, a, unnest(range(1, k)) as cut from p),
scored as (select c.lang, c.key, c.k, c.a, c.cut, x.a as l, y.a as r, n.n,
                  (1000::hugeint * c.a * n.n) // (x.a::hugeint * y.a) as score
           from cuts c join n on n.lang = c.lang join f x on x.lang = c.lang and x.key = c.key[1:c.cut]
                join f y on y.lang = c.lang and y.key = c.key[c.cut + 1:c.k]),
best as (select * from scored qualify row_number() over (partition by lang, key order by score, cut) = 1),
inside as (select lang, key[i:i + m - 1] as key, max(a) as over_a
           from (select lang, key, a, k, m, unnest(range(1, k - m + 2)) as i
                 from (select lang, key, a, k, unnest(range(2, k)) as m from p)) group by 1, 2),
kept as (select b.*, array_to_string(b.key, ' ') as phrase from best b left join inside i on i.lang = b.lang and i.key = b.key
         where i.over_a is null or 100 * i.over_a < 100 * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked where rank <= 2000
"""


@register("op12_phrase_mining", OP12_SQL)
def op12(spark, sf):
    """The first 2000 phrases of each language of the documents."""
    return phrases.mine_phrases(table(spark, sf, "documents"))


@register("op13_periodic_runs")
def op13(spark, sf):
    """Periodic runs of words of every document, the contract's planted runs included."""
    return periodic.run_digests(periodic.collapse_runs(table(spark, sf, "documents"), edit=periodic.planted_words))
