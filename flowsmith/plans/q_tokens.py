"""Value codec and token corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rand import sql_uniform
from ..functions.scalar import dequantize, quantize, value_band
from ..operators import synth as S
from ..operators import tokens as T
from ..session import materialize
from ..sources import adapters as A
from .catalog import register
from .q_synth import apportion_ctes

STRUCT_LIST = "[" + ", ".join(f"'{t}'" for t in K.STRUCTURAL_TOKENS) + "]"


def quant_sql(v: str) -> str:
    b = f"least(199, greatest(0, floor(log2(greatest(1.0e0, {v})) * 200 / 16)))"
    return (f"case when {v} < 0 then '<VAL_NEG>' when {v} = 0 then '<VAL_ZERO>' "
            f"when {v} >= 65536 then '<VAL_65536>' "
            f"else '<VAL_' || cast(cast(floor(pow(2.0e0, {b} * 16 / 200.0e0)) as bigint) as varchar) || '>' end")


def dequant_sql(t: str) -> str:
    return (f"case when {t} = '<VAL_ZERO>' then 0.0e0 when {t} = '<VAL_NEG>' then -1.0e0 "
            f"when {t} = '<UNK_VAL>' then 0.0e0 "
            f"when regexp_matches({t}, '^<VAL_[0-9]+>$') then cast(regexp_extract({t}, '^<VAL_([0-9]+)>$', 1) as double) "
            f"else 0.0e0 end")


VOCAB_CTES = {
    "voc0": f"""select pos, case when pos < 7 then {STRUCT_LIST}[pos + 1]
                 when pos < 97 then '<PPI_' || cast((pos - 7) // 30 as varchar) || '_' || cast((pos - 7) % 30 as varchar) || '>'
                 when pos = 97 then '<VAL_NEG>' when pos = 98 then '<VAL_ZERO>'
                 when pos < 299 then '<VAL_' || cast(cast(floor(pow(2.0e0, (pos - 99) * 16 / 200.0e0)) as bigint) as varchar) || '>'
                 else '<UNK_VAL>' end as token
               from (select range as pos from range(0, 300)) r""",
    "voc": """select token, cast(dense_rank() over (order by min(pos)) - 1 + 50257 as integer) as token_id
              from voc0 group by token""",
}


def corpus_ctes(src: str = "cells", id_col: str = "flow_id") -> dict[str, str]:
    tid = "(select token_id from voc where token = '{}')"
    ctes = dict(VOCAB_CTES)
    ctes.update({
        "lv": f"""select app, cast(dense_rank() over (order by app) - 1 + 50521 as integer) as token_id
                  from (select distinct app from {src}) t""",
        "ct": f"""select c.{id_col} as id, c.app, c.grp, c.slot,
                         coalesce(voc.token_id, {tid.format('<UNK_VAL>')}) as value_id
                  from {src} c left join voc on voc.token = {quant_sql('c.v')}""",
        "tok": f"""select id as {id_col}, cast(pos as integer) as pos, cast(token_id as integer) as token_id from (
            select id, 2 + 3 * (grp * 30 + slot) as pos, {tid.format('<PPI_0_0>')} + grp * 30 + slot as token_id from ct
            union all select id, 3 + 3 * (grp * 30 + slot), value_id from ct
            union all select id, 4 + 3 * (grp * 30 + slot), {tid.format('<SEP>')} from ct
            union all select id, 0, {tid.format('<SAMPLE_START>')} from ct where grp = 0 and slot = 0
            union all select id, 1, {tid.format('<PPI_START>')} from ct where grp = 0 and slot = 0
            union all select id, 272, {tid.format('<PPI_END>')} from ct where grp = 0 and slot = 0
            union all select id, 273, {tid.format('<APP_START>')} from ct where grp = 0 and slot = 0
            union all select ct.id, 274, lv.token_id from ct join lv on ct.app = lv.app where grp = 0 and slot = 0
            union all select id, 275, {tid.format('<APP_END>')} from ct where grp = 0 and slot = 0
            union all select id, 276, {tid.format('<SAMPLE_END>')} from ct where grp = 0 and slot = 0) t""",
    })
    return ctes


def _voc(spark):
    return T.vocab(spark)


def _corpus(spark, sf):
    """Vocabulary, label ids and token sequences; labels come from flow counts, so the flows are read once."""
    voc = _voc(spark)
    labels = materialize(T.label_vocab(A.label_counts(spark, sf), T.BASE_VOCAB + 264))
    return voc, labels, T.encode(A.flow_arrays(spark, sf), voc, labels)


@register("value_bands", A.with_views("""
select grp, band, count(*) as n_cells from (
  select grp, case when v is null then 'null'
    when grp = 0 then case when v < 0 then 'negative' when v >= 0.001e0 and v <= 100.0e0 then 'realistic'
                           when (v >= 0.0001e0 and v <= 0.001e0) or (v > 100.0e0 and v <= 1000.0e0) then 'extended'
                           when v > 10000.0e0 then 'unrealistic' else 'other' end
    when grp = 1 then case when abs(v + 1.0e0) < 0.001e0 or abs(v - 1.0e0) < 0.001e0 or abs(v) < 0.001e0 then 'exact'
                           when abs(v + 1.0e0) < 0.1e0 or abs(v - 1.0e0) < 0.1e0 or abs(v) < 0.1e0 then 'near'
                           else 'non_binary' end
    else case when v < 0 then 'negative' when v = 0 then 'zero' when v >= 20 and v <= 1500 then 'ethernet'
              when v > 1500 and v <= 9000 then 'jumbo' when v >= 1 and v < 20 then 'tiny' when v > 9000 then 'huge'
              else 'other' end end as band
  from cells_dirty) t
group by grp, band""", "cells_dirty"))
def value_bands(spark, sf):
    c = A.cells_dirty(spark, sf)
    return c.groupBy("grp", value_band(F.col("grp"), F.col("v")).alias("band")).agg(
        F.count(F.lit(1)).alias("n_cells"))


@register("quantize_values", A.with_views(
    f"select distinct v, {quant_sql('v')} as token from cells_dirty", "cells_dirty"))
def quantize_values(spark, sf):
    return A.cells_dirty(spark, sf).select("v").distinct().select("v", quantize(F.col("v")).alias("token"))


@register("dequantize_values", A.with_views(
    f"select token, {dequant_sql('token')} as value from (select distinct {quant_sql('v')} as token from cells_dirty) t",
    "cells_dirty"))
def dequantize_values(spark, sf):
    toks = A.cells_dirty(spark, sf).select(quantize(F.col("v")).alias("token")).distinct()
    return toks.select("token", dequantize(F.col("token")).alias("value"))


@register("quantization_error", A.with_views(f"""
select grp, count(*) as n_cells, round(avg(abs(v - dq)), 6) as mean_abs_error, max(abs(v - dq)) as max_abs_error,
       count_if(v >= 65536) as unknown_tokens
from (select grp, v, {dequant_sql(f"case when v >= 65536 then '<UNK_VAL>' else {quant_sql('v')} end")} as dq
      from cells_dirty where v is not null) t
group by grp""", "cells_dirty"))
def quantization_error(spark, sf):
    c = A.cells_dirty(spark, sf).where(F.col("v").isNotNull())
    tok = F.when(F.col("v") >= K.TOKEN_MAX_VALUE, F.lit(K.UNK_TOKEN)).otherwise(quantize(F.col("v")))
    err = F.abs(F.col("v") - dequantize(tok))
    return c.groupBy("grp").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.avg(err), 6).alias("mean_abs_error"),
                                F.max(err).alias("max_abs_error"),
                                F.count_if(F.col("v") >= K.TOKEN_MAX_VALUE).alias("unknown_tokens"))


@register("encode_flows", A.with_views("select * from tok", "cells", extra=corpus_ctes()))
def encode_flows(spark, sf):
    return _corpus(spark, sf)[2]


@register("pack_sequences", A.with_views("""
select flow_id, pos, token_id as input_id, 1 as attention_mask, token_id as label from tok where pos < 277
union all
select flow_id, cast(p.range as integer) as pos, 50256 as input_id,
       case when p.range = 277 then 1 else 0 end as attention_mask,
       case when p.range = 277 then 50256 else -100 end as label
from (select flow_id from tok where pos = 0) s, range(277, 512) p""", "cells", extra=corpus_ctes()))
def pack_sequences(spark, sf):
    return T.pack(_corpus(spark, sf)[2])


@register("decode_flows", A.with_views(f"""
select ct.id as flow_id, ct.app, ct.grp, ct.slot, {dequant_sql('voc.token')} as v
from ct join voc on voc.token_id = ct.value_id""", "cells", extra=corpus_ctes()))
def decode_flows(spark, sf):
    voc, labels, toks = _corpus(spark, sf)
    return T.decode(toks, voc, labels)


@register("token_frequency", A.with_views("""
select t.token_id, coalesce(voc.token, lv.app) as token, count(*) as cnt
from tok t left join voc on voc.token_id = t.token_id left join lv on lv.token_id = t.token_id
group by t.token_id, coalesce(voc.token, lv.app)""", "cells", extra=corpus_ctes()))
def token_frequency(spark, sf):
    voc, labels, toks = _corpus(spark, sf)
    return T.token_frequency(toks, voc, labels)


@register("sequence_lengths", A.with_views("""
select count(*) as sequences, min(len) as min_len, max(len) as max_len, round(avg(len), 6) as avg_len,
       count_if(len > 511) as truncated
from (select flow_id, count(*) as len from tok group by flow_id) t""", "cells", extra=corpus_ctes()))
def sequence_lengths(spark, sf):
    return T.sequence_lengths(_corpus(spark, sf)[2])


MODEL_CTES = {
    "tm": """select grp, slot, value_id as token_id, count(*) as cnt,
                    count(*) / sum(count(*)) over (partition by grp, slot) as p
             from ct group by grp, slot, value_id""",
}


@register("token_model", A.with_views("select * from tm", "cells", extra={**corpus_ctes(), **MODEL_CTES}))
def token_model(spark, sf):
    return T.token_model(A.cells(spark, sf), _voc(spark))


def sample_model_ctes(n: int = K.N_SAMPLES, seed: int = K.DEFAULT_SEED) -> dict[str, str]:
    u = sql_uniform(seed, "sample_id", "grp", "slot", "'tok'")
    return {
        **corpus_ctes(), **MODEL_CTES, **apportion_ctes(n, True),
        "mk": """select grp, slot, token_id, pow(p, 1.0e0 / 0.8e0) as w,
                        rank() over (partition by grp, slot order by p desc) as rk from tm""",
        "mc": """select grp, slot, token_id,
                   (sum(w) over (partition by grp, slot order by token_id rows between unbounded preceding and current row) - w)
                     / sum(w) over (partition by grp, slot) as lo,
                   case when token_id = max(token_id) over (partition by grp, slot) then 1.0e0
                        else sum(w) over (partition by grp, slot order by token_id rows between unbounded preceding and current row)
                             / sum(w) over (partition by grp, slot) end as hi
                 from mk where rk <= 50""",
        "sk": "select r.range as sample_id, ap.app from range(0, " + str(n) + ") r join ap "
              "on r.range >= ap.start and r.range < ap.start + ap.n_samples",
        "su": f"""select sample_id, app, cast(k // 30 as integer) as grp, cast(k % 30 as integer) as slot
                  from (select sample_id, app, unnest(range(0, 90)) as k from sk) t""",
        "sd": f"select *, {u} as u from su",
    }


@register("sample_token_model", A.with_views(f"""
select sd.sample_id, sd.app, sd.grp, sd.slot, {dequant_sql("coalesce(voc.token, '<UNK_VAL>')")} as v
from sd left join mc on sd.grp = mc.grp and sd.slot = mc.slot and sd.u >= mc.lo and sd.u < mc.hi
left join voc on voc.token_id = mc.token_id""", "cells", extra=sample_model_ctes()))
def sample_token_model(spark, sf):
    voc = _voc(spark)
    model = T.token_model(A.cells(spark, sf), voc)
    plan = S.apportion(A.label_counts(spark, sf), K.N_SAMPLES, True)
    skeleton = S.sample_skeleton(spark, plan, K.N_SAMPLES)
    return T.sample_token_model(spark, model, voc, skeleton)


@register("vocab_coverage", A.with_views("""
select voc.token_id, voc.token, coalesce(c.cnt, 0) as cnt
from voc left join (select token_id, count(*) as cnt from tok group by token_id) c on c.token_id = voc.token_id""",
                                         "cells", extra=corpus_ctes()))
def vocab_coverage(spark, sf):
    """K1: the 264-token flow vocabulary with how often each token occurs in
    the encoded corpus (0 = never used)."""
    voc, _, toks = _corpus(spark, sf)
    counts = toks.groupBy("token_id").agg(F.count(F.lit(1)).alias("cnt"))
    return (voc.join(counts, "token_id", "left")
            .select("token_id", "token", F.coalesce(F.col("cnt"), F.lit(0)).cast("bigint").alias("cnt")))
