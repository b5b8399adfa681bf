"""Flows as token sequences, and a count-based token model.

Token ids follow a GPT-2 style layout: ids below ``BASE_VOCAB`` belong to the
base tokenizer (``EOS_ID`` = end of text, also the pad id); the flow tokens
(structural, 90 feature names, NEG, ZERO, 200 log bins, UNK) get ids from
``BASE_VOCAB`` on, dense in first-occurrence order (300 listed, 264 distinct);
each label of the corpus is one further token.

A flow's tokens stand without gaps: start tokens, three tokens (feature,
value, SEP) for each cell that the flow has, in (group, slot) order, then the
label section if it has a label, and the end token.  A flow that comes as
arrays is encoded within its row; cells are gathered first (at most 90 per
flow).  The label table (one row per label) is broadcast up to a checked size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rand import uniform
from ..functions.scalar import bin_label, dequantize, value_bin
from . import flowtable as FT

BASE_VOCAB = 50257
EOS_ID = 50256
N_CELLS = K.N_GROUPS * K.N_SLOTS
SAMPLE_END_ID = BASE_VOCAB + K.STRUCTURAL_TOKENS.index("<SAMPLE_END>")   # the structural tokens are listed first
LABEL_BROADCAST_ROWS = 100_000


def vocab(spark: SparkSession) -> DataFrame:
    """K1: (token_id, token, kind, grp, slot, bin_value) - 264 rows, built
    from the listing rule: structural, features, NEG, ZERO, bins, UNK."""
    n_struct, n_feat = len(K.STRUCTURAL_TOKENS), N_CELLS
    listed = spark.range(0, n_struct + n_feat + 2 + K.TOKEN_BINS + 1, 1, 1).withColumnRenamed("id", "pos")
    p = F.col("pos")
    fi = p - n_struct
    bi = p - (n_struct + n_feat + 2)
    struct_tok = F.element_at(F.array(*[F.lit(t) for t in K.STRUCTURAL_TOKENS]), (p + 1).cast("int"))
    token = (F.when(p < n_struct, struct_tok)
             .when(p < n_struct + n_feat, F.format_string("<PPI_%d_%d>", (fi / K.N_SLOTS).cast("int"),
                                                          (fi % K.N_SLOTS).cast("int")))
             .when(p == n_struct + n_feat, F.lit(K.NEG_TOKEN))
             .when(p == n_struct + n_feat + 1, F.lit(K.ZERO_TOKEN))
             .when(bi < K.TOKEN_BINS, F.concat(F.lit("<VAL_"), bin_label(bi).cast("string"), F.lit(">")))
             .otherwise(F.lit(K.UNK_TOKEN)))
    kind = (F.when(p < n_struct, "structural").when(p < n_struct + n_feat, "feature")
            .when(bi < 0, "special_value").when(bi < K.TOKEN_BINS, "value").otherwise("unknown"))
    t = listed.select("pos", token.alias("token"), kind.alias("kind"),
                      F.when(kind == "feature", (fi / K.N_SLOTS).cast("int")).alias("grp"),
                      F.when(kind == "feature", (fi % K.N_SLOTS).cast("int")).alias("slot"),
                      F.when(kind == "value", bin_label(bi).cast("double")).alias("bin_value"))
    first = t.groupBy("token").agg(F.min("pos").alias("pos"), F.first("kind").alias("kind"),
                                   F.first("grp").alias("grp"), F.first("slot").alias("slot"),
                                   F.first("bin_value").alias("bin_value"))
    w = Window.orderBy("pos")  # 264 rows
    return first.select((F.dense_rank().over(w) - 1 + BASE_VOCAB).cast("int").alias("token_id"),
                        "token", "kind", "grp", "slot", "bin_value")


def label_vocab(labels: DataFrame, first_id: int) -> DataFrame:
    """(app, token_id) for the distinct labels, ids in label order; no label is none."""
    d = labels.select("app").where(F.col("app").isNotNull()).distinct()
    return d.select("app", (F.dense_rank().over(Window.orderBy("app")) - 1 + first_id).cast("int").alias("token_id"))


def _maybe_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def token_ids(voc: DataFrame) -> dict[str, int]:
    """token -> id of the flow vocabulary, 264 fixed rows."""
    return {r["token"]: r["token_id"] for r in voc.select("token", "token_id").collect()}


def value_id(v: Column, ids: dict[str, int]) -> Column:
    """Id of a value's token, by the number of its bin; the same as looking up ``quantize``."""
    label = [math.floor(2.0 ** (b * 16 / K.TOKEN_BINS)) for b in range(K.TOKEN_BINS)]
    bins = F.array(*[F.lit(ids.get(f"<VAL_{x}>", ids[K.UNK_TOKEN])) for x in label])
    return (F.when(v < 0, F.lit(ids[K.NEG_TOKEN])).when(v == 0, F.lit(ids[K.ZERO_TOKEN]))
            .when(v >= K.TOKEN_MAX_VALUE, F.lit(ids.get(f"<VAL_{K.TOKEN_MAX_VALUE}>", ids[K.UNK_TOKEN])))
            .otherwise(F.element_at(bins, value_bin(v) + 1)))


def encode(cells: DataFrame, voc: DataFrame, labels: DataFrame | None = None,
           id_col: str = "flow_id") -> DataFrame:
    """K2: (id, pos, token_id) long form of the token sequences, 277 rows for a
    complete flow.  A cell that a flow lacks has no tokens (a NULL value has: it
    quantizes like any other), a NULL label no label section; a label missing from
    ``labels`` (app, token_id), the label vocabulary, has a NULL token id."""
    first_label = BASE_VOCAB + 264
    lv = labels if labels is not None else label_vocab(cells, first_label)
    lv_rows = lv.count()
    lv = _maybe_broadcast(lv.select("app", F.col("token_id").alias("label_id")), lv_rows, LABEL_BROADCAST_ROWS)
    ids = token_ids(voc)
    flows = (cells if FT.is_flow_table(cells) else FT.from_cells(cells, id_col)).join(lv, "app", "left")

    def fixed(*names: str):
        return F.array(*[F.lit(ids[n]) for n in names])

    first = ids["<PPI_0_0>"]  # the 90 feature tokens are listed consecutively
    cellwise = F.transform(FT.values(flows), lambda v, k: F.array((k + first).cast("int"), value_id(v, ids), F.lit(ids["<SEP>"])))
    body = F.flatten(FT.unless_absent(cellwise, lambda e: e[0] - first))
    label = F.concat(fixed("<APP_START>"), F.array("label_id"), fixed("<APP_END>"))
    toks = F.concat(fixed("<SAMPLE_START>", "<PPI_START>"), body, fixed("<PPI_END>"),
                    F.when(F.col("app").isNotNull(), label).otherwise(F.array().cast("array<int>")), fixed("<SAMPLE_END>"))
    return flows.select(id_col, F.posexplode(toks).alias("pos", "token_id"))


def pack(tokens: DataFrame, max_len: int = K.MAX_SEQ_LEN, id_col: str = "flow_id") -> DataFrame:
    """K3: fixed-length model input.  Sequences are cut to max_len - 1, EOS is
    appended, the rest is padded with EOS from each sequence's own length on;
    mask 1 on real tokens; labels = ids with -100 on padding.  Long form
    (id, pos, input_id, attention_mask, label), max_len rows per sequence."""
    body = tokens.where(F.col("pos") < max_len - 1).select(
        id_col, "pos", F.col("token_id").alias("input_id"), F.lit(1).alias("attention_mask"),
        F.col("token_id").alias("label"))
    # the last token of each sequence emits the EOS and the padding positions
    tail = (tokens.where(F.col("token_id") == SAMPLE_END_ID)
            .select(id_col, F.least(F.col("pos") + 1, F.lit(max_len - 1)).alias("_keep"))
            .select(id_col, "_keep", F.explode(F.sequence(F.col("_keep"), F.lit(max_len - 1))).alias("pos"))
            .select(id_col, "pos", F.lit(EOS_ID).alias("input_id"),
                    F.when(F.col("pos") == F.col("_keep"), 1).otherwise(0).alias("attention_mask"),
                    F.when(F.col("pos") == F.col("_keep"), F.lit(EOS_ID)).otherwise(F.lit(K.IGNORE_INDEX)).alias("label")))
    return body.unionByName(tail).select(id_col, F.col("pos").cast("int"), F.col("input_id").cast("int"),
                                         F.col("attention_mask").cast("int"), F.col("label").cast("int"))


def decode(tokens: DataFrame, voc: DataFrame, labels: DataFrame, id_col: str = "flow_id") -> DataFrame:
    """K4: token sequences -> cells.  A feature token followed by a value token
    gives one cell; the label is the token after APP_START.  Pairing and the
    label lookup are windows over one sequence (at most a few hundred rows)."""
    v = F.broadcast(voc.select("token_id", "token", "kind", "grp", "slot"))
    w = Window.partitionBy(id_col).orderBy("pos")
    t = (tokens.join(v, "token_id", "left")
         .withColumn("prev_kind", F.lag("kind").over(w))
         .withColumn("prev_grp", F.lag("grp").over(w))
         .withColumn("prev_slot", F.lag("slot").over(w))
         .withColumn("prev_token", F.lag("token").over(w)))
    t = t.withColumn("label_id", F.max(F.when(F.col("prev_token") == "<APP_START>", F.col("token_id")))
                     .over(Window.partitionBy(id_col)))
    lv = labels.select(F.col("token_id").alias("label_id"), "app")
    lv = F.broadcast(lv) if lv.count() <= LABEL_BROADCAST_ROWS else lv
    cellrows = (t.where((F.col("prev_kind") == "feature") & F.col("kind").isin("value", "special_value", "unknown"))
                .select(id_col, "label_id", F.col("prev_grp").alias("grp"), F.col("prev_slot").alias("slot"),
                        dequantize(F.col("token")).alias("v")))
    return cellrows.join(lv, "label_id", "left").select(id_col, "app", "grp", "slot", "v")


def token_frequency(tokens: DataFrame, voc: DataFrame, labels: DataFrame) -> DataFrame:
    """K5: (token_id, token, cnt): counts per token; labels by name."""
    counts = tokens.groupBy("token_id").agg(F.count(F.lit(1)).alias("cnt"))
    names = voc.select("token_id", "token").unionByName(labels.select("token_id", F.col("app").alias("token")))
    # as many rows as tokens: Spark chooses the join from its size
    return counts.join(names, "token_id", "left").select("token_id", "token", "cnt")


def sequence_lengths(tokens: DataFrame, max_len: int = K.MAX_SEQ_LEN, id_col: str = "flow_id") -> DataFrame:
    """K6: number of sequences, min / max / mean length and how many would be
    cut at ``max_len`` - 1 tokens (EOS takes the last place)."""
    lens = tokens.groupBy(id_col).agg(F.count(F.lit(1)).alias("len"))
    return lens.agg(F.count(F.lit(1)).cast("bigint").alias("sequences"),
                    F.min("len").cast("bigint").alias("min_len"), F.max("len").cast("bigint").alias("max_len"),
                    F.round(F.avg("len"), 6).alias("avg_len"),
                    F.count_if(F.col("len") > max_len - 1).cast("bigint").alias("truncated"))


def value_tokens(cells: DataFrame, voc: DataFrame) -> DataFrame:
    """cells + ``token_id`` of the value (UNK when the quantized label is
    outside the vocabulary)."""
    return cells.withColumn("token_id", value_id(F.col("v"), token_ids(voc)))


def token_model(cells: DataFrame, voc: DataFrame) -> DataFrame:
    """M1: P(value token | feature) = count / column count."""
    vt = value_tokens(cells, voc)
    c = vt.groupBy("grp", "slot", "token_id").agg(F.count(F.lit(1)).alias("cnt"))
    return c.select("grp", "slot", "token_id", F.col("cnt").cast("bigint"),
                    (F.col("cnt") / F.sum("cnt").over(Window.partitionBy("grp", "slot"))).alias("p"))


def sample_token_model(spark: SparkSession, model: DataFrame, voc: DataFrame, skeleton: DataFrame,
                       temperature: float = 0.8, top_k: int = 50, seed: int = K.DEFAULT_SEED) -> DataFrame:
    """M2: per generated cell, draw a value token from P(token | feature)^(1/T)
    restricted to the top-k tokens of the feature (ties at the k-th kept) and
    decode it.  ``skeleton`` = (sample_id, app) with labels already drawn."""
    keys = ["grp", "slot"]
    m = model.withColumn("w", F.pow(F.col("p"), 1.0 / temperature))
    rk = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("p")))
    m = m.withColumn("_rk", rk).where(F.col("_rk") <= top_k)
    run = Window.partitionBy(*keys).orderBy("token_id").rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(*keys)
    cdf = m.select(*keys, "token_id",
                   ((F.sum("w").over(run) - F.col("w")) / F.sum("w").over(tot)).alias("lo"),
                   F.when(F.col("token_id") == F.max("token_id").over(tot), F.lit(1.0))
                    .otherwise(F.sum("w").over(run) / F.sum("w").over(tot)).alias("hi"))
    cdf = cdf.join(F.broadcast(voc.select("token_id", "token")), "token_id")
    i = F.explode(F.sequence(F.lit(0), F.lit(N_CELLS - 1))).alias("i")
    cells = (skeleton.select("sample_id", "app", i)
             .select("sample_id", "app", (F.col("i") / K.N_SLOTS).cast("int").alias("grp"),
                     (F.col("i") % K.N_SLOTS).cast("int").alias("slot"))
             .withColumn("u", uniform(seed, F.col("sample_id"), F.col("grp"), F.col("slot"), "tok")))
    # at most 90 x 50 rows: a bounded broadcast; the range predicate picks one step
    g = F.broadcast(cdf.select(*[F.col(c).alias(f"m_{c}") for c in ("grp", "slot", "lo", "hi", "token")]))
    j = cells.join(g, (F.col("grp") == F.col("m_grp")) & (F.col("slot") == F.col("m_slot"))
                   & (F.col("u") >= F.col("m_lo")) & (F.col("u") < F.col("m_hi")), "left")
    return j.select("sample_id", "app", "grp", "slot", dequantize(F.coalesce(F.col("m_token"), F.lit(K.UNK_TOKEN))).alias("v"))
