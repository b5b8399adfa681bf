"""Token codec round trip and the repair policy."""

from pyspark.sql import functions as F

from flowsmith.functions.scalar import dequantize, quantize
from flowsmith.operators import tokens as T
from flowsmith.sources import adapters as A

from paths import SF_SMALL


def test_vocab_shape(spark):
    voc = T.vocab(spark)
    assert voc.count() == 264
    ids = sorted(r["token_id"] for r in voc.collect())
    assert ids == list(range(T.BASE_VOCAB, T.BASE_VOCAB + 264))
    assert voc.where("kind = 'value'").count() == 164


def test_decode_encode_is_quantize(spark):
    voc = T.vocab(spark)
    cells = A.cells(spark, SF_SMALL)
    labels = T.label_vocab(cells, T.BASE_VOCAB + 264)
    toks = T.encode(cells, voc, labels)
    assert toks.groupBy("flow_id").count().where("count <> 277").count() == 0
    dec = T.decode(toks, voc, labels)
    want = cells.select("flow_id", "app", "grp", "slot",
                        F.when(F.col("v") >= 65536, 0.0).otherwise(dequantize(quantize(F.col("v")))).alias("v"))
    assert dec.exceptAll(want).count() == 0 and want.exceptAll(dec).count() == 0


def test_pack_lengths(spark):
    voc = T.vocab(spark)
    toks = T.encode(A.cells(spark, SF_SMALL), voc)
    packed = T.pack(toks, max_len=100)
    per = packed.groupBy("flow_id").agg(F.count(F.lit(1)).alias("n"), F.sum("attention_mask").alias("m"))
    assert per.where("n <> 100 or m <> 100").count() == 0
    assert packed.where("pos = 99 and input_id <> 50256").count() == 0


def test_incomplete_flows_are_dense(spark):
    """Flow 1 lacks most cells, cell (0, 0) too; flow 2 has no label; flow 3 is one NULL value."""
    voc = T.vocab(spark)
    ids = {r["token"]: r["token_id"] for r in voc.collect()}
    cells = spark.createDataFrame(
        [(1, "a", 2, 29, 0.0), (1, "a", 0, 3, -4.0), (2, None, 0, 0, 0.0), (3, "b", 1, 1, None)],
        "flow_id bigint, app string, grp int, slot int, v double")
    got = {}
    for r in T.encode(cells, voc).orderBy("flow_id", "pos").collect():
        got.setdefault(r["flow_id"], []).append((r["pos"], r["token_id"]))
    first = T.BASE_VOCAB + 264

    def want(values, label):
        out = ["<SAMPLE_START>", "<PPI_START>"]
        for feature, value in values:
            out += [feature, value, "<SEP>"]
        out.append("<PPI_END>")
        if label is not None:
            out += ["<APP_START>", label, "<APP_END>"]
        return [(i, ids.get(t, t)) for i, t in enumerate([*out, "<SAMPLE_END>"])]

    assert got[1] == want([("<PPI_0_3>", "<VAL_NEG>"), ("<PPI_2_29>", "<VAL_ZERO>")], first)
    assert got[2] == want([("<PPI_0_0>", "<VAL_ZERO>")], None)
    assert got[3] == want([("<PPI_1_1>", "<VAL_1>")], first + 1)
    packed = T.pack(T.encode(cells, voc), max_len=12).orderBy("flow_id", "pos").collect()
    masks = {f: [r["attention_mask"] for r in packed if r["flow_id"] == f] for f in (1, 2, 3)}
    # flow 1 is cut to 11 tokens and EOS, flow 2 has 7 tokens and EOS, flow 3 has 10
    assert masks == {1: [1] * 12, 2: [1] * 8 + [0] * 4, 3: [1] * 11 + [0]}
    assert [r["input_id"] for r in packed if r["flow_id"] == 2][7:] == [T.EOS_ID] * 5
    assert [r["label"] for r in packed if r["flow_id"] == 2][7:] == [T.EOS_ID] + [-100] * 4
