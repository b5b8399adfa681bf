"""Two-phase ranks equal the one-window ranks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowsmith.functions import rank as RK
from flowsmith.sources import adapters as A

from paths import SF_SMALL


def test_hot_key_path_equals_plain_window(spark, monkeypatch):
    base = A.cells(spark, SF_SMALL).orderBy("flow_id", "grp", "slot").toPandas()
    monkeypatch.setattr(RK, "HOT_ROWS", 5)   # every supplier is "hot": bucketed path
    hot = A.cells(spark, SF_SMALL).orderBy("flow_id", "grp", "slot").toPandas()
    assert base.equals(hot)


def test_ranked_within_matches_row_number(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("d", F.to_date("ts"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    want = ev.select("event_id", (F.row_number().over(w) - 1).alias("rn"),
                     F.lag("ts").over(w).alias("prev_ts")).toPandas().sort_values("event_id").reset_index(drop=True)
    got = RK.ranked_within(ev, ["user_id"], ["ts", "event_id"], F.unix_date("d"), carry_col="ts", hot_rows=1)
    got = got.select("event_id", "rn", "prev_ts").toPandas().sort_values("event_id").reset_index(drop=True)
    assert (got["rn"].values == want["rn"].values).all()
    assert got["prev_ts"].equals(want["prev_ts"])


def test_global_rank(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5003)
    got = RK.global_rank(df, F.floor(F.col("k") / 500), ["k", "id"]).toPandas().sort_values("k")
    assert list(got["rank"]) == list(range(1, 5001))


def test_running_mean_two_phase_equals_window(spark):
    from flowsmith.operators import metrics as M
    from flowsmith.sources import adapters as A
    b = A.batch_losses(spark, SF_SMALL)
    one = M.running_loss(b, bucket_size=10 ** 9).orderBy("run_id", "epoch", "batch").toPandas()
    many = M.running_loss(b, bucket_size=3).orderBy("run_id", "epoch", "batch").toPandas()
    assert one.equals(many)
