"""Flow tables derived from the driver tables.

The flow model (one flow = label + 30 packets x (gap, direction, size)) is
read off the TPC-H-like tables: each supplier's line items, in ship order, are
cut into flows of 30 packets; the region of the supplier is the label.  A
second shape comes from ``events`` (per user, in time order).

Spark side: DataFrame code.  The sequence number per supplier / user is a
two-phase rank (see ``functions.rank``) so a supplier with a third of all rows
is not sorted in one task, and padding of the last short flow of each supplier
is generated from the per-supplier totals instead of a join of every flow with
every slot.

Oracle side: ``SQL_VIEWS`` holds one SQL text per view (the FIXTURES.md text),
used as CTEs in front of every DuckDB oracle query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import N_SLOTS
from ..functions.joins import broadcast_if_small
from ..functions.rank import ranked_within
from ..operators import flowtable as FT
from .tables import read_table

# A flow id is key * 2^31 + flow number: the numbers of two keys meet only beyond 64 billion packets of one key.
FLOW_KEY_BASE = 1 << 31
FLOW_BLOCK = 1 << 16


def supplier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s_suppkey -> region name.  nation (25 rows) and region (5 rows) are
    fixed-size dimensions, so broadcasting them is bounded; the supplier side
    grows with the data and is left to Spark's size-checked join choice."""
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    nat_reg = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    supplier = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    return (supplier.join(F.broadcast(nat_reg), supplier.s_nationkey == nat_reg.n_nationkey)
            .select("s_suppkey", F.col("r_name").alias("app")))


def _packets_with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey",
                    "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_returnflag")
    labels = broadcast_if_small(supplier_labels(spark, sf_dir))
    p = (li.join(labels, li.l_suppkey == labels.s_suppkey)
         .withColumn("d", F.to_date("l_shipdate")))
    ranked = ranked_within(p, ["s_suppkey"],
                           ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
                           fine_bucket=F.unix_date("d"), carry_col="d")
    slot = (F.col("rn") % N_SLOTS).cast("int")
    size = (F.when(F.col("l_discount") == 0, F.lit(0.0))
            .when(F.col("l_quantity") <= 2, F.lit(15.0))
            .when(F.col("l_quantity") >= 49, F.lit(9500.0))
            .when(F.col("l_quantity") >= 46, F.lit(1800.0))
            .otherwise(F.floor(F.col("l_quantity") / 5) * 150 + 25).cast("double"))
    return ranked.select(
        (F.col("s_suppkey") * FLOW_KEY_BASE + F.floor(F.col("rn") / N_SLOTS)).cast("bigint").alias("flow_id"),
        "app",
        slot.alias("slot"),
        F.when(slot == 0, F.lit(0.0))
         .otherwise(F.coalesce(F.datediff("d", "prev_d"), F.lit(0)).cast("double")).alias("ipt"),
        F.when(F.col("l_returnflag") == "R", F.lit(-1.0)).otherwise(F.lit(1.0)).alias("dir"),
        size.alias("size"),
        "rn", "part_total", "s_suppkey", F.col("d").alias("day"),
    )


def _cells_from(packets_t: DataFrame) -> DataFrame:
    """Unpivot packets to cells in one narrow pass.  The last packet of each
    part (rank = part_total - 1) also emits the zero padding of its short flow,
    so no second pass over the packets and no flow x slot join is needed."""
    def cell(g, s, v):
        return F.struct(F.lit(g).alias("grp"), s.alias("slot"), v.alias("v"))

    slot = F.col("slot")
    own = F.array(cell(0, slot, F.col("ipt")), cell(1, slot, F.col("dir")), cell(2, slot, F.col("size")))
    zero = F.lit(0.0)
    pad = F.flatten(F.transform(F.sequence(slot + 1, F.lit(N_SLOTS - 1)),
                                lambda s: F.array(cell(0, s, zero), cell(1, s, zero), cell(2, s, zero))))
    is_last_short = (F.col("rn") == F.col("part_total") - 1) & (slot < N_SLOTS - 1)
    all_cells = F.when(is_last_short, F.concat(own, pad)).otherwise(own)
    return (packets_t.select("flow_id", "app", F.explode(all_cells).alias("c"))
            .select("flow_id", "app", F.col("c.grp").alias("grp"), F.col("c.slot").cast("int").alias("slot"),
                    F.coalesce(F.col("c.v"), F.lit(0.0)).alias("v")))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packets(flow_id, app, slot, ipt, dir, size)."""
    return _packets_with_totals(spark, sf_dir).drop("rn", "part_total", "s_suppkey", "day")


def packet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app, day, grp, v): the packets' own values, without padding, by the day of the packet."""
    p = _packets_with_totals(spark, sf_dir)
    entries = F.array(*[F.struct(F.lit(g).alias("grp"), F.col(n).alias("v")) for g, n in enumerate(FT.GROUPS)])
    return p.select("app", "day", F.explode(entries).alias("c")).select("app", "day", "c.grp", "c.v")


def _flow_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, app, n_flows): how many flows a supplier's line items make.  Counts are enough, nothing is ranked."""
    per = read_table(spark, sf_dir, "lineitem", "l_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("_n"))
    labels = supplier_labels(spark, sf_dir)
    return (per.join(labels, per.l_suppkey == labels.s_suppkey)
            .select("s_suppkey", "app", F.ceil(F.col("_n") / N_SLOTS).cast("bigint").alias("n_flows")))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app, cnt): flows per label, the same as counting the labels of ``cells``."""
    return _flow_totals(spark, sf_dir).groupBy("app").agg(F.sum("n_flows").alias("cnt"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flow_id, app): one row per flow of ``cells``.  The flow numbers of a supplier are laid out in blocks of
    ``FLOW_BLOCK`` that are spread over the tasks, so a supplier with most flows is no single task."""
    last = F.col("n_flows") - 1
    blocks = (_flow_totals(spark, sf_dir)
              .select("s_suppkey", "app", "n_flows", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(FLOW_BLOCK).cast("bigint"))).alias("_from"))
              .repartition("s_suppkey", "_from"))
    number = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + FLOW_BLOCK - 1, last)))
    return (blocks.select("s_suppkey", "app", number.alias("_k"))
            .select((F.col("s_suppkey") * FLOW_KEY_BASE + F.col("_k")).cast("bigint").alias("flow_id"), "app"))


def flow_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flows(flow_id, app, ipt[], dir[], size[], absent[]) straight from the packets: a flow's packets lie together after the
    ranking by supplier, so they are gathered without another shuffle (30 at most); short flows are padded with zeros."""
    return _arrays_from(_packets_with_totals(spark, sf_dir), "s_suppkey")


def flow_arrays_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the second data shape."""
    return _arrays_from(_events_packets_with_totals(spark, sf_dir), "user_id")


def _arrays_from(packets_t: DataFrame, key: str) -> DataFrame:
    entry = F.struct("slot", "ipt", "dir", "size")
    flows = packets_t.groupBy(key, "flow_id", "app").agg(F.array_sort(F.collect_list(entry)).alias("_p"))
    zeros = F.array_repeat(F.lit(0.0), N_SLOTS - F.size("_p"))
    groups = [F.concat(F.transform(F.col("_p")[n], lambda v: F.coalesce(v, F.lit(0.0))), zeros).alias(n) for n in FT.GROUPS]
    return flows.select("flow_id", "app", *groups, F.array().cast("array<int>").alias("absent"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells(flow_id, app, grp, slot, v): 90 cells per flow, zero-padded."""
    return _cells_from(_packets_with_totals(spark, sf_dir))


def _planted(g: Column, k: Column, v: Column) -> Column:
    """The value with rule violations and NULLs planted at fixed positions (k = id + slot)."""
    return (F.when(k % 101 == 0, F.lit(None).cast("double"))
            .when((g == 0) & (k % 97 == 0), -v - 1)
            .when((g == 0) & (k % 89 == 0), v * 1000 + 20000)
            .when((g == 1) & (k % 53 == 0), F.lit(0.4))
            .when((g == 1) & (k % 59 == 0), F.lit(-0.97))
            .when((g == 1) & (k % 61 == 0), F.lit(1.5))
            .when((g == 2) & (k % 71 == 0), -v)
            .when((g == 2) & (k % 73 == 0), F.lit(12.5))
            .when((g == 2) & (k % 79 == 0), F.lit(30000.0))
            .otherwise(v))


def perturb(c: DataFrame, id_col: str = "flow_id") -> DataFrame:
    """Plants rule violations and NULLs; takes cells or flows."""
    if FT.is_flow_table(c):
        return FT.map_values(c, lambda g, slot, v: _planted(F.lit(g), F.col(id_col) + slot, v))
    return c.select(id_col, "app", "grp", "slot", _planted(F.col("grp"), F.col(id_col) + F.col("slot"), F.col("v")).alias("v"))


def cells_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells with rule violations and NULLs planted at fixed positions."""
    return perturb(cells(spark, sf_dir))


def cells_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated-looking copy of every flow for duplicate checks."""
    return candidate_of(cells(spark, sf_dir))


def candidate_of(c: DataFrame) -> DataFrame:
    """Flows with id % 10 = 1 differ by 1e-7 (equal after rounding to 6
    places), id % 10 = 2 differ by 1.0 in their first gap (near misses), the
    rest are exact copies.  Takes cells or flows."""
    m = F.col("flow_id") % 10

    def near(slot, v):
        return F.when(m == 1, v + 0.0000001).when((m == 2) & (slot == 0), v + 1.0).otherwise(v)

    if FT.is_flow_table(c):
        return FT.map_values(c, lambda g, slot, v: near(slot, v)).withColumn("flow_id", -F.col("flow_id") - 1)
    return c.select((-F.col("flow_id") - 1).alias("flow_id"), "app", "grp", "slot", near(F.col("slot"), F.col("v")).alias("v"))


def _events_packets_with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    cust = broadcast_if_small(read_table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"))
    p = (ev.join(cust, ev.user_id == cust.c_custkey, "left")
         .withColumn("app", F.coalesce("c_mktsegment", F.lit("Unknown")))
         .withColumn("mi", (F.dayofmonth("ts") * 1440 + F.hour("ts") * 60 + F.minute("ts")).cast("int"))
         .withColumn("d", F.to_date("ts")))
    ranked = ranked_within(p, ["user_id"], ["ts", "event_id"], fine_bucket=F.unix_date("d"), carry_col="mi")
    slot = (F.col("rn") % N_SLOTS).cast("int")
    return ranked.select(
        (F.col("user_id") * FLOW_KEY_BASE + F.floor(F.col("rn") / N_SLOTS)).cast("bigint").alias("flow_id"),
        "app", slot.alias("slot"),
        F.when(slot == 0, F.lit(0.0))
         .otherwise(F.coalesce(F.col("mi") - F.col("prev_mi"), F.lit(0)).cast("double")).alias("ipt"),
        F.when(F.col("event_type").isin("view", "error"), F.lit(-1.0)).otherwise(F.lit(1.0)).alias("dir"),
        F.floor(F.col("value") * 10).cast("double").alias("size"),
        "rn", "part_total", "user_id",
    )


def packets_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_packets_with_totals(spark, sf_dir).drop("rn", "part_total", "user_id")


def cells_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells_from(_events_packets_with_totals(spark, sf_dir))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_metrics(run_id, epoch, train_loss, val_loss, secs)."""
    ev = read_table(spark, sf_dir, "events", "event_type", "ts", "user_id", "value")
    day = F.dayofmonth("ts").cast("bigint")
    return (ev.groupBy(F.col("event_type").alias("run_id"), day.alias("epoch"))
            .agg(F.round(F.avg(F.when(F.col("user_id") % 2 == 0, F.col("value"))), 6).alias("train_loss"),
                 F.round(F.avg(F.when(F.col("user_id") % 2 == 1, F.col("value"))), 6).alias("_val"),
                 F.count(F.lit(1)).cast("double").alias("secs"))
            .select("run_id", "epoch", "train_loss",
                    F.when(F.col("epoch") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("_val")).alias("val_loss"),
                    "secs"))


def batch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_losses(run_id, epoch, batch, loss): one row per event."""
    ev = read_table(spark, sf_dir, "events", "event_id", "event_type", "ts", "value")
    ev = (ev.withColumn("epoch", F.dayofmonth("ts").cast("bigint"))
          .withColumn("_minute", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000)))
    ranked = ranked_within(ev, ["event_type", "epoch"], ["ts", "event_id"], fine_bucket=F.col("_minute"))
    return ranked.select(F.col("event_type").alias("run_id"), "epoch",
                         (F.col("rn") + 1).cast("bigint").alias("batch"), F.col("value").alias("loss"))


# ---------------------------------------------------------------------------
# Oracle texts (DuckDB); identical to FIXTURES.md.
# ---------------------------------------------------------------------------

SQL_VIEWS: dict[str, str] = {
    "packets": """
select flow_id, app, slot,
       cast(coalesce(cast(d - lag(d) over (partition by flow_id order by slot) as int), 0) as double) as ipt,
       case when l_returnflag = 'R' then -1.0e0 else 1.0e0 end as dir,
       cast(case when l_discount = 0 then 0 when l_quantity <= 2 then 15 when l_quantity >= 49 then 9500
                 when l_quantity >= 46 then 1800 else floor(l_quantity / 5) * 150 + 25 end as double) as size
from (select cast(s_suppkey * 2147483648 + floor(rn / 30) as bigint) as flow_id, app, cast(rn % 30 as int) as slot,
             cast(l_shipdate as date) as d, l_quantity, l_discount, l_returnflag
      from (select s.s_suppkey, r.r_name as app, l.l_shipdate, l.l_quantity, l.l_discount, l.l_returnflag,
                   row_number() over (partition by l.l_suppkey
                     order by l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice) - 1 as rn
            from lineitem l join supplier s on l.l_suppkey = s.s_suppkey
                 join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey) p) q
""",
    "cells": """
select f.flow_id, f.app, g.grp, s.slot,
       coalesce(case g.grp when 0 then p.ipt when 1 then p.dir else p.size end, 0.0e0) as v
from (select distinct flow_id, app from packets) f
cross join (select distinct slot from packets) s
cross join (select 0 as grp union all select 1 union all select 2) g
left join packets p on p.flow_id = f.flow_id and p.slot = s.slot
""",
    "cells_dirty": """
select flow_id, app, grp, slot,
  case when (flow_id + slot) % 101 = 0 then null
       when grp = 0 and (flow_id + slot) % 97 = 0 then -v - 1
       when grp = 0 and (flow_id + slot) % 89 = 0 then v * 1000 + 20000
       when grp = 1 and (flow_id + slot) % 53 = 0 then 0.4e0
       when grp = 1 and (flow_id + slot) % 59 = 0 then -0.97e0
       when grp = 1 and (flow_id + slot) % 61 = 0 then 1.5e0
       when grp = 2 and (flow_id + slot) % 71 = 0 then -v
       when grp = 2 and (flow_id + slot) % 73 = 0 then 12.5e0
       when grp = 2 and (flow_id + slot) % 79 = 0 then 30000.0e0
       else v end as v
from cells
""",
    "cells_candidate": """
select -flow_id - 1 as flow_id, app, grp, slot,
  case when flow_id % 10 = 1 then v + 0.0000001e0
       when flow_id % 10 = 2 and slot = 0 then v + 1.0e0 else v end as v
from cells
""",
    "packets_events": """
select flow_id, app, slot,
       cast(coalesce(mi - lag(mi) over (partition by flow_id order by slot), 0) as double) as ipt,
       case when event_type in ('view', 'error') then -1.0e0 else 1.0e0 end as dir,
       cast(floor(value * 10) as double) as size
from (select cast(user_id * 2147483648 + floor(rn / 30) as bigint) as flow_id, app, cast(rn % 30 as int) as slot,
             mi, event_type, value
      from (select e.user_id, day(e.ts) * 1440 + hour(e.ts) * 60 + minute(e.ts) as mi, e.event_type, e.value,
                   coalesce(c.c_mktsegment, 'Unknown') as app,
                   row_number() over (partition by e.user_id order by e.ts, e.event_id) - 1 as rn
            from events e left join customer c on c.c_custkey = e.user_id) p) q
""",
    "cells_events": """
select f.flow_id, f.app, g.grp, s.slot,
       coalesce(case g.grp when 0 then p.ipt when 1 then p.dir else p.size end, 0.0e0) as v
from (select distinct flow_id, app from packets_events) f
cross join (select distinct slot from packets_events) s
cross join (select 0 as grp union all select 1 union all select 2) g
left join packets_events p on p.flow_id = f.flow_id and p.slot = s.slot
""",
    "run_metrics": """
select event_type as run_id, day(ts) as epoch,
       round(avg(case when user_id % 2 = 0 then value end), 6) as train_loss,
       case when day(ts) % 3 = 0 then null else round(avg(case when user_id % 2 = 1 then value end), 6) end as val_loss,
       cast(count(*) as double) as secs
from events group by event_type, day(ts)
""",
    "batch_losses": """
select event_type as run_id, day(ts) as epoch,
       row_number() over (partition by event_type, day(ts) order by ts, event_id) as batch,
       value as loss
from events
""",
}

VIEW_DEPS: dict[str, list[str]] = {
    "packets": [], "cells": ["packets"], "cells_dirty": ["packets", "cells"],
    "cells_candidate": ["packets", "cells"], "packets_events": [],
    "cells_events": ["packets_events"], "run_metrics": [], "batch_losses": [],
}


def with_views(sql: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs of ``views`` (and their dependencies).
    ``extra`` adds query-specific CTEs after the views, in the given order."""
    order: list[str] = []
    for v in views:
        for dep in VIEW_DEPS[v] + [v]:
            if dep not in order:
                order.append(dep)
    # materialized: views that several others read are computed once
    ctes = [f"{name} as materialized ({SQL_VIEWS[name].strip()})" for name in order]
    for name, text in (extra or {}).items():
        ctes.append(f"{name} as materialized ({text.strip()})")
    text = sql if not ctes else "with " + ",\n".join(ctes) + "\n" + sql
    return _bigint_counts(text)


def _bigint_counts(text: str) -> str:
    """DuckDB types count_if as HUGEINT; Spark counts are BIGINT.  Wrap every
    count_if(...) of an oracle text in a cast so both sides have one type."""
    out, i, key = [], 0, "count_if("
    while True:
        j = text.find(key, i)
        if j < 0:
            out.append(text[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        out.append(text[i:j] + "cast(" + text[j:k] + " as bigint)")
        i = k
