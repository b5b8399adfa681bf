"""Flows as arrays: flows(id, app, ipt[30], dir[30], size[30], absent[]).

One row holds a whole flow, so whatever reads a flow as a whole (token sequences, duplicate keys, the previous value of a
group, repair) stays within the row: higher-order functions in place of a shuffle and a window by flow.  A missing value is
NULL; ``absent`` lists the cells (group x 30 + slot) that the flow lacks altogether, which is empty for a complete flow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K

GROUPS = ("ipt", "dir", "size")
N_CELLS = K.N_GROUPS * K.N_SLOTS


def is_flow_table(df: DataFrame) -> bool:
    return set(GROUPS) <= set(df.columns)


def values(df: DataFrame) -> Column:
    """The 90 values in (group, slot) order, NULL for absent cells."""
    return F.concat(*GROUPS)


def unless_absent(entries: Column, cell: Callable[[Column], Column]) -> Column:
    """The entries whose cell number is not absent; complete flows skip the test."""
    return F.when(F.size("absent") == 0, entries).otherwise(F.filter(entries, lambda e: ~F.array_contains(F.col("absent"), cell(e))))


def present_values(df: DataFrame) -> Column:
    """The values of the cells that the flow has, in order."""
    entries = F.transform(values(df), lambda v, k: F.struct(k.alias("k"), v.alias("v")))
    return F.when(F.size("absent") == 0, values(df)).otherwise(
        F.transform(unless_absent(entries, lambda e: e["k"]), lambda e: e["v"]))


def from_cells(cells: DataFrame, id_col: str = "flow_id") -> DataFrame:
    """Cells to flows: the one shuffle by flow, of at most 90 cells each.  Where Spark already deals the cells by flow (as it
    does for generated ones) there is none."""
    k = (F.col("grp") * K.N_SLOTS + F.col("slot")).alias("k")
    flows = cells.groupBy(id_col, "app").agg(F.array_sort(F.collect_list(F.struct(k, F.col("v").alias("v")))).alias("_c"))
    whole = F.size("_c") == N_CELLS
    known = F.map_from_entries("_c")
    every = F.sequence(F.lit(0), F.lit(N_CELLS - 1))
    v = F.when(whole, F.transform("_c", lambda e: e["v"])).otherwise(F.transform(every, lambda i: F.element_at(known, i)))
    absent = F.when(whole, F.array().cast("array<int>")).otherwise(F.array_except(every, F.transform("_c", lambda e: e["k"])))
    flows = flows.select(id_col, "app", v.alias("_v"), absent.alias("absent"))
    return flows.select(id_col, "app", *[F.slice("_v", g * K.N_SLOTS + 1, K.N_SLOTS).alias(n) for g, n in enumerate(GROUPS)], "absent")


def to_cells(flows: DataFrame, id_col: str = "flow_id") -> DataFrame:
    """Flows to cells, a narrow explode; the groups and slots are laid beside the values as whole arrays."""
    grp, slot = (F.array(*[F.lit(n) for n in numbers]) for numbers in zip(*(divmod(k, K.N_SLOTS) for k in range(N_CELLS))))
    entries = F.arrays_zip(grp.alias("grp"), slot.alias("slot"), values(flows).alias("v"))
    entries = unless_absent(entries, lambda e: e["grp"] * K.N_SLOTS + e["slot"])
    return flows.select(id_col, "app", F.explode(entries).alias("c")).select(id_col, "app", "c.grp", "c.slot", "c.v")


def map_values(flows: DataFrame, fn: Callable[[int, Column, Column], Column]) -> DataFrame:
    """Every value replaced by fn(group, slot, value); absent cells stay absent."""
    def of(g: int) -> Callable[[Column, Column], Column]:
        return lambda v, s: fn(g, s, v)

    return flows.withColumns({name: F.transform(name, of(g)) for g, name in enumerate(GROUPS)})


def to_wide(flows: DataFrame, id_col: str = "flow_id") -> DataFrame:
    """Flows to the wide form, within the row."""
    cols = [F.get(name, F.lit(s)).alias(K.feature_name(g, s)) for g, name in enumerate(GROUPS) for s in range(K.N_SLOTS)]
    return flows.select(id_col, "app", *cols)


def from_wide(wide: DataFrame, id_col: str = "flow_id") -> DataFrame:
    """The wide form to flows, within the row: no cell is absent."""
    label = K.LABEL_COL if K.LABEL_COL in wide.columns else "app"
    groups = [F.array(*[F.col(K.feature_name(g, s)).cast("double") for s in range(K.N_SLOTS)]).alias(n) for g, n in enumerate(GROUPS)]
    return wide.select(id_col, F.col(label).alias("app"), *groups, F.array().cast("array<int>").alias("absent"))
