"""Flow files: the wide CSV / Parquet form, schema audit and completion,
run outputs, and the metric-history JSON.

The wide form (90 ``PPI_g_s`` doubles + ``APP``) exists only at this
boundary; inside the library flows are cells (long) or arrays.
"""

from __future__ import annotations

import csv
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..session import is_folder

FLOW_WIDE = T.StructType([T.StructField(c, T.DoubleType(), True) for c in K.FEATURES]
                         + [T.StructField(K.LABEL_COL, T.StringType(), True)])

HISTORY = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("train_losses", T.ArrayType(T.DoubleType())),
    T.StructField("val_losses", T.ArrayType(T.DoubleType())),
    T.StructField("learning_rates", T.ArrayType(T.DoubleType())),
    T.StructField("epoch_times", T.ArrayType(T.DoubleType())),
])


# --- S1 / S4 ---------------------------------------------------------------

def _escaped(path: str) -> str:
    """A file's URI as a path that Spark takes literally: decoded, glob signs escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(path))


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """(header, files): the different header lines below ``path`` and the files that start with each.

    One pass over the text keeps the first line of each file's first split (row numbers grow within a split); what is gathered is
    one line and one path per file, like Spark's own file listing.  Empty files have no header and no rows."""
    first = (spark.read.option("recursiveFileLookup", True).text(path)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("line"))
             .where("start = 0").groupBy("file").agg(F.min_by("value", "line").alias("header")))
    return first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))


def _base(spark: SparkSession, path: str) -> dict[str, str]:
    """Files of a folder per label (APP=web/...) carry the label in their path below this folder."""
    return {"basePath": path} if is_folder(spark, path) else {}


def _read_csv_group(spark: SparkSession, header: str, files: list[str], base: dict[str, str]) -> DataFrame:
    """Files of one header, each column at its place in that header and read with the type it has in FLOW_WIDE."""
    names = next(csv.reader([header.lstrip("\ufeff").rstrip("\r")]), [])
    kinds, fields = {f.name: f.dataType for f in FLOW_WIDE}, []
    for i, name in enumerate(names):
        known = name in kinds and name not in names[:i]             # of a repeated name the first column counts
        fields.append(T.StructField(name if known else f"_other_{i}", kinds[name] if known else T.StringType(), True))
    return spark.read.schema(T.StructType(fields)).option("header", True).options(**base).csv([_escaped(f) for f in files])


def _mergeable(spark: SparkSession, files: list[str], base: dict[str, str]) -> list[DataFrame]:
    """The Parquet files in as few reads as their types allow: all of them if the footers merge, else each half by itself."""
    try:
        return [spark.read.option("mergeSchema", True).options(**base).parquet(*[_escaped(f) for f in files])]
    except Exception as e:
        if len(files) == 1 or "MERGE" not in str(e).upper():
            raise
    half = len(files) // 2
    return _mergeable(spark, files[:half], base) + _mergeable(spark, files[half:], base)


def _by_name(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
                       for f in FLOW_WIDE])


def read_flows(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Wide flows in the fixed column order, whatever the order, number and types of the columns in each file.

    CSV files are grouped by their header line and each group is read by name; Parquet files are grouped by what their footers
    allow to merge, numbers are widened to double.  Absent columns and empty cells are NULL, other columns are ignored, a
    cell that is no number is NULL.  A folder laid out by label (``APP=...``) gives the label from the path."""
    base = _base(spark, path)
    if fmt == "csv":
        parts = [_read_csv_group(spark, r["header"], r["files"], base)
                 for r in csv_headers(spark, path).orderBy("header").toLocalIterator()]
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
        parts = _mergeable(spark, [r["path"] for r in files.select("path").orderBy("path").toLocalIterator()], base)
    if not parts:
        return spark.createDataFrame([], FLOW_WIDE)
    return reduce(DataFrame.unionByName, map(_by_name, parts))


def read_flows_of(spark: SparkSession, path: str, labels: DataFrame | list[str]) -> DataFrame:
    """S4 read: flows of some labels from a Parquet folder written with ``partition_by_label``.

    A list of labels prunes the folders when the query is planned; a DataFrame with a column ``APP`` prunes them at run
    time (dynamic partition pruning) where Spark finds it selective.  The schema is given, so no file is opened for it."""
    flows = spark.read.schema(FLOW_WIDE).parquet(path)
    if isinstance(labels, list):
        known = [x for x in labels if x is not None]
        wanted = F.col(K.LABEL_COL).isin(known)
        return flows.where(wanted | F.col(K.LABEL_COL).isNull() if None in labels else wanted)
    return flows.join(labels.select(K.LABEL_COL).distinct(), K.LABEL_COL, "left_semi").select(*FLOW_WIDE.names)


def write_flows(wide: DataFrame, path: str, fmt: str = "csv", partition_by_label: bool = False,
                mode: str = "overwrite") -> None:
    """Write wide flows in the fixed column order (90 features, then APP).
    ``partition_by_label`` lays files out by label for partition pruning."""
    df = wide
    if "app" in df.columns and K.LABEL_COL not in df.columns:
        df = df.withColumnRenamed("app", K.LABEL_COL)
    df = df.select(*K.FEATURES, K.LABEL_COL)
    w = df.write.mode(mode)
    if partition_by_label:
        w = w.partitionBy(K.LABEL_COL)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


# --- S2 / S3 ---------------------------------------------------------------

def schema_audit(spark: SparkSession, df: DataFrame) -> DataFrame:
    """One row - rows, feature columns present, missing feature names (in
    feature order), whether a label column exists and how many labels."""
    cols = set(df.columns)
    missing = [c for c in K.FEATURES if c not in cols]
    has_label = K.LABEL_COL in cols
    labels = F.countDistinct(K.LABEL_COL) if has_label else F.lit(None)
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("total_rows"),
                  F.lit(len(K.FEATURES) - len(missing)).cast("bigint").alias("feature_columns"),
                  F.lit(",".join(missing)).alias("missing_features"),
                  F.lit(has_label).alias("has_label"),
                  labels.cast("bigint").alias("distinct_labels"))


def complete_schema(df: DataFrame) -> DataFrame:
    """S3: absent features become 0.0, an absent or NULL label becomes 'Unknown';
    present columns are cast to double."""
    cols = set(df.columns)
    feats = [F.col(c).cast("double").alias(c) if c in cols else F.lit(0.0).alias(c) for c in K.FEATURES]
    label = F.coalesce(F.col(K.LABEL_COL), F.lit(K.UNKNOWN_LABEL)) if K.LABEL_COL in cols else F.lit(K.UNKNOWN_LABEL)
    keep = [c for c in df.columns if c not in K.FEATURES and c != K.LABEL_COL]
    return df.select(*keep, *feats, label.alias(K.LABEL_COL))


# --- P2 ----------------------------------------------------------------------

def wide_to_cells(wide: DataFrame, id_col: str = "flow_id") -> DataFrame:
    """Unpivot the 90 feature columns to (id, app, grp, slot, v)."""
    label = K.LABEL_COL if K.LABEL_COL in wide.columns else "app"
    entries = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(s).alias("slot"),
                                 F.col(K.feature_name(g, s)).cast("double").alias("v"))
                        for g in range(K.N_GROUPS) for s in range(K.N_SLOTS)])
    return (wide.select(id_col, F.col(label).alias("app"), F.explode(entries).alias("c"))
            .select(id_col, "app", "c.grp", "c.slot", "c.v"))


# --- S7 ----------------------------------------------------------------------

def write_history(metrics: DataFrame, path: str) -> None:
    """S7 write: one JSON object per run with its series as arrays in epoch
    order (a run's arrays are bounded by its number of epochs).  ``lr`` may be
    absent; its series is then of NULLs."""
    _histories(metrics).write.mode("overwrite").json(path)


def _histories(metrics: DataFrame) -> DataFrame:
    """One row per run with its series as arrays in epoch order."""
    lr = (F.col("lr") if "lr" in metrics.columns else F.lit(None)).cast("double").alias("lr")
    e = F.struct("epoch", "train_loss", "val_loss", lr, "secs")
    per_run = metrics.groupBy("run_id").agg(F.array_sort(F.collect_list(e)).alias("_e"))
    return per_run.select(
        "run_id",
        F.transform("_e", lambda x: x["train_loss"]).alias("train_losses"),
        F.transform("_e", lambda x: x["val_loss"]).alias("val_losses"),
        F.transform("_e", lambda x: x["lr"]).alias("learning_rates"),
        F.transform("_e", lambda x: x["secs"]).alias("epoch_times"))


def _epochs(histories: DataFrame) -> DataFrame:
    z = histories.select("run_id", F.posexplode(F.arrays_zip("train_losses", "val_losses", "learning_rates",
                                                             "epoch_times")).alias("pos", "z"))
    return z.select("run_id", (F.col("pos") + 1).alias("epoch"),
                    F.col("z.train_losses").alias("train_loss"), F.col("z.val_losses").alias("val_loss"),
                    F.col("z.learning_rates").alias("lr"), F.col("z.epoch_times").alias("secs"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """S7 read: (run_id, epoch, train_loss, val_loss, lr, secs), epoch = index + 1, from one object per line."""
    return _epochs(spark.read.schema(HISTORY).json(path))


def read_history_files(spark: SparkSession, path: str, run_id: str = r"([^/]+)/[^/]*$") -> DataFrame:
    """S7 read of one indented JSON object per file, as a training run saves it: it spans lines and has no run id.

    The run id is the first group of the pattern ``run_id`` in the file's path, the name of its folder by default; an id in the object
    goes first.  Series of unequal length (a run that stopped early) end in NULLs."""
    where = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), run_id, 1)
    h = spark.read.schema(HISTORY).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return _epochs(h.withColumn("run_id", F.coalesce("run_id", where)))


def write_history_files(metrics: DataFrame, path: str) -> None:
    """S7 write in that form: ``path``/run/file, one indented object per run."""
    flat = _histories(metrics)
    series = F.struct(*[c for c in flat.columns if c != "run_id"])
    text = F.to_json(series, {"pretty": "true", "ignoreNullFields": "false"}).alias("value")
    flat.select(text, F.col("run_id").alias("run")).write.mode("overwrite").partitionBy("run").text(path)


# --- S5 ----------------------------------------------------------------------

def write_profile(tables: dict[str, DataFrame], path: str, fmt: str = "json") -> dict[str, str]:
    """Write the profile tables (group profile, thresholds, value
    distributions, label proportions ...) one folder per table."""
    out = {}
    for name, df in tables.items():
        p = f"{path.rstrip('/')}/{name}"
        (df.write.mode("overwrite").json(p) if fmt == "json" else df.write.mode("overwrite").parquet(p))
        out[name] = p
    return out
