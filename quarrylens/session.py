"""Session defaults, table loading and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, AQE)."""
    builder = (
        SparkSession.builder.appName("quarrylens")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def load_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    return {name: table(spark, directory, name) for name in TABLES}


def scratch_root(spark: SparkSession) -> str:
    """Folder for materialised intermediates, shared by all executors.

    Uses the folder the cluster names in ``spark.checkpoint.dir``. Only a local
    master may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="quarrylens-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_folder(spark: SparkSession) -> str:
    """This application's part of the scratch folder, which others may share."""
    return f"{scratch_root(spark)}/quarrylens/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage, so values that depend on task placement (row slots) stay
    fixed when an executor is lost, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every intermediate of this application; no result read from them may be used after."""
    if spark.conf.get("spark.checkpoint.dir", None):
        path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are NULL everywhere in this package, never NaN."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floats else quoted(c)
            for c in df.columns
        ]
    )


def quoted(name: str):
    """Column by literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def is_datetime(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
