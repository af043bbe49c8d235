"""Trade files in, stage tables and result files out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickflow.operators.labels import LabelSpec, export_label
from tickflow.operators.regimes import feature_matrix, label_source
from tickflow.runtime import attach, written


def safe_name(column: str) -> str:
    """Column name without dots: ``imp_c_0.8`` becomes ``imp_c_0p8``."""
    return column.replace(".", "p")


def scan_csv(spark: SparkSession, folder: str, contains: str = "",
             schema: StructType | str | None = None) -> DataFrame:
    """All CSV files (or folders of files) whose name contains ``contains``, as one scan.

    Without a schema the types are inferred, which reads the files twice.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(f"{folder.rstrip('/')}/*{contains}*")


def with_row_ids(df: DataFrame) -> DataFrame:
    """``trd_id``: 0-based row number inside each file of a scan, in file order. Dots in
    column names are replaced.

    A file may be large: it is read in splits by many tasks. The scan is written once with
    a running id per task; the id minus the first id of the split, plus the rows in the
    splits before it, is the row number. Nothing is sorted.
    """
    tagged = df.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"),
        *[F.col(f"`{c}`").alias(safe_name(c)) for c in df.columns])
    fixed = written(tagged, "rows")
    splits = fixed.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("_file", "_at", (F.coalesce(F.sum("_n").over(before), F.lit(0))
                                             - F.col("_first")).alias("_shift"))
    return attach(fixed, offsets, ["_file", "_at"]).select(
        *[safe_name(c) for c in df.columns], (F.col("_id") + F.col("_shift")).alias("trd_id"))


def read_trades(spark: SparkSession, folder: str, contains: str,
                schema: StructType | str | None = None) -> DataFrame:
    """Trade table of all matching files, with row ids and NULL for NaN."""
    scan = scan_csv(spark, folder, contains, schema)
    return nan_to_null(with_row_ids(scan))


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def read_table_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One CSV table; an unnamed first column (a saved row index) is dropped."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.drop("_c0", "Unnamed: 0")


def read_regime_tables(spark: SparkSession, paths: dict[str, str],
                       schema: StructType | str | None = None) -> DataFrame:
    """One table per regime, appended with the regime's name in ``model``."""
    out = None
    for name, path in paths.items():
        one = read_table_csv(spark, path, schema).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def append(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_features(df: DataFrame, folder: str, prefix: str) -> str:
    """Feature matrix of a tagged trade table, partitioned by regime."""
    path = f"{folder}/X_samples_{prefix}"
    feature_matrix(df).write.partitionBy("model").parquet(path)
    return path


def write_label_source(df: DataFrame, folder: str, prefix: str) -> str:
    path = f"{folder}/y_source_{prefix}"
    label_source(df).write.parquet(path)
    return path


def write_label(labelled: DataFrame, folder: str, prefix: str, spec: LabelSpec) -> str:
    path = f"{folder}/y_{spec.name(prefix)}"
    export_label(labelled).write.parquet(path)
    return path


def load_saved(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A saved stage table; a missing one is reported as such."""
    try:
        return spark.read.parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(f"{name} is not in {folder}: write that stage first") from e


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> str:
    """Result table as CSV; ``append`` adds the files of one more run."""
    df.write.mode(mode).option("header", header).csv(path)
    return path

