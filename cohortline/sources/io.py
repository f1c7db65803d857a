"""Reading and writing tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortline.session import configure


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table."""
    return configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A database table or ``(query) alias``, read in parallel slices of an integer key."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, **options)
        .options(lowerBound=lower, upperBound=upper, numPartitions=partitions)
        .load()
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, index: bool = False) -> DataFrame:
    """CSV with a header and a given schema; ``index`` drops the unnamed first column of an indexed file."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if index:
        fields = T.StructType([T.StructField("_index", T.StringType())] + fields.fields)
    df = spark.read.csv(path, header=True, schema=fields, enforceSchema=True, mode="FAILFAST")
    return df.drop("_index")


def write_csv(df: DataFrame, path: str, index: Sequence[str] | None = None) -> None:
    """CSV with a header; ``index`` names the columns to put first."""
    if index:
        df = df.select(*index, *[c for c in df.columns if c not in index])
    df.write.mode("overwrite").option("header", True).csv(path)


def materialize(df: DataFrame, path: str, cluster_by: Sequence[str] | None = None) -> DataFrame:
    """Replace a derived table on shared storage and read it back (the lineage ends at the files).

    The new table is written beside the old one and takes its place once it is whole, so a job that fails leaves the old
    table as it was, and ``df`` may read the table that it replaces.
    """
    spark = df.sparkSession
    if cluster_by:
        df = df.repartition(*cluster_by)
    mark = uuid.uuid4().hex
    beside, before = (f"{path.rstrip('/')}.{kind}-{mark}" for kind in ("new", "old"))
    df.write.parquet(beside)
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, new, old = paths(path), paths(beside), paths(before)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    replaces = files.exists(target)
    if replaces and not files.rename(target, old):
        raise OSError(f"cannot replace {path}; the new table is at {beside}")
    if not files.rename(new, target):
        raise OSError(f"cannot move {beside} to {path}" + (f"; the old table is at {before}" if replaces else ""))
    if replaces:
        files.delete(old, True)
    spark.catalog.refreshByPath(path)
    return spark.read.schema(df.schema).parquet(path)


def register_views(tables: Mapping[str, DataFrame], prefix: str = "") -> None:
    """Make frames addressable by name in ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def save_table(
    df: DataFrame, name: str, buckets: int | None = None, key: str | None = None, path: str | None = None
) -> None:
    """Replace a catalog table; bucketing by the key lets later joins and groupings on it skip the shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if buckets and key:
        writer = writer.bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
