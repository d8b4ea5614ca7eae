"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and all runs on one machine."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        d = "file://" + os.path.join(tempfile.gettempdir(), "progdf-checkpoints")
    return d.rstrip("/")


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once as Parquet and read back, which ends its lineage."""
    path = f"{folder(df.sparkSession)}/progdf/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._progdf_path = path
    return out


def forget(*dfs: DataFrame | None) -> None:
    """Delete tables made by saved() that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_progdf_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Grown:
    """A table that only ever gets more rows: what is added is written once, what was there is not written again."""

    def __init__(self, df: DataFrame, name: str = "grown"):
        self.spark, self.schema, self.name, self.paths = df.sparkSession, df.schema, name, []
        self.add(df)

    def add(self, df: DataFrame) -> None:
        """Rows of df; a table made by saved() becomes a part as it is and must not be forgotten."""
        path = getattr(df, "_progdf_path", None)
        if path is None or df.schema.names != self.schema.names:
            path = saved(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]), self.name)._progdf_path
        self.paths.append(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)

    def drop(self) -> None:
        """Delete all parts."""
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []


def numbered(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df with `name`, from 1 on in the order of the columns: ranges of rows are counted first, then each is numbered by itself."""
    part = f"_{name}_part"
    dealt = saved(df.repartitionByRange(*columns).withColumn(part, F.spark_partition_id()), "numbered")
    per = dealt.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    own = F.row_number().over(Window.partitionBy(part).orderBy(*columns))
    return dealt.join(F.broadcast(per.select(part, before.alias("_before"))), part).withColumn(name, (own + F.col("_before")).cast("long")).drop(part, "_before")

