"""Shuffles of program queries are cut by their size, so that a task's memory does not grow with the input."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Bytes of input for each partition that a shuffle begins with, and of shuffled rows that one task takes.
INPUT, ROWS = 1 << 20, 8 << 20
#: Bytes of a table that a round of a fixed point may send through the driver.
SENT = 256 << 10
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")
_FIRST, _ADVISED = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def stored(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of the tables that programs are made of, as they are stored."""
    total = 0
    for name in TABLES:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        total += fs.getContentSummary(p).getLength() if fs.exists(p) else 0
    return total


def cut(spark: SparkSession, sf_dir: str) -> None:
    """Settings of the session: a shuffle begins with a partition for each MB of input, where those are more than are set, and adaptive execution joins them up to 8 MB."""
    size = lambda text: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)
    wanted = -(-stored(spark, sf_dir) // INPUT)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_FIRST, str(wanted))
    else:
        spark.conf.unset(_FIRST)
    if size(spark.conf.get(_ADVISED)) > ROWS:
        spark.conf.set(_ADVISED, f"{ROWS}b")


@contextmanager
def little_sent(spark: SparkSession) -> Iterator[None]:
    """Within, joins broadcast tables of up to 256 KB only: the rounds of a fixed point broadcast again and again, and each broadcast goes through the driver."""
    first, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {first: spark.conf.get(first), adaptive: spark.conf.get(adaptive, None)}  # the second is the first where it is unset
    size = lambda text: -1 if text.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)
    try:
        for name, text in before.items():
            if text is not None and size(text) > SENT:
                spark.conf.set(name, f"{SENT}b")
        yield
    finally:
        for name, text in before.items():
            if text is not None:
                spark.conf.set(name, text)
