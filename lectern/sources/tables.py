"""Tables of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are work: texts, pages, vectors.
HEAVY = frozenset({"conversations", "documents", "embeddings", "pages"})


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores. A small file is one split, and would keep one core busy; a table of
    more splits than cores stays as it is, so nothing is shuffled at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in HEAVY else df
