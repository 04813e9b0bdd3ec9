"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a fresh local folder serves a session on one machine; on several it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"file://{_own[0]}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as a table to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docquarry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many partitions as the session shuffles to. For work that is heavy for its bytes, as on texts: a number that is named keeps adaptive execution from joining partitions that look small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
