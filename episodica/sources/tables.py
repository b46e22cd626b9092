"""The tables as the engine's inputs, and its sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, idx, text: the turns of conversations."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("idx"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, text: the items of the benchmark."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def save(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.format(form).mode(mode).save(path)
