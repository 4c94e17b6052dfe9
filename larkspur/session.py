"""Session factory and table access shared by the queries, the tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the operators are tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("larkspur")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LARKSPUR_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
