"""Sessions with the engine's settings, its functions and the tables of a folder as views."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings of every session: UTC, ANSI arithmetic, adaptive plans, statistics-based join order, footer-only counts.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.cteRecursionLevelLimit": "1000",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def load(spark: SparkSession, sf_dir: str, tables: list[str] = TABLES) -> SparkSession:
    """Configure the session and make a view of each table of a folder."""
    configure(spark)
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir), or the warehouse where it is unset."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')}/quern-tables"
