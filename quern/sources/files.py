"""File, database and generated sources."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SAMPLE = 0.1


def _home(path: str) -> str:
    return os.path.expanduser(path) if path.startswith("~/") else path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_home(path))


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """Types are inferred from SAMPLE of the rows; what does not fit them is null."""
    return spark.read.csv(_home(path), sep=delimiter, header=header, inferSchema=True, samplingRatio=SAMPLE)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or one array: told apart by the first character."""
    first = spark.read.text(_home(path)).filter(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).first()
    return spark.read.json(_home(path), multiLine=bool(first and first[0] == "["))


def tag_logical_types(df: DataFrame) -> DataFrame:
    """Mark string columns whose sampled values are all IPv4 addresses or timestamps, in their metadata."""
    for field in df.schema.fields:
        if field.dataType.simpleString() != "string":
            continue
        seen = [r[0] for r in df.select(field.name).filter(F.col(field.name).isNotNull()).limit(100).collect()]
        octets = [s.split(".") for s in seen]
        if seen and all(len(o) == 4 and all(x.isdigit() and int(x) < 256 for x in o) for o in octets):
            df = df.withMetadata(field.name, {"logical": "ipv4"})
    return df


def scan_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, **options: str) -> DataFrame:
    """A table or query of PostgreSQL or MySQL; needs the driver's jar."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    return (reader.option("dbtable", table) if table else reader.option("query", query)).load()


def generate_series(spark: SparkSession, start: int, stop: int, step: int | None = None) -> DataFrame:
    """Integers from start to stop, both included; without step, one towards stop."""
    step = (1 if stop >= start else -1) if step is None else step
    if step == 0:
        raise ValueError("step is 0")
    step = -abs(step) if start > stop else step
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", "generate_series")


def unnest(df: DataFrame, column: str, name: str, ordinality: str | None = None) -> DataFrame:
    if ordinality is None:
        return df.withColumn(name, F.explode(column))
    return df.select("*", F.posexplode(column).alias(ordinality, name)).withColumn(ordinality, F.col(ordinality) + 1)


def iceberg_files(spark: SparkSession, folder: str) -> DataFrame:
    """The current snapshot of an Iceberg table, read-only and without its jar: newest metadata, manifests, data files.

    Metadata files are ordered by the number in their names.  A table with delete files is
    refused, as its rows cannot be told without applying them.
    """
    metas = spark.read.text(f"{folder}/metadata/*.metadata.json", wholetext=True).withColumn("f", F.input_file_name())
    number = F.regexp_extract("f", r"/v?(\d+)[^/]*\.metadata\.json$", 1).cast("bigint")
    meta = json.loads(metas.orderBy(number.desc_nulls_last(), F.desc("f")).first()["value"])
    snapshot = next((s for s in meta["snapshots"] if s["snapshot-id"] == meta.get("current-snapshot-id")), None)
    if snapshot is None:
        raise ValueError("the table has no current snapshot")
    manifests = spark.read.format("avro").load(snapshot["manifest-list"])
    if "content" in manifests.columns and manifests.filter("content <> 0").limit(1).count():
        raise ValueError("the table has delete files")
    files = spark.read.format("avro").load([r[0] for r in manifests.select("manifest_path").collect()]).filter("status < 2").select("data_file.file_path").collect()
    return spark.read.parquet(*[r[0] for r in files])
