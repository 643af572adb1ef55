"""Helpers the operators share: the shared work folder, small tables, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="quern-"))
        path = _OWN_DIR[0]
    return f"{path}/quern-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back.

    Cuts the lineage at a place that outlives any executor, fixes generated ids, and
    lets both sides of a following join be freshly exchanged, so that AQE can split
    a hot key.  `purge` removes everything written by this application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let at most so many rows at a time go to Python workers, for what both sides of the pipe hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


_KEPT: dict = {}


def kept(key, make: Callable):
    """What a Python worker keeps over its tasks: one thing, made when the key is new."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def tidy(run: Callable, forget: bool = True) -> Callable:
    """run over Arrow batches, in a worker that holds little afterwards.

    Workers serve one operator's tasks after another's.  What an earlier one kept goes
    (unless this one keeps something itself), and freed memory goes back to the system.
    """

    def tidied(batches):
        if forget:
            _KEPT.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def purge(spark: SparkSession) -> None:
    """Remove the tables `materialise` wrote; results that still read them become invalid."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(conf).delete(path, True)


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with the columns renamed that begin like an operator's own (two underscores), and the names to give back."""
    back = {f"given_{uuid.uuid4().hex}": c for c in df.columns if c.startswith("__")}
    return df.withColumnsRenamed({c: n for n, c in back.items()}), back


SLOTS = 1 << 16


def thinned(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of df whose `name` may be among the ids; exact only together with the join that follows.

    Keeps texts that no id asks for out of that join's shuffle.  What is broadcast is a map of
    64 bits for each of SLOTS slots, whatever the number of ids; a full map keeps all rows.
    """
    place = F.xxhash64(name)
    slot, bit = F.pmod(place, F.lit(SLOTS)), F.shiftright(place, 32).bitwiseAND(63).cast("int")
    full = ids.select(slot.alias("slot__"), F.expr(f"shiftleft(1L, cast(shiftright(xxhash64(`{name}`), 32) & 63 as int))").alias("m__")).groupBy("slot__").agg(F.bit_or("m__").alias("map__"))
    out = df.join(F.broadcast(full), slot == F.col("slot__"))
    return out.filter(F.getbit("map__", bit) == 1).select(df.columns)


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table from a short driver-side list, built inside the JVM (no Python workers)."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.  Linear in the text, inside the JVM."""
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit("[A-Z]+|[^A-Z]+"), F.lit(0))
    mixed = F.array_join(F.transform(runs, lambda r: F.when(F.ascii(r).between(65, 90), F.lower(r)).otherwise(r)), "")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(mixed)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as edges(a, b).

    Returns (node, component) with component the smallest node reachable, for every
    node on an edge between two different nodes.  Alternates the large-star and
    small-star steps; each step is a minimum per node (combined before its shuffle)
    joined back to the edges, so a hub of any degree is never gathered in one task.
    Null ends and self-loops are ignored; no edges gives no rows.
    """
    live = edges.dropna(subset=["a", "b"]).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    live = materialise(live.filter("u <> v").distinct())
    while not _starred(live):
        # Large star: neighbours greater than a node hang on the smallest neighbour.
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct())
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(small.filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        for used in (live, least, large, low):
            discard(used)
        live = after
    ends = live.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return live.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)


def _starred(live: DataFrame) -> bool:
    """Whether every u of live(u, v) has one v, and no v is a u: each component hangs on its smallest node."""
    edges, nodes = live.agg(F.count("*"), F.countDistinct("u")).first()
    return edges == nodes and not live.select("u").join(live.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()


def discard(df: DataFrame) -> None:
    """Remove a table that `materialise` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/quern-" in folder.toString():
            folder.getFileSystem(conf).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished jobs (it acts on the driver's collections)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
