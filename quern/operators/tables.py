"""Row-level changes, compaction, snapshots and access rules over Parquet tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class _Change:
    """Adds and removes files of a table's folder so that a crash is finished by the next change.

    New files are written beside the table's own, where readers do not look.  A journal names
    what is added and removed before anything moves; `recover` carries out what a journal says.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        self.spark, self.path, self.of = spark, path.rstrip("/"), jvm.org.apache.hadoop.fs.Path
        self.fs = self.of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.id = uuid.uuid4().hex
        self.staged = f"{self.path}/_staged-{self.id}"

    def files(self, folder: str, prefix: str = "") -> list[str]:
        found = self.fs.globStatus(self.of(f"{folder}/{prefix}*")) or []
        return [f.getPath().toString() for f in found]

    def write(self, df: DataFrame) -> None:
        df.write.parquet(self.staged)

    def commit(self, removed: list[str]) -> None:
        added = self.files(self.staged, "part-") if self.fs.exists(self.of(self.staged)) else []
        journal = f"{self.path}/_journal-{self.id}"
        self.spark.createDataFrame([(json.dumps({"add": added, "remove": removed}),)], "value string").coalesce(1).write.text(journal)
        self.finish(journal, added, removed)

    def finish(self, journal: str, added: list[str], removed: list[str]) -> None:
        for file in added:
            if self.fs.exists(self.of(file)):
                self.fs.rename(self.of(file), self.of(f"{self.path}/{file.rpartition('/')[2]}"))
        for file in removed:
            self.fs.delete(self.of(file), False)
        self.fs.delete(self.of(journal), True)
        for staged in {f.rpartition("/")[0] for f in added} | {self.staged}:
            self.fs.delete(self.of(staged), True)

    def recover(self) -> None:
        for journal in self.files(self.path, "_journal-"):
            if self.fs.exists(self.of(f"{journal}/_SUCCESS")):
                said = json.loads(self.spark.read.text(journal).first()[0])
                self.finish(journal, said["add"], said["remove"])
            else:
                self.fs.delete(self.of(journal), True)


def recover(spark: SparkSession, path: str) -> None:
    """Finish the changes of a table that a crash has cut off."""
    _Change(spark, path).recover()


def _touched(df: DataFrame, hit: Column) -> list[str]:
    return [r[0] for r in df.filter(hit).select(F.input_file_name()).distinct().collect()]


def insert(spark: SparkSession, path: str, rows: DataFrame) -> None:
    rows.write.mode("append").parquet(path)


def rewrite(spark: SparkSession, path: str, df: DataFrame) -> None:
    """Put df in place of all rows of a table."""
    change = _Change(spark, path)
    change.recover()
    change.write(df)
    change.commit(change.files(path, "part-"))


def delete(spark: SparkSession, path: str, where: str) -> int:
    """Remove rows for which the condition is true (not unknown); their number.  Other files stay as they are."""
    hit = F.coalesce(F.expr(where), F.lit(False))
    return _edit(spark, path, hit, lambda df: df.filter(~hit))


def update(spark: SparkSession, path: str, changes: dict[str, str], where: str = "true") -> int:
    """Change rows for which the condition is true; their number."""
    return _edit(spark, path, F.coalesce(F.expr(where), F.lit(False)), lambda df: updated(df, changes, where))


def _edit(spark: SparkSession, path: str, hit: Column, made) -> int:
    """Write the files with hit rows again.  The driver holds their names; partitioned folders are not supported."""
    change = _Change(spark, path)
    change.recover()
    schema = spark.read.parquet(path).schema
    read = lambda *files: spark.read.schema(schema).parquet(*files)
    files = _touched(read(path), hit)
    if not files:
        return 0
    n = read(*files).filter(hit).count()
    change.write(made(read(*files)))
    change.commit(files)
    return n


def merge(spark: SparkSession, path: str, source: DataFrame, keys: list[str], *, rules: list[tuple[str, dict[str, str] | None]], insert: dict[str, str] | bool = False, insert_when: str = "true") -> int:
    """MERGE into a table's files; the number of rows changed, removed or added.

    rules are tried in order on matched rows: (condition, changes), or (condition, None) to
    delete.  insert gives the columns of a row without a match.
    """
    change = _Change(spark, path)
    change.recover()
    schema = spark.read.parquet(path).schema
    if source.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError("several source rows for one key")
    target = spark.read.schema(schema).parquet(path)
    files = [r[0] for r in target.withColumn("q_file", F.input_file_name()).join(source.select(*keys).distinct(), keys, "left_semi").select("q_file").distinct().collect()]
    n = 0
    parts = []
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    s = source.withColumn("q_s", F.lit(True)).alias("s")
    if files:
        both = spark.read.schema(schema).parquet(*files).alias("t").join(s, on, "left")
        matched, free = F.col("s.q_s").isNotNull(), F.lit(True)
        which = F.lit(-1)
        for k, (test, _) in reversed(list(enumerate(rules))):
            which = F.when(F.coalesce(F.expr(test), F.lit(False)), k).otherwise(which)
        both = both.withColumn("q_rule", F.when(matched & free, which).otherwise(-1))
        n += both.filter("q_rule >= 0").count()
        gone = [k for k, (_, changes) in enumerate(rules) if changes is None]
        both = both.filter(~F.col("q_rule").isin(gone)) if gone else both

        def value(f) -> Column:
            out = F.col(f"t.{f.name}")
            for k, (_, changes) in enumerate(rules):
                if changes and f.name in changes:
                    out = F.when(F.col("q_rule") == k, F.expr(changes[f.name]).cast(f.dataType)).otherwise(out)
            return out.alias(f.name)

        parts.append(both.select(*[value(f) for f in schema.fields]))
    if insert:
        fresh = s.join(target.select(*keys).distinct(), keys, "left_anti").alias("s").filter(F.coalesce(F.expr(insert_when), F.lit(False)))
        n += fresh.count()
        parts.append(fresh.select(*[(F.expr(insert[f.name]) if f.name in insert else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]))
    if not n:
        return 0
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    change.write(out)
    change.commit(files)
    return n


def updated(df: DataFrame, changes: dict[str, str], where: str = "true") -> DataFrame:
    hit = F.coalesce(F.expr(where), F.lit(False))
    return df.select(*[F.when(hit, F.expr(changes[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in changes else F.col(f.name) for f in df.schema.fields])


def merged(target: DataFrame, source: DataFrame, keys: list[str], *, update: dict[str, str] | None = None, delete_when: str | None = None, update_when: str = "true", insert: bool = True) -> DataFrame:
    """MERGE as one full outer join on equal keys; expressions name columns as t.x and s.x.

    A target row with several source rows is an error.
    """
    if source.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError("several source rows for one key")
    t, s = target.withColumn("q_t", F.lit(True)).alias("t"), source.withColumn("q_s", F.lit(True)).alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    both = t.join(s, on, "full_outer")
    matched = F.col("t.q_t").isNotNull() & F.col("s.q_s").isNotNull()
    if delete_when:
        both = both.filter(~(matched & F.coalesce(F.expr(delete_when), F.lit(False))))
    if not insert:
        both = both.filter(F.col("t.q_t").isNotNull())
    change = matched & F.coalesce(F.expr(update_when), F.lit(False))

    def value(name: str) -> Column:
        new = F.expr(update[name]) if update and name in update else F.col(f"t.{name}")
        fresh = F.col(f"s.{name}") if name in source.columns else F.lit(None)
        return F.when(F.col("t.q_t").isNull(), fresh).when(change, new).otherwise(F.col(f"t.{name}")).alias(name)

    return both.select(*[value(c) for c in target.columns])


def compact(spark: SparkSession, path: str, file_bytes: int = 128 << 20) -> int:
    """Merge the files smaller than half of file_bytes into files of about that size; how many were merged.  Large files stay, nothing is shuffled."""
    change = _Change(spark, path)
    change.recover()
    sizes = {f.getPath().toString(): f.getLen() for f in change.fs.globStatus(change.of(f"{path}/part-*"))}
    small = [f for f, n in sizes.items() if n < file_bytes // 2]
    if len(small) < 2:
        return 0
    schema = spark.read.parquet(path).schema
    change.write(spark.read.schema(schema).parquet(*small).coalesce(max(1, -(-sum(sizes[f] for f in small) // file_bytes))))
    change.commit(small)
    return len(small)


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast(kind))


def secured(df: DataFrame, *, row_filter: str | None = None, masks: dict[str, str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """The part of a table a role may see: rows filtered first, then columns masked and denied."""
    out = df.filter(row_filter) if row_filter else df
    for name, expression in (masks or {}).items():
        out = out.withColumn(name, F.expr(expression))
    return out.drop(*(deny or []))


def cidr_join(flows: DataFrame, networks: DataFrame, ip: str, cidr: str, widths: int = 33) -> DataFrame:
    """Rows of flows with each network that contains their IPv4 address, as equi-joins.

    The address is explored at each prefix length that networks uses, so the range condition
    becomes a hash join on (length, masked address); no nested loop.  What is no IPv4 address
    or network matches nothing.
    """
    whole = "^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\\\.|$)){{4}}$"
    number = lambda x: F.expr(f"CASE WHEN {x} RLIKE '{whole}' AND {x} NOT LIKE '%.' THEN aggregate(split({x}, '\\\\.'), 0L, (p, o) -> p * 256 + CAST(o AS BIGINT)) END".replace("{{", "{").replace("}}", "}"))
    nets = networks.withColumn("q_len", F.expr(f"try_cast(split_part({cidr}, '/', 2) AS INT)")).withColumn("q_key", number(f"split_part({cidr}, '/', 1)"))
    nets = nets.filter("q_len BETWEEN 0 AND 32 AND q_key IS NOT NULL").withColumn("q_key", F.expr("shiftright(q_key, 32 - q_len)"))
    lengths = sorted(r[0] for r in nets.select("q_len").distinct().limit(widths).collect())
    keyed = flows.withColumn("q_ip", number(ip)).filter("q_ip IS NOT NULL").withColumn("q_len", F.explode(F.array(*[F.lit(n) for n in lengths] or [F.lit(-1)])))
    keyed = keyed.withColumn("q_key", F.expr("shiftright(q_ip, 32 - q_len)"))
    return keyed.join(nets, ["q_len", "q_key"]).drop("q_len", "q_key", "q_ip")
