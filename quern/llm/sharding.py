"""Sharding by histogram sort (DataFrame functions only).

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours.  The exact
bytes below candidate key boundaries are counted over all partitions; cells of the key
space that hold a splitter away from their edges, or too many rows, are probed again with
finer boundaries, until each splitter lies within the tolerance of a boundary.  Then the
rows are exchanged once.

The driver holds only the histogram: FIRST_CELLS cells and PROBES for each refined one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialise, set_aside, small_table

FIRST_BITS, PROBES, ROW_CELLS = 10, 64, 256
_LOW = -(2**63)
_OUT = ("size", "text_crc32", "law", "shard", "slot")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns(
        {
            "size": F.octet_length(text).cast("long") + 8,
            "text_crc32": F.crc32(text),
            "__h": F.xxhash64(text),
            "__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)),
        }
    ).withColumn("__cell", F.shiftrightunsigned(F.col("__h").bitwiseXOR(F.lit(_LOW)), 64 - FIRST_BITS))


def _probe(df: DataFrame, finer: list[dict], how: str) -> DataFrame:
    """Move rows of refined cells into their finer cells."""
    small = small_table(df.sparkSession, finer, "cell bigint, by_doc boolean, lo decimal(20,0), step decimal(20,0), first bigint")
    small = small.select(*[F.col(c).alias(f"__p_{c}") for c in small.columns])
    at = "cast((cast(if(__p_by_doc, __d, __h) as decimal(20,0)) - __p_lo) div __p_step as bigint)"
    moved = df.join(F.broadcast(small), F.col("__cell") == F.col("__p_cell"), how)
    return moved.withColumn("__cell", F.expr(f"coalesce(__p_first + {at}, __cell)")).drop(*small.columns)


def _histogram(df: DataFrame) -> list:
    return (
        df.groupBy("__cell")
        .agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.min("__h").alias("h0"), F.max("__h").alias("h1"), F.min("__d").alias("d0"), F.max("__d").alias("d1"))
        .collect()
    )


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = 0.01) -> DataFrame:
    """docs(doc_id, text, ...) with size, text_crc32, law ('bytes'), shard and slot.

    size is the text's UTF-8 bytes plus 8.  Each shard's bytes differ from the mean by at
    most tolerance of it, or by one row where a row is larger; a group of equal texts stays
    in one shard unless it must be cut to keep that.  slot numbers a shard's rows from 0 in
    key order.  A null text counts as empty; a null doc_id sorts first; repeated rows keep
    their multiplicity.  Input columns named like an output are replaced.  An empty table
    gives no rows.
    """
    docs, back = set_aside(docs.drop(*_OUT))
    keys = materialise(_keyed(docs.select("doc_id", "text")).select("size", "__h", "__d", "__cell"))
    cells = {r["__cell"]: r for r in _histogram(keys)}
    order = sorted(cells)
    total_b, total_n = sum(r["b"] for r in cells.values()), sum(r["n"] for r in cells.values())
    mean, next_id, rounds, moved = total_b / shards, 1 << FIRST_BITS, [], keys
    while True:
        below, finer = 0, []
        for c in order:
            r = cells[c]
            first = int(below // mean) + 1 if mean else shards
            cut = any(min(k * mean - below, below + r["b"] - k * mean) > tolerance * mean / 2 for k in range(first, min(shards - 1, int((below + r["b"]) // mean)) + 1))
            wide_h, wide_d = r["h1"] > r["h0"], r["d1"] > r["d0"]
            if (cut or r["n"] > max(64, total_n // ROW_CELLS)) and (wide_h or wide_d):
                lo, hi = (r["h0"], r["h1"]) if wide_h else (r["d0"], r["d1"])
                finer.append({"cell": c, "by_doc": not wide_h, "lo": lo, "step": (hi - lo) // PROBES + 1, "first": next_id})
                next_id += PROBES
            below += r["b"]
        if not finer:
            break
        rounds.append(finer)
        moved = _probe(moved, finer, "inner")
        found = {r["__cell"]: r for r in _histogram(moved)}
        firsts = {f["cell"]: f["first"] for f in finer}
        order = [x for c in order for x in (range(firsts[c], firsts[c] + PROBES) if c in firsts else (c,)) if x in found or x in cells and c not in firsts]
        cells = {c: found.get(c) or cells[c] for c in order}

    below, used, places = 0, {}, []
    for c in order:
        r = cells[c]
        shard = min(shards - 1, int((below + r["b"] / 2) // mean)) if mean else 0
        places.append({"cell": c, "shard": shard, "base": used.get(shard, 0)})
        used[shard] = used.get(shard, 0) + r["n"]
        below += r["b"]

    out = _keyed(docs)
    for finer in rounds:
        out = _probe(out, finer, "left")
    small = small_table(docs.sparkSession, places, "cell bigint, shard int, base bigint").select(F.col("cell").alias("__cell"), "shard", F.col("base").alias("__base"))
    out = out.join(F.broadcast(small), "__cell")
    within = Window.partitionBy("__cell").orderBy("__h", "__d", "text_crc32", "size")
    return out.withColumns({"slot": F.col("__base") + F.row_number().over(within) - 1, "law": F.lit("bytes")}).drop("__cell", "__h", "__d", "__base").withColumnsRenamed(back)
