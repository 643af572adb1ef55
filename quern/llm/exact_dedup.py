"""Exact duplicates by deterministic block naming (DataFrame functions only).

A text is cut into fixed-size blocks.  Distinct blocks are sorted into integer names,
then adjacent names are paired and the distinct pairs named again, until every text
has one name.  Two texts get the same (level, name) exactly when they are equal.

A block's 64-bit hash only routes it: the distinct (hash, block) pairs are counted per
hash, and blocks whose hash is shared by different blocks get a sub-number by comparing
the blocks themselves, so no identity rests on a hash.  The text is shuffled once, after
map-side removal of repeats; every later exchange carries integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import lower_ascii, materialise, set_aside

BLOCK_CHARS = 8192


def _numbered(df: DataFrame, *keys: str) -> DataFrame:
    """Names for distinct rows: partition number and place in the partition's sort order."""
    return df.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def exact_dedup(
    docs: DataFrame,
    *,
    block_chars: int = BLOCK_CHARS,
    route: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256, level, name.

    Texts are equal when identical after lower-casing A-Z only.  Of equal texts the row
    with the largest doc_id is kept (keep_id).  A null text counts as empty; empty texts
    are equal to each other.  Repeated rows of one doc_id count as separate members and
    one of them is kept; a null doc_id loses to any other.  Other columns, whatever their names,
    are not read.  An empty table gives no rows.
    """
    text = lower_ascii(F.col("text"))
    pieces = F.regexp_extract_all(F.col("t"), F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    cut = docs.select("doc_id", text.alias("t")).select(
        "doc_id", F.sha2("t", 256).alias("sha"), F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(pieces).alias("blocks")
    )
    rows = materialise(
        cut.select("doc_id", "sha", F.transform("blocks", lambda b: route(b)).alias("hs")).withColumn("rid", F.monotonically_increasing_id())
    )

    distinct = cut.select(F.explode("blocks").alias("b")).select(route(F.col("b")).alias("h"), "b").distinct()
    names = materialise(_numbered(distinct.groupBy("h").agg(F.count("*").alias("n")), "h"))
    places = rows.select("rid", F.size("hs").alias("m"), F.posexplode("hs").alias("pos", "h"))
    state = places.join(names.select("h", "name", "n"), "h")
    if names.filter("n > 1").limit(1).count():
        # Different blocks under one hash: number them by their own order, from the texts.
        shared = names.filter("n > 1").select("h")
        again = distinct.join(shared, "h", "left_semi").withColumn("sub", F.row_number().over(_by("h", "b")))
        texts = cut.select("doc_id", "sha", F.posexplode("blocks").alias("pos", "b")).withColumn("h", route(F.col("b")))
        texts = texts.join(shared, "h", "left_semi").join(again, ["h", "b"]).select("doc_id", "sha", "pos", "sub").distinct()
        at = rows.select("rid", "doc_id", "sha")
        subs = texts.join(at, texts.doc_id.eqNullSafe(at.doc_id) & (texts.sha == at.sha)).select("rid", "pos", "sub")
        state = state.join(subs, ["rid", "pos"], "left")
        pair = materialise(state.select("rid", "m", "pos", F.col("name").alias("a"), F.coalesce("sub", F.lit(0)).cast("long").alias("b")))
        both = materialise(_numbered(pair.select("a", "b").distinct(), "a", "b"))
        state = pair.join(both, ["a", "b"])
    state = materialise(state.select("rid", "m", "pos", "name"))

    done, level = [], 0
    while True:
        done.append(state.filter("m = 1").select("rid", F.lit(level).alias("level"), "name"))
        state = state.filter("m > 1")
        if not state.limit(1).count():
            break
        level += 1
        pair = state.groupBy("rid", "m", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pair = materialise(pair)
        both = materialise(_numbered(pair.select("a", "b").distinct(), "a", "b"))
        state = materialise(pair.join(both, ["a", "b"]).select("rid", F.expr("cast((m + 1) div 2 as int) m"), "pos", "name"))

    ids = done[0]
    for more in done[1:]:
        ids = ids.unionByName(more)
    ids = materialise(ids.join(rows.select("rid", "doc_id", "sha"), "rid"))
    groups = materialise(
        ids.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size"))
    )
    return ids.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "level",
        "name",
    )


def _by(part: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that exact_dedup keeps: one of each group of equal texts."""
    names = docs.columns
    docs, back = set_aside(docs)
    verdict = materialise(exact_dedup(docs).select("doc_id", "keep_id", "kept", "text_sha256"))
    lost = verdict.filter("not kept").select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("__d"), F.col("text_sha256").alias("__s"), F.expr("doc_id <=> keep_id").alias("again")
    )
    keyed = docs.withColumns({"__d": F.coalesce("doc_id", F.lit(-(2**63))), "__s": F.sha2(lower_ascii(F.col("text")), 256)})
    out = keyed.join(lost.filter("not again").select("__d", "__s"), ["__d", "__s"], "left_anti")
    again = lost.filter("again").select("__d", "__s")
    if again.limit(1).count():  # rows repeated with their doc_id: one of each stays
        out = out.join(again, ["__d", "__s"], "left_anti").unionByName(out.join(again, ["__d", "__s"], "left_semi").dropDuplicates(["__d", "__s"]))
    return out.drop("__d", "__s").withColumnsRenamed(back).select(*[f"`{c}`" for c in names])
