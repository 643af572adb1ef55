"""Self-join of documents by the Jaccard similarity of their word shingles.

Shingle hashes are dealt into groups; a set's point is its vector of group counts, and the
overlap of two sets is at most the sum of the smaller counts.  Points are held in R-trees
whose nodes keep the largest count of each group and the smallest set size, so a node whose
bound is below what the threshold needs is skipped with all below it.

Sets that are equal are one point.  Points meet in the trees of the rare shingles they share:
two sets that reach the threshold share one among the first n - ceil(t n) + 1 of any common
order, and k more among k more, so points with fewer shared ones are left out.  The order here
puts shingles from crowded hash cells last, so that very common passages form no tree.
Points whose bound survives are joined into blobs; every link lies in
one blob.  The sets of a blob then meet once, in finer trees, and surviving pairs are verified
on the sets themselves.  Both searches keep a union-find, leave out pairs it has joined and
give a spanning forest: never more pairs than points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import shingles
from quern.llm.common import components, discard, materialise, release, small_batches, thinned, tidy

CELL_BITS = 21
TILE, MASS = 2048, 2 << 20  # rows and shingles that meet in one tree
ANCHORS = 64
MORE = 4  # percent of a set by which its prefix is longer than one common shingle needs
LEAF = 16


def _groups(n: int) -> int:
    """Number of groups: a power of two that leaves four to eight shingles in each, 16 at least."""
    return max(16, 1 << max(0, (n - 1) // 8).bit_length())


def _counts(s: np.ndarray, g: int) -> np.ndarray:
    """How many hashes of a set fall into each of g groups (their low bits), in bytes.

    A count beyond a byte makes all of them the greatest, which bounds any overlap.
    """
    n = np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g)
    return n.astype(np.uint8) if n.max() < 256 else np.full(g, 255, np.uint8)


def _needed(a, b, percent: int):
    """Least overlap of sets of sizes a and b (numbers or arrays) that reaches the similarity."""
    return -(-(percent * (a + b)) // (100 + percent))


def _cells(size: int):
    """Counts of the cells that stand out among a task's shingles; a very common shingle does so in every task."""

    def run(batches):
        total, held = np.zeros(1 << CELL_BITS, np.int64), []

        def add():
            if held:
                at = (np.concatenate(held) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
                total[:] += np.bincount(at, minlength=len(total))
                held.clear()

        for batch in batches:
            for s in shingles.shingle_sets(batch.column(0), size):
                held.append(s)
                if len(held) >= 4096 or len(s) > 1 << 18:
                    add()
        add()
        at = np.flatnonzero(total > 4 * total.mean() + 16)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return run


def _points(crowd: dict[int, int], percent: int, size: int):
    def run(batches):
        crowded = np.zeros(1 << CELL_BITS, np.uint8)
        crowded[list(crowd)] = list(crowd.values())
        for batch in batches:
            for lo, hi in shingles.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                n, f1, f2, sig, vec, head = [], [], [], [], [], []
                for s in shingles.shingle_sets(part.column("text"), size):
                    n.append(len(s))
                    f1.append(int(np.sum(s, dtype=np.uint64)) - 2**63)
                    f2.append(int(np.sum(shingles.mix(s ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)) - 2**63)
                    first = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    order = np.argsort(crowded[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")
                    sig.append(s[order[: first + -(-MORE * len(s) // 100)]].view(np.int64))
                    head.append(first)
                    vec.append(_counts(s, _groups(len(s))).tobytes())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sig])]).astype(np.int32)
                flat = np.concatenate(sig) if sig else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(vec, pa.binary()), pa.array(head, pa.int32())],
                    names=["doc_id", "n", "f1", "f2", "sig", "vec", "head"],
                )

    return run


def _sets(size: int):
    """The sets of texts that have the size and sum asked for; without these columns, of all texts."""

    def run(batches):
        for batch in batches:
            for lo, hi in shingles.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                made = [(len(s), int(np.sum(s, dtype=np.uint64)) - 2**63, s.tobytes()) for s in shingles.shingle_sets(part.column("text"), size)]
                if "cid" in part.schema.names:
                    wanted = zip(part.column("n").to_pylist(), part.column("f1").to_pylist(), strict=True)
                    keep = [i for i, (m, w) in enumerate(zip(made, wanted, strict=True)) if m[:2] == w]
                    own = part.select(["cid", "blob", "n"]).take(pa.array(keep, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([made[i][2] for i in keep], pa.binary())], names=["cid", "blob", "n", "data"])
                else:
                    n, f1, data = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(data, pa.binary())], names=["n", "f1", "data"])

    return run


def _bound(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (na, nb) in enumerate(zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True)):
                if 100 * min(na, nb) < percent * max(na, nb):
                    continue
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in ("va", "vb"))
                g = min(len(x), len(y))
                if int(np.minimum(_folded(x, g), _folded(y, g)).sum(dtype=np.int64)) >= _needed(na, nb, percent):
                    keep.append(i)
            took = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([took.column("a"), took.column("b")], names=["a", "b"])

    return run


def _folded(counts: np.ndarray, g: int) -> np.ndarray:
    """Counts of a finer grid as those of g groups: groups are low bits of the hash."""
    return counts if len(counts) == g else counts.reshape(-1, g).sum(0, dtype=np.uint16)


class RTree:
    """Points (count vectors with set sizes) under nodes that bound every overlap below them."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray) -> None:
        self.vectors, self.sizes = vectors, sizes
        self.root = self._node(np.arange(len(sizes)))

    def _node(self, rows: np.ndarray):
        top, least, most = self.vectors[rows].max(0), self.sizes[rows].min(), self.sizes[rows].max()
        if len(rows) <= LEAF:
            return top, least, most, rows, None
        spread = top.astype(np.int64) - self.vectors[rows].min(0)
        by = self.sizes[rows] if most > least * 5 // 4 else self.vectors[rows, int(spread.argmax())]
        order = rows[np.argsort(by, kind="stable")]
        half = len(order) // 2
        return top, least, most, None, (self._node(order[:half]), self._node(order[half:]))

    def search(self, vectors: np.ndarray, sizes: np.ndarray, percent: int, allowed=lambda row, qs: qs, exact_sizes: bool = True) -> Iterator[tuple[int, np.ndarray]]:
        """(row, positions of queries) whose bound reaches the similarity, best first, among those allowed for the row.

        Without exact_sizes the sizes are only the least that a set may have.
        """
        stack = [(self.root, np.arange(len(sizes)))]
        while stack:
            (top, least, most, rows, kids), qs = stack.pop()
            if exact_sizes:
                qs = qs[(100 * sizes[qs] >= percent * least) & (100 * most >= percent * sizes[qs])]
            if not len(qs):
                continue
            if rows is None:
                bound = np.minimum(vectors[qs], top).sum(1, dtype=np.int64)
                other = np.maximum(least, -(-percent * sizes[qs] // 100)) if exact_sizes else least
                qs = qs[bound >= _needed(sizes[qs], other, percent)]
                if len(qs):
                    stack += [(k, qs) for k in kids]
                continue
            for r in rows.tolist():
                own = allowed(r, qs)
                if not len(own):
                    continue
                bound = np.minimum(vectors[own], self.vectors[r]).sum(1, dtype=np.int64)
                spare = bound - _needed(sizes[own], self.sizes[r], percent)
                fits = spare >= 0
                if exact_sizes:
                    fits &= 100 * np.minimum(sizes[own], self.sizes[r]) >= percent * np.maximum(sizes[own], self.sizes[r])
                if fits.any():
                    own, spare = own[fits], spare[fits]
                    yield r, own[np.argsort(-spare, kind="stable")]


class Tile:
    """Rows (q, own, cid, comp, n, data) that meet; pairs of a row with q and one with own are searched.

    data is a point's counts, or with exact the set itself, on which surviving pairs are verified.
    """

    def __init__(self, rows: list[tuple], percent: int, exact: bool) -> None:
        q, own, cid, comp, n = (np.array(c) for c in list(zip(*rows, strict=True))[:5])
        self.q, self.own, self.cid, self.n = q.astype(bool), own.astype(bool), cid, n
        _, self.label = np.unique(comp, return_inverse=True)
        self.percent, self.exact, self.exact_sizes = percent, exact, True
        self.data = [np.frombuffer(r[5], np.uint64 if exact else np.uint8) for r in rows]
        # Sizes of one class are within a factor of two, and only neighbouring classes can be similar.
        self.kind = np.array([len(d).bit_length() for d in self.data])

    def _vectors(self, at: np.ndarray, g: int) -> np.ndarray:
        return np.array([_counts(self.data[i], g) if self.exact else _folded(self.data[i], g) for i in at.tolist()])

    def _groups(self, a: np.ndarray, b: np.ndarray) -> int:
        if not self.exact:
            return min(len(self.data[i]) for i in (a[0], b[0]))
        fine = 16 * _groups(int(min(self.n[a].max(), self.n[b].max())))
        while fine > 16 and fine * (len(a) + len(b)) > 64 << 20:
            fine //= 2
        return fine

    def links(self) -> Iterator[tuple[int, int]]:
        """(smallest cid, cid) of the rows of each tree that pairs has made."""
        row = {c: i for i, c in enumerate(self.cid.tolist())}
        ends = sorted({c for pair in list(self.pairs()) for c in pair})
        least: dict[int, int] = {}
        for c in ends:
            root = least.setdefault(int(self.label[row[c]]), c)
            if root != c:
                yield root, c

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Pairs of cids that join the rows' components: a spanning forest of what is similar."""
        if self.label.max() == 0:
            return
        for kind in np.unique(self.kind).tolist():
            for step in (0, 1, -1):
                queries, others = np.flatnonzero(self.q & (self.kind == kind)), np.flatnonzero(self.own & (self.kind == kind + step))
                if step == -1 and (self.q & self.own).all() or not len(queries) or not len(others):
                    continue  # met from the other side
                g = self._groups(queries, others)
                yield from self.joined(queries, others, self._vectors(queries, g), self._vectors(others, g))

    def joined(self, queries: np.ndarray, others: np.ndarray, vq: np.ndarray, vo: np.ndarray) -> Iterator[tuple[int, int]]:
        both = self.q & self.own

        def allowed(r: int, qs: np.ndarray) -> np.ndarray:
            at = queries[qs]
            return qs[(self.label[at] != self.label[others[r]]) & ~(both[at] & both[others[r]] & (self.kind[at] == self.kind[others[r]]) & (at > others[r]))]

        for r, qs in RTree(vo, self.n[others]).search(vq, self.n[queries], self.percent, allowed, self.exact_sizes):
            y = int(others[r])
            for x in queries[qs].tolist():
                if self.label[x] != self.label[y] and (not self.exact or self.similar(x, y)):
                    self.label[self.label == self.label[x]] = self.label[y]
                    yield min(int(self.cid[x]), int(self.cid[y])), max(int(self.cid[x]), int(self.cid[y]))

    def similar(self, x: int, y: int) -> bool:
        a, b = sorted((self.data[x], self.data[y]), key=len)
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        return int((b[at] == a).sum()) >= _needed(len(a), len(b), self.percent)


def _search(made):
    """Search the tiles of a partition, each a run of rows of one (part, tile, chunk); one is held at a time."""

    def run(batches):
        now, held = None, []

        def pairs() -> pa.RecordBatch:
            found = sorted(set(made(held).links())) if held else []
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("part", "tile", "chunk", "q", "own", "cid", "comp", "n", "data")]
            for key, *row in zip(zip(*cols[:3], strict=True), *cols[3:], strict=True):
                if key != now:
                    yield pairs()
                    now, held = key, []
                held.append(tuple(row))
        yield pairs()

    return run


def dealt(rows: DataFrame, data: DataFrame, made) -> DataFrame:
    """Links (a, b) of rows(part, cid, comp, n) between different comps of a part, as trees of each tile.

    made turns a tile's rows into a Tile, whose data is that of data(cid, data).  Rows
    outside the part's largest comp are queries against all its rows, so the work grows
    with their number times the part, not with the square of a part that is joined already.
    A part beyond TILE rows or MASS shingles is cut into tiles, its queries into chunks.
    """
    kinds = rows.groupBy("part", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    sizes = kinds.groupBy("part").agg(F.sum("k").alias("m"), F.sum("s").alias("mass"), F.max(F.struct("k", "s", "comp")).alias("most"), F.count("*").alias("comps"))
    sizes = sizes.filter("comps > 1").select(
        "part", F.col("most.comp").alias("most"), F.expr(f"cast(greatest(ceil(m / {TILE}), ceil(mass / {MASS})) as int)").alias("parts"),
        F.expr(f"cast(greatest(ceil((m - most.k) / {TILE}), ceil((mass - most.s) / {MASS}), 1) as int)").alias("chunks"),
    )
    own = rows.join(materialise(sizes), "part").withColumns({"tile": F.expr("pmod(xxhash64(cid), parts)"), "chunk": F.expr("pmod(xxhash64(cid, 1), chunks)"), "ask": F.expr("comp <> most")})
    # Each row of a small part both asks and is there; in a large one it is there once for each chunk, and asks once in each tile.
    small, once = F.expr("parts = 1 and chunks = 1"), F.array(F.struct("tile", "chunk", F.col("ask").alias("q"), F.lit(True).alias("own")))
    there = F.expr("transform(sequence(0L, chunks - 1L), c -> struct(tile, c as chunk, false as q, true as own))")
    asks = F.expr("if(ask, transform(sequence(0L, parts - 1L), t -> struct(t as tile, chunk, true as q, false as own)), array())")
    tiles = own.select("part", "cid", "comp", "n", F.inline(F.when(small, once).otherwise(F.concat(there, asks))))
    return _met(tiles.join(data.select("cid", "data"), "cid").select(*_MET), made)


_MET = ["part", "tile", "chunk", "q", "own", "cid", "comp", "n", "data"]


def _met(tiles: DataFrame, made) -> DataFrame:
    key = ["part", "tile", "chunk"]
    return tiles.repartition(*key).sortWithinPartitions(*key).mapInArrow(tidy(_search(made)), "a long, b long")


def _verified(sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) of sets(part, cid, n, data), each part a blob, as forests.

    Sets of a part meet in tiles, with a few ANCHORS in all tiles of a large one, so that
    what is similar all over is one component before the rest is dealt out again.
    """
    made = partial(Tile, percent=percent, exact=True)
    sizes = sets.groupBy("part").agg(F.count("*").alias("m"), F.sum("n").alias("mass"))
    sizes = materialise(sizes.select("part", "m", F.expr(f"cast(greatest(ceil(m / {TILE}), ceil(mass / {MASS})) as int)").alias("parts")).filter("m > 1"))
    own = sets.join(sizes, "part").withColumns({"comp": F.col("cid"), "q": F.lit(True), "own": F.lit(True), "chunk": F.lit(0)})
    anchor = F.expr(f"parts > 1 and pmod(xxhash64(cid, 2), cast(ceil(m / {ANCHORS}) as int)) = 0")
    home = F.expr("array(pmod(xxhash64(cid), parts))")
    tiles = own.withColumn("tile", F.explode(F.when(anchor, F.expr("sequence(0L, parts - 1L)")).otherwise(home)))
    links = materialise(_met(tiles.select(*_MET), made))
    large = sizes.filter("parts > 1").select("part")
    if large.limit(1).count():
        comp = components(links).withColumnRenamed("node", "cid")
        rest = sets.select("part", "cid", "n").join(large, "part").join(comp, "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
        links = links.unionByName(materialise(dealt(materialise(rest.select("part", "cid", "comp", "n")), sets, made)))
    return links


def jaccard_components(docs: DataFrame, *, percent: int = 80, size: int = 5) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_shingles, component_id, n_texts.

    Texts are read with A-Z lower-cased, as words of characters other than space and
    \\t\\n\\v\\f\\r.  A set is the distinct `size`-word shingles, or the whole sequence of a
    shorter text.  Two documents link when 100 |A & B| >= percent |A | B|.  component_id is
    the smallest doc_id reachable, n_texts the number of different sets there.  A null or
    wordless text has no shingles and is a component of its own (its own doc_id).  Repeated
    rows each get a row.  Other columns are not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    cells = docs.select("text").mapInArrow(tidy(_cells(size)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    crowd = {r["cell"]: int(r["n"]).bit_length() for r in cells}  # a fourth of the cells at most, whatever the input

    points = docs.mapInArrow(tidy(_points(crowd, percent, size)), "doc_id long, n long, f1 long, f2 long, sig array<long>, vec binary, head int")
    points = materialise(points.withColumn("rid", F.monotonically_increasing_id()))
    classes = points.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc"), F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "rid", "doc_id")).alias("one"))
    classes = materialise(classes.select("f1", "f2", "n", "doc", F.col("one.rid").alias("rid"), F.col("one.doc_id").alias("text_id"), F.monotonically_increasing_id().alias("cid")))
    members = materialise(points.select("doc_id", "n", "f1", "f2").join(classes.select("f1", "f2", "n", "cid"), ["f1", "f2", "n"], "left").select("doc_id", "n", "cid"))
    keyed = materialise(points.select("rid", "n", "sig", "vec", "head").join(classes.select("rid", "cid"), "rid").select("cid", "n", "sig", "vec", "head"))
    discard(points)
    release(spark)

    rare = keyed.select("cid", F.inline(F.expr("transform(sig, (h, i) -> struct(h, i < head as first))")))
    shared = materialise(rare.groupBy("h").agg(F.count("*").alias("m"), F.min("cid").alias("r")).filter("m > 1"))
    every = materialise(rare.join(shared, "h").select("h", "cid", "r", "first"))
    discard(shared)
    release(spark)
    enough = every.groupBy("cid").count().join(keyed.select("cid", "n"), "cid").filter(F.expr(f"count > {MORE} * {percent} * n div 10000"))
    rows = materialise(every.join(enough.select("cid", "n"), "cid"))
    discard(every)

    # Each point first tries the one, of the smallest points of its trees, that it shares most with.
    weights = keyed.select("cid", "n", "vec")
    x, y = (weights.select(F.col("cid").alias(p), F.col("n").alias(f"n{p}"), F.col("vec").alias(f"v{p}")) for p in "ab")
    star = rows.filter("cid > r").groupBy("cid", "r").count().groupBy("cid").agg(F.max(F.struct("count", (-F.col("r")).alias("r"))).alias("most"))
    star = materialise(star.select((-F.col("most.r")).alias("a"), F.col("cid").alias("b")))
    star = materialise(star.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "va", "vb").mapInArrow(tidy(_bound(percent)), "a long, b long"))
    # What hangs on one point, over two steps, is joined already.
    over = star.join(star.select(F.col("a").alias("top"), F.col("b").alias("a")), "a", "left").select(F.col("b").alias("cid"), F.coalesce("top", "a").alias("component"))
    placed = rows.filter("first").select("h", "cid", "n").join(over, "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    placed = materialise(placed.select("h", "cid", "comp", "n"))
    discard(rows)
    # Shingles of one passage often have the same members; one tree serves all of them.
    same = [F.bit_xor(F.xxhash64("cid")).alias("x0"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("x1"), F.count("*").alias("rows")]
    split = placed.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), *same).filter("c0 < c1")
    split = materialise(split.groupBy("x0", "x1", "rows").agg(F.min("h").alias("h")).select("h"))
    open_ = materialise(placed.join(split, "h").select(F.col("h").alias("part"), "cid", "comp", "n"))
    found = materialise(dealt(open_, keyed.select("cid", F.col("vec").alias("data")), partial(Tile, percent=percent, exact=False)))
    for used in (placed, split, open_):
        discard(used)
    release(spark)

    blobs = components(star.unionByName(found)).select(F.col("node").alias("cid"), F.col("component").alias("blob"))
    wanted = materialise(blobs.join(classes.select("cid", F.col("text_id").alias("doc_id"), "f1", "n"), "cid"))
    discard(keyed)
    links = _verified(materialise(_read_sets(docs, wanted, size)).withColumnRenamed("blob", "part"), percent)
    release(spark)

    comp = components(links).withColumnRenamed("node", "cid")
    known = materialise(classes.select("cid", "doc").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    least = materialise(known.groupBy("component").agg(F.min("doc").alias("component_id"), F.count("*").alias("n_texts")))
    named = materialise(known.join(least, "component").select("cid", "component_id", "n_texts"))
    return members.join(named, "cid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_texts", F.lit(0)).alias("n_texts")
    )


def _read_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """cid, blob, n, data of the classes wanted(cid, blob, doc_id, f1, n), read again from their texts."""
    kinds = wanted.groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(2).collect()
    sets = thinned(docs, wanted, "doc_id").join(wanted, "doc_id").select("cid", "blob", "n", "f1", "text").mapInArrow(tidy(_sets(size)), "cid long, blob long, n long, data binary")
    if any(r["doc_id"] is None for r in kinds):  # classes of rows without a doc_id
        nameless = docs.filter("doc_id is null").select("text").mapInArrow(tidy(_sets(size)), "n long, f1 long, data binary")
        sets = sets.unionByName(nameless.join(wanted.filter("doc_id is null").drop("doc_id"), ["n", "f1"]).select("cid", "blob", "n", "data"))
    return sets.dropDuplicates(["cid"]) if kinds else sets


def keep_one(docs: DataFrame, *, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of docs, all columns, but those whose component has a smaller doc_id.

    Rows with a null doc_id stay.
    """
    verdict = materialise(jaccard_components(docs, percent=percent, size=size).select("doc_id", "component_id"))
    stay = verdict.filter("doc_id = component_id").select("doc_id")
    gone = materialise(verdict.filter("doc_id <> component_id").select("doc_id").join(stay, "doc_id", "left_anti").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
