"""Packing of token ids into fixed-length rows by best fit decreasing.

Sequences longer than a row are split losslessly into full rows and a rest.  Within a window
of rows of a task, segments are placed longest first into the open bin with the least room
that holds them, found in a segment tree over room sizes.  Nothing is shuffled, and a task
holds one window at a time, so memory has the window's bound whatever the input.

An id takes two bytes where the vocabulary, with its end and padding ids, fits, else four.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bpe
from quern.llm.common import kept, tidy

ROW_IDS, WINDOW_IDS = 4096, 4 << 20
PACKED = "pack_id long, ids binary, n_ids int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"


def id_type(ids: int) -> str:
    """The little-endian type that holds the ids 0 to ids - 1."""
    return "<u2" if ids <= 1 << 16 else "<u4"


class RoomTree:
    """Open bins by their room (0..capacity); finds the smallest room of at least a size."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) of the best fit, removed from the tree."""
        at = size + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions of sizes (each 1..capacity), by best fit decreasing; ties keep their order."""
    tree, bins = RoomTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = tree.take(sizes[i])
        room, b = got if got else (capacity, len(bins))
        if not got:
            bins.append([])
        bins[b].append(i)
        if room > sizes[i]:
            tree.put(room - sizes[i], b)
    return bins


def _encoder(ranks: dict[bytes, int], pattern: str):
    """Text to ids as an array, kept over a worker's tasks."""
    import tiktoken

    key = "tiktoken", hash((pattern, frozenset(ranks.items())))
    made = kept(key, lambda: tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))

    def encode(text: str) -> np.ndarray:
        try:
            return made.encode_to_numpy(text, disallowed_special=())
        except BaseException as failure:  # a panic of the library is no Exception
            if isinstance(failure, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.frombuffer(bpe.Encoder(ranks, pattern)(text), "<i4")

    return encode


def token_ids(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids (binary, id_type of the vocabulary): the byte-level BPE ids of each text and an end id.

    The end id follows the vocabulary, the padding id follows it.  A null text counts as
    empty and is the end id alone; repeated rows and null doc_ids are kept; other columns are
    not read.  The tiktoken library encodes, faster than the transducer of `bpe`, whose ids
    it gives; a text that it fails on goes to the transducer.
    """
    end = max(ranks.values()) + 1
    kind = id_type(end + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = _encoder(ranks, pattern), np.array([end], kind).tobytes()
        for part in bpe.by_bytes(batches):
            ids = [encoder(t or "").astype(kind).tobytes() + last for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run, forget=False), "doc_id long, ids binary")


def pack(sequences: DataFrame, vocabulary: int, *, row_ids: int = ROW_IDS, window_ids: int = WINDOW_IDS) -> DataFrame:
    """Rows of exactly row_ids ids from sequences(doc_id, ids binary of id_type(vocabulary)).

    vocabulary counts all ids, the last of which is the padding.

    Columns: pack_id (unique), ids (padded), n_ids (without padding), cu_seqlens
    (0 and the end of each segment), position_resets (where positions start again from 0: the
    segment starts), doc_ids and doc_offsets (each segment's document and the place of its
    first id there).  Every id of every sequence is in one row, once.  Null or empty ids give
    no segment; repeated rows are packed as often as they occur; other columns are not read;
    an empty table gives no rows.
    """

    filler = np.array([vocabulary - 1], id_type(vocabulary)).tobytes()
    width = len(filler)

    def window(held: list[tuple[int, bytes]], task: int, made: int) -> Iterator[pa.RecordBatch]:
        segments = [(d, at, ids[width * at : width * (at + row_ids)]) for d, ids in held for at in range(0, len(ids) // width, row_ids)]
        bins = best_fit([len(s[2]) // width for s in segments], row_ids)
        for lo in range(0, len(bins), 512):
            cols: list[list] = [[] for _ in range(7)]
            for b, members in enumerate(bins[lo : lo + 512], made + lo):
                ids = b"".join(segments[i][2] for i in members)
                ends = np.cumsum([0] + [len(segments[i][2]) // width for i in members]).tolist()
                row = (task << 33 | b, ids + filler * (row_ids - ends[-1]), ends[-1], ends, ends[:-1], [segments[i][0] for i in members], [segments[i][1] for i in members])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["pack_id", "ids", "n_ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for d, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                held.append((d, ids.as_py() or b""))
                size += len(held[-1][1]) // width
                if size >= window_ids:
                    for out in window(held, task, made):
                        made += out.num_rows
                        yield out
                    held, size = [], 0
        yield from window(held, task, made)

    return sequences.select("doc_id", "ids").mapInArrow(tidy(run, forget=False), PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the packed matrix as Parquet, one binary value of row_ids ids a row; a lost task is written again."""
    packed.write.parquet(path)


def unpack(packed: DataFrame, vocabulary: int) -> DataFrame:
    """doc_id, offset, ids of every segment: the inverse of pack."""
    width = np.dtype(id_type(vocabulary)).itemsize
    ends = F.expr("slice(cu_seqlens, 2, size(position_resets))").alias("ends")
    return packed.select("ids", F.explode(F.arrays_zip("doc_ids", "doc_offsets", "position_resets", ends)).alias("s")).select(
        F.col("s.doc_ids").alias("doc_id"),
        F.col("s.doc_offsets").alias("offset"),
        F.expr(f"substring(ids, {width} * s.position_resets + 1, {width} * (s.ends - s.position_resets))").alias("ids"),
    )
