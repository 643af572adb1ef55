"""Byte-level BPE encoding and decoding by a lazily determinised transducer.

The merges are never replayed over a text.  A token sequence is the encoding of its bytes
exactly when each token encodes to itself and each neighbouring pair encodes to that pair,
so the last token of every prefix is determined by the last tokens of shorter prefixes.
The transducer's state is what later bytes can still change: the bytes after the last
settled boundary, the token before it, and the last token at each position between.  A
boundary is settled once every position from which a longer token might still start leads
back through it; tokens before it are emitted, after a lookahead of less than the longest
token.  States and their transitions are made when first met and kept, up to a number; a
piece that leaves them then is ended by a search over the same pairs.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import kept, small_batches, tidy
from quern.llm.shingles import slices

#: Bounds of what one worker remembers, in entries; PIECE_BYTES bounds a remembered piece, so all have a bound in bytes.
MOST_STATES, MOST_PIECES, MOST_PAIRS, PIECE_BYTES = 30_000, 300_000, 250_000, 64
#: Pieces that leave full memory, for each state it holds, after which the states are forgotten and made anew.
STEPS_A_STATE = 100


class Transducer:
    """Encodes the bytes of one piece of text by `ranks` (token bytes to id, lower merges first)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        # What a token begins with or is, with its id in the second case.
        self.known = dict.fromkeys(self.prefixes, -1) | ranks
        # The longest other token that a token begins with.
        self.shorter = {i: s for t, i in ranks.items() if (s := next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), None)) is not None}
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.whole: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.ordered: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.keys: list[tuple] = []
        self.live: list[tuple[int, ...]] = []
        self.index: dict[tuple, int] = {}
        self.next: dict[int, tuple[int, bytes]] = {}
        self.final: dict[int, bytes] = {}
        self._reset()

    def _reset(self) -> None:
        """Forget all states but the first."""
        for held in (self.keys, self.live, self.index, self.next, self.final):
            held.clear()
        self.outside = 0
        self.keys.append((None, b"", ()))
        self.live.append((0,))
        self.index[self.keys[0]] = 0
        self.final[0] = b""

    def _merge(self, data: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """A few bytes encoded from the definition (merge the lowest pair, leftmost first), and the last pair merged."""
        parts, pair = [data[i : i + 1] for i in range(len(data))], None
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            pair = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, pair

    def merged(self, data: bytes) -> list[int]:
        return [self.ranks[p] for p in self._merge(data)[0]]

    def _stands_alone(self, token: int) -> bool:
        """Whether a token encodes to itself; notes the halves it is merged from."""
        known = self.whole.get(token)
        if known is None:
            parts, pair = self._merge(self.bytes_of[token])
            known = self.whole[token] = len(parts) == 1
            if known and pair:
                self.halves[token] = self.ranks[pair[0]], self.ranks[pair[1]]
        return known

    def _in_order(self, token: int) -> bool:
        """Whether every merge inside a token has a lower rank than the merge it leads to."""
        known = self.ordered.get(token)
        if known is None:
            known = self._stands_alone(token)
            if known and self.length[token] > 1:
                known = all((self.length[h] == 1 or h < token) and self._in_order(h) for h in self.halves[token])
            self.ordered[token] = known
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether a and b side by side encode to just these two.

        The merges at the touching ends are undone, latest first; between two of them a
        merge across the boundary must not have come first (of equal ranks the left one
        does).  Tokens whose merges are not in the order of their ranks are encoded anew.
        """
        if not (self._in_order(a) and self._in_order(b)):
            return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        left_due = right_due = 1 << 60  # ranks of the next merges on either side
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < left_due and across <= right_due:
                return False
            a_made = a if self.length[a] > 1 else -1
            b_made = b if self.length[b] > 1 else -1
            if a_made < 0 and b_made < 0:
                return True
            if b_made >= a_made:  # of equal ranks the left was merged first, so the right is undone first
                right_due, b = b, self.halves[b][0]
            else:
                left_due, a = a, self.halves[a][1]

    def _stands(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._may_follow(a, b)
        return known

    def _step(self, state: int, byte: int) -> tuple[int, bytes]:
        (before, window, last), starts = self.keys[state], self.live[state]
        window += byte.to_bytes(1, "little")
        token, live = None, []
        # A token that ends here began where one could still start; the longest that stands is the last token.
        for start in starts:
            tail = window[start:]
            if tail in self.prefixes:
                live.append(start)
            if token is None and (end := self.ranks.get(tail)) is not None and self._stands_alone(end):
                left = last[start - 1] if start else before
                if left is None or self._stands(left, end):
                    token = end
        live.append(len(window))
        length = self.length
        last = (*last, token)
        # The last boundary that all positions a later token may start at lead back through.
        settled = live[0]
        for at in live[1:]:
            while at != settled:
                if at > settled:
                    at -= length[last[at - 1]]
                else:
                    settled -= length[last[settled - 1]]
            if not settled:
                break
        out = b""
        if settled:
            out = self._tokens(last, settled)
            before, window, last = last[settled - 1], window[settled:], last[settled:]
            live = [at - settled for at in live]
        key = (before, window, last)
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.keys)
            self.keys.append(key)
            self.live.append(tuple(live))
        made = self.next[state << 8 | byte] = to, out
        return made

    def _tokens(self, last: tuple[int, ...], at: int) -> bytes:
        """The tokens that lead to a position."""
        out = []
        while at > 0:
            token = last[at - 1]
            out.append(self.packed[token])
            at -= self.length[token]
        return b"".join(out[::-1])

    def _leave(self, state: int, rest: bytes) -> bytes:
        """The tokens from a state to the end of a piece, without further states.

        At each place the longest token that stands there is taken, and given up for shorter
        ones where nothing can follow.  What leads to a place is its encoding, so a place that
        was given up is not entered again.
        """
        before, window, _ = self.keys[state]
        self.outside += 1
        if self.outside > STEPS_A_STATE * MOST_STATES:
            self._reset()
        known, pairs, length, shorter = self.known.get, self.pairs, self.length, self.shorter
        data, first, at = window + rest, -1 if before is None else before, 0
        size, left, path, closed = len(data), first, [], set()
        while at < size:
            token = self.single[data[at]]
            for end in range(at + 2, size + 1):
                found = known(data[at:end])
                if found is None:
                    break
                if found >= 0:
                    token = found
            while True:
                if token is None:
                    closed.add(at)
                    token = path.pop()
                    at -= length[token]
                    left = path[-1] if path else first
                elif not closed or at + length[token] not in closed:
                    stands = pairs.get(left << 32 | token)
                    if stands is None:
                        stands = self._stands(left, token) if left >= 0 else self._stands_alone(token)
                    if stands:
                        break
                token = shorter.get(token)
            path.append(token)
            left = token
            at += length[token]
        return b"".join([self.packed[t] for t in path])

    def encode(self, data: bytes) -> bytes:
        """The ids as little-endian 32-bit integers.  A piece that is a token is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return self.packed[whole]
        out, state, get, rest = [], 0, self.next.get, iter(data)
        for byte in rest:
            made = get(state << 8 | byte)
            if made is None:
                if len(self.keys) >= MOST_STATES:
                    out.append(self._leave(state, data[-1 - rest.__length_hint__() :]))
                    return b"".join(out)
                made = self._step(state, byte)
            state, ids = made
            if ids:
                out.append(ids)
        end = self.final.get(state)
        if end is None:
            last = self.keys[state][2]
            end = self.final[state] = self._tokens(last, len(last))
        out.append(end)
        return b"".join(out)


class Utf8Stream:
    """Incremental UTF-8 reader: push bytes, get the characters completed so far."""

    def __init__(self) -> None:
        self.tail = b""

    @staticmethod
    def pending(data: bytes) -> int:
        """Bytes at the end that begin a character and do not finish it."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                return back if back < (4 if b >= 0xF0 else 3 if b >= 0xE0 else 2) else 0
        return 0

    def push(self, data: bytes) -> str:
        data = self.tail + data
        cut = len(data) - self.pending(data)
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.tail = self.tail, b""
        return rest.decode("utf-8", "replace")


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces(dict):
    """The ids of pieces: what is met first is encoded; pieces of a bound in bytes are kept, in two generations."""

    def __init__(self, fst: Transducer) -> None:
        super().__init__()
        self.fst = fst
        self.before: dict[str, bytes] = {}  # an earlier generation, from which pieces met again are taken over

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            data = piece.encode()
            ids = self.fst.encode(data)
            if len(data) > PIECE_BYTES:
                return ids
        if len(self) >= MOST_PIECES:
            self.before = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Texts to ids: each match of the pattern by the transducer, met pieces from memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.find, self.fst = regex.compile(pattern).findall, Transducer(ranks)
        self.seen = Pieces(self.fst)

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers; null counts as empty."""
        return b"".join(map(self.seen.__getitem__, self.find(text or "")))


def encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The encoder of a vocabulary and pattern, kept over a worker's tasks."""
    return kept(("encoder", hash((pattern, frozenset(ranks.items())))), lambda: Encoder(ranks, pattern))


def _id_lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids array<int> for each row of docs(doc_id, text, ...).

    Each match of pattern is encoded by itself, without special tokens.  A null text counts
    as empty and has no ids; repeated rows and null doc_ids are kept; other columns are not
    read; an empty table gives no rows.  A task holds one batch of texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(ranks, pattern)
        for part in by_bytes(batches):
            ids = _id_lists([made(text) for text in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run, forget=False), "doc_id long, ids array<int>")


def by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts whose texts have a bound in bytes together, or one row with a longer one."""
    for batch in batches:
        for lo, hi in slices(batch.column("text"), 1 << 20):
            yield batch.slice(lo, hi - lo)


def _joined(tokens: pa.BinaryArray) -> bytes:
    """The bytes of all tokens: the values an array holds lie side by side."""
    if tokens.null_count:
        raise ValueError("an id is null or outside the vocabulary")
    _, ends, data = tokens.buffers()
    return data.to_pybytes()[: np.frombuffer(ends, np.int32)[len(tokens)]]


class Decoder:
    """Ids to text, a chunk of ids at a time through Utf8Stream."""

    def __init__(self, ranks: dict[bytes, int], chunk: int) -> None:
        tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.table, self.chunk = pa.array(tokens, pa.binary()), chunk

    def __call__(self, ids: pa.Array) -> str:
        stream, out = Utf8Stream(), []
        for at in range(0, len(ids), self.chunk):
            out.append(stream.push(_joined(self.table.take(ids[at : at + self.chunk]))))
        out.append(stream.end())
        return "".join(out)


def decode(encoded: DataFrame, ranks: dict[bytes, int], chunk: int = 8192) -> DataFrame:
    """doc_id, ids and text for each row of encoded(doc_id, ids).

    ids are turned into bytes a chunk at a time and read through Utf8Stream; bytes that are
    no UTF-8 become U+FFFD.  Null ids count as none.  An id outside the vocabulary is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Decoder(ranks, chunk)
        for batch in batches:
            for part in (batch.slice(lo, 256) for lo in range(0, batch.num_rows, 256)):
                texts = [made(ids.values) if ids.is_valid else "" for ids in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run, forget=False), "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk: int = 8192) -> DataFrame:
    """decode(encode(docs)) in one worker: doc_id, ids and the text decoded from the ids; the cases are theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_, decode_ = encoder(ranks, pattern), Decoder(ranks, chunk)
        for part in by_bytes(batches):
            ids = _id_lists([encode_(text) for text in part.column("text").to_pylist()])
            texts = pa.array([decode_(x.values) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, texts], names=["doc_id", "ids", "text"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run, forget=False), "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of decode's rows."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
