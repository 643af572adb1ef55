"""Benchmark passages in documents by pigeonhole edit matching.

A test item of L characters with an error budget of k edits is split into k + 1 pieces: a
copy within the budget holds one piece unchanged.  All pieces are found in one pass of an
Aho-Corasick automaton over each text; around a hit the item is verified by Myers'
bit-parallel edit distance, its vector being one integer of L bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import kept, materialise, tidy

ERROR_RATE = 0.08
LEAST_CHARS = 32
BLOCK_CHARS = 8 << 20
_INSIDE = re.compile(r"\w\w")


def normal(text: str | None) -> str:
    """Lower case, each run of white space one space."""
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of pattern within text, the first of equals, if at most `most`."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score <= most and (best is None or score < best[0]):
            best = score, j + 1
    return best


class Matcher:
    """Finds the items [(item_id, normalised text)] in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, least: int = 0) -> None:
        import ahocorasick

        self.items, self.auto = items, ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        self.least = least  # shorter items are found whole, as words of their own
        self.budget = [int(len(t) * error_rate) if len(t) >= least else 0 for _, t in items]
        for n, (_, text) in enumerate(items):
            k = self.budget[n] + 1
            cuts = [len(text) * i // k for i in range(k + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((n, a))
        for piece, places in pieces.items():
            self.auto.add_word(piece, (len(piece), places))
        if items:
            self.auto.make_automaton()

    def find(self, text: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start bound, end) in the normalised text, the best place for each item."""
        text = normal(text)
        best: dict[int, tuple[int, int]] = {}
        searched: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.auto.iter(text) if self.items else ():
            for n, at in places:
                item, k = self.items[n][1], self.budget[n]
                start = end + 1 - size - at
                if len(item) < self.least and (start and _INSIDE.match(text, start - 1) or _INSIDE.match(text, end)):
                    continue
                if n in best and best[n][0] == 0:
                    continue
                for lo, hi in _unsearched(searched.setdefault(n, []), max(0, start - k), min(len(text), start + len(item) + 2 * k), len(item) + k):
                    window = text[lo:hi]
                    exact = window.find(item)
                    got = (0, exact + len(item)) if exact >= 0 else myers(item, window, k)
                    if got:
                        best[n] = min(best.get(n, (k + 1, 0)), (got[0], lo + got[1]))
        for n, (distance, end) in sorted(best.items()):
            yield self.items[n][0], distance, max(0, end - len(self.items[n][1]) - distance), end


def _unsearched(done: list[list[int]], lo: int, hi: int, longest: int) -> list[tuple[int, int]]:
    """The stretches to search so that every match of at most `longest` characters inside [lo, hi) has been met.

    done holds the ranges whose matches are all met, and is brought up to date.  A range that
    overlaps [lo, hi) grows by it: only matches across its old end are new, and they reach
    back into it by less than `longest` characters.
    """
    for old in done:
        if old[0] <= lo and hi <= old[1]:
            return []
    for old in done:
        if old[0] <= lo < old[1]:
            new = max(old[0], old[1] - longest), hi
            old[1] = hi
            return [new]
        if old[0] < hi <= old[1]:
            new = lo, min(old[1], old[0] + longest)
            old[0] = lo
            return [new]
    done.append([lo, hi])
    return [(lo, hi)]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items in blocks of at most BLOCK_CHARS characters (or one longer item), and whether a block is the last.

    A block is done with before the next is fetched, so that is also what the driver holds.
    """
    block, held = [], 0
    for r in benchmark.select("item_id", "text").dropna().distinct().toLocalIterator():
        text = normal(r["text"])
        if not text:
            continue
        if block and held + len(text) > BLOCK_CHARS:
            yield block, False
            block, held = [], 0
        block.append((r["item_id"], text))
        held += len(text)
    yield block, True


def _matcher(items: list[tuple[int, str]], rate: float, least: int) -> Matcher:
    return kept(("matcher", hash((tuple(items), rate, least))), lambda: Matcher(items, rate, least))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, distance, start, end.

    start and end are places in the normalised text (start a lower bound when distance > 0).
    Items of fewer than least_chars normalised characters are found exactly, between word
    boundaries; null texts and null or blank items match nothing; repeated rows each give
    their rows; documents without an item give none; an empty table on either side gives
    none; other columns are not read.  A benchmark beyond one block is searched block by
    block, each over all documents.
    """
    docs, out = docs.select("doc_id", "text"), None
    for items, last in _blocks(benchmark):

        def run(batches, items=items):
            matcher = _matcher(items, error_rate, least_chars)
            for batch in batches:
                rows = [(d, *hit) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for hit in matcher.find(text.as_py())]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "distance", "start", "end"])

        made = docs.mapInArrow(tidy(run, forget=False), "doc_id long, item_id long, distance long, start long, end long")
        made = made if last and out is None else materialise(made)
        out = made if out is None else out.unionByName(made)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows of docs, all columns, that hold no item; nothing is shuffled.  The cases are find_leaks'."""
    for items, last in _blocks(benchmark):

        def run(batches, items=items):
            matcher = _matcher(items, error_rate, least_chars)
            for batch in batches:
                clean = [next(matcher.find(text.as_py()), None) is None for text in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(tidy(run, forget=False), docs.schema)
        docs = docs if last else materialise(docs)
    return docs
