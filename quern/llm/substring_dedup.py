"""Near-duplicate passages by compact windows.

A text's tokens are its sequences of TOKEN words; their hashes have a Cartesian tree.  A node
whose span holds at least `least` tokens is a compact window: every subsequence of its span
that contains the node has the node's token as its min-hash signature.  Two passages of WORDS
words with PERCENT of their shingles in common have at most one edit between equal words, so
they share a run of at least 25 equal words (`run_words`), longer passages a longer one; the
tokens of a shared run have the same signature in both texts.  So every such pair of passages
meets, whichever hash function is used.

Of the places that meet, each is joined with the first, and joined places are verified on the
texts: runs of equal words are chained over edits in both directions while the similarity
holds.  Places that prove to be in no passage are dealt by the runs of 25 words around them:
two places of one near passage share one of these.  There the words around a place meet those
of all others in tiles, bounded by counts of their shingles, and places that are similar go
to the same verification.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import shingles
from quern.llm.common import discard, materialise, release, small_batches, thinned, tidy
from quern.llm.jaccard_join import Tile, _needed, dealt

WORDS, SHINGLE, PERCENT = 50, 5, 80
_SALT = np.uint64(0x1234567)
_BASE = 0x9E3779B97F4A7C15
_GROUPS = 512


def run_words(words: int, size: int, percent: int) -> int:
    """The equal words in a row that two passages of `words` words of the similarity share at least."""
    n = words - size + 1
    common = math.ceil(percent * 2 * n / (100 + percent))
    return math.ceil(common / ((n - common) // (size - 1) + 1)) + size - 1


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(left, node, right) of the Cartesian tree's nodes whose span holds `least` values; ties go left."""
    n = len(values)
    if n < least:
        return []
    # Only minima of some window of `least` values can have such a span, and they bound each other.
    blocks = -(-n // least)
    padded = np.full(blocks * least, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, least)
    head = np.minimum.accumulate(grid, 1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(tail[: n - least + 1], head[least - 1 : n])
    reach = np.full(n, 0, np.uint64)  # for each place, the greatest minimum of the windows over it
    spread = np.zeros(n + least - 1, np.uint64)
    spread[least - 1 : n] = low
    width = 1
    while width * 2 <= least:
        spread[: len(spread) - width] = np.maximum(spread[: len(spread) - width], spread[width:])
        width *= 2
    reach = np.maximum(spread[:n], spread[least - width : least - width + n])
    keep = np.flatnonzero(values <= reach)
    out, ats, tops, lefts = [], [], [], []
    for p, v in zip(keep.tolist(), values[keep].tolist(), strict=True):
        while tops and tops[-1] > v:
            tops.pop()
            at, left = ats.pop(), lefts.pop()
            if p - left >= least:
                out.append((left, at, p - 1))
        lefts.append(ats[-1] + 1 if ats else 0)
        ats.append(p)
        tops.append(v)
    out += [(left, at, n - 1) for left, at in zip(lefts, ats, strict=True) if n - left >= least]
    return out


def token_words(words: int, size: int, percent: int) -> int:
    """Words of a token: two thirds of the shared run, so that common phrases make no token."""
    return max(size, run_words(words, size, percent) * 2 // 3)


def _windows(words_least: int, size: int, percent: int):
    """The places (doc_id, key, at) of the compact windows' tokens."""
    token = token_words(words_least, size, percent)
    least = run_words(words_least, size, percent) - token + 1

    def run(batches):
        for batch in batches:
            for lo, hi in shingles.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                words, before = shingles.word_hashes(part.column("text"))
                made = shingles.mix(shingles.sequences(words, before, token)[0] ^ _SALT)
                ids, keys, places = [], [], []
                for d, a, b in zip(part.column("doc_id").to_pylist(), before[:-1].tolist(), before[1:].tolist(), strict=True):
                    if b - a < words_least or d is None:
                        continue
                    own = made[a : b - token + 1]
                    nodes = np.array(sorted(c for _, c, _ in compact_windows(own, least)), np.int64)
                    key = own[nodes]
                    if len(nodes) > 2:
                        # Of one word over and over, the first and the last place; verification aligns both its ends.
                        same = (key[1:] == key[:-1]) & (np.diff(nodes) == 1)
                        keep = np.ones(len(nodes), bool)
                        keep[1:-1] = ~(same[1:] & same[:-1])
                        nodes, key = nodes[keep], key[keep]
                    ids.append(np.full(len(nodes), d))
                    keys.append(key.view(np.int64))
                    places.append(nodes.astype(np.int32))
                cols = [np.concatenate(c).astype(t) if c else np.zeros(0, t) for c, t in ((ids, np.int64), (keys, np.int64), (places, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "key", "at"])

    return run


def _runs(words_least: int, size: int, percent: int):
    """For places of a text (at, open, comp), the runs of words over their token: (part, doc_id, start, open, comp, near, long).

    near is a hash of all least passages over the run, long whether there are any.
    """
    token, run_least = token_words(words_least, size, percent), run_words(words_least, size, percent)
    spare = words_least - run_least

    def run(batches):
        for batch in batches:
            for lo, hi in shingles.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                words, before = shingles.word_hashes(part.column("text"))
                made, inside = shingles.sequences(words, before, run_least)
                power = np.multiply.accumulate(np.full(len(words) + 1, _BASE, np.uint64))
                back = np.multiply.accumulate(np.full(len(words) + 1, pow(_BASE, -1, 1 << 64), np.uint64))
                total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(words * power[:-1])])
                rows = []
                for d, a, b, places in zip(part.column("doc_id").to_pylist(), before[:-1].tolist(), before[1:].tolist(), part.column("places").to_pylist(), strict=True):
                    starts: dict[int, list] = {}
                    for p in places:
                        for at in range(max(0, p["at"] + token - run_least), p["at"] + 1):
                            if a + at < b and inside[a + at]:
                                held = starts.setdefault(at, [False, p["comp"]])
                                held[0] |= p["open"]
                    if starts:
                        at = np.array(list(starts), np.int64) + a
                        s, e = np.maximum(a, at - spare), np.minimum(b, at + run_least + spare)
                        near = shingles.mix((total[e] - total[s]) * back[s] + shingles.mix((at - s + ((e - at) << 32)).astype(np.uint64)))
                        rows.append((made[at].view(np.int64), np.full(len(at), d), at - a, [o for o, _ in starts.values()], [c for _, c in starts.values()], near.view(np.int64), e - s >= words_least))
                kinds = [np.int64, np.int64, np.int32, bool, np.int64, np.int64, bool]
                cols = [np.concatenate(c).astype(k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [np.zeros(0, k) for k in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["part", "doc_id", "start", "open", "comp", "near", "long"])

    return run


def _around(words_least: int, size: int, percent: int):
    """For starts of runs of a text, the hashes of the words of all least passages over the run: (part, cid, comp, n, data)."""
    run_least = run_words(words_least, size, percent)
    spare = words_least - run_least

    def run(batches):
        for batch in batches:
            for lo, hi in shingles.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                words, before = shingles.word_hashes(part.column("text"))
                rows = []
                for d, a, b, places in zip(part.column("doc_id").to_numpy(), before[:-1].tolist(), before[1:].tolist(), part.column("places").to_pylist(), strict=True):
                    for p in places:
                        at = a + p["start"]
                        if at + run_least <= b:
                            s, e = max(a, at - spare), min(b, at + run_least + spare)
                            rows.append((p["part"], p["cid"], p["comp"], np.concatenate([np.array([at - s, d], np.int64).view(np.uint64), words[s:e]]).tobytes()))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "cid", "comp", "data"])

    return run


@lru_cache(256)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse."""
    return tuple(np.multiply.accumulate(np.array([1, *[b] * (n - 1)], np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


@lru_cache(256)
def _ranges(m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all ranges of n of m shingles at least, and which shingles are inside each."""
    start, end = np.triu_indices(m - n + 1)
    k = np.arange(m)
    return start[:, None], (k >= start[:, None]) & (k < end[:, None] + n)


class Surroundings(Tile):
    """Words around runs that meet; a row's size is the least number of different shingles that a passage in it has."""

    def __init__(self, rows: list[tuple], words: int, size: int, percent: int) -> None:
        super().__init__(rows, percent, True)
        self.words, self.size, self.exact_sizes = words, size, False
        self.kind = np.zeros(len(rows), np.int64)
        self.places = [int(d[0]) for d in self.data]
        self.docs = np.array([d[1] for d in self.data], np.uint64).view(np.int64)
        # Equal surroundings are searched once; those shorter than a passage hold none.
        alike: dict[tuple[int, bytes], list[int]] = {}
        for i, row in enumerate(rows):
            if len(row[5]) // 8 - 2 >= words:
                alike.setdefault((self.places[i], row[5][16:]), []).append(i)
        self.alike = list(alike.values())
        self.data = [d[2:] for d in self.data]
        q, own = self.q, self.own
        self.q, self.own, self.n = np.zeros(len(rows), bool), np.zeros(len(rows), bool), np.full(len(rows), words)
        self.made, self.news, self.least, self.hashes, self.last, self.numbers = {}, {}, {}, {}, {}, {}
        self.counts = np.zeros((len(rows), _GROUPS), np.uint8)
        lengths: dict[int, list[int]] = {}
        for group in self.alike:
            i = group[0]
            self.q[i], self.own[i] = q[group].any(), own[group].any()
            lengths.setdefault(len(self.data[i]), []).append(i)
        different = {}
        for long, at in lengths.items():
            flat = np.concatenate([self.data[i] for i in at])
            m = shingles.sequences(flat, np.arange(len(at) + 1) * long, size)[0].reshape(-1, long)[:, : long - size + 1]
            power, back = _powers(long)
            total = np.zeros((len(at), long + 1), np.uint64)
            np.cumsum(flat.reshape(-1, long) * power, 1, out=total[:, 1:])
            h = (total[:, words:] - total[:, : long - words + 1]) * back[: long - words + 1]
            last = _before(m)
            news = _windows_new(last, words - size + 1)
            least = news.sum(2)
            self.n[at], different[long] = least.min(1), last < 0
            group = np.arange(len(at))[:, None] * _GROUPS + (m & np.uint64(_GROUPS - 1)).astype(np.int64)
            self.counts[at] = np.bincount(group[different[long]], minlength=len(at) * _GROUPS).reshape(-1, _GROUPS)
            for held, of in ((self.made, m), (self.news, news), (self.least, least), (self.hashes, h), (self.last, last)):
                held.update(zip(at, of, strict=True))
        # Each row's different shingles by their number in the tile; `place` has one more, which is no shingle's.
        every = [np.concatenate([self.made[i] for i in at]) for at in lengths.values()]
        number = np.unique(np.concatenate(every or [np.zeros(0, np.uint64)]), return_inverse=True)[1]
        self.place = np.full(len(number) + 1, -1)
        self.ids = np.full((len(rows), max(lengths, default=size) - size + 1), len(number))
        for (long, at), ids in zip(lengths.items(), np.split(number, np.cumsum([len(e) for e in every])[:-1]), strict=True) if every else ():
            ids = ids.reshape(len(at), -1)
            self.ids[at, : long - size + 1] = np.where(different[long], ids, len(number))
            self.numbers.update(zip(at, ids, strict=True))

    def _groups(self, a: np.ndarray, b: np.ndarray) -> int:
        return _GROUPS

    def _vectors(self, at: np.ndarray, g: int) -> np.ndarray:
        return self.counts[at]

    def links(self) -> Iterator[tuple[int, int]]:
        """The forest, and besides the link of each row to the first document of its tree where they are similar."""
        found, one = [], {}
        for group in self.alike:
            for i in group:
                one[i] = group[0]
                if self.label[i] != self.label[group[0]]:
                    found.append(self._join(i, group[0]))
        # Rows with an equal least passage are similar, which needs no pairs.
        if self.alike:
            holder = np.repeat([g[0] for g in self.alike], [len(self.hashes[g[0]]) for g in self.alike])
            _, at, which = np.unique(np.concatenate([self.hashes[g[0]] for g in self.alike]), return_index=True, return_inverse=True)
            other = holder[at][which]
            for k in np.flatnonzero(other != holder).tolist():
                if self.label[holder[k]] != self.label[other[k]]:
                    found.append(self._join(int(holder[k]), int(other[k])))
        found += self.pairs()
        yield from found
        row = {c: i for i, c in enumerate(self.cid.tolist())}
        joined = sorted({row[c] for pair in found for c in pair}, key=lambda i: (self.docs[i], i))
        first: dict[int, int] = {}
        known: dict[tuple[int, int], bool] = {}
        for i in joined:
            root = first.setdefault(int(self.label[i]), i)
            pair = one[i], one[root]
            if self.docs[root] >= self.docs[i]:
                continue
            if pair not in known:
                known[pair] = pair[0] == pair[1] or len(self._able(pair[0], np.array(pair[1:]))) > 0 and self.similar(*pair)
            if known[pair]:
                yield min(int(self.cid[i]), int(self.cid[root])), max(int(self.cid[i]), int(self.cid[root]))

    def joined(self, queries: np.ndarray, others: np.ndarray, vq: np.ndarray, vo: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of similar rows; a product of counts is the smaller one at least, so products of vectors bound overlaps."""
        both, right = self.q & self.own, vo.astype(np.float32).T
        for lo in range(0, len(queries), 256):
            qs = queries[lo : lo + 256]
            need = _needed(self.n[qs][:, None], self.n[others][None, :], self.percent)
            able = (vq[lo : lo + 256].astype(np.float32) @ right >= need) & (self.label[qs][:, None] != self.label[others][None, :])
            able &= ~(both[qs][:, None] & both[others][None, :] & (qs[:, None] > others[None, :]))
            for i in np.flatnonzero(able.any(1)).tolist():
                x, at = int(qs[i]), np.flatnonzero(able[i])
                for y in self._able(x, others[at[self.label[others[at]] != self.label[x]]]).tolist():
                    if self.label[x] != self.label[y] and self.similar(x, y):
                        yield self._join(x, y)

    def _able(self, x: int, others: np.ndarray) -> np.ndarray:
        """The others that can have a passage in common with a row.

        Passages have the different shingles of a least one, so both rows share what two least ones
        need, and some range of x has enough of the other's.
        """
        m, n = len(self.numbers[x]), self.words - self.size + 1
        self.place[self.numbers[x][::-1]] = np.arange(m)[::-1]  # the first of equal ones
        first, has = self.place[self.numbers[x]], self.place[self.ids[others]]
        self.place[self.numbers[x]] = -1
        keep = (has >= 0).sum(1) >= _needed(self.n[x], self.n[others], self.percent)
        others, has = others[keep], has[keep]
        if not len(others):
            return others
        # Ranges (start, end) of x and, of each, the shingles that it does not have before.
        start, inside = _ranges(m, n)
        ranges = inside & (self.last[x] < start)
        size, out = ranges.sum(1), []
        ranges = ranges.astype(np.float32).T
        for lo in range(0, len(others), 256):
            part = has[lo : lo + 256]
            held = np.zeros((len(part), m + 1), np.float32)
            held[np.arange(len(part))[:, None], part] = 1  # those that x does not have in a last column
            gain = (held[:, first] @ ranges * (100 + self.percent) - self.percent * size).max(1)
            out.append(others[lo : lo + 256][gain >= self.percent * self.n[others[lo : lo + 256]]])
        return np.concatenate(out)

    def _join(self, x: int, y: int) -> tuple[int, int]:
        self.label[self.label == self.label[x]] = self.label[y]
        return min(int(self.cid[x]), int(self.cid[y])), max(int(self.cid[x]), int(self.cid[y]))

    def similar(self, x: int, y: int) -> bool:
        n = self.words - self.size + 1
        if self._aligned(x, y, n):
            return True
        same = self.made[x][:, None] == self.made[y][None, :]
        total = np.zeros((same.shape[0] + 1, same.shape[1] + 1), np.int32)
        total[1:, 1:] = same.cumsum(0, dtype=np.int32).cumsum(1)
        # For each pair of least passages, the equal pairs of their shingles: at least the shingles in common.
        common = total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]
        every, able = int(total[-1, -1]), 100 * common >= self.percent * (self.least[x][:, None] + self.least[y][None, :] - common)
        if not able.any() and 100 * every < self.percent * (len(self.made[x]) + len(self.made[y]) - every):
            return False
        if self._long_run(x, y, n):
            return True
        return bool(_passages(self.made[x], self.made[y], [(self.places[x], self.places[y])], self.words, self.size, self.percent))

    def _aligned(self, x: int, y: int, n: int) -> bool:
        """Whether equal shingles on the run's own diagonal are enough for a least passage."""
        d, a, b = self.places[x] - self.places[y], self.made[x], self.made[y]
        lo, hi = max(0, d), min(len(a), len(b) + d)
        if hi - lo < n:
            return False
        same = np.lib.stride_tricks.sliding_window_view(a[lo:hi] == b[lo - d : hi - d], n)
        p, q = self.news[x][lo : hi - n + 1], self.news[y][lo - d : hi - d - n + 1]
        both = (p & same).sum(1)
        return bool((100 * both >= self.percent * (p.sum(1) + q.sum(1) - both)).any())

    def _long_run(self, x: int, y: int, n: int) -> bool:
        """Whether the run alone is enough for a least passage of each row around it."""
        a, b, i, j = self.made[x], self.made[y], self.places[x], self.places[y]
        e, s = _agree(a[i:], b[j:]), _agree(a[:i][::-1], b[:j][::-1])
        if s + e < _needed(n, n, self.percent) or s + e > n:
            return False
        common, least = len(np.unique(a[i - s : i + e])), 0
        for row, m, at in ((x, a, i), (y, b, j)):
            least += int(self.news[row][max(0, at + e - n) : min(at - s, len(m) - n) + 1].sum(1).min())
        return 100 * common >= self.percent * (least - common)


def _chain(mx: np.ndarray, my: np.ndarray, i: int, j: int, percent: int, most: int, held: int) -> list[tuple[int, int, int]]:
    """(x, y, gain) at the ends of the runs that follow the run up to shingles i, j; gain is linear in the shingles.

    A range's shingles reach the similarity when its gains add up to 0 at least.  The chain
    ends where the gain of the run it starts from, held, is used up: what follows is reached
    from a longer run there, if at all.
    """
    out, gain = [], 0
    while i < len(mx) and j < len(my):
        p, q = mx[i : i + most], my[j : j + most]
        at = np.flatnonzero(p[:, None] == q[None, :])
        if not len(at):
            break
        u, v = np.divmod(at, len(q))
        k = ((u + v) * most + abs(u - v)).argmin()
        u, v = int(u[k]), int(v[k])
        n = _agree(mx[i + u :], my[j + v :])
        gain += (100 + percent) * n - percent * (u + v + 2 * n)
        if held + gain < 0:
            break
        i, j = i + u + n, j + v + n
        out.append((i, j, gain))
    return out


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two arrays have in common from their beginning on."""
    n, got, step = min(len(x), len(y)), 0, 64
    while got < n:
        differ = np.flatnonzero(x[got : min(n, got + step)] != y[got : min(n, got + step)])
        if len(differ):
            return got + int(differ[0])
        got, step = got + step, step * 4
    return n


def _before(x: np.ndarray) -> np.ndarray:
    """For each value of a row (along the last axis), where it last stood before, -1 if nowhere."""
    order = np.argsort(x, -1, kind="stable")
    held = np.take_along_axis(x, order, -1)
    out = np.full(x.shape, -1)
    np.put_along_axis(out, order[..., 1:], np.where(held[..., 1:] == held[..., :-1], order[..., :-1], -1), -1)
    return out


def _windows_new(before: np.ndarray, n: int) -> np.ndarray:
    """For each window of n values, which of them the window does not have before."""
    windows = np.lib.stride_tricks.sliding_window_view(before, n, -1)
    return windows < np.arange(windows.shape[-2])[:, None]


def _new(x: np.ndarray, n: int) -> np.ndarray:
    """For each window of n shingles of x, which of them the window does not have before."""
    return _windows_new(_before(x), n) if len(x) >= n else np.zeros((0, n), bool)


def _able(x: np.ndarray, has: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Whether each window of n shingles of x has enough different ones of those that another text has."""
    if len(set(x.tolist())) == len(x):  # all are different
        held = np.concatenate([[0], np.cumsum(has)])
        return 100 * (held[n:] - held[:-n]) >= percent * n
    new = _new(x, n)
    return 100 * (new & np.lib.stride_tricks.sliding_window_view(has, n)).sum(1) >= percent * new.sum(1)


def _slide(x: np.ndarray, y: np.ndarray, n: int, percent: int, at: int, d: int) -> tuple:
    """(similarity, -place, -d) of the best pair of windows of n shingles at one place of both, (0.0,) if none is similar."""
    xs, ys, p, q = x.tolist(), y.tolist(), Counter(x[:n].tolist()), Counter(y[:n].tolist())
    both, best = len(p.keys() & q.keys()), (0.0,)
    for k in range(len(xs) - n + 1):
        if k:
            for own, other, v in ((p, q, xs), (q, p, ys)):
                gone, new = v[k - 1], v[k + n - 1]
                own[gone] -= 1
                if not own[gone]:
                    del own[gone]
                    both -= gone in other
                if not own[new]:
                    both += new in other
                own[new] += 1
        if 100 * both >= percent * (len(p) + len(q) - both):
            best = max(best, (both / (len(p) + len(q) - both), -at - k, -d))
    return best


def passages(x: np.ndarray, y: np.ndarray, places: list[tuple[int, int]], words_least: int, size: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """The passages (range in x, range in y, similarity) of two texts' word hashes around places of equal words."""
    mx, my = (shingles.sequences(w, np.array([0, len(w)]), size)[0][: len(w) - size + 1] for w in (x, y))
    return _passages(mx, my, places, words_least, size, percent)


def _passages(mx: np.ndarray, my: np.ndarray, places: list[tuple[int, int]], words_least: int, size: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """passages of two texts' shingles."""
    n_least, out, tried = words_least - size + 1, [], {}
    needed = _needed(n_least, n_least, percent)

    def similar(s: int, e: int, t: int, f: int) -> float:
        p, q = set(mx[s:e].tolist()), set(my[t:f].tolist())
        both = len(p & q)
        return both / (len(p) + len(q) - both) if 100 * both >= percent * (len(p) + len(q) - both) else 0.0

    def ends(m: np.ndarray, i: int) -> tuple[int, int]:
        """The first and the last of the equal shingles around one."""
        differ = np.flatnonzero(m != m[i])
        k = int(np.searchsorted(differ, i))
        return (int(differ[k - 1]) + 1 if k else 0), (int(differ[k]) - 1 if k < len(differ) else len(m) - 1)

    every = set(places)
    again = np.flatnonzero(mx[1:] == mx[:-1])
    again = {*again.tolist(), *(again + 1).tolist()}
    for i, j in places:
        if i in again:
            every.update(zip(ends(mx, i), ends(my, j), strict=True))
    for i, j in sorted(every):
        if tried.get(i - j, -1) > i or any(a <= i and i + size <= b for a, b, *_ in out):
            continue
        e0, s0 = _agree(mx[i:], my[j:]), _agree(mx[:i][::-1], my[:j][::-1])
        tried[i - j] = i + e0
        s, e, t, f = i - s0, i + e0, j - s0, j + e0  # shingles
        held = (100 - percent) * (e - s)
        right = [(e, f, 0), *_chain(mx[e:], my[f:], 0, 0, percent, 4 * size, held)]
        left = [(s, t, 0), *_chain(mx[:s][::-1], my[:t][::-1], 0, 0, percent, 4 * size, held)]
        right[1:] = [(e + a, f + b, g) for a, b, g in right[1:]]
        left[1:] = [(s - a, t - b, g) for a, b, g in left[1:]]
        found = None
        if min(right[-1][0] - left[-1][0], right[-1][1] - left[-1][1]) >= n_least:  # the longest
            (xe, ye, ge), (xs, ys, gs) = (np.array(c, np.int64).T for c in (right, left))
            long = np.minimum(xe[None, :] - xs[:, None], ye[None, :] - ys[:, None])
            holds = ((100 - percent) * (e - s) + gs[:, None] + ge[None, :] >= 0) & (long >= n_least)
            for k in np.argsort(-np.where(holds, long, -1), axis=None, kind="stable")[: int(holds.sum())].tolist():
                p, q = divmod(k, len(xe))
                if score := similar(*(where := (int(xs[p]), int(xe[q]), int(ys[p]), int(ye[q])))):
                    found = where, score
                    break
        if not found:
            # No chain of runs: every least passage around the run, on the diagonals of the runs beside it.
            beside = {a - b for a, b, _ in right[:3] + left[:3]}
            if n_least > e - s >= needed:  # the run is enough, whichever side of it either passage reaches over
                beside |= {s - t + k for k in range(e - s - n_least, n_least - e + s + 1)}
            best = (0.0,)
            # The least passages start in these ranges of x and y; what they have in common is there too.
            xa, xz = max(0, s - n_least + 1), min(e, len(mx) - n_least + 1)
            ya, yz = max(0, xa - max(beside)), min(xz - min(beside), len(my) - n_least + 1)
            able = None
            if xa < xz and ya < yz:
                p, q = mx[xa : xz + n_least - 1], my[ya : yz + n_least - 1]
                same = p[:, None] == q[None, :]
                able = _able(p, same.any(1), n_least, percent)
                able = (able, _able(q, same.any(0), n_least, percent)) if able.any() else None
            for d in sorted(beside) if able else ():
                a, z = max(xa, d), min(xz, len(my) - n_least + 1 + d)
                at = np.flatnonzero(able[0][a - xa : z - xa] & able[1][a - d - ya : z - d - ya]) if a < z else ()
                if len(at):
                    a, z = a + int(at[0]), a + int(at[-1]) + n_least
                    best = max(best, _slide(mx[a:z], my[a - d : z - d], n_least, percent, a, d))
            if best[0]:
                a, d = -best[1], -best[2]
                found = (a, a + n_least, a - d, a - d + n_least), best[0]
        if found:
            (s, e, t, f), score = found
            out.append((s, e + size - 1, t, f + size - 1, score))
    return [r for k, r in enumerate(out) if not any(o[0] <= r[0] and r[1] <= o[1] and (o[:2] != r[:2] or m < k) for m, o in enumerate(out) if m != k)]


def _verified(words_least: int, size: int, percent: int):
    """Each row holds two texts and places where they meet; finds the passages around the places."""

    def hashed(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
        """The hashes of the words and shingles of the different texts of a column, and which of them each row has."""
        column = pc.dictionary_encode(pc.fill_null(column, ""))
        out = []
        for lo, hi in shingles.slices(column.dictionary):
            words, before = shingles.word_hashes(column.dictionary.slice(lo, hi - lo))
            made = shingles.sequences(words, before, size)[0]
            out += [(words[a:b], made[a : max(a, b - size + 1)]) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
        return out, column.indices.to_pylist()

    def run(batches):
        for batch in (b.slice(lo, hi - lo) for b in batches for lo, hi in shingles.slices(b.column("text_a"))):
            rows = []
            (xs, of_x), (ys, of_y) = (hashed(batch.column(c)) for c in ("text_a", "text_b"))
            places = batch.column("places")
            ends = places.offsets.to_numpy()
            at = [places.values.field(c).to_numpy() for c in ("i", "j")]
            for a, b, p, q, lo, hi in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), of_x, of_y, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                # A doc_id that stands for several texts brings places that are not its text's.
                (x, mx), (y, my) = xs[p], ys[q]
                if len(x) == len(y) and (x == y).all():
                    rows.append((a, b, 0, len(x), 0, len(x), 1.0))
                    continue
                i, j = (c[lo:hi] for c in at)
                inside = (i < len(mx)) & (j < len(my))
                i, j = i[inside], j[inside]
                equal = mx[i] == my[j]
                rows += [(a, b, *got) for got in _passages(mx, my, list(zip(i[equal].tolist(), j[equal].tolist(), strict=True)), words_least, size, percent)] if equal.any() else []
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "of_doc_id", "start_word", "end_word", "of_start_word", "of_end_word", "similarity"])

    return run


def repeated_passages(docs: DataFrame, *, words: int = WORDS, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Passages of at least `words` words that two documents share, nearly or exactly.

    Columns: doc_id, of_doc_id (the smaller doc_id), word ranges in both and the similarity of
    their `size`-word shingles (percent / 100 at least).  Each passage of a document is paired
    with the first document that holds its words; where that fails, with documents that the
    passage's others are not paired with yet (a forest of each tile), not with every copy.  A
    pair has a row for each of its passages.  Texts of fewer words, null texts and rows with a null doc_id take no part; rows
    repeated with their doc_id are not paired with each other; an empty table gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    token, tries = token_words(words, size, percent), (words, size, percent)
    made = materialise(docs.mapInArrow(tidy(_windows(*tries)), "doc_id long, key long, at int"))
    groups = made.groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.max("doc_id").alias("last")).filter("f.doc_id < last")
    groups = materialise(groups.select("key", F.col("f.doc_id").alias("b"), F.col("f.at").alias("j")))
    release(spark)
    shared = materialise(made.join(groups, "key"))
    discard(made)
    discard(groups)
    release(spark)

    out = _verify(docs, shared.filter("doc_id > b").select(F.col("doc_id").alias("a"), F.col("at").alias("i"), "b", "j"), tries)
    # Places that lie in no passage, and what shares their tokens.
    within = shared.filter("doc_id > b").select("doc_id", "at").distinct().join(out.select("doc_id", "start_word", "end_word", "of_doc_id"), "doc_id")
    within = materialise(within.filter(f"start_word <= at and at + {token} <= end_word").groupBy("doc_id", "at").agg(F.min("of_doc_id").alias("comp")))
    marked = materialise(shared.join(within, ["doc_id", "at"], "left").withColumn("open", F.expr("comp is null and doc_id > b")))
    left = marked.filter("open").select("key").distinct()
    places = marked.join(left, "key").withColumn("comp", F.coalesce("comp", "doc_id")).groupBy("doc_id", "at").agg(F.max("open").alias("open"), F.min("comp").alias("comp"))
    places = materialise(places.groupBy("doc_id").agg(F.collect_list(F.struct("at", "open", "comp")).alias("places")))
    for used in (shared, within, marked):
        discard(used)
    release(spark)
    runs = materialise(thinned(docs, places, "doc_id").join(places, "doc_id").mapInArrow(tidy(_runs(*tries)), "part long, doc_id long, start int, open boolean, comp long, near long, long boolean"))
    several = runs.groupBy("part").agg(F.max("open").alias("any"), F.min(F.struct("doc_id", "start")).alias("f"), F.max("doc_id").alias("hi")).filter("any and f.doc_id < hi")
    several = materialise(several.select("part", F.col("f.start").alias("s")))
    kept = materialise(runs.join(several, "part"))
    discard(runs)
    # Of runs that lie at the same distances in the same documents, one in each stretch of a run's length serves all.
    same = [F.bit_xor(F.xxhash64("doc_id", F.col("start") - F.col("s"), F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    one = kept.groupBy("part").agg(*same, F.first("s").alias("s")).groupBy("x0", "x1", F.expr(f"s div {run_words(*tries)}").alias("k")).agg(F.min_by("part", "s").alias("part"))
    kept, every = materialise(kept.join(one.select("part"), "part").drop("s").withColumn("cid", F.monotonically_increasing_id())), kept
    discard(every)
    discard(several)
    # Equal surroundings are alike at once; the first of them meets the others for all.
    own = kept.withColumn("comp", F.expr("xxhash64(if(open, cid, comp), open)"))
    firsts = materialise(own.groupBy("part", "near").agg(F.min(F.struct("doc_id", "start", "cid", "comp", "long")).alias("f"), F.max("open").alias("open")))
    alike = own.filter("long").join(firsts.select("part", "near", "f"), ["part", "near"]).filter("comp <> f.comp and doc_id <> f.doc_id")
    alike = materialise(alike.select(F.col("doc_id").alias("a"), F.col("start").alias("i"), F.col("f.doc_id").alias("b"), F.col("f.start").alias("j")))
    discard(kept)
    kinds = firsts.filter("f.long").groupBy("part").agg(F.count("*").alias("m"), F.max("open").alias("any")).filter("m > 1 and any")
    kept = materialise(firsts.filter("f.long").join(kinds.select("part"), "part").select("part", "f.*"))
    discard(firsts)
    release(spark)
    wanted = kept.groupBy("doc_id").agg(F.collect_list(F.struct("part", "start", "cid", "comp")).alias("places"))
    near = materialise(thinned(docs, wanted, "doc_id").join(wanted, "doc_id").mapInArrow(tidy(_around(*tries)), "part long, cid long, comp long, data binary"))
    met = dealt(near.select("part", "cid", "comp", F.lit(words - size + 1).alias("n")), near, partial(Surroundings, words=words, size=size, percent=percent))
    x, y = (kept.select(F.col("cid").alias(c), F.col("doc_id").alias(f"d{c}"), F.col("start").alias(f"s{c}")) for c in "ab")
    met = materialise(met.join(x, "a").join(y, "b").filter("da <> db"))
    discard(near)
    more = alike.unionByName(met.select(*[F.expr(f"if(da > db, {p}, {q})").alias(c) for p, q, c in (("da", "db", "a"), ("sa", "sb", "i"), ("db", "da", "b"), ("sb", "sa", "j"))]))
    return out.unionByName(_verify(docs, more, tries)).distinct()


def _verify(docs: DataFrame, met: DataFrame, tries: tuple[int, int, int]) -> DataFrame:
    """The passages around places (a, i, b, j) that meet in texts a and b."""
    pairs = materialise(met.groupBy("a", "b").agg(F.collect_set(F.struct("i", "j")).alias("places")))
    x, y = (thinned(docs.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")), pairs, c) for c in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "places", "text_a", "text_b")
    out = materialise(both.mapInArrow(tidy(_verified(*tries)), "doc_id long, of_doc_id long, start_word long, end_word long, of_start_word long, of_end_word long, similarity double"))
    discard(pairs)
    release(docs.sparkSession)
    return out
