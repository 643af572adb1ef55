"""Toxicity by noisy-channel deobfuscation.

A span that looks disguised (letters mixed with look-alike signs, single letters set apart,
letters repeated) is a lattice: each sign may stand for several letters, a repeated letter
for one or two.  Viterbi search under a character trigram model, counted over all
documents, finds the likeliest readings, and the restored text is scored.

The scorer's terms are whole words and word beginnings that the labelled rows tie to
toxicity; it is fitted on at most SAMPLE labelled rows (those first in the order of a hash
of their id) and has at most TERMS terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise, small_batches, tidy

SAMPLE, TERMS = 40_000, 4096
STEMS = (4, 5, 6)
N = 27  # a-z, and one for everything else

# The letters a sign may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou",
}

_FOLD = np.zeros(0x250, np.int64)
for _i in range(26):
    _FOLD[[97 + _i, 65 + _i]] = _i + 1
for _letters, _to in (("àáâãäåÀÁÂÃÄÅ", "a"), ("çÇ", "c"), ("èéêëÈÉÊË", "e"), ("ìíîïÌÍÎÏ", "i"), ("ñÑ", "n"), ("òóôõöÒÓÔÕÖ", "o"), ("ùúûüÙÚÛÜ", "u"), ("ýÿÝ", "y"), ("ß", "s")):
    for _c in _letters:
        _FOLD[ord(_c)] = ord(_to) - 96

_SIGNS = re.escape("".join(LOOK_ALIKES))
_CORE = re.compile(
    rf"[A-Za-z][{_SIGNS}]+[A-Za-z]"  # signs between letters
    rf"|(?<!\S)[{_SIGNS}]+[A-Za-z]{{2,}}|[A-Za-z]{{2,}}[0-9@$]{{1,2}}(?!\S)"  # or at either end
    r"|([A-Za-z])\1\1"  # a letter three times
    rf"|(?<![^\W_])[A-Za-z{_SIGNS}](?:[ .\-_*~][A-Za-z{_SIGNS}]){{2,}}(?![^\W_])"  # letters set apart
)
_APART = re.compile(rf"[A-Za-z{_SIGNS}](?:[ .\-_*~][A-Za-z{_SIGNS}]){{2,}}")
_WORD = re.compile(r"[^\W\d_]+")
_MARKS, _APART_MARKS = re.compile(r"(?<=[^\W_])[.\-_~](?=[^\W_])"), re.compile(r"[.\-_*~]")


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < len(_FOLD), _FOLD[np.minimum(points, len(_FOLD) - 1)], 0)


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigrams of folded letters over all documents; the driver gets N cubed sums at most."""

    def run(batches):
        total = np.zeros(N**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                c = _codes(" " + (text.as_py() or "") + " ")
                total += np.bincount(c[:-2] * N * N + c[1:-1] * N + c[2:], minlength=N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["t", "n"])

    out = np.zeros(N**3, np.int64)
    for r in docs.select("text").mapInArrow(tidy(run), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        out[r["t"]] = r["n"]
    return out.reshape(N, N, N)


class Channel:
    """Restores disguised spans under a trigram model."""

    def __init__(self, counts: np.ndarray) -> None:
        tri = counts.astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + N)
        p2 = (bi + 50 * p1) / (bi.sum(1, keepdims=True) + 50)
        p3 = (tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20)
        self.logp = np.log(p3).tolist()
        self.read = lru_cache(200_000)(self._read)

    def _read(self, span: str) -> tuple[str, ...]:
        """The likeliest readings of a span of letters and signs, best first, three at most."""
        beams = {(0, 0): [(0.0, "")]}
        at = 0
        while at < len(span):
            c, run = span[at], 1
            while at + run < len(span) and span[at + run] == c:
                run += 1
            at += run
            fold = int(_codes(c)[0]) if len(c) == 1 else 0
            letters = [chr(96 + fold)] if fold else list(LOOK_ALIKES.get(c, ""))
            ways = [(x, 0.0 if run == 1 or fold == 0 else -0.5) for x in letters]
            if run > 1:
                ways += [(x * 2, -0.2 if run == 2 else -1.0) for x in letters]
            if not ways:
                ways = [("", -1.0)]
            made: dict[tuple[int, int], list[tuple[float, str]]] = {}
            for (a, b), held in beams.items():
                for x, cost in ways:
                    p, q, s = a, b, cost
                    for ch in x:
                        o = ord(ch) - 96
                        s += self.logp[p][q][o]
                        p, q = q, o
                    made.setdefault((p, q), []).extend((v + s, t + x) for v, t in held)
            beams = {k: sorted(v, reverse=True)[:3] for k, v in made.items()}
        done = [(v + self.logp[a][b][0], t) for (a, b), held in beams.items() for v, t in held]
        return tuple(dict.fromkeys(t for _, t in sorted(done, reverse=True)))[:3]

    def restored(self, text: str) -> list[str]:
        """Readings of every disguised span of a text, in order."""
        out, done = [], 0
        for m in _CORE.finditer(text):
            if m.start() < done:
                continue
            apart = bool(_APART.fullmatch(m.group()))
            if apart and m.group()[1] == " ":
                signs = m.group()[::2]
                done = m.end()
            else:
                lo, hi = m.start(), m.end()
                while lo > done and not text[lo - 1].isspace():
                    lo -= 1
                while hi < len(text) and not text[hi].isspace():
                    hi += 1
                done = hi
                signs = text[lo:hi].strip(".,;:?\"'“”()[]")
                signs = (_APART_MARKS if apart else _MARKS).sub("", signs)
            if any(c.isalpha() for c in signs):
                out += self.read(signs.lower())
                if apart and len(signs) > 3 and signs[0] in "aAiI":
                    out += self.read(signs[1:].lower())  # the first may be a word of its own
        return out

    def words(self, text: str | None) -> set[str]:
        text = (text or "").lower()
        return set(_WORD.findall(text)).union(*(_WORD.findall(r) for r in self.restored(text)))


def _terms(words: set[str]) -> set[str]:
    return words.union(*({f"{w[:k]}~" for w in words if len(w) >= k} for k in STEMS))


def _counted(docs: DataFrame, channel_counts: np.ndarray, only: frozenset[str] | None) -> DataFrame:
    """(term, n): the rows of docs(text) whose restored text has each term."""

    def run(batches):
        channel, found = Channel(channel_counts), Counter()
        for batch in batches:
            for text in batch.column(0):
                terms = _terms(channel.words(text.as_py()))
                found.update(terms if only is None else terms & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(tidy(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Model:
    """Log-likelihood ratios of terms: the five strongest words add to the prior; a text without any has the base."""

    def __init__(self, base: float, prior: float, weights: dict[str, float]) -> None:
        self.base, self.prior, self.weights = base, prior, weights

    def score(self, words: set[str]) -> float:
        got = {}
        for k in (0, *STEMS):
            keys = words if not k else {f"{w[:k]}~": w for w in words if len(w) >= k}
            for t in keys & self.weights.keys():
                got[t[:4]] = max(got.get(t[:4], 0.0), self.weights[t])
        logit = self.prior + sum(sorted(got.values(), reverse=True)[:5]) if got else self.base
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, counts: np.ndarray, *, sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """Fit on at most `sample` labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    Rows without a label or text id are ignored; several labels of one doc_id count as their
    largest.  Without toxic rows every score is low.
    """
    known = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample's bound keeps this side small whatever the input.
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic"))
    n1, n0 = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not n1:
        return Model(-3.0, -3.0, {})
    bad = _counted(rows.filter("toxic = 1"), counts, None).filter(F.col("n") >= max(5, n1 // 200)).orderBy(F.desc("n"), "term").limit(8 * terms)
    ones = {r["term"]: r["n"] for r in bad.collect()}
    zeros = {r["term"]: r["n"] for r in _counted(rows.filter("toxic = 0"), counts, frozenset(ones)).collect()}
    weights = {}
    for t, a in ones.items():
        b = zeros.get(t, 0)
        if a >= 9 * b:
            weights[t] = float(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)))
    best = sorted(weights, key=lambda t: (-ones[t], t))[:terms]
    weights = {t: weights[t] for t in best}
    # Texts without a term: a few in a hundred of the toxic ones against nearly all others.
    return Model(float(np.log((0.05 * n1 + 1) / (n0 + 1))), float(np.log((n1 + 1) / (n0 + 1))), weights)


def score_documents(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, terms: int = TERMS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text, ...).

    A null or empty text scores the base rate.  held_out (crc32 of doc_id as text mod 5 is 0)
    marks rows the fit never sees; a null doc_id is not held out.  Only the text makes the
    score.  Repeated rows each get a row; an empty table gives none.
    """
    counts, model = _fitted(docs, labels, sample, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(counts)
        for batch in batches:
            scores = [model.score(channel.words(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _fitted(docs: DataFrame, labels: DataFrame, sample: int, terms: int) -> tuple[np.ndarray, Model]:
    small_batches(docs.sparkSession)
    counts = count_trigrams(docs)
    return counts, fit(docs, labels, counts, sample=sample, terms=terms)


def keep_clean(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, terms: int = TERMS) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic; nothing is shuffled."""
    counts, model = _fitted(docs, labels, sample, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(counts)
        for batch in batches:
            yield batch.filter(pa.array([model.score(channel.words(t.as_py())) < 0.5 for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
