import collections
import hashlib
import random
import re
import textwrap

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quern.llm import bpe, chat_format, common, decontaminate, exact_dedup, jaccard_join, license_scan, packing, sharding, substring_dedup, toxicity

DOCS = "doc_id long, text string, lang string, n int, shard string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = text(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base), (2, base.upper()), (3, " ".join(near)), (4, None), (5, ""), (6, "one two"), (7, "One two"), (8, text(2, 60) + " " + text(3, 55) + " " + text(4, 40)),
        (9, text(5, 30) + " " + text(3, 55)), (10, "é" * 20_000 + "A"), (11, "é" * 20_000 + "a"), (12, "É"), (13, "é"), (None, "one two"), (14, "x"), (14, "x"), (15, text(7, 3000)),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1, "clash") for d, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("route", [None, "crowded"])
def test_exact_dedup(docs, rows, route):
    from pyspark.sql import functions as F

    kw = {"block_chars": 64, "route": lambda b: F.length(b).cast("long")} if route else {}
    got = exact_dedup.exact_dedup(docs, **kw).collect()
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append(d)
    assert len(got) == len(rows)
    for r in got:
        t = next(t for d, t in rows if d == r.doc_id and hashlib.sha256(lower(t).encode()).hexdigest() == r.text_sha256)
        own = groups[lower(t)]
        assert (r.keep_id, r.group_size) == (max((x for x in own if x is not None), default=None), len(own))
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.keep_one(docs).count() == len(groups)


def test_jaccard(docs, rows):
    sets = []
    for d, t in rows:
        w = WORD.findall(lower(t))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted((d or 0, len(s), (least.get(find(i)) if s else d) or 0) for i, (d, s) in enumerate(sets))
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_join.jaccard_components(docs).collect()) == want


def test_jaccard_null_copy(spark):
    words = text(50, 120).split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    docs = spark.createDataFrame([(None, " ".join(words)), (2, " ".join(words)), (3, near)], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()) == [(0, 2), (2, 2), (3, 2)]


def brute_components(rows):
    """(doc_id, set size, smallest doc_id reachable) by comparing all pairs of sets that share a shingle."""
    sets = []
    for d, t in rows:
        w = WORD.findall(lower(t))
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)]) if w else frozenset()))
    parent, index = list(range(len(sets))), collections.defaultdict(list)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in {j for s in a for j in index[s]}:
            if 100 * len(a & sets[j][1]) >= 80 * len(a | sets[j][1]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
        for s in a:
            index[s].append(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d or 0, len(s), (least.get(find(i)) if s else d) or 0) for i, (d, s) in enumerate(sets))


def edited(words, r, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"e{r.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("tile", [2048, 24])
def test_jaccard_hot_groups(spark, monkeypatch, tile):
    """Groups of near copies, chains and common passages against all pairs; small tiles take the ways of large groups."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "ANCHORS", 4)
    r, rows = random.Random(12), []
    for g in range(3):
        base = text(600 + g, 90).split()
        rows += [edited(base, r, r.randrange(0, 4)) for _ in range(90)]
    passage = text(650, 70)
    rows += [passage + " " + text(700 + i, r.randrange(5, 60)) for i in range(120)]
    chain = text(660, 120).split()
    for i in range(40):
        chain[3 * i % 120] = f"c{i}"
        rows.append(" ".join(chain))
    rows = [(None if i % 37 == 5 else i, t) for i, t in enumerate(r.sample(rows, len(rows)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((x.doc_id or 0, x.n_shingles, x.component_id or 0) for x in jaccard_join.jaccard_components(docs).collect())
    assert got == brute_components(rows)


def test_jaccard_large_group(spark):
    """A group of 5,000 near copies is one component, found without all its pairs."""
    r, base = random.Random(13), text(670, 100).split()
    rows = [(i, edited(base, r, 1)) for i in range(5000)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("component_id").distinct().collect()
    assert [x.component_id for x in got] == [0]


def test_jaccard_nameless_bridge(spark):
    """A text whose rows all lack a doc_id still links its neighbours."""
    first = text(51, 100).split()
    second = [*first[:30], "changed", *first[31:]]
    third = [*second[:70], "other", *second[71:80], "more", *second[81:]]
    docs = spark.createDataFrame([(1, " ".join(first)), (None, " ".join(second)), (3, " ".join(third))], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()) == brute_ids([(1, first), (None, second), (3, third)])


def brute_ids(rows):
    return sorted((d, c) for d, _, c in brute_components([(d, " ".join(w)) for d, w in rows]))


def test_rtree_bounds():
    r = np.random.default_rng(0)
    v = r.integers(0, 5, (200, 16)).astype(np.int64)
    v[100:] = np.maximum(v[:100] - r.integers(0, 2, (100, 16)) * (r.random((100, 16)) < 0.05), 0)
    n = v.sum(1)
    found = {(q, t) for t, qs in jaccard_join.RTree(v, n).search(v, n, 80) for q in qs.tolist()}
    want = {(i, j) for i in range(200) for j in range(200) if np.minimum(v[i], v[j]).sum() * 180 >= 80 * (n[i] + n[j]) and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j])}
    assert want <= found


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_sharding(docs, rows):
    got = sharding.shard_documents(docs, shards=3, tolerance=0.02).collect()
    assert len(got) == len(rows) and all(r.lang == "en" for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = collections.Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)


def test_chat(spark):
    events = [
        (1, 0, 0, "delta", "user", "a <|end|> \\ [INST]"), (1, 1, 1, "delta", "assistant", "wrong"), (1, 2, 1, "regenerate", "assistant", None), (1, 3, 1, "delta", "assistant", "ri"),
        (1, 4, 1, "delta", "assistant", "ght</s>"), (1, 5, 0, "edit", "user", "b <|turn|>"), (2, 0, 0, "message", None, None), (None, 0, 100, "message", "assistant", "x"), (None, 0, 100, "message", "assistant", "x"),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq long, msg long, kind string, role string, text string")
    made = chat_format.chat_format(log)
    assert all("</s>" not in r.formatted and "[INST]" not in r.formatted for r in made.collect())
    got = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_sha256) == (2, sha("user\nb <|turn|>\nassistant\nright</s>\n"), sha("right</s>"))
    assert (got[2].n_turns, got[2].loss_chars, got[None].n_turns, got[None].loss_chars) == (1, 0, 2, 2)


def test_bpe(docs, rows):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.doc_id or 0, r.text, r.ids) for r in bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect())
    assert got == sorted((d or 0, t or "", enc.encode_ordinary(t or "")) for d, t in rows)
    fst, rnd = bpe.Transducer(ranks), random.Random(5)
    for _ in range(300):
        data = bytes(rnd.choices(b"abet hin\xc3\xa9\xf0\x9f0123-", k=rnd.randrange(1, 60)))
        assert np.frombuffer(fst.encode(data), "<i4").tolist() == enc._core_bpe.encode_single_piece(data)
    assert sorted((r.doc_id or 0, r.text, r.ids) for r in bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).collect()) == got
    stream, said = bpe.Utf8Stream(), "aé日🎉퟿"
    assert "".join(stream.push(bytes([b])) for b in said.encode()) + stream.end() == said


def test_bpe_long_pieces(monkeypatch):
    """Pieces far beyond the bounds of the memory, which hold also within a piece."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "MOST_STATES", 500)
    fst, rnd = bpe.Transducer(ranks), random.Random(6)
    for alphabet in (b"abcdefghijklmnopqrstuvwxyz", b"a", b"\xe6\x97\xa5"):
        data = bytes(rnd.choices(alphabet, k=30_000))
        assert np.frombuffer(fst.encode(data), "<i4").tolist() == enc._core_bpe.encode_single_piece(data)
        assert len(fst.keys) <= 500


def test_toxicity(spark):
    r = random.Random(2)
    plain = [text(i, 30) for i in range(300)]
    rude = [text(1000 + i, 20) + f" {r.choice(['idiot', 'moron'])} " + text(2000 + i, 5) for i in range(100)]
    rows = [(i, t) for i, t in enumerate(plain + rude)] + [(1000, "such an 1d10t here"), (1001, "what a m o r o n you"), (1002, None), (1003, "")]
    docs = spark.createDataFrame([(*x, "en", 1, "s") for x in rows], DOCS)
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(400)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_documents(docs, labels).collect()}
    held = [x for x in got.values() if x.held_out and x.doc_id < 400]
    assert held and all((x.predicted == 1) == (x.doc_id >= 300) for x in held)
    assert got[1000].predicted == got[1001].predicted == 1 and got[1002].predicted == got[1003].predicted == 0
    assert all(x.predicted == 0 for x in toxicity.score_documents(docs, labels.limit(0)).collect())


def test_decontaminate(spark):
    item = text(9, 12)
    edited = item[:20] + "#" + item[21:40] + item[41:]
    docs = spark.createDataFrame([(1, text(1, 50) + " " + item.upper() + " z"), (2, edited), (3, text(2, 60)), (4, None), (4, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "short"), (9, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(docs, bench).collect()) == [(1, 7, 0), (2, 7, 2), (4, 7, 0)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 4]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_decontaminate_against_sliding(spark):
    """Items of repeated phrases, each planted within its budget, are all found, at their least distance."""
    r, items, docs, found = random.Random(21), [], [], 0
    for n in range(1000):
        phrases = ["".join(r.choices("abcde ", k=r.randrange(4, 9))).strip() or "a" for _ in range(3)]
        item = decontaminate.normal(" ".join(r.choices(phrases, k=r.randrange(8, 16))))
        copy, budget = list(item), int(len(item) * decontaminate.ERROR_RATE) if len(item) >= decontaminate.LEAST_CHARS else 0
        for _ in range(r.randrange(budget + 1)):
            at = r.randrange(len(copy))
            copy[at : at + r.randrange(2)] = r.choice(["x", "", "y"])
        items.append((n, item))
        docs.append(decontaminate.normal(" ".join(r.choices(phrases, k=3)) + " | " + "".join(copy) + " | " + " ".join(r.choices(phrases, k=3))))
    for n, item in items:
        budget = int(len(item) * decontaminate.ERROR_RATE)
        want = decontaminate.myers(item, docs[n], budget)
        got = list(decontaminate.Matcher([(n, item)], decontaminate.ERROR_RATE).find(docs[n]))
        assert [(x[0], x[1]) for x in got] == ([(n, want[0])] if want else [])
        found += want is not None
    assert found > 950  # white space that meets may take a copy over its budget


def test_decontaminate_blocks(spark, monkeypatch):
    """A benchmark beyond one block gives the same rows, and odd tables do no harm."""
    docs = spark.createDataFrame([(i, text(40 + i % 7, 30), i, "x") for i in range(20)] + [(None, None, 1, "y"), (21, "w " * 200_000 + text(41, 12), 1, "z")], "doc_id long, text string, item_id int, distance string")
    bench = spark.createDataFrame([(i, text(40 + i, 12)) for i in range(7)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    assert whole and sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == whole
    assert {21} | set(range(20)) == {x[0] for x in whole}
    assert [tuple(x) for x in decontaminate.decontaminate(docs, bench).collect()] == [(None, None, 1, "y")]


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "So: what is  the capital of PERU? Lima."), (2, "what is the capital of perus?"), (3, "xab cd, ab cdx and ab cd."), (4, "xab cd ab cdx")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "What is the capital of Peru?"), (6, "ab cd"), (7, "  ")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance, r.start) for r in decontaminate.find_leaks(docs, bench).collect()) == [(1, 5, 0, 4), (3, 6, 0, 19)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 4]


def test_myers():
    r = random.Random(4)
    for _ in range(200):
        p, t = ("".join(r.choices("ab", k=r.randrange(1, 12))) for _ in range(2))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        got = decontaminate.myers(p, t, len(p))
        assert got[0] == min(row[1:])


def test_passages(docs):
    got = {(r.doc_id, r.of_doc_id): r for r in substring_dedup.repeated_passages(docs).collect()}
    assert {(2, 1), (3, 1), (9, 8)} == set(got)
    assert (got[9, 8].start_word, got[9, 8].end_word, got[9, 8].of_start_word) == (30, 85, 60)


def test_near_passages_in_clusters(spark):
    """Of all pairs of near passages in clusters of variants, nine tenths at least are joined, directly or over others."""
    r, groups = random.Random(41), []
    for k in range(12):
        base = text(300 + k, 50 + k).split()
        groups.append([edited(base, r, 1).split() for _ in range(8)])
    docs = near_docs(spark, groups)
    words = {x.doc_id: x.text.split() for x in docs.collect()}
    sets = {d: [frozenset(tuple(w[i + m : i + m + 5]) for m in range(46)) for i in range(len(w) - 49)] for d, w in words.items()}
    parent = {d: d for d in words}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    rows = substring_dedup.repeated_passages(docs).collect()
    for x in rows:
        a, b = (frozenset(tuple(w[i : i + 5]) for i in range(s, e - 4)) for w, s, e in ((words[x.doc_id], x.start_word, x.end_word), (words[x.of_doc_id], x.of_start_word, x.of_end_word)))
        assert x.of_doc_id < x.doc_id and min(x.end_word - x.start_word, x.of_end_word - x.of_start_word) >= 50 and 100 * len(a & b) >= 80 * len(a | b)
        parent[max(find(x.doc_id), find(x.of_doc_id))] = min(find(x.doc_id), find(x.of_doc_id))
    near = [(d, e) for d in words for e in words if d < e and d // 8 == e // 8 and any(100 * len(p & q) >= 80 * len(p | q) for p in sets[d] for q in sets[e])]
    assert len(near) > 100 and sum(find(d) == find(e) for d, e in near) >= 0.9 * len(near)


def near_docs(spark, groups):
    """A document for each list of words, between words of its own; ids count from 0."""
    rows = [(d, text(5000 + d, 40) + " " + " ".join(w) + " " + text(7000 + d, 30)) for d, w in enumerate(w for g in groups for w in g)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_all_passages_of_a_pair(spark):
    one, two, far, long = text(30, 60).split(), text(31, 90).split(), text(32, 200).split(), text(33, 400).split()
    edited = [f"edit{i}" if i % 45 == 44 else w for i, w in enumerate(long)]
    docs = near_docs(spark, [[one + far + two, two + text(34, 300).split() + one], [long, edited]])
    got = {(r.doc_id, r.of_doc_id, r.start_word, r.end_word, r.of_start_word, r.of_end_word) for r in substring_dedup.repeated_passages(docs).collect()}
    assert got == {(1, 0, 40, 130, 300, 390), (1, 0, 430, 490, 40, 100), (3, 2, 40, 440, 40, 440)}


def test_near_passages_of_least_length(spark):
    groups = []
    for k in range(36):
        words = text(100 + k, 50 + k % 2).split()
        near, at = list(words), 22 + k % 6
        near[at : at + (k % 3 != 1)] = [] if k % 3 == 2 else [f"edit{k}"]
        groups.append([words, near])
    docs, want = near_docs(spark, groups), set()
    sets = {r.doc_id: [{tuple(w[i + m : i + m + 5]) for m in range(46)} for i in range(len(w) - 49)] for r in docs.collect() for w in [r.text.split()]}
    for d in range(1, len(sets), 2):
        if any(100 * len(a & b) >= 80 * len(a | b) for a in sets[d] for b in sets[d - 1]):
            want.add((d, d - 1))
    assert len(want) > 30 and {(r.doc_id, r.of_doc_id) for r in substring_dedup.repeated_passages(docs).collect()} == want


def test_surroundings_with_repeated_words(monkeypatch):
    """Rows whose equal pairs of shingles are many only by repeated words are told apart before each pair is compared; no similar pair is lost."""
    r, words, tried = random.Random(43), [], []
    for k in range(30):
        own = text(800 + k, 40).split()
        row = [*["again"] * 10, *own[:3], *text(790, 11).split(), own[3], *text(791, 25).split(), *own[4:18], *["more"] * 11]
        words += [row, edited(row, r, 1).split() if k % 2 else text(900 + k, 75).split()[:25] + row[25:]]
    data = [np.frombuffer(b"".join(int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little").to_bytes(8, "little") for w in row), np.uint64) for row in words]
    rows = [(True, True, k, k, 46, np.concatenate([np.array([25, k], np.uint64), d]).tobytes()) for k, d in enumerate(data)]
    similar = substring_dedup.Surroundings.similar
    monkeypatch.setattr(substring_dedup.Surroundings, "similar", lambda self, x, y: tried.append((x, y)) or similar(self, x, y))
    got = set(substring_dedup.Surroundings(rows, 50, 5, 80).links())
    want = {(a, b) for b in range(60) for a in range(b) if substring_dedup.passages(data[b], data[a], [(25, 25)], 50, 5, 80)}
    assert len(want) > 10 and components_of(got) == components_of(want)
    assert len(tried) < 200


def components_of(pairs):
    parts = []
    for a, b in pairs:
        touched = [p for p in parts if a in p or b in p]
        parts = [p for p in parts if p not in touched] + [set().union({a, b}, *touched)]
    return {frozenset(p) for p in parts}


def test_near_passages_in_chains(spark):
    groups = []
    for k in range(20):
        first = text(200 + k, 50).split()
        second = [*first[:25], f"edit{k}", *first[26:]]
        third = [*second[:12], f"other{k}", *second[13:]]
        groups.append([first, second, third])
    got = {(r.doc_id, r.of_doc_id) for r in substring_dedup.repeated_passages(near_docs(spark, groups)).collect()}
    assert got == {(3 * k + d, 3 * k + d - 1) for k in range(20) for d in (1, 2)}


def naive_best_fit(sizes, capacity):
    rooms, bins = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= sizes[i]]
        if not fits:
            rooms.append(capacity)
            bins.append([])
            fits = [(capacity, len(bins) - 1)]
        room = min(fits)[0]
        b = max(b for r, b in fits if r == room)
        rooms[b] -= sizes[i]
        bins[b].append(i)
    return bins


def test_packing(spark, docs, rows, tmp_path):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary = max(ranks.values()) + 3
    packing.write_packed(packing.pack(packing.token_ids(docs, ranks, public_tokenizers.PATTERN), vocabulary, row_ids=128, window_ids=4096), f"{tmp_path}/packed")
    packed, parts = spark.read.parquet(f"{tmp_path}/packed"), collections.defaultdict(list)
    for r in packing.unpack(packed, vocabulary).collect():
        parts[r.doc_id].append((r.offset, np.frombuffer(r.ids, "<u2").tolist()))
    wanted = collections.defaultdict(list)
    for d, t in rows:
        wanted[d] += [*enc.encode_ordinary(t or ""), vocabulary - 2]
    assert {d: sorted(i for _, p in v for i in p) for d, v in parts.items()} == {d: sorted(v) for d, v in wanted.items()}
    assert [i for _, p in sorted(parts[15]) for i in p] == wanted[15]
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 128 and (ids[r.n_ids :] == vocabulary - 1).all() and r.cu_seqlens == [*r.position_resets, r.n_ids]
    assert packing.id_type(1 << 16) == "<u2" and packing.id_type((1 << 16) + 1) == "<u4"


def test_best_fit_against_naive():
    for seed in range(30):
        r = random.Random(seed)
        sizes, capacity = [r.choice([r.randrange(1, 101), 25, 50, 100]) for _ in range(r.randrange(200))], 100
        bins, naive = packing.best_fit(sizes, capacity), naive_best_fit(sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        # Bins of equal room are alike, so any choice among them fills the same rooms.
        assert sorted(sum(sizes[i] for i in b) for b in bins) == sorted(sum(sizes[i] for i in b) for b in naive)


def test_licenses(spark):
    docs = spark.createDataFrame([(1, "a\nReleased under the MIT License.\nb"), (2, "Licensed under CC BY-NC 4.0."), (3, "a license to drive"), (4, None), (5, "Licensed under the Apache License, Version 1.1.")], "doc_id long, text string")
    assert sorted((r.doc_id, r.license) for r in license_scan.scan(docs).collect()) == [(1, "MIT"), (2, "CC-BY-NC-4.0")]


@pytest.mark.parametrize("width", [40, 75, 5000])
def test_wrapped_licenses(width):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name, texts in license_scan.TEMPLATES.items():
        for t in texts:
            lines = textwrap.fill("prose " * 150 + "license " + "prose " * 80 + t + " more" * 90, width, break_long_words=False, break_on_hyphens=False).split("\n")
            assert [x[0] for x in scanner.text("\n".join(" * " + x for x in lines))] == [name]


def test_all_licenses_of_a_line():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    assert sorted(x[0] for x in scanner.text(f"{mit} {gpl} Some prose, and again. {mit}")) == ["GPL-3.0", "MIT", "MIT"]
    every = [(name, max(texts, key=len)) for name, texts in license_scan.TEMPLATES.items()]
    assert sorted(x[0] for x in scanner.text(" And then ".join(t for _, t in every))) == sorted(n for n, _ in every)


def test_clashing_columns(spark):
    """Columns named like an operator's own come back with their values."""
    rows = [(1, "a b", 10, 20, "h", 1), (2, "A B", 11, 21, "i", 2), (3, "other", 12, 22, "j", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __d int, __s int, __h string, slot int")
    assert sorted(map(tuple, exact_dedup.keep_one(docs).collect())) == [rows[1], rows[2]]
    got = sharding.shard_documents(docs, shards=2).select("doc_id", "text", "__d", "__s", "__h").collect()
    assert sorted(map(tuple, got)) == [r[:5] for r in rows]
    assert sorted(map(tuple, jaccard_join.keep_one(docs).collect())) == [rows[0], rows[2]]


def test_scan_against_all_templates(spark):
    """Texts with a template each, some words left out, against aligning every template everywhere."""
    r, scanner, rows, want = random.Random(31), license_scan.Scanner(license_scan.TEMPLATES), [], []
    every = [(name, t) for name, texts in license_scan.TEMPLATES.items() for t in texts]
    for i, (name, t) in enumerate(every):
        words = t.split()
        if len(words) > 30:
            for _ in range(len(words) // 20):
                del words[r.randrange(5, len(words) - 5)]
        prose = [text(900 + i, 40), text(950 + i, 40)]
        rows.append((i, f"{prose[0]}\n# license\n{' '.join(words)}\n{prose[1]}"))
        want.append((i, name))
    got = [(x.doc_id, x.license) for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    lost = {w for w in want if w not in got}
    # Left out may be what tells a license from its neighbour: a version, a name.
    assert len(lost) <= len(want) // 10 and all(d == i for d, i in zip(sorted({g[0] for g in got}), sorted({g[0] for g in got}), strict=True))
    assert len(got) <= len(want)


def test_chat_cases(spark):
    """No events, a long message of many deltas, columns with the names of the output."""
    schema = "conv_id long, seq long, msg long, kind string, role string, text string, formatted string, turns int"
    assert chat_format.chat_format(spark.createDataFrame([], schema)).count() == 0
    log = [(1, i, 0, "delta", "assistant", f"{i}<", "x", 1) for i in range(3000)]
    got = chat_format.read_back(chat_format.chat_format(spark.createDataFrame(log, schema))).first()
    assert got.loss_sha256 == hashlib.sha256("".join(f"{i}<" for i in range(3000)).encode()).hexdigest()


def test_empty_tables(spark, empty):
    labels, bench = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for df in (
        exact_dedup.exact_dedup(empty), jaccard_join.jaccard_components(empty), sharding.shard_documents(empty), bpe.decode(bpe.encode(empty, ranks, public_tokenizers.PATTERN), ranks), toxicity.score_documents(empty, labels),
        decontaminate.find_leaks(empty, bench), substring_dedup.repeated_passages(empty), packing.pack(packing.token_ids(empty, ranks, public_tokenizers.PATTERN), 50_003), license_scan.scan(empty),
    ):
        assert df.count() == 0


def test_passages_look_around_their_places(monkeypatch):
    """What a pair costs that shares no passage does not grow with its texts."""
    rng, sizes, new = np.random.default_rng(5), [], substring_dedup._new
    x, y = rng.integers(1, 1 << 62, (2, 3000), dtype=np.uint64)
    y[1000:1030] = x[1500:1530]
    y[2000:2050] = x[2500:2550]
    y[2025] = 7
    x[1490:1500] = x[1489]  # words repeat, so that windows are counted one by one
    monkeypatch.setattr(substring_dedup, "_new", lambda v, n: sizes.append(len(v)) or new(v, n))
    got = substring_dedup.passages(x, y, [(1500, 1000), (2500, 2000)], 50, 5, 80)
    assert [g[:4] for g in got] == [(2500, 2550, 2000, 2050)] and max(sizes, default=0) < 200


@pytest.mark.parametrize("most", [1, 5, 100])
def test_pieces_outside_memory_take_one_step(monkeypatch, most):
    """When memory is full, a short piece leaves the states once and is encoded as by the definition."""
    monkeypatch.setattr(bpe, "MOST_STATES", most)
    monkeypatch.setattr(bpe, "STEPS_A_STATE", 1 << 30)
    made = bpe.Transducer(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rng, steps, step = random.Random(3), [], made._step
    made._step = lambda state, byte: steps.append(state) or step(state, byte)
    for k in range(300):
        data = "".join(rng.choices(["en", "tion", "è", "a", "ou", "x", "'", "9", "the"], k=rng.randint(1, 14))).encode()[: bpe.PIECE_BYTES]
        before = len(steps), len(made.keys)
        assert np.frombuffer(made.encode(data), "<i4").tolist() == made.merged(data)
        if before[1] >= most:
            assert sum(s < 0 for s in steps[before[0] :]) == 0
    long = ("entionèaoux" * 30).encode()
    assert np.frombuffer(made.encode(long), "<i4").tolist() == made.merged(long)


@pytest.mark.parametrize("most", [1, 40, 1000])
def test_full_memory_takes_no_steps(monkeypatch, most):
    """When memory is full, pieces of any length are ended without steps; where the longest tokens lead nowhere, shorter ones are tried."""
    monkeypatch.setattr(bpe, "MOST_STATES", most)
    monkeypatch.setattr(bpe, "STEPS_A_STATE", 1 << 30)
    real, rng = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(4)
    toy = {t: i for i, t in enumerate([b"a", b"b", b"c", b"ab", b"bc", b"abab", b"cab", b"bca", b"ababc", b"caba", b"bcabab"])}
    for ranks, alphabet in ((toy, "abc"), (real, ["en", "tion", "è", "a", "日本", "x", "'", "9", "the"])):
        made, steps = bpe.Transducer(ranks), []
        step = made._step
        made._step = lambda *of: steps.append(of) or step(*of)  # noqa: B023
        for k in range(120):
            data, before = "".join(rng.choices(alphabet, k=rng.choice([3, 12, 150]))).encode(), (len(steps), len(made.keys))
            assert np.frombuffer(made.encode(data), "<i4").tolist() == made.merged(data)
            assert before[1] < most or len(steps) == before[0]
        assert len(made.keys) <= most


def test_piece_memory(monkeypatch):
    """Met pieces are taken from memory, also from the generation before; long ones are not kept, and both have a bound."""
    monkeypatch.setattr(bpe, "MOST_PIECES", 4)
    made, encoded = bpe.Encoder({bytes([b]): b for b in range(256)}, r"\S+|\s+"), []
    encode = made.fst.encode
    monkeypatch.setattr(made.fst, "encode", lambda data: encoded.append(data) or encode(data))
    for word, new in [("a", 1), ("a", 0), ("b", 1), ("c", 1), ("é" * 32, 1), ("e", 1), ("a", 0), ("f" * 65, 1), ("f" * 65, 1), ("é" * 32, 0), ("b", 0), (None, 0)]:
        before = len(encoded)
        assert np.frombuffer(made(word), "<i4").tolist() == list((word or "").encode())
        assert len(encoded) - before == new, word
        assert len(made.seen) <= 4 and len(made.seen.before) <= 4 and "f" * 65 not in made.seen
